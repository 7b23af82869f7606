"""Containers: exact round trips and hand-made boxes."""

import hashlib
import struct
import zlib

import pytest

from tessera.llm import media


@pytest.mark.parametrize("size", [64, 128, 4096, 4160, 64 * 1000])
def test_round_trip(size):
    payload = bytes(i * 7 % 256 for i in range(size))
    blob = media.pack_samples(payload)
    tracks, problem = media.parse_container(blob)
    (t,) = tracks
    assert not problem and media.payload_of(blob, t) == payload and t["codec"] == "raw " and t["handler"] == "soun"
    assert t["duration"] == size == t["media_time"] and list(t["key"]) == list(range(0, size // 64, 16))
    k = t["key"][-1]
    assert blob[t["offsets"][k] : t["offsets"][k] + 64] == payload[64 * k : 64 * k + 64]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def hand_made(wide=False):
    """A track of 5 samples of different sizes in 3 chunks, not in file order, behind a 64-bit sized box."""
    p = struct.pack
    data = b"AABBBCDDDDEEEEE"
    large = p(">I4sQ", 1, b"free", 16 + 4) + b"skip"
    mdat = box(b"mdat", b"DDDD", b"EEEEE", b"AABBB", b"C")
    base = len(large) + 8
    chunks = [base + 9, base + 14, base]
    stbl = box(
        b"stbl",
        box(b"stsd", p(">II", 0, 1), box(b"avc1", bytes(70))),
        box(b"stts", p(">IIIII", 0, 2, 3, 100, 2) + p(">I", 50)),
        box(b"stsc", p(">II", 0, 3), p(">9I", 1, 2, 1, 2, 1, 1, 3, 2, 1)),
        box(b"stz2", p(">IIIB", 0, 8, 5, 2), bytes([3, 1, 4, 5])) if wide else box(b"stsz", p(">III5I", 0, 0, 5, 2, 3, 1, 4, 5)),
        box(b"co64", p(">II3Q", 0, 3, *chunks)) if wide else box(b"stco", p(">II3I", 0, 3, *chunks)),
        box(b"stss", p(">III", 0, 2, 1) + p(">I", 4)),
    )
    mdhd = box(b"mdhd", p(">B3xQQIQI", 1, 0, 0, 90000, 180000, 0)) if wide else box(b"mdhd", p(">IIIIII", 0, 0, 0, 90000, 180000, 0))
    trak = box(b"trak", box(b"tkhd", bytes(84)), box(b"mdia", mdhd, box(b"hdlr", bytes(8), b"vide", bytes(12)), box(b"minf", stbl)))
    return large + mdat + box(b"moov", box(b"mvhd", bytes(100)), trak), data


@pytest.mark.parametrize("wide", [False, True])
def test_sample_tables(wide):
    blob, data = hand_made(wide)
    (t,), problem = media.parse_container(blob)
    assert not problem and media.payload_of(blob, t) == data and t["codec"] == "avc1" and t["duration"] / t["timescale"] == 2
    assert [blob[t["offsets"][k] : t["offsets"][k] + t["sizes"][k]] for k in t["key"]] == [b"AA", b"DDDD"]


def test_media_columns(spark):
    good = hand_made()[0]
    rows = [(1, good, "x"), (1, good, "x"), (2, None, None), (3, b"", ""), (4, b"not a container at all", ""), (5, good[:-40], ""), (None, good, None)]
    out = media.media_columns(spark.createDataFrame(rows, "id long, media binary, codec string")).collect()
    by = sorted(((str(r["id"]), r["container"]["n_tracks"], (r["container"]["tracks"] or [{"n_keyframes": 0}])[0]["n_keyframes"], r["container"]["problem"]) for r in out))
    assert by == [("1", 1, 2, ""), ("1", 1, 2, ""), ("2", 0, 0, "empty"), ("3", 0, 0, "empty"), ("4", 0, 0, "no moov box"), ("5", 0, 0, "no moov box"), ("None", 1, 2, "")]
    assert out[0]["container"]["tracks"][0]["keyframes"][0]["length"] == 2 and out[0]["codec"] == "x"


def test_documents(spark):
    texts = [(1, "é" * 40), (2, None), (3, ""), (4, "a" * 64), (5, "long " * 50000), (5, "long " * 50000), (None, "x")]
    df = spark.createDataFrame([(i, t, "k") for i, t in texts], "doc_id long, text string, media string")
    rows = media.read_features(media.store_documents(df)).collect()
    assert len(rows) == 7
    for r, (i, t) in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"])), texts):
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (i, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        blob = media.pack_samples(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(blob), hashlib.sha256(blob).hexdigest())
    assert media.read_features(media.store_documents(df.limit(0))).collect() == []


def test_all_tracks_and_fragments(spark):
    """Two tracks, each with samples in the tables or in fragments, against positions laid down by hand."""
    pack, box = struct.pack, media._box

    def trak(number, handler, codec, stbl):
        mdhd = box(b"mdhd", pack(">IIIIIHH", 0, 0, 0, 100, 0, 0, 0))
        hdlr = box(b"hdlr", bytes(8), handler, bytes(13))
        stsd = box(b"stsd", pack(">II", 0, 1), box(codec, bytes(8)))
        return box(b"trak", box(b"tkhd", pack(">IIIIII", 7, 0, 0, number, 0, 0), bytes(60)), box(b"mdia", mdhd, hdlr, box(b"minf", box(b"stbl", stsd, *stbl))))

    mvex = box(b"mvex", *(box(b"trex", pack(">IIIIII", 0, n, 1, 25, 5, 0x10000)) for n in (1, 2)))
    start = box(b"ftyp", b"iso5", bytes(4)) + box(b"moov", trak(1, b"soun", b"mp4a", []), trak(2, b"vide", b"avc1", []), mvex)

    def moof(at):
        sound = box(b"traf", box(b"tfhd", pack(">III", 0x20020, 1, 0)), box(b"trun", pack(">IIi", 1, 3, at)))
        picture = box(b"traf", box(b"tfhd", pack(">II", 0x20000, 2)), box(b"trun", pack(">IIiI", 0x205, 3, at + 15, 0), pack(">III", 7, 8, 9)))
        return box(b"moof", box(b"mfhd", bytes(8)), sound, picture)

    head = len(moof(0)) + 8
    blob = start + moof(head) + box(b"mdat", bytes(39))
    data = len(start) + head
    row = media.media_columns(spark.createDataFrame([(blob, 1)], "media binary, container int")).first()
    assert row["container"] == 1 and row["_container"]["problem"] == ""
    sound, picture = row["_container"]["tracks"]
    assert (sound["codec"], sound["handler"], sound["n_samples"], sound["duration_s"]) == ("mp4a", "soun", 3, 0.75)
    assert [(k["start"] - data, k["length"]) for k in sound["keyframes"]] == [(0, 5), (5, 5), (10, 5)]
    assert (picture["codec"], picture["n_samples"]) == ("avc1", 3) and [(k["start"] - data, k["length"]) for k in picture["keyframes"]] == [(15, 7)]
