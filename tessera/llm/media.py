"""Media columns: read ISO base media containers without decoding payloads.

``parse_container`` walks the nested boxes of one container, decodes the sample
tables of each track (and the runs of movie fragments) and gives codec, duration
and the byte ranges of key frames. ``media_columns`` applies it to a binary column. ``pack_samples`` writes
a payload losslessly as fixed-size 8-bit samples of one track.

Defined results: a null or empty blob, or one that is no container, has
``n_tracks`` 0 and says why in ``problem``; boxes cut off by the end of the blob
end the walk; unknown boxes are skipped; a repeated row gives equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh, table, text_bytes, written

#: Fixed values of the format: boxes that hold boxes, and the bytes before them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0}
SAMPLE_BYTES, SAMPLES_PER_CHUNK, KEY_EVERY, TIMESCALE, CODEC = 64, 64, 16, 8000, b"raw "


def walk(blob: bytes, at: int = 0, end: int | None = None):
    """Yield (type, body start, body end) of the boxes in ``blob[at:end]``, not of their children."""
    end = len(blob) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", blob, at)
        head = 8
        if size == 1:
            if at + 16 > end:
                return
            size, head = struct.unpack_from(">Q", blob, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield kind, at + head, at + size
        at += size


def find(blob: bytes, path: tuple[bytes, ...], at: int, end: int):
    """Bodies of all boxes under ``path``."""
    for kind, b, e in walk(blob, at, end):
        if kind == path[0]:
            if len(path) == 1:
                yield b, e
            else:
                yield from find(blob, path[1:], b, e)


def _one(blob, path, at, end):
    return next(find(blob, path, at, end), None)


def _ints(blob: bytes, at: int, count: int, kind: str) -> np.ndarray:
    return np.frombuffer(blob, kind, count, at).astype(np.int64)


def _track(blob: bytes, at: int, end: int) -> dict | None:
    head, stbl = _one(blob, (b"mdia", b"mdhd"), at, end), _one(blob, (b"mdia", b"minf", b"stbl"), at, end)
    if not head or not stbl:
        return None
    long_form = blob[head[0]] == 1
    scale, duration = struct.unpack_from(">IQ" if long_form else ">II", blob, head[0] + (20 if long_form else 12))
    handler = _one(blob, (b"mdia", b"hdlr"), at, end)
    boxes = {kind: b for kind, b, _ in walk(blob, *stbl)}
    number = lambda kind, skip=4: struct.unpack_from(">I", blob, boxes[kind] + skip)[0] if kind in boxes else 0
    ident = _one(blob, (b"tkhd",), at, end)
    out = {
        "id": struct.unpack_from(">I", blob, ident[0] + (20 if blob[ident[0]] == 1 else 12))[0] if ident else 0,
        "codec": blob[boxes[b"stsd"] + 12 : boxes[b"stsd"] + 16].decode("latin-1") if number(b"stsd") else "",
        "handler": blob[handler[0] + 8 : handler[0] + 12].decode("latin-1") if handler else "",
        "timescale": scale,
        "duration": duration,
    }
    # sizes of samples
    if b"stsz" in boxes:
        fixed, n = struct.unpack_from(">II", blob, boxes[b"stsz"] + 4)
        sizes = np.full(n, fixed, np.int64) if fixed else _ints(blob, boxes[b"stsz"] + 12, n, ">u4")
    elif b"stz2" in boxes:
        field, n = struct.unpack_from(">II", blob, boxes[b"stz2"] + 4)
        field, at2 = field & 255, boxes[b"stz2"] + 12
        if field == 4:
            raw = np.frombuffer(blob, np.uint8, (n + 1) // 2, at2)
            sizes = np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
        else:
            sizes = _ints(blob, at2, n, f">u{field // 8}")
    else:
        sizes, n = np.zeros(0, np.int64), 0
    # offsets of chunks, and the samples of each
    wide = b"co64" in boxes
    chunks = _ints(blob, boxes[b"co64" if wide else b"stco"] + 8, number(b"co64" if wide else b"stco"), ">u8" if wide else ">u4") if wide or b"stco" in boxes else np.zeros(0, np.int64)
    runs = _ints(blob, boxes[b"stsc"] + 8, 3 * number(b"stsc"), ">u4").reshape(-1, 3) if b"stsc" in boxes else np.zeros((0, 3), np.int64)
    if len(runs) and len(chunks):
        each = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
        chunk = np.repeat(np.arange(len(each)), each)[:n]
        before = np.cumsum(sizes[: len(chunk)]) - sizes[: len(chunk)]
        starts = np.searchsorted(chunk, np.arange(len(each)))
        offsets = chunks[chunk] + before - np.append(before, 0)[np.minimum(starts, len(before))][chunk]
    else:
        offsets = np.zeros(0, np.int64)
    n = len(offsets)
    key = _ints(blob, boxes[b"stss"] + 8, number(b"stss"), ">u4") - 1 if b"stss" in boxes else np.arange(n)
    key = key[(key >= 0) & (key < n)]
    times = _ints(blob, boxes[b"stts"] + 8, 2 * number(b"stts"), ">u4").reshape(-1, 2) if b"stts" in boxes else np.zeros((0, 2), np.int64)
    return out | {"offsets": offsets, "sizes": sizes[:n], "key": key, "media_time": int((times[:, 0] * times[:, 1]).sum())}


def _add_fragments(blob: bytes, moov: tuple[int, int], tracks: list[dict]) -> None:
    """Append the samples of movie fragments to their tracks."""
    word = lambda at: struct.unpack_from(">I", blob, at)[0]
    usual = {word(b + 4): (word(b + 12), word(b + 16), word(b + 20)) for b, _ in find(blob, (b"mvex", b"trex"), *moov)}
    by_id = {t["id"]: t for t in tracks}
    for kind, begin, end in walk(blob):
        if kind != b"moof":
            continue
        moof = begin - 8 if word(begin - 8) != 1 or blob[begin - 12 : begin - 8] != b"moof" else begin - 16
        for b, e in find(blob, (b"traf",), begin, end):
            head = _one(blob, (b"tfhd",), b, e)
            track = by_id.get(word(head[0] + 4)) if head else None
            if track is None:
                continue
            # optional fields follow in this order, each if its flag is set
            flags, at, base = word(head[0]) & 0xFFFFFF, head[0] + 8, moof
            span, size, mark = usual.get(track["id"], (0, 0, 0))
            if flags & 1:
                base, at = struct.unpack_from(">Q", blob, at)[0], at + 8
            at += 4 if flags & 2 else 0
            if flags & 8:
                span, at = word(at), at + 4
            if flags & 16:
                size, at = word(at), at + 4
            if flags & 32:
                mark = word(at)
            place = base
            for t, _ in find(blob, (b"trun",), b, e):
                flags, n, at = word(t) & 0xFFFFFF, word(t + 4), t + 8
                if flags & 1:
                    place, at = base + struct.unpack_from(">i", blob, at)[0], at + 4
                first = None
                if flags & 4:
                    first, at = word(at), at + 4
                given = [f for f in (0x100, 0x200, 0x400, 0x800) if flags & f]
                rows = _ints(blob, at, n * len(given), ">u4").reshape(n, len(given))
                own = lambda f, default: rows[:, given.index(f)] if f in given else np.full(n, default, np.int64)
                spans, sizes, marks = own(0x100, span), own(0x200, size), own(0x400, mark)
                if first is not None and n:
                    marks = np.append(first, marks[1:])
                offsets = place + np.cumsum(sizes) - sizes
                place += int(sizes.sum())
                track["key"] = np.append(track["key"], len(track["offsets"]) + np.flatnonzero((marks & 0x10000) == 0))
                track["offsets"], track["sizes"] = np.append(track["offsets"], offsets), np.append(track["sizes"], sizes)
                track["media_time"] += int(spans.sum())


def parse_container(blob: bytes) -> tuple[list[dict], str]:
    """The tracks of a container, and what is wrong with it ('' if nothing)."""
    if not blob:
        return [], "empty"
    moov = _one(blob, (b"moov",), 0, len(blob))
    if moov is None:
        return [], "no moov box"
    try:
        tracks = [t for at in find(blob, (b"trak",), *moov) if (t := _track(blob, *at))]
        _add_fragments(blob, moov, tracks)
    except (struct.error, ValueError, IndexError, KeyError) as e:
        return [], f"broken sample table: {type(e).__name__}"
    return tracks, "" if tracks else "no track"


def payload_of(blob: bytes, track: dict) -> bytes:
    """The samples of a track in order; neighbours are read as one range."""
    at, size = track["offsets"], track["sizes"]
    if not len(at):
        return b""
    cut = np.flatnonzero(at[1:] != at[:-1] + size[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut, len(at)) - 1
    return b"".join(blob[at[i] : at[j] + size[j]] for i, j in zip(first, last, strict=True))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def pack_samples(payload: bytes) -> bytes:
    """A container whose one track holds ``payload`` (a multiple of 64 bytes) as 64-byte groups of 8-bit samples."""
    n = len(payload) // SAMPLE_BYTES
    full, rest = divmod(n, SAMPLES_PER_CHUNK)
    duration, pack = n * SAMPLE_BYTES, struct.pack
    ftyp = _box(b"ftyp", b"isom", pack(">I", 512), b"isomiso2mp41")
    runs = ([(1, SAMPLES_PER_CHUNK, 1)] if full else []) + ([(full + 1, rest, 1)] if rest else [])
    keys = range(1, n + 1, KEY_EVERY)
    entry = _box(CODEC, bytes(6), pack(">H", 1), bytes(8), pack(">HHI", 1, 8, 0), pack(">I", TIMESCALE << 16))

    def moov(first: int) -> bytes:
        chunks = [first + i * SAMPLE_BYTES * SAMPLES_PER_CHUNK for i in range(full + bool(rest))]
        wide = first + len(payload) > 0xFFFFFFFF
        stbl = _box(
            b"stbl",
            _box(b"stsd", pack(">II", 0, 1), entry),
            _box(b"stts", pack(">IIII", 0, 1, n, SAMPLE_BYTES)),
            _box(b"stsc", pack(">II", 0, len(runs)), *(pack(">III", *r) for r in runs)),
            _box(b"stsz", pack(">III", 0, SAMPLE_BYTES, n)),
            _box(b"co64" if wide else b"stco", pack(">II", 0, len(chunks)), pack(f">{len(chunks)}{'Q' if wide else 'I'}", *chunks)),
            _box(b"stss", pack(">II", 0, len(keys)), pack(f">{len(keys)}I", *keys)),
        )
        mdia = _box(
            b"mdia",
            _box(b"mdhd", pack(">IIIIIHH", 0, 0, 0, TIMESCALE, duration, 0x55C4, 0)),
            _box(b"hdlr", bytes(8), b"soun", bytes(12), b"samples\0"),
            _box(b"minf", _box(b"smhd", bytes(8)), stbl),
        )
        tkhd = _box(b"tkhd", pack(">IIIIII", 7, 0, 0, 1, 0, duration), bytes(60))
        mvhd = _box(b"mvhd", pack(">IIIII", 0, 0, 0, TIMESCALE, duration), bytes(80))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = len(ftyp) + len(moov(0)) + 8
    return ftyp + moov(head) + _box(b"mdat", payload)


TRACK = "codec string, handler string, duration_s double, n_samples long, n_keyframes long, keyframes array<struct<start: long, length: long>>"
FIELDS = f"n_tracks int, tracks array<struct<{TRACK}>>, problem string"


def media_columns(df: DataFrame, blob: str = "media") -> DataFrame:
    """Add a struct column ``container`` (fields of ``FIELDS``, a struct for each track); all other columns stay as they are.

    Where ``df`` has a column of that name, the new one is ``_container``.
    """
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    track = pa.struct([("codec", pa.string()), ("handler", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("n_keyframes", pa.int64()), ("keyframes", ranges)])
    kind = pa.struct([("n_tracks", pa.int32()), ("tracks", pa.list_(track)), ("problem", pa.string())])

    def described(t: dict) -> dict:
        # files in fragments say how long they are by their samples alone
        duration = t["duration"] or t["media_time"]
        keys = [{"start": int(t["offsets"][k]), "length": int(t["sizes"][k])} for k in t["key"]]
        return {"codec": t["codec"], "handler": t["handler"], "duration_s": duration / t["timescale"] if t["timescale"] else None, "n_samples": len(t["offsets"]), "n_keyframes": len(keys), "keyframes": keys}

    def read(batches):
        for batch in batches:
            rows = []
            for raw in batch.column(0).to_pylist():
                tracks, problem = parse_container(raw or b"")
                rows.append({"n_tracks": len(tracks), "tracks": [described(t) for t in tracks], "problem": problem})
            yield pa.RecordBatch.from_arrays([pa.array(rows, kind), batch.column(1)], ["container", "kept"])

    (name,) = fresh(df, "container")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    kept = df.select(F.col(f"`{blob}`").cast("binary").alias("media"), row.alias("kept"))
    out = kept.mapInArrow(read, f"container struct<{FIELDS}>, kept {kept.schema['kept'].dataType.simpleString()}")
    return out.select("kept.*", F.col("container").alias(name))


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text, zero-padded to a positive multiple of 64 bytes, as a container."""

    def write(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            media = [pack_samples(t + bytes(-len(t) % SAMPLE_BYTES if t else SAMPLE_BYTES)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("t")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def read_features(stored: DataFrame) -> DataFrame:
    """Features of stored containers, all taken from their bytes through their sample tables."""

    def read(batches):
        for batch in batches:
            out = []
            for blob in batch.column(2).to_pylist():
                track = parse_container(blob)[0][0]
                payload, keys = payload_of(blob, track), track["key"]
                ranges = np.stack([track["offsets"][keys], track["sizes"][keys]], 1)
                feature = f"{track['codec'].strip()};{track['handler']};{track['duration']}/{track['timescale']};samples={len(track['offsets'])};keyframes={len(keys)};at={ranges[0, 0]}-{ranges[-1].sum()};ranges={zlib.crc32(ranges.astype('<i8').tobytes()):08x}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` as a container in the shared folder, read back and described."""
    return read_features(written(store_documents(table(spark, sf_dir, "documents")), "op10-media"))
