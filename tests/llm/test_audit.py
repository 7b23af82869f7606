"""All orders of the filters, one document after another, against the products."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest

from tessera.llm import audit

DOCS = "doc_id long, text string, lang string, mask string, digest string, n string, good string"
LABELS = "doc_id long, quality int, toxic int, part string"


def fails(rows):
    """The letters each row fails, in the words of the conditions."""
    out = []
    for doc_id, text, *_ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        found = set()
        if len(words) < 200:
            found.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            found.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            found.add("C")
        if re.search(r"[#$%&*|]", t):
            found.add("D")
        if doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == t for r in rows):
            found.add("E")
        out.append(found)
    return out


def brute(rows, labels):
    good, toxic = ({r[0] for r in labels if r[k] == 1} for k in (1, 2))
    out, shapley = defaultdict(lambda: [0] * 6), defaultdict(int)
    for (doc_id, _, lang, *_), failed in zip(rows, fails(rows), strict=True):
        part = lang or ""
        for order in permutations("ABCDE"):
            gone = False
            for step, letter in enumerate(order, 1):
                row = out[part, "".join(order), step]
                if letter in failed:
                    row[3] += failed == {letter}
                    row[2] += gone
                    if not gone:
                        row[1] += 1
                        row[4] += doc_id in good
                        row[5] += doc_id in toxic
                        shapley[part, letter] += 1
                    gone = True
                row[0] += not gone
    return {(*key, *row, shapley[key[0], key[1][key[2] - 1]]) for key, row in out.items()}


def corpus():
    rng = np.random.default_rng(1)
    base = [" ".join(f"w{j}" for j in rng.integers(0, int(rng.integers(50, 900)), 210)) for _ in range(12)]
    rows = []
    for i in range(120):
        t = base[int(rng.integers(0, 12))]
        t = t + [" $", " X" * 40, "", " é&", " "][int(rng.integers(0, 5))]
        t = t[: int(rng.integers(0, 30))] if rng.random() < 0.3 else t
        rows.append((int(rng.integers(0, 90)), t, [None, "", "en", "de"][int(rng.integers(0, 4))], "m", "d", "n", "g"))
    return [*rows, (None, base[0], "en", *"mdng"), (None, base[0], "en", *"mdng"), (500, None, "fr", *"mdng"), (501, "", "fr", *"mdng"), (502, "\x1f\x85 a", "fr", *"mdng"), (502, "\x1f\x85 a", "de", *"mdng")]


def test_all_orders_against_one_by_one(spark):
    rows = corpus()
    labels = [(i, i % 2, int(i % 3 == 0), "p") for i in range(60)] + [(4, 1, 1, "p"), (None, 1, 1, "p"), (7, None, None, "p")]
    got = audit.audit_filters(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 600 * 4
    assert {tuple(r) for r in got} == brute(rows, labels)


def test_matrices_split_every_mask():
    orders, m, own = audit.outcome_matrices(5)
    assert len(orders) == 120 and all(x.shape == (32, 600) for x in m.values())
    fails_own = (np.arange(32)[:, None] >> own) & 1
    assert ((m["removed"] + m["redundant"]) == fails_own).all()
    # each failing mask is removed at one step of each order, and kept to the end only if it fails nothing
    assert (m["removed"].reshape(32, 120, 5).sum(2) == (np.arange(32) > 0)[:, None]).all()
    assert (m["kept"].reshape(32, 120, 5)[:, :, 4] == (np.arange(32) == 0)[:, None]).all()


@pytest.mark.parametrize("docs, labels", [([], []), ([(1, "a", "en", *"mdng")], [])])
def test_empty_tables(spark, docs, labels):
    got = audit.audit_filters(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 600 * len(docs)


def test_a_hot_text_is_a_few_rows_when_copies_meet(spark):
    rows = [(i, "hot", "en", *"mdng") for i in range(2000)] + [(i, f"t{i}", "de", *"mdng") for i in range(2000, 2100)]
    got = audit.audit_filters(spark.createDataFrame(rows, DOCS), spark.createDataFrame([], LABELS))
    first = {(r["part"], r["filter_order"], r["step"]): r for r in got.collect()}
    assert first["en", "EABCD", 1]["removed"] == 1999 and first["en", "EABCD", 1]["kept"] == 1
    assert first["de", "EABCD", 1]["removed"] == 0 and first["en", "AEBCD", 2]["redundant"] == 1999


def test_query_against_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    want = con.execute(audit.ORACLE_SQL)
    names = [d[0] for d in want.description]
    got = audit.op13_audit(spark, folder)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
