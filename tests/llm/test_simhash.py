"""SimHash groups against brute force over all pairs of fingerprints."""

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash as sh

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def brute(fps: np.ndarray, tau: int = 3) -> dict:
    parent = {int(x): int(x) for x in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ x) <= tau]:
            parent[find(int(x))] = find(int(y))
    return {x: find(x) for x in parent}


def partition_of(root: dict) -> set:
    groups = {}
    for x, r in root.items():
        groups.setdefault(r, set()).add(x)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


@pytest.mark.parametrize("chunk", [2048, 40])
def test_links_join_what_brute_force_joins(spark, chunk):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    flip = lambda x, n: x ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, n, replace=False).astype(np.uint64))
    near = [flip(x, n) for x in base[:60] for n in (1, 2, 3, 4, 5)]
    dense = [flip(base[100], int(rng.integers(1, 4))) for _ in range(150)]  # one large family
    fps = np.unique(np.concatenate([base, np.array(near + dense, np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    rows = sh.components(sh.fingerprint_links(df, chunk=chunk)).collect()
    unsigned = lambda x: x & 0xFFFFFFFFFFFFFFFF
    got = partition_of({unsigned(r["node"]): unsigned(r["root"]) for r in rows})
    assert got == partition_of(brute(fps))
    assert all(r["root"] <= r["node"] for r in rows) and len(rows) == len({r["node"] for r in rows})


def test_chain_filter_loses_no_close_pair():
    rng = np.random.default_rng(3)
    diff = np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in (0, 1, 2, 3) for _ in range(500)], np.uint64)
    assert sh.chain_within(diff).all()
    assert not sh.chain_within(np.array([0b1111, (1 << 63) | 0b111], np.uint64)).any()


def test_long_chains_of_links_are_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    root = {r["node"]: r["root"] for r in sh.components(links).collect()}
    assert {root[i] for i in range(201)} == {0} and root[501] == 500


def test_texts_and_odd_rows(spark):
    long = "word " * 30000
    rows = [(4, "A b  c\td"), (2, "a B c d"), (9, None), (7, "   \n"), (7, "   \n"), (None, "one two"), (12, long), (11, long), (13, "x")]
    df = spark.createDataFrame([(i, t, "en", None, 0, "z") for i, t in rows], DOCS)
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in sh.near_duplicates(df).collect()), key=str)
    by = {i: (f, c) for i, f, c in got}
    assert len(got) == len(rows)
    assert by[4] == by[2] and by[2][1] == 2
    assert by[9] == by[7] == ("0" * 16, 7)
    assert by[12] == by[11] == (f"{xxhash.xxh64_intdigest(b'word word word', 42):016x}", 11)
    assert by[13][0] == f"{xxhash.xxh64_intdigest(b'x', 42):016x}"
    assert by[None][1] is None


def test_empty_table(spark):
    assert sh.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("exhaustive", [False, True])
def test_near_copies_against_brute_force_at_the_threshold(spark, tmp_path, exhaustive):
    """Pairs at 0.75 to 0.87 true similarity: those at 0.8 go, those below stay."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    texts = []
    for n in (12, 60, 300, 1500):
        for share in np.linspace(0.76, 0.86, 16):
            a = word(n)
            cut = round(n * 2 * share / (1 + share))
            texts += [" ".join(a), " ".join(a[:cut] + word(n - cut))]
    family = word(400)  # a large group, each copy with an end of its own
    texts += [" ".join(family + word(int(rng.integers(20, 60)))) for _ in range(100)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    linked = {(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    root = list(range(len(texts)))
    for i, j in sorted(linked):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    assert 20 < len({r for r in root[:128]}) - 64 < 50
    df = spark.createDataFrame([(i, t, "en", None, 0, "z") for i, t in enumerate(texts)], DOCS).repartition(4)
    kept = [r["doc_id"] for r in sh.drop_near_duplicates(spark, df, str(tmp_path), exhaustive).collect()]
    assert sorted(kept) == sorted(set(root))


SKEW = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def test_a_hub_is_split(spark, monkeypatch):
    """Joins of a component whose links all lead to one node take several tasks for that node."""
    plans = []

    def spy(df, label, *rest, real=sh.written):
        df.write.format("noop").mode("overwrite").save()
        out = real(df, label, *rest)
        if label in ("links", "links-large"):
            frame = df.selectExpr("*")
            frame.collect()
            plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return out

    before = {k: spark.conf.get(k) for k in SKEW}
    monkeypatch.setattr(sh, "written", spy)
    try:
        for k, v in SKEW.items():
            spark.conf.set(k, v)
        star = spark.range(1, 30_000).selectExpr("0L as a", "id as b").unionByName(spark.createDataFrame([(40_000, 40_001)], "a long, b long"))
        roots = sh.components(star).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(roots) == 30_002 and {r["root"] for r in roots} == {0, 40_000}
    assert any("skew=true" in p for p in plans)


def test_chains_prune_and_lose_nothing():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 16, (4000, 16), dtype=np.uint16)
    b = a.copy()
    flips = rng.integers(0, 80, 4000)
    for i, n in enumerate(flips.tolist()):
        for bit in rng.choice(256, n, replace=False).tolist():
            b[i, bit // 16] ^= np.uint16(1 << (bit % 16))
    diff, tau = np.bitwise_count(a ^ b), np.full(4000, 60)
    near = diff.sum(1, dtype=int) <= 60
    for chain in (1, 2, 3, 8, 16):
        assert sh.chained(diff, tau, chain)[near].all()
    assert (sh.wide_within(a, b, tau) == near).all()
    others = np.bitwise_count(a[:-1] ^ a[1:])
    assert sh.chained(others, tau[:-1], sh.CHAIN).mean() < 0.05


def test_the_pipeline_searches_all_pairs_that_share_a_key():
    import inspect

    import corpus_pipeline

    assert corpus_pipeline.EXHAUSTIVE
    assert all(inspect.signature(f).parameters["exhaustive"].default for f in (sh.drop_near_duplicates, sh.similar_links))


@pytest.mark.parametrize("small", [False, True])
def test_a_group_just_below_the_similarity_makes_no_rows_for_its_pairs(spark, tmp_path, monkeypatch, small):
    """All 11,175 pairs of 150 texts are at 0.77 to 0.79, under shared keys; two more texts of the group are at 0.8 or more with one of them."""
    rng = np.random.default_rng(17)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    common = word(350)
    docs = [common + word(49) for _ in range(150)]
    docs += [docs[40][:390] + word(9), docs[90][:380] + word(19)]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in docs]
    share = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    assert all(0.77 < share(i, j) < 0.79 for i in range(150) for j in range(i)) and share(150, 40) >= 0.8 <= share(151, 90)
    made = {}

    def spy(df, label, *rest, real=sh.written):
        out = real(df, label, *rest)
        made[label] = max(made.get(label, 0), out.count())
        return out

    monkeypatch.setattr(sh, "written", spy)
    if small:  # many chunks of a key
        monkeypatch.setattr(sh.in_question, "__defaults__", (40,))
        monkeypatch.setattr(sh.links_between, "__defaults__", (100_000,))
    df = spark.createDataFrame([(i, " ".join(t), "en", None, 0, "z") for i, t in enumerate(docs)], DOCS).repartition(4)
    kept = [r["doc_id"] for r in sh.drop_near_duplicates(spark, df, str(tmp_path)).collect()]
    assert sorted(kept) == list(range(150))
    assert max(made.values()) <= sh.KEYS * len(docs), made
    assert made["dedup-asked"] > 150
    assert max(n for label, n in made.items() if label in ("dedup-pairs", "dedup-links")) <= sh.NEAREST * len(docs)
