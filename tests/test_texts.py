"""Heading paths, bounds on authors, the log's chain, Italian stems."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import stems
from tessera.operators import bounds, headings, ingest
from tessera.operators.postings import Postings
from tessera.sources.audit import AuditLog, linked

PAGES = "document string, page int, markdown string"


def blocks_by_hand(text):
    """One line after another: a stack of headings, blocks up to blank lines."""
    out, stack, block, fenced = [], [], [], False

    def end():
        if block:
            out.append((" > ".join(t for _, t in stack), "\n".join(block)))
            block.clear()

    for line in text.split("\n"):
        marks = len(line) - len(line.lstrip("#"))
        if line.strip().startswith("```"):
            fenced = not fenced
            block.append(line)
        elif not fenced and 1 <= marks <= 6 and line[marks : marks + 1] == " " and line[marks:].strip():
            end()
            while stack and stack[-1][0] >= marks:
                stack.pop()
            stack.append((marks, line[marks:].strip()))
        elif not fenced and not line.strip():
            end()
        else:
            block.append(line)
    end()
    return out


def test_paths_against_a_stack(spark):
    rng = random.Random(2)
    line = lambda: rng.choice(["# One", "## Two", "### Three", "#### Four", "## Again", "", "", "text a", "text b", "#no heading", "####### seven", "- item", "```", "  "])
    texts = {f"d{i}": "\n".join(line() for _ in range(rng.randrange(0, 40))) for i in range(40)}
    got = headings.heading_blocks(spark.createDataFrame([(d, 0, t) for d, t in texts.items()], PAGES))
    found = {}
    for r in sorted(got.collect(), key=lambda r: r["block"]):
        found.setdefault(r["document"], []).append((r["path"], r["text"]))
    assert {d: found.get(d, []) for d in texts} == {d: blocks_by_hand(t) for d, t in texts.items()}


def test_headings_hold_over_pages_and_pieces_carry_them(spark):
    rows = [("a", 2, "still two\n\n# Next ##\nafter"), ("a", 1, "# One\n## Two\nfirst"), ("a", None, "front"), ("b", 1, None), ("c", 1, "")]
    got = headings.heading_blocks(spark.createDataFrame(rows, PAGES)).orderBy("block").collect()
    assert [(r["page"], r["piece"]) for r in got] == [(None, "front"), (1, "One > Two\nfirst"), (2, "One > Two\nstill two"), (2, "Next\nafter")]


def test_pages_of_html(spark):
    html = "<html><head><title>x</title></head><body><!-- <h1>no</h1> --><H1 class='a'>Red &amp; blue</H1><p>one<b>two</b> three<br>four<ul><li>five</li></ul><script>var a='<p>';</script><h2>Sub</h2>six</body></html>"
    df = spark.createDataFrame([("d", 1, html)], PAGES).withColumn("markdown", headings.html_to_markdown(F.col("markdown")))
    got = [(r["path"], r["text"].strip()) for r in headings.heading_blocks(df).orderBy("block").collect()]
    assert got == [("Red & blue", "onetwo three"), ("Red & blue", "four"), ("Red & blue", "- five"), ("Red & blue > Sub", "six")]


# --- bounds


def test_a_long_run_is_ended_and_others_go_on(spark):
    def sleepy(batches):
        for b in batches:
            time.sleep(60)
            yield b

    def slow():
        return spark.range(0, 8, 1, 8).repartition(8).mapInPandas(sleepy, "id long")

    began = time.time()
    with pytest.raises(bounds.NotRun) as e:
        bounds.bounded(spark, slow, seconds=2)
    assert e.value.family == "too slow" and time.time() - began < 15
    deadline = time.time() + 10
    while spark.sparkContext.statusTracker().getActiveJobsIds() and time.time() < deadline:
        time.sleep(0.1)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds() and not spark.sparkContext.getJobTags()
    assert bounds.bounded(spark, lambda: spark.range(100), seconds=60, rows=40) == ([(i,) for i in range(40)], True)
    assert bounds.bounded(spark, lambda: spark.range(3)) == ([(0,), (1,), (2,)], False)


def test_a_run_that_starts_job_after_job_is_ended(spark):
    def endless():
        while True:
            spark.range(10).count()

    with pytest.raises(bounds.NotRun, match="too slow"):
        bounds.bounded(spark, endless, seconds=1)


@pytest.mark.parametrize(
    "sql, family",
    [
        ("SELECT nothing FROM range(3)", "unknown name"), ("SELECT * FROM no_such_table", "unknown name"), ("SELECT no_function(id) FROM range(3)", "unknown name"), ("SELEC id", "syntax"),
        ("SELECT id, count(*) FROM range(3)", "grouping"), ("SELECT id FROM range(3) GROUP BY id + 1", "grouping"), ("SELECT id + array(1) FROM range(3)", "types"), ("SELECT cast('x' AS int) FROM range(3)", "types"),
        ("SELECT raise_error('no') FROM range(3)", "not run"),
    ],
)
def test_errors_have_families(spark, sql, family):
    with pytest.raises(bounds.NotRun) as e:
        bounds.bounded(spark, lambda: spark.sql(sql))
    assert e.value.family == family


def test_patterns(spark):
    assert bounds.checked_pattern("star|stellar") == "star|stellar" and bounds.checked_pattern(" star |x") == " star |x"
    with pytest.raises(ValueError, match="'star motif'; leave it out: 'star|stellar'"):
        bounds.checked_pattern("star|star motif|stellar")
    with pytest.raises(ValueError, match="'white' and 'ribbon' in two conditions"):
        bounds.checked_pattern("white ribbon")
    df = spark.createDataFrame([("a|b c| d |",), ("x  y",), ("",), (None,)], "p string")
    got = df.select(bounds.refused_alternatives(F.col("p")).alias("r"), bounds.cleaned_pattern(F.col("p")).alias("c")).collect()
    assert [tuple(r) for r in got] == [(["b c"], "a| d "), (["x  y"], None), ([], None), (None, None)]


# --- the log


ROWS = "id long, who string, what string"


def a_log(spark, path):
    log = AuditLog(spark, str(path), ROWS)
    ends = [log.append(spark.createDataFrame([(10 * b + i, "ann", None if i == 2 else f"did {i}") for i in range(4)], ROWS)) for b in range(3)]
    return log, ends[-1]


def rewritten(spark, log, batch, change):
    rows = spark.createDataFrame(change([tuple(r) for r in log.rows().where(F.col("batch") == batch).drop("batch").collect()]), ROWS)
    rows.write.mode("overwrite").parquet(f"{log.path}/rows/batch={batch}")


def test_an_untouched_log_is_whole_whatever_its_files(spark, tmp_path):
    log, end = a_log(spark, tmp_path)
    assert log.first_broken(end) is None and log.rows().count() == 12
    rewritten(spark, log, 1, lambda rows: rows[::-1])  # other order, other files
    assert log.first_broken(end) is None
    assert AuditLog(spark, str(tmp_path / "none"), ROWS).chain() == []


@pytest.mark.parametrize(
    "change",
    [lambda rows: [(rows[0][0], "eve", rows[0][2]), *rows[1:]], lambda rows: rows[1:], lambda rows: [*rows, rows[0]], lambda rows: [*rows[1:], (99, "eve", None)], lambda rows: [(r[0], r[1], r[2] or "null") for r in rows]],
    ids=["changed", "removed", "added", "replaced", "null filled in"],
)
def test_the_first_broken_batch_is_named(spark, tmp_path, change):
    log, end = a_log(spark, tmp_path)
    rewritten(spark, log, 1, change)
    assert log.first_broken(end) == 1


def test_lost_batches_and_rewritten_chains(spark, tmp_path):
    import shutil

    log, end = a_log(spark, tmp_path)
    shutil.copytree(log.path, tmp_path / "copy")
    shutil.rmtree(f"{log.path}/rows/batch=2")
    assert log.first_broken(end) == 2
    other = AuditLog(spark, str(tmp_path / "copy"), ROWS)
    spark.createDataFrame([(100, "eve", "x")], ROWS).write.parquet(f"{other.path}/rows/batch=7")
    assert other.first_broken() == 7
    shutil.rmtree(f"{other.path}/rows/batch=7")
    # the last batch and its link are taken out together: only the noted end tells
    held = [tuple(r) for r in other.chain()][:2]
    shutil.rmtree(f"{other.path}/rows/batch=2")
    spark.createDataFrame(held, "batch long, n long, digest string, link string").write.mode("overwrite").parquet(f"{other.path}/chain")
    assert other.first_broken() is None and other.first_broken(end) == 1
    assert held[1][3] == linked(held[0][3], held[1][2])


def test_a_batch_without_its_link_is_written_anew(spark, tmp_path):
    log, _ = a_log(spark, tmp_path)
    spark.createDataFrame([(1, "x", "cut off")], ROWS).write.parquet(f"{log.path}/rows/batch=3")
    assert log.first_broken() == 3
    log.append(spark.createDataFrame([(2, "y", "whole")], ROWS))
    assert log.first_broken() is None and log.rows().count() == 13


# --- stems: words of the published vocabulary and their stems (fixed values)


VOCABULARY = """abbandonata abbandon abbandonerà abbandon abbandoneranno abbandon abbandono abband abbandonò abbandon abbaruffato abbaruff abbassamento abbass
abbassando abbass abbassandola abbass abbassandole abbass abbassar abbass abbassarono abbass abbassarsi abbass abbassassero abbass abbassi abbass abbassò abbass
abbastanza abbast abbatté abbatt abbattendo abbatt abbattersi abbatt abbattesse abbattess abbattevamo abbatt abbattimento abbatt abbattuta abbatt pronto pront
pronuncerà pronunc pronuncia pronunc pronunciamento pronunc pronunciarsi pronunc pronunziano pronunz pronunziarle pronunz pronunziò pronunz propaga propag
propagamento propag propaganda propagand propagarla propag propagasse propag propagazione propag propaghino propaghin propalate propal propende prop propensi propens
propensione propension propini propin propio prop propizio propiz propone propon proponendosi propon proponenti proponent proponevano propon proponga propong""".split()


def test_stems_of_the_vocabulary():
    pairs = list(zip(VOCABULARY[::2], VOCABULARY[1::2], strict=True))
    assert [(w, stems.stem(w), s) for w, s in pairs if stems.stem(w) != s] == []


def test_stop_words_and_short_words():
    assert {"della", "sugli", "nell", "dal", "coi", "agli", "il", "non"} <= stems.STOP_WORDS and "nastro" not in stems.STOP_WORDS
    assert [stems.stem(w) for w in ("", "a", "è", "x9", "qui", "aiuola", "123")] == [stems.stem(w) for w in ("", "a", "è", "x9", "qui", "aiuola", "123")]
    assert stems.analysed("Le tazze della cucina e la tazza") == [stems.stem("tazze"), stems.stem("cucina")] and stems.stem("tazze") == stems.stem("tazza")


def test_search_by_stems_and_the_default_without(spark, tmp_path):
    c = spark.createDataFrame([(1, "Tazze per la cucina"), (2, "la tazza"), (3, "della e il"), (4, None), (5, "cucinare")], "id long, content string")
    rows = {r["id"]: set(r["content"]) for r in stems.stemmed(c).collect()}
    assert rows == {1: {stems.stem("tazze"), stems.stem("cucina")}, 2: {stems.stem("tazza")}, 3: set(), 4: set(), 5: {stems.stem("cucinare")}}
    index = Postings(spark, str(tmp_path / "stems"), lambda words: words, 4)
    index.update(None, stems.stemmed(c))
    assert sorted(r["id"] for r in index.postings(stems.analysed("una tazza")).collect()) == [1, 2] and index.total() == 5
    plain = Postings(spark, str(tmp_path / "words"), buckets=4)
    plain.update(None, c)
    assert [r["id"] for r in plain.postings(["tazza"]).collect()] == [2] and plain.postings(["della"]).count() == 1


def test_first_lines_keep_their_digits(spark):
    """A line's number in its text is no character to trim."""
    rows = [("a", 1, "  call 555-8630\nmore"), ("a", 2, " | x\n \n 3 boats 32 "), ("b", 3, "0"), ("b", 4, None)]
    out = ingest.heading_sample(spark.createDataFrame(rows, "document string, ord long, piece string"))
    assert sorted(map(tuple, out.collect())) == [("a", 1, "call 555-8630"), ("a", 2, "3 boats 32"), ("b", 1, "0")]


def test_page_titles_keep_their_digits(spark):
    """Spaces of any kind are trimmed, digits that equal a line's number are not."""
    rows = [(1, "\u00a0call 555-8630 \n```\n\u2003\n 1 boat 21\n3 oars 43\n5"), (2, "0"), (3, "")]
    out = spark.createDataFrame(rows, "id long, content string").select("id", ingest.page_title(F.col("content")))
    assert sorted(map(tuple, out.collect())) == [(1, "call 555-8630 1 boat 21 3 oars 43"), (2, "0"), (3, "")]
