"""Quotation linking: from mail-like messages to reply-ordered conversations.

Each message's lines are parsed into nested quote levels (the number of leading
``>``). Neighbouring lines of one level form a passage; an attribution line
("... wrote:") before a deeper level is no text. Passages and the messages' own
texts are cut into units - the whole and its sentences - in lower case, letters
and digits only. A unit's hash joins a quoted passage to the original: the
earliest message with that unit in its own text, in the same conversation before
the quoting message if there is one, else anywhere in the table, if its
(conv_id, turn) is smaller. A message replies to the original that its outermost
linked passages quote most of. As every parent is earlier than its reply, replies
form trees; root and depth follow by doubling the steps, so that a chain of n
replies takes log n joins.

Only built-in functions are used. Each join has at most one original per key, so
a sentence that everyone quotes joins no pairs.

Defined results: null text is empty; rows that share conv_id and turn are one
message for linking and stay rows of their own; rows with a null conv_id or turn
are neither linked nor linked to; a message without a linked quote is the root of
its own thread; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, written

PREFIX = r"^[ \t]*(?:>[ \t]?)+"
ATTRIBUTION = r"(?i)(wrote|writes|schrieb|a écrit|escribió|ha scritto)[ \t]*:[ \t]*$"
SENTENCE_END = r"([.!?])[ \t\n]+"
OUTSIDE = r"[^\p{L}\p{N}]+"
EDGES = r"^[ \t\n]+|[ \t\n]+$"


def with_passages(rows: DataFrame) -> DataFrame:
    """``rows`` with ``parts`` instead of ``text``: neighbouring lines of one quote level (level, text without the marks), in order.

    Each step's array is a column of its own before the next step looks into it
    by position, so that the time is linear in the number of lines.
    """
    others = [c for c in rows.columns if c != "text"]
    marks = lambda x: F.regexp_extract(x, PREFIX, 0)
    line = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\n", -1)
    lines = rows.select(*others, F.transform(line, lambda x: F.struct(F.length(F.regexp_replace(marks(x), "[^>]", "")).alias("level"), F.regexp_replace(x, PREFIX, "").alias("text"))).alias("every"))
    # an attribution line announces the deeper lines after it
    ahead = lambda x, i: F.coalesce(F.get("every", i + 1)["level"] > x["level"], F.lit(False))
    lines = lines.select(*others, F.filter("every", lambda x, i: ~(ahead(x, i) & x["text"].rlike(ATTRIBUTION))).alias("line"))
    begins = lambda i: (i == 0) | (F.get("line", i)["level"] != F.get("line", i - 1)["level"])
    lines = lines.select(*others, "line", F.when(F.size("line") > 0, F.filter(F.sequence(F.lit(0), F.size("line") - 1), begins)).otherwise(F.array().cast("array<int>")).alias("begin"))
    end = lambda k: F.coalesce(F.get("begin", k + 1), F.size("line"))
    part = lambda s, k: F.struct(F.get("line", s)["level"].alias("level"), F.array_join(F.transform(F.slice("line", s + 1, end(k) - s), lambda x: x["text"]), "\n").alias("text"))
    return lines.select(*others, F.transform("begin", part).alias("parts"))


def normal(text: Column) -> Column:
    """Lower case, one space between runs of letters and digits."""
    return F.trim(F.regexp_replace(F.lower(text), OUTSIDE, " "))


def units(text: Column) -> Column:
    """The whole text and its sentences, normalised; each once, none empty."""
    sentences = F.split(F.regexp_replace(text, SENTENCE_END, "$1\u0001"), "\u0001")
    return F.array_distinct(F.filter(F.concat(F.array(normal(text)), F.transform(sentences, normal)), lambda x: x != ""))


def parsed_messages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, own (text without quotes) and quotes (array of level and text) of each row."""
    rows = with_passages(messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"))
    own = F.array_join(F.transform(F.filter("parts", lambda p: p["level"] == 0), lambda p: p["text"]), "\n")
    own = F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), EDGES, "")
    return rows.select("conv_id", "turn", "role", own.alias("own"), F.filter("parts", lambda p: (p["level"] > 0) & (normal(p["text"]) != "")).alias("quotes"))


def quote_links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, parent_conv, parent_turn and n_linked (passage units with an original) of messages that quote an earlier one."""
    known = parsed.where("conv_id is not null and turn is not null")
    units_of = known.select("conv_id", "turn", F.explode(units(F.col("own"))).alias("unit")).select("conv_id", "turn", F.sha2("unit", 256).alias("key"))
    # written first: a join of two plain tables can split a passage that everyone quotes, one with an aggregate below it can't
    nearby = written(units_of.groupBy("key", "conv_id").agg(F.min("turn").alias("near_turn")), "quote-nearby")
    anywhere = written(nearby.groupBy("key").agg(F.min(F.struct("conv_id", "near_turn")).alias("far")), "quote-anywhere")
    quoted = known.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", F.col("q.level").alias("level"), F.explode(units(F.col("q.text"))).alias("unit"))
    quoted = quoted.select("conv_id", "turn", "level", F.sha2("unit", 256).alias("key"), F.length("unit").cast("long").alias("weight"))
    quoted = written(quoted.join(nearby, ["key", "conv_id"], "left"), "quote-units")
    found = quoted.join(anywhere, "key", "left")
    near = F.col("near_turn") < F.col("turn")
    far = F.col("far").isNotNull() & (F.struct("far.conv_id", "far.near_turn") < F.struct("conv_id", "turn"))
    source = F.when(near, F.struct(F.col("conv_id").alias("c"), F.col("near_turn").alias("t"))).when(far, F.struct(F.col("far.conv_id").alias("c"), F.col("far.near_turn").alias("t")))
    votes = found.withColumn("source", source).where("source is not null").groupBy("conv_id", "turn", "level", "source").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
    best = F.max(F.struct((-F.col("level")).alias("a"), F.col("weight").alias("b"), (F.col("source.c") == F.col("conv_id")).alias("same"), (-F.col("source.c")).alias("c"), (-F.col("source.t")).alias("t")))
    return votes.groupBy("conv_id", "turn").agg(best.alias("best"), F.sum("n").alias("n_linked")).select("conv_id", "turn", (-F.col("best.c")).alias("parent_conv"), (-F.col("best.t")).alias("parent_turn"), "n_linked")


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, thread_conv, thread_turn and depth of each linked message: its root and the steps to it."""
    now = written(links.select("conv_id", "turn", F.col("parent_conv").alias("up_conv"), F.col("parent_turn").alias("up_turn"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        above = now.select(F.col("conv_id").alias("up_conv"), F.col("turn").alias("up_turn"), F.col("up_conv").alias("c"), F.col("up_turn").alias("t"), F.col("depth").alias("d"))
        step = now.join(above, ["up_conv", "up_turn"], "left").select("conv_id", "turn", F.coalesce("c", "up_conv").alias("up_conv"), F.coalesce("t", "up_turn").alias("up_turn"), (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"), F.col("c").isNotNull().alias("moved"))
        step = written(step, "threads")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now.select("conv_id", "turn", F.col("up_conv").alias("thread_conv"), F.col("up_turn").alias("thread_turn"), "depth")


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Messages without quotes, in reply order: thread by thread, parents before replies."""
    parsed = written(parsed_messages(messages), "messages")
    links = written(quote_links(parsed), "quote-links")
    placed = links.join(threads(links), ["conv_id", "turn"])
    deepest = F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0))
    rows = parsed.select("conv_id", "turn", "role", F.size("quotes").alias("n_quotes"), deepest.alias("deepest_quote"), F.col("own").alias("text"))
    return (
        rows.join(placed, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "role", "parent_conv", "parent_turn",
            F.coalesce("thread_conv", "conv_id").alias("thread_conv"),
            F.coalesce("thread_turn", "turn").alias("thread_turn"),
            F.coalesce("depth", F.lit(0)).alias("depth"),
            "n_quotes", "deepest_quote",
            F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
            "text",
        )
        .orderBy("thread_conv", "thread_turn", "depth", "conv_id", "turn")
    )


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` with quotes parsed, linked and taken out."""
    return reply_ordered(table(spark, sf_dir, "conversations"))


def quoting_conversations(conversations: DataFrame) -> DataFrame:
    """The conversations as a mailing list would have them: each turn quotes the one before, and below it the one before that."""
    said = conversations.groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("said"))
    before = lambda n: said.select("conv_id", (F.col("turn") + n).alias("turn"), F.regexp_replace("said", r"\r\n?", "\n").alias(f"said{n}"))
    rows = conversations.join(before(1), ["conv_id", "turn"], "left").join(before(2), ["conv_id", "turn"], "left")
    quoted = lambda n: F.concat(F.lit(f"A{n} wrote:\n"), F.lit("> " * n), F.regexp_replace(f"said{n}", "\n", "\n" + "> " * n), F.lit("\n"))
    return rows.select("conv_id", "turn", "role", F.concat_ws("", quoted(2), quoted(1), F.coalesce("text", F.lit(""))).alias("text"))


def quoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, threads and unquoted texts of conversations that quote by a fixed rule."""
    return reply_ordered(quoting_conversations(table(spark, sf_dir, "conversations")))


ORACLE_SQL = r"""
WITH RECURSIVE
m AS (SELECT row_number() OVER () AS r, CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role,
             regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM conversations),
l0 AS (SELECT r, i, string_split(t, chr(10))[i] AS line FROM m, LATERAL (SELECT unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i)),
l1 AS (SELECT r, i, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]?)+'), '[^>]', '', 'g')) AS level,
              regexp_replace(line, '^[ \t]*(?:>[ \t]?)+', '') AS line FROM l0),
l2 AS (SELECT r, i, level, line FROM (SELECT *, lead(level) OVER (PARTITION BY r ORDER BY i) AS next_level FROM l1)
       WHERE NOT (coalesce(next_level > level, false)
                  AND regexp_matches(line, '(?i)(wrote|writes|schrieb|a écrit|escribió|ha scritto)[ \t]*:[ \t]*$'))),
l3 AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS part FROM
       (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY r ORDER BY i) THEN 1 ELSE 0 END AS new FROM l2)),
p AS (SELECT r, part, min(level) AS level, string_agg(line, chr(10) ORDER BY i) AS t FROM l3 GROUP BY r, part),
q AS (SELECT * FROM p WHERE level > 0 AND trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g')) <> ''),
own AS (SELECT m.r, m.conv_id, m.turn, m.role, regexp_replace(regexp_replace(coalesce(o.t, ''), '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n]+|[ \t\n]+$', '', 'g') AS t
        FROM m LEFT JOIN (SELECT r, string_agg(t, chr(10) ORDER BY part) AS t FROM p WHERE level = 0 GROUP BY r) o ON o.r = m.r),
ou AS (SELECT DISTINCT conv_id, turn, u FROM
       (SELECT conv_id, turn, unnest(list_concat([t], string_split(regexp_replace(t, '([.!?])[ \t\n]+', '\1' || chr(1), 'g'), chr(1)))) AS s FROM own
        WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
       LATERAL (SELECT trim(regexp_replace(lower(s), '[^\p{L}\p{N}]+', ' ', 'g')) AS u) WHERE u <> ''),
qu AS (SELECT r, conv_id, turn, level, u FROM
       (SELECT DISTINCT r, part, conv_id, turn, level, trim(regexp_replace(lower(s), '[^\p{L}\p{N}]+', ' ', 'g')) AS u FROM
        (SELECT q.r, q.part, m.conv_id, m.turn, q.level, unnest(list_concat([q.t], string_split(regexp_replace(q.t, '([.!?])[ \t\n]+', '\1' || chr(1), 'g'), chr(1)))) AS s
         FROM q JOIN m ON m.r = q.r WHERE m.conv_id IS NOT NULL AND m.turn IS NOT NULL)) WHERE u <> ''),
near AS (SELECT u, conv_id, min(turn) AS turn FROM ou GROUP BY u, conv_id),
far AS (SELECT u, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY conv_id, turn) AS k FROM near) WHERE k = 1),
v AS (SELECT * FROM (SELECT qu.conv_id, qu.turn, qu.level, length(qu.u) AS w,
        CASE WHEN n.turn < qu.turn THEN n.conv_id WHEN f.conv_id < qu.conv_id OR f.conv_id = qu.conv_id AND f.turn < qu.turn THEN f.conv_id END AS sc,
        CASE WHEN n.turn < qu.turn THEN n.turn WHEN f.conv_id < qu.conv_id OR f.conv_id = qu.conv_id AND f.turn < qu.turn THEN f.turn END AS st
      FROM qu LEFT JOIN near n ON n.u = qu.u AND n.conv_id = qu.conv_id LEFT JOIN far f ON f.u = qu.u) WHERE sc IS NOT NULL),
best AS (SELECT conv_id, turn, sc, st, sum(n) OVER (PARTITION BY conv_id, turn) AS n_linked,
                row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, w DESC, (sc = conv_id) DESC, sc, st) AS k
         FROM (SELECT conv_id, turn, level, sc, st, sum(w) AS w, count(*) AS n FROM v GROUP BY ALL)),
link AS (SELECT conv_id, turn, sc, st, CAST(n_linked AS BIGINT) AS n_linked FROM best WHERE k = 1),
up AS (SELECT conv_id, turn, sc, st, 1 AS depth FROM link
       UNION ALL SELECT up.conv_id, up.turn, link.sc, link.st, up.depth + 1 FROM up JOIN link ON link.conv_id = up.sc AND link.turn = up.st),
root AS (SELECT conv_id, turn, max(depth) AS depth, arg_max(sc, depth) AS sc, arg_max(st, depth) AS st FROM up GROUP BY conv_id, turn),
nq AS (SELECT r, count(*) AS n, max(level) AS deepest FROM q GROUP BY r)
SELECT own.conv_id, own.turn, own.role, link.sc AS parent_conv, link.st AS parent_turn,
       coalesce(root.sc, own.conv_id) AS thread_conv, coalesce(root.st, own.turn) AS thread_turn, CAST(coalesce(root.depth, 0) AS BIGINT) AS depth,
       CAST(coalesce(nq.n, 0) AS INTEGER) AS n_quotes, CAST(coalesce(nq.deepest, 0) AS INTEGER) AS deepest_quote, coalesce(link.n_linked, 0) AS n_linked, own.t AS text
FROM own LEFT JOIN link ON link.conv_id = own.conv_id AND link.turn = own.turn
LEFT JOIN root ON root.conv_id = own.conv_id AND root.turn = own.turn LEFT JOIN nq ON nq.r = own.r
"""

QUOTING_SQL = ORACLE_SQL.replace("FROM conversations)", "FROM quoting)").replace("WITH RECURSIVE", r"""WITH RECURSIVE
said AS (SELECT conv_id, turn, regexp_replace(min(coalesce(text, '')), '\r\n?', chr(10), 'g') AS said FROM conversations GROUP BY conv_id, turn),
quoting AS (SELECT c.conv_id, c.turn, c.role,
  coalesce('A2 wrote:' || chr(10) || '> > ' || replace(s2.said, chr(10), chr(10) || '> > ') || chr(10), '') ||
  coalesce('A1 wrote:' || chr(10) || '> ' || replace(s1.said, chr(10), chr(10) || '> ') || chr(10), '') || coalesce(c.text, '') AS text
  FROM conversations c LEFT JOIN said s1 ON s1.conv_id = c.conv_id AND s1.turn = c.turn - 1 LEFT JOIN said s2 ON s2.conv_id = c.conv_id AND s2.turn = c.turn - 2),""", 1)
