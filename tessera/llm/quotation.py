"""Quotation linking of conversations, in DataFrame and SQL functions only.

1.  Each line of a message has a quote level: the number of ``>`` marks it begins
    with. Consecutive quoted lines of one level are a passage.
2.  Lines are normalised (marks off, lower case, runs of characters other than
    letters and digits as one space) and hashed. A quoted line is joined by its
    hash to own (unquoted) lines of earlier messages of the same conversation; a
    passage is linked to the message that holds most of its lines, the latest of
    those that hold as many.
3.  A message replies to the message its passage of the lowest level is linked to
    (the first such passage with a link; so a quote within a quote does not
    outrank the quote around it). One without a linked passage follows the
    message before it.
4.  Quoted lines go from the text, with the lines that only introduce them, and
    each message gets its place in reply order: a reply comes after what it
    replies to. Originals are earlier turns, so the order of turns is such an
    order, and holds within each branch.

Hot conversations: lines are grouped by conversation and hash with partial
minima and counts, never collected; the join's key holds the hash as well, so a
long conversation is many keys. Positions are counted in segments of turns.

Defined results: a null text has no lines and stays null; a conversation's rows
that share a turn are told apart by role and text in their order; rows equal in
all of these are one message; a null conversation id is a conversation; extra
columns are not kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import written

MARKS = r"^[ \t]*(>[ \t>]*)"
#: Turns in a segment of a conversation.
SEGMENT = 256
#: A line that only introduces a quotation, right before it.
INTRO = r"(?i)(wrote|writes|said|says|schrieb|a écrit|escribió)\s*:\s*$|^-+\s*original message\s*-+\s*$"


def quote_level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), r"[^>]", "")).cast("long")


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"[^\p{L}\p{N}]+", " "))


def messages_of(conversations: DataFrame) -> DataFrame:
    """Messages with a key of their own: conversation, turn, and a hash of role and text."""
    base = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct()
    return base.withColumn("mark", F.xxhash64("role", "text"))


def with_next(text: Column) -> Column:
    """The lines of a text, each with the line after it."""
    parts = F.split(text, "\n")
    return F.zip_with(parts, F.concat(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit(""))), lambda a, b: F.struct(a.alias("raw"), b.alias("next")))


def introduces(pair: Column) -> Column:
    return (quote_level(pair["raw"]) == 0) & (quote_level(pair["next"]) > 0) & pair["raw"].rlike(INTRO)


def lines_of(messages: DataFrame) -> DataFrame:
    base = messages.where(F.col("text").isNotNull()).select("conv_id", "turn", "mark", F.posexplode(with_next(F.col("text"))).alias("line", "pair"))
    return base.select("conv_id", "turn", "mark", "line", quote_level(F.col("pair.raw")).alias("level"), normalised(F.col("pair.raw")).alias("norm"), introduces(F.col("pair")).alias("intro"))


def placed(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Messages with their position in the conversation and the turn before theirs, counted in segments of turns so that a long conversation is many keys."""
    messages = messages.withColumn("segment", F.coalesce(F.floor(F.col("turn") / segment), F.lit(-(1 << 40))).cast("long"))
    sums = messages.groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.max("turn").alias("last"))
    over = Window.partitionBy("conv_id").orderBy("segment")
    sums = sums.select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"), F.lag("last").over(over).alias("last"))
    own = Window.partitionBy("conv_id", "segment").orderBy("turn", "mark")
    out = messages.withColumn("rank", F.row_number().over(own)).withColumn("before", F.lag("turn").over(own))
    out = out.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")))
    return out.withColumn("position", (F.col("below") + F.col("rank")).cast("long")).withColumn("before", F.when(F.col("rank") == 1, F.col("last")).otherwise(F.col("before"))).drop("segment", "c", "s", "below", "last", "rank")


def link(conversations: DataFrame) -> DataFrame:
    """A row for each message: conv_id, turn, role, text (without quotations), n_quoted, n_linked, max_level, reply_to, reply_mark, position."""
    messages = written(messages_of(conversations), "messages")
    lines = written(lines_of(messages), "lines")

    # passages: runs of quoted lines of one level; a run's number is its line less the count of such lines before it
    inner = Window.partitionBy("conv_id", "turn", "mark", "level").orderBy("line")  # the quoted lines of one message
    quoted = lines.where("level > 0").withColumn("passage", F.col("line") - F.row_number().over(inner))
    quoted = quoted.where("norm != ''").withColumn("hash", F.xxhash64("norm"))
    own = lines.where("level = 0 and norm != '' and not intro").select(F.col("conv_id").alias("c"), F.xxhash64("norm").alias("h"), F.col("turn").alias("t"), F.col("mark").alias("m")).distinct()
    # passages, not lines, are looked up: the votes of a passage's lines for each message that holds them
    votes = quoted.join(own, (F.col("conv_id").eqNullSafe(F.col("c"))) & (F.col("hash") == F.col("h")) & (F.col("t") < F.col("turn")))
    votes = votes.groupBy("conv_id", "turn", "mark", "level", "passage", "t", "m").agg(F.count_distinct("line").alias("held"), F.min("line").alias("first"))
    best = votes.groupBy("conv_id", "turn", "mark", "level", "passage").agg(F.max(F.struct("held", "t", "m")).alias("best"), F.min("first").alias("first"))
    reply = best.groupBy("conv_id", "turn", "mark").agg(F.min(F.struct("level", "first", F.col("best.t").alias("t"), F.col("best.m").alias("m"))).alias("r"), F.sum("best.held").alias("n_linked"))
    counts = lines.groupBy("conv_id", "turn", "mark").agg(F.sum((F.col("level") > 0).cast("long")).alias("n_quoted"), F.max("level").alias("max_level"))

    same = lambda a, b: a["conv_id"].eqNullSafe(b["conv_id"]) & a["turn"].eqNullSafe(b["turn"]) & (a["mark"] == b["mark"])
    out = messages.join(counts, same(messages, counts), "left").select(messages["*"], "n_quoted", "max_level")
    out = out.join(reply, same(out, reply), "left").select(out["*"], "r", "n_linked")
    out = placed(out)
    bare = F.transform(F.filter(with_next(F.col("text")), lambda p: (quote_level(p["raw"]) == 0) & ~introduces(p)), lambda p: p["raw"])
    text = F.when(F.coalesce("n_quoted", F.lit(0)) > 0, F.trim(F.array_join(bare, "\n"))).otherwise(F.col("text"))
    return out.select(
        "conv_id", "turn", "role", text.alias("text"), F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("max_level", F.lit(0)).cast("long").alias("max_level"), F.coalesce("r.t", "before").alias("reply_to"), F.col("r").isNotNull().alias("by_quote"), "position",
    )


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = r"""
WITH m AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
a AS (SELECT *, string_split(text, chr(10)) AS parts FROM m WHERE text IS NOT NULL),
l AS (SELECT conv_id, turn, role, text, unnest(parts) AS raw, generate_subscripts(parts, 1) AS line FROM a),
q AS (
  SELECT *, length(regexp_replace(regexp_extract(raw, '^[ \t]*(>[ \t>]*)', 1), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(raw, '^[ \t]*(>[ \t>]*)', '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm
  FROM l),
n AS (SELECT *, coalesce(lead(level) OVER (PARTITION BY conv_id, turn, role, text ORDER BY line), 0) AS next_level FROM q),
i AS (
  SELECT *, level = 0 AND next_level > 0 AND regexp_matches(raw, '(?i)(wrote|writes|said|says|schrieb|a écrit|escribió)\s*:\s*$|^-+\s*original message\s*-+\s*$') AS intro,
    line - row_number() OVER (PARTITION BY conv_id, turn, role, text, level ORDER BY line) AS passage
  FROM n),
own AS (SELECT DISTINCT conv_id, turn AS t, norm FROM i WHERE level = 0 AND norm <> '' AND NOT intro),
votes AS (
  SELECT i.conv_id, i.turn, i.role, i.text, level, passage, t, count(DISTINCT line) AS held, min(line) AS first
  FROM i JOIN own ON own.conv_id IS NOT DISTINCT FROM i.conv_id AND own.norm = i.norm AND t < i.turn
  WHERE level > 0 AND i.norm <> '' GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role, text, level, passage ORDER BY held DESC, t DESC) AS k,
    min(first) OVER (PARTITION BY conv_id, turn, role, text, level, passage) AS begins FROM votes),
reply AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, role, text ORDER BY level, begins, t) AS r,
    sum(held) OVER (PARTITION BY conv_id, turn, role, text) AS n_linked FROM best WHERE k = 1),
per AS (
  SELECT conv_id, turn, role, text, count(*) FILTER (level > 0) AS n_quoted, max(level) AS max_level,
    string_agg(raw, chr(10) ORDER BY line) FILTER (level = 0 AND NOT intro) AS bare
  FROM i GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, CASE WHEN n_quoted > 0 THEN trim(coalesce(bare, '')) ELSE m.text END AS text,
  coalesce(n_quoted, 0)::BIGINT AS n_quoted, coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(max_level, 0)::BIGINT AS max_level,
  coalesce(reply.t, lag(m.turn) OVER (PARTITION BY m.conv_id ORDER BY m.turn)) AS reply_to, reply.t IS NOT NULL AS by_quote,
  row_number() OVER (PARTITION BY m.conv_id ORDER BY m.turn) AS position
FROM m
LEFT JOIN per ON per.conv_id IS NOT DISTINCT FROM m.conv_id AND per.turn IS NOT DISTINCT FROM m.turn AND per.role IS NOT DISTINCT FROM m.role AND per.text = m.text
LEFT JOIN reply ON reply.conv_id IS NOT DISTINCT FROM m.conv_id AND reply.turn = m.turn AND reply.role IS NOT DISTINCT FROM m.role AND reply.text = m.text AND r = 1
"""

ORACLES = {"op4_quotation_linking": ORACLE}
QUERIES = {"op4_quotation_linking": op4_quotation_linking}
