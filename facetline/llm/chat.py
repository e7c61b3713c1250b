"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A log often holds a conversation several times, each time some turns longer. A hash of every prefix of turns tells which
conversations another one continues: those go by an anti-join, of equal ones the least conv_id stays, and what is left
is rendered.

All turns are put in order once, in ranges of (conv_id, turn, role, beginning of the text), so that however many turns a
conversation has, or turns without a number, they are spread over tasks; a turn's place follows from its place in its range
and the counts of the ranges before. The prefix hash is the exclusive or of hashes of (place, role, text), 128 bits wide. It
runs within parts of 256 places, and part totals over the conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, table

PART = 256
#: characters of a text that ranges are cut by
BEGINNING = 16


def _told(c: str) -> Column:
    """A column so that null and empty differ in hashes."""
    return F.struct(F.col(c).isNull(), F.coalesce(c, F.lit("")))


def _before(by: str, total: Column, none: Column) -> Column:
    rows = Window.partitionBy("conv_id").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(total.over(rows), none)


def ordered(conversations: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, range, seq, role, text and the hashes c and d of both) and, for each conversation's share of a range,
    shift (place = seq + shift, from 1) and n_turns.

    Turns are ordered by turn, role and text, null first. Rows without a conv_id belong to no conversation and are left
    out. Other columns are ignored."""
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role")]
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    placed = turns.repartitionByRange(*order, F.asc_nulls_first(F.substring("text", 1, BEGINNING))).sortWithinPartitions(*order, F.asc_nulls_first("text"))
    number = F.monotonically_increasing_id()
    # ranges and numbers are given once, when the table is written
    turns = scratch.put(
        placed.select(
            "conv_id", F.shiftright(number, 33).alias("range"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("seq"), "role", "text",
            F.xxhash64(_told("role"), _told("text")).alias("c"), F.xxhash64(_told("text"), F.lit(11), _told("role")).alias("d"),
        ),
        "turns",
    )
    shares = turns.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    shift = _before("range", F.sum("n"), F.lit(0)) - F.col("first") + 1
    shares = shares.select("conv_id", "range", shift.alias("shift"), F.sum("n").over(Window.partitionBy("conv_id")).alias("n_turns"))
    return turns, scratch.put(shares, "shares")


def _part(place: Column) -> Column:
    return F.floor((place - 1) / PART).cast("long")


def prefixes(turns: DataFrame, shares: DataFrame) -> DataFrame:
    """conv_id, n_turns, place and the hash (a, b) of the turns up to that place."""
    place = (F.col("seq") + F.col("shift")).alias("place")
    hashed = turns.select("conv_id", "range", "seq", "c", "d").join(shares, ["conv_id", "range"]).select("conv_id", place, "n_turns", "c", "d")
    hashed = hashed.select("conv_id", _part(F.col("place")).alias("part"), "place", "n_turns", F.xxhash64("place", "c", "d").alias("x"), F.xxhash64("d", "place", "c").alias("y"))
    within = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    parts = hashed.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    parts = parts.select("conv_id", "part", *(_before("part", F.bit_xor(c), F.lit(0)).alias(f"{c}_before") for c in "xy"))
    running = hashed.select("conv_id", "part", "place", "n_turns", F.bit_xor("x").over(within).alias("x"), F.bit_xor("y").over(within).alias("y"))
    return running.join(parts, ["conv_id", "part"]).select("conv_id", "n_turns", "place", F.col("x").bitwiseXOR(F.col("x_before")).alias("a"), F.col("y").bitwiseXOR(F.col("y_before")).alias("b"))


def maximal(turns: DataFrame, shares: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id and copies of the conversations that no longer one begins with; of equal ones the least conv_id.

    Equal conversations and equal prefixes are counted before they are joined, so however many there are, one row of
    each meets the other side."""
    found = scratch.put(prefixes(turns, shares), "prefixes")
    whole = found.where("place = n_turns").groupBy("place", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    proper = found.where("place < n_turns").select("place", "a", "b").distinct()
    kept = scratch.put(whole.join(proper, ["place", "a", "b"], "left_anti").select("conv_id", "copies"), "kept")
    scratch.drop("prefixes")
    return kept


def rendered(turns: DataFrame, shares: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, copies and text of the kept conversations, a row for each part of 256 turns, so that no
    conversation needs to fit in one row. Null roles and texts are rendered empty."""
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    lines = turns.select("conv_id", "range", "seq", line.alias("line")).join(shares.join(kept, "conv_id"), ["conv_id", "range"]).withColumn("place", F.col("seq") + F.col("shift"))
    parts = lines.groupBy("conv_id", _part(F.col("place")).alias("part"), "n_turns", "copies").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return parts.select("conv_id", "part", "n_turns", "copies", F.concat_ws("", F.transform("lines", lambda x: x["line"])).alias("rendered"))


def collapsed(conversations: DataFrame) -> DataFrame:
    """The maximal conversations, rendered; see the functions above for null, ties and repeats. An empty table gives no
    rows."""
    scratch = Scratch(conversations.sparkSession, "chat")
    turns, shares = ordered(conversations, scratch)
    return rendered(turns, shares, maximal(turns, shares, scratch))


def op5_chat_collapse(spark, sf_dir: str) -> DataFrame:
    return collapsed(table(spark, sf_dir, "conversations"))


OP5_SQL = """
WITH turns AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), whole AS (
  SELECT conv_id, count(*) AS n_turns, list({'role': role, 'text': text} ORDER BY place) AS said FROM turns GROUP BY conv_id
), proper AS (
  SELECT DISTINCT said[1:k] AS said FROM (SELECT said, unnest(range(1, n_turns)) AS k FROM whole)
), kept AS (
  SELECT min(conv_id) AS conv_id, count(*) AS copies, any_value(n_turns) AS n_turns FROM whole
  WHERE said NOT IN (SELECT said FROM proper) GROUP BY said
)
SELECT conv_id, (place - 1) // 256 AS part, n_turns, copies,
       string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
FROM turns JOIN kept USING (conv_id) GROUP BY conv_id, (place - 1) // 256, n_turns, copies
"""
