"""Chat logs: conversations that are prefixes of longer ones collapse, the rest are rendered.

A logger that stores a snapshot after every turn leaves a conversation many times. The
rolling hash of a conversation's first t turns is a running sum of turn hashes, each mixed
with its place, so it needs no fold over the conversation: sums of blocks of turns are
added first, then turns inside a block, and no task has to hold one conversation whole.
Two independent sums make 128 bits. A conversation is dropped if its full hash is the
proper prefix of another, or the full hash of one with a smaller id.

Only DataFrame functions; rendering is by blocks of turns, so a conversation of any length
is emitted as a few rows in order instead of one row without bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _placed(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, place (0, 1, ... in turn order, ties by role and text), by two levels of counting."""
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    base = base.where("conv_id is not null").withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40)))).distinct()
    sizes = base.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("block")) - F.col("n")).drop("n")
    within = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")) - 1
    return base.withColumn("within", within).join(before, ["conv_id", "block"]).withColumn("place", F.col("before") + F.col("within"))


def _prefixes(placed: DataFrame) -> DataFrame:
    """conv_id, place, h1, h2: rolling hashes of the turns 0 to place, by block sums."""
    turn_hash = lambda seed: F.xxhash64(F.lit(seed), "place", F.col("role").isNull(), "role", F.col("text").isNull(), "text").cast("decimal(38,0)")
    hashed = placed.select("conv_id", "block", "place", turn_hash(1).alias("a"), turn_hash(2).alias("b"))
    sums = hashed.groupBy("conv_id", "block").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    to_block = Window.partitionBy("conv_id").orderBy("block")
    sums = sums.select("conv_id", "block", (F.sum("sa").over(to_block) - F.col("sa")).alias("pa"), (F.sum("sb").over(to_block) - F.col("sb")).alias("pb"))
    in_block = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rolled = hashed.withColumn("ra", F.sum("a").over(in_block)).withColumn("rb", F.sum("b").over(in_block)).join(sums, ["conv_id", "block"])
    key = lambda p, r: F.xxhash64((F.col(p) + F.col(r)).cast("decimal(38,0)"))
    return rolled.select("conv_id", "place", key("pa", "ra").alias("h1"), key("pb", "rb").alias("h2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of conversations that are no prefix of another one.

    Of equal conversations the smallest id stays. Two turns are equal if role and text are,
    null only to null. Repeated rows count once; a null turn sorts first; rows with a null
    conv_id belong to no conversation. Empty input gives no rows.
    """
    hashed = materialize(_prefixes(_placed(turns)), "prefixes")
    longest = hashed.groupBy("conv_id").agg((F.max("place") + 1).alias("n_turns"))
    full = hashed.join(longest, "conv_id").where("place + 1 = n_turns").select("conv_id", "n_turns", "h1", "h2")
    # one row for each different conversation: the copies of one end here, by partial minima
    first = full.groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"))
    proper = hashed.join(longest, "conv_id").where("place + 1 < n_turns").select("h1", "h2").distinct()
    return first.join(proper, ["h1", "h2"], "left_anti").select("conv_id", "n_turns")


def render_chat(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, block, first_turn, rendered for the maximal conversations.

    ``rendered`` holds up to BLOCK turns; blocks of a conversation in order make its whole
    text. Null role is "unknown", null text is empty.
    """
    placed = _placed(turns).join(maximal_conversations(turns), "conv_id").withColumn("part", F.floor(F.col("place") / BLOCK).cast("int"))
    said = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(CLOSE), F.lit("\n"))
    grouped = placed.groupBy("conv_id", "n_turns", "part").agg(F.min("place").alias("first_turn"), F.array_sort(F.collect_list(F.struct("place", said.alias("said")))).alias("all"))
    return grouped.select("conv_id", "n_turns", F.col("part").alias("block"), "first_turn", F.array_join(F.col("all.said"), "").alias("rendered"))


#: What render_chat returns, for conversations of up to BLOCK turns in one block.
ORACLE = """
WITH base AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM base),
whole AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY place) AS said FROM placed GROUP BY conv_id),
prefixes AS (SELECT w.said[1:k] AS said FROM whole w, range(1, 100000) r(k) WHERE k < len(w.said)),
kept AS (SELECT min(conv_id) AS conv_id, said FROM whole WHERE said NOT IN (SELECT said FROM prefixes) GROUP BY said)
SELECT p.conv_id AS conv_id, CAST(max(len(k.said)) AS BIGINT) AS n_turns, CAST(p.place // 256 AS INTEGER) AS block, CAST(min(p.place) AS BIGINT) AS first_turn,
  string_agg('<|im_start|>' || coalesce(p.role, 'unknown') || chr(10) || coalesce(p.text, '') || '<|im_end|>' || chr(10), '' ORDER BY p.place) AS rendered
FROM placed p JOIN kept k USING (conv_id) GROUP BY p.conv_id, p.place // 256
"""
