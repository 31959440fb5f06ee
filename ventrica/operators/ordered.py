"""Runs, pairs, strides and quantiles over ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def runs(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """group, value, run, length, start: maximal stretches of equal values in order."""
    w = Window.partitionBy(*group).orderBy(*order)
    turn = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    marked = rows.withColumn("_turn", turn).withColumn("run", F.sum("_turn").over(w))
    return marked.groupBy(*group, "run", value).agg(F.count("*").alias("length"), F.min(order[0]).alias("start"))


def paired(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """group, pair, enter, leave: rows 1-2, 3-4, ... of each group; groups with an odd count are left out."""
    w = Window.partitionBy(*group).orderBy(*order)
    placed = rows.withColumn("_n", F.row_number().over(w) - 1).withColumn("_all", F.count("*").over(Window.partitionBy(*group))).where("_all % 2 = 0")
    pick = lambda odd: F.max(F.when(F.col("_n") % 2 == odd, F.col(value)))
    return placed.groupBy(*group, F.floor(F.col("_n") / 2).alias("pair")).agg(pick(0).alias("enter"), pick(1).alias("leave"))


def numbered(rows: DataFrame, order: list[str], partitions: int) -> DataFrame:
    """rows with ``n`` 0, 1, ... in order, without sorting everything in one task.

    The rows are dealt to ranges and written once, with the number of their range, as the bounds
    of ranges are sampled anew in each job; sizes of the ranges give the offsets.
    """
    dealt = written(rows.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = {r._part: r.c for r in dealt.groupBy("_part").agg(F.count("*").alias("c")).collect()}
    before = [sum(c for p, c in sizes.items() if p < part) for part in range(partitions)]
    offset = F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_part") + 1)
    return dealt.withColumn("n", offset + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).drop("_part")


def stride(rows: DataFrame, order: list[str], budget: int, partitions: int = 64) -> DataFrame:
    """Every step-th row in order, step being the row count over the budget, at least 1."""
    step = max(1, rows.count() // budget)
    return numbered(rows, order, partitions).where(F.col("n") % step == 0)


def floor_quantiles(rows: DataFrame, group: str, value: str, **wanted: float) -> DataFrame:
    """group and, by name, the value at place floor(n q) of the sorted group, at most the last.

    Equal values are counted first, so a hot group is no longer than its distinct values.
    """
    counts = rows.groupBy(group, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group)
    upto = counts.withColumn("_upto", F.sum("_c").over(w.orderBy(value))).withColumn("_n", F.sum("_c").over(w))
    place = lambda q: F.least(F.floor(F.col("_n") * F.lit(q)), F.col("_n") - 1)
    return upto.groupBy(group).agg(*[F.min(F.when(F.col("_upto") > place(q), F.col(value))).alias(name) for name, q in wanted.items()])


def later_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The second and later rows of each key, in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n > 1").drop("_n")
