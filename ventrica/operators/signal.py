"""Label tables and stencils over images as tables (line, sample, rf)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: echogenicity and attenuation of blood, which undeclared labels get.
BLOOD = 0.02


def lookup_table(spark: SparkSession, declared: DataFrame) -> DataFrame:
    """label, echogenicity, attenuation, scale for labels 0 to 255; scale is the largest attenuation, at least 1."""
    full = spark.range(256).withColumnRenamed("id", "label").join(F.broadcast(declared.where("label between 0 and 255")), "label", "left")
    filled = full.select("label", *[F.coalesce(c, F.lit(BLOOD)).alias(c) for c in ("echogenicity", "attenuation")])
    scale = filled.agg(F.greatest(F.lit(1.0), F.max("attenuation")).alias("scale"))
    return filled.join(F.broadcast(scale))  # one row


def _tapped(image: DataFrame, axis: str, size: int, radius: int) -> DataFrame:
    """image with ``tap`` and ``near``, the value that many places on along an axis; edges hold.

    Each value is dealt to the places that see it, so a stencil is one shuffle and no self-join.
    """
    place, last = F.col(axis), size - 1
    low = F.when(place == 0, F.lit(-radius)).otherwise(place - radius)
    high = F.when(place == last, F.lit(last + radius)).otherwise(place + radius)
    # an edge value is also seen past the edge: one row for each unclamped place
    seen = image.withColumn("target", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    taps = F.filter(F.sequence(F.lit(-radius), F.lit(radius)), lambda t: F.least(F.greatest(F.col("target") + t, F.lit(0)), F.lit(last)) == place)
    seen = seen.where(F.col("target").between(0, last)).withColumn("tap", F.explode(taps))
    return seen.withColumn(axis, F.col("target")).drop("target").withColumnRenamed("rf", "near")


def _weight(sigma: Column) -> Column:
    return F.exp(-0.5 * F.col("tap") * F.col("tap") / (sigma * sigma))


def lateral_blur(image: DataFrame, lines: int, samples: int, sigma: float, defocus: float, focus: float, radius: int) -> DataFrame:
    """line, sample, rf: coherent sum across lines, wider away from the focus, keeping the variance of noise."""
    depth = (F.col("sample") + 0.5) / samples
    width = F.greatest(sigma * (1 + defocus * F.abs(depth - focus) * 100), F.lit(0.35))
    taps = _tapped(image, "line", lines, radius).withColumn("w", _weight(width))
    return taps.groupBy("line", "sample").agg((F.sum(F.col("near") * F.col("w")) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("rf"))


def axial_envelope(image: DataFrame, samples: int, sigma: float, radius: int) -> DataFrame:
    """line, sample, envelope: root of the weighted mean square along a line."""
    taps = _tapped(image, "sample", samples, radius).withColumn("w", _weight(F.lit(sigma)))
    return taps.groupBy("line", "sample").agg(F.sqrt(F.sum(F.col("near") * F.col("near") * F.col("w")) / F.sum("w")).alias("envelope"))


def rim_and_core(rows: DataFrame, group: str, order: list[str], value: str, k: int) -> DataFrame:
    """group, rim, core: means of the first k and last k values of a group, and of those between (null if none)."""
    w = Window.partitionBy(group)
    placed = rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).withColumn("_all", F.count("*").over(w))
    ends = (F.col("_n") <= k).cast("int") + (F.col("_n") > F.col("_all") - k).cast("int")
    placed = placed.withColumn("_ends", ends)
    return placed.groupBy(group).agg((F.sum(F.col(value) * F.col("_ends")) / F.sum("_ends")).alias("rim"), F.avg(F.when(F.col("_ends") == 0, F.col(value))).alias("core"))
