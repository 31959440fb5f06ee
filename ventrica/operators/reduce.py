"""Fewer facets: vertex clustering with quadrics, at the finest grid that keeps a structure in its budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

#: A structure gets at least so many facets of the budget.
FLOOR = 800
#: Cells along the longest side of a structure, from fine to coarse.
LEVELS = (256, 128, 64, 32, 16, 8, 4, 2)
#: How much the mean of the corners pulls a vertex, as a share of the quadric's trace.
PULL = 1e-3


def budgets(facets: DataFrame, budget: int, floor: int = FLOOR) -> DataFrame:
    """structure, before, allowed: facets of each structure and its share of the budget, but at least ``floor``."""
    n = facets.groupBy("structure").agg(F.count("*").alias("before"))
    share = F.col("before") / F.sum("before").over(Window.partitionBy())  # one row for each structure
    return n.withColumn("allowed", F.greatest(F.lit(floor), F.floor(budget * share)))


def _boxes(facets: DataFrame) -> DataFrame:
    corner = lambda h, x: h(*[F.col(f"{c}.{x}") for c in "abc"])
    box = facets.groupBy(F.col("structure").alias("_s")).agg(*[f(corner(h, x)).alias(f"{n}{x}") for x in "xyz" for n, f, h in (("lo", F.min, F.least), ("hi", F.max, F.greatest))])
    return box.withColumn("longest", F.greatest(*[F.col(f"hi{x}") - F.col(f"lo{x}") for x in "xyz"])).drop(*[f"hi{x}" for x in "xyz"])


def _cell(corner: str, level) -> F.Column:
    place = [F.least(F.floor((F.col(f"{corner}.{x}") - F.col(f"lo{x}")) / F.col("longest") * level), level - 1).cast("long") for x in "xyz"]
    return F.when(F.col("longest") > 0, place[0] * 1048576 + place[1] * 1024 + place[2]).otherwise(0)


def decimated(facets: DataFrame, budget: int, floor: int = FLOOR) -> tuple[DataFrame, DataFrame]:
    """Facets of each structure within its budget, and what became of it.

    The first frame is structure, a, b, c (corners as structs); the second structure, before,
    allowed, level, after. All corners in one cell become one vertex, where the sum of squared
    distances to the planes of the facets at the cell is least (weights are areas; the mean of
    the corners steadies what planes leave open). Facets with two corners in one cell vanish,
    facets between the same three cells are one. The level is the finest of LEVELS whose count
    is allowed, else the coarsest. Null corners drop a facet; no facets give no rows.
    """
    f = facets.where(F.forall(F.array(*[F.col(f"{c}.{x}") for c in "abc" for x in "xyz"]), lambda v: v.isNotNull() & ~F.isnan(v)))
    f = f.join(F.broadcast(_boxes(f)), F.col("structure") == F.col("_s")).drop("_s")  # one row for each structure
    cells = lambda level: F.array_sort(F.array(*[_cell(c, level) for c in "abc"]))
    tried = f.select("structure", F.explode(F.array(*map(F.lit, LEVELS))).alias("level"), *"abc", "longest", "lox", "loy", "loz").select("structure", "level", cells(F.col("level")).alias("key"))
    left = tried.where(F.size(F.array_distinct("key")) == 3).distinct().groupBy("structure", "level").agg(F.count("*").alias("after"))
    allowed = budgets(f, budget, floor)
    every = allowed.withColumn("level", F.explode(F.array(*map(F.lit, LEVELS)))).join(left, ["structure", "level"], "left").na.fill(0, ["after"])
    fits = F.col("after") <= F.col("allowed")
    best = every.groupBy("structure", "before", "allowed").agg(F.coalesce(F.max(F.when(fits, F.col("level"))), F.lit(LEVELS[-1])).alias("level"))
    report = best.join(every.select("structure", "level", "after"), ["structure", "level"]).select("structure", "before", "allowed", "level", "after")
    at = f.join(F.broadcast(best.select(F.col("structure").alias("_s"), "level")), F.col("structure") == F.col("_s")).drop("_s")
    at = at.withColumns({f"k{c}": _cell(c, F.col("level")) for c in "abc"})
    spots = _vertices(at)
    kept = at.where("ka <> kb and kb <> kc and ka <> kc").select("structure", "ka", "kb", "kc")
    # of facets between the same cells the least order stands, turned so that its smallest cell comes first
    turned = F.when((F.col("ka") < F.col("kb")) & (F.col("ka") < F.col("kc")), F.array("ka", "kb", "kc")).when(F.col("kb") < F.col("kc"), F.array("kb", "kc", "ka")).otherwise(F.array("kc", "ka", "kb"))
    faces = kept.select("structure", turned.alias("t")).groupBy("structure", F.array_sort("t").alias("key")).agg(F.min("t").alias("t"))
    out = faces.select("structure", *[F.col("t")[k].alias(f"k{c}") for k, c in enumerate("abc")])
    for c in "abc":
        out = out.join(spots.select("structure", F.col("cell").alias(f"k{c}"), F.struct("x", "y", "z").alias(c)), ["structure", f"k{c}"])
    return out.select("structure", *"abc"), report


def _vertices(at: DataFrame) -> DataFrame:
    """structure, cell, x, y, z: where the quadrics of a cell's facets are least."""
    a, b, c = (tuple(F.col(f"{n}.{x}") for x in "xyz") for n in "abc")
    n = g.cross(g.sub(b, a), g.sub(c, a))
    at = at.withColumns({f"n{x}": v for x, v in zip("xyz", n, strict=True)}).withColumn("_l", g.norm(tuple(F.col(f"n{x}") for x in "xyz")))
    at = at.withColumns({f"n{x}": F.col(f"n{x}") / F.when(F.col("_l") > 0, F.col("_l")).otherwise(1.0) for x in "xyz"})
    normal = tuple(F.col(f"n{x}") for x in "xyz")
    at = at.withColumn("d", -g.dot(normal, a)).withColumn("w", F.col("_l") / 2)
    each = at.select("structure", *[f"n{x}" for x in "xyz"], "d", "w", F.explode(F.array(*[F.struct(F.col(f"k{k}").alias("cell"), F.col(k).alias("p")) for k in "abc"])).alias("v"))
    products = {p + q: F.sum(F.col("w") * F.col(f"n{p}") * F.col(f"n{q}")).alias(p + q) for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")}
    sums = each.groupBy("structure", F.col("v.cell").alias("cell")).agg(*products.values(), *[F.sum(F.col("w") * F.col(f"n{x}") * F.col("d")).alias(f"b{x}") for x in "xyz"], *[F.avg(f"v.p.{x}").alias(f"m{x}") for x in "xyz"])
    # (A + e) (v - m) = -(A m + b), by Cramer's rule; e keeps the system sound where all planes are alike
    e = PULL * (F.col("xx") + F.col("yy") + F.col("zz")) + 1e-9
    sums = sums.withColumns({"xx": F.col("xx") + e, "yy": F.col("yy") + e, "zz": F.col("zz") + e, "_e": e})
    rows = [tuple(F.col("".join(sorted(p + q))) for q in "xyz") for p in "xyz"]
    m = tuple(F.col(f"m{x}") for x in "xyz")
    sums = sums.withColumns({f"r{x}": -(g.dot(rows[k], m) - F.col("_e") * m[k] + F.col(f"b{x}")) for k, x in enumerate("xyz")})
    right = tuple(F.col(f"r{x}") for x in "xyz")
    det = lambda p, q, r: g.dot(p, g.cross(q, r))
    whole = det(*rows)
    # the matrix is symmetric, so its rows are its columns
    return sums.select("structure", "cell", *[(m[k] + det(*[right if j == k else rows[j] for j in range(3)]) / whole).alias(x) for k, x in enumerate("xyz")])
