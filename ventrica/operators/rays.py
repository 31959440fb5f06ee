"""Rays along x through facets, with rays, points and cut planes as tables.

Facets and rays are dealt to square bins of the plane across the rays and meet by an equi-join
on the bin; a facet goes to the bins of its bounding box, a ray to one. Whether a ray meets a
facet is told as for the lines of a grid.

Where only the number of crossings counts, facets over more than NARROW bins are dealt to blocks
in place of bins, and so are rays (and all facets, if a bin has more than RAYS_A_BIN rays). Each block of the ones meets each of the others in a tile, which
gives a row for each ray and structure, so that no pair of a ray and a wide facet becomes a row.
The time still goes with rays times wide facets, which is what random facets ask for; the memory
of a tile is bounded.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import written
from . import surfaces

NARROW, RAYS_A_BIN = 4, 1000
#: Facets and rays of a tile.
FACETS_A_TILE, RAYS_A_TILE = 16_384, 65_536
_EDGES = [f"{n}{k}" for k in range(3) for n in ("ly", "lz", "hy", "s")]


def _sound(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def ray_crossings(facets: DataFrame, rays: DataFrame, bin_mm: float) -> DataFrame:
    """The columns of rays(y, z, ...) with structure, cross_x and way for each facet that the line along x through (y, z) meets.

    ``way`` is 1 where the line leaves through a facet that is wound outwards, -1 where it enters.
    Facets seen edge-on are never met. Rays with a null or non-finite place meet nothing.
    """
    f = surfaces.prepared(facets)
    place = lambda v: F.floor(v / F.lit(float(bin_mm)))
    for n, x in (("_bj", "y"), ("_bk", "z")):
        span = [F.col(f"{c}.{x}") for c in "abc"]
        f = f.withColumn(n, F.explode(F.sequence(place(F.least(*span)), place(F.greatest(*span)))))
    dealt = rays.where(_sound(F.col("y")) & _sound(F.col("z"))).withColumns({"_bj": place(F.col("y")), "_bk": place(F.col("z"))})
    met, x = surfaces.line_meets(F.col("y"), F.col("z"))
    return dealt.join(f, ["_bj", "_bk"]).where(met).select(*[F.col(c) for c in rays.columns], "structure", x.alias("cross_x"), F.signum("det").cast("int").alias("way"))


def _tile_hits(keys: list[str], beyond: bool, rays: pa.Table, facets: pa.Table) -> pa.Table:
    """structure, *keys, hits of one tile; facets see rays in order of y, so an edge looks at one run of them."""
    number = lambda t, c: t.column(c).to_numpy()
    kinds = facets.column("structure").combine_chunks().dictionary_encode("encode")
    of = kinds.indices.to_numpy()
    rays = rays.take(pa.array(np.argsort(number(rays, "y"), kind="stable")))
    y, z = number(rays, "y"), number(rays, "z")
    x = number(rays, "x") if beyond else None
    edges = [[number(facets, f"{n}{k}") for n in ("ly", "lz", "hy", "s")] for k in range(3)]
    runs = [(np.searchsorted(y, ly), np.searchsorted(y, hy)) for ly, _, hy, _ in edges]
    first, last = np.minimum.reduce([a for a, _ in runs]), np.maximum.reduce([b for _, b in runs])
    plane = [number(facets, c) for c in ("ax", "ay", "az", "by_y", "by_z")] if beyond else []
    out = []
    for kind in np.unique(of).tolist():
        hits = np.zeros(len(y), np.int64)
        for k in np.flatnonzero((of == kind) & (first < last)).tolist():
            at, end = first[k], last[k]
            met = np.zeros(end - at, bool)
            for (ly, lz, _, slope), (a, b) in zip(edges, runs, strict=True):
                if a[k] < b[k]:
                    met[a[k] - at : b[k] - at] ^= z[a[k] : b[k]] < lz[k] + (y[a[k] : b[k]] - ly[k]) * slope[k]
            if beyond:
                rows = np.flatnonzero(met) + at
                ax, ay, az, by_y, by_z = (c[k] for c in plane)
                hits[rows[~(ax + (y[rows] - ay) * by_y + (z[rows] - az) * by_z <= x[rows])]] += 1
            else:
                hits[at:end] += met
        some = np.flatnonzero(hits)
        found = rays.select(keys).take(pa.array(some))
        structure = kinds.dictionary.take(pa.array(np.full(len(some), kind)))
        out.append(pa.table([structure, *found.columns, pa.array(hits[some])], ["structure", *keys, "hits"]))
    return pa.concat_tables(out)


def _wide_hits(facets: DataFrame, rays: DataFrame, n_rays: int, keys: list[str], beyond: bool) -> DataFrame:
    """structure, *keys, hits of facets that are dealt to blocks, those of a structure to as few as can be."""
    edge = lambda k: [F.col(f"e{k}.low.y").alias(f"ly{k}"), F.col(f"e{k}.low.z").alias(f"lz{k}"), F.col(f"e{k}.high.y").alias(f"hy{k}"), F.coalesce(f"s{k}", F.lit(0.0)).alias(f"s{k}")]
    f = surfaces.prepared(facets).select("structure", *[F.col(f"a.{x}").alias(f"a{x}") for x in "xyz"], "by_y", "by_z", *edge(0), *edge(1), *edge(2))
    if beyond:  # a facet without a place along the rays lies beyond nothing
        f, rays = f.dropna(subset=["ax", "by_y", "by_z"]), rays.where(F.col("x").isNotNull() & ~F.isnan("x"))
    rays = rays.where(_sound(F.col("y")) & _sound(F.col("z"))).select(*keys, *("xyz" if beyond else "yz"))
    blocks, groups = max(1, -(-f.count() // FACETS_A_TILE)), max(1, -(-n_rays // RAYS_A_TILE))
    f = written(f.repartitionByRange(blocks, "structure", F.xxhash64(*_EDGES)).withColumn("i", F.spark_partition_id()), "facets")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    used = [r.i for r in f.select("i").distinct().collect()]  # a number for each block
    left = rays.withColumn("j", F.pmod(F.xxhash64(*keys, "y", "z"), F.lit(groups)).cast("int")).withColumn("i", F.explode(F.lit(used).cast("array<int>")))
    right = f.withColumn("j", upto(groups))
    schema = T.StructType([T.StructField("structure", f.schema["structure"].dataType), *[rays.schema[k] for k in keys], T.StructField("hits", T.LongType())])
    # a number of tasks of our own, as Spark would join tiles of few bytes, which take seconds each
    left, right = (df.repartition(min(2 * len(used) * groups, 4096) or 1, "i", "j") for df in (left, right))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(partial(_in_tile, schema.names, keys, beyond), schema)


def _in_tile(names: list[str], keys: list[str], beyond: bool, rays: pa.Table, facets: pa.Table) -> pa.Table:
    if rays.num_rows and facets.num_rows:
        return _tile_hits(keys, beyond, rays, facets)
    kinds = [facets.schema.field("structure").type, *[rays.schema.field(k).type for k in keys], pa.int64()]
    return pa.table([pa.nulls(0, t) for t in kinds], names)


def hits(facets: DataFrame, rays: DataFrame, keys: list[str], bin_mm: float, beyond: bool = False) -> DataFrame:
    """structure, *keys, hits: how often the rays of each key meet each structure, beyond their own x if so asked; no row without a hit.

    Rays with a null or non-finite place meet nothing, nor does a facet with such a corner in the plane across the rays.
    """
    span = F.lit(1)
    for x in "yz":
        corners = [F.col(f"{c}.{x}") for c in "abc"]
        facets = facets.where(_sound(corners[0]) & _sound(corners[1]) & _sound(corners[2]))
        span = span * (F.floor(F.greatest(*corners) / bin_mm) - F.floor(F.least(*corners) / bin_mm) + 1).cast("double")
    bins = rays.groupBy(F.floor(F.col("y") / bin_mm), F.floor(F.col("z") / bin_mm)).agg(F.count("*").alias("n"))
    seen = bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    sparse = seen.most <= RAYS_A_BIN
    found = _wide_hits(facets.where(span > NARROW) if sparse else facets, rays, seen.n, keys, beyond)
    if sparse:
        near = ray_crossings(facets.where(span <= NARROW), rays, bin_mm)
        near = near.where(F.col("cross_x") > F.col("x")) if beyond else near
        found = found.unionByName(near.groupBy("structure", *keys).agg(F.count("*").alias("hits")))
    return found.groupBy("structure", *keys).agg(F.sum("hits").alias("hits"))


def enclosed(facets: DataFrame, points: DataFrame, bin_mm: float) -> DataFrame:
    """structure, group, n, inside, share: of each group of points(group, x, y, z) how many lie inside each structure.

    A point is inside if the ray from it along +x meets the structure an odd number of times, so
    crossings are counted on one side only. Groups of points that meet nothing have 0 inside;
    points with a null or non-finite coordinate lie in nothing, but count.
    """
    rows = points.withColumn("_row", F.monotonically_increasing_id())
    odd = hits(facets, rows, ["group", "_row"], bin_mm, beyond=True).where("hits % 2 = 1")
    inside = odd.groupBy("structure", "group").agg(F.count("*").alias("inside"))
    sizes = points.groupBy("group").agg(F.count("*").alias("n"))
    # one row for each structure and group: both few, as each is a label
    every = facets.select("structure").distinct().join(sizes, F.lit(True))
    found = every.join(inside, ["structure", "group"], "left").na.fill(0, ["inside"])
    return found.withColumn("share", F.col("inside") / F.col("n"))


def ray_parity(facets: DataFrame, rays: DataFrame, bin_mm: float) -> DataFrame:
    """structure, hits, rays, odd: how many of rays(ray, y, z) meet a structure so many times; rays without a hit are no evidence."""
    each = hits(facets, rays, ["ray"], bin_mm)
    return each.groupBy("structure", "hits").agg(F.count("*").alias("rays")).withColumn("odd", F.col("hits") % 2 == 1)


def caps(facets: DataFrame, grid: DataFrame, side: int, keep: Column) -> DataFrame:
    """structure, j, k, net: cells of a view along x that the cut of a solid fills, with the sum of ways of the crossings that are kept.

    ``keep`` tells, from columns x, y and z of a crossing, what the cut leaves. What is entered and
    left again sums to zero; a line that sees more of one than of the other looks through the cut.
    """
    met = surfaces.crossings(facets, grid, side).join(F.broadcast(grid))  # one row
    at = met.withColumns({"y": (F.col("j") + 0.5) * F.col("pitch") + F.col("oy"), "z": (F.col("k") + 0.5) * F.col("pitch") + F.col("oz")})
    return at.where(keep).groupBy("structure", "j", "k").agg(F.sum("way").alias("net")).where("net <> 0")
