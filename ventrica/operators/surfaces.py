"""Triangle surfaces: winding, normals, and scanlines through facets(structure, a, b, c) with corners (x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .mesh import Points, dealt, with_corners

#: Shares of rays with more than two crossings from which a solid has inner surfaces, or has them in places.
MOSTLY, PARTLY = 0.5, 0.1
MIN_CHORD = 1e-6


def wound_boundary(tets: DataFrame, points: Points, tasks: int | None = None) -> DataFrame:
    """tag, a, b, c: the surface of each tag, its faces wound so that normals point outwards.

    A tetrahedron of negative volume has two corners swapped first, so its order doesn't matter.
    Flat ones (volume 0) are wound as they stand.
    """
    t = with_corners(tets, points, "abcd")
    at = {n: tuple(F.col(f"{n}{x}") for x in "xyz") for n in "abcd"}
    volume = g.dot(g.cross(g.sub(at["b"], at["a"]), g.sub(at["c"], at["a"])), g.sub(at["d"], at["a"]))
    p, q = F.when(volume < 0, F.col("b")).otherwise(F.col("a")), F.when(volume < 0, F.col("a")).otherwise(F.col("b"))
    r, s = F.col("c"), F.col("d")
    faces = t.select("tag", F.explode(F.array(*[F.array(*f) for f in ((p, r, q), (p, q, s), (p, s, r), (q, r, s))])).alias("f"))
    key = F.array_sort("f")
    # plain numbers, as groups of arrays are sorted in place of hashed
    rows = faces.select("tag", *[key[k].alias(n) for k, n in enumerate("pqr")], *[F.col("f")[k].alias(n) for k, n in enumerate("abc")])
    # a face that is alone is the least of its group corner by corner
    alone = dealt(rows, tasks, *"pqr").groupBy("tag", *"pqr").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in "abc"]).where("n = 1")
    return alone.select("tag", *"abc")


def winding_census(surface: DataFrame, tasks: int | None = None) -> DataFrame:
    """tag, n_edges, n_boundary, n_nonmanifold, n_miswound: an edge of two faces is miswound if both run along it the same way."""
    ends = [("a", "b"), ("b", "c"), ("c", "a")]
    way = F.array(*[F.struct(F.least(u, v).alias("u"), F.greatest(u, v).alias("v"), F.when(F.col(u) < F.col(v), 1).otherwise(-1).alias("way")) for u, v in ends])
    edges = dealt(surface.select("tag", F.explode(way).alias("e")).select("tag", "e.*"), tasks, *"uv").groupBy("tag", "u", "v").agg(F.count("*").alias("n"), F.sum("way").alias("way"))
    tell = {"n_boundary": F.col("n") == 1, "n_nonmanifold": F.col("n") > 2, "n_miswound": (F.col("n") == 2) & (F.col("way") != 0)}
    return edges.groupBy("tag").agg(F.count("*").alias("n_edges"), *[F.count_if(c).alias(n) for n, c in tell.items()])


def _corners() -> list[g.Vec]:
    return [tuple(F.col(f"{c}{x}") for x in "xyz") for c in "abc"]


def enclosed_volume(surface: DataFrame, points: Points) -> DataFrame:
    """tag, volume: signed volume within the surface by the divergence theorem; an inverted one is negative."""
    a, b, c = _corners()
    return with_corners(surface, points, "abc").groupBy("tag").agg((F.sum(g.dot(a, g.cross(b, c))) / 6).alias("volume"))


def vertex_normals(surface: DataFrame, points: Points, tasks: int | None = None) -> DataFrame:
    """tag, pid, nx, ny, nz: unit sums of the area-weighted normals of the faces at each vertex; zero where they cancel."""
    a, b, c = _corners()
    n = g.cross(g.sub(b, a), g.sub(c, a))
    each = with_corners(surface, points, "abc").select("tag", F.explode(F.array(*"abc")).alias("pid"), *[v.alias(k) for k, v in zip("xyz", n, strict=True)])
    total = dealt(each, tasks, "pid").groupBy("tag", "pid").agg(*[F.sum(k).alias(k) for k in "xyz"])
    length = g.norm(tuple(map(F.col, "xyz")))
    return total.select("tag", "pid", *[(F.col(k) / F.when(length > 0, length).otherwise(1.0)).alias(f"n{k}") for k in "xyz"])


def reindexed(surface: DataFrame, tasks: int | None = None) -> DataFrame:
    """tag, pid, n: the used vertices of each tag, numbered from 0 by pid.

    The number is the count of smaller used vertices, over blocks of 4096 ids, so no tag is sorted in one task.
    """
    used = surface.select("tag", F.explode(F.array(*"abc")).alias("pid")).withColumn("block", F.floor(F.col("pid") / 4096))
    used = dealt(used, tasks, "tag", "block").distinct()
    sizes = used.groupBy("tag", "block").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("tag").orderBy("block")) - F.col("size")).drop("size")
    within = F.row_number().over(Window.partitionBy("tag", "block").orderBy("pid")) - 1
    return used.withColumn("k", within).join(before.hint("merge"), ["tag", "block"]).select("tag", "pid", (F.col("before") + F.col("k")).alias("n"))


def fitted_grid(facets: DataFrame, side: int) -> DataFrame:
    """One row ox, oy, oz, pitch: a cube grid around all corners with a margin of one cell; no row values for no facets."""
    each = lambda x: (F.col(f"{c}.{x}") for c in "abc")
    found = facets.agg(*[f(h(*each(x))).alias(f"{n}{x}") for x in "xyz" for n, f, h in (("lo", F.min, F.least), ("hi", F.max, F.greatest))])
    pitch = F.greatest(*[F.col(f"hi{x}") - F.col(f"lo{x}") for x in "xyz"]) / (side - 2)
    found = found.withColumn("pitch", pitch)
    return found.select(*[((F.col(f"lo{x}") + F.col(f"hi{x}")) / 2 - F.col("pitch") * side / 2).alias(f"o{x}") for x in "xyz"], "pitch")


def prepared(facets: DataFrame) -> DataFrame:
    """``facets`` with what a line along x needs to know of one: det, by_y, by_z and its edges e0 to e2 with slopes s0 to s2; facets along x are left out."""

    def edge(p: str, q: str) -> Column:
        low = F.least(*[F.struct(F.col(f"{c}.y").alias("y"), F.col(f"{c}.z").alias("z")) for c in (p, q)])
        high = F.greatest(*[F.struct(F.col(f"{c}.y").alias("y"), F.col(f"{c}.z").alias("z")) for c in (p, q)])
        return F.struct(low.alias("low"), high.alias("high"))

    u, v = ([F.col(f"{c}.{x}") - F.col(f"a.{x}") for x in "xyz"] for c in "bc")
    f = facets.withColumn("det", u[1] * v[2] - u[2] * v[1]).where("det != 0")
    f = f.withColumns({"by_y": F.try_divide(u[0] * v[2] - u[2] * v[0], F.col("det")), "by_z": F.try_divide(u[1] * v[0] - u[0] * v[1], F.col("det")), **{f"e{k}": edge(p, q) for k, (p, q) in enumerate(("ab", "bc", "ca"))}})
    return f.withColumns({f"s{k}": F.try_divide(F.col(f"e{k}.high.z") - F.col(f"e{k}.low.z"), F.col(f"e{k}.high.y") - F.col(f"e{k}.low.y")) for k in range(3)})


def line_meets(y: Column, z: Column) -> tuple[Column, Column]:
    """Whether the line along x through (y, z) meets a prepared facet, and at which x.

    It is told by the parity of the edges beside the line, with each edge taken from its lower
    end, so that two facets that share an edge never both take, or both miss, a line along it.
    """
    beside = [F.when((F.col(f"e{k}.low.y") <= y) & (y < F.col(f"e{k}.high.y")) & (z < F.col(f"e{k}.low.z") + (y - F.col(f"e{k}.low.y")) * F.col(f"s{k}")), 1).otherwise(0) for k in range(3)]
    return (beside[0] + beside[1] + beside[2]) % 2 == 1, F.col("a.x") + (y - F.col("a.y")) * F.col("by_y") + (z - F.col("a.z")) * F.col("by_z")


def crossings(facets: DataFrame, grid: DataFrame, side: int) -> DataFrame:
    """structure, j, k, x, way: where lines along x through the cell centres (j, k) of the grid meet the facets.

    A facet is dealt only to the lines of its bounding box. ``way`` is 1 where a line leaves through
    a facet that is wound outwards, -1 where it enters.
    """
    f = prepared(facets).join(F.broadcast(grid))  # one row; what depends on the facet alone is worked out before it is dealt
    for n, x in (("j", "y"), ("k", "z")):
        place = lambda v, x=x: (v - F.col(f"o{x}")) / F.col("pitch") - 0.5
        lo = F.greatest(F.ceil(place(F.least(*[F.col(f"{c}.{x}") for c in "abc"]))), F.lit(0))
        hi = F.least(F.floor(place(F.greatest(*[F.col(f"{c}.{x}") for c in "abc"]))), F.lit(side - 1))
        f = f.where(lo <= hi).withColumn(n, F.explode(F.sequence(lo, hi))).withColumn(x, (F.col(n) + 0.5) * F.col("pitch") + F.col(f"o{x}"))
    met, x = line_meets(F.col("y"), F.col("z"))
    return f.where(met).select("structure", "j", "k", x.alias("x"), F.signum("det").cast("int").alias("way"))


def spans(met: DataFrame) -> DataFrame:
    """structure, j, k, hits, enter, leave: crossings 1-2, 3-4, ... of each line; a line with an odd count has one row with nulls.

    One line through one structure is one group; its size is bounded by how often the surface folds over the line.
    """
    w = Window.partitionBy("structure", "j", "k")
    placed = met.withColumn("n", F.row_number().over(w.orderBy("x")) - 1).withColumn("hits", F.count("*").over(w))
    pair = F.when(F.col("hits") % 2 == 0, F.floor(F.col("n") / 2))
    pick = lambda odd: F.max(F.when((F.col("hits") % 2 == 0) & (F.col("n") % 2 == odd), F.col("x")))
    return placed.groupBy("structure", "j", "k", "hits", pair.alias("pair")).agg(pick(0).alias("enter"), pick(1).alias("leave")).drop("pair")


def chords(found: DataFrame) -> DataFrame:
    """structure, chord: how long the spans are; those up to MIN_CHORD are no chords."""
    return found.select("structure", (F.col("leave") - F.col("enter")).alias("chord")).where(F.col("chord") > MIN_CHORD)


def filled(found: DataFrame, grid: DataFrame, side: int) -> DataFrame:
    """i, j, k, structure: cells whose centres lie in a span; where structures overlap the last one, the largest, stands."""
    f = found.where("enter is not null").join(F.broadcast(grid))  # one row
    place = lambda c: (F.col(c) - F.col("ox")) / F.col("pitch") - 0.5
    lo, hi = F.greatest(F.ceil(place("enter")), F.lit(0)), F.least(F.floor(place("leave")), F.lit(side - 1))
    cells = f.where(lo <= hi).select("structure", F.explode(F.sequence(lo, hi)).alias("i"), "j", "k")
    return cells.groupBy("i", "j", "k").agg(F.max("structure").alias("structure"))


def parity_verdict(met: DataFrame, facets: DataFrame) -> DataFrame:
    """structure, rays, odd, max_hits, over_two, verdict: how the lines that meet each structure of facets cross it.

    over_two is the share of those lines with more than two crossings; no line at all is no evidence.
    """
    lines = met.groupBy("structure", "j", "k").agg(F.count("*").alias("hits"))
    found = lines.groupBy("structure").agg(F.count("*").alias("rays"), F.count_if(F.col("hits") % 2 == 1).alias("odd"), F.max("hits").alias("max_hits"), F.avg((F.col("hits") > 2).cast("int")).alias("over_two"))
    share = F.col("over_two")
    verdict = F.when(F.col("rays") == 0, "inconclusive").when(share >= MOSTLY, "inner surfaces").when(share >= PARTLY, "inner surfaces in places").otherwise("solid")
    return facets.select("structure").distinct().join(found, "structure", "left").na.fill(0, ["rays", "odd", "max_hits", "over_two"]).withColumn("verdict", verdict)
