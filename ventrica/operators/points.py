"""Labelled points: sector membership, sweeps, extents and nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Probe, Vec
from ..scratch import discard, written


def at(prefix: str = "") -> Vec:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def first_seen(points: DataFrame, pose: Callable[[Column], Probe], samples: int) -> DataFrame:
    """structure, first_step, neg_points, ord, vacuous: when a sweep first reaches each structure.

    The steps are tried inside one expression per point, so rows are never multiplied; the
    aggregation is partial. Order is by step, then by falling point count, then structure.
    """
    reached = F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda s: pose(s.cast("double") / (samples - 1)).contains(at()))
    step = F.when(F.size(reached) > 0, F.element_at(reached, 1).cast("long"))
    seen = points.groupBy("structure").agg(F.min(step).alias("first_step"), (-F.count("*")).alias("neg_points")).where("first_step is not null")
    every = Window.partitionBy()  # over one row per structure
    order = F.row_number().over(Window.orderBy("first_step", "neg_points", "structure")).cast("long")
    vacuous = (F.count("*").over(every) < 2) | (F.min("first_step").over(every) == F.max("first_step").over(every))
    return seen.select("structure", "first_step", "neg_points", order.alias("ord"), vacuous.alias("vacuous"))


def nearest(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """left's columns with ``near``: the distance to the closest row of right.

    Null if right has no point or the row's own coordinates are null or not finite; repeated rows
    stay as many. Grid rings: with cells of width h a point is joined with the 27 cells around
    it, and is settled if its best distance is at most h; the rest goes on with twice the width,
    until the cells hold all of right.
    """
    sound = lambda names: F.coalesce(F.forall(F.array(*names), lambda v: ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))), F.lit(False))
    right = right.where(sound("xyz")).select(*[F.col(c).alias(f"_{c}") for c in "xyz"])
    rest = written(left.withColumn("_row", F.monotonically_increasing_id()), "points")
    done = [rest.where(~sound("xyz")).withColumn("near", F.lit(None).cast("double"))]
    rest, any_right = rest.where(sound("xyz")), not right.isEmpty()
    while any_right and not rest.isEmpty():
        index = [F.floor(F.col(c) / F.lit(cell)).cast("long") for c in "xyz"]
        key = F.struct(*[F.floor(F.col(f"_{c}") / F.lit(cell)).cast("long").alias(k) for c, k in zip("xyz", "ijk", strict=True)])
        around = F.explode(F.flatten(F.flatten(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda a: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda b: F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda c: F.struct((index[0] + a).alias("i"), (index[1] + b).alias("j"), (index[2] + c).alias("k"))))))))  # noqa: B023
        pairs = rest.select("_row", *"xyz", around.alias("_cell")).join(right.withColumn("_cell", key), "_cell")
        gap = F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2 + (F.col("z") - F.col("_z")) ** 2)
        best = written(pairs.groupBy("_row").agg(F.min(gap).alias("near")).where(F.col("near") <= cell), "near")
        done.append(rest.join(best, "_row"))
        rest = written(rest.join(best, "_row", "left_anti"), "points")
        cell *= 2
    out = done + ([] if any_right else [rest.withColumn("near", F.lit(None).cast("double"))])
    return reduce(DataFrame.unionByName, out).drop("_row")


#: Places that a cell of nearest_k holds on average where the densest cells are; a task's share of pairs follows from it.
IN_A_CELL = 16
#: How often the first width is halved at most.
HALVINGS = 40


def _fitting(places: DataFrame, cell: float) -> float:
    """``cell``, halved until its cells hold IN_A_CELL places or less, as a place in them sees it."""
    for _ in range(HALVINGS):
        sizes = places.groupBy(*[F.floor(F.col(f"_{c}") / F.lit(cell)).alias(c) for c in "xyz"]).agg(F.count("*").alias("n"))
        seen = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n")) / F.sum("n")).first()[0]
        if seen is None or seen <= IN_A_CELL:
            break
        cell /= 2
    return cell


def nearest_k(left: DataFrame, right: DataFrame, k: int, cell: float) -> DataFrame:
    """id, rank, other, distance: the k nearest rows of right(id, x, y, z) for each row of left(id, x, y, z), itself left out.

    Ranks begin at 1; equal distances go by the smaller id. Fewer rows than k give fewer ranks;
    rows with a null or non-finite coordinate have no neighbours and are none. Ids must be unique.
    As in nearest, a place meets the cells around it and is settled if k neighbours lie within a
    cell's width; the rest goes on with twice the width, until cells hold all of right. The first
    width is ``cell``, or less where that holds many rows, so pairs grow with the rows and not with
    their square. Rows at one place are one: it has its k + 1 smallest ids, as no row can have more
    of them for neighbours.
    """
    sound = F.coalesce(F.forall(F.array(*"xyz"), lambda v: ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))), F.lit(False))
    plain = [(F.col(c) + 0.0).alias(c) for c in "xyz"]
    within = Window.partitionBy(*"xyz").orderBy("id")
    firsts = right.where(sound).select("id", *plain).withColumn("_n", F.row_number().over(within)).where(F.col("_n") <= k + 1)
    right = written(firsts.groupBy(*[F.col(c).alias(f"_{c}") for c in "xyz"]).agg(F.collect_list("id").alias("ids")), "right")
    asked = written(left.where(sound).select("id", *plain), "left")
    rest, done = written(asked.select(*"xyz").distinct(), "points"), []
    farthest = lambda df, names: df.agg(F.max(F.greatest(*[F.abs(n) for n in names]))).first()[0]
    of_right, of_left = farthest(right, ("_x", "_y", "_z")), farthest(rest, "xyz")
    cell = _fitting(right, cell)
    order = Window.partitionBy(*"xyz").orderBy("distance", "other")
    while of_right is not None and not rest.isEmpty():
        index = [F.floor(F.col(c) / F.lit(cell)).cast("long") for c in "xyz"]
        key = F.struct(*[F.floor(F.col(f"_{c}") / F.lit(cell)).cast("long").alias(n) for c, n in zip("xyz", "ijk", strict=True)])
        near = F.struct(*[(i + F.col(f"_o.{n}")).alias(n) for i, n in zip(index, "ijk", strict=True)])
        steps = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(o, "ijk", strict=True)]) for o in product((-1, 0, 1), repeat=3)])
        pairs = rest.withColumn("_o", F.explode(steps)).withColumn("_cell", near).join(right.withColumn("_cell", key).hint("merge"), "_cell")
        gap = F.sqrt(sum((F.col(c) - F.col(f"_{c}")) ** 2 for c in "xyz"))
        last = cell > max(of_right, of_left)  # two cells an axis hold all points, so every place has met all
        # what lies beyond a cell's width settles nothing; k + 1, as one of them may be the row itself
        pairs = pairs.select(*"xyz", gap.alias("distance"), "ids").where(F.lit(last) | (F.col("distance") <= cell))
        ranked = written(pairs.select(*"xyz", "distance", F.explode("ids").alias("other")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1), "ranked")
        # without the row itself, k others lie within a cell's width
        settled = ranked.select(*"xyz").distinct() if last else ranked.where(F.col("rank") == k + 1).select(*"xyz")
        done.append(ranked.join(settled.hint("merge"), [*"xyz"], "left_semi"))
        if last:
            break
        old, rest = rest, written(rest.join(settled.hint("merge"), [*"xyz"], "left_anti"), "points")
        discard(old)
        cell *= 2
    none = rest.select(*"xyz", F.lit(0.0).alias("distance"), F.lit(0).cast(asked.schema["id"].dataType).alias("other"), F.lit(0).alias("rank")).limit(0)
    found = reduce(DataFrame.unionByName, done, none).drop("rank")
    others = asked.join(found.hint("merge"), [*"xyz"]).where("other <> id")
    of_row = Window.partitionBy("id").orderBy("distance", "other")
    return others.withColumn("rank", F.row_number().over(of_row)).where(F.col("rank") <= k).select("id", "rank", "other", "distance")


def grabbed(pointers: DataFrame, handles: DataFrame, radius: float, last: bool) -> DataFrame:
    """pointer, handle, px for pointers(pointer, px_x, px_y) and handles(handle, x, y): the nearest handle within the radius, itself included.

    Of equally near ones the ``last`` or the first handle stands. Places of handles and of pointers
    meet by bins of the radius, each place once with the one handle that it can yield, however many
    lie there; a pointer without a handle in reach has no row.
    """
    place = lambda v: F.floor(v / F.lit(float(radius)))
    stand = handles.groupBy("x", "y").agg((F.max if last else F.min)("handle").alias("handle"))
    asked = pointers.select(F.col("px_x").alias("_x"), F.col("px_y").alias("_y")).distinct()
    around = F.explode(F.array(*[F.struct((place(F.col("_x")) + a).alias("i"), (place(F.col("_y")) + b).alias("j")) for a, b in product((-1, 0, 1), repeat=2)]))
    pairs = asked.withColumn("_bin", around).join(stand.withColumn("_bin", F.struct(place(F.col("x")).alias("i"), place(F.col("y")).alias("j"))).hint("merge"), "_bin")
    px = F.hypot(F.col("_x") - F.col("x"), F.col("_y") - F.col("y"))
    reached = pairs.select("_x", "_y", "handle", px.alias("px")).where(F.col("px") <= radius)
    order = F.struct("px", (-F.col("handle") if last else F.col("handle")).alias("_h"))
    nearest_of = lambda df, *keys: df.groupBy(*keys).agg(F.min_by("handle", order).alias("handle"), F.min("px").alias("px"))
    best = nearest_of(reached, "_x", "_y").hint("merge")
    return nearest_of(pointers.join(best, (F.col("px_x") == F.col("_x")) & (F.col("px_y") == F.col("_y"))), "pointer")
