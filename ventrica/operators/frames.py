"""Anatomical frames: ends of an axis from a coordinate, a right-handed basis, and a plane fitted to points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import views as v

#: Coordinates below this mark points that have none.
SENTINEL_FLOOR = -1.0
END_PERCENTILE = 0.01


def axis_ends(points: DataFrame, group: str, along: str) -> DataFrame:
    """group, ax, ay, az, bx, by, bz: means of the points in the lowest and the highest percentile of a coordinate.

    A mean of many points stands for an end, as a single one may be an outlier. Points without a
    coordinate (null, NaN or under SENTINEL_FLOOR) don't count; a group without any has no row.
    """
    valid = points.where((F.col(along) >= SENTINEL_FLOOR) & ~F.isnan(along))
    at = valid.groupBy(group).agg(F.percentile(along, F.array(F.lit(END_PERCENTILE), F.lit(1 - END_PERCENTILE))).alias("q")).select(F.col(group).alias("_g"), F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi"))
    ends = valid.join(at, F.col(group).eqNullSafe(F.col("_g")))
    means = [F.avg(F.when(inside, F.col(x))).alias(f"{n}{x}") for n, inside in (("a", F.col(along) <= F.col("_lo")), ("b", F.col(along) >= F.col("_hi"))) for x in "xyz"]
    return ends.groupBy(group).agg(*means)


def frame(df: DataFrame, apex: g.Vec, base: g.Vec, left: g.Vec) -> DataFrame:
    """``df`` with unit vectors long, left and front: long runs from apex to base, left gives way to it, front makes the basis right-handed."""
    df = v.imaging_frame(df, g.sub(base, apex), left)
    df = v.held(df, long=v.of("beam"), left=v.of("lateral"), front=g.cross(v.of("lateral"), v.of("beam")))
    return df.drop(*[f"{n}_{x}" for n in ("beam", "lateral", "normal") for x in "xyz"])


def framed(basis: tuple[g.Vec, g.Vec, g.Vec], p: g.Vec) -> g.Vec:
    return tuple(g.dot(axis, p) for axis in basis)


def coherent(axes: list[Column], handed: Column) -> Column:
    """Why three axis names (+x, -y, ...) in the order right, up and back can't be a frame of that hand, null if they can."""
    letter = lambda a: F.substring(a, 2, 1)
    sign = [F.when(F.substring(a, 1, 1) == "-", -1).otherwise(1) for a in axes]
    # an even order of x, y, z keeps the hand, an odd one turns it
    turn = F.when(F.concat(*map(letter, axes)).isin("xyz", "yzx", "zxy"), 1).otherwise(-1) * sign[0] * sign[1] * sign[2]
    return F.when(F.size(F.array_distinct(F.array(*map(letter, axes)))) < 3, "axes repeat").when(F.when(turn > 0, "right").otherwise("left") != handed, "does not fit the axes")


def fitted_planes(points: DataFrame, group: str, towards: g.Vec) -> DataFrame:
    """group, nx, ny, nz, spread: unit normal of the plane through the mean of each group's points with the least squares, and the root mean square distance from it.

    The normal looks along ``towards``, columns that are one for each group. Sums of products are
    aggregated, centred at the group's mean, so only a matrix of three by three for each group reaches Python.
    """
    centre = points.groupBy(F.col(group).alias("_g")).agg(*[F.avg(x).alias(f"_m{x}") for x in "xyz"])
    moved = points.join(centre, F.col(group).eqNullSafe(F.col("_g"))).withColumns({f"_d{x}": F.col(x) - F.col(f"_m{x}") for x in "xyz"})
    moments = moved.groupBy(group).agg(*[F.avg(F.col(f"_d{p}") * F.col(f"_d{q}")).alias(p + q) for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")], *[F.first(t).alias(f"t{x}") for x, t in zip("xyz", towards, strict=True)])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            matrix = b[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy(float).reshape(-1, 3, 3)
            value, vector = np.linalg.eigh(matrix)
            normal = vector[:, :, 0]
            normal = np.where((normal * b[["tx", "ty", "tz"]].to_numpy(float)).sum(1, keepdims=True) < 0, -normal, normal)
            yield pd.DataFrame({group: b[group], "nx": normal[:, 0], "ny": normal[:, 1], "nz": normal[:, 2], "spread": np.sqrt(np.maximum(value[:, 0], 0))})

    kind = dict(points.dtypes)[group]
    return moments.mapInPandas(solve, f"`{group}` {kind}, nx double, ny double, nz double, spread double")
