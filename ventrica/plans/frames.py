"""Queries over frames; each label of embeddings is read as a body of points, with the fourth number as its long coordinate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import views as v
from ..operators import frames


def _points(spark, sf_dir):
    e = lambda k: F.col("embedding")[k].cast("double")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", *[e(k).alias(n) for k, n in enumerate("xyz")], e(3).alias("along"), e(4).alias("side"))


def landmark_frames(spark, sf_dir):
    """The basis of each label from its ends and the mean of the points with a positive fifth number, and checks of its signs."""
    points = _points(spark, sf_dir)
    left = points.where("side > 0").groupBy("label").agg(*[F.avg(x).alias(f"l{x}") for x in "xyz"])
    rows = frames.axis_ends(points, "label", "along").join(left, "label")
    apex, base, side = (tuple(F.col(f"{n}{x}") for x in "xyz") for n in "abl")
    rows = frames.frame(rows, apex, base, g.sub(side, apex))
    basis = [v.of(n) for n in ("left", "long", "front")]
    apex_in, base_in, left_in = (frames.framed(basis, p) for p in (apex, base, side))
    shown = [(F.round(c, 5) + 0.0).alias(f"{n}_{x}") for n, axis in zip(("left", "long", "front"), basis, strict=True) for c, x in zip(axis, "xyz", strict=True)]
    checks = ((apex_in[1] < base_in[1]).alias("apex_below_base"), (left_in[0] > apex_in[0]).alias("left_of_apex"))
    return rows.select("label", *shown, F.round(g.norm(g.sub(base, apex)), 5).alias("long_axis"), *checks)


_P = "p AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS along, embedding[5]::DOUBLE AS side FROM embeddings)"
LANDMARKS = f"""WITH {_P}, q AS (SELECT label, quantile_cont(along, 0.01) AS lo, quantile_cont(along, 0.99) AS hi FROM p WHERE along >= -1 GROUP BY 1),
ends AS (SELECT label, {", ".join(f"avg({x}) FILTER (along <= lo) AS a{x}, avg({x}) FILTER (along >= hi) AS b{x}" for x in "xyz")} FROM p JOIN q USING (label) WHERE along >= -1 GROUP BY 1),
l AS (SELECT label, avg(x) AS lx, avg(y) AS ly, avg(z) AS lz FROM p WHERE side > 0 GROUP BY 1),
d AS (SELECT label, sqrt((bx-ax)**2+(b_y-ay)**2+(bz-az)**2) AS n, bx-ax AS ux, b_y-ay AS uy, bz-az AS uz, lx-ax AS sx, ly-ay AS sy, lz-az AS sz FROM ends JOIN l USING (label)),
u AS (SELECT label, n, ux/n AS ux, uy/n AS uy, uz/n AS uz, sx, sy, sz, (sx*ux+sy*uy+sz*uz)/n AS k FROM d), s AS (SELECT *, sqrt(sx*sx+sy*sy+sz*sz-k*k) AS m FROM u), f AS (SELECT label, n, ux, uy, uz, (sx-k*ux)/m AS vx, (sy-k*uy)/m AS vy, (sz-k*uz)/m AS vz FROM s)
SELECT label, round(vx, 5) + 0.0 AS left_x, round(vy, 5) + 0.0 AS left_y, round(vz, 5) + 0.0 AS left_z, round(ux, 5) + 0.0 AS long_x, round(uy, 5) + 0.0 AS long_y, round(uz, 5) + 0.0 AS long_z,
 round(vy*uz-vz*uy, 5) + 0.0 AS front_x, round(vz*ux-vx*uz, 5) + 0.0 AS front_y, round(vx*uy-vy*ux, 5) + 0.0 AS front_z, round(n, 5) AS long_axis, true AS apex_below_base, true AS left_of_apex FROM f""".replace("AS by,", "AS b_y,")


def plane_fit(spark, sf_dir):
    """The plane fitted to each label's points, its normal towards positive z; no SQL twin, as SQL has no eigenvectors."""
    out = frames.fitted_planes(_points(spark, sf_dir), "label", g.vec(0, 0, 1))
    return out.select("label", *[F.round(c, 6).alias(c) for c in ("nx", "ny", "nz", "spread")])


def orientation_coherence(spark, sf_dir):
    """Axis names and hand made of each part's key: why they are no frame, if so."""
    names = F.array(*map(F.lit, ("+x", "-x", "+y", "-y", "+z", "-z")))
    pick = lambda by: F.element_at(names, (F.floor(F.col("p_partkey") / by) % 6 + 1).cast("int"))
    axes = [pick(1), pick(6), pick(36)]
    issue = frames.coherent(axes, F.when(F.floor(F.col("p_partkey") / 216) % 2 == 0, "right").otherwise("left"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", issue.alias("issue"))


_AXIS = lambda by: f"(p_partkey // {by}) % 6"
# a triple of unit axes has the determinant of the matrix of their components
COHERENT = f"""WITH a AS (SELECT p_partkey, {_AXIS(1)} AS a, {_AXIS(6)} AS b, {_AXIS(36)} AS c, (p_partkey // 216) % 2 = 0 AS right_ FROM part),
v AS (SELECT p_partkey, right_, {", ".join(f"CASE WHEN {n} // 2 = {k} THEN 1 - 2 * ({n} % 2) ELSE 0 END AS {n}{k}" for n in "abc" for k in range(3))} FROM a),
d AS (SELECT *, a0*(b1*c2-b2*c1) - a1*(b0*c2-b2*c0) + a2*(b0*c1-b1*c0) AS det FROM v)
SELECT p_partkey, CASE WHEN det = 0 THEN 'axes repeat' WHEN (det > 0) <> right_ THEN 'does not fit the axes' END AS issue FROM d"""

QUERIES = {f.__name__: f for f in (landmark_frames, plane_fit, orientation_coherence)}
ORACLES = {"landmark_frames": LANDMARKS, "orientation_coherence": COHERENT}
