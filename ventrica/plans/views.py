"""Queries over frames, maps, screens and colours; embeddings are read as vectors, keys of parts and nations as colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import views as v

STOPS = 24
HALF_DEG, MM = 35.0, 30.0
#: A volume's map from model to cells, by columns, and its cells a side.
TO_CELLS, CELLS = (16.0, 2.0, 0.0, 0.0, -1.0, 16.0, 0.0, 0.0, 0.0, 3.0, 16.0, 0.0, 16.0, 16.0, 16.0, 1.0), 32
TOLERANCE = 0.06


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vec(first: int) -> g.Vec:
    return tuple(F.get(F.col("embedding"), F.lit(first + k)).cast("double") for k in range(3))


def _shown(p: g.Vec, name: str):
    return [(F.round(c, 6) + 0.0).alias(f"{name}{x}") for c, x in zip(p, "xyz", strict=True)]


def imaging_frames(spark, sf_dir):
    """The frame of each embedding read as beam and lateral, a point of its fan, the basis of the plane across the beam, and the angle between what was given."""
    rows = v.held(_t(spark, sf_dir, "embeddings").select("vec_id", "embedding"), p=_vec(0), q=_vec(3))
    rows = v.plane_basis(v.imaging_frame(rows, v.of("p"), v.of("q")), v.of("beam"), g.vec(1, 0, 0))
    point = v.sample_point(g.vec(1, 2, 3), v.of("beam"), v.of("lateral"), F.lit(0.5), HALF_DEG, F.lit(MM))
    return rows.select("vec_id", *_shown(v.of("normal"), "n"), *_shown(point, "s"), *_shown(v.of("u"), "u"), *_shown(v.of("w"), "w"), F.round(v.angle_deg(v.of("p"), v.of("q")), 6).alias("angle"))


_E = "e AS (SELECT vec_id, label, " + ", ".join(f"embedding[{k + 1}]::DOUBLE AS e{k}" for k in range(9)) + " FROM embeddings)"
FRAMES = f"""WITH {_E}, b AS (SELECT *, sqrt(e0*e0+e1*e1+e2*e2) AS bn, e0*e3+e1*e4+e2*e5 AS d, sqrt(e3*e3+e4*e4+e5*e5) AS qn FROM e),
r AS (SELECT *, e3-e0*d/bn**2 AS l0, e4-e1*d/bn**2 AS l1, e5-e2*d/bn**2 AS l2 FROM b), l AS (SELECT *, sqrt(l0*l0+l1*l1+l2*l2) AS ln, sqrt(1-(e0/bn)**2) AS un FROM r),
f AS (SELECT *, e0/bn AS b0, e1/bn AS b1, e2/bn AS b2, l0/ln AS m0, l1/ln AS m1, l2/ln AS m2 FROM l), k AS (SELECT *, (1-b0*b0)/un AS u0, -b0*b1/un AS u1, -b0*b2/un AS u2 FROM f)
SELECT vec_id, round(b1*m2-b2*m1, 6) + 0.0 AS nx, round(b2*m0-b0*m2, 6) + 0.0 AS ny, round(b0*m1-b1*m0, 6) + 0.0 AS nz,
 {", ".join(f"round({k + 1} + {MM}::DOUBLE*(b{k}*cos(radians({HALF_DEG / 2}))+m{k}*sin(radians({HALF_DEG / 2}))), 6) + 0.0 AS s{x}" for k, x in enumerate("xyz"))},
 round(u0, 6) + 0.0 AS ux, round(u1, 6) + 0.0 AS uy, round(u2, 6) + 0.0 AS uz, round(b1*u2-b2*u1, 6) + 0.0 AS wx, round(b2*u0-b0*u2, 6) + 0.0 AS wy, round(b0*u1-b1*u0, 6) + 0.0 AS wz, round(degrees(acos(greatest(-1, least(1, d/(bn*qn))))), 6) AS angle FROM k"""


def travel_path(spark, sf_dir):
    """Where the envelope of each embedding's probe ends while it tilts about z from -20 to 20 degrees around its own origin."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", *[c.alias(f"b{k}") for k, c in enumerate(_vec(0))], F.explode(F.sequence(F.lit(0), F.lit(STOPS))).alias("step"))
    turn = F.radians(v.swept(F.col("step") / float(STOPS), F.lit(-20.0), F.lit(20.0)))
    beam = g.rotated(tuple(F.col(f"b{k}") for k in range(3)), g.vec(0, 0, 1), turn)
    return rows.select("vec_id", F.col("step").cast("long").alias("step"), *_shown(v.behind(g.vec(0, 0, 60), beam), ""))


PATH = f"""WITH {_E}, s AS (SELECT vec_id, r.s::BIGINT AS step, radians(-20 + 40 * r.s / {STOPS}::DOUBLE) AS a, e0, e1, e2, sqrt(e0*e0+e1*e1+e2*e2) AS n FROM e, range({STOPS + 1}) r(s))
SELECT vec_id, step, round(-46*(e0*cos(a)-e1*sin(a))/n, 6) + 0.0 AS x, round(-46*(e0*sin(a)+e1*cos(a))/n, 6) + 0.0 AS y, round(60-46*e2/n, 6) + 0.0 AS z FROM s"""


def volume_registration(spark, sf_dir):
    """How far the centre of each label's cells lies from the centre of its vertices in model space, against 6 % of the volume's diagonal."""
    m = [F.lit(c) for c in TO_CELLS]
    vertex, cell = _vec(0), v.added(v.mapped(m, _vec(3)), g.vec(0.5, 0.5, 0.5))
    means = _t(spark, sf_dir, "embeddings").groupBy("label").agg(*[F.avg(c).alias(f"{n}{k}") for n, p in (("v", vertex), ("c", cell)) for k, c in enumerate(p)])
    far = g.norm(g.sub(v.unmapped(m, g.vec(CELLS, CELLS, CELLS)), v.unmapped(m, g.vec(0, 0, 0)))) * TOLERANCE
    gap = g.norm(g.sub(v.unmapped(m, tuple(F.col(f"c{k}") for k in range(3))), tuple(F.col(f"v{k}") for k in range(3))))
    return means.select("label", F.round(gap, 6).alias("gap"), F.round(far, 6).alias("tolerance"), (gap > far).alias("unregistered"))


def dim_palette_de2000(spark, sf_dir):
    """How far dimming moves the colour of each part."""
    colour = (F.col("p_partkey") * 7919 % 16777216).cast("long")
    rows = _t(spark, sf_dir, "part").select("p_partkey", colour.alias("colour"))
    rgb = v.channels(F.col("colour"))
    out = v.colour_difference(rows, v.lab(rgb), v.lab(v.dimmed(rgb)), "difference")
    return out.select("p_partkey", "colour", F.round("difference", 4).alias("difference"))


def closest_colours(spark, sf_dir):
    """Of the palette of each region's nations the closest pair, and how many pairs differ by less than 20."""
    rows = _t(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", (F.col("n_nationkey") * 655361 % 16777216).cast("long").alias("colour"))
    other = rows.select("n_regionkey", F.col("n_nationkey").alias("other"), F.col("colour").alias("colour2"))
    pairs = rows.join(other, "n_regionkey").where("n_nationkey < other")
    found = v.colour_difference(pairs, v.lab(v.channels(F.col("colour"))), v.lab(v.channels(F.col("colour2"))), "difference")
    best = F.min(F.struct("difference", "n_nationkey", "other"))
    return found.groupBy("n_regionkey").agg(best.alias("b"), F.count_if(F.col("difference") < 20).alias("n_close")).select("n_regionkey", F.col("b.n_nationkey").alias("one"), F.col("b.other").alias("two"), F.round("b.difference", 4).alias("difference"), "n_close")


_CHANNELS = lambda n, of: ", ".join(f"(({of} >> {bits}) & 255)::DOUBLE AS {n}{c}" for bits, c in ((16, "r"), (8, "g"), (0, "b")))


def _lab_sql(n: str) -> str:
    lin = {c: f"(CASE WHEN {n}{c}/255 <= 0.04045 THEN {n}{c}/255/12.92 ELSE pow(({n}{c}/255+0.055)/1.055, 2.4) END)" for c in "rgb"}
    t = [f"(({' + '.join(f'{k}::DOUBLE*{lin[c]}' for k, c in zip(row, 'rgb', strict=True))})/{white}::DOUBLE)" for row, white in zip(v.SRGB_TO_XYZ, v.WHITE, strict=True)]
    f = [f"(CASE WHEN {x} > 0.008856 THEN cbrt({x}) ELSE {x}*7.787::DOUBLE + 16/116::DOUBLE END)" for x in t]
    return f"116*{f[1]}-16 AS l{n}, 500*({f[0]}-{f[1]}) AS a{n}, 200*({f[1]}-{f[2]}) AS b{n}"


def _difference_sql(rows: str, keys: str) -> str:
    """CTEs from rows with channels pr, pg, pb and qr, qg, qb to de(keys, difference)."""
    return f"""c0 AS (SELECT {keys}, {_lab_sql("p")}, {_lab_sql("q")} FROM {rows}),
c1 AS (SELECT *, 1.5-0.5*sqrt(1-pow(25.0::DOUBLE, 7)/(pow((sqrt(ap*ap+bp*bp)+sqrt(aq*aq+bq*bq))/2, 7)+pow(25.0::DOUBLE, 7))) AS g FROM c0),
c2 AS (SELECT *, sqrt(ap*ap*g*g+bp*bp) AS cp, sqrt(aq*aq*g*g+bq*bq) AS cq, degrees(atan2(bp, ap*g)) AS hp0, degrees(atan2(bq, aq*g)) AS hq0 FROM c1),
c3 AS (SELECT *, CASE WHEN hp0 < 0 THEN hp0+360 ELSE hp0 END AS hp, CASE WHEN hq0 < 0 THEN hq0+360 ELSE hq0 END AS hq, (cp+cq)/2 AS c FROM c2),
c4 AS (SELECT *, CASE WHEN abs(hq-hp) <= 180 THEN hq-hp WHEN hq > hp THEN hq-hp-360 ELSE hq-hp+360 END AS dh, CASE WHEN abs(hq-hp) <= 180 THEN (hp+hq)/2 WHEN hp+hq < 360 THEN (hp+hq+360)/2 ELSE (hp+hq-360)/2 END AS h FROM c3),
c5 AS (SELECT *, (lq-lp)/(1+0.015*pow((lp+lq)/2-50, 2)/sqrt(20+pow((lp+lq)/2-50, 2))) AS x, (cq-cp)/(1+0.045*c) AS y,
 2*sqrt(cp*cq)*sin(radians(dh)/2)/(1+0.015*c*(1-0.17*cos(radians(h-30))+0.24*cos(radians(2*h))+0.32*cos(radians(3*h+6))-0.20*cos(radians(4*h-63)))) AS z,
 -sin(radians(60*exp(-pow((h-275)/25, 2))))*2*sqrt(pow(c, 7)/(pow(c, 7)+pow(25.0::DOUBLE, 7))) AS r FROM c4),
de AS (SELECT *, sqrt(x*x+y*y+z*z+r*y*z) AS difference FROM c5)"""


_LUMA = "(0.2126::DOUBLE*pr+0.7152::DOUBLE*pg+0.0722::DOUBLE*pb)"
DIM = f"""WITH p0 AS (SELECT p_partkey, p_partkey * 7919 % 16777216 AS colour FROM part), p1 AS (SELECT *, {_CHANNELS("p", "colour")} FROM p0),
p2 AS (SELECT *, {", ".join(f"least(255, greatest(0, 0.6::DOUBLE*(0.72::DOUBLE*{_LUMA}+0.28::DOUBLE*p{c}))) AS q{c}" for c in "rgb")} FROM p1), {_difference_sql("p2", "p_partkey, colour")}
SELECT p_partkey, colour, round(difference, 4) AS difference FROM de"""
CLOSEST = f"""WITH p0 AS (SELECT n_regionkey, n_nationkey, (n_nationkey * 655361 % 16777216)::BIGINT AS colour FROM nation), p1 AS (SELECT a.n_regionkey, a.n_nationkey AS one, b.n_nationkey AS two, {_CHANNELS("p", "a.colour")}, {_CHANNELS("q", "b.colour")} FROM p0 a JOIN p0 b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey),
{_difference_sql("p1", "n_regionkey, one, two")}, n AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY difference, one, two) AS n, count(*) FILTER (difference < 20) OVER (PARTITION BY n_regionkey)::BIGINT AS n_close FROM de)
SELECT n_regionkey, one, two, round(difference, 4) AS difference, n_close FROM n WHERE n = 1"""


def handle_reveal(spark, sf_dir):
    """How far each embedding's segment is from a pointer on a screen of 800 by 600 pixels, and how visible its handle is; nothing of it if an end is behind."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(f"e{k}") for k in range(6)])
    a, b = (v.screen_point(tuple(F.col(f"e{k}") * 5 for k in range(first, first + 3)), 2.0, 45.0, 800, 600) for first in (0, 3))
    px = F.when(a[2] & b[2], v.segment_distance(a[0], a[1], b[0], b[1], 400, 300))
    return rows.withColumn("px", px).select("vec_id", F.round("px", 4).alias("px"), F.round(v.reveal(F.col("px"), False), 6).alias("shown"))


_SX = lambda x, z: f"({x}*5/((2-{z}*5)*tan(radians(22.5))*800/600::DOUBLE)+1)*400"
_SY = lambda y, z: f"(1-{y}*5/((2-{z}*5)*tan(radians(22.5))))*300"
REVEAL = f"""WITH {_E}, s AS (SELECT vec_id, e2*5 < 2 AND e5*5 < 2 AS front, {_SX("e0", "e2")} AS ax, {_SY("e1", "e2")} AS ay, {_SX("e3", "e5")} AS bx, {_SY("e4", "e5")} AS by_ FROM e),
u AS (SELECT *, greatest(0, least(1, ((400-ax)*(bx-ax)+(300-ay)*(by_-ay))/((bx-ax)**2+(by_-ay)**2))) AS u FROM s), d AS (SELECT vec_id, CASE WHEN front THEN sqrt((ax+(bx-ax)*u-400)**2+(ay+(by_-ay)*u-300)**2) END AS px FROM u)
SELECT vec_id, round(px, 4) AS px, round(CASE WHEN px IS NULL OR px >= 90 THEN 0 WHEN px <= 16 THEN 1 ELSE 1-(px-16)/74 END, 6) AS shown FROM d"""
# the means of cells and of mapped points commute, so only the half cell is left to undo: L d = (1/2, 1/2, 1/2), by substitution
REGISTRATION = f"""WITH {_E}, m AS (SELECT label, {", ".join(f"avg(e{k}) AS e{k}" for k in range(6))} FROM e GROUP BY 1),
i AS (SELECT 0.5::DOUBLE/16 AS z, {CELLS}::DOUBLE/16 AS fz), y AS (SELECT *, (0.5-3*z-2*0.5::DOUBLE/16)/(16+2/16::DOUBLE) AS y, ({CELLS}-3*fz-2*{CELLS}::DOUBLE/16)/(16+2/16::DOUBLE) AS fy FROM i),
d AS (SELECT *, (0.5+y)/16 AS x, ({CELLS}+fy)/16 AS fx FROM y), r AS (SELECT label, sqrt((e3+x-e0)**2+(e4+y-e1)**2+(e5+z-e2)**2) AS gap, sqrt(fx*fx+fy*fy+fz*fz)*{TOLERANCE} AS far FROM m, d)
SELECT label, round(gap, 6) AS gap, round(far, 6) AS tolerance, gap > far AS unregistered FROM r"""

QUERIES = {f.__name__: f for f in (imaging_frames, travel_path, volume_registration, dim_palette_de2000, closest_colours, handle_reveal)}
ORACLES = {"imaging_frames": FRAMES, "travel_path": PATH, "volume_registration": REGISTRATION, "dim_palette_de2000": DIM, "closest_colours": CLOSEST, "handle_reveal": REVEAL}
