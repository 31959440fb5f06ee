"""Queries of rays, cuts, fewer facets and nearest neighbours; facets and points come from embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import points as op
from ..operators import rays, reduce, surfaces
from .points import POINTS, labelled_points
from .surfaces import FACETS, GRID, MET, SIDE, facets

BIN = 5.0
K = 24
BUDGET, FLOOR = 1500, 100


def enclosure_share(spark, sf_dir):
    """Which share of each label's points lies inside each label's facets, by crossings beyond the point."""
    points = labelled_points(spark, sf_dir).select(F.col("structure").alias("group"), *"xyz")
    out = rays.enclosed(facets(spark, sf_dir), points, BIN)
    return out.select("structure", F.col("group").alias("points_of"), "n", "inside", F.round("share", 6).alias("share"))


_HIT = lambda y, z: f"""(b2-a2)*(c3-a3)-(b3-a3)*(c2-a2) <> 0 AND {y} BETWEEN least(a2,b2,c2) AND greatest(a2,b2,c2) AND {z} BETWEEN least(a3,b3,c3) AND greatest(a3,b3,c3)"""
_UV = lambda y, z: f"""(({y}-a2)*(c3-a3)-({z}-a3)*(c2-a2))/((b2-a2)*(c3-a3)-(b3-a3)*(c2-a2)) AS u, ((b2-a2)*({z}-a3)-(b3-a3)*({y}-a2))/((b2-a2)*(c3-a3)-(b3-a3)*(c2-a2)) AS v"""
ENCLOSURE = f"""{FACETS}, {POINTS[5:]}, h AS (SELECT f.structure, p.structure AS g, p.vid, p.x, a1, b1, c1, {_UV("p.y", "p.z")} FROM f, pts p WHERE {_HIT("p.y", "p.z")}),
o AS (SELECT structure, g, vid FROM h WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND a1 + u*(b1-a1) + v*(c1-a1) > x GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1), i AS (SELECT structure, g, count(*)::BIGINT AS inside FROM o GROUP BY 1, 2),
s AS (SELECT structure AS g, count(*)::BIGINT AS n FROM pts GROUP BY 1), t AS (SELECT DISTINCT structure FROM f)
SELECT t.structure, s.g AS points_of, n, coalesce(inside, 0) AS inside, round(coalesce(inside, 0)::DOUBLE / n, 6) AS share FROM t CROSS JOIN s LEFT JOIN i ON i.structure = t.structure AND i.g = s.g"""


def random_ray_parity(spark, sf_dir):
    """How often rays at scattered places of the middle of the box meet each structure; one ray for each embedding."""
    f = facets(spark, sf_dir)
    corner = lambda h, x: h(*[F.col(f"{c}.{x}") for c in "abc"])
    box = f.agg(*[fn(corner(h, x)).alias(f"{n}{x}") for x in "yz" for n, fn, h in (("lo", F.min, F.least), ("hi", F.max, F.greatest))])
    spread = lambda times, mod: 0.1 + 0.8 * ((F.col("vid") * times) % mod) / float(mod)
    at = {x: F.col(f"lo{x}") + (F.col(f"hi{x}") - F.col(f"lo{x}")) * spread(*m) for x, m in (("y", (7919, 10007)), ("z", (104729, 10009)))}
    table = labelled_points(spark, sf_dir).select("vid").join(F.broadcast(box)).select(F.col("vid").alias("ray"), *[c.alias(n) for n, c in at.items()])  # one row
    return rays.ray_parity(f, table, BIN)


RAYS = f"""{FACETS}, bo AS (SELECT {", ".join(f"min(least(a{k}, b{k}, c{k})) AS lo{k}, max(greatest(a{k}, b{k}, c{k})) AS hi{k}" for k in (2, 3))} FROM f),
ry AS (SELECT vec_id AS ray, lo2 + (hi2-lo2) * (0.1::DOUBLE + 0.8::DOUBLE * (vec_id * 7919 % 10007) / 10007) AS y, lo3 + (hi3-lo3) * (0.1::DOUBLE + 0.8::DOUBLE * (vec_id * 104729 % 10009) / 10009) AS z FROM embeddings, bo),
h AS (SELECT structure, ray, {_UV("y", "z")} FROM f, ry WHERE {_HIT("y", "z")}), n AS (SELECT structure, ray, count(*)::BIGINT AS hits FROM h WHERE u >= 0 AND v >= 0 AND u + v <= 1 GROUP BY 1, 2)
SELECT structure, hits, count(*)::BIGINT AS rays, hits % 2 = 1 AS odd FROM n GROUP BY 1, 2"""


def cut_caps(spark, sf_dir):
    """Cells that a slanted cut through each structure fills, seen along x."""
    f = facets(spark, sf_dir)
    found = rays.caps(f, surfaces.fitted_grid(f, SIDE), SIDE, 0.6 * F.col("x") + 0.8 * F.col("y") <= 5)
    return found.groupBy("structure").agg(F.count("*").alias("n"), F.sum("net").alias("net"), F.sum(F.abs("net")).alias("weight"), F.sum("j").alias("sj"), F.sum("k").alias("sk"))


CAPS = f"""{MET}, way AS (SELECT structure, j, k, y, a1 + u*(b1-a1) + v*(c1-a1) AS x, sign(det)::BIGINT AS way FROM uv WHERE u >= 0 AND v >= 0 AND u + v <= 1),
ne AS (SELECT structure, j, k, sum(way)::BIGINT AS net FROM way WHERE 0.6::DOUBLE*x + 0.8::DOUBLE*y <= 5 GROUP BY 1, 2, 3)
SELECT structure, count(*)::BIGINT AS n, sum(net)::BIGINT AS net, sum(abs(net))::BIGINT AS weight, sum(j)::BIGINT AS sj, sum(k)::BIGINT AS sk FROM ne WHERE net <> 0 GROUP BY 1"""


def decimated_facets(spark, sf_dir):
    """What is left of each structure within a budget of facets: the grid that was taken, counts, and the mean place of the corners."""
    kept, report = reduce.decimated(facets(spark, sf_dir), BUDGET, FLOOR)
    mean = lambda x: F.round(F.avg(sum(F.col(f"{c}.{x}") for c in "abc")) / 3, 4).alias(f"mean_{x}")
    return report.join(kept.groupBy("structure").agg(F.count("*").alias("n_facets"), *map(mean, "xyz")), "structure", "left")


_CELL = lambda c, level: f"CASE WHEN longest > 0 THEN {' + '.join(f'least(floor(({c}{k}-lo{k})/longest*{level}), {level}-1)::BIGINT * {m}' for k, m in ((1, 1048576), (2, 1024), (3, 1)))} ELSE 0 END"
_DET = lambda m: f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]}) - {m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]}) + {m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))"
_A = [["(xx+e)", "xy", "xz"], ["xy", "(yy+e)", "yz"], ["xz", "yz", "(zz+e)"]]
_AT = lambda col: [[_A[r][c] if c != col else f"r{r + 1}" for c in range(3)] for r in range(3)]
DECIMATED = f"""{FACETS}, bx AS (SELECT structure, {", ".join(f"min(least(a{k},b{k},c{k})) AS lo{k}, max(greatest(a{k},b{k},c{k})) AS hi{k}" for k in (1, 2, 3))} FROM f GROUP BY 1),
g AS (SELECT f.*, lo1, lo2, lo3, greatest(hi1-lo1, hi2-lo2, hi3-lo3) AS longest FROM f JOIN bx ON f.structure IS NOT DISTINCT FROM bx.structure),
nb AS (SELECT structure, count(*)::BIGINT AS before FROM g GROUP BY 1), al AS (SELECT *, greatest({FLOOR}, floor({BUDGET} * (before / (SELECT sum(before) FROM nb)::DOUBLE)))::BIGINT AS allowed FROM nb),
lv AS (SELECT structure, level, list_sort([{", ".join(_CELL(c, "level") for c in "abc")}]) AS key FROM g, (VALUES {", ".join(f"({x})" for x in reduce.LEVELS)}) l(level)),
le AS (SELECT structure, level, count(DISTINCT key)::BIGINT AS after FROM lv WHERE len(list_distinct(key)) = 3 GROUP BY 1, 2),
ev AS (SELECT al.*, l.level, coalesce(after, 0) AS after FROM al CROSS JOIN (VALUES {", ".join(f"({x})" for x in reduce.LEVELS)}) l(level) LEFT JOIN le ON le.structure = al.structure AND le.level = l.level),
be AS (SELECT structure, before, allowed, coalesce(max(level) FILTER (after <= allowed), 2) AS level FROM ev GROUP BY 1, 2, 3),
rp AS (SELECT be.*, after FROM be JOIN ev USING (structure, level)),
pl AS (SELECT g.*, {", ".join(f"{_CELL(c, 'be.level')} AS k{c}" for c in "abc")}, (b2-a2)*(c3-a3)-(b3-a3)*(c2-a2) AS n1, (b3-a3)*(c1-a1)-(b1-a1)*(c3-a3) AS n2, (b1-a1)*(c2-a2)-(b2-a2)*(c1-a1) AS n3 FROM g JOIN be USING (structure)),
pn AS (SELECT *, sqrt(n1*n1+n2*n2+n3*n3) AS l FROM pl), pu AS (SELECT * REPLACE (n1/CASE WHEN l > 0 THEN l ELSE 1 END AS n1, n2/CASE WHEN l > 0 THEN l ELSE 1 END AS n2, n3/CASE WHEN l > 0 THEN l ELSE 1 END AS n3), l/2 AS w FROM pn),
pd AS (SELECT *, -(n1*a1+n2*a2+n3*a3) AS d FROM pu),
co AS (SELECT structure, n1, n2, n3, d, w, unnest([ka,kb,kc]) AS cell, unnest([a1,b1,c1]) AS p1, unnest([a2,b2,c2]) AS p2, unnest([a3,b3,c3]) AS p3 FROM pd),
su AS (SELECT structure, cell, sum(w*n1*n1) AS xx, sum(w*n1*n2) AS xy, sum(w*n1*n3) AS xz, sum(w*n2*n2) AS yy, sum(w*n2*n3) AS yz, sum(w*n3*n3) AS zz, {", ".join(f"sum(w*n{k}*d) AS q{k}, avg(p{k}) AS m{k}" for k in (1, 2, 3))} FROM co GROUP BY 1, 2),
se AS (SELECT *, 1e-3::DOUBLE*(xx+yy+zz)+1e-9::DOUBLE AS e FROM su), sr AS (SELECT *, -(xx*m1+xy*m2+xz*m3+q1) AS r1, -(xy*m1+yy*m2+yz*m3+q2) AS r2, -(xz*m1+yz*m2+zz*m3+q3) AS r3 FROM se),
ve AS (SELECT structure, cell, {", ".join(f"m{k + 1} + {_DET(_AT(k))}/{_DET(_A)} AS v{k + 1}" for k in range(3))} FROM sr),
fa AS (SELECT DISTINCT structure, list_sort([ka,kb,kc]) AS key FROM pd WHERE ka <> kb AND kb <> kc AND ka <> kc),
fv AS (SELECT structure, unnest(key) AS cell FROM fa), me AS (SELECT structure, {", ".join(f"round(avg(v{k}), 4) AS mean_{x}" for k, x in ((1, "x"), (2, "y"), (3, "z")))}, (count(*) // 3)::BIGINT AS n_facets FROM fv JOIN ve USING (structure, cell) GROUP BY 1)
SELECT structure, before, allowed, level, after, n_facets, mean_x, mean_y, mean_z FROM rp LEFT JOIN me USING (structure)"""


def k_nearest_points(spark, sf_dir):
    """The 24 nearest other points of each point."""
    p = labelled_points(spark, sf_dir).select(F.col("vid").alias("id"), *"xyz")
    return op.nearest_k(p, p, K, 16.0).withColumn("distance", F.round("distance", 6))


K_NEAREST = f"""{POINTS}, d AS (SELECT a.vid AS id, b.vid AS other, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) AS distance FROM pts a JOIN pts b ON a.vid <> b.vid)
SELECT id, rank, other, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, other)::INT AS rank FROM d) WHERE rank <= {K}"""


def handle_hits(spark, sf_dir):
    """Which supplier's handle each customer's pointer grabs, by the rule that takes the first and by the one that takes the last of equally near ones."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    pointers = t("customer").select(F.col("c_custkey").alias("pointer"), (F.col("c_custkey") * 37 % 192 * 10).cast("double").alias("px_x"), (F.col("c_custkey") * 53 % 108 * 10).cast("double").alias("px_y"))
    handles = t("supplier").select(F.col("s_suppkey").alias("handle"), (F.col("s_suppkey") * 101 % 96 * 20).cast("double").alias("x"), (F.col("s_suppkey") * 67 % 54 * 20).cast("double").alias("y"))
    first, last = (op.grabbed(pointers, handles, 26.0, last=w) for w in (False, True))
    return first.join(last.select("pointer", F.col("handle").alias("last_handle")).hint("merge"), "pointer").withColumn("px", F.round("px", 6))


HITS = """WITH p AS (SELECT c_custkey AS pointer, (c_custkey*37%192*10)::DOUBLE AS x, (c_custkey*53%108*10)::DOUBLE AS y FROM customer), h AS (SELECT s_suppkey AS handle, (s_suppkey*101%96*20)::DOUBLE AS x, (s_suppkey*67%54*20)::DOUBLE AS y FROM supplier),
d AS (SELECT pointer, handle, sqrt((p.x-h.x)**2+(p.y-h.y)**2) AS px FROM p, h WHERE sqrt((p.x-h.x)**2+(p.y-h.y)**2) <= 26), m AS (SELECT pointer, min(px) AS px FROM d GROUP BY 1)
SELECT pointer, min(handle) AS handle, max(handle) AS last_handle, round(any_value(m.px), 6) AS px FROM d JOIN m USING (pointer) WHERE d.px = m.px GROUP BY 1"""

QUERIES = {f.__name__: f for f in (enclosure_share, random_ray_parity, cut_caps, decimated_facets, k_nearest_points, handle_hits)}
ORACLES = {"enclosure_share": ENCLOSURE, "random_ray_parity": RAYS, "cut_caps": CAPS, "decimated_facets": DECIMATED, "k_nearest_points": K_NEAREST, "handle_hits": HITS}
