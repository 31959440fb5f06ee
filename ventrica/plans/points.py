"""Queries over labelled points (embeddings read as points) and over closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import points as op

SAMPLES = 61


def _probe() -> g.Probe:
    return g.Probe(g.vec(0, -60, 60), g.vec(0, 0, -1), g.vec(1, 0, 0))


def labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: (F.col("embedding")[k].cast("double") * 100).alias("xyz"[k])
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("vid"), F.col("label").alias("structure"), e(0), e(1), e(2))


POINTS = "WITH pts AS (SELECT vec_id AS vid, label AS structure, embedding[1]::DOUBLE*100 AS x, embedding[2]::DOUBLE*100 AS y, embedding[3]::DOUBLE*100 AS z FROM embeddings)"


def sweep_first_seen(spark, sf_dir):
    pose = lambda t: g.translated(_probe(), g.vec(0, 1, 0), t * 120.0)
    return op.first_seen(labelled_points(spark, sf_dir), pose, SAMPLES)


SWEEP = f"""{POINTS}, hit AS (SELECT structure, s FROM pts, range(61) r(s) WHERE abs(y + 60 - s / 60.0::DOUBLE * 120) <= 6 AND abs(atan2(x, 60 - z)) <= radians(35) AND sqrt(x*x + (60-z)*(60-z)) <= 120),
seen AS (SELECT structure, min(s)::BIGINT AS first_step FROM hit GROUP BY 1),
all_ AS (SELECT structure, first_step, (SELECT -count(*) FROM pts p WHERE p.structure = seen.structure)::BIGINT AS neg_points FROM seen)
SELECT structure, first_step, neg_points, row_number() OVER (ORDER BY first_step, neg_points, structure)::BIGINT AS ord,
 (count(*) OVER () < 2 OR min(first_step) OVER () = max(first_step) OVER ()) AS vacuous FROM all_"""


def sector_membership(spark, sf_dir):
    probe = _probe()._replace(origin=g.vec(0, 0, 60))
    return labelled_points(spark, sf_dir).groupBy("structure").agg(F.count_if(probe.contains(op.at())).alias("inside"), F.count("*").alias("n_points"), F.round(F.sum(probe.crossed(op.at())), 6).alias("soft"))


_STEP = lambda lo, hi, v: f"(least(greatest(({v} - {lo}) / ({hi}::DOUBLE - {lo}), 0), 1))"
_SMOOTH = lambda lo, hi, v: f"({_STEP(lo, hi, v)} * {_STEP(lo, hi, v)} * (3 - 2 * {_STEP(lo, hi, v)}))"
SECTOR = f"""{POINTS}, p AS (SELECT structure, 60 - z AS along, abs(y) AS off, sqrt(x*x + (60-z)*(60-z)) AS r, abs(atan2(x, 60 - z)) AS a FROM pts)
SELECT structure, count(*) FILTER (off <= 6 AND a <= radians(35) AND r <= 120)::BIGINT AS inside, count(*)::BIGINT AS n_points,
 round(sum(CASE WHEN along >= 0 THEN (1 - {_SMOOTH(0.6, 1.0, "off / 6")}) * (1 - {_SMOOTH(0.97, 1.0, "r / 120")}) * (1 - {_SMOOTH(0.94, 1.0, "a / radians(35)")}) ELSE 0 END), 6) AS soft FROM p GROUP BY 1"""


def structure_extents(spark, sf_dir):
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    each = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    centre = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in "xyz"]
    return labelled_points(spark, sf_dir).groupBy("structure").agg(F.count("*").alias("n"), *centre, *each, F.round(F.max(r), 6).alias("radius"))


EXTENTS = f"{POINTS} SELECT structure, count(*)::BIGINT AS n, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in "xyz") + ", round(max(sqrt(x*x+y*y+z*z)), 6) AS radius FROM pts GROUP BY 1"


def nearest_pair_thickness(spark, sf_dir):
    pts = labelled_points(spark, sf_dir)
    near = op.nearest(pts.where("structure = 0").drop("structure"), pts.where("structure = 1").select("x", "y", "z"), 4.0)
    return near.select("vid", F.round("near", 6).alias("near"))


THICKNESS = f"{POINTS} SELECT a.vid, round(min(sqrt((a.x-b.x)**2 + (a.y-b.y)**2 + (a.z-b.z)**2)), 6) AS near FROM pts a, pts b WHERE a.structure = 0 AND b.structure = 1 GROUP BY a.vid"


def clearance_bands(spark, sf_dir):
    d = F.min(g.norm(g.sub(op.at(), g.vec(0, -60, 60))))
    band = F.when(F.col("clear") < 3, "too close").when(F.col("clear") > 70, "too far").otherwise("in bounds")
    return labelled_points(spark, sf_dir).groupBy("structure").agg(F.round(d, 6).alias("clear")).withColumn("band", band)


CLEARANCE = f"{POINTS}, c AS (SELECT structure, round(min(sqrt(x*x + (y+60)*(y+60) + (z-60)*(z-60))), 6) AS clear FROM pts GROUP BY 1) SELECT *, CASE WHEN clear < 3 THEN 'too close' WHEN clear > 70 THEN 'too far' ELSE 'in bounds' END AS band FROM c"


def halfspace_clip(spark, sf_dir):
    side = g.dot(g.sub(op.at(), g.vec(1, 2, 3)), g.vec(0.6, 0, 0.8))
    return labelled_points(spark, sf_dir).withColumn("kept", side <= 2.5).groupBy("structure", "kept").agg(F.count("*").alias("n"))


CLIP = f"{POINTS} SELECT structure, ((x-1)*0.6::DOUBLE + (y-2)*0::DOUBLE + (z-3)*0.8::DOUBLE) <= 2.5 AS kept, count(*)::BIGINT AS n FROM pts GROUP BY 1, 2"


def stand_off_depth(spark, sf_dir):
    """Distance behind the aim point plus 8 mm, and sector depth in cm over the slab of 12 mm, else over all."""
    pts = labelled_points(spark, sf_dir).select("structure", F.col("y").alias("off"), (-F.col("z")).alias("along"), F.sqrt(F.col("x") ** 2 + F.col("z") ** 2).alias("r"))
    slab = F.max(F.when(F.abs("off") <= 12, F.col("r")))
    return pts.groupBy("structure").agg(F.round(F.greatest(F.max(-F.col("along")), F.lit(0.0)) + 8, 6).alias("stand_off"), F.round(F.coalesce(slab, F.max("r")) * 1.08 / 10, 2).alias("depth_cm"))


STAND_OFF = f"{POINTS} SELECT structure, round(greatest(max(z), 0) + 8, 6) AS stand_off, round(coalesce(max(sqrt(x*x+z*z)) FILTER (abs(y) <= 12), max(sqrt(x*x+z*z))) * 1.08::DOUBLE / 10, 2) AS depth_cm FROM pts GROUP BY 1"


def pose_track(spark, sf_dir):
    """Origin and beam of a tilting probe at each of 61 samples."""
    pose = g.tilted(g.Probe(g.vec(0, 0, 60), g.vec(0, 0, -1), g.vec(1, 0, 0)), g.vec(1, 0, 0), F.col("id") / 60.0 * 40 - 20)
    return spark.range(SAMPLES).select(F.col("id").alias("step"), *[(F.round(c, 6) + 0.0).alias(f"beam_{n}") for c, n in zip(pose.beam, "xyz", strict=True)])


TRACK = "SELECT s::BIGINT AS step, 0.0::DOUBLE AS beam_x, round(sin(radians(s / 60.0::DOUBLE * 40 - 20)), 6) + 0.0 AS beam_y, round(-cos(radians(s / 60.0::DOUBLE * 40 - 20)), 6) + 0.0 AS beam_z FROM range(61) r(s)"


def hash_scatterers(spark, sf_dir):
    i = F.col("id")
    return spark.range(4096).select(i.alias("cell"), F.round(g.hash01(i % 16 - 8, F.floor(i / 16) % 16, F.floor(i / 256), 20260818), 9).alias("u"))




def volume_labels(spark: SparkSession, side: int = 24) -> DataFrame:
    """A box inside a shell: label 2 within 0.4 of the centre by the largest coordinate, 1 within 0.9, else 0."""
    p = F.col("id")
    u = [(c + 0.5) / side * 2 - 1 for c in (p % side, F.floor(p / side) % side, F.floor(p / side / side))]
    r = F.greatest(*map(F.abs, u))
    return spark.range(side**3).select(*[c.alias(n) for c, n in zip((p % side, F.floor(p / side) % side, F.floor(p / side / side)), "ijk", strict=True)], F.when(r <= 0.4, 2).when(r <= 0.9, 1).otherwise(0).alias("label"))


def voxel_centroids(spark, sf_dir):
    return volume_labels(spark).where("label > 0").groupBy("label").agg(F.count("*").alias("n"), *[F.round(F.avg(F.col(c) + 0.5), 6).alias(f"c{c}") for c in "ijk"])


VOLUME = """WITH c AS (SELECT s % 24 AS i, s // 24 % 24 AS j, s // 576 AS k FROM range(13824) r(s)),
v AS (SELECT *, greatest(abs((i+0.5::DOUBLE)/24*2-1), abs((j+0.5::DOUBLE)/24*2-1), abs((k+0.5::DOUBLE)/24*2-1)) AS r FROM c),
vol AS (SELECT i, j, k, CASE WHEN r <= 0.4 THEN 2 WHEN r <= 0.9 THEN 1 ELSE 0 END AS label FROM v)"""
CENTROIDS = f"{VOLUME} SELECT label, count(*)::BIGINT AS n, round(avg(i + 0.5::DOUBLE), 6) AS ci, round(avg(j + 0.5::DOUBLE), 6) AS cj, round(avg(k + 0.5::DOUBLE), 6) AS ck FROM vol WHERE label > 0 GROUP BY 1"


def label_presence_diff(spark, sf_dir):
    """Labels that the volume holds undeclared, or that are declared and unused; 0 is reserved."""
    declared = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("declared")).distinct()
    present = volume_labels(spark).where("label > 0").select("label").distinct()
    both = present.join(declared, F.col("label") == F.col("declared"), "full")
    return both.where("label is null or declared is null").select(F.coalesce("label", "declared").alias("label"), F.when(F.col("declared").isNull(), "undeclared").when(F.col("declared") == 0, "reserved").otherwise("unused").alias("issue"))


PRESENCE = f"{VOLUME}, d AS (SELECT DISTINCT label AS declared FROM embeddings), p AS (SELECT DISTINCT label FROM vol WHERE label > 0) SELECT coalesce(label, declared) AS label, CASE WHEN declared IS NULL THEN 'undeclared' WHEN declared = 0 THEN 'reserved' ELSE 'unused' END AS issue FROM p FULL JOIN d ON label = declared WHERE label IS NULL OR declared IS NULL"


def tgc_compress_curve(spark, sf_dir):
    """Grey levels of line discounts read as envelopes, at a depth given by the line number."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_discount", "l_linenumber").groupBy("l_discount", "l_linenumber").agg(F.count("*").alias("n"))
    level = g.compressed(F.col("l_discount") * g.time_gain(8.0, F.col("l_linenumber").cast("double"), 7.0))
    return lines.withColumn("grey", F.round(level, 6))


TGC = "WITH e AS (SELECT l_discount, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2), x AS (SELECT *, l_discount * pow(10.0::DOUBLE, 8 * least(l_linenumber / 7.0::DOUBLE, 1) / 20) AS v FROM e) SELECT l_discount, l_linenumber, n, round(CASE WHEN v <= 0.0008 THEN 0 ELSE pow(least(greatest(20 * log10(greatest(v, 1e-30)) / 60.0::DOUBLE + 1, 0), 1), 1.25::DOUBLE) END, 6) AS grey FROM x"

QUERIES = {f.__name__: f for f in (sweep_first_seen, sector_membership, structure_extents, nearest_pair_thickness, clearance_bands, halfspace_clip, stand_off_depth, pose_track, hash_scatterers, voxel_centroids, label_presence_diff, tgc_compress_curve)}
ORACLES = {
    "sweep_first_seen": SWEEP, "sector_membership": SECTOR, "structure_extents": EXTENTS, "nearest_pair_thickness": THICKNESS, "clearance_bands": CLEARANCE, "halfspace_clip": CLIP,
    "stand_off_depth": STAND_OFF, "pose_track": TRACK, "voxel_centroids": CENTROIDS, "label_presence_diff": PRESENCE, "tgc_compress_curve": TGC,
}
