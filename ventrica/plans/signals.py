"""Queries over sampled signals: label tables, stencils, fans, runs and settings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text
from ..operators import ordered, signal

LINES, SAMPLES = 24, 32


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_lut(spark, sf_dir):
    """Acoustic values of all 256 labels; undeclared ones are blood."""
    declared = spark.createDataFrame([(1, 0.55, 0.45), (7, 0.9, 0.8)], "label long, echogenicity double, attenuation double")
    return signal.lookup_table(spark, declared)


LUT = """WITH d(label, e, a) AS (VALUES (1, 0.55::DOUBLE, 0.45::DOUBLE), (7, 0.9::DOUBLE, 0.8::DOUBLE))
SELECT s::BIGINT AS label, coalesce(e, 0.02::DOUBLE) AS echogenicity, coalesce(a, 0.02::DOUBLE) AS attenuation, greatest(1::DOUBLE, (SELECT max(a) FROM d)) AS scale FROM range(256) r(s) LEFT JOIN d ON label = s"""


def _polar(spark):
    line, sample = F.col("id") % LINES, F.floor(F.col("id") / LINES)
    return spark.range(LINES * SAMPLES).select(line.alias("line"), sample.alias("sample"), F.sin(line * 12.9898 + sample * 78.233).alias("rf"))


def psf_lateral(spark, sf_dir):
    out = signal.lateral_blur(_polar(spark), LINES, SAMPLES, sigma=1.2, defocus=0.014, focus=0.55, radius=4)
    return out.select("line", "sample", (F.round("rf", 6) + 0.0).alias("rf"))


def psf_envelope(spark, sf_dir):
    out = signal.axial_envelope(_polar(spark), SAMPLES, sigma=0.9, radius=3)
    return out.select("line", "sample", F.round("envelope", 6).alias("envelope"))


POLAR = "WITH p AS (SELECT s % 24 AS line, s // 24 AS sample, sin((s % 24) * 12.9898::DOUBLE + (s // 24) * 78.233::DOUBLE) AS rf FROM range(768) r(s))"
LATERAL = f"""{POLAR}, w AS (SELECT c.line, c.sample, n.rf, exp(-0.5 * o * o / pow(greatest(1.2::DOUBLE * (1 + 0.014 * abs((c.sample + 0.5::DOUBLE) / 32 - 0.55) * 100), 0.35), 2)) AS w
 FROM p c, range(-4, 5) t(o), p n WHERE n.sample = c.sample AND n.line = least(greatest(c.line + o, 0), 23))
SELECT line::BIGINT AS line, sample::BIGINT AS sample, round(sum(rf * w) / sqrt(sum(w * w)), 6) + 0.0 AS rf FROM w GROUP BY 1, 2"""
ENVELOPE = f"""{POLAR}, w AS (SELECT c.line, c.sample, n.rf, exp(-0.5 * o * o / (0.9::DOUBLE * 0.9::DOUBLE)) AS w FROM p c, range(-3, 4) t(o), p n WHERE n.line = c.line AND n.sample = least(greatest(c.sample + o, 0), 31))
SELECT line::BIGINT AS line, sample::BIGINT AS sample, round(sqrt(sum(rf * rf * w) / sum(w)), 6) AS envelope FROM w GROUP BY 1, 2"""


def wedge_points(spark, sf_dir):
    """The arc of a fan of 48 triangles: its half angle of 35 degrees, 120 mm deep."""
    angle = F.radians(F.col("id") / 48.0 * 70 - 35)
    beam, lateral = g.vec(0, 0, -1), g.vec(1, 0, 0)
    at = [b * F.cos(angle) * 120 + a * F.sin(angle) * 120 + o for b, a, o in zip(beam, lateral, g.vec(0, 0, 60), strict=True)]
    return spark.range(49).select(F.col("id").alias("step"), *[(F.round(c, 6) + 0.0).alias(n) for n, c in zip("xyz", at, strict=True)])


WEDGE = "SELECT s::BIGINT AS step, round(sin(radians(s / 48.0::DOUBLE * 70 - 35)) * 120, 6) + 0.0 AS x, 0.0::DOUBLE AS y, round(60 - cos(radians(s / 48.0::DOUBLE * 70 - 35)) * 120, 6) + 0.0 AS z FROM range(49) r(s)"


def weld_points(spark, sf_dir):
    """Points that agree to one unit in all axes, as one vertex under the smallest id."""
    e = [F.floor(F.col("embedding")[k].cast("double") * 100).alias(n) for k, n in enumerate("xyz")]
    return _t(spark, sf_dir, "embeddings").select("vec_id", *e).groupBy(*"xyz").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))


WELD = "SELECT floor(embedding[1]::DOUBLE * 100)::BIGINT AS x, floor(embedding[2]::DOUBLE * 100)::BIGINT AS y, floor(embedding[3]::DOUBLE * 100)::BIGINT AS z, count(*)::BIGINT AS n, min(vec_id) AS first_id FROM embeddings GROUP BY 1, 2, 3"


def longest_run(spark, sf_dir):
    """Of each user the first of the longest stretches of one event type."""
    found = ordered.runs(_t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    best = F.max(F.struct("length", (-F.col("run")).alias("early"), "event_type"))
    return found.groupBy("user_id").agg(best.alias("b")).select("user_id", F.col("b.event_type").alias("event_type"), F.col("b.length").alias("length"))


LONGEST = """WITH m AS (SELECT user_id, ts, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, event_type, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m), l AS (SELECT user_id, event_type, run, count(*)::BIGINT AS length FROM r GROUP BY 1, 2, 3)
SELECT user_id, event_type, length FROM l QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY length DESC, run) = 1"""


def rim_core(spark, sf_dir):
    """Mean of the first two and last two values of each user, and of those between; overlapping ends count twice."""
    rows = _t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return signal.rim_and_core(rows, "user_id", ["ts", "event_id"], "value", 2).select("user_id", F.round("rim", 6).alias("rim"), F.round("core", 6).alias("core"))


RIM = """WITH n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS down FROM events),
w AS (SELECT *, (up <= 2)::INT + (down <= 2)::INT AS ends FROM n)
SELECT user_id, round(sum(value * ends) / sum(ends), 6) AS rim, round(avg(value) FILTER (ends = 0), 6) AS core FROM w GROUP BY 1"""


def fk_lineitem_orders(spark, sf_dir):
    """Lines whose order is not among the closed and open ones."""
    orders = _t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(orders, "l_orderkey", "left_anti")


def tuning_override(spark, sf_dir):
    """The setting k of each event where it is a JSON number, else 4; how many events have each value."""
    k = F.get_json_object("props", "$.k")
    number = F.when(F.schema_of_variant(F.try_parse_json("props")).rlike(r"\bk: (?:BIGINT|DOUBLE|DECIMAL)"), k.cast("double"))
    return _t(spark, sf_dir, "events").groupBy(F.coalesce(number, F.lit(4.0)).alias("setting")).agg(F.count("*").alias("n"))


TUNING = "SELECT CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract_string(props, '$.k')::DOUBLE ELSE 4 END::DOUBLE AS setting, count(*)::BIGINT AS n FROM events GROUP BY 1"


def path_problems(spark, sf_dir):
    """Why a path can't be one in a pack: parts of pages' addresses after the host, and PATHS made of page numbers."""
    made = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("page_id") % len(PATHS) + 1).cast("int"))
    pages = _t(spark, sf_dir, "pages").select("page_id", F.explode(F.array(made, F.regexp_replace("url", r"^https?://[^/]*/?", ""))).alias("path"))
    return pages.select("page_id", "path", text.path_problem(F.col("path")).alias("problem"))


#: Paths that are accepted or refused, one after another for the pages.
PATHS = (
    "assets/stub.gltf", "..\\outside.gltf", "%2e%2e/outside.gltf", "a/%2E%2E/outside.gltf", "../outside.gltf", "./assets/stub.gltf", "/assets/stub.gltf", "https://elsewhere.invalid/a.gltf", "C:/assets/stub.gltf",
    "assets/stub.gltf?v=2", "assets/stub.gltf#frag", "assets//stub.gltf", "", "a/b/c/stub-volume.raw", "assets/with%20space.gltf", "a%5Cb", "a%3Fb", "%zz", "half%2", "a+b",
)
_LIST = ", ".join("'" + p + "'" for p in PATHS)
PATH = rf"""WITH p AS (SELECT page_id, unnest([[{_LIST}][page_id % {len(PATHS)} + 1], regexp_replace(url, '^https?://[^/]*/?', '')]) AS path FROM pages),
d AS (SELECT *, url_decode(replace(path, '+', '%2B')) AS plain, regexp_matches(path, '%([^0-9a-fA-F]|[0-9a-fA-F][^0-9a-fA-F]|[0-9a-fA-F]?$)') AS bad FROM p)
SELECT page_id, path, CASE WHEN path = '' THEN 'empty' WHEN contains(path, '\') THEN 'backslash' WHEN contains(path, '?') OR contains(path, '#') THEN 'query or fragment' WHEN bad THEN 'bad escape'
 WHEN contains(plain, '\') THEN 'encoded backslash' WHEN regexp_matches(plain, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'scheme' WHEN starts_with(plain, '/') THEN 'absolute'
 WHEN list_contains(string_split(plain, '/'), '') THEN 'empty segment' WHEN list_contains(string_split(plain, '/'), '.') OR list_contains(string_split(plain, '/'), '..') THEN 'leaves the pack' END AS problem FROM d""".replace("'\\\\'", "'\\'")


def quantile_linear(spark, sf_dir):
    at = F.percentile(F.col("l_quantity").cast("double"), F.array(F.lit(0.01), F.lit(0.5), F.lit(0.95)))
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(at.alias("q")).select("l_returnflag", *[F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("p01", "p50", "p95"))])


QUANTILES = "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_quantity::DOUBLE, {q}), 6) AS {n}" for n, q in (("p01", 0.01), ("p50", 0.5), ("p95", 0.95))) + " FROM lineitem GROUP BY 1"


def label_numbering(spark, sf_dir):
    """Suppliers of each return flag numbered by falling rows."""
    n = _t(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    return n.withColumn("number", F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc("n"), "l_suppkey")).cast("long"))


NUMBERS = "WITH c AS (SELECT l_returnflag, l_suppkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_suppkey)::BIGINT AS number FROM c"

QUERIES = {f.__name__: f for f in (label_lut, psf_lateral, psf_envelope, wedge_points, weld_points, longest_run, rim_core, fk_lineitem_orders, tuning_override, path_problems, quantile_linear, label_numbering)}
ORACLES = {
    "label_lut": LUT, "psf_lateral": LATERAL, "psf_envelope": ENVELOPE, "wedge_points": WEDGE, "weld_points": WELD, "longest_run": LONGEST, "rim_core": RIM,
    "fk_lineitem_orders": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
    "tuning_override": TUNING, "path_problems": PATH, "quantile_linear": QUANTILES, "label_numbering": NUMBERS,
}
