"""Queries over forests and surfaces as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph
from .surfaces import FACETS, facets

#: Names that a scene wraps around its content and that say nothing of it.
WRAPPERS = ("ASIA", "EUROPE")
WELD = 10.0


def scene_nodes(spark, sf_dir) -> DataFrame:
    """Regions, nations, customers and suppliers as one scene: node, parent, name (some are empty)."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    key = lambda c, times, plus: (F.col(c).cast("long") * times + plus)
    region = t("region").select(key("r_regionkey", 1, 0).alias("node"), F.lit(None).cast("long").alias("parent"), F.when(F.col("r_regionkey") != 4, F.col("r_name")).otherwise("").alias("name"))
    nation = t("nation").select(key("n_nationkey", 1, 100).alias("node"), key("n_regionkey", 1, 0).alias("parent"), F.when(F.col("n_nationkey") % 7 != 0, F.col("n_name")).otherwise("").alias("name"))
    under = lambda n, k, c, plus: t(n).select(key(k, 2, plus).alias("node"), key(c, 1, 100).alias("parent"), F.when(F.col(k) % 3 != 0, F.concat(F.lit(f"{n} "), F.col(k).cast("string"))).otherwise("").alias("name"))
    return region.unionByName(nation).unionByName(under("customer", "c_custkey", "c_nationkey", 1000)).unionByName(under("supplier", "s_suppkey", "s_nationkey", 1001))


def node_groups(spark, sf_dir):
    """The group of each node: its top-most named ancestor that is no wrapper, else its own name, else its number."""
    nodes = scene_nodes(spark, sf_dir)
    telling = nodes.withColumn("own", F.nullif("name", F.lit(""))).withColumn("name", F.when(~F.col("own").isin(*WRAPPERS), F.col("own")))
    found = graph.climbed(telling).select("node", "top").join(telling.select("node", "own"), "node")
    return found.select("node", F.coalesce("top", "own", F.concat(F.lit("node"), F.col("node").cast("string"))).alias("group_name"))


SCENE = """WITH RECURSIVE n AS (SELECT r_regionkey::BIGINT AS node, NULL::BIGINT AS parent, CASE WHEN r_regionkey <> 4 THEN r_name ELSE '' END AS name FROM region
 UNION ALL SELECT n_nationkey::BIGINT + 100, n_regionkey::BIGINT, CASE WHEN n_nationkey % 7 <> 0 THEN n_name ELSE '' END FROM nation
 UNION ALL SELECT c_custkey::BIGINT * 2 + 1000, c_nationkey::BIGINT + 100, CASE WHEN c_custkey % 3 <> 0 THEN 'customer ' || c_custkey ELSE '' END FROM customer
 UNION ALL SELECT s_suppkey::BIGINT * 2 + 1001, s_nationkey::BIGINT + 100, CASE WHEN s_suppkey % 3 <> 0 THEN 'supplier ' || s_suppkey ELSE '' END FROM supplier),
w(node, up, d, name) AS (SELECT node, parent, 0, name FROM n UNION ALL SELECT w.node, n.parent, d + 1, n.name FROM w JOIN n ON n.node = w.up),
g AS (SELECT node, arg_max(name, d) FILTER (name <> '' AND name NOT IN ('ASIA', 'EUROPE')) AS top, max(name) FILTER (d = 0) AS own FROM w GROUP BY 1),
grp AS (SELECT node, coalesce(top, nullif(own, ''), 'node' || node) AS group_name FROM g)"""


def structure_split(spark, sf_dir):
    """Structures of the scene by group: slug, whether the name tells of blood, how it sounds by default, and the number and mean of its nodes."""
    groups = node_groups(spark, sf_dir)
    name = F.col("group_name")
    pool = F.lower(name).contains("blood") | F.lower(name).contains("pool") | F.lower(name).contains("land")
    made = groups.groupBy("group_name").agg(F.count("*").alias("n_nodes"), F.round(F.avg("node"), 6).alias("centre"))
    sounds = {"echogenicity": F.when(F.col("blood_pool"), 0.05).otherwise(0.6), "attenuation": F.when(F.col("blood_pool"), 0.05).otherwise(0.5)}
    return made.withColumn("blood_pool", pool).select("group_name", text.slug(name).alias("slug"), "n_nodes", "centre", "blood_pool", *[c.alias(n) for n, c in sounds.items()])


SPLIT = f"""{SCENE}, m AS (SELECT group_name, count(*)::BIGINT AS n_nodes, round(avg(node), 6) AS centre, (contains(lower(group_name), 'blood') OR contains(lower(group_name), 'pool') OR contains(lower(group_name), 'land')) AS blood_pool FROM grp GROUP BY 1)
SELECT group_name, regexp_replace(regexp_replace(lower(group_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, n_nodes, centre, blood_pool, CASE WHEN blood_pool THEN 0.05::DOUBLE ELSE 0.6::DOUBLE END AS echogenicity, CASE WHEN blood_pool THEN 0.05::DOUBLE ELSE 0.5::DOUBLE END AS attenuation FROM m"""


def welded_facets(spark, sf_dir) -> DataFrame:
    """facet, structure, p, q, r: facets whose corners are welded to a lattice; those with two equal corners are gone."""
    at = lambda c: F.struct(*[F.floor(F.col(f"{c}.{x}") / WELD).cast("long").alias(x) for x in "xyz"])
    f = facets(spark, sf_dir).select((F.col("vec_id") * 7 + F.col("t")).alias("facet"), "structure", at("a").alias("p"), at("b").alias("q"), at("c").alias("r"))
    return f.where("p <> q and q <> r and p <> r")


def surface_components(spark, sf_dir):
    """Parts of each welded surface that hang together by shared edges."""
    f = welded_facets(spark, sf_dir)
    ends = F.explode(F.array(*[F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in (("p", "q"), ("q", "r"), ("p", "r"))]))
    edges = f.select("facet", "structure", ends.alias("e"))
    # all facets of an edge link to its first one, so an edge of many facets is no square of links
    first = edges.groupBy("structure", "e").agg(F.min("facet").alias("v"))
    links = edges.join(first, ["structure", "e"]).select(F.col("facet").alias("u"), "v")
    sizes = graph.components(links).withColumnRenamed("node", "facet").join(f.select("facet", "structure"), "facet").groupBy("structure", "component").agg(F.count("*").alias("n"))
    return sizes.groupBy("structure").agg(F.sum("n").alias("n_facets"), F.count("*").alias("n_components"), F.max("n").alias("largest"), F.max("component").alias("last_component"))


WELDED = f"""{FACETS.replace("WITH f", "WITH RECURSIVE f")}, wf AS (SELECT vec_id*7+t AS facet, structure, {", ".join(f"[floor({c}1/10)::BIGINT, floor({c}2/10)::BIGINT, floor({c}3/10)::BIGINT] AS {n}" for c, n in zip("abc", "pqr"))} FROM f),
w AS (SELECT * FROM wf WHERE p <> q AND q <> r AND p <> r)"""
COMPONENTS = f"""{WELDED}, ed AS (SELECT facet, structure, unnest([[least(p,q), greatest(p,q)], [least(q,r), greatest(q,r)], [least(p,r), greatest(p,r)]]) AS e FROM w),
li AS (SELECT DISTINCT a.facet AS u, b.facet AS v FROM ed a JOIN ed b ON a.structure = b.structure AND a.e = b.e),
reach(node, c) AS (SELECT facet, facet FROM w UNION SELECT li.v, reach.c FROM reach JOIN li ON li.u = reach.node WHERE reach.c < li.v),
co AS (SELECT node, min(c) AS component FROM reach GROUP BY 1), sz AS (SELECT structure, component, count(*)::BIGINT AS n FROM co JOIN w ON w.facet = node GROUP BY 1, 2)
SELECT structure, sum(n)::BIGINT AS n_facets, count(*)::BIGINT AS n_components, max(n) AS largest, max(component) AS last_component FROM sz GROUP BY 1"""

QUERIES = {f.__name__: f for f in (node_groups, structure_split, surface_components)}
ORACLES = {"node_groups": f"{SCENE} SELECT node, group_name FROM grp", "structure_split": SPLIT, "surface_components": COMPONENTS}
