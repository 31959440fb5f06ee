"""Data-quality gates and measurement queries over the star schema, events and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import graph, ordered


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fk_orders_customer(spark, sf_dir):
    """Orders whose customer is not among those in credit."""
    known = _t(spark, sf_dir, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    missing = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(known, "o_custkey", "left_anti")
    return missing.select("o_orderkey", "o_custkey")


def duplicate_ids(spark, sf_dir):
    """Rows that repeat the key of an earlier one."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return ordered.later_rows(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"]).drop("l_extendedprice")


def hierarchy_cycles(spark, sf_dir):
    """Nodes whose walk to the root never ends, in a parent table of nations; bounded by the node count."""
    parent = F.when(F.col("n_nationkey") % 5 != 0, (F.col("n_nationkey") * 7 + 3) % 25)
    nodes = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), parent.alias("parent"), F.lit(None).cast("string").alias("name"))
    return graph.climbed(nodes).where("endless").select("node")


CYCLES = """WITH RECURSIVE e AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey % 5 <> 0 THEN (n_nationkey * 7 + 3) % 25 END AS parent FROM nation),
w(node, parent, d) AS (SELECT node, parent, 1 FROM e UNION ALL SELECT w.node, e.parent, d + 1 FROM w JOIN e ON e.node = w.parent WHERE d < 40) SELECT DISTINCT node FROM w WHERE d = 40 AND parent IS NOT NULL"""


def json_strict_keys(spark, sf_dir):
    keys = F.json_object_keys("props")
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.size(F.array_except(keys, F.array(F.lit("k")))) > 0).alias("n_unknown"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("max_k"))


STRICT = "SELECT event_type, count(*)::BIGINT AS n, count(*) FILTER (len(list_filter(json_keys(props), lambda k: k <> 'k')) > 0)::BIGINT AS n_unknown, max(json_extract_string(props, '$.k')::BIGINT) AS max_k FROM events GROUP BY 1"


def url_problems(spark, sf_dir):
    url = F.col("url")
    # every tenth address loses its scheme, so that there is something to find
    url = F.when(F.col("page_id") % 10 == 0, F.regexp_replace(url, "^https?:", "ftp:")).otherwise(url)
    issue = F.when(~text.is_http(url), "not http")
    return _t(spark, sf_dir, "pages").select("page_id", issue.alias("issue"))


URLS = r"SELECT page_id, CASE WHEN page_id % 10 = 0 OR NOT (lower(url) LIKE 'http://_%' OR lower(url) LIKE 'https://_%') THEN 'not http' END AS issue FROM pages"


def slugify_names(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", text.slug(F.substring("text", 1, 60)).alias("slug"))


SLUGS = r"SELECT doc_id, coalesce(nullif(lower(trim(regexp_replace(substr(text, 1, 60), '[^\p{L}\p{N}]+', '-', 'g'), '-')), ''), 'structure') AS slug FROM documents"


def placeholder_text(spark, sf_dir):
    """Notes on parts, made of their names, that are still to be written."""
    notes = _t(spark, sf_dir, "part").select("p_partkey", F.element_at(F.array(*[F.concat(F.lit(a), "p_name", F.lit(b)) for a, b in NOTES]), (F.col("p_partkey") % len(NOTES) + 1).cast("int")).alias("note"))
    return notes.where(text.is_placeholder(F.col("note"))).select("p_partkey", "note")


#: Ways to write a note; about half of them are placeholders.
NOTES = (("", ""), ("TBD - ", ""), (" todo\n", ""), ("Nashville ", ""), ("n/a; ", ""), ("na ", ""), ("None of ", ""), ("???", ""), ("??? ", ""), ("xxx_", " "), ("unknowns of ", ""), ("Placeholder.", ""), ("the TBD ", ""))
_OPENS = " OR ".join(f"(starts_with(t, '{token}') AND (t = '{token}' OR contains(' :;,._-' || chr(9) || chr(10) || chr(13), substr(t, {len(token) + 1}, 1))))" for token in text.PLACEHOLDERS)
_FORMS = ", ".join("'" + a + "' || p_name || '" + b + "'" for a, b in NOTES)
PLACEHOLDER = f"WITH n AS (SELECT p_partkey, [{_FORMS}][p_partkey % {len(NOTES)} + 1] AS note FROM part), l AS (SELECT *, lower(trim(note, ' ' || chr(9) || chr(10) || chr(13))) AS t FROM n) SELECT p_partkey, note FROM l WHERE {_OPENS}"


def calendar_dates(spark, sf_dir):
    shown = F.concat_ws("-", F.lpad((1990 + F.col("id") % 40).cast("string"), 4, "0"), F.lpad((F.col("id") % 14).cast("string"), 2, "0"), F.lpad((F.col("id") % 33).cast("string"), 2, "0"))
    return spark.range(2000).select("id", shown.alias("shown")).withColumn("valid", text.is_date(F.col("shown")))


DATES = "WITH d AS (SELECT s::BIGINT AS id, printf('%04d-%02d-%02d', 1990 + s % 40, s % 14, s % 33) AS shown FROM range(2000) r(s)) SELECT id, shown, try_cast(shown AS DATE) IS NOT NULL AS valid FROM d"


def event_runs(spark, sf_dir):
    """The longest run of one event type of each user, in time order."""
    found = ordered.runs(_t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return found.groupBy("user_id").agg(F.count("*").alias("n_runs"), F.max("length").alias("longest"))


RUNS = """WITH m AS (SELECT user_id, ts, event_id, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w THEN 0 ELSE 1 END AS turn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m), l AS (SELECT user_id, run, count(*)::BIGINT AS length FROM r GROUP BY 1, 2)
SELECT user_id, count(*)::BIGINT AS n_runs, max(length) AS longest FROM l GROUP BY 1"""


def odd_pairing(spark, sf_dir):
    pairs = ordered.paired(_t(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value")
    return pairs.groupBy("user_id").agg(F.count("*").alias("n_pairs"), F.round(F.sum(F.col("leave") - F.col("enter")), 4).alias("chord"))


PAIRS = """WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, (count(*) // 2)::BIGINT AS n_pairs, round(sum(CASE WHEN n % 2 = 1 THEN value ELSE -value END), 4) AS chord FROM p WHERE c % 2 = 0 GROUP BY 1"""


def first_type_order(spark, sf_dir):
    first = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))
    return first.withColumn("ord", F.row_number().over(Window.orderBy("first_id")).cast("long"))


def stride_sample(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return ordered.stride(lines, keys, 6000).select("l_orderkey", "l_linenumber", "n")


STRIDE = """WITH n AS (SELECT l_orderkey, l_linenumber, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1)::BIGINT AS n FROM lineitem)
SELECT * FROM n WHERE n % greatest(1, (SELECT count(*) FROM lineitem) // 6000) = 0"""


def quantile_floor(spark, sf_dir):
    return ordered.floor_quantiles(_t(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), "l_returnflag", "l_quantity", median=0.5, p95=0.95)


FLOORS = "WITH s AS (SELECT l_returnflag, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY 1) SELECT l_returnflag, v[least(len(v) - 1, floor(len(v) * 0.5))::BIGINT + 1] AS median, v[least(len(v) - 1, floor(len(v) * 0.95))::BIGINT + 1] AS p95 FROM s"


def summary_stats(spark, sf_dir):
    v = F.col("l_discount")
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.round(F.avg((v < 0.05).cast("int")), 6).alias("below"), F.round(F.percentile(v, 0.25), 6).alias("q1"))


STATS = "SELECT l_returnflag, count(*)::BIGINT AS n, min(l_discount) AS lo, max(l_discount) AS hi, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS std, round(avg((l_discount < 0.05)::INT), 6) AS below, round(quantile_cont(l_discount, 0.25), 6) AS q1 FROM lineitem GROUP BY 1"


def budget_share(spark, sf_dir):
    """Each supplier's share of a budget of 220000 by its rows, at least 800, and its number by falling rows."""
    n = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).withColumn("less", -F.col("n"))
    placed = ordered.numbered(n, ["less", "l_suppkey"], 64)
    total = placed.agg(F.sum(-F.col("less")).alias("total"))
    share = F.greatest(F.lit(800), F.floor(-220000 * F.col("less") / F.col("total")))
    return placed.join(F.broadcast(total)).select("l_suppkey", (-F.col("less")).alias("n"), share.alias("share"), (F.col("n") + 1).alias("number"))


BUDGET = "WITH c AS (SELECT l_suppkey, count(*)::BIGINT AS n FROM lineitem GROUP BY 1) SELECT l_suppkey, n, greatest(800, floor(220000 * n / sum(n) OVER ()))::BIGINT AS share, row_number() OVER (ORDER BY n DESC, l_suppkey)::BIGINT AS number FROM c"


def group_means_min50(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).where("n >= 50")


def allowlist_reconcile(spark, sf_dir):
    allowed = _t(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("allowed"))
    shipped = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("shipped")).distinct()
    both = shipped.join(allowed, F.col("shipped") == F.col("allowed"), "full")
    return both.where("shipped is null or allowed is null").select(F.coalesce("shipped", "allowed").alias("suppkey"), F.when(F.col("allowed").isNull(), "not allowed").otherwise("not shipped").alias("issue"))


RECONCILE = "WITH a AS (SELECT s_suppkey AS allowed FROM supplier WHERE s_suppkey % 10 <> 0), s AS (SELECT DISTINCT l_suppkey AS shipped FROM lineitem) SELECT coalesce(shipped, allowed) AS suppkey, CASE WHEN allowed IS NULL THEN 'not allowed' ELSE 'not shipped' END AS issue FROM s FULL JOIN a ON shipped = allowed WHERE shipped IS NULL OR allowed IS NULL"


def show_hide_overlap(spark, sf_dir):
    shown = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return shown.intersect(_t(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id")))


def provenance_gate(spark, sf_dir):
    """Conversations that open with a placeholder, lack a role or have an empty turn."""
    t = _t(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("conv_id") % 7 == 0, F.concat(F.lit("TODO: "), "text")).when(F.col("conv_id") % 11 == 0, F.lit("  ")).otherwise(F.col("text")))
    t = t.withColumn("role", F.when(F.col("conv_id") % 5 == 0, F.lit("")).otherwise(F.col("role")))
    issue = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").when(F.coalesce(F.trim("role"), F.lit("")) == "", "no role").when(text.is_placeholder(F.col("text")), "placeholder")
    return t.withColumn("issue", issue).where("issue is not null").groupBy("issue").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_convs"))


PROVENANCE = f"""WITH c AS (SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'TODO: ' || text WHEN conv_id % 11 = 0 THEN '  ' ELSE text END AS text, CASE WHEN conv_id % 5 = 0 THEN '' ELSE role END AS role FROM conversations),
l AS (SELECT *, lower(trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13))) AS t FROM c),
i AS (SELECT conv_id, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN coalesce(trim(role), '') = '' THEN 'no role' WHEN {_OPENS} THEN 'placeholder' END AS issue FROM l)
SELECT issue, count(*)::BIGINT AS n, count(DISTINCT conv_id)::BIGINT AS n_convs FROM i WHERE issue IS NOT NULL GROUP BY 1"""

QUERIES = {
    f.__name__: f
    for f in (
        fk_orders_customer, duplicate_ids, hierarchy_cycles, json_strict_keys, url_problems, slugify_names, placeholder_text, calendar_dates, event_runs, odd_pairing, first_type_order,
        stride_sample, quantile_floor, summary_stats, budget_share, group_means_min50, allowlist_reconcile, show_hide_overlap, provenance_gate,
    )
}
ORACLES = {
    "fk_orders_customer": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)",
    "duplicate_ids": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) > 1",
    "hierarchy_cycles": CYCLES, "json_strict_keys": STRICT, "url_problems": URLS, "slugify_names": SLUGS, "placeholder_text": PLACEHOLDER, "calendar_dates": DATES, "event_runs": RUNS, "odd_pairing": PAIRS,
    "first_type_order": "WITH f AS (SELECT event_type, min(event_id) AS first_id, count(*)::BIGINT AS n FROM events GROUP BY 1) SELECT *, row_number() OVER (ORDER BY first_id)::BIGINT AS ord FROM f",
    "stride_sample": STRIDE, "quantile_floor": FLOORS, "summary_stats": STATS, "budget_share": BUDGET,
    "group_means_min50": "SELECT user_id, count(*)::BIGINT AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1 HAVING count(*) >= 50",
    "allowlist_reconcile": RECONCILE,
    "show_hide_overlap": "SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'",
    "provenance_gate": PROVENANCE,
}
