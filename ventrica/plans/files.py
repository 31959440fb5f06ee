"""Queries over packs as files: written and read back, a ledger of digests, and checks across files; all made from part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assets, ledger
from ..sources import packs as source
from ..streaming import first_seen
from .packs import _IF, _K, BODY, _text, documents

#: The scene of a part: its nodes, some under other names, and what its buffers and images refer to.
SCENE = _text(
    '<open>"asset":{"version":"2.0"},"nodes":[{"name":"node 0"},{"mesh":0},{"name":"<two>"},{"name":"node 1"}],"buffers":[{"uri":"<buffer>"},{"byteLength":4},{"uri":"data:application/octet-stream;base64,AAAA"}],"images":[{"uri":"<image>"}]}',
    open=_IF(_K(9, 4), "", "{"), two=_IF(_K(5, 2), "hub", "node 2"), buffer=_IF(_K(7, 3), "../part.bin", "part.bin"), image=_IF(_K(8, 1), "other.png", "part.png"),
)


def _listing(spark, sf_dir) -> DataFrame:
    """The files of each part: its scene, buffer, image and volume, but for some that are lost."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey")
    lost = {"scenes/part.gltf": F.expr(_K(10, 6)), "scenes/part.bin": F.expr(_K(11, 5)), "scenes/part.png": F.lit(False)}
    paths = F.array(*[F.when(~gone, p) for p, gone in lost.items()], F.when(F.expr("p_partkey % 12 <> 0"), F.concat(F.lit("volumes/v-"), F.col("p_partkey").cast("string"), F.lit(".raw"))))
    return parts.select(F.col("p_partkey").alias("key"), F.explode(F.array_compact(paths)).alias("path"))


def pack_assets(spark, sf_dir):
    """What is wrong between each pack, its files and its scene."""
    scenes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("key"), F.expr(SCENE).alias("content"))
    # every 13th pack has a binary scene
    body = F.when(F.expr(_K(13, 7)), F.regexp_replace("body", "scenes/part.gltf", "scenes/part.glb")).otherwise(F.col("body"))
    return assets.asset_issues(documents(spark, sf_dir).select(F.col("p_partkey").alias("key"), body.alias("body")), _listing(spark, sf_dir), scenes).withColumnRenamed("key", "p_partkey")


_GLTF = "json_extract_string(j, '$.meshes.gltf')"
ASSETS = f"""WITH d AS (SELECT p_partkey, CASE WHEN {_K(13, 7)} THEN replace({BODY}, 'scenes/part.gltf', 'scenes/part.glb') ELSE {BODY} END AS body, {SCENE} AS scene FROM part),
p AS (SELECT p_partkey, body::JSON AS j, scene FROM d WHERE json_valid(body)),
files AS (SELECT p_partkey, 'scenes/part.gltf' AS path FROM part WHERE NOT {_K(10, 6)} UNION ALL SELECT p_partkey, 'scenes/part.bin' FROM part WHERE NOT {_K(11, 5)} UNION ALL SELECT p_partkey, 'scenes/part.png' FROM part UNION ALL SELECT p_partkey, 'volumes/v-' || p_partkey || '.raw' FROM part WHERE p_partkey % 12 <> 0),
names AS (SELECT p_partkey, {_GLTF} AS gltf, json_extract_string(j, '$.echo_volume.asset') AS asset FROM p),
ref AS (SELECT p_partkey, 'meshes.gltf' AS place, gltf AS path FROM names UNION ALL SELECT p_partkey, 'echo_volume.asset', asset FROM names WHERE asset IS NOT NULL),
sc AS (SELECT p.* FROM p JOIN files f ON f.p_partkey = p.p_partkey AND f.path = {_GLTF} WHERE {_GLTF} LIKE '%.gltf'),
ok AS (SELECT p_partkey, j, scene::JSON AS s FROM sc WHERE json_valid(scene)),
nn AS (SELECT p_partkey, j, list_sort(list_filter([json_extract_string(s, '$.nodes[0].name'), json_extract_string(s, '$.nodes[1].name'), json_extract_string(s, '$.nodes[2].name'), json_extract_string(s, '$.nodes[3].name')], lambda n: n IS NOT NULL)) AS names FROM ok),
st AS (SELECT p_partkey, names, i, json_extract_string(j, '$.meshes.structures[' || i || '].mesh_node') AS node FROM (SELECT *, unnest(range(json_array_length(j, '$.meshes.structures')::BIGINT)) AS i FROM nn)),
uri AS (SELECT p_partkey, 'buffers.0' AS place, json_extract_string(s, '$.buffers[0].uri') AS uri FROM ok UNION ALL SELECT p_partkey, 'images.0', json_extract_string(s, '$.images[0].uri') FROM ok)
SELECT p_partkey, place, 'does not exist: ' || path AS issue, 'failure' AS severity FROM ref WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.p_partkey = ref.p_partkey AND f.path = ref.path)
UNION ALL SELECT p_partkey, 'meshes.gltf', 'only .gltf is inspected', 'skipped' FROM names WHERE gltf NOT LIKE '%.gltf' UNION ALL SELECT p_partkey, 'meshes.gltf', 'not JSON', 'failure' FROM sc WHERE NOT json_valid(scene)
UNION ALL SELECT p_partkey, 'meshes.structures.' || i, 'no node ' || node || '; there are ' || array_to_string(names, ', '), 'failure' FROM st WHERE NOT list_contains(names, node)
UNION ALL SELECT p_partkey, place, 'bad path: ' || uri, 'failure' FROM uri WHERE uri LIKE '../%'
UNION ALL SELECT p_partkey, place, 'does not exist: ' || uri, 'failure' FROM uri WHERE uri NOT LIKE '../%' AND NOT EXISTS (SELECT 1 FROM files f WHERE f.p_partkey = uri.p_partkey AND f.path = 'scenes/' || uri)"""


def packs_written(spark, sf_dir):
    """Packs of all parts written by the sink and read back: digest and problem of each."""
    spark.dataSource.register(source.PackSink)
    folder = first_seen.scratch_folder(spark, "packs")
    named = documents(spark, sf_dir).select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("pack_dir"), "body")
    named.write.format("packs").mode("append").save(folder)
    return source.read_packs(spark, folder).select("pack_dir", F.md5("body").alias("md5"), "problem")


WRITTEN = f"WITH d AS (SELECT p_partkey, {BODY} AS body FROM part) SELECT 'part-' || p_partkey AS pack_dir, md5(body) AS md5, CASE WHEN NOT json_valid(body) THEN 'not JSON' END AS problem FROM d"


def file_ledger(spark, sf_dir):
    """A ledger of scenes after a run: a third known as they are, a third known as they were, some not as expected, some not fetched."""
    scenes = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"), F.expr(SCENE).cast("binary").alias("content"))
    whole = ledger.digests(scenes).join(scenes.select("name", "p_partkey"), "name")
    known = whole.where("p_partkey % 3 < 2").select("name", F.when(F.expr("p_partkey % 3 = 1"), F.md5("md5")).otherwise(F.col("md5")).alias("md5"), "size_bytes")
    expected = whole.where("p_partkey % 2 = 0").select("name", F.when(F.expr("p_partkey % 14 = 2"), F.md5("name")).otherwise(F.col("md5")).alias("md5"), (F.col("size_bytes") + F.expr("CASE WHEN p_partkey % 16 = 6 THEN 1 ELSE 0 END")).alias("size_bytes"))
    return ledger.merged(known, scenes.where("p_partkey % 17 <> 1").select("name", "content"), expected)


LEDGER = f"""WITH f AS (SELECT p_partkey AS k, 'part-' || p_partkey AS name, md5({SCENE}) AS md5, strlen({SCENE})::BIGINT AS size FROM part),
m AS (SELECT k, name, md5, size, k % 3 < 2 AS old, CASE WHEN k % 3 = 1 THEN md5(md5) ELSE md5 END AS old_md5, k % 17 <> 1 AS fetched, k % 2 = 0 AND k % 16 = 6 AS bad_size, k % 2 = 0 AND k % 14 = 2 AS bad FROM f),
o AS (SELECT *, CASE WHEN NOT fetched THEN 'kept' WHEN bad_size THEN 'wrong size' WHEN bad THEN 'wrong digest' WHEN NOT old THEN 'added' WHEN old_md5 = md5 THEN 'hit' ELSE 'replaced' END AS outcome FROM m WHERE fetched OR old)
SELECT name, CASE WHEN outcome IN ('added', 'replaced') THEN md5 WHEN old THEN old_md5 END AS md5, CASE WHEN outcome IN ('added', 'replaced') OR old THEN size END AS size_bytes, outcome FROM o"""


def wire_sizes(spark, sf_dir):
    """Bytes of the pages of each fifth as they are and as gzip sends them; SQL has no gzip, tests compare with zlib."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.col("page_id") % 5).alias("fifth"), F.col("html").cast("binary").alias("content"))
    return ledger.wire_sizes(pages, "fifth")


def published_set(spark, sf_dir):
    """Parts that ship against those that are published or rejected."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("pack_id"), "p_type")
    rejected = part.where("pack_id % 21 = 4").select("pack_id", F.lower("p_type").alias("reason"))
    return assets.publish_issues(part.where("pack_id % 10 <> 3"), part.where("pack_id % 9 <> 5"), rejected)


PUBLISHED = """SELECT pack_id, issue FROM (SELECT p_partkey AS pack_id, CASE WHEN p_partkey % 10 <> 3 AND p_partkey % 21 = 4 THEN 'rejected: ' || lower(p_type) WHEN p_partkey % 10 <> 3 AND p_partkey % 9 = 5 THEN 'ships unpublished' WHEN p_partkey % 10 = 3 AND p_partkey % 9 <> 5 THEN 'published but not shipped' END AS issue FROM part) WHERE issue IS NOT NULL"""


def stream_first_types(spark, sf_dir):
    """When each user first did each thing, and how often, from a stream over the events."""
    path = f"{sf_dir}/events.parquet"
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")  # a stream takes folders and patterns
    return first_seen.stream_first_seen(events.select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", first_seen.scratch_folder(spark, "first_seen"))


STREAM = "SELECT user_id, event_type, min(ts) AS first_time, count(*)::BIGINT AS n FROM events GROUP BY 1, 2"

QUERIES = {f.__name__: f for f in (pack_assets, packs_written, file_ledger, wire_sizes, published_set, stream_first_types)}
ORACLES = {"pack_assets": ASSETS, "packs_written": WRITTEN, "file_ledger": LEDGER, "published_set": PUBLISHED, "stream_first_types": STREAM}
