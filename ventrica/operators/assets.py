"""Checks across the files of packs: what a pack refers to against a listing and against the nodes of its scene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

_NODES = "nodes array<struct<name:string>>, buffers array<struct<uri:string>>, images array<struct<uri:string>>"


def asset_issues(packs: DataFrame, files: DataFrame, scenes: DataFrame) -> DataFrame:
    """key, place, issue, severity for packs(key, body), files(key, path) and scenes(key, content), the text of each pack's scene.

    Every asset that a pack names must be listed; a scene must be JSON and have each mesh_node among
    its named nodes (the finding lists the names that exist, sorted); what its buffers and images
    refer to must be a sound path and listed beside the scene. Data URIs are embedded. A scene that
    is no .gltf is skipped, said aloud; one that isn't listed is only that. A finding is one row.

    Packs, scenes and listings are as many as packs are and meet by merging: Spark guesses the size
    of texts that are made from small columns as small, and would send them through the driver.
    """
    pack = packs.select("key", F.get_json_object("body", "$.meshes.gltf").alias("gltf"), F.get_json_object("body", "$.echo_volume.asset").alias("asset"), F.from_json("body", "meshes struct<structures:array<struct<mesh_node:string>>>")["meshes"]["structures"]["mesh_node"].alias("wanted"))
    listed = files.select("key", "path").distinct().hint("merge")
    named = pack.select("key", F.explode(F.array(F.struct(F.lit("meshes.gltf").alias("place"), F.col("gltf").alias("path")), F.struct(F.lit("echo_volume.asset").alias("place"), F.col("asset").alias("path")))).alias("n")).select("key", "n.*").where("path is not null")
    row = lambda place, issue, severity="failure": (F.lit(place).alias("place") if isinstance(place, str) else place.alias("place"), (F.lit(issue) if isinstance(issue, str) else issue).alias("issue"), F.lit(severity).alias("severity"))
    missing = named.join(listed, ["key", "path"], "left_anti").select("key", *row(F.col("place"), F.concat(F.lit("does not exist: "), "path")))
    inspected = F.lower("gltf").endswith(".gltf")
    skipped = pack.where(~inspected).select("key", *row("meshes.gltf", "only .gltf is inspected", "skipped"))
    there = pack.where(inspected).join(listed.withColumnRenamed("path", "gltf").hint("merge"), ["key", "gltf"], "left_semi")
    scene = there.join(scenes.hint("merge"), "key").withColumn("sound", F.json_object_keys("content").isNotNull())
    broken = scene.where(~F.col("sound")).select("key", *row("meshes.gltf", "not JSON"))
    doc = scene.where("sound").withColumn("d", F.from_json("content", _NODES))
    names = F.coalesce(F.array_sort(F.array_distinct(F.filter(F.col("d")["nodes"]["name"], lambda n: n.isNotNull() & (n != "")))), F.array().cast("array<string>"))
    doc = doc.withColumn("names", names)
    lost = doc.select("key", "names", F.posexplode("wanted").alias("i", "node")).where(~F.array_contains("names", F.col("node")))
    available = F.coalesce(F.nullif(F.array_join("names", ", "), F.lit("")), F.lit("(none named)"))
    nodes = lost.select("key", *row(F.concat(F.lit("meshes.structures."), F.col("i").cast("string")), F.concat(F.lit("no node "), "node", F.lit("; there are "), available)))
    uris = [doc.select("key", "gltf", F.posexplode(F.col("d")[kind]["uri"]).alias("i", "uri")).withColumn("place", F.concat(F.lit(f"{kind}."), F.col("i").cast("string"))) for kind in ("buffers", "images")]
    uri = uris[0].unionByName(uris[1]).where(F.col("uri").isNotNull() & ~F.col("uri").startswith("data:")).withColumn("bad", text.path_problem(F.col("uri")))
    unsafe = uri.where("bad is not null").select("key", *row(F.col("place"), F.concat(F.lit("bad path: "), "uri")))
    beside = uri.where("bad is null").withColumn("path", F.concat(F.regexp_extract("gltf", "^(.*/)?[^/]*$", 1), "uri"))
    absent = beside.join(listed, ["key", "path"], "left_anti").select("key", *row(F.col("place"), F.concat(F.lit("does not exist: "), "uri")))
    out = missing
    for part in (skipped, broken, nodes, unsafe, absent):
        out = out.unionByName(part)
    return out


def publish_issues(packs: DataFrame, published: DataFrame, rejected: DataFrame) -> DataFrame:
    """pack_id, issue for what is shipped, packs(pack_id), against published(pack_id) and rejected(pack_id, reason): each must be published, none rejected, and what is published must ship."""
    shipped = packs.select("pack_id").distinct().withColumn("ships", F.lit(True))
    told = published.select("pack_id").distinct().withColumn("published", F.lit(True))
    all_ = shipped.join(told, "pack_id", "full").join(rejected.select("pack_id", "reason"), "pack_id", "left")
    issue = F.when(F.col("ships") & F.col("reason").isNotNull(), F.concat(F.lit("rejected: "), "reason")).when(F.col("ships") & F.col("published").isNull(), "ships unpublished").when(F.col("ships").isNull(), "published but not shipped")
    return all_.select("pack_id", issue.alias("issue")).where("issue is not null")
