"""A ledger of verified files: what was fetched, its digest and size, merged so that a second run changes nothing."""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digests(files: DataFrame) -> DataFrame:
    """name, md5, size_bytes of files(name, content); a null content is an empty file."""
    content = F.coalesce("content", F.lit("").cast("binary"))
    return files.select("name", F.md5(content).alias("md5"), F.octet_length(content).cast("long").alias("size_bytes"))


def merged(ledger: DataFrame, files: DataFrame, expected: DataFrame) -> DataFrame:
    """name, md5, size_bytes, outcome: ``ledger(name, md5, size_bytes)`` after ``files`` were verified against ``expected(name, md5, size_bytes)``.

    outcome is "hit" (the ledger knew the file as it is), "added", "replaced", "kept" (no such file
    this time), or, for a file that is not what was expected, "wrong digest" or "wrong size"; such a
    file leaves the ledger's row as it was, with null digests where it had none. A file that nothing
    is expected of is taken as it is. Names are unique in each input; merging twice gives only hits.
    """
    now = digests(files).select("name", F.col("md5").alias("_md5"), F.col("size_bytes").alias("_size"))
    want = expected.select("name", F.col("md5").alias("_want"), F.col("size_bytes").alias("_want_size"))
    all_ = ledger.withColumn("_old", F.lit(True)).join(now, "name", "full").join(want, "name", "left")
    wrong: Column = F.when(F.col("_want_size") != F.col("_size"), "wrong size").when(F.col("_want") != F.col("_md5"), "wrong digest")
    same = (F.col("md5") == F.col("_md5")) & (F.col("size_bytes") == F.col("_size"))
    outcome = F.when(F.col("_md5").isNull(), "kept").otherwise(F.coalesce(wrong, F.when(F.col("_old").isNull(), "added").when(same, "hit").otherwise("replaced")))
    taken = F.col("outcome").isin("added", "replaced")
    return all_.withColumn("outcome", outcome).select("name", F.when(taken, F.col("_md5")).otherwise(F.col("md5")).alias("md5"), F.when(taken, F.col("_size")).otherwise(F.col("size_bytes")).alias("size_bytes"), "outcome")


def wire_sizes(files: DataFrame, group: str, level: int = 6) -> DataFrame:
    """group, files, raw_bytes, wire_bytes: sizes of contents as they are and as gzip at a level sends them."""

    def run(batches):
        for b in batches:
            wire = [len(zlib.compress(c or b"", level, 31)) for c in b.column("content").to_pylist()]
            raw = [len(c or b"") for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("g"), pa.array(raw, pa.int64()), pa.array(wire, pa.int64())], ["g", "raw", "wire"])

    sized = files.select(F.col(group).cast("string").alias("g"), "content").mapInArrow(run, "g string, raw long, wire long")
    return sized.groupBy(F.col("g").alias(group)).agg(F.count("*").alias("files"), F.sum("raw").alias("raw_bytes"), F.sum("wire").alias("wire_bytes"))
