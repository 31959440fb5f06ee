"""First sight of each key in a stream of files; beyond the batch operators, with the same rows as theirs once all files were read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir


def stream_first_seen(events: DataFrame, keys: list[str], time: str, folder: str, every: str | None = None) -> DataFrame:
    """keys, first_time, n of a streaming DataFrame after all that is there was read.

    The state holds one row a key. Each micro-batch writes the keys that it changed under its own
    number, so a batch that is run again after a loss replaces what it wrote; the progress lies in
    ``folder`` too, so a later call goes on where this one ended. A null key is a key, rows with a
    null time count but are never first. ``every`` keeps the query running at that interval
    in the background instead; then the rows are those so far.
    """
    seen = events.groupBy(*keys).agg(F.min(time).alias("first_time"), F.count("*").alias("n"))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/seen/batch={number}")

    writer = seen.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/progress")
    if every:
        writer.trigger(processingTime=every).start()
    else:
        writer.trigger(availableNow=True).start().awaitTermination()
    return first_seen_so_far(events.sparkSession, keys, seen.schema, folder)


def first_seen_so_far(spark: SparkSession, keys: list[str], schema, folder: str) -> DataFrame:
    """What the stream has found: of each key the row of its last batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/seen")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", f"{folder}/seen").schema(schema.add("batch", "long")).parquet(f"{folder}/seen")
    return rows.groupBy(*keys).agg(F.max_by("first_time", "batch").alias("first_time"), F.max_by("n", "batch").alias("n"))


def scratch_folder(spark: SparkSession, tag: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
