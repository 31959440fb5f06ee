"""Helpers shared by the corpus operators: the shared scratch folder and text columns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor and the driver see: the one that the session names in ``spark.checkpoint.dir``.

    Where it is unset and Spark runs in this process alone, as in tests, a temporary folder
    is set for the session; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="ventrica-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a DataFrame made by :func:`materialize`, once nothing reads them."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:  # no files of an empty one, which take no room
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


class Scratch:
    """materialize() that remembers what it wrote, to delete it once a result that no longer needs it is written."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame, tag: str) -> DataFrame:
        self.made.append(materialize(df, tag))
        return self.made[-1]

    def clear(self) -> None:
        for df in self.made:
            discard(df)
        self.made.clear()


#: So many row numbers, 16 MB, are sent to every executor to pick rows; more are joined by a shuffle.
SENT_ROWS = 2_000_000


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written with a unique number ``row``, so that rows are told apart whatever their ids are."""
    return materialize(df.withColumn("row", F.monotonically_increasing_id()), "numbered")


def few(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written, and marked for broadcast if it has at most SENT_ROWS / 16 short rows."""
    df = materialize(df, tag)
    return F.broadcast(df) if df.count() <= SENT_ROWS // 16 else df


def _picked(df: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    rows = materialize(rows, "rows")
    return df.join(F.broadcast(rows) if rows.count() <= SENT_ROWS else rows, "row", how)


def keep_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of ``df`` whose row is among ``rows(row)``; few rows go to every executor, so that texts stay in place."""
    return _picked(df, rows, "left_semi")


def without_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Those of ``df`` whose row is not among ``rows(row)``."""
    return _picked(df, rows, "left_anti")


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names that cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
