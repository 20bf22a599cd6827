"""Shared plumbing: session settings, cut lineage, labelled samples, Arrow batches."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Whole texts travel in a batch, so it is kept small to bound worker memory.
BATCH_ROWS = 512
#: Bytes after which a batch is closed (a single longer text still travels whole).
BATCH_BYTES = 16 << 20
#: Default bound on labelled rows gathered to the driver for fitting a classifier.
MAX_TRAIN_ROWS = 20_000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches of whole texts small in rows and in bytes, whatever the length of a text."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key, str((1 << 31) - 1))) <= most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Only a session on one machine may do without: it gets a temporary one."""
    conf = spark.sparkContext.getConf()
    if not (named := conf.get("spark.checkpoint.dir")) and not re.match(r"local(\[|$)", conf.get("spark.master", "local")):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    return named or tempfile.mkdtemp(prefix="neumata-")


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder the session names in spark.checkpoint.dir.

    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    gc.collect()  # what led here is no longer referred to: let Spark delete its shuffle files now, not some time later
    sc._jvm.System.gc()
    return out


#: Groups up to so many rows may be broadcast; more go through a salted join.
MAX_BROADCAST_GROUPS = 100_000
SALTS = 16


def with_group(rows: DataFrame, groups: DataFrame, key: str, most: int = MAX_BROADCAST_GROUPS) -> DataFrame:
    """rows and what groups (one row a key, null included) says of their key.

    Few groups are broadcast, their number counted first; otherwise rows of a hot key are spread over salts, groups repeated.
    """
    groups = cut(groups.withColumnRenamed(key, "_key"))
    if groups.count() <= most:
        return rows.join(F.broadcast(groups), F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("_row", F.pmod(F.xxhash64(*(c for c in rows.columns if c != key)), F.lit(SALTS)).cast("int"))
    return spread.join(salted, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_row") == F.col("_salt"))).drop("_key", "_salt", "_row")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text counts as empty, other columns are left out."""
    return df.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def label_sample(labels: DataFrame, column: str, keep, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """About max_rows labelled ids, chosen by a hash of the id, so that the same ones are chosen each time.

    keep: a condition on doc_id. Ids with several labels take the majority, ties count as 1; null labels are left out.
    """
    rows = labels.select("doc_id", F.col(column).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    rows = rows.where(keep).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    n = rows.count()
    share = min(1.0, max_rows / max(n, 1))
    return rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def texts_of(batches: Iterator, step: int = BATCH_ROWS) -> Iterator[tuple[list, list]]:
    """(doc_ids, texts) of each Arrow record batch with columns doc_id and text."""
    for b in batches:
        for k in range(0, b.num_rows, step):
            part = b.slice(k, step)
            yield part.column(0).to_pylist(), part.column(1).to_pylist()
