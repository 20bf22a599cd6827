"""Structured Streaming: hourly windows over events, and exports that take each new file once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import shared_folder


def shared(spark: SparkSession, name: str) -> str:
    """A folder that all executors see: under spark.checkpoint.dir. Only a session on one machine may name none."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4()}"


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of each hour; rows later than `late` may be left out once their hour is done."""
    got = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def hourly(spark: SparkSession, path: str) -> DataFrame:
    """The same, run as a stream over the files there are, to its end."""
    schema = spark.read.parquet(path).schema
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
    files = spark.readStream.schema(schema)
    stream = files.parquet(path) if folder else files.option("pathGlobFilter", where.getName()).parquet(str(where.getParent()))
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    out = shared(spark, "hourly")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    run = hourly_counts(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{out}/state").foreachBatch(put).trigger(availableNow=True).start()
    run.awaitTermination()
    last = run.lastProgress["batchId"] if run.lastProgress else 0
    return spark.read.parquet(f"{out}/{last}")


def export_new(spark: SparkSession, source: str, sink: str, state: str, schema: str) -> None:
    """Every JSON file of `source` that is not exported yet goes to the Parquet folder `sink`, once, whatever restarts."""
    stream = spark.readStream.schema(schema).option("multiLine", True).json(source)
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
