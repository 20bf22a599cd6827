"""Warnings since the start of a song: keyed state in a stream, and the same over a table.

Rows are song_id, seq (their order in the song), event (start, end, or a warning), warn_type. A start forgets what was counted
before; warnings count while a song is open; an end gives out the counts and closes it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .windows import shared

OUT = "song_id long, seq long, warn_type string, n long"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Since(StatefulProcessor):
    """Counts of the open song of a key; a key holds a row a warning type, however long its songs are."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "warn_type string", "n long")
        self.open = handle.getValueState("open", "open boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, out = (self.open.exists() and self.open.get()[0]), []
        counts = Counter({k[0]: v[0] for k, v in self.counts.iterator()})
        for r in pd.concat(rows).sort_values("seq").itertuples():
            if r.event == "start":
                counts, state = Counter(), True
            elif r.event == "end":
                out += [(key[0], r.seq, w, n) for w, n in counts.items()] if state else []
                counts, state = Counter(), False
            elif state:
                counts[r.warn_type] += 1
        self.counts.clear()
        for w, n in counts.items():
            self.counts.updateValue((w,), (n,))
        self.open.update((state,))
        yield pd.DataFrame(out, columns=["song_id", "seq", "warn_type", "n"]).astype({"song_id": "int64", "seq": "int64", "n": "int64"})

    def close(self) -> None:
        pass


def tracked_stream(stream: DataFrame) -> DataFrame:
    """song_id, seq (of the end), warn_type, n: as ends arrive. Rows of a song come in order from batch to batch."""
    return stream.select("song_id", "seq", "event", "warn_type").groupBy("song_id").transformWithStateInPandas(Since(), OUT, "append", "None")


def tracked(events: DataFrame) -> DataFrame:
    """The same of a table."""
    w = Window.partitionBy("song_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("nth", F.sum((F.col("event") == "start").cast("int")).over(w)).where("nth > 0")
    ends = rows.where("event = 'end'").groupBy("song_id", "nth").agg(F.min("seq").alias("until"))
    inside = rows.where("event = 'warn'").join(ends, ["song_id", "nth"]).where("seq < until")
    return inside.groupBy("song_id", F.col("until").alias("seq"), "warn_type").agg(F.count("*").alias("n"))


def run(spark: SparkSession, slices: list[DataFrame]) -> DataFrame:
    """What tracked_stream gives for slices of rows that arrive one after the other; the stream is started anew for each and goes on where it was."""
    at, before = shared(spark, "tracked"), spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, rows in enumerate(slices):
            rows.write.mode("append").parquet(f"{at}/in")
            stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in")
            tracked_stream(stream).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(OUT).parquet(f"{at}/out")
