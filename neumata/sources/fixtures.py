"""Songs, notes, intervals and token texts derived from the star-schema tables, for corpora without scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as S
from ..functions.dims import TICKS_PER_QUARTER

#: Time signatures by customer: the common ones and two rare ones.
SIGNATURES = ((4, 4), (3, 4), (2, 4), (6, 8), (2, 2), (5, 4), (12, 8), (7, 16), (3, 8))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, artist, dataset, tempo, ts_num, ts_den of every order."""
    o = table(spark, sf_dir, "orders")
    k = (F.col("o_custkey") % len(SIGNATURES)).cast("int")
    pick = lambda j: F.element_at(F.array(*(F.lit(s[j]) for s in SIGNATURES)), k + 1)
    return o.select(
        F.col("o_orderkey").alias("song_id"), F.col("o_custkey").alias("artist"), F.col("o_orderpriority").alias("dataset"),
        (F.floor("o_totalprice").cast("long") % 260 + 20).cast("int").alias("tempo"), pick(0).alias("ts_num"), pick(1).alias("ts_den"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, bar, pos (in its bar and channel), channel, midi (-1: rest), slots of every line item."""
    li = table(spark, sf_dir, "lineitem")
    order = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax", "l_returnflag"]
    channel = F.when(F.col("l_linestatus") == "O", "melody").otherwise("bass")
    own = ["l_orderkey", "l_linenumber", "l_linestatus"]
    li = li.withColumn("nth", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*own[1:], *order)))  # dealt out by song, as all that follows
    pos = F.col("nth") - F.min("nth").over(Window.partitionBy(*own)) + 1
    rest = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_partkey") % 3 == 0)
    return li.select(
        F.col("l_orderkey").alias("song_id"), (F.col("l_linenumber") - 1).alias("bar"), pos.alias("pos"), channel.alias("channel"),
        F.when(rest, -1).otherwise((F.col("l_partkey") % 128).cast("int")).alias("midi"), (F.floor("l_quantity").cast("int") % 60 + 1).alias("slots"),
    )


def note_tokens(rows: DataFrame) -> DataFrame:
    """rows and their pitch and duration tokens; durations over the bound are written out as they are."""
    return rows.withColumns({"pitch": S.pitch_token(F.col("midi")), "duration": S.slots_token(F.col("slots"))})


def score_texts(songs_: DataFrame, notes_: DataFrame) -> DataFrame:
    """song_id, dataset, score: header, bars with a melody and a bass part, and the closing token."""
    one = F.struct("bar", (F.col("channel") == "bass").alias("second"), "channel", "pos", "pitch", "duration")
    per = note_tokens(notes_).groupBy("song_id").agg(F.array_sort(F.collect_list(one)).alias("n"))

    def text(x: Column, k: Column) -> Column:
        before = F.get(F.col("n"), k - 1)
        same = before["bar"].eqNullSafe(x["bar"]) & (k > 0)
        mark = F.when(same & before["channel"].eqNullSafe(x["channel"]), F.lit(None)).otherwise(F.concat(F.lit("<"), x["channel"], F.lit(">")))
        return F.concat_ws(" ", F.when(~same, "<bar>"), mark, x["pitch"], x["duration"])

    body = per.select("song_id", F.array_join(F.transform("n", text), " ").alias("body"))
    head = F.concat_ws(" ", S.time_sig_token(F.col("ts_num"), F.col("ts_den")), F.concat(F.lit("Tempo_"), F.col("tempo").cast("string")))
    return songs_.join(body, "song_id").select("song_id", "dataset", F.concat_ws(" ", head, "body", F.lit("</s>")).alias("score"))


def intervals(spark: SparkSession, sf_dir: str, bar_slots: int = 32) -> DataFrame:
    """song_id, part, bar, id, start, end (slots in the bar), midi: events as notes; one bar an hour."""
    e = table(spark, sf_dir, "events")
    start = (F.unix_timestamp("ts") % 3600 / (3600 // bar_slots)).cast("int")
    start = F.least(start, F.lit(bar_slots - 1))
    length = 1 + F.pmod(F.floor(F.col("value")).cast("long"), F.lit(12)).cast("int")
    return e.select(
        F.col("user_id").alias("song_id"), F.col("event_type").alias("part"), F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("bar"), F.col("event_id").alias("id"),
        start.alias("start"), F.least(start + length, F.lit(bar_slots)).alias("end"), (36 + F.pmod(F.col("event_id") * 7, F.lit(60))).cast("int").alias("midi"),
    )


def score_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """song_id, part, bar, ts_num, ts_den, tempo (null where none is written), room (ticks): a bar a week in which a user has events."""
    user, bar = F.col("song_id"), F.col("bar")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("song_id"), F.lit("score").alias("part"), F.floor(F.unix_timestamp("ts") / 604800).cast("long").alias("bar")).distinct()
    odd = (user % 3 == 0) & (bar % 5 == 4)
    pick = lambda j, other: F.when(odd, other).otherwise(F.element_at(F.array(*(F.lit(s[j]) for s in SIGNATURES)), (user % len(SIGNATURES)).cast("int") + 1))
    tempo = F.when((user % 4 > 0) & ((user + bar) % 2 == 0), 20 + (user * 13 + bar % 3 * user) % 260)
    rows = rows.withColumns({"ts_num": pick(0, 3), "ts_den": pick(1, 4), "tempo": tempo})
    return rows.withColumn("room", F.floor(F.col("ts_num") * F.lit(4 * TICKS_PER_QUARTER).cast("long") / F.col("ts_den")).cast("long"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements (see operators.voices) of these bars: an event is a note, a chord or a rest, plain or in a tuplet of three or five."""
    e, unit = F.col("event_id"), TICKS_PER_QUARTER // 24
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("song_id"), F.lit("score").alias("part"), F.floor(F.unix_timestamp("ts") / 604800).cast("long").alias("bar"), (e % 2).cast("int").alias("voice"), "event_id",
        (F.floor(F.unix_timestamp("ts") % 604800 / 6300) * unit).cast("long").alias("start"), "event_type", F.floor("value").cast("long").alias("v"), (36 + e * 7 % 60).cast("int").alias("m"),
    )
    n = F.when(e % 7 == 0, 0).otherwise(F.element_at(F.array(*map(F.lit, (0, 3, 3, 5))), ((F.col("song_id") + F.col("bar") + F.col("voice")) % 4 + 1).cast("int")))
    plain = (1 + F.col("v") % 8) * S.SLOT_TICKS + F.when(e % 11 == 0, unit).otherwise(0)
    three = F.when(e % 10 == 7, 16 * unit).when(e % 10 == 8, 12 * unit).when(e % 10 == 9, TICKS_PER_QUARTER // 64).otherwise(8 * unit)
    five = F.when(e % 5 == 0, TICKS_PER_QUARTER // 2).otherwise(TICKS_PER_QUARTER // 5)
    m = F.col("m")
    pitches = F.when(F.col("event_type") == "view", F.array(m, m + 4)).when(F.col("event_type") == "purchase", F.array(m, m + 3, m + 7)).when((F.col("event_type") == "error") & (e % 3 == 0), F.array().cast("array<int>")).otherwise(F.array(m))
    nth = F.row_number().over(Window.partitionBy("song_id", "part", "bar").orderBy("voice", "start", "event_id")).cast("long")
    rows = rows.withColumn("n", n).select("song_id", "part", "bar", "voice", nth.alias("id"), "start", F.when(F.col("n") == 0, plain).when(F.col("n") == 5, five).otherwise(three).cast("long").alias("dur"), pitches.alias("pitches"), F.col("n").cast("int").alias("n"))
    return rows.join(score_bars(spark, sf_dir).select("song_id", "part", "bar", "room"), ["song_id", "part", "bar"])
