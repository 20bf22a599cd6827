"""Key finding, scale degrees and in-key ratios. One shuffle by song; key tables are broadcast (24 by 12 rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import dims
from ..functions import scalars as S


def class_durations(notes: DataFrame, weight: str = "slots") -> DataFrame:
    """song_id, pc, dur: total duration of each pitch class; rests and rare pitches (null) do not count."""
    heard = notes.where(F.col("midi").isNotNull() & (F.col("midi") != -1))
    return heard.groupBy("song_id", F.pmod("midi", F.lit(12)).alias("pc")).agg(F.sum(weight).cast("long").alias("dur"))


def key_scores(durations: DataFrame, digits: int = 6) -> DataFrame:
    """song_id, key, mode, score: Pearson correlation with each key's profile, missing classes as zeros; none without variance."""
    spark = durations.sparkSession
    wide = durations.groupBy("song_id").agg(*(F.sum(F.when(F.col("pc") == k, F.col("dur")).otherwise(0)).cast("double").alias(f"d{k}") for k in range(12)))
    total, squares = sum(F.col(f"d{k}") for k in range(12)), sum(F.col(f"d{k}") * F.col(f"d{k}") for k in range(12))
    keys = {}
    for key, mode, pc, w in dims.profile_rows():
        keys.setdefault((key, mode), [0.0] * 12)[pc] = w
    rows = [(k, m, w, sum(w), sum(x * x for x in w)) for (k, m), w in keys.items()]
    profile = spark.createDataFrame(rows, "key string, mode int, w array<double>, sw double, sww double").coalesce(1)
    cross = wide.withColumns({"s": total, "ss": squares}).crossJoin(F.broadcast(profile))  # 24 rows, always
    sxy = sum(F.col(f"d{k}") * F.col("w")[k] for k in range(12))
    r = F.try_divide(12 * sxy - F.col("s") * F.col("sw"), F.sqrt((12 * F.col("ss") - F.col("s") * F.col("s")) * (12 * F.col("sww") - F.col("sw") * F.col("sw"))))
    return cross.select("song_id", "key", "mode", F.round(r, digits).alias("score")).where("score is not null")


def candidates(scores: DataFrame, major: float = 0.8, minor: float = 0.7) -> DataFrame:
    """The keys near the best of their mode."""
    best = F.max("score").over(Window.partitionBy("song_id", "mode"))
    share = F.when(F.col("mode") == 1, major).otherwise(minor)
    return scores.withColumn("best", best).where(F.col("score") >= share * F.col("best")).drop("best")


def best_key(scores: DataFrame) -> DataFrame:
    """song_id, key, score of the best key; the smallest name of equals."""
    w = Window.partitionBy("song_id").orderBy(F.desc("score"), "key")
    return scores.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("song_id", "key", "score")


def as_map(cands: DataFrame) -> DataFrame:
    """song_id, keys map<key, score>."""
    return cands.groupBy("song_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "score")))).alias("keys"))


def in_key(notes: DataFrame, song_keys: DataFrame, fix_e_minor: bool = False, rests_as_b: bool = False, kept: tuple[str, ...] = ()) -> DataFrame:
    """song_id, key, ikr: the share of heard pitches inside each given key. rests_as_b: count a rest as pitch class 11. kept: columns of song_keys that stay."""
    keys = F.broadcast(dims.keys(notes.sparkSession, fix_e_minor))
    heard = notes.where("midi is not null") if rests_as_b else notes.where("midi >= 0 or midi < -1")
    pc = F.pmod("midi", F.lit(12))
    counts = heard.groupBy("song_id").agg(*(F.count_if(pc == k).alias(f"n{k}") for k in range(12)))  # a row a song, whatever the number of keys
    more = [c for c in song_keys.columns if c in kept]
    rows = song_keys.select("song_id", "key", *more).join(counts, "song_id", "left").join(keys, "key")
    outside = sum(F.when(F.array_contains("off_offsets", F.pmod(F.lit(k) - F.col("tonic_pc"), F.lit(12))), F.col(f"n{k}")).otherwise(0) for k in range(12))
    every = sum(F.col(f"n{k}") for k in range(12))
    return rows.select("song_id", "key", *more, F.coalesce(F.try_divide(every - outside, every), F.lit(0.0)).alias("ikr"))


def weighted_in_key(notes: DataFrame, scores: DataFrame, **options) -> DataFrame:
    """song_id, ikr: mean over the keys with positive scores, weighted by them."""
    rows = in_key(notes, scores.where("score > 0"), kept=("score",), **options)
    return rows.groupBy("song_id").agg((F.sum(F.col("ikr") * F.col("score")) / F.sum("score")).alias("ikr"))


def initial_class(notes: DataFrame, bars: int = 4) -> DataFrame:
    """song_id, pc: the most common pitch class of the first bars, the one met first of equals."""
    rows = notes.where((F.col("bar") < bars) & (F.col("midi") >= 0))
    met = F.struct("bar", (F.col("channel") == "bass").alias("second"), "pos")
    counts = rows.groupBy("song_id", F.pmod("midi", F.lit(12)).alias("pc")).agg(F.count("*").alias("n"), F.min(met).alias("met"))
    w = Window.partitionBy("song_id").orderBy(F.desc("n"), "met", "pc")
    return counts.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("song_id", "pc", "n")


def sampled_key(cands: DataFrame, seed: int, top: int | None = None) -> DataFrame:
    """One key a song with a chance in proportion to its score, the same for the same seed; top: among the best ones only."""
    rows = cands.where("score > 0")
    if top:
        rank = F.row_number().over(Window.partitionBy("song_id").orderBy(F.desc("score"), "key"))
        rows = rows.withColumn("rn", rank).where(F.col("rn") <= top).drop("rn")
    draw = F.round(-F.log((S.hashed(F.col("song_id"), F.col("key"), seed) + 1) / F.lit(float(1 << 60) + 1)) / F.col("score"), 9)
    w = Window.partitionBy("song_id").orderBy("draw", "key")
    return rows.withColumn("draw", draw).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("song_id", "key", "score")


def shifted(notes: DataFrame, song_keys: DataFrame) -> DataFrame:
    """notes and degree, token: usual spelling of each heard pitch as a degree of its song's key; edge octaves fold inwards."""
    names = F.array(*(F.lit(s[0][0]) for s in dims.SPELLINGS))
    rows = notes.join(song_keys.select("song_id", "key"), "song_id")
    step = F.when(F.col("midi") >= 0, F.element_at(names, F.pmod("midi", F.lit(12)).cast("int") + 1))
    deg = S.degree(step, F.col("key"))
    midi = F.when(F.col("midi") == -12, 0).when(F.col("midi") == 131, 119).otherwise(F.col("midi"))
    token = F.when(deg == 0, S.pitch_token(midi)).otherwise(F.concat(S.pitch_token(midi), F.lit("_"), deg.cast("string")))
    return rows.withColumns({"degree": deg, "token": token})
