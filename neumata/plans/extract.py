"""From notated scores to token texts: align bars, take melody and bass, put them on the grid, render, find keys.

Chords and tuplets take part as operators.voices has them; tuplets that stay off the grid are rendered between their marks. A
song is one path. Bars are cropped to those between the first and the last in which anything sounds; a song with a bar that is
not whole in the end (its signature does not fit the grid) is quarantined: it has no text, and the number of such bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from ..functions import scalars as S
from ..functions.lineage import cut
from ..operators import harmony, intervals, stats, voices
from ..sources import songs

MELODY, BASS = "melody", "bass"
#: The least share of bars that have the song's signature.
STEADY = 0.95


def aligned(bars: DataFrame) -> DataFrame:
    """song_id, bar, ts_num, ts_den, tempo: one row a bar over all parts, signature and tempo carried forward (4/4, 120)."""
    one = bars.groupBy(F.col("path").alias("song_id"), "bar").agg(F.min_by("ts_num", F.when(F.col("ts_num").isNotNull(), F.col("part"))).alias("ts_num"), F.min_by("ts_den", F.when(F.col("ts_den").isNotNull(), F.col("part"))).alias("ts_den"), F.avg("tempo").alias("tempo"))
    return carried(one)


def carried(bars: DataFrame) -> DataFrame:
    for column, default in (("ts_num", 4), ("ts_den", 4), ("tempo", 120.0)):
        bars = intervals.carried(bars, ["song_id"], ["bar"], column, default)
    return bars


def trimmed(notes: DataFrame) -> DataFrame:
    """notes of the bars between the first and the last in which anything sounds."""
    ends = notes.where("midi >= 0").groupBy("song_id").agg(F.min("bar").alias("a"), F.max("bar").alias("z"))
    return notes.join(ends, "song_id").where("bar between a and z").drop("a", "z")


def roomed(bars: DataFrame) -> DataFrame:
    """bars (song_id, bar, ts_num, ts_den) with part and room, their length in ticks."""
    return bars.withColumns({"part": F.lit("score"), "bar": F.col("bar").cast("long"), "room": F.floor(F.col("ts_num") * F.lit(4 * dims.TICKS_PER_QUARTER).cast("long") / F.col("ts_den")).cast("long")})


def sounding(elements: DataFrame, bars: DataFrame) -> DataFrame:
    """The bars between the first and the last that is not of rests alone."""
    ends = elements.where(F.size("pitches") > 0).groupBy("song_id").agg(F.min("bar").alias("a"), F.max("bar").alias("z"))
    return bars.join(ends, "song_id").where("bar between a and z").drop("a", "z")


def lines(elements: DataFrame, most: int = voices.MOST) -> tuple[DataFrame, DataFrame]:
    """The high and the low line of each bar, with their warnings (see voices.swept), written to the shared folder."""
    elements = cut(elements)
    return cut(voices.swept(voices.compound(elements, "high", most))), cut(voices.swept(voices.compound(elements, "low", most), "low"))


def channels(high: DataFrame, low: DataFrame, room: DataFrame) -> dict[str, DataFrame]:
    """The melody's and the bass's notes in whole bars on the grid, before even tuplets are made plain; written to the shared folder."""
    melody = voices.notes_of(high)
    return {MELODY: cut(voices.placed(melody, room)), BASS: cut(voices.placed(voices.only_low(voices.notes_of(low), melody), room))}


def texts(songs_: DataFrame, parts: dict[str, DataFrame], room: DataFrame) -> DataFrame:
    """song_id, invalid_bars, score: header, bars with both parts, end; no score for a song with invalid bars."""
    rows = valid = None
    for k, (channel, notes) in enumerate(parts.items()):
        notes = voices.plain(notes)
        ok = voices.validity(notes, room)
        part = notes.withColumn("text", voices.note_text()).groupBy(*intervals.BAR).agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("x"))
        part = part.select("song_id", "bar", F.lit(k).alias("k"), F.concat_ws(" ", F.lit(f"<{channel}>"), F.array_join(F.transform("x", lambda x: x["text"]), " ")).alias("part_text"))
        rows, valid = (part, ok) if rows is None else (rows.unionByName(part), valid.unionByName(ok))
    bars = rows.groupBy("song_id", "bar").agg(F.concat_ws(" ", F.lit("<bar>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part_text"))), lambda x: x["part_text"]), " ")).alias("text"))
    body = bars.groupBy("song_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bar", "text"))), lambda x: x["text"]), " ").alias("body"))
    wrong = valid.where("not valid").select("song_id", "bar").distinct().groupBy("song_id").agg(F.count("*").alias("invalid_bars"))
    head = F.concat_ws(" ", S.time_sig_token(F.col("ts_num"), F.col("ts_den")), F.concat(F.lit("Tempo_"), F.col("tempo").cast("string")))
    out = songs_.join(body, "song_id").join(wrong, "song_id", "left").withColumn("invalid_bars", F.coalesce("invalid_bars", F.lit(0).cast("long")))
    return out.withColumn("score", F.when(F.col("invalid_bars") == 0, F.concat_ws(" ", head, "body", F.lit("</s>")))).drop("body")


def facts(bars: DataFrame) -> DataFrame:
    """song_id, ts_num, ts_den (of most bars, the first met of equals), tempo (mean), seconds. bars: as carried() gives them."""
    ts = stats.mode_first(bars.withColumn("ts", F.struct("ts_num", "ts_den")), "song_id", "ts", "bar")
    quarter = F.col("ts_num") * 4.0 / F.col("ts_den")
    one = bars.groupBy("song_id").agg(F.bround(F.avg("tempo")).cast("int").alias("tempo"), F.bround(F.sum(quarter * 60 / F.col("tempo"))).cast("int").alias("seconds"))
    return one.join(ts.select("song_id", "ts.ts_num", "ts.ts_den"), "song_id")


def extract(files: DataFrame, dataset: str = "scores") -> DataFrame:
    """song_id, dataset, score, invalid_bars, keys, seconds of each readable file (path, content)."""
    parsed, bars = songs.parsed(files, keep=cut)  # each file is read once
    notes = songs.without_drums(parsed)
    every = roomed(aligned(bars))
    elements = songs.elements(notes).join(every.select(*intervals.BAR, "room"), list(intervals.BAR))
    elements = cut(elements)
    bars = cut(sounding(elements, every))
    room = bars.select(*intervals.BAR, "room")
    elements = elements.join(room.select(*intervals.BAR), list(intervals.BAR), "left_semi")
    heard = notes.select(F.col("path").alias("song_id"), "midi", F.col("dur_ticks").alias("ticks"))
    keys = harmony.as_map(harmony.candidates(harmony.key_scores(harmony.class_durations(heard, "ticks"))))
    out = texts(facts(bars), channels(*lines(elements), room), room)
    return out.select("song_id", F.lit(dataset).alias("dataset"), "score", "invalid_bars", "seconds").join(keys, "song_id", "left")


# Warnings


def of_songs(bars: DataFrame, elements: DataFrame) -> DataFrame:
    """song_id, bar, warn_type of what concerns whole songs. bars: song_id, bar, ts_num, ts_den, tempo as written (null where none is)."""
    full = carried(bars)
    heard = elements.where(F.size("pitches") > 0).groupBy("song_id").agg(F.min("bar").alias("a"), F.max("bar").alias("z"))
    ends = full.groupBy("song_id").agg(F.min("bar").alias("first"), F.max("bar").alias("last")).join(heard, "song_id")
    inside = full.join(heard, "song_id").where("bar between a and z")
    ts = F.concat_ws("/", F.col("ts_num").cast("string"), F.col("ts_den").cast("string"))
    one = inside.groupBy("song_id").agg(F.count_distinct(ts).alias("n_ts"), F.count_distinct(F.bround("tempo")).alias("n_tempo"), F.count("*").alias("n"), F.bround(F.avg("tempo")).alias("mean"))
    mode = stats.mode_first(inside.withColumn("ts", ts), "song_id", "ts", "bar").withColumnRenamed("n", "n_mode")
    one = one.join(mode, "song_id").join(ends, "song_id")
    opening = bars.groupBy("song_id").agg(F.min_by(F.col("tempo").isNull(), "bar").alias("silent"))
    one = one.join(opening, "song_id")
    common = [f"{a}/{b}" for a, b in dims.TIME_SIGNATURES]
    found = {
        "Beginning Empty Bars": F.col("a") > F.col("first"), "Ending Empty Bars": F.col("z") < F.col("last"), "Multiple Tempos": F.col("n_tempo") > 1, "Multiple Time Signatures": F.col("n_ts") > 1, "Missing Tempo": F.col("silent"),
        "Inconsistent Time Signatures": F.col("n_mode") / F.col("n") < STEADY, "Rare Time Signature": ~F.col("ts").isin(common), "Rare Mean Tempo": ~F.col("mean").between(dims.TEMPO_LOW, dims.TEMPO_HIGH),
    }
    return listed(one, found, F.lit(None).cast("long"))


def listed(rows: DataFrame, found: dict[str, Column], bar: Column | None = None) -> DataFrame:
    names = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in found.items())))
    return rows.select("song_id", (F.col("bar") if bar is None else bar).alias("bar"), F.explode(names).alias("warn_type"))


def of_tuplets(elements: DataFrame, most: int = voices.MOST) -> DataFrame:
    """song_id, bar, warn_type of runs and groups of tuplets."""
    g = cut(voices.tuplets(elements))
    runs = listed(g.where("g = 0"), {"Input Tuplet Notes Overlap": F.col("run_overlap"), "Gap Observed in Consecutive Tuplets": F.col("run_gap")})
    many, kept = F.col("run_size") > 1, ~F.col("low")
    found = {
        "Invalid Tuplet Durations": F.col("odd") & ~F.col("severe"), "Invalid Tuplet Durations, Severe": F.col("severe"), "Tuplet Group Duration Too Low": F.col("low"), "Invalid Tuplet Size": many & kept & (F.col("size") != F.col("n")),
        "Output Tuplet Notes Overlap": kept & F.col("overlap"), "Tuplet Total Duration Beyond Quantization": kept & F.col("overlap") & (F.col("total") % voices.SLOT != 0),
        "Rest in Tuplet": many & kept & F.exists("options", lambda o: o == F.array(F.lit(-1))), "Excessive Tuplet Chord Notes": many & kept & (F.col("n_options") > most),
    }
    return runs.unionByName(listed(g, found))


def of_bars(elements: DataFrame, room: DataFrame, most: int = voices.MOST) -> DataFrame:
    """song_id, bar, warn_type of the sweeps and of the grid, for melody and bass each."""
    high, low = lines(elements, most)
    out = high.unionByName(low).where("warning is not null").select("song_id", "bar", F.col("warning").alias("warn_type"))
    beyond = elements.where((F.size("pitches") == 0) & (F.col("start") + F.col("dur") > F.col("room"))).select("song_id", "bar").distinct()
    out = out.unionByName(beyond.withColumn("warn_type", F.lit("Rests Beyond Time Signature")))
    for notes in channels(high, low, room).values():
        per = notes.groupBy("song_id", "part", "bar").agg(F.bool_or(F.col("how") == "dealt").alias("off"), F.bool_or(F.col("how") == "gap").alias("gap"))
        even = notes.where(F.col("tuplet") & ((F.col("end") - F.col("start")) % (F.size("pitches") * voices.SLOT) == 0))
        out = out.unionByName(listed(per, {"Notes Beyond Quantization": F.col("off"), "Gap in extracted Bar Notes": F.col("gap")}))
        out = out.unionByName(even.select("song_id", "bar", F.lit("Tuplet Notes Quantizable").alias("warn_type")))
        bad = voices.validity(voices.plain(notes), room).where("not valid")
        out = out.unionByName(bad.select("song_id", "bar", F.lit("Invalid Bar Notes Duration").alias("warn_type")))
    return out


def every_warning(elements: DataFrame, bars: DataFrame, most: int = voices.MOST) -> DataFrame:
    """song_id, bar (null: the whole song), warn_type, as often as it occurs. elements, bars: as the score has them.

    26 of the 27 types: a makeup note is never taken back here, since places in a bar are whole ticks and no two are nearly equal.
    """
    elements, bars = cut(elements), cut(bars)
    inside = cut(sounding(elements, bars.select(*intervals.BAR, "room")))
    elements_ = elements.join(inside.select(*intervals.BAR), list(intervals.BAR), "left_semi")
    return of_songs(bars, elements).unionByName(of_tuplets(elements_, most)).unionByName(of_bars(elements_, inside, most))


def warnings_of(files: DataFrame, most: int = voices.MOST) -> DataFrame:
    """every_warning of score files, and Inconsistent Time Signatures of bars in which parts disagree."""
    parsed = songs.parse(files, bars=True)
    odd = parsed.groupBy(F.col("path").alias("song_id"), "bar").agg(F.count_distinct("ts_num", "ts_den").alias("n")).where("n > 1")
    written = parsed.groupBy(F.col("path").alias("song_id"), "bar").agg(F.min_by("ts_num", F.when(F.col("ts_num").isNotNull(), F.col("part"))).alias("ts_num"), F.min_by("ts_den", F.when(F.col("ts_den").isNotNull(), F.col("part"))).alias("ts_den"), F.avg("tempo").alias("tempo"))
    bars = roomed(carried(written).drop("tempo").join(written.select("song_id", "bar", "tempo"), ["song_id", "bar"]))
    elements = songs.elements(songs.without_drums(songs.parse(files))).join(bars.select(*intervals.BAR, "room"), list(intervals.BAR))
    return every_warning(elements, bars, most).unionByName(odd.select("song_id", F.col("bar").cast("long").alias("bar"), F.lit("Inconsistent Time Signatures").alias("warn_type")))
