"""Song records: JSON envelopes, Parquet data sets with splits, notated scores (MusicXML, plain or zipped), exports."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dims import TICKS_PER_QUARTER

META = "struct<mode:string,precision:int,with_pitch_step:boolean,greedy_tuplet_pitch_threshold:bigint>"
WARNING = "array<struct<warn_name:string,bar_num:int,args:map<string,string>>>"
SONG = f"struct<score:string,song_path:string,title:string,duration:int,warnings:{WARNING},keys:map<string,double>>"
COMBINED = f"encoding_type string, extractor_meta {META}, music array<{SONG}>"
SINGLE = f"encoding_type string, extractor_meta {META}, music {SONG}"
NOTES = "path string, part int, bar int, voice int, start_ticks long, dur_ticks long, midi int, is_drum boolean, tuplet int, element int, error string"
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
BARS = "path string, part int, bar int, ts_num int, ts_den int, tempo double"


def load(spark: SparkSession, *paths: str, dataset: str | None = None) -> DataFrame:
    """dataset, encoding_type, extractor_meta and the columns of a song, from files with many songs each. Schemas are given, never guessed."""
    rows = spark.read.schema(COMBINED).option("multiLine", True).json(list(paths))
    return rows.select(F.lit(dataset).alias("dataset"), "encoding_type", "extractor_meta", F.explode("music").alias("m")).select("dataset", "encoding_type", "extractor_meta", "m.*")


def load_single(spark: SparkSession, paths: str, dataset: str | None = None) -> DataFrame:
    """The same from files of one song each."""
    rows = spark.read.schema(SINGLE).option("multiLine", True).json(paths)
    return rows.select(F.lit(dataset).alias("dataset"), "encoding_type", "extractor_meta", "music.*")


def stack(*songs: DataFrame) -> DataFrame:
    """All data sets as one, which they may only be if made with the same settings."""
    out = songs[0]
    for s in songs[1:]:
        out = out.unionByName(s)
    kinds = out.select(F.to_json("extractor_meta").alias("m")).distinct().limit(2).collect()
    if len(kinds) > 1:
        raise ValueError(f"extracted with different settings: {[r[0] for r in kinds]}")
    return out


#: Songs of one envelope that combine() writes.
ENVELOPE = 1000


def combine(songs: DataFrame, path: str, most: int = ENVELOPE) -> None:
    """Songs as envelopes of at most `most` songs of one setting each, a file an envelope, so no row ever holds the corpus; load() reads them too."""
    song = F.struct("score", "song_path", "title", "duration", "warnings", "keys")
    nth = F.monotonically_increasing_id()
    rows = songs.withColumn("box", F.struct(F.shiftright(nth, 33).alias("part"), F.floor(nth.bitwiseAND(F.lit((1 << 33) - 1)) / most).alias("k")))
    rows.groupBy("encoding_type", "extractor_meta", "box").agg(F.collect_list(song).alias("music")).drop("box").write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def load_combined(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """load() of what combine() has written; files are read by ranges of bytes, an envelope a line."""
    rows = spark.read.schema(COMBINED).json(path)
    return rows.select(F.lit(dataset).alias("dataset"), "encoding_type", "extractor_meta", F.explode("music").alias("m")).select("dataset", "encoding_type", "extractor_meta", "m.*")


def to_dataset(songs: DataFrame, path: str) -> None:
    """Parquet by data set and split, without columns of no use for training."""
    songs.drop("warnings", "duration", "song_path").write.mode("overwrite").partitionBy(*[c for c in ("dataset", "split") if c in songs.columns]).parquet(path)


def read_dataset(spark: SparkSession, path: str, split: str | None = None, n: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    rows = rows if split is None else rows.where(F.col("split") == split)
    return rows if n is None else rows.orderBy("title").limit(n)


def not_done(files: DataFrame, done: DataFrame) -> DataFrame:
    """Files to export yet: those whose path no result has."""
    return files.join(done.select("path"), "path", "left_anti")


def root_of(content: bytes) -> ElementTree.Element:
    if content[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = [n for n in z.namelist() if not n.startswith("META-INF") and n.endswith((".xml", ".musicxml"))]
            content = z.read(sorted(names)[0])
    return ElementTree.fromstring(content)


#: How pitch classes are written.
STEPS = (("C", 0), ("C", 1), ("D", 0), ("D", 1), ("E", 0), ("F", 0), ("F", 1), ("G", 0), ("G", 1), ("A", 0), ("A", 1), ("B", 0))
SEMITONE = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def read_score(path: str, content: bytes) -> tuple[list[tuple], list[tuple]]:
    """(notes, bars) of a score: positions in ticks from the start of their bar; rests have midi -1."""
    root, notes, bars = root_of(content), [], []
    drums = {p.get("id") for p in root.iter("score-part") if any((c.text or "") == "10" for c in p.iter("midi-channel"))}
    for p, part in enumerate(root.iter("part")):
        divisions, sig = 1, (None, None)
        for b, measure in enumerate(part.findall("measure")):
            at = last = 0
            element, tempos = -1, []
            for e in measure:
                if e.tag == "attributes":
                    divisions = int(e.findtext("divisions", divisions))
                    if e.find("time/beats") is not None:
                        sig = int(e.findtext("time/beats")), int(e.findtext("time/beat-type"))
                elif e.tag in ("backup", "forward"):
                    at += (1 if e.tag == "forward" else -1) * int(e.findtext("duration", "0")) * TICKS_PER_QUARTER // divisions
                elif e.tag in ("sound", "direction"):
                    tempos += [float(s.get("tempo")) for s in e.iter("sound") if s.get("tempo")]
                elif e.tag == "note" and e.find("grace") is None:
                    ticks = int(e.findtext("duration", "0")) * TICKS_PER_QUARTER // divisions
                    start = last if e.find("chord") is not None else at
                    pitch, unpitched = e.find("pitch"), e.find("unpitched") is not None
                    midi = -1 if pitch is None else SEMITONE[pitch.findtext("step")] + int(float(pitch.findtext("alter", "0"))) + 12 * (int(pitch.findtext("octave")) + 1)
                    tuplet = int(e.findtext("time-modification/actual-notes", "0"))
                    element += e.find("chord") is None
                    notes.append((path, p, b, int(e.findtext("voice", "1")), start, ticks, midi, unpitched or part.get("id") in drums, tuplet, element, None))
                    last = start
                    at = max(at, start + ticks) if e.find("chord") is not None else at + ticks
            bars.append((path, p, b, *sig, sum(tempos) / len(tempos) if tempos else None))
    return notes, bars


def parse(files: DataFrame, bars: bool = False) -> DataFrame:
    """Notes (or bars) of score files (path, content); a file that cannot be read gives one row with its error."""
    return parsed(files, False, True)[1] if bars else parsed(files, True, False)[0]


def parsed(files: DataFrame, notes: bool = True, bars: bool = True, keep=lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """(notes, bars) of score files, read once: the rows of both are told apart after keep, which may write them."""
    fields = {name: (kind, k) for k, schema in enumerate((NOTES, BARS)) for name, kind in (c.split() for c in schema.split(", "))}
    own = [[c.split()[0] for c in schema.split(", ")] for schema in (NOTES, BARS)]
    at = [[list(fields).index(c) for c in columns] for columns in own]

    def run(batches):
        for b in batches:
            columns = [[] for _ in fields]
            is_bar = []

            def put(rows, kind):
                if rows:
                    n = len(rows)
                    given = dict(zip(at[kind], zip(*rows, strict=True), strict=True))
                    for k, column in enumerate(columns):
                        column.extend(given[k] if k in given else (None,) * n)
                    is_bar.extend((bool(kind),) * n)

            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = read_score(path, bytes(content))
                    for kind, wanted in enumerate((notes, bars)):
                        put(found[kind] if wanted else [], kind)
                except Exception as e:  # one broken file must not stop the others
                    put([(path, *[None] * (len(own[0]) - 2), f"{type(e).__name__}: {e}"[:300])] if notes else [], 0)
            yield pa.RecordBatch.from_arrays([pa.array(is_bar, pa.bool_()), *(pa.array(c, ARROW[fields[n][0]]) for n, c in zip(fields, columns, strict=True))], ["is_bar", *fields])

    rows = keep(files.select("path", "content").mapInArrow(run, ", ".join(["is_bar boolean", *(f"{n} {kind}" for n, (kind, _) in fields.items())])))
    return rows.where("not is_bar").select(*own[0]), rows.where("is_bar").select(*own[1])


#: Voices of a part that are told apart.
VOICES = 64


def elements(notes: DataFrame) -> DataFrame:
    """Parsed notes as elements of one part (see operators.voices, but for room): notes of a chord together, numbered as they are written."""
    one = notes.groupBy(F.col("path").alias("song_id"), F.col("part").alias("p"), "bar", "voice", "element").agg(
        F.min("start_ticks").alias("start"), F.max("dur_ticks").alias("dur"), F.array_sort(F.array_distinct(F.filter(F.collect_list("midi"), lambda m: m >= 0))).alias("pitches"), F.max("tuplet").alias("n"),
    )
    nth = F.row_number().over(Window.partitionBy("song_id", "bar").orderBy("p", "element")).cast("long")
    return one.select("song_id", F.lit("score").alias("part"), F.col("bar").cast("long").alias("bar"), (F.col("p") * VOICES + F.col("voice")).cast("int").alias("voice"), nth.alias("id"), "start", "dur", "pitches", F.col("n").cast("int").alias("n"))


def musicxml(elements: DataFrame, bars: DataFrame) -> DataFrame:
    """path (the song's id), content: scores of one part each. Durations are written in ticks, each element at its place of the bar.

    bars: song_id, part, bar, ts_num, ts_den, tempo (or null). A song is one row; nothing is gathered beyond it.
    """
    w = Window.partitionBy("song_id", "part", "bar").orderBy("voice", "start", "id")
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c.cast("string"), F.lit(f"</{name}>"))
    rows = elements.withColumn("move", F.col("start") - F.coalesce(F.lag(F.col("start") + F.col("dur")).over(w), F.lit(0)))
    move = F.when(F.col("move") > 0, tag("forward", tag("duration", F.col("move")))).when(F.col("move") < 0, tag("backup", tag("duration", -F.col("move")))).otherwise("")
    steps, alters = F.array(*(F.lit(STEPS[k][0]) for k in range(12))), F.array(*(F.lit(f"<alter>{a}</alter>" if a else "") for _, a in STEPS))
    pc = lambda p: (F.pmod(p, F.lit(12)) + 1).cast("int")
    pitch = lambda p: F.concat(F.lit("<pitch>"), tag("step", F.element_at(steps, pc(p))), F.element_at(alters, pc(p)), tag("octave", F.floor(p / 12) - 1), F.lit("</pitch>"))
    tail = F.concat(tag("duration", F.col("dur")), tag("voice", F.col("voice")), F.when(F.col("n") > 0, tag("time-modification", F.concat(tag("actual-notes", F.col("n")), tag("normal-notes", F.lit(2))))).otherwise(""))
    note = lambda head: F.concat(F.lit("<note>"), head, tail, F.lit("</note>"))
    body = F.when(F.size("pitches") == 0, note(F.lit("<rest/>"))).otherwise(F.array_join(F.transform("pitches", lambda p, k: note(F.concat(F.when(k > 0, "<chord/>").otherwise(""), pitch(p)))), ""))
    per = rows.select("song_id", "part", "bar", "voice", "start", "id", F.concat(move, body).alias("x")).groupBy("song_id", "part", "bar").agg(F.array_sort(F.collect_list(F.struct("voice", "start", "id", "x"))).alias("x"))
    time = tag("time", F.concat(tag("beats", F.col("ts_num")), tag("beat-type", F.col("ts_den"))))
    head = F.concat(F.lit("<attributes>"), tag("divisions", F.lit(TICKS_PER_QUARTER)), time, F.lit("</attributes>"), F.when(F.col("tempo").isNull(), "").otherwise(F.concat(F.lit('<sound tempo="'), F.col("tempo").cast("string"), F.lit('"/>'))))
    measures = bars.join(per, ["song_id", "part", "bar"], "left").select("song_id", "bar", F.concat(F.lit("<measure>"), head, F.array_join(F.coalesce(F.transform("x", lambda x: x["x"]), F.array()), ""), F.lit("</measure>")).alias("m"))
    score = measures.groupBy("song_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bar", "m"))), lambda x: x["m"]), "").alias("m"))
    text = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><score-partwise><part-list><score-part id="P1"><part-name>score</part-name></score-part></part-list><part id="P1">'), "m", F.lit("</part></score-partwise>"))
    return score.select(F.col("song_id").cast("string").alias("path"), F.encode(text, "UTF-8").alias("content"))


def write_scores(scores: DataFrame, folder: str) -> None:
    """Scores (path, content) as files of a table, one row a score, which parse() reads again."""
    scores.write.mode("overwrite").parquet(folder)


def read_scores(spark: SparkSession, folder: str, pattern: str = "*.mxl") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)


def without_drums(notes: DataFrame) -> DataFrame:
    """Notes of the parts that are no drum parts."""
    drums = notes.groupBy("path", "part").agg(F.bool_or("is_drum").alias("drum"), F.bool_or(F.col("midi") >= 0).alias("pitched")).where("drum or not pitched")
    return notes.where("error is null").join(drums, ["path", "part"], "left_anti")


def scan_statistics(notes: DataFrame, bars: DataFrame) -> DataFrame:
    """path, notes, rests, bars, time_signatures, tempos, errors of each file."""
    n = notes.groupBy("path").agg(F.count_if(F.col("midi") >= 0).alias("notes"), F.count_if(F.col("midi") == -1).alias("rests"), F.count("error").alias("errors"))
    b = bars.groupBy("path").agg(F.count_distinct("bar").alias("bars"), F.count_distinct("ts_num", "ts_den").alias("time_signatures"), F.count_distinct("tempo").alias("tempos"))
    return n.join(b, "path", "left")


def format_of(path: Column) -> Column:
    """The file's ending in small letters, with both endings of a double one; empty where it has none."""
    return F.lower(F.regexp_extract(path, r"((?:\.[A-Za-z0-9]{1,9}){1,2})$", 1))


def scanned(notes: DataFrame) -> DataFrame:
    """path, format, error (class name; null: readable), notes, rests, histogram (ticks -> notes) of each file: broken ones are kept apart by their error."""
    per = notes.groupBy("path", F.when(F.col("midi") >= 0, F.col("dur_ticks")).alias("ticks")).agg(F.count_if(F.col("midi") >= 0).alias("n"), F.count_if(F.col("midi") == -1).alias("rests"), F.max("error").alias("error"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("ticks", "n"))))
    got = per.groupBy("path").agg(F.sum("n").alias("notes"), F.sum("rests").alias("rests"), F.regexp_extract(F.max("error"), r"^(\w+)", 1).alias("error"), F.map_from_entries(pairs).alias("histogram"))
    return got.select("path", format_of(F.col("path")).alias("format"), F.nullif("error", F.lit("")).alias("error"), "notes", "rests", "histogram")


def by_format(scan: DataFrame) -> DataFrame:
    """format, ticks (null: files), n, broken: notes of each duration, and files with how many of them cannot be read."""
    files = scan.groupBy("format").agg(F.count("*").alias("n"), F.count("error").alias("broken")).withColumn("ticks", F.lit(None).cast("long"))
    notes = scan.where("error is null").select("format", F.explode("histogram").alias("ticks", "n")).groupBy("format", "ticks").agg(F.sum("n").alias("n")).withColumn("broken", F.lit(0).cast("long"))
    return files.select("format", "ticks", "n", "broken").unionByName(notes.select("format", "ticks", "n", "broken"))
