"""Bars of chords and tuplets: tuplet grouping, chord options, skylines over compound notes, the grid, texts, and what is wrong.

An element is a note, a chord or a rest of a voice: BAR, voice, id (distinct in its bar), start, dur (ticks from the start of
the bar), pitches (distinct; none: a rest), n (the tuplet it is written in; 0: none), room (ticks of its bar). A compound note is
one interval with its pitches: a plain note has one (-1: a rest), a tuplet several, which share the interval equally once it is
on the grid. Everything is grouped and windowed by bar, which holds a bounded number of elements; songs of any length are many
bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.dims import TICKS_PER_QUARTER
from .intervals import BAR, each_bar

#: Tuplets end on eighths; the grid; what odd totals are rounded to; chord options of a tuplet that are still told apart.
EIGHTH, SLOT, FINE, MOST = TICKS_PER_QUARTER // 2, S.SLOT_TICKS, TICKS_PER_QUARTER // 32, 3**9
MEMBER = "struct<start:bigint,id:bigint,dur:bigint,pitches:array<int>>"


def total(members: Column) -> Column:
    return F.aggregate(members, F.lit(0).cast("long"), lambda a, m: a + m["dur"])


def runs(elements: DataFrame) -> DataFrame:
    """BAR, voice, run, n, room, members: neighbours of a voice that are written in the same tuplet, in order."""
    w = Window.partitionBy(*BAR, "voice").orderBy("start", "id")
    rows = elements.withColumn("new", (~F.lag("n").over(w).eqNullSafe(F.col("n"))).cast("int"))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("n > 0")
    return rows.groupBy(*BAR, "voice", "run", "n", "room").agg(F.array_sort(F.collect_list(F.struct("start", "id", "dur", "pitches"))).alias("members"))


def dealt(members: Column, n: Column) -> Column:
    """struct<done, open>: groups that are full (n elements or more, ending on an eighth), and what is left after the last."""
    none, groups = F.array().cast(f"array<{MEMBER}>"), F.array().cast(f"array<array<{MEMBER}>>")

    def step(s: Column, m: Column) -> Column:
        now = F.concat(s["open"], F.array(m))
        full = (F.size(now) >= n) & (total(now) % EIGHTH == 0)
        return F.struct(F.when(full, F.concat(s["done"], F.array(now))).otherwise(s["done"]).alias("done"), F.when(full, none).otherwise(now).alias("open"))

    return F.aggregate(members, F.struct(groups.alias("done"), none.alias("open")), step)


def touching(members: Column, wrong) -> Column:
    """Whether wrong(start, end of the one before) holds for any two neighbours."""
    pairs = F.zip_with(F.slice(members, 2, F.greatest(F.size(members) - 1, F.lit(0))), F.slice(members, 1, F.greatest(F.size(members) - 1, F.lit(0))), lambda b, a: F.struct(b["start"].alias("start"), (a["start"] + a["dur"]).alias("before")))
    return F.exists(pairs, lambda p: wrong(p["start"], p["before"]))


def tuplets(elements: DataFrame) -> DataFrame:
    """One row a tuplet group: BAR, voice, run, g, n, room, run_size, members, size, total, odd, severe, low, overlap, start, end, options, n_options; and of its run: run_overlap, run_gap.

    A group ends with n elements or more whose durations end on an eighth. What is left at the end of a run joins the group before
    when its durations end on an eighth too, else it is a group of its own; where its total is off the eighths it is `odd`, off the
    grid `severe` (then it is rounded, cut to the bar, and shared out equally) and `low` when nothing remains of it. A group whose
    elements overlap is as long as they are together. options: the pitches of each element (-1: a rest).
    """
    rows = runs(elements).withColumns({"d": dealt(F.col("members"), F.col("n")), "run_size": F.size("members"), "run_overlap": touching(F.col("members"), lambda s, e: s < e), "run_gap": touching(F.col("members"), lambda s, e: s > e)})
    left, done = F.col("d.open"), F.col("d.done")
    ends = total(left) % EIGHTH == 0
    joined = (F.size(left) > 0) & ends & (F.size(done) > 0)
    last = F.concat(F.element_at(done, -1), left)
    groups = F.when(F.size(left) == 0, done).when(joined, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(last))).otherwise(F.concat(done, F.array(left)))
    rows = rows.withColumns({"groups": groups, "odd_end": (F.size(left) > 0) & ~ends})
    rows = rows.select(*BAR, "voice", "run", "n", "room", "run_size", "run_overlap", "run_gap", "odd_end", F.size("groups").alias("n_groups"), F.posexplode("groups").alias("g", "members"))
    m = F.col("members")
    rows = rows.withColumns({"size": F.size(m), "written": total(m), "odd": F.col("odd_end") & (F.col("g") == F.col("n_groups") - 1) & (F.col("run_size") > 1), "overlaps": touching(m, lambda s, e: s < e)})
    rows = rows.withColumn("severe", F.col("odd") & (F.col("written") % SLOT != 0))
    rounded = F.least((F.bround(F.col("written") / FINE) * FINE).cast("long"), F.col("room"))
    rows = rows.withColumns({"total": F.when(F.col("severe"), rounded).otherwise(F.col("written")), "overlap": F.col("overlaps") & ~F.col("severe"), "start": m[0]["start"]})
    hull = F.element_at(m, -1)["start"] + F.element_at(m, -1)["dur"]
    options = F.transform(m, lambda x: F.when(F.size(x["pitches"]) == 0, F.array(F.lit(-1))).otherwise(x["pitches"]))
    rows = rows.withColumns({"low": F.col("severe") & (F.col("total") == 0), "end": F.when(F.col("severe") | F.col("overlap"), F.col("start") + F.col("total")).otherwise(hull), "options": options})
    rows = rows.withColumn("n_options", F.aggregate("options", F.lit(1.0), lambda a, o: a * F.size(o)))
    return rows.select(*BAR, "voice", "run", "g", "n", "room", "run_size", "run_overlap", "run_gap", "members", "size", "total", "odd", "severe", "low", "overlap", "start", "end", "options", "n_options")


def choices(groups: DataFrame, most: int = MOST) -> DataFrame:
    """groups and k, pitches: every way to take one pitch of each chord, or, beyond `most` ways, the highest pitches alone.

    The number of ways is known from the sizes before any is built, so a row never holds more than `most`.
    """
    start = F.array(F.array().cast("array<int>"))
    every = F.aggregate("options", start, lambda ways, o: F.flatten(F.transform(ways, lambda w: F.transform(o, lambda p: F.concat(w, F.array(p))))))
    ways = F.when(F.col("n_options") > most, F.array(F.transform("options", F.array_max))).otherwise(every)
    return groups.select("*", F.posexplode(ways).alias("k", "pitches"))


def best_choices(groups: DataFrame, k: int, high: bool = True) -> DataFrame:
    """groups and rank, pitches: the k ways with the highest (lowest) mean pitch, without building all of them.

    A mean is a sum over the elements, so a way that is not among the k best of the elements so far cannot be among the k best
    of all: each step keeps k.
    """
    sign = -1 if high else 1

    def step(ways: Column, o: Column) -> Column:
        longer = F.flatten(F.transform(ways, lambda w: F.transform(o, lambda p: F.struct((w["sum"] + sign * p).alias("sum"), F.concat(w["pitches"], F.array(p)).alias("pitches")))))
        return F.slice(F.array_sort(longer), 1, k)

    start = F.array(F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("pitches")))
    found = F.aggregate("options", start, step)
    return groups.select("*", F.posexplode(F.transform(found, lambda w: w["pitches"])).alias("rank", "pitches"))


def height(pitches: Column, weights: Column) -> Column:
    """The mean frequency in thousandths of a hertz, weighted; rests count as 0."""
    fs = F.zip_with(pitches, weights, lambda p, w: S.frequency(p) * w)
    sums = F.aggregate(fs, F.lit(0.0), lambda a, x: a + x) / F.aggregate(weights, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.round(sums * 1000).cast("long")


def compound(elements: DataFrame, keep: str = "high", most: int = MOST) -> DataFrame:
    """BAR, id, start, end, height, pitches, tuplet: chords as their notes, tuplet groups as one note each.

    Of a group's chord options the highest (lowest) alone takes part: a sweep never keeps another one, since whatever is better
    than the best option and cuts it off does the same to all others of the same interval. The low line is drawn among what sounds: rests take part in the high one alone.
    """
    ids = F.col("id") * 256
    plain = elements.where("n = 0").withColumn("p", F.explode(F.when(F.size("pitches") == 0, F.array(F.lit(-1))).otherwise(F.col("pitches"))))
    plain = plain.select(*BAR, (ids + F.col("p") + 1).alias("id"), "start", (F.col("start") + F.col("dur")).alias("end"), F.array("p").alias("pitches"), F.array("dur").alias("weights"), F.lit(False).alias("tuplet"))
    g = tuplets(elements).where("not low")
    pick = F.array_max if keep == "high" else lambda o: F.when((F.col("n_options") > most) | (F.col("run_size") == 1), F.array_max(o)).otherwise(F.array_min(o))
    rest = F.forall("options", lambda o: o == F.array(F.lit(-1)))
    one = (F.col("size") == 1) | rest
    pitches = F.when(rest, F.array(F.lit(-1))).otherwise(F.transform("options", pick))
    weights = F.when(rest, F.array(F.col("total"))).when(F.col("severe"), F.transform("members", lambda m: F.lit(1).cast("long"))).otherwise(F.transform("members", lambda m: m["dur"]))
    end = F.when(rest, F.col("start") + F.col("total")).otherwise(F.col("end"))
    made = g.select(*BAR, (F.col("members")[0]["id"] * 256 + 255).alias("id"), "start", end.alias("end"), pitches.alias("pitches"), weights.alias("weights"), (~one).alias("tuplet"))
    rows = plain.unionByName(made).where("end > start")
    rows = rows if keep == "high" else rows.where(F.col("pitches") != F.array(F.lit(-1)))  # the low line has no rests
    return rows.withColumn("height", height(F.col("pitches"), F.col("weights"))).drop("weights")


OVER, OVER_TUPLET, MAKEUP = "Higher Pitch Overlap", "Higher Pitch Overlap with Triplet", "Lower Pitch Makeup"


def sweep(rows: list[tuple], high: bool) -> tuple[list[tuple], list[str]]:
    """(notes (id, start, end) of the greedy sweep, warnings) of one bar's rows (start, end, height, id, tuplet).

    At each start the best note (of equals the longer for the high line, the shorter for the low) meets the last one that still
    sounds: a better one cuts it short, or takes it out altogether where it is a tuplet, and the sweep begins again; a worse one
    that lasts longer is put back with what remains of it, and the sweep begins again; a worse tuplet is passed over.
    """
    sign, warned = 1 if high else -1, []
    notes = {(i, s): [s, e, h, i, t] for s, e, h, i, t in rows}
    while True:
        out: list[list] = []
        for at in sorted({n[0] for n in notes.values()}):
            note = max((n for n in notes.values() if n[0] == at), key=lambda n: (sign * n[2], sign * (n[1] - n[0]), sign * n[3]))
            last = out[-1] if out else None
            if last is None or last[1] <= at:
                out.append(note)
            elif sign * note[2] > sign * last[2]:
                if last[4]:
                    del notes[last[3], last[0]]
                    warned.append(OVER_TUPLET)
                    break
                last[1] = at
                warned.append(OVER)
                out.append(note)
            elif note[1] > last[1] and not note[4]:
                del notes[note[3], at]
                notes[note[3], last[1]] = [last[1], note[1], note[2], note[3], False]
                warned.append(MAKEUP)
                break
        else:
            return [(n[3], n[0], n[1]) for n in out], warned


def swept(notes: DataFrame, keep: str = "high") -> DataFrame:
    """BAR, id, start, end, pitches, tuplet, warning: the notes of the line, and, with no id, one row for each warning of its bar."""

    def work(rows: list[tuple]) -> list[tuple]:
        out, warned = sweep([r[:5] for r in rows], keep == "high")
        own = {r[3]: r[4:] for r in rows}
        return [(i, s, e, own[i][1], own[i][0], None) for i, s, e in out] + [(None, None, None, None, None, w) for w in warned]

    return each_bar(notes, work, "id long, start long, end long, pitches array<int>, tuplet boolean, warning string", ("start", "end", "height", "id", "tuplet", "pitches"))


def notes_of(line: DataFrame) -> DataFrame:
    """The notes of what swept() gives."""
    return line.where("id is not null").drop("warning")


def skyline(notes: DataFrame, keep: str = "high") -> DataFrame:
    """BAR, id, start, end, pitches, tuplet: the compound notes of the high (low) line, cut as the sweep says."""
    return notes_of(swept(notes, keep))


def only_low(low: DataFrame, melody: DataFrame) -> DataFrame:
    """The low line without the notes that the melody has too (same interval, same pitches)."""
    same = [*BAR, "start", "end", "pitches"]
    return low.join(melody.select(*same), same, "left_anti").select(*low.columns)


def bass_of(elements: DataFrame, melody: DataFrame, most: int = MOST) -> DataFrame:
    return only_low(skyline(compound(elements, "low", most), "low"), melody)


# The grid


def placed(line: DataFrame, room: DataFrame, slot: int = SLOT) -> DataFrame:
    """BAR, start, end, pitches, tuplet, how: whole bars on the grid. room: BAR, room of every bar that the line is to have.

    Bars whose notes all start on the grid and last whole slots stay as they are (how: kept); in others each slot goes to the note
    that sounds longest in it, the first of equals, and a note gets its slots in a row (how: dealt). Gaps become rests (how: gap).
    """
    rows = line.join(room, list(BAR))
    off = F.max(((F.col("start") % slot != 0) | ((F.col("end") - F.col("start")) % slot != 0) | (F.col("end") > F.col("room"))).cast("int")).over(Window.partitionBy(*BAR))
    rows = rows.withColumn("off", off)
    kept = rows.where("off = 0").select(*BAR, "room", "start", "end", "pitches", "tuplet", F.lit("kept").alias("how"))
    out = rows.where("off = 1").withColumn("slot", F.explode(F.sequence(F.floor(F.col("start") / slot), F.floor((F.col("end") - 1) / slot)))).where(F.col("slot") < F.floor(F.col("room") / slot))
    overlap = F.least("end", (F.col("slot") + 1) * slot) - F.greatest("start", F.col("slot") * slot)
    first = F.row_number().over(Window.partitionBy(*BAR, "slot").orderBy(F.desc("overlap"), "start", "id"))
    out = out.withColumn("overlap", overlap).withColumn("rn", first).where("rn = 1")
    out = out.withColumn("island", F.col("slot") - F.row_number().over(Window.partitionBy(*BAR, "id", "start").orderBy("slot")))
    out = out.groupBy(*BAR, "room", "id", "start", "island").agg(F.min("slot").alias("a"), F.max("slot").alias("z"), F.first("pitches").alias("pitches"), F.first("tuplet").alias("tuplet"))
    out = out.select(*BAR, "room", (F.col("a") * slot).alias("start"), ((F.col("z") + 1) * slot).alias("end"), "pitches", "tuplet", F.lit("dealt").alias("how"))
    return filled(kept.unionByName(out), room)


def filled(notes: DataFrame, room: DataFrame) -> DataFrame:
    """notes (without overlaps) and rests in the gaps between them, up to the end of the bar; bars without notes are one rest."""
    w = Window.partitionBy(*BAR).orderBy("start", "end")
    rows = notes.withColumns({"before": F.coalesce(F.lag("end").over(w), F.lit(0)), "after": F.lead("start").over(w)})
    rest = lambda a, z: F.struct(a.cast("long").alias("start"), z.cast("long").alias("end"), F.array(F.lit(-1)).alias("pitches"), F.lit(False).alias("tuplet"), F.lit("gap").alias("how"))
    own = F.struct(*(F.col(c) for c in ("start", "end", "pitches", "tuplet", "how")))
    parts = F.array_compact(F.array(F.when(F.col("start") > F.col("before"), rest(F.col("before"), F.col("start"))), own, F.when(F.col("after").isNull() & (F.col("end") < F.col("room")), rest(F.col("end"), F.col("room")))))
    got = rows.select(*BAR, F.explode(parts).alias("x")).select(*BAR, "x.*")
    empty = room.join(notes.select(*BAR).distinct(), list(BAR), "left_anti").where("room > 0").select(*BAR, rest(F.lit(0), F.col("room")).alias("x")).select(*BAR, "x.*")
    return got.unionByName(empty)


def plain(notes: DataFrame, slot: int = SLOT) -> DataFrame:
    """Tuplets whose equal shares lie on the grid as plain notes (how: shared), and neighbouring rests as one."""
    length = F.col("end") - F.col("start")
    n = F.size("pitches")
    even = F.col("tuplet") & (length % (n * slot) == 0)
    share = F.floor(length / n)
    parts = F.when(even, F.transform("pitches", lambda p, i: F.struct((F.col("start") + i * share).cast("long").alias("start"), (F.col("start") + (i + 1) * share).cast("long").alias("end"), F.array(p).alias("pitches"), F.lit(False).alias("tuplet"), F.lit("shared").alias("how"))))
    one = F.array(F.struct(*(F.col(c) for c in ("start", "end", "pitches", "tuplet", "how"))))
    rows = notes.select(*BAR, F.explode(F.coalesce(parts, one)).alias("x")).select(*BAR, "x.*")
    w = Window.partitionBy(*BAR).orderBy("start")
    rest = F.col("pitches") == F.array(F.lit(-1))
    rows = rows.withColumn("rest", rest).withColumn("new", (~(F.col("rest") & F.coalesce(F.lag("rest").over(w), F.lit(False)))).cast("int"))
    rows = rows.withColumn("nth", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*BAR, "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("pitches").alias("pitches"), F.first("tuplet").alias("tuplet"), F.max("how").alias("how")).drop("nth")


def validity(notes: DataFrame, room: DataFrame) -> DataFrame:
    """BAR, valid: whether the notes of a bar follow each other without gap or overlap, last some time each, and fill it."""
    before = F.lag("end").over(Window.partitionBy(*BAR).orderBy("start", "end"))
    rows = notes.withColumn("fits", (F.coalesce(before, F.lit(0)) == F.col("start")) & (F.col("end") > F.col("start")))
    got = rows.groupBy(*BAR).agg(F.bool_and("fits").alias("fits"), F.max("end").alias("end")).join(room, list(BAR), "right")
    return got.select(*BAR, F.coalesce(F.col("fits") & (F.col("end") == F.col("room")), F.lit(False)).alias("valid"))


def note_text(slot: int = SLOT) -> Column:
    """A note's tokens: pitch and duration, or a tuplet's pitches and its whole duration between marks."""
    pitches = F.array_join(F.transform("pitches", S.pitch_token), " ")
    duration = S.slots_token(((F.col("end") - F.col("start")) / slot).cast("long"))
    text = F.concat_ws(" ", pitches, duration)
    return F.when(F.col("tuplet"), F.concat_ws(" ", F.lit("<tup>"), text, F.lit("</tup>"))).otherwise(text)


# Several groups: hulls, packing, unrolling


def hulls(members: DataFrame) -> DataFrame:
    """BAR, hull, start, end, n: overlapping notes (BAR, start, end) melt into one hull; touching ones stay apart."""
    w = Window.partitionBy(*BAR).orderBy("start", "end")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = members.withColumn("new", (reached.isNull() | (F.col("start") >= reached)).cast("int"))
    rows = rows.withColumn("hull", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*BAR, "hull").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))


def unrolled(notes: DataFrame) -> DataFrame:
    """BAR, nth, k, n, start, dur, midi: compound notes (BAR, start, end, pitches) as single ones, back to back in ticks.

    Shares of a tuplet are whole ticks; what does not divide goes to its last note, so nothing is lost.
    """
    nth = F.row_number().over(Window.partitionBy(*BAR).orderBy("start", "end", "pitches"))
    length, n = F.col("end") - F.col("start"), F.size("pitches")
    rows = notes.select(*BAR, nth.alias("nth"), length.alias("length"), n.alias("n"), "pitches")
    rows = rows.select(*BAR, "nth", "length", "n", F.posexplode("pitches").alias("k", "midi"))
    share = F.floor(F.col("length") / F.col("n")).cast("long")
    rows = rows.withColumn("dur", F.when(F.col("k") == F.col("n") - 1, F.col("length") - share * (F.col("n") - 1)).otherwise(share))
    upto = F.sum("dur").over(Window.partitionBy(*BAR).orderBy("nth", "k"))
    return rows.select(*BAR, "nth", "k", "n", (upto - F.col("dur")).alias("start"), "dur", "midi")


def packed(singles: DataFrame) -> DataFrame:
    """BAR, nth, start, end, pitches: the compound notes that unrolled() has taken apart."""
    got = singles.groupBy(*BAR, "nth").agg(F.min("start").alias("start"), F.sum("dur").alias("dur"), F.array_sort(F.collect_list(F.struct("k", "midi"))).alias("x"))
    return got.select(*BAR, "nth", "start", (F.col("start") + F.col("dur")).alias("end"), F.transform("x", lambda x: x["midi"]).alias("pitches"))
