"""Notes as intervals on a grid: gaps, overlaps, rests, quantization, carried values, skylines."""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

BAR = ("song_id", "part", "bar")


def ordered(*more: str):
    return Window.partitionBy(*BAR).orderBy("start", "end", "midi", "id", *more)


def gaps(notes: DataFrame, bar_slots: int = 32) -> DataFrame:
    """BAR, has_gap, has_overlap, covered: between each note and the one before it, and up to the end of the bar."""
    rows = notes.withColumn("before", F.coalesce(F.lag("end").over(ordered()), F.lit(0)))
    return rows.groupBy(*BAR).agg(
        (F.bool_or(F.col("start") > F.col("before")) | (F.max_by("end", F.struct("start", "end", "midi", "id")) < bar_slots)).alias("has_gap"),
        F.bool_or(F.col("start") < F.col("before")).alias("has_overlap"), F.sum(F.col("end") - F.col("start")).cast("long").alias("covered"),
    )


def rests(notes: DataFrame, bar_slots: int = 32) -> DataFrame:
    """BAR, start, end of the stretches of each bar that no note sounds in."""
    running = ordered().rowsBetween(Window.unboundedPreceding, -1)
    rows = notes.withColumn("reached", F.coalesce(F.max("end").over(running), F.lit(0)))
    inner = rows.where("start > reached").select(*BAR, F.col("reached").alias("start"), F.col("start").alias("end"))
    tail = notes.groupBy(*BAR).agg(F.max("end").alias("start")).where(F.col("start") < bar_slots).withColumn("end", F.lit(bar_slots))
    return inner.unionByName(tail.select(*BAR, "start", "end"))


def joined_rests(notes: DataFrame) -> DataFrame:
    """BAR, start, end, midi: neighbouring rests (midi -1) as one, other notes as they are."""
    rest, w = F.col("midi") == -1, ordered()
    rows = notes.withColumn("new", (~(rest & (F.lag("midi").over(w) == -1) & (F.lag("end").over(w) == F.col("start")))) | F.lag("midi").over(w).isNull())
    rows = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*BAR, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("midi").alias("midi")).drop("run")


def quantized(notes: DataFrame, bar_units: int = 32, unit: int = 2) -> DataFrame:
    """BAR, slot, id: the note that sounds longest in each slot of `unit` grid steps, the first of equals.

    Notes are dealt out to the slots they touch, so the overlap join is an equality of slots.
    """
    rows = notes.where("end > start").withColumn("slot", F.explode(F.sequence(F.floor(F.col("start") / unit).cast("int"), F.floor((F.col("end") - 1) / unit).cast("int"))))
    rows = rows.where(F.col("slot") < bar_units // unit)
    overlap = F.least("end", (F.col("slot") + 1) * unit) - F.greatest("start", F.col("slot") * unit)
    w = Window.partitionBy(*BAR, "slot").orderBy(F.desc("overlap"), "start", "end", "midi", "id")
    return rows.withColumn("overlap", overlap).withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*BAR, "slot", "id", "midi")


def runs(slots: DataFrame) -> DataFrame:
    """BAR, id, first, n: neighbouring slots with the same note, run-length encoded."""
    w = Window.partitionBy(*BAR, "id").orderBy("slot")
    rows = slots.withColumn("island", F.col("slot") - F.row_number().over(w))
    return rows.groupBy(*BAR, "id", "island").agg(F.min("slot").alias("first"), F.count("*").alias("n")).drop("island")


def slot_top(notes: DataFrame) -> DataFrame:
    """BAR, slot, midi: the highest pitch sounding in each grid step (the skyline where notes may be cut anywhere)."""
    rows = notes.where("end > start").withColumn("slot", F.explode(F.sequence(F.col("start"), F.col("end") - 1)))
    return rows.groupBy(*BAR, "slot").agg(F.max("midi").alias("midi"))


def simultaneous(notes: DataFrame, by: tuple[str, ...] = BAR) -> DataFrame:
    """by, start, end, n: how many notes sound in each stretch between two starts or ends; silent stretches are left out.

    A note counts +1 where it starts and -1 where it ends, so no time is dealt out in steps.
    """
    steps = notes.where("end > start").select(*by, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy(*by, F.col("x.at").alias("start")).agg(F.sum("x.d").alias("d")).where("d <> 0")
    w = Window.partitionBy(*by).orderBy("start")
    rows = steps.withColumns({"n": F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)), "end": F.lead("start").over(w)})
    return rows.where("n > 0").select(*by, "start", "end", "n")


def changes(rows: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """rows whose value differs from the one before in order, the first ones included; nulls stand for no change."""
    w = Window.partitionBy(*keys).orderBy(*order)
    known = rows.where(F.col(column).isNotNull()).withColumn("_before", F.lag(column).over(w))
    return known.where(F.col("_before").isNull() | (F.col("_before") != F.col(column))).drop("_before")


def carried(rows: DataFrame, keys: list[str], order: list[str], column: str, default) -> DataFrame:
    """rows with nulls of a column filled from the row before (as-of), or with the default where none is."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.coalesce(F.last(column, True).over(w), F.lit(default)))


def skyline(notes: DataFrame, keep: str = "high") -> DataFrame:
    """BAR, id, start, end, midi: the greedy sweep. The last note of a start (highest, or lowest) competes with what sounds.

    A better note cuts the one before it short; a worse one that lasts longer is put back with what remains of it. One
    bar is one group (a bar holds a bounded number of notes), so state stays small.
    """
    high = keep == "high"

    def better(a: int, b: int) -> bool:
        return a > b if high else a < b

    def sweep(rows: list[tuple]) -> list[tuple]:
        groups: dict[int, list] = {}
        for start, end, midi, i in rows:
            if end > start:
                groups.setdefault(start, []).append([start, end, midi, i])
        while True:
            out, last, again = [], 0, False
            for start in sorted(groups):
                if not groups[start]:
                    continue
                note = max(groups[start], key=lambda n: (n[2] if high else -n[2], n[1] if high else -n[1], n[3]))
                if last <= start:
                    out.append(list(note))
                    last = note[1]
                elif better(note[2], out[-1][2]):
                    out[-1][1] = start
                    for g in groups.get(out[-1][0], []):  # it stays short if the sweep begins again
                        if g[3] == out[-1][3]:
                            g[1] = start
                    if out[-1][1] <= out[-1][0]:
                        gone = out.pop()
                        groups[gone[0]] = [g for g in groups[gone[0]] if g[3] != gone[3]]
                    out.append(list(note))
                    last = note[1]
                elif note[1] > last:
                    groups[start].remove(note)
                    groups.setdefault(last, []).append([last, note[1], note[2], note[3]])
                    again = True
                    break
            if not again:
                return [(i, start, end, midi) for start, end, midi, i in out]

    return each_bar(notes, sweep, "id long, start int, end int, midi int")


ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def each_bar(notes: DataFrame, work, schema: str, of: tuple[str, ...] = ("start", "end", "midi", "id")) -> DataFrame:
    """BAR and the columns of schema: work(rows) of each bar, rows of the columns `of`, in their order.

    Bars come one after the other from sorted partitions, many to a batch; one bar alone is held back between batches.
    """
    columns = [*BAR, *of]
    kinds = {f.name: f.dataType.simpleString() for f in notes.schema}
    names = [*BAR, *(c.split()[0] for c in schema.split(", "))]

    def run(batches):
        held: list[tuple] = []

        def done(rows: list[tuple]) -> list[tuple]:
            out = []
            for key, group in groupby(rows, key=lambda r: r[: len(BAR)]):
                out += [(*key, *r) for r in work([g[len(BAR) :] for g in group])]
            return out

        for b in batches:
            held += zip(*(b.column(k).to_pylist() for k in range(len(columns))), strict=True)
            last = held[-1][: len(BAR)] if held else None
            whole = next((k for k in range(len(held), 0, -1) if held[k - 1][: len(BAR)] != last), 0)
            if whole:
                yield done(held[:whole])
                held = held[whole:]
        yield done(held)

    def arrow(batches):
        for rows in run(batches):
            cols = zip(*rows, strict=True) if rows else [[]] * len(names)
            kinds_ = [pa.int64() if kinds[c] == "bigint" else pa.int32() if kinds[c] == "int" else pa.string() for c in BAR] + [ARROW[c.split()[1]] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds_, strict=True)], names=names)

    sorted_ = notes.select(*columns).repartition(*BAR).sortWithinPartitions(*columns)
    return sorted_.mapInArrow(arrow, ", ".join(f"{c} {kinds[c]}" for c in BAR) + f", {schema}")


def bass_of(notes: DataFrame, melody: DataFrame) -> DataFrame:
    """Notes of the low skyline that equal no melody note in start, end and pitch."""
    low = skyline(notes.where("midi >= 0"), "low")
    return low.join(melody.select(*BAR, "start", "end", "midi"), [*BAR, "start", "end", "midi"], "left_anti").select(*low.columns)


def tuplets(elements: DataFrame, n: int = 3, unit_slots: int = 4) -> DataFrame:
    """BAR, id, tuplet: elements of a stretch are grouped until there are n and their total is a multiple of the unit.

    A short rest of a stretch joins the group before it when its total is such a multiple too; other rests have no group (-1).
    """

    def group(rows: list[tuple]) -> list[tuple]:
        number, count, total, first, labels = 0, 0, 0, 0, []
        for k, (start, end, _, _) in enumerate(rows):
            labels.append(number)
            count, total = count + 1, total + end - start
            if count >= n and total % unit_slots == 0:
                number, count, total, first = number + 1, 0, 0, k + 1
        if count:
            mark = number - 1 if total % unit_slots == 0 and number else -1
            labels[first:] = [mark] * (len(labels) - first)
        return [(r[3], label) for r, label in zip(rows, labels, strict=True)]

    return each_bar(elements, group, "id long, tuplet int")


def tuplet_chunks(notes: DataFrame, by: list[str], order: list[str], kind: str, size: int) -> DataFrame:
    """notes and chunk: neighbours of the same non-null kind in groups of `size`, numbered within `by`; null elsewhere."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.col(kind).isNotNull() & ~F.lag(kind).over(w).eqNullSafe(F.col(kind))
    rows = notes.withColumn("run", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"_at": F.row_number().over(w), "_new": F.coalesce(new, F.lit(False))})
    nth = F.col("_at") - F.max(F.when(F.col("_new"), F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, 0))  # a run's rows of the kind stand together
    chunk = F.concat_ws("/", F.col("run"), F.floor(nth / size).cast("int"))
    return rows.withColumn("chunk", F.when(F.col(kind).isNotNull(), chunk)).drop("run", "_at", "_new")


def plain_tuplets(groups: DataFrame, size: str = "n", total: str = "slots") -> DataFrame:
    """Groups, one row each, and parts: those whose equal shares lie on the grid become that many plain notes, others stay one."""
    share = F.col(total) / F.col(size)
    even = F.col(total) % F.col(size) == 0
    parts = F.when(even, F.array_repeat(share.cast("long"), F.col(size).cast("int"))).otherwise(F.array(F.col(total).cast("long")))
    return groups.select("*", F.posexplode(parts).alias("k", "part"), (~even).alias("tuplet"))
