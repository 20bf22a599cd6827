"""Mixing sources to target weights: how often each document is taken, so that each source comes near its share of words.

Words are summed by source; a source's target is its weight's share of all that the mix takes, but no more than `most` times its
own words: what is over goes to the others by their weights (a water level, found in rounds of sums over the sources). A source's
rate is its target by its words; each document is taken floor(rate) times, and once more with the rest as probability.

That last copy is decided by a draw of the document's own (a seeded hash of its id). Only documents that hold a thousandth or
more of their source's words (a thousand a source at most) share one draw of the source: each still has the same probability,
but they are taken in turns, so that no single long document moves a source far from its target.

Defined cases: a null text has no words; documents without words and sources without any take nothing. Null sources are one
source, the last. Rows with the same id draw the same number; rows without an id share one. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, MOST = (5, 2, 1), (3, 2), 2
#: A document with this share of its source's words draws together with its like.
HEAVY = 1000
SEED = "mix"


def n_words(text: Column) -> Column:
    """Words between white space of ASCII."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(*parts: Column) -> Column:
    """A number in [0, 1) from the first 60 bits of an md5 over the seed and the parts."""
    text = F.concat_ws("|", F.lit(SEED), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") / F.lit(float(1 << 60))


def weighted(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """sizes (source, source_size) and weight: sources by code point, null last, take the weights in turn.

    Sources are sorted by ranges and counted by partition, so their number may grow.
    """
    order = F.asc_nulls_last("source")
    rows = sizes.repartitionByRange(common.partitions(sizes.sparkSession), order).sortWithinPartitions(order)
    rows = common.cut(rows.withColumns({"part": F.spark_partition_id(), "k": F.monotonically_increasing_id()}))
    parts = rows.groupBy("part").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    parts = parts.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a partition
    nth = F.col("before") + F.col("k") - F.col("first")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int")).cast("long")
    return common.cut(rows.join(F.broadcast(parts), "part").select("source", "source_size", turn.alias("weight")))


def full(level: tuple[int, int], most: int) -> Column:
    """Whether a source's limit lies below its weight's part of the level (a fraction); exact."""
    whole = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of two have 38 digits
    return whole(F.col("source_size") * most) * whole(F.lit(level[1])) < whole(F.col("weight")) * whole(F.lit(level[0]))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target. Each round takes the sources that are over their limit out; the level rises until none is."""
    if share[0] > most * share[1]:
        raise ValueError("the mix cannot take more than every source's limit")
    rows = weighted(sizes, weights)
    every = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
    level, out = (share[0] * every.s, share[1] * max(every.w, 1)), 0
    while True:
        over = rows.where(full(level, most)).agg(F.count("*").alias("n"), F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
        if over.n == out or over.w == every.w:
            break
        level, out = (share[0] * every.s - share[1] * most * over.s, share[1] * (every.w - over.w)), over.n
    target = F.when(full(level, most), (F.col("source_size") * most).cast("double")).otherwise((F.col("weight") * F.lit(level[0])).cast("double") / F.lit(float(level[1])))
    return rows.select("source", "source_size", target.alias("target"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size of every document."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))


def rated(rows: DataFrame, aims: DataFrame, most: int) -> DataFrame:
    """rows (source, size and others) with source_size, target, rate, and whether they are heavy in their source."""
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = common.with_group(rows, aims, "source").withColumn("rate", rate)
    return rows.withColumns({"rest": F.col("rate") - F.floor("rate"), "heavy": (F.col("size") > 0) & (F.col("size") * HEAVY >= F.col("source_size"))})


def copied(rows: DataFrame, sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """rows (doc_id, source, size and others) with source_size, target, copies. sizes: doc_id, source, size of all documents.

    Rows alike in id, source and size are taken alike. Only heavy documents (HEAVY a source at most) are sorted and joined.
    """
    sizes = common.cut(sizes)
    aims = common.cut(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    in_turn = Window.partitionBy("source").orderBy(F.desc("size"), draw(F.col("doc_id")), F.asc_nulls_last("doc_id"))
    heavy = rated(sizes, aims, most).where("heavy").withColumn("at", F.row_number().over(in_turn))
    start = draw(F.col("source"), F.lit("source"))
    turns = heavy.withColumn("more", F.floor(start + F.col("rest") * F.col("at")) - F.floor(start + F.col("rest") * (F.col("at") - 1)))
    turns = common.cut(turns.groupBy(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "size"))).agg(F.max("more").alias("_more")))
    if turns.count() <= common.MAX_BROADCAST_GROUPS:
        turns = F.broadcast(turns)
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    found = rated(rows, aims, most).join(turns, same, "left")
    more = F.when(F.col("heavy"), F.col("_more")).otherwise((draw(F.col("doc_id")) < F.col("rest")).cast("long"))
    copies = F.when(F.col("size") > 0, F.floor("rate") + more).otherwise(0).cast("long")
    return found.select(*rows.columns, "source_size", "target", copies.alias("copies"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies x size) of every document; texts are read once."""
    sizes = common.cut(measured(docs))
    return copied(sizes, sizes, **options).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: every row as often as it is taken, with the number of the copy. Texts are not shuffled."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    found = copied(rows, measured(docs), **options).where("copies > 0")
    return found.select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
