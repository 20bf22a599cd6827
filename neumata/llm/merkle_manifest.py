"""Merkle manifest of a data set: leaves of rows, a tree for each group of rows, a tree over the groups, and a proof for each row.

Leaves are numbered within their group by a range sort, so a hot group is spread over tasks. Large blocks of neighbouring nodes
are reduced to one node each, over the cluster, again and again until few are left. The driver builds the tree on top of these
(TOP nodes at most) and broadcasts the path from each to the root; executors put it behind the paths inside their block and
finish proofs and folds row by row. Where several reductions are needed, paths go down from one to the next through a shuffle
by block.

Defined cases: null columns count as `-` (an empty text as `0:`). Null ids come first, null groups too; rows with equal group and
id are ordered by their leaf, so repeated rows keep their place. A group of one row has its leaf as subroot; a single group's
subroot is the root. An empty table gives no rows. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Children of a node, leaves of a block (a power of it), nodes that may go to the driver.
ARITY, BLOCK, TOP = 3, 3**7, 20_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A value with its length in front, so that neighbouring values cannot run into each other."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def stripped(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(""))


def leaves(docs: DataFrame, tampered: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, other: other is the leaf of the row with the tampered columns where the condition holds, else null."""
    other = F.lit(None).cast("string") if tampered is None else F.when(where, leaf(*((tampered or {}).get(c, F.col(c)) for c in COLUMNS)))
    return docs.select("doc_id", "source", leaf(*map(F.col, COLUMNS)).alias("leaf"), other.alias("other"))


def numbered(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, other, tree (number of the source, in order), idx (in the source, by doc_id), n (of the source).

    Rows are sorted by ranges; a row's number is its place in its partition and the rows of its source in the partitions before.
    What is counted by partition and source has at most partitions + sources rows.
    """
    order = [F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.col("leaf"), F.col("tie")]
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(common.partitions(rows.sparkSession), *order).sortWithinPartitions(*order).drop("tie")
    spread = common.cut(spread.withColumns({"part": F.spark_partition_id(), "k": F.monotonically_increasing_id()}))
    held = spread.groupBy("part", "source").agg(F.min("k").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("source").orderBy("part")
    held = held.withColumns({"upto": F.sum("rows").over(before) - F.col("rows"), "n": F.sum("rows").over(Window.partitionBy("source"))})
    held = held.withColumn("opens", (F.col("upto") == 0).cast("long")).withColumn("local", F.sum("opens").over(Window.partitionBy("part").orderBy("first")))
    opened = held.groupBy("part").agg(F.sum("opens").alias("opened"))
    opened = opened.withColumn("earlier", F.sum("opened").over(Window.orderBy("part")) - F.col("opened")).drop("opened")  # one row a partition
    held = held.join(F.broadcast(opened), "part").select("part", F.col("source").alias("of"), "first", "upto", "n", (F.col("earlier") + F.col("local") - 1).alias("tree"))
    held = common.cut(held)
    if held.count() <= common.MAX_BROADCAST_GROUPS:
        held = F.broadcast(held)
    at = (spread["part"] == held["part"]) & spread["source"].eqNullSafe(held["of"])
    return spread.join(held, at).select("doc_id", "leaf", "other", "tree", (F.col("upto") + F.col("k") - F.col("first")).alias("idx"), "n")


def hashed(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def heights(n: int, block: int) -> int:
    """Levels that a block of a tree of n nodes is reduced by: to one node, but no more than a whole block needs."""
    levels, left = 0, 1
    while left < min(n, block):
        left *= ARITY
        levels += 1
    return levels


def grown(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them."""
    out = [nodes]
    for _ in range(levels):
        out.append([hashed(out[-1][k : k + ARITY]) for k in range(0, len(out[-1]), ARITY)])
    return out


def path(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """What stands left and right of node i's way up, level by level."""
    steps = []
    for level in levels[:-1]:
        first = i - i % ARITY
        steps.append(("".join(level[first:i]), "".join(level[i + 1 : first + ARITY])))
        i //= ARITY
    return steps


def written(steps: list[tuple[str, str]]) -> str:
    return "/".join(f"{a}.{b}" for a, b in steps)


def read(text: str) -> list[tuple[str, str]]:
    return [tuple(s.split(".")) for s in text.split("/")] if text else []


def folded(node: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        node = sha256(f"{left}{node}{right}".encode()).hexdigest()
    return node


def in_blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
    """((tree, block), rows) one after the other. Rows come sorted by tree and idx, as (tree, at, ...); one block is held at a time."""
    held: list[tuple] = []
    for b in batches:
        held += zip(*(c.to_pylist() for c in b.columns), strict=True)
        keys = [r[:2] for r in held]
        end = next((k for k in range(len(held), 0, -1) if keys[k - 1] != keys[-1]), 0)
        for key, rows in groupby(held[:end], key=lambda r: r[:2]):
            yield key, list(rows)
        held = held[end:]
    for key, rows in groupby(held, key=lambda r: r[:2]):
        yield key, list(rows)


def blocked(nodes: DataFrame, block: int) -> DataFrame:
    """nodes, dealt out by blocks and sorted; `at` is the number of the block."""
    rows = nodes.withColumn("at", F.floor(F.col("idx") / block).cast("long"))
    return common.cut(rows.repartition("tree", "at").sortWithinPartitions("tree", "at", "idx"))


def reduced(level: DataFrame, block: int) -> DataFrame:
    """tree, idx, n, leaf: one node for each block of a level."""

    def run(batches):
        out = []
        for (tree, at), rows in in_blocks(batches, block):
            n = rows[0][2]
            out.append((tree, at, -(-n // block), grown([r[3] for r in rows], heights(n, block))[-1][0]))
            if len(out) == 1024:
                yield batch(out, NODE)
                out = []
        yield batch(out, NODE)

    return level.select("tree", "at", "n", "leaf").mapInArrow(run, "tree long, idx long, n long, leaf string")


NODE = {"tree": pa.int64(), "idx": pa.int64(), "n": pa.int64(), "leaf": pa.string()}


def batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def topped(nodes: list[tuple[int, int, str]]) -> tuple[dict[tuple[int, int], tuple[str, str]], str]:
    """({(tree, idx): (path to the root, subroot)}, root) of the few nodes (tree, idx, digest) that are left."""
    trees = {t: [d for _, _, d in rows] for t, rows in groupby(sorted(nodes), key=lambda x: x[0])}
    levels = {t: grown(d, heights(len(d), len(d))) for t, d in trees.items()}
    over = grown([up[-1][0] for up in levels.values()], heights(len(levels), len(levels)))
    found = {}
    for k, (t, up) in enumerate(levels.items()):
        above = path(over, k)
        for i in range(len(up[0])):
            found[t, i] = written(path(up, i) + above), up[-1][0]
    return found, over[-1][0]


def manifest(rows: DataFrame, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """doc_id, leaf, subroot, root, proof, proof_sha256, folded_root, verified for each row of leaves().

    proof: `left.right` siblings of each level, joined by `/`, from the leaf's run to the root's; proof_sha256 is over the siblings
    alone. folded_root: the root that the other leaf (else the leaf itself) gives with this proof.
    """
    if block < ARITY or ARITY ** heights(block, block) != block:
        raise ValueError(f"a block has a power of {ARITY} rows")
    spark = rows.sparkSession
    levels = [blocked(numbered(rows), block)]
    grouped = None  # the number of levels when every source has one node and sources become the nodes of one tree
    while True:
        nodes = common.cut(reduced(levels[-1], block))
        left = nodes.agg(F.count("*"), F.max("n")).first()
        if left[0] <= top:
            break
        if left[1] <= 1:
            grouped = len(levels)
            nodes = nodes.select(F.lit(-1).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(left[0]).alias("n"), "leaf")
        levels.append(blocked(nodes, block))
    found, root = topped([(r.tree, r.idx, r.leaf) for r in nodes.collect()]) if left[0] else ({}, "")  # at most `top` rows
    paths = spark.sparkContext.broadcast(found)
    for k in range(len(levels) - 1, 0, -1):
        down = descended(levels[k], block, paths, k == grouped)
        if k == grouped:
            down = down.select(F.col("idx").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", "leaf")
        paths = down
    return proved(levels[0], rows, block, paths, root)


def with_paths(level: DataFrame, paths, columns: list[str]) -> DataFrame:
    """Blocks of a level; where their paths are a table, each block's first row (idx -1) brings its path and subroot."""
    rows = level.select("tree", "at", "idx", "n", "leaf", *columns)
    if not isinstance(paths, DataFrame):
        return rows
    kinds = {f.name: f.dataType for f in rows.schema}
    heads = paths.select("tree", F.col("idx").alias("at"), F.lit(-1).cast("long").alias("idx"), F.lit(0).cast("long").alias("n"), F.concat_ws(" ", "path", "leaf").alias("leaf"), *(F.lit(None).cast(kinds[c]).alias(c) for c in columns))
    return rows.unionByName(heads).repartition("tree", "at").sortWithinPartitions("tree", "at", "idx")


def opened(key: tuple[int, int], rows: list[tuple], paths) -> tuple[list[tuple], str, str]:
    """(rows of the block, its path, its subroot)."""
    if rows[0][2] == -1:
        above, subroot = rows[0][4].rsplit(" ", 1)
        return rows[1:], above, subroot
    return rows, *paths[key]


def descended(level: DataFrame, block: int, paths, single: bool) -> DataFrame:
    """tree, idx, path, leaf (the subroot) for each node of a level. single: its nodes are the subroots themselves."""
    shared = None if isinstance(paths, DataFrame) else paths

    def run(batches):
        for key, rows in in_blocks(batches, block):
            nodes, above, subroot = opened(key, rows, shared.value if shared else None)
            up, out = grown([r[4] for r in nodes], heights(nodes[0][3], block)), []
            for i, r in enumerate(nodes):
                out.append((r[0], r[2], written(path(up, i) + read(above)), r[4] if single else subroot))
            yield batch(out, {"tree": pa.int64(), "idx": pa.int64(), "path": pa.string(), "leaf": pa.string()})

    return with_paths(level, paths, []).mapInArrow(run, "tree long, idx long, path string, leaf string")


def proved(level: DataFrame, rows: DataFrame, block: int, paths, root: str) -> DataFrame:
    shared = None if isinstance(paths, DataFrame) else paths
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        kinds = {"doc_id": first["doc_id"].type} | dict.fromkeys(("leaf", "subroot", "root", "proof", "proof_sha256", "folded_root"), pa.string()) | {"verified": pa.bool_()}

        def every():
            yield first
            yield from batches

        for key, held in in_blocks(every(), block):
            nodes, above, subroot = opened(key, held, shared.value if shared else None)
            up, behind, out = grown([r[4] for r in nodes], heights(nodes[0][3], block)), read(above), []
            for i, (_, _, _, _, own, doc_id, other) in enumerate(nodes):
                steps = path(up, i) + behind
                got = folded(own if other is None else other, steps)
                out.append((doc_id, own, subroot, root, written(steps), hashed([s for pair in steps for s in pair]), got, got == root))
            yield batch(out, kinds)

    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string, verified boolean"
    return with_paths(level, paths, ["doc_id", "other"]).mapInArrow(run, schema)


def tampered(docs: DataFrame) -> DataFrame:
    """leaves() of documents, where rows whose id has an even crc32 lose the line ends of their texts. A null id is never tampered with."""
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    return leaves(docs, {"text": stripped(F.col("text").cast("string"))}, even)
