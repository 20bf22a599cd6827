"""Vector codes: product codebooks by Lloyd's rounds with Hamerly's bounds, in exact integers.

Every vector keeps, for each of its parts, its entry, an upper bound of the distance to it and one lower bound of the distance
to any other entry. When entries move, bounds move with them; a part is measured against the whole codebook only where the
upper bound is not strictly below the lower one, so ties always go through the full scan and to the lower index.

Vectors stay on the executors: each round reads the state of the round before from the shared folder and writes its own, with
sums by entry. The driver holds the codebooks and their sums (parts x entries x part length), whatever the number of vectors.

Defined cases: null vectors and vectors with null or non-finite components are left out. Null vec_ids come last among first
entries; repeated rows count as often as they stand; of equal vec_ids the smaller vector comes first. With fewer vectors than
entries, codebooks are shorter. Vectors of another length than the first entry's get no code (null). Components beyond
+-65,536 raise an error, as their squared distances would not be exact. An empty table gives no rows. Other columns are left
out, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components up to this may go through floating-point products, which are exact below 2^53.
EXACT = 1 << 20
#: Larger components are refused.
MOST = 1 << 26
#: What bounds are widened by against rounding.
SLACK = 1e-9


def whole(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, x: the vectors that count, their components as whole numbers floor(scale * component)."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select("vec_id", "label", v.alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    refused = F.raise_error(F.lit(f"a component is too large for exact distances (over {MOST // scale})")).cast("int")
    return rows.select("vec_id", "label", F.transform("v", lambda c: F.when(F.abs(c) <= MOST / scale, F.floor(c * scale).cast("int")).otherwise(refused)).alias("x"))


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact."""
    big = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) > EXACT
    a, b = (x, book) if big else (x.astype(np.float64), book.astype(np.float64))
    return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]


def scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (of equals the first), upper bound of its distance, lower bound of the second nearest one's."""
    d = distances(x, book)
    rows, a = np.arange(len(x)), d.argmin(1)
    upper = np.sqrt(d[rows, a].astype(np.float64)) * (1 + SLACK)
    d = d.astype(np.float64)
    d[rows, a] = np.inf
    return a, upper, np.sqrt(d.min(1)) * (1 - SLACK)


def own(x: np.ndarray, book: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Squared distance of each row to its entry, exact."""
    return ((x - book[a]) ** 2).sum(1)


def drifts(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each entry moved, and how far any other one did at most."""
    moved = np.sqrt(((old - new) ** 2).sum(1).astype(np.float64)) * (1 + SLACK)
    others = np.array([np.delete(moved, k).max(initial=0.0) for k in range(len(moved))])
    return moved, others


def reassign(x: np.ndarray, old: np.ndarray, new: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """scan() of the new codebook by way of the old entries and bounds; the last is how many rows were scanned."""
    moved, others = drifts(old, new)
    a, upper, lower = a.copy(), upper + moved[a], lower - others[a]
    todo = np.flatnonzero(~(upper < lower))
    upper[todo] = np.sqrt(own(x[todo], new, a[todo]).astype(np.float64)) * (1 + SLACK)
    todo = todo[~(upper[todo] < lower[todo])]
    if len(todo):
        a[todo], upper[todo], lower[todo] = scan(x[todo], new)
    return a, upper, lower, len(todo)


def matrix(column, n: int, length: int, kind) -> np.ndarray:
    """A list column of equal lengths as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, length).astype(kind)


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(0, rows.size + 1, rows.shape[1] or 1, dtype=np.int32) if rows.size else np.zeros(len(rows) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel(), kind))


def fitting(b: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Rows with a vector, rows whose vector does not fit."""
    has = b["x"].is_valid()
    return b.filter(has), b.filter(pc.invert(has))


def placed(b: pa.RecordBatch, old: list[np.ndarray] | None, new: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, entries, upper, lower) of a batch under the new codebooks. old: the codebooks its state is of, none at first."""
    n, parts, size = b.num_rows, len(new), new[0].shape[1]
    x = matrix(b["x"], n, parts * size, np.int64)
    code, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts))
    state = None if old is None else [matrix(b[c], n, parts, k) for c, k in (("code", np.int64), ("upper", np.float64), ("lower", np.float64))]
    for p in range(parts):
        xp = x[:, p * size : (p + 1) * size]
        if state is None:
            code[:, p], upper[:, p], lower[:, p] = scan(xp, new[p])
        else:
            code[:, p], upper[:, p], lower[:, p], _ = reassign(xp, old[p], new[p], *(s[:, p] for s in state))
    return x, code, upper, lower


def state_schema(rows: DataFrame) -> StructType:
    own_ = [rows.schema["vec_id"], rows.schema["label"]]
    more = [("x", ArrayType(IntegerType())), ("code", ArrayType(IntegerType())), ("upper", ArrayType(DoubleType())), ("lower", ArrayType(DoubleType())), ("part", IntegerType()), ("entry", IntegerType()), ("n", LongType()), ("total", ArrayType(LongType()))]
    return StructType([*own_, *(StructField(n, k) for n, k in more)])


KINDS = {"code": pa.list_(pa.int32()), "upper": pa.list_(pa.float64()), "lower": pa.list_(pa.float64()), "part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "total": pa.list_(pa.int64())}


def filled(b: pa.RecordBatch, names: list[str], **columns: pa.Array) -> pa.RecordBatch:
    """vec_id, label and x of a batch with the given state columns; the others are null."""
    return pa.RecordBatch.from_arrays([b[c] if c in ("vec_id", "label", "x") else columns[c] if c in columns else pa.nulls(b.num_rows, KINDS[c]) for c in names], names=names)


def assigning(old: list[np.ndarray] | None, new: list[np.ndarray]):
    """State rows of each batch, and one row with count and sums for each entry that the task has used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, (k, size) = len(new), new[0].shape
        n, total, kinds = np.zeros((parts, k), np.int64), np.zeros((parts, k, size), np.int64), None
        names = ["vec_id", "label", "x", "code", "upper", "lower", "part", "entry", "n", "total"]
        for b in batches:
            kinds = [b["vec_id"].type, b["label"].type]
            b, unfit = fitting(b)
            yield filled(unfit, names)
            x, code, upper, lower = placed(b, old, new)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=k)
                np.add.at(total[p], code[:, p], x[:, p * size : (p + 1) * size])
            yield filled(b, names, code=lists(code, pa.int32()), upper=lists(upper, pa.float64()), lower=lists(lower, pa.float64()))
        if kinds is not None:
            p, e = np.nonzero(n)
            none = pa.RecordBatch.from_arrays([pa.nulls(len(p), t) for t in (*kinds, pa.list_(pa.int32()))], names=names[:3])
            yield filled(none, names, part=pa.array(p, pa.int32()), entry=pa.array(e, pa.int32()), n=pa.array(n[p, e], pa.int64()), total=lists(total[p, e], pa.int64()))

    return run


def coding(old: list[np.ndarray] | None, new: list[np.ndarray]):
    """vec_id, label, code (two hex digits a part), error of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = new[0].shape[1]
        for b in batches:
            b, unfit = fitting(b)
            yield pa.RecordBatch.from_arrays([unfit["vec_id"], unfit["label"], pa.nulls(unfit.num_rows, pa.string()), pa.nulls(unfit.num_rows, pa.int64())], ["vec_id", "label", "code", "error"])
            x, code, _, _ = placed(b, old, new)
            error = sum(own(x[:, p * size : (p + 1) * size], new[p], code[:, p]) for p in range(len(new)))
            text = [bytes(r).hex() for r in code.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b["vec_id"], b["label"], pa.array(text, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(c) for book in books for entry in book.tolist() for c in entry).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error; the final codebooks). The rows are read from a table in the shared folder.

    code: the index of each part's entry, two hex digits each; error: squared distances over all parts.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an index has two hex digits: 1 to 256 entries")
    spark, rows = vectors.sparkSession, whole(vectors, scale)
    result = StructType([rows.schema["vec_id"], rows.schema["label"], StructField("code", StringType()), StructField("error", LongType())])
    least = rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(1).collect()
    if not least:
        return spark.createDataFrame([], result), []
    length = len(least[0].x)
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    first = rows.where(F.size("x") == length).orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries)
    first = np.array([r.x for r in first.collect()], np.int64)
    size = length // parts
    books = [first[:, p * size : (p + 1) * size].copy() for p in range(parts)]

    at, state, old = f"{common.shared_folder(spark).rstrip('/')}/codes-{uuid.uuid4()}", rows.withColumn("x", F.when(F.size("x") == length, F.col("x"))), None
    schema = state_schema(rows)
    for k in range(rounds):
        state.mapInArrow(assigning(old, books), schema).write.parquet(f"{at}/{k}")
        if k:
            common.delete(spark, f"{at}/{k - 1}")
        written = spark.read.parquet(f"{at}/{k}")
        by = written.where("part is not null").select("part", "entry", "n", F.posexplode_outer("total").alias("j", "t"))
        sums = by.groupBy("part", "entry", "j").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).groupBy("part", "entry")
        sums = sums.agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("j", "t"))), lambda x: x["t"]).alias("total"))
        old, books = books, moved(books, sums)
        state = written.where("part is null")
    state.mapInArrow(coding(old, books), result).write.parquet(f"{at}/codes")
    if rounds:
        common.delete(spark, f"{at}/{rounds - 1}")
    return spark.read.parquet(f"{at}/codes"), books


def moved(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """All codebooks after a round: parts x entries rows at most come to the driver."""
    out = [b.copy() for b in books]
    for r in sums.collect():
        out[r.part][r.entry] = [t // r.n for t in r.total if t is not None]
    return out


def with_label_errors(codes: DataFrame) -> DataFrame:
    """codes and label_error: the error of all rows with the same label, null labels together. Labels are summed first, then joined."""
    sums = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    return common.with_group(codes, sums, "label")
