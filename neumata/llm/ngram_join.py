"""Exact n-gram Jaccard self-join: a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are the distinct n-gram sets (copies collapse into one row first), columns are n-grams. Which entries
of the product can matter is told by sizes: with rare columns first, two sets that reach the threshold share a column
among the first n - ceil(t * n) + 1 of each. The product of these columns, dealt out in blocks (long ones in several, by a
salt), gives the pairs to look at and counts of what they share; pairs whose sizes and positions rule the threshold out
are discarded. Of the others the whole rows are multiplied, a pivot with a block of rows, one block of columns after the
other: overlap counts are accumulated, and a row is discarded once the rest of its columns cannot make up the overlap
that the sizes ask for.

So that a large group of near copies costs no pairs within it, this runs in rounds. First each class asks the pivot it
shares most columns with. The second round takes the long columns that still hold rows of several components; pivots are
drawn anew, the rows in the middle of those they look like, since what is near the text all copies come from reaches most
of them. The third round multiplies, over all columns, the most alike pair of each two components; the fourth all other
pairs whose components are still apart. Every pair that reaches the threshold is thus either multiplied or already
connected: no link between components is lost, and no cap is set on anything.

Sets and n-grams are told apart by 64-bit hashes, which are certain enough up to some 10^9 distinct sets. Null texts and
texts without words have an empty set and stay alone; repeated rows and ids each give a row (`keep_one` keeps or drops the
rows of an id together). Texts of any length are read whole. Equal counts are settled by the smaller class, and only
doc_id and text are read, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, small_batches, texts_of

WIDTH, THRESHOLD = 4, 85
#: Order of columns only: per task the most counters kept, the least count to call a column frequent, and how many frequent columns are sent to all tasks (eight bytes each). Other columns come in order of their hash.
COUNTERS, FREQUENT, MOST_FREQUENT = 1 << 15, 64, 1 << 16
#: Rows of a column that go into one block.
BLOCK = 2048
#: Bits of a set's parity sketch.
SKETCH_BITS = 2048
#: Ids (eight bytes each) that may be broadcast, once counted.
MOST_BROADCAST = 500_000
#: Longs of the coarser sketch that goes along with cells after the first round.
FOLDED = 8
#: Rows from which a column is long: pivots are drawn anew in it. The pairs of shorter ones are few.
LONG = 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes read at once, n-grams among which a task looks for frequent ones at once, and blocks of columns of the product.
SEGMENT, TALLIED, COLUMN_BLOCKS = 1 << 20, 1 << 21, 8


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of each text.

    A word's hash is a polynomial in an odd multiplier over random 64-bit values of its bytes: products with the powers of
    the multiplier, summed up from one word's start to the next one's (white space counts 0), shifted back by its inverse.
    Bytes are read in segments that end in white space, so memory follows the longest word, not the longest text.
    """

    def __init__(self, width: int = WIDTH, segment: int = SEGMENT):
        self.width, self.segment = width, segment
        value = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64)
        value[65:91] = value[97:123]  # A-Z as a-z
        self.white = np.zeros(256, bool)
        self.white[[32, *range(9, 14)]] = True
        value[self.white] = 0
        self.value, self.up, self.down = value, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x)])) for x in (MULTIPLIER, inverse))

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of all words in these bytes, which end in white space."""
        starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        while at < len(data):
            end = min(len(data), at + self.segment)
            part = data[at:end]
            blank = self.white[part]
            if end < len(data):
                last = np.flatnonzero(blank)
                if len(last):
                    end = at + int(last[-1]) + 1
                else:  # a word longer than a segment
                    while end < len(data) and not self.white[data[end]]:
                        end += 1
                part, blank = data[at:end], self.white[data[at:end]]
            first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
            if len(first):
                self.powers(len(part))
                starts.append(first + at)
                hashes.append(mixed(np.add.reduceat(self.value[part] * self.up[: len(part)], first) * self.down[first]))
            at = end
        return np.concatenate(starts), np.concatenate(hashes)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        with np.errstate(over="ignore"):
            starts, h = self.words(np.frombuffer(b"\n".join([*raw, b""]), np.uint8))
            width, ends = self.width, np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))
            grams = h[: max(len(h) - width + 1, 0)].copy()
            for k in range(1, width):
                grams = grams * MULTIPLIER + h[k : k + len(grams)]
            grams, out, begin = mixed(grams).view(np.int64), [], 0
            for e in ends:
                n = e - begin
                if n >= width:
                    g = np.sort(grams[begin : e - width + 1])
                    out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
                else:
                    g = np.zeros(min(n, 1), np.uint64) + np.uint64(n)
                    for v in h[begin:e]:
                        g = g * MULTIPLIER + v
                    out.append(mixed(g).view(np.int64))
                begin = e
        return out


def class_of(grams: np.ndarray) -> int:
    return int.from_bytes(blake2b(grams.tobytes(), digest_size=8).digest(), "little", signed=True)


def first_of_their_kind(sets: list[np.ndarray], seen: set, most: int = 1 << 18):
    """(class, set) of the non-empty sets that this task has not met yet; the memory has a bound, and more than once does no harm."""
    for grams in sets:
        if len(grams) and (c := class_of(grams)) not in seen:
            if len(seen) >= most:
                seen.clear()
            seen.add(c)
            yield c, grams


def sketch_of(grams: np.ndarray) -> np.ndarray:
    """Parities of the numbers of n-grams in each of SKETCH_BITS parts: every bit in which two sketches differ is the work of a n-gram that one set lacks."""
    odd = np.bincount((grams.view(np.uint64) >> np.uint64(7)).astype(np.int64) % SKETCH_BITS, minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def tally(kept: tuple, new: np.ndarray, most: int) -> tuple:
    """Counters of columns after another batch; the least frequent go when there are too many."""
    new = np.sort(new)
    first = np.flatnonzero(np.concatenate([[True], new[1:] != new[:-1]])) if len(new) else np.zeros(0, np.int64)
    u, c = new[first], np.diff(np.append(first, len(new)))
    u, c = np.concatenate([kept[0], u[c > 1]]), np.concatenate([kept[1], c[c > 1]])
    u, at = np.unique(u, return_inverse=True)
    c = np.bincount(at, c, len(u)).astype(np.int64)
    if len(u) > most:
        best = np.sort(np.argpartition(-c, most)[:most])
        u, c = u[best], c[best]
    return u, c


def rows_of(docs: DataFrame, width: int) -> DataFrame:
    """kind 0: doc_id, n, cls, sketch of every document; kind 1: doc_id is a column, n its count within a task."""
    small_batches(docs.sparkSession)

    def run(batches):
        make, seen, kept, fresh = Shingler(width), set(), (np.zeros(0, np.int64), np.zeros(0, np.int64)), []
        names, longs, waiting = ["kind", "doc_id", "n", "cls", "sketch"], pa.list_(pa.int64()), 0
        for ids, texts in texts_of(batches):
            sets = make(texts)
            fresh += [g for _, g in first_of_their_kind(sets, seen)]
            waiting += sum(map(len, sets))
            if waiting >= TALLIED:
                kept, fresh, waiting = tally(kept, np.concatenate([np.zeros(0, np.int64), *fresh]), COUNTERS), [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), pa.array(ids, pa.int64()), pa.array([len(g) for g in sets], pa.int64()), pa.array([class_of(g) for g in sets], pa.int64()), pa.array([sketch_of(g) for g in sets], longs)], names)
        kept = tally(kept, np.concatenate([np.zeros(0, np.int64), *fresh]), COUNTERS)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(kept[0]), np.int32)), pa.array(kept[0]), pa.array(kept[1]), pa.array(np.zeros(len(kept[0]), np.int64)), pa.nulls(len(kept[0]), longs)], names)

    return documents(docs).mapInArrow(run, "kind int, doc_id long, n long, cls long, sketch array<long>")


def prefix_length(n: int, threshold: int) -> int:
    return n - (threshold * n + 99) // 100 + 1


def incidence(docs: DataFrame, width: int, threshold: int, frequent: list[tuple[int, int]]) -> DataFrame:
    """gram, salt, cls, n, pos: the first columns of each set, rare ones first. salt: -1, or the part of a long column."""
    columns = np.array([g for g, _ in frequent], np.int64)
    counts = np.array([c for _, c in frequent], np.int64)
    order = np.argsort(columns)
    columns, counts = columns[order], counts[order]
    parts = np.maximum(1, 2 * counts // BLOCK)

    def run(batches):
        make, seen = Shingler(width), set()
        for _, texts in texts_of(batches):
            out = []
            for c, grams in first_of_their_kind(make(texts), seen):
                n, p = len(grams), prefix_length(len(grams), threshold)
                salt = np.full(n, -1, np.int32)
                if len(columns):
                    at = np.minimum(np.searchsorted(columns, grams), len(columns) - 1)
                    hot = columns[at] == grams
                    rank = np.where(hot, counts[at], 0)
                    first = np.argsort(rank, kind="stable")[:p]
                    salt[hot & (parts[at] > 1)] = 0
                    salt = np.where(salt == 0, c % parts[at], salt)[first].astype(np.int32)
                    grams = grams[first]
                else:
                    grams, salt = grams[:p], salt[:p]
                out.append((grams, salt, np.full(p, c, np.int64), np.full(p, n, np.int32), np.arange(p, dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["gram", "salt", "cls", "n", "pos"])

    return documents(docs).mapInArrow(run, "gram long, salt int, cls long, n int, pos int")


def shared_columns(cells: DataFrame) -> DataFrame:
    """Cells of columns that more than one set holds, once each, with the pivot of their block.

    Reads columns one after the other from sorted partitions; of a column a block alone is held, never all of a long one.
    """

    def run(batches):
        names = ["gram", "salt", "cls", "n", "pos", "pivot", "pivot_n", "pivot_pos"]

        def out(held):
            gram, salt, cls, n, pos = held
            if not len(gram):
                return None
            fresh = np.ones(len(gram), bool)
            fresh[1:] = (np.diff(gram) != 0) | (np.diff(salt) != 0) | (np.diff(cls) != 0)
            gram, salt, cls, n, pos = (x[fresh] for x in held)
            first = np.flatnonzero(np.concatenate([[True], (np.diff(gram) != 0) | (np.diff(salt) != 0)]))
            size = np.diff(np.append(first, len(gram)))
            group = np.repeat(np.arange(len(first)), size)
            pivot = first[group]
            keep = (size[group] > 1) | (salt >= 0)
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (gram, salt, cls, n, pos, cls[pivot], n[pivot], pos[pivot])], names=names)

        held = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int32, np.int32)]
        for b in batches:
            held = [np.concatenate([x, b.column(k).to_numpy(zero_copy_only=False)]) for k, x in enumerate(held)]
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1])) if len(held[0]) else []
            if len(last):
                done = out([x[: last[-1] + 1] for x in held])
                held = [x[last[-1] + 1 :] for x in held]
                yield done
        if (done := out(held)) is not None:
            yield done

    dealt = cells.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "cls")
    return dealt.mapInArrow(run, "gram long, salt int, cls long, n int, pos int, pivot long, pivot_n int, pivot_pos int")


def may_reach(threshold: int, n, m, pos, other) -> F.Column:
    """Whether sets of n and m elements, alike in nothing before these positions, can still reach the threshold."""
    small, large = F.least(n, m), F.greatest(n, m)
    most = 1 + F.least(n - pos - 1, m - other - 1)
    return (100 * small >= threshold * large) & ((100 + threshold) * most >= threshold * (n + m))


def near_enough(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """p, q, a, b: the pairs of classes (with their representatives) that their sketches do not rule out.

    Sets of n and m elements that reach the threshold t differ in (1 - t) / (1 + t) * (n + m) elements at most.
    """
    of = lambda node, x, rep: sets.select(F.col("cls").alias(node), F.col("n").alias(f"n{x}"), F.col("sketch").alias(x), F.col("rep").alias(rep))
    differ = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, k: s + k)
    bound = (100 + threshold) * differ <= (100 - threshold) * (F.col("nx") + F.col("ny"))
    return pairs.join(of("p", "x", "a"), "p").join(of("q", "y", "b"), "q").where(bound).select("p", "q", "a", "b")


def folded(sets: DataFrame) -> DataFrame:
    """cls, s0..: sketches of FOLDED longs; parts of a sketch taken together are a coarser sketch."""
    parts = SKETCH_BITS // 64

    def fold(k: int):
        out = F.col("sketch")[k]
        for j in range(k + FOLDED, parts, FOLDED):
            out = out.bitwiseXOR(F.col("sketch")[j])
        return out.alias(f"s{k}")

    return sets.select("cls", *(fold(k) for k in range(FOLDED)))


def middles(cls: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, sketch: np.ndarray, threshold: int):
    """(pivot, members, distances) of one block of a column: indices of the rows in the middle, and of rows of other components that look like them.

    The majority of the block's bits stands for the text that copies come from. The row next to it is the pivot of all rows
    that sketch, sizes and positions let reach the threshold with it; those left get another pivot, and so on, so each row
    is a member at most once. The majority is taken anew whenever half of the rows are gone.
    """
    left, voted = np.arange(len(cls)), None
    while len(left) > 1:
        if voted is None or 2 * len(left) <= voted:
            voted = len(left)
            bits = np.unpackbits(sketch[left].view(np.uint8), axis=1).sum(0, dtype=np.int64)
            major = np.packbits(2 * bits > voted).view(np.uint64)
            far = np.bitwise_count(sketch[left] ^ major).sum(1, dtype=np.int64)
            left = left[np.lexsort((cls[left], far))]
        p, rest = left[0], left[1:]
        d = np.bitwise_count(sketch[rest] ^ sketch[p]).sum(1, dtype=np.int64)
        small, large = np.minimum(n[rest], n[p]), np.maximum(n[rest], n[p])
        most = np.minimum(n[rest] - pos[rest], n[p] - pos[p])
        able = (100 * small >= threshold * large) & ((100 + threshold) * most >= threshold * (small + large))
        able &= (100 + threshold) * d <= (100 - threshold) * (small + large)
        asks = able & (root[rest] != root[p])
        yield p, rest[asks], d[asks]
        left = rest[~able]


def drawn(placed: DataFrame, threshold: int) -> DataFrame:
    """p, q, d: pivots drawn anew in the blocks of long columns, and what each is to be multiplied with.

    placed: cells with root, sketch and the number of parts of their column. Columns come from sorted partitions, one
    block is held at a time. Each row asks the pivot most like it; pivots ask all they were drawn with, and the pivots of a
    column's blocks one of them.
    """
    longs = [f"s{k}" for k in range(FOLDED)]

    def run(batches):
        def out(block):
            gram, part, parts, cls, n, pos, root, *sketch = block
            rows = []
            for p, members, d in middles(cls, n, pos, root, np.stack(sketch, 1).view(np.uint64), threshold):
                if not rows and parts[0] > 1:
                    rows.append((gram[[0]], cls[[p]], np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1, bool)))
                rows.append((gram[: len(members)], np.full(len(members), cls[p]), cls[members], d, np.zeros(len(members), bool)))
            return rows

        held = None
        for b in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            ends = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0)) + 1
            rows, start = [], 0
            for e in ends:
                rows += out([x[start:e] for x in held])
                start = e
            held = [x[start:] for x in held]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["gram", "p", "q", "d", "head"])
        if held is not None and len(held[0]) and (rows := out(held)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows, strict=True)], names=["gram", "p", "q", "d", "head"])

    dealt = placed.where(F.col("c") >= LONG).withColumn("parts", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("part", F.pmod("cls", F.col("parts")).cast("int"))
    dealt = dealt.repartition("gram", "part").sortWithinPartitions("gram", "part", "cls").select("gram", "part", "parts", "cls", "n", "pos", "root", *longs)
    met = cut(dealt.mapInArrow(run, "gram long, p long, q long, d long, head boolean"))
    asks = met.where("not head").select("p", "q", "d").distinct()
    nearest = asks.groupBy("q").agg(F.min(F.struct("d", "p")).alias("m")).select("m.p", "q")
    between = asks.join(asks.select(F.col("p").alias("q")).distinct(), "q", "left_semi").select("p", "q")
    heads = met.where("head").select("gram", "p").distinct()
    across = heads.select("gram", F.col("p").alias("q")).join(heads.groupBy("gram").agg(F.min("p").alias("p")), "gram").select("p", "q").where("p <> q")
    return nearest.union(between).union(across).distinct()


def least_overlap(n, m, threshold: int):
    """The least number of common elements of sets of n and m elements that reach the threshold."""
    return -(-threshold * (n + m) // (100 + threshold))


def reaching(pivot: np.ndarray, rows: list[np.ndarray], threshold: int, blocks: int = COLUMN_BLOCKS) -> np.ndarray:
    """Which rows reach the threshold with the pivot: their product, one block of columns after the other.

    Counts are accumulated over the blocks; a row is discarded as soon as what is left of it, or of the pivot, is too
    little for the overlap that both sizes ask for.
    """
    if not rows:
        return np.zeros(0, bool)
    size, m = np.array([len(r) for r in rows], np.int64), len(pivot)
    need, got = least_overlap(size, m, threshold), np.zeros(len(rows), np.int64)
    alive = np.flatnonzero((need <= size) & (need <= m))
    borders = np.linspace(-(2.0**63), 2.0**63, blocks + 1)[1:-1].astype(np.int64)
    cuts = np.stack([np.concatenate([[0], np.searchsorted(r, borders), [len(r)]]) for r in rows])
    own = np.concatenate([[0], np.searchsorted(pivot, borders), [m]])
    for k in range(blocks):
        if not len(alive):
            break
        part = pivot[own[k] : own[k + 1]]
        count = cuts[alive, k + 1] - cuts[alive, k]
        if len(part) and count.sum():
            flat = np.concatenate([rows[r][cuts[r, k] : cuts[r, k + 1]] for r in alive])
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            got[alive] += np.bincount(np.repeat(np.arange(len(alive)), count), part[at] == flat, len(alive)).astype(np.int64)
        left = np.minimum(size[alive] - cuts[alive, k + 1], m - own[k + 1])
        alive = alive[got[alive] + left >= need[alive]]
    out = np.zeros(len(rows), bool)
    out[alive] = got[alive] >= need[alive]
    return out


def multiply(docs: DataFrame, pairs: DataFrame, width: int, threshold: int) -> DataFrame:
    """p, q: the pairs whose whole rows reach the threshold. pairs: p, q (classes), a, b (their representatives).

    A pivot (a) and the rows it is multiplied with lie in one block, or several if they are many. Whole rows go to their
    blocks once; a block is read from sorted partitions, the pivot first, and some rows at a time are held.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = cut(pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "b", "p", "q", "salt"))
    pivots = dealt.select(F.col("a").alias("doc_id"), F.struct(F.col("a").alias("key"), "salt", F.lit(None).cast("long").alias("p"), F.lit(None).cast("long").alias("q")).alias("ask")).distinct()
    others = dealt.select(F.col("b").alias("doc_id"), F.struct(F.col("a").alias("key"), "salt", "p", "q").alias("ask"))
    asks = cut(pivots.union(others))
    needed = asks.groupBy("doc_id").agg(F.collect_list("ask").alias("asks"))
    if asks.count() <= MOST_BROADCAST:  # beyond it the join shuffles
        needed = F.broadcast(needed)
    schema = "key long, salt int, p long, q long, grams binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def rows(batches):
        make = Shingler(width)
        for b in batches:
            out = []
            for grams, asked in zip(make(b.column(1).to_pylist()), b.column(2).to_pylist(), strict=True):
                data = grams.tobytes()
                out += [(x["key"], x["salt"], x["p"], x["q"], data) for x in asked]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=names)

    def product(batches):
        held, key, pivot = [], None, None

        def found(part):
            ok = reaching(pivot, [np.frombuffer(r[2], np.int64) for r in part], threshold)
            return [r[:2] for r, good in zip(part, ok, strict=True) if good]

        for b in batches:
            out = []
            for k, s, p, q, grams in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (k, s) != key:
                    out += found(held) if held else []
                    held, key = [], (k, s)
                if p is None:
                    pivot = np.frombuffer(grams, np.int64)
                else:
                    held.append((p, q, grams))
            out += found(held) if held else []
            held = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(2)], names=["p", "q"])

    blocks = documents(docs).join(needed, "doc_id").mapInArrow(rows, schema).repartition("key", "salt").sortWithinPartitions("key", "salt", F.col("p").asc_nulls_first(), "q")
    return blocks.mapInArrow(product, "p long, q long")


def jumped(parents: DataFrame) -> DataFrame:
    """node, root from node, root (a smaller node, or itself): each node jumps to its root's root until none moves."""
    while True:
        up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = cut(parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
        parents = new.select("node", "root")
        if not new.where("moved").limit(1).count():
            return parents


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """node, root of all linked nodes, by contraction. links: p, q; labels: node, root known before.

    Each node takes its smallest neighbour, chains of them are jumped over, and links between the roots are all that is
    left, each once. So every round at least halves the linked nodes, and its rows are those of the links left.
    """
    while True:
        if labels is not None:
            of = lambda node: labels.select(F.col("node").alias(node), F.col("root").alias(f"{node}_root"))
            links = links.join(of("p"), "p", "left").join(of("q"), "q", "left").select(F.coalesce("p_root", "p").alias("p"), F.coalesce("q_root", "q").alias("q"))
        links = cut(links.where("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct())
        if not links.limit(1).count():
            return labels if labels is not None else links.select(F.col("p").alias("node"), F.col("q").alias("root"))
        both = links.select(F.col("p").alias("node"), F.col("q").alias("other")).union(links.select("q", "p"))
        new = jumped(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")))
        if labels is None:
            labels = new
        else:
            up = new.select(F.col("node").alias("root"), F.col("root").alias("above"))
            moved = labels.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            labels = cut(moved.union(new.join(labels, "node", "left_anti")))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (p, q) whose classes are not connected yet."""
    of = lambda node: labels.select(F.col("node").alias(node), F.col("root").alias(f"{node}_root"))
    met = pairs.join(of("p"), "p", "left").join(of("q"), "q", "left")
    return met.where(F.coalesce("p_root", "p") != F.coalesce("q_root", "q")).select("p", "q")


def join(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    base = cut(rows_of(docs, width))
    every = base.where("kind = 0").select("doc_id", "n", "cls", "sketch")
    counted = base.where("kind = 1").groupBy(F.col("doc_id").alias("gram")).agg(F.sum("n").alias("c"))
    frequent = [tuple(r) for r in counted.where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "gram").limit(MOST_FREQUENT).collect()]
    kinds = every.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    sets = cut(kinds.join(every.select("cls", F.col("doc_id").alias("rep"), "n", "sketch"), ["cls", "rep"]).dropDuplicates(["cls"]))
    cells = cut(shared_columns(incidence(docs, width, threshold, frequent)))

    def ask(pairs: DataFrame) -> DataFrame:
        """p, q: which of the pairs of classes reach the threshold."""
        return cut(multiply(docs, cut(near_enough(pairs, sets, threshold)), width, threshold))

    # Round 1: the product of each block's members with its pivot, and of a long column's pivots with one of them, gives
    # counts of common columns. Each class asks the pivot it has most in common with.
    own = cells.select("cls", "n", "pos", "pivot", "pivot_n", "pivot_pos")
    heads = cells.where("salt >= 0").select("gram", F.struct(F.col("pivot").alias("cls"), F.col("pivot_n").alias("n"), F.col("pivot_pos").alias("pos")).alias("head")).distinct()
    first = heads.groupBy("gram").agg(F.min("head").alias("top"))
    across = heads.join(first, "gram").select("head.*", F.col("top.cls").alias("pivot"), F.col("top.n").alias("pivot_n"), F.col("top.pos").alias("pivot_pos"))
    able = may_reach(threshold, F.col("n"), F.col("pivot_n"), F.col("pos"), F.col("pivot_pos"))
    met = own.union(across).where("cls <> pivot").groupBy(F.col("pivot").alias("p"), F.col("cls").alias("q")).agg(F.count("*").alias("common"), F.max(able).alias("able"))
    top = cut(met.where("able").groupBy("q").agg(F.min(F.struct(-F.col("common"), "p")).alias("m")).select("m.p", "q"))
    roots = jumped(cut(ask(top).select(F.col("q").alias("node"), F.col("p").alias("root"))))  # a pivot is smaller than its members

    # Round 2: in long columns that hold several components, pivots from the middle of what they look like.
    def rooted(cells: DataFrame) -> DataFrame:
        return cells.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")

    def still_open(placed: DataFrame) -> DataFrame:
        """The rows of columns that hold several components, with the number of their column's rows."""
        several = placed.groupBy("gram").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("c"))
        return placed.join(several.where("least < most").select("gram", "c"), "gram")

    placed = cut(still_open(rooted(cells.select("gram", "cls", "n", "pos"))).join(folded(sets), "cls"))
    pairs = drawn(placed, threshold)
    if pairs.limit(1).count():
        roots = components(ask(pairs), roots)
        placed = cut(still_open(rooted(placed.drop("root", "c"))))

    # Round 3: of each two components that a column holds, the two rows that look most alike.
    x, y = placed.alias("x"), placed.alias("y")
    crossed = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root"))
    differ = sum(F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(FOLDED))
    alike = (100 + threshold) * differ <= (100 - threshold) * (F.col("x.n") + F.col("y.n"))
    met = x.join(y, crossed & may_reach(threshold, F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")) & alike)
    met = cut(met.select(F.col("x.cls").alias("p"), F.col("y.cls").alias("q"), F.least("x.root", "y.root").alias("r"), F.greatest("x.root", "y.root").alias("s"), differ.alias("d")).distinct())
    best = cut(met.groupBy("r", "s").agg(F.min(F.struct("d", "p", "q")).alias("m")).select("m.p", "m.q"))
    if best.limit(1).count():
        roots = components(ask(best), roots)
        # Round 4: all others whose components are still apart.
        rest = cut(apart(met.select("p", "q").join(best, ["p", "q"], "left_anti"), roots))
        if rest.limit(1).count():
            roots = components(ask(rest), roots)
    of = sets.select("cls", "rep").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    least = of.groupBy("root").agg(F.min("rep").alias("component"))
    places = of.join(least, "root").select("cls", "component")
    key = F.when(F.col("n") > 0, F.col("cls")).otherwise(F.col("doc_id"))
    return every.select("doc_id", "n", key.alias("cls")).join(places, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("component").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, with all their columns."""
    gone = cut(join(docs, width, threshold).where("component_id <> doc_id").select("doc_id").distinct())
    if gone.count() <= MOST_BROADCAST:  # beyond it the join shuffles
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
