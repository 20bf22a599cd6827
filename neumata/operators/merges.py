"""Element-merge vocabularies: train on counts of whole elements, tokenise, decode; WordPiece by longest match."""

from __future__ import annotations

import heapq
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import scalars as S
from ..functions.lineage import cut
from .tokens import words as words_of

#: Merges that are repeated in every round before the blocks of words are written anew; pieces of a block, about.
MERGES, BLOCK = 64, 1 << 20


def element_counts(elements: DataFrame) -> DataFrame:
    """elm_text, n, rank: elements of more than one token, from the most frequent on."""
    rows = elements.where(F.size("toks") > 1).groupBy(F.array_join("toks", " ").alias("elm_text")).agg(F.count("*").alias("n"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "elm_text")))  # a vocabulary's rows


def cutoff(c: DataFrame, ratios: list[float]) -> DataFrame:
    """ratio, size: how many elements have a cumulative share of at most the ratio."""
    w = Window.orderBy("rank")
    rows = c.withColumn("share", F.round(F.sum("n").over(w) / F.sum("n").over(Window.partitionBy()), 9))
    return rows.agg(*(F.count_if(F.col("share") <= r).alias(f"r{k}") for k, r in enumerate(ratios))).select(F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), F.col(f"r{k}").alias("size")) for k, r in enumerate(ratios)))).alias("x")).select("x.*")


def merged_vocab(c: DataFrame, base: DataFrame, size: int) -> DataFrame:
    """id, tok: the base vocabulary, then the most frequent elements."""
    n = base.agg((F.max("id") + 1).alias("n"))
    extra = c.where(F.col("rank") <= size).select((F.col("rank") - 1).alias("k"), F.col("elm_text").alias("tok")).crossJoin(F.broadcast(n))
    return base.select("id", "tok").unionByName(extra.select((F.col("k") + F.col("n")).cast("int").alias("id"), "tok"))


def tokenised(elements: DataFrame, vocab: DataFrame) -> DataFrame:
    """song_id, elm, k, tok: an element of the vocabulary as one token, others as their parts. vocab: tok (bounded, broadcast)."""
    rows = elements.withColumn("whole", F.array_join("toks", " ")).join(F.broadcast(vocab.select(F.col("tok").alias("whole"), F.lit(True).alias("known"))), "whole", "left")
    parts = F.when(F.col("known"), F.array("whole")).otherwise(F.col("toks"))
    return rows.select("song_id", "elm", F.posexplode(parts).alias("k", "tok"))


def song_texts(songs: DataFrame, vocab: DataFrame) -> DataFrame:
    """song_id, score, toks: the elements of each text (from tokens.song_elements) as tokenised() has them, each within its text. vocab: tok (bounded, a vocabulary's rows)."""
    known = [r.tok for r in vocab.select("tok").collect()]
    whole = F.transform("elms", lambda e: F.array_join(e["toks"], " "))
    parts = F.zip_with(whole, "elms", lambda w, e: F.when(w.isin(known), F.array(w)).otherwise(e["toks"]))
    return songs.select("song_id", "score", F.flatten(parts).alias("toks"))


def texts_of(tokens: DataFrame) -> DataFrame:
    """song_id, score: the tokens put together again."""
    got = tokens.groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("elm", "k", "tok"))).alias("t"))
    return got.select("song_id", F.array_join(F.transform("t", lambda x: x["tok"]), " ").alias("score"))


def merged(ids: np.ndarray, a: int, b: int, new: int) -> np.ndarray:
    """Pieces of words, each word followed by -1, with each a b (from the left) as new."""
    hit = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b))
    if a == b and len(hit):  # in a run of the same piece, every other place
        start = np.concatenate([[True], np.diff(hit) != 1])
        first = np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
    ids[hit] = new
    return np.delete(ids, hit + 1)


#: Merges guessed ahead in one job, pairs of neighbours kept on the driver for each piece still to be found, and at least.
GUESSED, PAIRS_A_PIECE, LEAST_PAIRS = 192, 8, 1024


def pair_counts(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs of neighbours, their counts). ids: pieces of words, each word followed by -1; n: how often each word occurs."""
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.cumsum(ids < 0) - (ids < 0)
    near = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    u, at = np.unique(ids[near].astype(np.int64) << 32 | ids[near + 1], return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, at, n[word[near]])
    return u, total


class Block:
    """Words as runs of piece ids, each followed by -1, with an index from pairs of neighbours to the words that hold them: a merge looks at these alone."""

    def __init__(self, ids: np.ndarray, n: np.ndarray):
        self.ids, self.n = ids.copy(), n
        ends = np.flatnonzero(ids < 0)
        self.first = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
        self.length = ends - self.first + 1
        codes, words = self.pairs(self.ids, np.arange(len(ends)), self.length)
        order = np.argsort(codes, kind="stable")
        self.codes, self.words, self.made = codes[order], words[order].astype(np.int32), {}

    @staticmethod
    def pairs(ids: np.ndarray, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of neighbours, the words they stand in)."""
        near = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        return ids[near].astype(np.int64) << 32 | ids[near + 1], np.repeat(words, length)[near]

    def places(self, words: np.ndarray) -> np.ndarray:
        spans = self.length[words]
        return np.repeat(self.first[words] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())

    def flat(self) -> np.ndarray:
        return self.ids[self.places(np.arange(len(self.first)))]

    def step(self, step: tuple[int, int, int], counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Apply a merge: (pairs whose counts it changes, by how much), or nothing of these when not counted."""
        a, b, new = step
        code, none = a << 32 | b, np.zeros(0, np.int64)
        lo, hi = np.searchsorted(self.codes, code), np.searchsorted(self.codes, code, "right")
        words = np.unique(np.concatenate([self.words[lo:hi], *self.made.pop(code, ())]))
        old = self.ids[self.places(words)] if len(words) else none
        hit = np.flatnonzero((old[:-1] == a) & (old[1:] == b))
        if not len(hit):
            return none, none
        words = words[np.unique(np.repeat(np.arange(len(words)), self.length[words])[hit])]  # some have lost the pair since
        old = self.ids[self.places(words)]
        made = merged(old.copy(), a, b, new)
        before = self.length[words]
        self.length[words] = np.diff(np.flatnonzero(made < 0), prepend=-1)
        self.ids[self.places(words)] = made
        codes, at = self.pairs(made, words, self.length[words])
        fresh = (codes >> 32 == new) | (codes & 0xFFFFFFFF == new)
        order = np.argsort(codes[fresh], kind="stable")
        u, starts = np.unique(codes[fresh][order], return_index=True)
        for c, w in zip(u.tolist(), np.split(at[fresh][order], starts[1:]), strict=False):
            self.made.setdefault(c, []).append(w)
        if not counted:
            return none, none
        gone, where = self.pairs(old, words, before)
        pairs, to = np.unique(np.concatenate([gone, codes]), return_inverse=True)
        change = np.zeros(len(pairs), np.int64)
        np.add.at(change, to, np.concatenate([-self.n[where], self.n[at]]))
        return pairs[change != 0], change[change != 0]


class Greedy:
    """Counts of pairs on the driver, and the merges that follow from them.

    All counts are exact, of the most frequent pairs down to `last` (count and names) when they were counted: no other comes first
    before these, as counts of old pairs only fall, and a pair that a merge makes is known in full.
    """

    def __init__(self, pieces: list[str], counts: dict[tuple[int, int], int], last: tuple[int, int, int] | None):
        self.pieces, self.number = pieces, {p: k for k, p in enumerate(pieces)}
        self.counts, self.seen = counts, {}
        self.last = (0, ("", "")) if last is None else (last[0], (pieces[last[1]], pieces[last[2]]))

    def best(self, counts: dict) -> tuple[int, int] | None:
        """The most frequent pair, of equals the first by name; none when unknown ones may have as many."""
        top = max(counts.values(), default=0)
        if top <= 0:
            return None
        name = lambda x: (self.pieces[x[0]], self.pieces[x[1]])
        first = min((x for x, n in counts.items() if n == top), key=name)
        return first if (-top, name(first)) <= (-self.last[0], self.last[1]) or not self.last[0] else None

    def named(self, pair: tuple[int, int]) -> str:
        return self.pieces[pair[0]] + self.pieces[pair[1]].removeprefix("##")

    def guessed(self, most: int) -> list[tuple[int, int, int]]:
        """The next merges, as far as they can be guessed: what a merge changes is known from a job that guessed it too, or estimated from the frequencies of its pieces."""
        counts, pieces, out = self.counts.copy(), len(self.pieces), []
        heap = [(-n, self.pieces[a], self.pieces[b], a, b) for (a, b), n in counts.items()]
        heapq.heapify(heap)
        followers, leaders = {}, {}
        for (a, b), n in counts.items():
            followers.setdefault(a, {})[b] = n
            leaders.setdefault(b, {})[a] = n

        def put(a: int, b: int, n: int) -> None:
            counts[a, b] = n
            followers.setdefault(a, {})[b] = n
            leaders.setdefault(b, {})[a] = n
            if n > 0:
                heapq.heappush(heap, (-n, self.pieces[a], self.pieces[b], a, b))

        try:
            while len(out) < most and heap:
                n, _, _, a, b = heapq.heappop(heap)
                n = -n
                if counts.get((a, b)) != n:
                    continue
                if n < self.last[0]:
                    break
                name = self.named((a, b))
                new = self.number.get(name, -1)
                if new < 0:
                    new = len(self.pieces)
                    self.pieces.append(name)
                    self.number[name] = new
                out.append((a, b, new))
                put(a, b, 0)
                if (name, self.pieces[a]) in self.seen:
                    changes = {(self.number[x], self.number[y]): d for (x, y), d in self.seen[name, self.pieces[a]].items() if x in self.number and y in self.number}
                    for (x, y), d in changes.items():
                        if (x, y) != (a, b):
                            put(x, y, max(0, counts.get((x, y), 0) + d))
                    continue
                of_a, of_b = sum(leaders.get(a, {}).values()) + n or 1, sum(followers.get(b, {}).values()) + n or 1
                for x, m in list(leaders.get(a, {}).items()):
                    if m > 0 and (k := m * n // of_a):
                        put(x, a, m - k)
                        put(x, new, counts.get((x, new), 0) + k)
                for y, m in list(followers.get(b, {}).items()):
                    if m > 0 and (k := m * n // of_b):
                        put(b, y, m - k)
                        put(new, y, counts.get((new, y), 0) + k)
        finally:
            for name in self.pieces[pieces:]:
                del self.number[name]
            del self.pieces[pieces:]
        return out

    def accepted(self, steps: list[tuple[int, int, int]], changes: dict[int, dict[tuple[int, int], int]], names: list[str]) -> int:
        """How many of the guessed merges are the right ones; their pieces and counts are taken over. names: of all pieces, guessed ones too."""
        for k, (a, b, new) in enumerate(steps):
            if self.best(self.counts) != (a, b):
                break
            if new == len(self.pieces):
                self.pieces.append(names[new])
                self.number[names[new]] = new
            for x, d in changes.get(k, {}).items():
                self.counts[x] = self.counts.get(x, 0) + d
                if not self.counts[x]:
                    del self.counts[x]
        else:
            k = len(steps)
        self.seen = {(names[new], names[a]): {(names[x], names[y]): d for (x, y), d in changes.get(j, {}).items()} for j, (a, b, new) in enumerate(steps) if j >= k}
        return k


def train_wordpiece(words: DataFrame, size: int) -> list[str]:
    """Pieces by repeated merging of the most frequent pair of neighbours (of equals, the first by name). words: word, n (distinct).

    Words lie in blocks of piece ids over the cluster. The driver keeps the exact counts of the most frequent pairs (some for each
    piece to be found) and guesses the next merges; one job applies them one after the other to the words that hold them and gives
    back what each changed. Guesses are taken over up to the first that is not the most frequent pair by these exact counts, so
    the result is that of one merge at a time, in far fewer jobs. All pairs are counted anew only when those kept run out.
    """

    def split(word):
        return [c if i == 0 else f"##{c}" for i, c in enumerate(word)]

    def alphabet(batches):
        found = set()
        for b in batches:
            found.update(*map(split, b.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["p"])

    spread = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(words.where("word <> ''").select("word", F.col("n").cast("long").alias("n")).repartition(spread, "word"))
    pieces = sorted(r.p for r in rows.select("word").mapInArrow(alphabet, "p string").distinct().collect())
    if len(pieces) >= size:
        return pieces
    number = {p: k for k, p in enumerate(pieces)}

    def blocks(batches):
        ids, n = [], []
        for b in batches:
            for w, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids += [*map(number.get, split(w)), -1]
                n.append(c)
                if len(ids) >= BLOCK:
                    yield block(ids, n)
                    ids, n = [], []
        if ids:
            yield block(ids, n)

    def block(ids, n):
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int64()))], ["ids", "n"])

    def flat(column):
        return column.flatten().to_numpy(zero_copy_only=False)

    def opened(batches, steps):
        """Blocks after the steps, with the counts of words as they were written."""
        for b in batches:
            for k in range(b.num_rows):
                one = Block(flat(b.column(0).slice(k, 1)), flat(b.column(1).slice(k, 1)))
                for step in steps:
                    one.step(step, counted=False)
                yield one

    def merging(steps):
        def run(batches):
            for one in opened(batches, steps):
                yield block(one.flat(), one.n)

        return run

    def summed(parts):
        """Rows (step, pair, c) of a task, summed."""
        if not parts:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], ["step", "pair", "c"])
        step, pair, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pair, step))
        step, pair, c = step[order], pair[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(step) != 0) | (np.diff(pair) != 0)])) if len(step) else np.zeros(0, np.int64)
        total = np.add.reduceat(c, first) if len(first) else c
        return pa.RecordBatch.from_arrays([pa.array(step[first].astype(np.int32)), pa.array(pair[first]), pa.array(total)], ["step", "pair", "c"])

    def counting(done, steps=None):
        """Counts of all pairs (step -1), or what each of the steps changes."""

        def run(batches):
            parts = []
            for one in opened(batches, done):
                if steps is None:
                    u, c = pair_counts(one.flat(), one.n)
                    parts.append((np.full(len(u), -1, np.int32), u, c))
                for k, step in enumerate(steps or ()):
                    u, c = one.step(step)
                    parts.append((np.full(len(u), k, np.int32), u, c))
            yield summed(parts)

        return run

    schema = "step int, pair long, c long"
    pair = lambda x: (x >> 32, x & 0xFFFFFFFF)
    state, done, greedy = cut(rows.mapInArrow(blocks, "ids array<int>, n array<long>")), [], None
    while len(pieces) < size:
        if len(done) >= MERGES:
            state, done = cut(state.mapInArrow(merging(done), state.schema)), []
        if greedy is None or greedy.best(greedy.counts) is None:
            most = PAIRS_A_PIECE * (size - len(pieces)) + LEAST_PAIRS
            every = state.mapInArrow(counting(done), schema).groupBy("pair").agg(F.sum("c").alias("c"))
            kept = by_name(every, pieces).orderBy(F.desc("c"), "a", "b").limit(most).collect()
            greedy = Greedy(pieces, {pair(r.pair): r.c for r in kept}, (kept[-1].c, *pair(kept[-1].pair)) if len(kept) == most else None)
            if not kept:
                break
        steps = greedy.guessed(min(GUESSED, size - len(pieces)))
        names = list(pieces)
        for a, b, new in steps:
            if new == len(names):
                names.append(names[a] + names[b].removeprefix("##"))
        changes: dict[int, dict[tuple[int, int], int]] = {}
        found = state.mapInArrow(counting(done, steps), schema).groupBy("step", "pair").agg(F.sum("c").alias("c")).where("c <> 0").toArrow()
        for step, x, c in zip(*(found.column(k).to_pylist() for k in range(3)), strict=True):
            changes.setdefault(step, {})[pair(x)] = c
        k = greedy.accepted(steps, changes, names)
        done = [*done, *steps[:k]]
    return pieces


def by_name(pairs: DataFrame, pieces: list[str]) -> DataFrame:
    """pair, c, a, b: the places of both pieces in the order of names, so that ties can be sorted. pieces are broadcast: a vocabulary's rows."""
    place = {p: k for k, p in enumerate(sorted(pieces))}
    rank = np.array([place[p] for p in pieces], np.int32)

    def run(batches):
        for b in batches:
            x = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rank[x >> 32]), pa.array(rank[x & 0xFFFFFFFF])], ["pair", "c", "a", "b"])

    return pairs.select("pair", "c").mapInArrow(run, "pair long, c long, a int, b int")


class Trie:
    """Greedy longest match in one pass: where a walk ends, a failure link says which pieces are certain and where to go on."""

    def __init__(self, pieces: list[str]):
        known = frozenset(pieces)
        self.next, self.fail, self.out, text = [{}, {}], [None, None], [[], []], ["", "##"]
        self.first, self.inner = 0, 1
        for p in pieces:
            at = self.inner if p.startswith("##") and len(p) > 2 else self.first
            for c in p[2:] if at == self.inner else p:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(None)
                    self.out.append([])
                    text.append(text[at] + c)
                at = self.next[at][c]
        queue = deque((self.first, self.inner))
        while queue:
            v = queue.popleft()
            for c, u in self.next[v].items():
                if text[u] in known:
                    self.fail[u], self.out[u] = self.inner, [text[u]]
                else:
                    z, popped = self.fail[v], []
                    while z is not None and c not in self.next[z]:
                        popped += self.out[z]
                        z = self.fail[z]
                    if z is not None:
                        self.fail[u], self.out[u] = self.next[z][c], self.out[v] + popped
                queue.append(u)

    def __call__(self, word: str) -> list[str]:
        at, out, k = self.first, [], 0
        while k < len(word) or at not in (self.first, self.inner):
            if k < len(word) and word[k] in self.next[at]:
                at, k = self.next[at][word[k]], k + 1
            elif self.fail[at] is None:
                return ["[UNK]"]
            else:
                out += self.out[at]
                at = self.fail[at]
        return out


def wordpieces(words: DataFrame, pieces: list[str], *kept: str) -> DataFrame:
    """word, pieces and the columns kept: greedy longest match from the left; [UNK] where none fits, none for an empty word."""

    def run(batches):
        cut_ = Trie(pieces)
        for b in batches:
            w = b.column(0).to_pylist()
            made = [pa.array(w, pa.string()), pa.array([cut_(x or "") for x in w], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*made, *(b.column(k + 1) for k in range(len(kept)))], ["word", "pieces", *kept])

    types = {f.name: f.dataType.simpleString() for f in words.schema}
    return words.select("word", *kept).mapInArrow(run, ", ".join(["word string", "pieces array<string>", *(f"{c} {types[c]}" for c in kept)]))


def unpieced(pieces: Column) -> Column:
    """The word that pieces make up; null where one is unknown."""
    word = F.array_join(F.transform(pieces, lambda p, k: F.when((k > 0) & p.startswith("##"), F.substr(p, F.lit(3))).otherwise(p)), "")
    return F.when(~F.array_contains(pieces, "[UNK]"), word)


#: The first of the characters that stand for token ids.
FIRST_CHARACTER = 0x4E00


def to_chars(encoded: DataFrame) -> DataFrame:
    """song_id, chars: every token (song_id, pos, id) as one character, so that piece trainers for text can be used; unknown tokens are left out."""
    char = F.decode(F.unhex(F.lpad(F.hex(F.col("id") + FIRST_CHARACTER), 4, "0")), "UTF-16BE")
    got = encoded.where("id is not null").groupBy("song_id").agg(F.array_sort(F.collect_list(F.struct("pos", char.alias("c")))).alias("x"))
    return got.select("song_id", F.array_join(F.transform("x", lambda x: x["c"]), "").alias("chars"))


def from_chars(chars: DataFrame) -> DataFrame:
    """song_id, pos, id: the ids that characters stand for."""
    rows = chars.select("song_id", F.posexplode(F.split("chars", r"(?!\A)(?!\z)")).alias("pos", "c"))
    return rows.select("song_id", "pos", (F.conv(F.hex(F.encode("c", "UTF-16BE")), 16, 10).cast("int") - FIRST_CHARACTER).alias("id"))


def char_words(encoded: DataFrame) -> DataFrame:
    """song_id, k, word: tokens (song_id, pos, id, tok_type) as characters, split into words before and after header and special tokens, so that no piece reaches over them."""
    char = F.decode(F.unhex(F.lpad(F.hex(F.col("id") + FIRST_CHARACTER), 4, "0")), "UTF-16BE")
    alone = F.col("tok_type").isin("special", "time_sig", "tempo", "key")
    w = Window.partitionBy("song_id").orderBy("pos")
    rows = encoded.where("id is not null").select("song_id", "pos", char.alias("c"), alone.alias("alone"))
    rows = rows.withColumn("new", (F.col("alone") | F.coalesce(F.lag("alone").over(w), F.lit(True))).cast("int"))
    rows = rows.withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = rows.groupBy("song_id", "k").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("x"))
    return got.select("song_id", "k", F.array_join(F.transform("x", lambda x: x["c"]), "").alias("word"))


def song_words(scores: DataFrame, vocab: DataFrame) -> DataFrame:
    """song_id, words: char_words() of whole texts as an array, each within its text. vocab: id, tok, tok_type (a vocabulary's rows)."""
    rows = vocab.select("id", "tok", "tok_type").collect()
    known = pa.array([r.tok for r in rows])
    alone = {"special", "time_sig", "tempo", "key"}
    chars = pa.array([f"\n{chr(r.id + FIRST_CHARACTER)}\n" if r.tok_type in alone else chr(r.id + FIRST_CHARACTER) for r in rows])

    @F.arrow_udf("array<string>")
    def spelled(texts: pa.Array) -> pa.Array:
        made = chars.take(pc.index_in(texts.flatten(), known))
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False))])
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pc.fill_null(made, ""))  # unknown tokens are left out
        return pc.split_pattern(pc.binary_join(lists, ""), "\n")

    return scores.select("song_id", F.filter(spelled(words_of(F.col("score"))), lambda w: w != "").alias("words"))


def piece_pitches(pieces: DataFrame, vocab: DataFrame, with_rests: bool = True) -> DataFrame:
    """piece, pitches: the pitches of the tokens that each distinct piece (of characters) stands for, in their order; a rest is -1."""
    bare = F.when(F.col("piece").startswith("##") & (F.length("piece") > 2), F.substr("piece", F.lit(3))).otherwise(F.col("piece"))
    rows = pieces.select("piece").distinct().select("piece", F.posexplode(F.split(bare, r"(?!\A)(?!\z)")).alias("k", "c"))
    rows = rows.withColumn("id", F.conv(F.hex(F.encode("c", "UTF-16BE")), 16, 10).cast("int") - FIRST_CHARACTER)
    rows = rows.join(F.broadcast(vocab.select("id", "tok")), "id", "left")  # a vocabulary's rows
    heard = S.is_pitch_heard(F.col("tok")) | (F.col("tok") == "p_r") if with_rests else S.is_pitch_heard(F.col("tok"))
    got = rows.groupBy("piece").agg(F.array_sort(F.collect_list(F.when(heard, F.struct("k", S.midi_of(F.col("tok")).alias("m"))))).alias("x"))
    return got.select("piece", F.transform("x", lambda x: x["m"]).alias("pitches"))
