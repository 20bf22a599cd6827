"""Packing of token sequences by minimum bin slack.

Each task tokenises the documents of its partition and packs them window by window. Whole windows of long documents go
first. Of the remaining lengths a bitset subset-sum picks the multiset that fills a window closest to its capacity, and
the counts are traced back. What slack is left is closed with a piece cut from the longest remaining document; the last
tokens of a task are cut into windows whose lengths are powers of two, which need no padding. So there is no shuffle,
and a lost task gives the same windows again: its partition holds the same rows in the same order.

Null and empty texts are the closing id alone. Repeated rows and ids are packed each. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import documents, small_batches, texts_of

WINDOW, CLOSING_ID, BUFFER_TOKENS = 2048, 1, 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# Fixed value: how byte-level BPE of this family cuts a text before merging.
CUTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranked(tokenizer):
    """The same encoding by ranks alone, which is faster, where ids follow the order of merges; else None."""
    try:
        import tiktoken
    except ImportError:
        return None
    spec = json.loads(tokenizer.to_str())
    vocabulary, merges = spec["model"].get("vocab", {}), spec["model"].get("merges") or []
    made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in merges]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    plain = [t for t in vocabulary if t not in special]
    cutter = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type") != "BPE" or spec.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or None in made or made != sorted(made) or not all(set(t) <= set(letter) for t in plain):
        return None
    return tiktoken.Encoding("ranked", pat_str=CUTS, mergeable_ranks={bytes(letter[c] for c in t): vocabulary[t] for t in plain}, special_tokens={})


class Encoder:
    """Ids of whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) or r"\Z\A.")
        self.fast = ranked(self.tokenizer)

    def __call__(self, text: str, closing: bytes = b"") -> np.ndarray:
        """Little-endian 32-bit ids, and the closing ones."""
        if self.fast is not None and not self.special.search(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.frombuffer(array("I", ids).tobytes() + closing, "<u4")


def lengths(mask: int, most: int):
    """The set bits up to `most`, from the largest."""
    mask &= (1 << (most + 1)) - 1
    while mask:
        n = mask.bit_length() - 1
        yield n
        mask ^= 1 << n


def closest(counts: dict[int, int], capacity: int, mask: int | None = None) -> dict[int, int]:
    """The multiset of lengths (length -> times) whose sum comes closest to capacity from below. mask: the lengths as bits."""
    if mask is None:
        mask = sum(1 << n for n in counts)
    reach, inside, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in lengths(mask, capacity):
        left, k = min(counts[length], capacity // length), 1
        while left and not reach >> capacity & 1:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << length * k & inside
            left, k = left - k, k * 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            at -= length * k
            chosen[length] += k
    return dict(chosen)


class Counts:
    """The number of pieces of each length in a pool."""

    def __init__(self, pool: dict[int, list]):
        self.pool = pool

    def __getitem__(self, length: int) -> int:
        return len(self.pool[length])


class Packer:
    """Windows of the documents given so far; pool: what is left of documents, by length."""

    def __init__(self, window: int, first_sequence: int):
        self.window, self.sequence, self.pool, self.mask, self.total = window, first_sequence, defaultdict(list), 0, 0

    def add(self, doc: tuple, begin: int, length: int):
        if length:
            self.pool[length].append((doc, begin))
            self.mask |= 1 << length
            self.total += length

    def take(self, length: int) -> tuple:
        at = self.pool[length].pop()
        if not self.pool[length]:
            self.mask ^= 1 << length
        self.total -= length
        return (*at, length)

    def close(self, pieces: list[tuple]):
        at = 0
        for (doc_id, ids), begin, length in pieces:
            yield doc_id, begin, length, zlib.crc32(ids[begin : begin + length].tobytes()), len(ids), self.sequence, at
            at += length
        self.sequence += 1

    def documents(self, docs: list[tuple]):
        for doc in docs:
            n = len(doc[1])
            for begin in range(0, n - n % self.window, self.window):
                yield from self.close([(doc, begin, self.window)])
            self.add(doc, n - n % self.window, n % self.window)
        while self.total >= self.window:
            yield from self.fill(self.window)

    def fill(self, window: int):
        """Close one window of exactly this many tokens; the pool holds as many."""
        pieces, room = [], window
        if longest := next(lengths(self.mask, room), 0):
            pieces.append(self.take(longest))
            room -= longest
        for length, times in closest(Counts(self.pool), room, self.mask).items():
            pieces += [self.take(length) for _ in range(times)]
            room -= length * times
        if room:
            doc, begin, length = self.take(self.mask.bit_length() - 1)
            pieces.append((doc, begin, room))
            self.add(doc, begin + room, length - room)
        yield from self.close(pieces)

    def finish(self):
        while self.total:
            yield from self.fill(1 << (self.total.bit_length() - 1))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, closing_id: int = CLOSING_ID) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. window: a power of two."""
    small_batches(docs.sparkSession)

    def run(batches):
        encode, packer = Encoder(tokenizer), Packer(window, TaskContext.get().partitionId() << 40)
        kind = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])

        def out(rows):
            rows = list(rows)
            cols = zip(*rows, strict=True) if rows else [[]] * len(kind)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=kind)

        held, tokens, closing = [], 0, np.array([closing_id], "<u4").tobytes()
        for ids, texts in texts_of(batches):
            for i, t in zip(ids, texts, strict=True):
                held.append((i, encode(t, closing)))
                tokens += len(held[-1][1])
            if tokens >= BUFFER_TOKENS:
                yield out(packer.documents(held))
                held, tokens = [], 0
        yield out(packer.documents(held))
        yield out(packer.finish())

    return documents(docs).mapInArrow(run, SCHEMA)
