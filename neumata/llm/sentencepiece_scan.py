"""SentencePiece encoding and decoding; giant texts by a max-plus parallel scan.

A byte-pair encoding is the one sequence of pieces of a text in which every two neighbours are compatible: encoded
together, they come out as they are. So encoding is a path of weight 0 in a lattice whose other edges weigh minus
infinity, and a stretch of text acts on it as a max-plus matrix from the pieces that may cover its left border to those
that may cover its right one. Texts longer than a chunk are split; each chunk gives its matrix on its own; matrices are
combined associatively from the left and from the right, which fixes the piece at each border; then each chunk is traced
back on its own. Inside a chunk the matrix is a product of rank one wherever a blank follows a word, since no piece of
the model reaches over such a place: there the words between are looked up.

Null and empty texts give one row without ids. Repeated rows and ids are encoded each. An empty table gives no rows.
Columns beyond doc_id and text are not read. U+2581, the model's sign for a blank, decodes as a blank.
"""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, small_batches, texts_of

BLANK, CHUNK = "▁", 1 << 15
WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
INSIDE = re.compile(f"(?<=[^{BLANK}]){BLANK}")
NEVER = -np.inf


class Words(dict):
    """Ids of words already encoded (with a bound)."""

    def __init__(self, model: Model, most: int):
        self.model, self.most = model, most

    def __missing__(self, word: str) -> tuple:
        model = self.model
        # the library puts one blank before what it encodes, so it gives a word after one blank as it stands here
        plain = word[0] == BLANK and len(word) > 1 and word[1] != BLANK
        ids = tuple(model.whole(word[1:]) if plain else model.ids_of(model.pieces(word)))
        if len(self) >= self.most:
            self.clear()
        self[word] = ids
        return ids


class Model:
    """Pieces, their scores, and words already encoded."""

    def __init__(self, path: str, most: int = 100_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize, self.whole, self.most, self.words, self.pairs = sp.normalize, sp.encode, most, Words(self, most), {}
        every = range(sp.get_piece_size())
        self.ids = {sp.id_to_piece(i): i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in every if sp.is_byte(i)}
        self.surface = {i: p.encode() for p, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.longest = max(map(len, self.ids))

    def pieces(self, text: str) -> list[str]:
        """Byte-pair encoding: the best-scored pair merges first, the leftmost of equals."""
        if text in self.ids and len(text) == 1 or not text:
            return [text] if text else []
        at, score = list(text), self.score
        left, right = list(range(-1, len(at) - 1)), list(range(1, len(at) + 1))
        heap = [(-score[at[i] + at[i + 1]], i, at[i] + at[i + 1]) for i in range(len(at) - 1) if at[i] + at[i + 1] in score]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = right[i]
            if at[i] is None or j >= len(at) or at[i] + at[j] != both:
                continue
            at[i], at[j], right[i] = both, None, right[j]
            if right[j] < len(at):
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < len(at) and (new := at[a] + at[b]) in score:
                    heapq.heappush(heap, (-score[new], a, new))
        return [p for p in at if p is not None]

    def ids_of(self, pieces: list[str]) -> list[int]:
        return [i for p in pieces for i in ([self.ids[p]] if p in self.ids else [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")])]

    def spells(self, ids, text: str) -> bool:
        return b"".join(map(self.surface.__getitem__, ids)) == text.encode("utf-8", "surrogatepass")

    def plain(self, text: str) -> list[int]:
        """Ids of a stretch that begins and ends where no piece reaches over."""
        return list(chain.from_iterable(map(self.words.__getitem__, WORD.findall(text))))

    def fit_together(self, a: str, b: str) -> bool:
        if (got := self.pairs.get((a, b))) is None:
            if len(self.pairs) > self.most:
                self.pairs.clear()
            got = self.pairs[a, b] = self.pieces(a + b) == [a, b]
        return got

    def starting(self, text: str, at: int):
        """Ends of the pieces that may start here (a single character always may)."""
        return [e for e in range(at + 1, min(at + self.longest, len(text)) + 1) if e == at + 1 or text[at:e] in self.ids]

    def borders(self, text: str, cut: int) -> list[tuple[int, int]]:
        """States at a border: the pieces (begin, end) that may cover the character before it."""
        if cut <= 0:
            return [(0, 0)]
        if cut >= len(text):
            cut = len(text)
        return [(a, e) for a in range(max(0, cut - self.longest), cut) for e in self.starting(text, a) if e >= cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids as a whole: without the blank that encoding puts before it."""
        text = b"".join(self.surface.get(i, b"") for i in ids).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def model_of(path: str) -> Model:
    """The model, read once in a worker, whose tasks share the words known so far."""
    return Model(path)


def walk(model: Model, text: str, start: tuple[int, int], stop: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """All paths from a piece to those that cover `stop`, as the pieces after it; one path each.

    A piece keeps the one before it, and paths are read backwards from their ends.
    """
    ends, before, done = {start[1]: [start]}, {start: None}, []
    for at in range(start[1], stop + model.longest + 1):
        reached = ends.pop(at, ())
        if at >= stop:
            done += reached
        elif reached:
            for e in model.starting(text, at):
                for token in reached:
                    if token[0] == token[1] or model.fit_together(text[token[0] : token[1]], text[at:e]):
                        before[at, e] = token
                        ends.setdefault(e, []).append((at, e))
                        break
        if not ends:
            break
    out = {}
    for token in done:
        path, at = [], token
        while before[at] is not None:
            path.append(at)
            at = before[at]
        out[token] = path[::-1]
    return out


def places(text: str, begin: int, end: int) -> tuple[int, int] | None:
    """First and last place in a stretch over which no piece reaches, if there is one."""
    found = [m.start() for m in INSIDE.finditer(text, begin, end) if m.start() > begin]
    return (found[0], found[-1]) if found else None


def paths(model: Model, text: str, begin: int, end: int, u: tuple[int, int]):
    """(head, tails) of a chunk entered by piece u: paths to the first place and from the last, or (None, whole paths)."""
    got = places(text, max(begin, u[1]), end)
    if got is None:
        return None, walk(model, text, u, end)
    first, last = got
    head = [p for t, p in walk(model, text, u, first).items() if t[1] == first]
    return (head[0] if head else []), (walk(model, text, (last, last), end) if head else {})


def transfer(model: Model, text: str, begin: int, end: int) -> np.ndarray:
    """The max-plus matrix of a chunk. text has the context of both borders."""
    rows, cols = model.borders(text, begin), model.borders(text, end)
    out = np.full((len(rows), len(cols)), NEVER)
    place = {v: k for k, v in enumerate(cols)}
    for r, u in enumerate(rows):
        if u[1] >= end:  # the piece covers the whole chunk
            reached = [u]
        else:
            reached = paths(model, text, begin, end, u)[1]
        for v in reached:
            if v in place:
                out[r, place[v]] = 0.0
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None]).max(1)


def trace(model: Model, text: str, begin: int, end: int, u: tuple[int, int], v: tuple[int, int]) -> list[int]:
    """Ids of the pieces after u up to v."""
    if u[1] >= end:
        return []
    head, tails = paths(model, text, begin, end, u)
    spell = lambda path: model.ids_of([text[a:e] for a, e in path])
    if head is None:
        return spell(tails[v])
    first, last = places(text, max(begin, u[1]), end)
    return [*spell(head), *model.plain(text[first:last]), *spell(tails[v])]


def told(ids: list[int], digested: bool) -> tuple:
    """The columns that tell of ids: the ids themselves, or their number and CRC-32 (as little-endian 32-bit numbers)."""
    return (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) if digested else (ids,)


def columns(digested: bool) -> str:
    return "n_ids long, ids_crc32 long" if digested else "ids array<int>"


KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), KINDS[kind]) for c, (_, kind) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def encode(docs: DataFrame, path: str, chunk: int = CHUNK, digested: bool = False) -> DataFrame:
    """doc_id, chunk, n_chunks, ids, round_trip: the ids of a text are those of its chunks, one after the other.

    round_trip: decoding gave the chunk's own text again. digested: n_ids and ids_crc32 in place of ids. Only texts longer
    than a chunk are dealt out and combined; their chunks are written to the shared folder first, so that a task that runs
    again reads the same rows under the same numbers.
    """
    small_batches(docs.sparkSession)
    out_schema = f"doc_id long, chunk int, n_chunks int, {columns(digested)}, round_trip boolean"
    names = [c.split()[0] for c in out_schema.split(", ")]
    parts = f"row long, text string, begin int, end int, {out_schema}"
    none = (None,) * (len(names) - 4)

    def whole(batches):
        model = model_of(path)
        for ids, texts in texts_of(batches, 64):
            got = model.whole(texts)
            yield batch([(i, 0, 1, *told(x, digested), model.spells(x, model.normalize(t))) for i, t, x in zip(ids, texts, got, strict=True)], out_schema)

    def split(batches):
        model, row = model_of(path), TaskContext.get().partitionId() << 40
        for ids, texts in texts_of(batches, 16):
            out = []
            for i, raw in zip(ids, texts, strict=True):
                text, row = model.normalize(raw), row + 1
                n = max(1, -(-len(text) // chunk))
                if n == 1:
                    got = model.whole(raw)
                    out.append((row, None, 0, 0, i, 0, 1, *told(got, digested), model.spells(got, text)))
                for k in range(n if n > 1 else 0):
                    begin, end = max(0, k * chunk - model.longest), min(len(text), (k + 1) * chunk + model.longest)
                    out.append((row, text[begin:end], k * chunk - begin, min(len(text), (k + 1) * chunk) - begin, i, k, n, *none, None))
            yield batch(out, parts)

    def matrices(batches):
        model = model_of(path)
        for b in batches:
            out = []
            for r in b.to_pylist():
                m = transfer(model, r["text"], r["begin"], r["end"])
                out.append((r["row"], r["chunk"], list(m.shape), (m == 0).ravel().tolist()))
            yield batch(out, "row long, chunk int, shape array<int>, zero array<boolean>")

    def combine(key, pdf):
        pdf = pdf.sort_values("chunk")
        each = [np.where(np.array(z, bool), 0.0, NEVER).reshape(s) for z, s in zip(pdf["zero"], pdf["shape"], strict=True)]
        before, after = [np.zeros((1, 1))], [np.zeros((each[-1].shape[1], 1))]
        for m in each:
            before.append(times(before[-1], m))
        for m in reversed(each):
            after.append(times(m, after[-1]))
        after.reverse()
        at = [int(np.argmax(f[0] + g[:, 0])) for f, g in zip(before, after, strict=True)]
        return pdf[["row", "chunk"]].assign(u=at[:-1], v=at[1:])

    def back(batches):
        model = model_of(path)
        for b in batches:
            out = []
            for r in b.to_pylist():
                text, begin, end = r["text"], r["begin"], r["end"]
                u, v = model.borders(text, begin)[r["u"]], model.borders(text, end)[r["v"]]
                got = trace(model, text, begin, end, u, v)
                out.append((r["doc_id"], r["chunk"], r["n_chunks"], *told(got, digested), model.spells(got, text[u[1] : max(u[1], v[1])])))
            yield batch(out, out_schema)

    some = documents(docs)
    blanks = F.length("text") + 1  # normalising puts one blank before a text, and may change its length otherwise
    rest = cut(some.where(blanks > chunk // 2).mapInArrow(split, parts))
    long = rest.where("text is not null").select("row", "doc_id", "chunk", "n_chunks", "text", "begin", "end").repartition("row", "chunk")
    states = long.mapInArrow(matrices, "row long, chunk int, shape array<int>, zero array<boolean>").groupBy("row").applyInPandas(combine, "row long, chunk int, u int, v int")
    done = long.join(states, ["row", "chunk"]).mapInArrow(back, out_schema)
    return some.where(blanks <= chunk // 2).mapInArrow(whole, out_schema).unionByName(rest.where("text is null").select(*names)).unionByName(done)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids of whole texts (one row a text)."""

    def run(batches):
        model = model_of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
