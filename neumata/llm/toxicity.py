"""Toxicity by multiple-instance learning: labels are of documents, scores are of sentences.

A sentence has the logistic score of its hashed words and word beginnings; a document is toxic unless every sentence is
harmless (noisy-or). The weights are fitted through that noisy-or on a bounded sample of labelled documents, so sentences
need no labels. A sentence without any weighted feature scores 0, and so does one under FLOOR: a long harmless text is no
more toxic than a short one.

Fitting reads the sample twice. Features are counted by label where the texts are, and the chosen ones alone, as distinct
bags of sentences with their numbers, reach the driver. Texts of any length are scored whole.

Null and empty texts have no sentence and score 0. Repeated rows are scored each. Equal scores are equal: nothing is ranked.
Columns beyond doc_id and text are not read. Without usable labels all score 0. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, label_sample, small_batches, texts_of

#: Documents to learn from at most (about: a hash draws them), characters of the longest of them, and the width of the hashed word space.
MAX_TRAIN_DOCS, MAX_TRAIN_CHARS, WIDTH = 6_000, 200_000, 1 << 18
#: A feature must be in so many toxic documents, and so many times as often as in harmless ones. Sentences under FLOOR count as harmless.
LEAST, LIFT, FLOOR = 3, 3.0, 0.02
#: Sentence ends; also cell borders, since tables put one statement in a cell.
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n|]+")
SENTENCE = re.compile(r"[^.!?\n|]*[^\W\d_][^.!?\n|]*")


def features(word: str) -> list[int]:
    """Hashed ids of a word and of its first 4, 5 and 6 letters: a stem can offend in words never seen."""
    return [zlib.crc32(f"{k}{word[:k] if k else word}".encode("utf-8", "surrogatepass")) % WIDTH for k in (0, 4, 5, 6)]


def tokens(text: str) -> tuple[list[str], np.ndarray]:
    """(words of a whole text, sentence of each)."""
    found = TOKEN.findall(text.lower())
    end = np.fromiter((t[0] in ".!?\n|" for t in found), bool, len(found))
    return [t for t, e in zip(found, end, strict=True) if not e], np.cumsum(end)[~end]


class Words:
    """Values of words, worked out once and remembered; the memory has a bound."""

    def __init__(self, of, kind, width: int, most: int = 200_000):
        self.of, self.kind, self.width, self.most, self.known = of, kind, width, most, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        for w in set(words).difference(known):
            known[w] = self.of(w)
        out = np.array([known[w] for w in words], self.kind).reshape(len(words), *[self.width] * (self.width > 1))
        if len(known) > self.most:
            known.clear()
        return out


@dataclass
class Model:
    """Weights of hashed features (others have none) and the bias of a sentence that holds one of them."""

    weight: dict[int, float]
    bias: float

    def words(self) -> Words:
        return Words(lambda w: sum(self.weight.get(f, 0.0) for f in features(w)), np.float64, 1)

    def sentences(self, words: Words, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(sentence numbers, their scores)."""
        found, sentence = tokens(text)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        first = np.flatnonzero(np.diff(sentence, prepend=-1))
        w = words(found)
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w, first) + self.bias, -30, 30)))
        return sentence[first], np.where((np.add.reduceat(w != 0, first) > 0) & (p >= FLOOR), p, 0.0)


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def chosen(counts: np.ndarray, totals: np.ndarray, least: int = LEAST, lift: float = LIFT) -> np.ndarray:
    """The features that speak for toxicity. counts: documents that hold a feature, by label; totals: documents by label."""
    more = (counts[1] + 0.5) / (totals[1] + 1) > lift * (counts[0] + 0.5) / (totals[0] + 1)
    return np.flatnonzero((counts[1] >= least) & more)


def bag_of(ids: np.ndarray, sentence: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, end of each sentence) of the distinct bags of a text, each sentence followed by its number of times.

    ids: hashed features, one row a word; place: the place of a feature among the chosen ones, or -1.
    """
    at = place[ids]
    row, col = np.nonzero(at >= 0)
    if not len(row):
        return np.zeros(0, np.int32), np.zeros((0, 2), np.int32)
    found, owner = at[row, col], sentence[row]
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    bags: dict[bytes, int] = {}
    for a, e in zip(first, np.append(first[1:], len(owner)), strict=True):
        key = np.sort(found[a:e]).astype(np.int32).tobytes()
        bags[key] = bags.get(key, 0) + 1
    ends = np.cumsum([len(k) // 4 for k in bags])
    return np.frombuffer(b"".join(bags), np.int32), np.stack([ends, list(bags.values())], 1).astype(np.int32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, used: np.ndarray, rounds: int = 150, rate: float = 0.5, l2: float = 0.01) -> Model:
    """Adagrad on the noisy-or likelihood. bags: of documents, as bag_of gives them; used: the chosen features."""
    if not len(used) or not len(y) or y.min() == y.max():
        return Model({}, -30.0)
    times = np.concatenate([b[1][:, 1] for b in bags]).astype(float)
    doc = np.repeat(np.arange(len(bags)), [len(b[1]) for b in bags])
    sizes = np.concatenate([np.diff(b[1][:, 0], prepend=0) for b in bags])
    at, owner = np.concatenate([b[0] for b in bags]), np.repeat(np.arange(len(doc)), sizes)
    w, bias, seen, seen_b = np.zeros(len(used)), -3.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[at], len(doc)) + bias, -30, 30)))
        none = np.bincount(doc, times * np.log1p(-np.minimum(p, 1 - 1e-12)), len(bags))
        toxic = np.maximum(-np.expm1(none), 1e-9)
        grad = times * p * np.where(y > 0, -np.exp(none) / toxic, 1.0)[doc] / len(bags)
        g, gb = np.bincount(at, grad[owner], len(used)) + l2 / len(bags) * w, grad.sum()
        seen, seen_b = seen + g * g, seen_b + gb * gb
        w, bias = w - rate * g / np.sqrt(seen), bias - rate * gb / np.sqrt(seen_b)
    return Model(dict(zip(used.tolist(), w.tolist(), strict=True)), float(bias))


def fit(docs: DataFrame, labels: DataFrame, keep, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """The model from about max_docs labelled documents (their ids are broadcast) of MAX_TRAIN_CHARS at most, for which `keep` holds."""
    small_batches(docs.sparkSession)
    sample = label_sample(labels, "toxic", keep, max_docs)
    some = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where(F.length("text") <= MAX_TRAIN_CHARS).select("doc_id", "text", "y")

    def count(batches):
        words, held, total = Words(features, np.int32, 4), np.zeros((2, WIDTH), np.int64), [0, 0]
        for b in batches:
            for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if found := tokens(text)[0]:
                    held[y, np.unique(words(found))] += 1
                    total[y] += 1
        label, feature = np.nonzero(held)
        n = np.concatenate([held[label, feature], total])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([label, [0, 1]])), pa.array(np.concatenate([feature, [-1, -1]])), pa.array(n)], ["y", "feature", "n"])

    counted = some.mapInArrow(count, "y long, feature long, n long").groupBy("y", "feature").agg(F.sum("n").alias("n"))
    often = counted.where(F.col("feature") >= 0).groupBy("feature").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("plain"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    held, totals = np.zeros((2, WIDTH), np.int64), np.zeros(2, np.int64)
    for r in often.where(F.col("toxic") >= LEAST).unionByName(counted.where("feature < 0").select(F.col("feature"), F.col("y").alias("plain"), F.col("n").alias("toxic"))).collect():  # WIDTH rows at most
        if r.feature < 0:
            totals[r.plain] = r.toxic
        else:
            held[:, r.feature] = r.plain, r.toxic
    used = chosen(held, totals)
    place = np.full(WIDTH, -1, np.int32)
    place[used] = np.arange(len(used))

    def gather(batches):
        words = Words(features, np.int32, 4)
        for b in batches:
            out = []
            for i, text, y in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                found, sentence = tokens(text)
                if found:
                    bag, ends = bag_of(words(found), sentence, place)
                    out.append((i, bag.tobytes(), ends.tobytes(), y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.int32()), strict=True)], ["doc_id", "bag", "ends", "y"])

    got = some.mapInArrow(gather, "doc_id long, bag binary, ends binary, y int").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1]), r[3]))
    bags = [(np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.int32).reshape(-1, 2)) for r in got]
    return train(bags, np.array([r[3] for r in got], float), used)


def score(docs: DataFrame, model: Model, locate: float = 0.5) -> DataFrame:
    """doc_id, score, and the offending sentences (code points, end exclusive) whose own score reaches `locate`."""
    small_batches(docs.sparkSession)

    def run(batches):
        words = model.words()
        for ids, texts in texts_of(batches):
            scores, spans = [], []
            for t in texts:
                _, p = model.sentences(words, t)
                scores.append(noisy_or(p))
                spans.append(offending(t, model, words, locate) if len(p) and p.max() >= locate else [])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "score", "sentences"])

    return documents(docs).mapInArrow(run, "doc_id long, score double, sentences array<struct<start:long,end:long,score:double>>")


def offending(text: str, model: Model, words: Words, least: float) -> list[dict]:
    out = []
    for m in SENTENCE.finditer(text):
        _, p = model.sentences(words, m[0])
        if len(p) and p.max() >= least:
            out.append({"start": m.start(), "end": m.end(), "score": float(p.max())})
    return out


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences; ids whose crc32 modulo `folds` is `held` are never learned from."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model = fit(docs, labels, fold != held)
    return score(docs, model).select("doc_id", (fold == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "sentences")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs scored under the threshold, with all their columns, where they stand."""
    model = fit(docs, labels, F.lit(True))
    at = docs.columns.index("text")

    def run(batches):
        words = model.words()
        for b in batches:
            keep = [noisy_or(model.sentences(words, t or "")[1]) < threshold for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
