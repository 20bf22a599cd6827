"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

A text without words is scored like any other (its statistics are zeros). Null texts count as empty. Repeated rows are
scored each, texts of any length whole, and equal statistics get equal scores. Columns beyond doc_id and text are not read.
Without usable labels every score is the constant 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt, textstats
from .common import MAX_TRAIN_ROWS, documents, label_sample, small_batches, texts_of


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, features array<double> (textstats.NAMES) of every text."""
    small_batches(docs.sparkSession)

    def run(batches):
        for ids, texts in texts_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(textstats.matrix(texts)), pa.list_(pa.float64()))], ["doc_id", "features"])

    return documents(docs).mapInArrow(run, "doc_id long, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, column: str, keep, max_rows: int = MAX_TRAIN_ROWS, **params) -> gbt.Trees:
    """Trees from about max_rows labelled rows, for which `keep` (a condition on doc_id) holds.

    The sampled ids are broadcast: a hash draws them, so their number has that bound.
    """
    sample = label_sample(labels, column, keep, max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    got = statistics(rows).join(F.broadcast(sample), "doc_id").select("doc_id", "features", "y").collect()
    got.sort(key=lambda r: (r[0], r[1]))
    x = np.array([r[1] for r in got]).reshape(len(got), len(textstats.NAMES))
    return gbt.fit(x, np.array([r[2] for r in got], float), **params)


def score(docs: DataFrame, model: gbt.Trees) -> DataFrame:
    """doc_id, score (0 to 1) of every text, in one pass over the input and without a shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        for ids, texts in texts_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.score(textstats.matrix(texts)))], ["doc_id", "score"])

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted; ids whose crc32 modulo `folds` is `held` are never learned from."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    model = fit(docs, labels, "quality", fold != held)
    return score(docs, model).select("doc_id", (fold == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
