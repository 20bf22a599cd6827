"""Quality rules: fixed rules first, then gradient-boosted trees with monotonic constraints.

The trees may only lower a document's score as its symbols, capitals, repeated lines or repeated words grow, so a verdict
can be explained by "too much of it". Null texts count as empty and fail the fixed rules, as do all under ten words.
Repeated rows are judged each, texts of any length whole. A score equal to the least one is kept. Columns beyond doc_id and
text are not read by `judge`; `keep_good` returns them as they are. Without usable labels the fixed rules alone decide. An
empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt, textstats
from .common import MAX_TRAIN_ROWS, documents, small_batches, texts_of
from .quality_classifier import fit

#: Statistics that may only lower the score as they grow.
FALLING = ("n_symbols", "n_dup_lines", "n_repeat_words", "symbols_per_word", "bangs_per_word", "pipes_per_word", "upper_share", "dup_line_share", "repeat_share")
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_SCORE = 10, 20, 0.5


def fit_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> gbt.Trees:
    monotone = {textstats.NAMES.index(c): -1 for c in FALLING}
    return fit(docs, labels, "quality", F.lit(True), max_rows, monotone=monotone)


def judge(docs: DataFrame, model: gbt.Trees, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, n_words, the four counts, base_failed, score, kept for every row, in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    counts = textstats.NAMES[:5]

    def run(batches):
        for ids, texts in texts_of(batches):
            x = textstats.matrix(texts)
            failed = (x[:, 0] < MIN_WORDS) | (100 * x[:, 4] > MAX_REPEAT_PERCENT * x[:, 0])
            score = model.score(x)
            cols = [pa.array(ids, pa.int64()), *(pa.array(x[:, k].astype("int64")) for k in range(5)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= min_score))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *counts, "base_failed", "score", "kept"])

    return documents(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; judged where they stand, so nothing is shuffled."""
    model = fit_rules(docs, labels)
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            x = textstats.matrix(b.column(at).to_pylist())
            failed = (x[:, 0] < MIN_WORDS) | (100 * x[:, 4] > MAX_REPEAT_PERCENT * x[:, 0])
            yield b.filter(pa.array(~failed & (model.score(x) >= MIN_SCORE)))

    return docs.mapInArrow(run, docs.schema)
