"""Statistics of whole texts, computed for a batch at a time with numpy."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd

SYMBOLS = "#*$%&|<>"
#: The names of the statistics, in the order of the columns of `matrix`.
NAMES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "mean_word", "symbols_per_word", "bangs_per_word", "pipes_per_word", "upper_share", "digit_share",
    "dup_line_share", "repeat_share", "distinct_share", "stops_per_word", "commas_per_word",
    "words_per_line", "short_word_share", "long_word_share", "other_share", "top_word_share", "char_entropy",
)
WHITE = " \t\n\v\f\r"


def repeated_words(codes: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> np.ndarray:
    """Per document, words inside windows of `width` words that occur twice or more in it (first ones included).

    codes: dense word ids of all documents, one after the other; doc: the document of each word. Exact: windows are
    renumbered pair by pair, never hashed.
    """
    out = np.zeros(n_docs, np.int64)
    if len(codes) < width:
        return out
    win, size = codes.astype(np.int64), int(codes.max()) + 1
    for k in range(1, width):
        win = pd.factorize(win[: len(codes) - k] * size + codes[k:])[0].astype(np.int64)
    starts = np.flatnonzero(doc[: len(win)] == doc[width - 1 :])
    if not len(starts):
        return out
    key = win[starts] * n_docs + doc[starts]
    group = pd.factorize(key)[0]
    again = starts[np.bincount(group)[group] > 1]
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=n_docs).astype(np.int64)


def matrix(texts: list[str | None]) -> np.ndarray:
    """One row of statistics for each text; None counts as empty."""
    n = len(texts)
    x = np.zeros((n, len(NAMES)), np.float64)
    if not n:
        return x
    texts = [t or "" for t in texts]
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # splits at \x20 and \x09-\x0D alone
    count = np.array([len(w) for w in words], np.int64)
    doc = np.repeat(np.arange(n), count)
    flat = np.empty(int(count.sum()), object)
    flat[:] = list(chain.from_iterable(words))
    codes, vocabulary = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), flat)
    repeat = repeated_words(codes, doc, n)
    sizes = np.array([len(w) for w in vocabulary], np.int64)[codes] if len(flat) else np.zeros(0, np.int64)
    short, long = np.bincount(doc[sizes <= 3], minlength=n), np.bincount(doc[sizes >= 15], minlength=n)
    pair = np.sort(codes.astype(np.int64) + doc.astype(np.int64) * (len(vocabulary) + 1))
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    runs = np.diff(np.append(first, len(pair)))
    owner = pair[first] // (len(vocabulary) + 1)
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, runs)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)
        hist = np.bincount(raw, minlength=256)
        symbols = sum(int(hist[ord(c)]) for c in SYMBOLS)
        lines = [s for s in t.split("\n") if s.strip(WHITE)]
        chars = len(t) - sum(int(hist[ord(c)]) for c in WHITE)
        w, c = max(int(count[i]), 1), max(chars, 1)
        upper, digits = int(hist[65:91].sum()), int(hist[48:58].sum())
        letters = max(upper + int(hist[97:123].sum()), 1)
        dup = len(lines) - len(set(lines))
        some = hist[hist > 0] / max(len(raw), 1)
        x[i] = (
            count[i], chars, symbols, dup, repeat[i],
            chars / w, symbols / w, int(hist[33]) / w, int(hist[124]) / w, upper / letters, digits / c,
            dup / max(len(lines), 1), repeat[i] / w, distinct[i] / w, int(hist[46]) / w, int(hist[44]) / w,
            count[i] / max(len(lines), 1), short[i] / w, long[i] / w, 1 - (letters + digits) / c if chars else 0.0, top[i] / w, float(-(some * np.log2(some)).sum()),
        )
    return x
