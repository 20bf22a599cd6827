"""Dimension tables: keys, key profiles, pitch spellings, warning types, vocabularies. All are small and of fixed size."""

from __future__ import annotations

from math import gcd

from pyspark.sql import DataFrame, SparkSession

#: A duration is counted in ticks; every grid value and every share of a tuplet of up to 16 notes is whole.
TICKS_PER_QUARTER = 5_765_760

# Keys in the order of their ordinals, tonic pitch classes, notes outside a key, key profiles.
MAJOR = ("C", "F", "Bb", "Eb", "Ab", "Db", "Gb", "B", "E", "A", "D", "G")
MINOR = ("A", "D", "G", "C", "F", "Bb", "Eb", "G#", "C#", "F#", "B", "E")
TONIC = {"C": 0, "C#": 1, "Db": 1, "D": 2, "Eb": 3, "E": 4, "F": 5, "F#": 6, "Gb": 6, "G": 7, "G#": 8, "Ab": 8, "A": 9, "Bb": 10, "B": 11}
OFF_KEY = {"Major": (1, 3, 6, 8, 10), "Minor": (1, 4, 6, 9, 11)}
PROFILE = {
    "Major": (0.748, 0.060, 0.488, 0.082, 0.670, 0.460, 0.096, 0.715, 0.104, 0.366, 0.057, 0.400),
    "Minor": (0.712, 0.084, 0.474, 0.618, 0.049, 0.460, 0.105, 0.747, 0.404, 0.067, 0.133, 0.330),
}
LETTERS = "CDEFGAB"

# Spellings of each pitch class, usual and kept rare ones (letter, octave shift in writing).
SPELLINGS = (
    (("C", 0), ("B", -1)), (("C", 0), ("D", 0)), (("D", 0), ("C", 0)), (("D", 0), ("E", 0)), (("E", 0), ("F", 0)), (("F", 0), ("E", 0)),
    (("F", 0), ("G", 0)), (("G", 0), ("F", 0)), (("G", 0), ("A", 0)), (("A", 0), ("B", 0), ("G", 0)), (("A", 0), ("B", 0)), (("B", 0), ("C", 1)),
)
USUAL = (1, 2, 1, 2, 1, 1, 2, 1, 2, 1, 2, 1)

# Common time signatures, tempo bounds, special tokens.
TIME_SIGNATURES = ((2, 2), (2, 4), (3, 4), (4, 4), (5, 4), (6, 8), (12, 8))
TEMPO_LOW, TEMPO_HIGH, MAX_QUARTERS = 40, 240, 6
SPECIALS = ("[OMIT]", "[PAD]", "<bar>", "</s>", "<melody>", "<bass>", "<tup>", "</tup>")

# Warning types and how severe each is.
WARNINGS = {
    "Beginning Empty Bars": 1, "Ending Empty Bars": 1, "Multiple Tempos": 2, "Multiple Time Signatures": 2, "Missing Tempo": 3,
    "Inconsistent Time Signatures": 3, "Rare Time Signature": 3, "Rare Mean Tempo": 3, "Rests Beyond Time Signature": 3,
    "Higher Pitch Overlap": 6, "Higher Pitch Overlap with Triplet": 6, "Lower Pitch Makeup": 6, "Lower Pitch Makeup Removed": 6,
    "Invalid Tuplet Size": 6, "Tuplet Group Duration Too Low": 6, "Invalid Tuplet Durations": 6, "Invalid Tuplet Durations, Severe": 8,
    "Rest in Tuplet": 8, "Excessive Tuplet Chord Notes": 8, "Tuplet Notes Quantizable": 8, "Gap Observed in Consecutive Tuplets": 8,
    "Notes Beyond Quantization": 10, "Tuplet Total Duration Beyond Quantization": 12, "Input Tuplet Notes Overlap": 8,
    "Output Tuplet Notes Overlap": 12, "Invalid Bar Notes Duration": 12, "Gap in extracted Bar Notes": 14,
}


def key_rows(fix_e_minor: bool = True) -> list[tuple]:
    """key, ordinal, mode (0 minor, 1 major), tonic, tonic_pc, off_offsets. fix_e_minor=False takes pitch class 3 for E minor."""
    rows = [(f"{t}Major", k, 1, t, TONIC[t], list(OFF_KEY["Major"])) for k, t in enumerate(MAJOR)]
    for k, t in enumerate(MINOR):
        rows.append((f"{t}Minor", 12 + k, 0, t, 3 if t == "E" and not fix_e_minor else TONIC[t], list(OFF_KEY["Minor"])))
    return rows


def keys(spark: SparkSession, fix_e_minor: bool = False) -> DataFrame:
    return spark.createDataFrame(key_rows(fix_e_minor), "key string, ordinal int, mode int, tonic string, tonic_pc int, off_offsets array<int>").coalesce(1)


def profile_rows() -> list[tuple]:
    """key, mode, pc, weight: 24 keys by 12 pitch classes."""
    return [(k, m, pc, PROFILE["Major" if m else "Minor"][(pc - t) % 12]) for k, _, m, _, t, _ in key_rows() for pc in range(12)]


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(profile_rows(), "key string, mode int, pc int, weight double").coalesce(1)


def duration_text(num: int, den: int) -> str:
    g = gcd(num, den)
    return f"d_{num // g}" if den == g else f"d_{num // g}/{den // g}"


def tempo_bins(width: int) -> list[tuple[int, int, int]]:
    """first, last, mean of each bin; the last bin is one wider; means round half to even."""
    starts = range(TEMPO_LOW, TEMPO_HIGH, width)
    out = [(s, s + width - 1 + (s + width == TEMPO_HIGH)) for s in starts]
    return [(a, b, round((a + b) / 2)) for a, b in out]


def vocab_rows(kind: str = "midi", precision: int = 5, tempo_bin: int | None = None, rare_steps: bool = True) -> list[tuple[int, str, str]]:
    """id, token, type in the order of ids. kind: midi, step or degree."""
    written = lambda m, shift=0: f"p_{m % 12 + 1}/{m // 12 - 1 + shift}"
    if kind == "midi":
        pitches = [written(m) for m in range(128)]
    elif kind == "step":
        pitches = [f"{written(m, s)}_{x}" for m in range(128) for x, s in SPELLINGS[m % 12][: None if rare_steps else USUAL[m % 12]]]
    else:
        pitches = [f"{written(m)}_{d}" for m in range(128) for d in range(1, 8)]
    tempos = [f"{a}/{b}" for a, b, _ in tempo_bins(tempo_bin)] if tempo_bin else [str(t) for t in range(TEMPO_LOW, TEMPO_HIGH + 1)]
    slots = MAX_QUARTERS * 2**precision // 4
    groups = {
        "special": SPECIALS,
        "time_sig": ("TimeSig_rare", *(f"TimeSig_{n}/{d}" for n, d in TIME_SIGNATURES)),
        "tempo": ("Tempo_low", *(f"Tempo_{t}" for t in tempos), "Tempo_high"),
        "key": tuple(sorted(f"Key_{r[0]}" for r in key_rows())),
        "pitch": ("p_r", "p_rare", *pitches),
        "duration": ("d_rare", *(duration_text(4 * k, 2**precision) for k in range(1, slots + 1))),
    }
    return [(i, tok, kind_) for i, (kind_, tok) in enumerate((g, t) for g, ts in groups.items() for t in ts)]


def vocab(spark: SparkSession, kind: str = "midi", **options) -> DataFrame:
    """id, tok, tok_type; at most some 1,200 rows, so it may always be broadcast."""
    return spark.createDataFrame(vocab_rows(kind, **options), "id int, tok string, tok_type string").coalesce(1)


def warning_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, k, s) for k, (n, s) in enumerate(WARNINGS.items())], "warn_type string, ordinal int, severity int").coalesce(1)
