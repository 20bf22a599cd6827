"""Column functions: token typing and meaning, exact durations, portable hashes, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import LETTERS, TEMPO_HIGH, TEMPO_LOW, TICKS_PER_QUARTER

SLOT_TICKS = TICKS_PER_QUARTER // 8


def hashed(*parts) -> Column:
    """A seeded hash that other engines can repeat: the first 60 bits of the md5 of the parts, joined by '|'."""
    text = F.concat_ws("|", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A number in [0, 1) from the hash."""
    return hashed(*parts) / F.lit(float(1 << 60))


def tok_type(tok: Column) -> Column:
    out = F.lit("special")
    for prefix, kind in (("Key_", "key"), ("Tempo_", "tempo"), ("TimeSig_", "time_sig"), ("d_", "duration"), ("p_", "pitch")):
        out = F.when(tok.startswith(prefix), kind).otherwise(out)
    return out


def is_pitch_heard(tok: Column) -> Column:
    """A pitch that is neither a rest nor rare."""
    return tok.startswith("p_") & ~tok.isin("p_r", "p_rare")


def group(tok: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(tok, pattern, k), F.lit(""))


PITCH, DURATION = r"^p_(\d+)/(-?\d+)(?:_([A-G1-7]))?$", r"^d_(\d+)(?:/(\d+))?$"


def midi_of(tok: Column) -> Column:
    """As written: spellings that cross an octave come out 12 off, rests are -1, rare pitches null."""
    return F.when(tok == "p_r", -1).otherwise(group(tok, PITCH, 1).cast("int") - 1 + (group(tok, PITCH, 2).cast("int") + 1) * 12)


def meta(tok: Column) -> Column:
    """The meaning of a token as a sparse struct; rare values are null, but for the stand-ins 39 and 241 of tempos."""
    ts, tempo = r"^TimeSig_(\d+)/(\d+)$", r"^Tempo_(\d+)$"
    suffix = group(tok, PITCH, 3)
    return F.struct(
        group(tok, ts, 1).cast("int").alias("ts_num"),
        group(tok, ts, 2).cast("int").alias("ts_den"),
        F.when(tok == "Tempo_low", TEMPO_LOW - 1).when(tok == "Tempo_high", TEMPO_HIGH + 1).otherwise(group(tok, tempo, 1).cast("int")).alias("tempo"),
        group(tok, r"^Key_(\w[#b]?(?:Major|Minor))$", 1).alias("key"),
        midi_of(tok).alias("midi"),
        F.when(suffix.rlike("[A-G]"), suffix).alias("step"),
        F.when(suffix.rlike("[1-7]"), suffix).cast("int").alias("degree"),
        group(tok, DURATION, 1).cast("int").alias("dur_num"),
        F.when(tok.rlike(DURATION), F.coalesce(group(tok, DURATION, 2).cast("int"), F.lit(1))).alias("dur_den"),
    )


def pitch_token(midi: Column) -> Column:
    return F.when(midi < 0, "p_r").otherwise(F.concat(F.lit("p_"), (F.pmod(midi, 12) + 1).cast("string"), F.lit("/"), (F.floor(midi / 12).cast("int") - 1).cast("string")))


def slots_token(slots: Column) -> Column:
    """The duration token of a number of grid slots (eighths of a quarter), as a reduced fraction."""
    out = F.concat(F.lit("d_"), (slots / 8).cast("long").cast("string"))
    for d in (4, 2, 1):
        out = F.when(slots % (2 * d) == d, F.concat(F.lit("d_"), (slots / d).cast("long").cast("string"), F.lit(f"/{8 // d}"))).otherwise(out)
    return out


def time_sig_token(num: Column, den: Column) -> Column:
    return F.concat(F.lit("TimeSig_"), num.cast("string"), F.lit("/"), den.cast("string"))


def duration_ticks(tok: Column) -> Column:
    return (group(tok, DURATION, 1).cast("long") * TICKS_PER_QUARTER / F.coalesce(group(tok, DURATION, 2).cast("long"), F.lit(1))).cast("long")


def snapped(midi: Column) -> Column:
    """Into 0..127 by octaves."""
    return F.when(midi < 0, F.pmod(midi, 12)).when(midi > 127, 127 - F.pmod(127 - midi, 12)).otherwise(midi)


def letter_index(letter: Column) -> Column:
    return F.position(letter, F.lit(LETTERS)) - 1


def degree(step: Column, key: Column) -> Column:
    """Scale degree 1..7 of a step letter in a key (its name); accidentals do not count; null (a rest) is 0."""
    return F.when(step.isNull() | (step == ""), 0).otherwise(F.pmod(letter_index(step) - letter_index(F.substring(key, 1, 1)), 7) + 1).cast("int")


def frequency(midi: Column) -> Column:
    return F.when(midi < 0, 0.0).otherwise(440.0 * F.pow(F.lit(2.0), (midi - 69) / 12.0))


def tempo_bin(tempo: Column, width: int = 5) -> Column:
    """The first tempo of the bin; the last bin takes the upper bound too; tempos out of range stay what they are."""
    first = TEMPO_LOW + (F.least(tempo, F.lit(TEMPO_HIGH - 1)) - TEMPO_LOW - F.pmod(F.least(tempo, F.lit(TEMPO_HIGH - 1)) - TEMPO_LOW, width))
    return F.when(tempo.between(TEMPO_LOW, TEMPO_HIGH), first).otherwise(tempo)


def tempo_bin_token(tempo: Column, width: int = 5) -> Column:
    first = tempo_bin(tempo, width)
    last = first + width - 1 + (first + width == TEMPO_HIGH).cast("int")
    binned = F.concat(F.lit("Tempo_"), first.cast("string"), F.lit("/"), last.cast("string"))
    return F.when(tempo < TEMPO_LOW, "Tempo_low").when(tempo > TEMPO_HIGH, "Tempo_high").otherwise(binned)


def minutes(seconds: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(seconds / 60), F.pmod(seconds, 60))


#: Accented letters and what they fold to, one by one.
FOLD = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY")


def folded(title: Column) -> Column:
    return F.translate(title, *FOLD)


def bpm(microseconds: Column) -> Column:
    return 60e6 / microseconds


def on_grid(ticks: Column, parts: int) -> Column:
    """Whether a duration is a whole number of quarters' parts (1: whole quarters, 2: eighths, 2^(precision - 2): the grid of a precision)."""
    return ticks % (TICKS_PER_QUARTER // parts) == 0


def short_key(key: Column) -> Column:
    """'F#Minor' as 'F#m', 'CMajor' as 'C'."""
    return F.regexp_replace(F.regexp_replace(key, "Major$", ""), "Minor$", "m")


def meta_text(**parts: Column) -> Column:
    """'{a=1, b=x}': parameters in a file's name."""
    return F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items())), F.lit("}"))


def last_wins(first: Column, second: Column) -> Column:
    """Two maps as one; keys of both take the second one's value."""
    return F.map_concat(F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k)), second)
