"""Token texts: parsing to tokens, bars, channels and elements, rendering, vocabulary look-ups and row-wise transforms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import dims
from ..functions import scalars as S


def words(text: Column) -> Column:
    """White-space separated tokens, none for an empty or null text."""
    return F.filter(F.split(F.coalesce(F.trim(text), F.lit("")), r"\s+"), lambda t: t != "")


MARKS = pa.array(["<bar>", "<melody>", "<bass>", "<tup>", "</tup>"])
MARKED = "array<struct<tok:string,bar:int,channel:string,tuplet:int>>"
SONG_ELEMENTS = "array<struct<bar:int,channel:string,elm:int,toks:array<string>>>"


def running(texts: pa.ListArray) -> tuple[pa.Array, np.ndarray, dict[str, np.ndarray]]:
    """(tokens of all texts, where each text begins and the last ends, for each token: mark (place in MARKS, -1: none), bar, channel (place in MARKS, -1: none yet), tuplet) of texts as lists of tokens."""
    toks, sizes = texts.flatten(), pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    mark = pc.fill_null(pc.index_in(toks, MARKS), -1).to_numpy(zero_copy_only=False)
    first = np.repeat(ends[:-1], sizes)
    met = np.maximum.accumulate(np.where((mark == 1) | (mark == 2), np.arange(len(mark)), -1)) if len(mark) else mark
    channel = np.where(met >= first, mark[met], -1) if len(mark) else mark
    return toks, ends, {"mark": mark, "bar": summed(mark == 0, first) - 1, "channel": channel, "tuplet": summed((mark == 3).astype(int) - (mark == 4), first), "first": first}


def summed(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums within each text, the text's first place given for each token."""
    upto = np.concatenate([[0], np.cumsum(x)])
    return upto[1:] - upto[first]


def named(channel: np.ndarray) -> pa.Array:
    return pc.replace_substring_regex(MARKS.take(pa.array(channel, mask=channel < 0)), "[<>]", "")


def mark_all(texts: pa.Array) -> pa.Array:
    """The tokens of each text with their bar, channel and depth of tuplets, in one pass over a batch."""
    toks, ends, x = running(texts)
    rows = pa.StructArray.from_arrays([toks, pa.array(x["bar"].astype(np.int32)), named(x["channel"]), pa.array(x["tuplet"].astype(np.int32))], names=["tok", "bar", "channel", "tuplet"])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rows)


def group_all(texts: pa.Array) -> pa.Array:
    """The elements of each text, in one pass over a batch."""
    toks, ends, x = running(texts)
    inside = (x["tuplet"] > 0) | (x["mark"] == 4)
    starts = (x["mark"] == 3) | ~(inside | pc.starts_with(toks, "d_").to_numpy(zero_copy_only=False))
    elm = summed(starts, x["first"]) - 1
    at = np.flatnonzero(starts | (np.arange(len(toks)) == x["first"]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(toks)).astype(np.int32)), toks)
    rows = pa.StructArray.from_arrays([pa.array(x["bar"][at].astype(np.int32)), named(x["channel"][at]), pa.array(elm[at].astype(np.int32)), lists], names=["bar", "channel", "elm", "toks"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(at, ends).astype(np.int32)), rows)


def marked(texts: Column) -> Column:
    return F.arrow_udf(mark_all, MARKED)(texts)


def grouped(texts: Column) -> Column:
    return F.arrow_udf(group_all, SONG_ELEMENTS)(texts)


def dealt(scores: DataFrame, *kept: str) -> DataFrame:
    """song_id, kept, pos, tok, tok_type: one row a token, where nothing but the token counts."""
    rows = scores.select("song_id", *kept, F.posexplode(words(F.col("score"))).alias("pos", "tok"))
    return rows.withColumn("tok_type", S.tok_type(F.col("tok")))


def let(x: Column, f) -> Column:
    """f(x), with x worked out once however often f names it (a lambda's expressions are not shared otherwise)."""
    return F.get(F.transform(F.array(x), f), 0)


def parse(scores: DataFrame) -> DataFrame:
    """song_id, pos, tok, tok_type, bar (-1: header), channel, tuplet (depth): one row a token. Texts are taken apart one by one: nothing is shuffled or sorted."""
    t = scores.select("song_id", F.posexplode(marked(words(F.col("score")))).alias("pos", "t"))
    return t.select("song_id", "pos", "t.tok", S.tok_type(F.col("t.tok")).alias("tok_type"), "t.bar", "t.channel", "t.tuplet")


def song_elements(scores: DataFrame) -> DataFrame:
    """elements() of texts, each within its text, without a shuffle: song_id, score, elms (an array of bar, channel, elm, toks)."""
    return scores.select("song_id", "score", grouped(words(F.col("score"))).alias("elms"))


def each_element(songs: DataFrame) -> DataFrame:
    """song_id, bar, channel, elm, toks: the rows of song_elements()."""
    return songs.select("song_id", F.explode("elms").alias("e")).select("song_id", "e.bar", "e.channel", "e.elm", "e.toks")


def elements(tokens: DataFrame) -> DataFrame:
    """song_id, bar, channel, elm (number in the song), first, toks: a note (pitch, duration), a tuplet, or one other token. Of whole texts song_elements() makes the same without a shuffle."""
    inside = (F.col("tuplet") > 0) | (F.col("tok") == "</tup>")
    starts = F.when(F.col("tok") == "<tup>", 1).when(inside, 0).when(F.col("tok_type") == "duration", 0).otherwise(1)
    w = Window.partitionBy("song_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.withColumn("elm", (F.sum(starts).over(w) - 1).cast("int"))
    got = rows.groupBy("song_id", "elm").agg(F.min("bar").alias("bar"), F.min_by("channel", "pos").alias("channel"), F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("t"))
    return got.select("song_id", "bar", "channel", "elm", F.transform("t", lambda x: x["tok"]).alias("toks"))


def note_list(elms: DataFrame) -> DataFrame:
    """song_id, bar, channel, elm, k, midi, ticks: tuplets as equal shares of their duration; rare values are null."""
    pitches = F.filter("toks", lambda t: t.startswith("p_"))
    rows = elms.where(F.exists("toks", lambda t: t.startswith("p_"))).withColumns({"pitches": pitches, "total": S.duration_ticks(F.element_at(F.filter("toks", lambda t: t.startswith("d_")), 1))})
    rows = rows.select("song_id", "bar", "channel", "elm", F.size("pitches").alias("n"), "total", F.posexplode("pitches").alias("k", "pitch"))
    return rows.select("song_id", "bar", "channel", "elm", "k", S.midi_of(F.col("pitch")).alias("midi"), (F.col("total") / F.col("n")).cast("long").alias("ticks"))


def bar_texts(tokens: DataFrame) -> DataFrame:
    """song_id, bar, text: one row a bar, without the closing token."""
    rows = tokens.where((F.col("bar") >= 0) & (F.col("tok") != "</s>"))
    got = rows.groupBy("song_id", "bar").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("t"))
    return got.select("song_id", "bar", F.array_join(F.transform("t", lambda x: x["tok"]), " ").alias("text"))


def song_bars(scores: DataFrame) -> DataFrame:
    """bar_texts() of whole texts, each within its text."""
    text = F.array_join(F.filter(words(F.col("score")), lambda t: t != "</s>"), " ")
    rows = scores.select("song_id", F.posexplode(F.split(text, r"(?<![^ ])<bar>(?![^ ])")).alias("k", "part")).where("k > 0")
    return rows.select("song_id", (F.col("k") - 1).alias("bar"), F.rtrim(F.concat(F.lit("<bar>"), "part")).alias("text"))


def violations(tokens: DataFrame) -> DataFrame:
    """song_id, pos, rule: broken grammar, none for a well-formed text."""
    w = Window.partitionBy("song_id").orderBy("pos")
    after, before = F.lead("tok_type").over(w), F.lag("tok_type").over(w)
    rows = tokens.withColumns({"after": after, "before": before, "next": F.lead("tok").over(w)})
    rules = {
        "header": (F.col("pos") == 0) & (F.col("tok_type") != "time_sig") | (F.col("pos") == 1) & (F.col("tok_type") != "tempo"),
        "pitch without duration": (F.col("tok_type") == "pitch") & (F.col("tuplet") == 0) & (F.coalesce(F.col("after"), F.lit("")) != "duration"),
        "duration without pitch": (F.col("tok_type") == "duration") & (F.coalesce(F.col("before"), F.lit("")) != "pitch"),
        "empty bar": (F.col("tok") == "<bar>") & F.coalesce(F.col("next"), F.lit("</s>")).isin("<bar>", "</s>"),
        "tuplet nesting": ~F.col("tuplet").between(0, 1),
        "no end": F.col("next").isNull() & (F.col("tok") != "</s>"),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return rows.select("song_id", "pos", F.explode(found).alias("rule"))


def song_violations(scores: DataFrame) -> DataFrame:
    """violations() of whole texts, each within its text."""
    rows = scores.select("song_id", marked(words(F.col("score"))).alias("t"))

    def rules(x: Column, k: Column) -> Column:
        tok, kind, next_ = x["tok"], S.tok_type(x["tok"]), F.get("t", k + 1)["tok"]
        after, before = F.coalesce(next_, F.lit("")), F.when(k > 0, F.get("t", k - 1)["tok"]).otherwise("")
        found = {
            "header": (k == 0) & (kind != "time_sig") | (k == 1) & (kind != "tempo"),
            "pitch without duration": tok.startswith("p_") & (x["tuplet"] == 0) & ~after.startswith("d_"),
            "duration without pitch": tok.startswith("d_") & ~before.startswith("p_"),
            "empty bar": (tok == "<bar>") & F.coalesce(next_, F.lit("</s>")).isin("<bar>", "</s>"),
            "tuplet nesting": ~x["tuplet"].between(0, 1),
            "no end": next_.isNull() & (tok != "</s>"),
        }
        return F.struct(k.alias("pos"), F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in found.items()))).alias("rules"))

    wrong = F.filter(F.transform("t", rules), lambda x: F.size(x["rules"]) > 0)
    return rows.select("song_id", F.explode(wrong).alias("w")).select("song_id", "w.pos", F.explode("w.rules").alias("rule"))


def rare_of(tok: Column, kind: Column | None = None) -> Column:
    """The rare token of a token's type; for types without one, the token."""
    kind = S.tok_type(tok) if kind is None else kind
    rare = {"pitch": F.lit("p_rare"), "duration": F.lit("d_rare"), "time_sig": F.lit("TimeSig_rare"), "tempo": F.when(S.meta(tok)["tempo"] < dims.TEMPO_LOW, "Tempo_low").otherwise("Tempo_high")}
    out = tok
    for name, r in rare.items():
        out = F.when(kind == name, r).otherwise(out)
    return out


def sanitized(tokens: DataFrame, vocab: DataFrame, for_midi: bool = False, rare_pitch_only: bool = False) -> DataFrame:
    """tokens and clean, rare: tokens outside the vocabulary become the rare one of their type (pitches fold into range for_midi)."""
    known = F.broadcast(vocab.select(F.col("tok").alias("known")))
    kind, tok = F.col("tok_type"), F.col("tok")
    other = rare_of(tok, kind)
    pitch = S.pitch_token(S.snapped(S.midi_of(tok))) if for_midi else F.lit("p_rare")
    clean = F.when(F.col("known").isNotNull(), tok).when(kind == "pitch", pitch).otherwise(tok if rare_pitch_only else other)
    return tokens.join(known, tok == F.col("known"), "left").withColumns({"clean": clean, "rare": F.col("known").isNull() | tok.isin("p_rare", "d_rare", "TimeSig_rare", "Tempo_low", "Tempo_high")}).drop("known")


def encoded(tokens: DataFrame, vocab: DataFrame, column: str = "tok") -> DataFrame:
    """tokens and id; tokens outside the vocabulary have none (encode strictly by demanding none is null)."""
    return tokens.join(F.broadcast(vocab.select(F.col("tok").alias(column), "id")), column, "left")


def decoded(ids: DataFrame, vocab: DataFrame) -> DataFrame:
    return ids.join(F.broadcast(vocab.select("id", "tok")), "id", "left")


def padded(ids: Column, length: int, pad: int) -> Column:
    """Cut or filled up to a length."""
    return F.concat(F.slice(ids, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def cropped(scores: DataFrame, seed: int, least: int = 16, multiple: int = 1) -> DataFrame:
    """song_id, dropped, score: the first bars left out at random, [OMIT] after the header where any is; `least` bars stay."""
    parts = F.split("score", " ?<bar>")
    n = F.size(parts) - 1
    room = F.greatest(F.floor((n - least) / multiple).cast("long") + 1, F.lit(1))
    k = (F.pmod(S.hashed(F.col("song_id"), seed), room) * multiple).cast("int")
    rows = scores.withColumns({"parts": parts, "dropped": k})
    rest = F.concat_ws(" <bar>", F.concat(F.element_at("parts", 1), F.when(F.col("dropped") > 0, " [OMIT]").otherwise("")), F.slice("parts", F.col("dropped") + 2, F.size("parts")))
    return rows.select("song_id", "dropped", rest.alias("score"))


def tempo_grouped(score: Column, width: int = 5) -> Column:
    """The tempo token (second of the text) as its bin."""
    t = words(score)
    tempo = S.meta(F.element_at(t, 2))["tempo"]
    return F.array_join(F.concat(F.slice(t, 1, 1), F.array(S.tempo_bin_token(tempo, width)), F.slice(t, F.lit(3), F.size(t))), " ")


def key_inserted(score: Column, key: Column) -> Column:
    """The key token third in the text."""
    return F.array_join(F.array_insert(words(score), 3, F.concat(F.lit("Key_"), key)), " ")


def first_bars(score: Column, n: int) -> Column:
    """The header and the first n bars."""
    return F.trim(F.substring_index(score, "<bar>", n + 1))


def without_last_bar(tokens: Column) -> Column:
    """Tokens before the last bar mark: what a generator may have left unfinished goes."""
    last = F.size(tokens) - F.array_position(F.reverse(tokens), "<bar>").cast("int")
    return F.when(F.array_contains(tokens, "<bar>"), F.slice(tokens, F.lit(1), last)).otherwise(tokens)


def to_midi(tok: Column) -> Column:
    """Step and degree pitch tokens as plain ones, folded into range; other tokens stay."""
    return F.when(S.is_pitch_heard(tok), S.pitch_token(S.snapped(S.midi_of(tok)))).otherwise(tok)


#: An element of a bar, or the mark of a channel.
ELEMENT = r"<melody>|<bass>|<tup> .*? </tup>|p_\S+ d_\S+"


def by_channel(bar: Column) -> Column:
    """struct<melody, bass>: the elements of a bar's text, each channel's in its order, however the channels alternate."""
    marks = ("<melody>", "<bass>")

    def channel(xs: Column) -> Column:
        """The elements, in stretches of one channel each: what stands between two marks is cut out whole."""
        n = F.size(xs)
        at = F.concat(F.array(F.lit(-1)), F.filter(F.transform(xs, lambda x, i: F.when(x.isin(*marks), i).otherwise(-1)), lambda i: i >= 0))
        pieces = lambda ps, mark: F.flatten(F.transform(ps, lambda p, k: F.when((F.when(p < 0, F.lit("<melody>")).otherwise(F.get(xs, p))) == mark, F.slice(xs, p + 2, F.coalesce(F.get(ps, k + 1), n) - p - 1)).otherwise(F.array().cast("array<string>"))))
        return let(at, lambda ps: F.struct(pieces(ps, "<melody>").alias("melody"), pieces(ps, "<bass>").alias("bass")))

    return let(F.regexp_extract_all(bar, F.lit(ELEMENT), F.lit(0)), channel)


def merged_bar(melody: Column, bass: Column, draw) -> Column:
    """Both channels as one text, each in its order: place by place draw(k) decides, melody as often as its share of the elements.

    Once a channel is used up the other follows. A mark stands where the channel changes.
    """
    n_m, n_b = F.size(melody), F.size(bass)
    start = F.struct(F.lit(0).alias("m"), F.lit(0).alias("b"), F.lit("").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, k: Column) -> Column:
        drawn = F.when(s["m"] >= n_m, F.lit(False)).when(s["b"] >= n_b, F.lit(True)).otherwise(F.pmod(draw(k), (n_m + n_b).cast("long")) < n_m)

        def put(high: Column) -> Column:
            mark = F.when(high, "<melody>").otherwise("<bass>")
            elm = F.when(high, F.get(melody, s["m"])).otherwise(F.get(bass, s["b"]))
            more = F.when(mark == s["at"], F.array(elm)).otherwise(F.array(mark, elm))
            return F.struct((s["m"] + high.cast("int")).alias("m"), (s["b"] + (~high).cast("int")).alias("b"), mark.alias("at"), F.concat(s["out"], more).alias("out"))

        return let(drawn, put)

    places = F.when(n_m + n_b > 0, F.sequence(F.lit(1), n_m + n_b)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.aggregate(places, start, step)["out"], " ")


def mixed(scores: DataFrame, seed: int) -> DataFrame:
    """song_id, score: in each bar the elements of melody and bass in one random order that keeps each channel's own; within a text, without a shuffle."""
    parts = F.split(F.regexp_replace(F.regexp_replace("score", " </s>$", ""), " <bar> ", "\n"), "\n")

    def bar(t: Column, k: Column) -> Column:
        merged = let(by_channel(t), lambda c: merged_bar(c["melody"], c["bass"], lambda j: S.hashed(F.col("song_id"), k, j, seed)))
        return F.when(k == 0, t).otherwise(F.concat_ws(" ", F.lit("<bar>"), merged))

    return scores.select("song_id", F.concat(F.array_join(F.transform(parts, bar), " "), F.lit(" </s>")).alias("score"))


def key_vector(keys: Column) -> Column:
    """24 scores in the order of key ordinals; missing and zero ones are -1."""
    names = [r[0] for r in dims.key_rows()]
    return F.array(*(F.coalesce(F.nullif(F.try_element_at(keys, F.lit(n)), F.lit(0.0)), F.lit(-1.0)) for n in names))


def respelled(score: Column, pitch) -> Column:
    """The text with pitch(token) in place of each heard pitch; nothing is dealt out."""
    return F.array_join(F.transform(words(score), lambda t: F.when(S.is_pitch_heard(t), pitch(t)).otherwise(t)), " ")


def stepped(score: Column) -> Column:
    """Plain pitches with the letter of their usual spelling; where it crosses an octave, the octave is the letter's."""
    letters = F.array(*(F.lit(s[0][0]) for s in dims.SPELLINGS))

    def spelled(t: Column) -> Column:
        return F.concat(t, F.lit("_"), F.element_at(letters, S.group(t, S.PITCH, 1).cast("int")))

    return respelled(score, spelled)


def degreed(score: Column, key: Column) -> Column:
    """Pitches with a step letter as degrees of the key; numbers an octave out of range fold inwards."""

    def shifted(t: Column) -> Column:
        folded = let(S.midi_of(t), lambda midi: F.when(midi < 0, midi + 12).when(midi > 127, midi - 12).otherwise(midi))
        degree = let(S.group(t, S.PITCH, 3), lambda step: S.degree(step, key))
        return F.concat_ws("_", let(folded, S.pitch_token), degree.cast("string"))

    return respelled(score, shifted)


def augmented(score: Column, key: Column) -> Column:
    """The key token third, and steps as degrees of that key."""
    return key_inserted(degreed(score, key), key)


def clean(scores: DataFrame, vocab: DataFrame, kept: list[str]) -> DataFrame:
    """song_id, score with rare tokens in place of those outside the vocabulary, and the columns that are kept."""
    known = [r.tok for r in vocab.select("tok").collect()]  # a vocabulary's rows
    text = F.array_join(F.transform(words(F.col("score")), lambda t: F.when(t.isin(known), t).otherwise(rare_of(t))), " ")
    return scores.select("song_id", *kept, text.alias("score"))


def loaded(scores: DataFrame, pitch_kind: str, vocab: DataFrame | None = None) -> DataFrame:
    """song_id, score as training takes it: 'midi' folds pitches into range, 'degree' inserts the key (column key) and shifts, 'step' stays.

    vocab: tokens outside it become rare ones first (that alone deals tokens out and joins them).
    """
    if vocab is not None:
        scores = clean(scores, vocab, [c for c in scores.columns if c not in ("song_id", "score")])
    made = {"midi": lambda: respelled(F.col("score"), to_midi), "degree": lambda: augmented(F.col("score"), F.col("key")), "step": lambda: F.col("score")}
    if pitch_kind not in made:
        raise ValueError(f"pitch kind {pitch_kind!r} is none of {sorted(made)}")
    return scores.select("song_id", made[pitch_kind]().alias("score"))


def swapped(scores: DataFrame, seed: int) -> DataFrame:
    """song_id, score: in each bar a coin decides whether the bass part comes before the melody part; within a text, without a shuffle."""
    parts = F.split(F.regexp_replace(F.regexp_replace("score", " </s>$", ""), " <bar> ", "\n"), "\n")

    def bar(t: Column, k: Column) -> Column:
        melody, bass = F.regexp_extract(t, r"^(<melody>.*?)(?: <bass>|$)", 1), F.regexp_extract(t, r"(<bass>.*)$", 1)
        first = F.pmod(S.hashed(F.col("song_id"), k, seed), F.lit(2)) == 1
        both = F.when(first, F.array(bass, melody)).otherwise(F.array(melody, bass))
        return F.when(k == 0, t).otherwise(F.concat_ws(" ", F.lit("<bar>"), F.array_join(F.filter(both, lambda x: x != ""), " ")))

    return scores.select("song_id", F.concat(F.array_join(F.transform(parts, bar), " "), F.lit(" </s>")).alias("score"))


@dataclass(frozen=True)
class Augmented:
    """The chain of transforms of a training epoch: sanitise, crop, order or mix of channels, tempo bins, key, pitch kind.

    swap: bass before melody by a coin for each bar; mix: both channels in one random order. vocab: tokens outside it become rare
    ones first. keys: the column of candidate keys with their scores (a map); each epoch draws one of them for the degrees.
    """

    pitch_kind: str = "midi"
    crop: int | None = None
    tempo_width: int | None = None
    swap: bool = False
    seed: int = 0
    mix: bool = False
    vocab: DataFrame | None = None
    keys: str | None = None

    def __post_init__(self):
        if self.pitch_kind not in ("midi", "step", "degree"):
            raise ValueError(f"pitch kind {self.pitch_kind!r}")
        if self.crop is not None and self.crop < 1:
            raise ValueError("a crop keeps one bar at least")
        if self.swap and self.mix:
            raise ValueError("channels are either swapped or mixed")

    def __call__(self, scores: DataFrame, epoch: int, train: bool = True) -> DataFrame:
        """song_id, score. scores: song_id, score, and, where the pitch kind is degree, key or the column of keys."""
        rows, seed = scores, self.seed + epoch
        if self.keys:
            rows = rows.withColumn("key", drawn_key(F.col(self.keys), F.col("song_id"), seed)).drop(self.keys)
        kept = [c for c in ("key",) if c in rows.columns]
        if self.vocab is not None:
            rows = clean(rows, self.vocab, kept)
        if self.crop is not None and train:
            rows = again(rows, cropped(rows, seed, self.crop), kept)
        if self.swap or self.mix:
            rows = again(rows, (mixed if self.mix else swapped)(rows, seed), kept)
        if self.tempo_width:
            rows = rows.withColumn("score", tempo_grouped(F.col("score"), self.tempo_width))
        return loaded(rows, self.pitch_kind)

    @property
    def name(self) -> str:
        return "{" + ", ".join(f"{k}={v}" for k, v in (("pitch", self.pitch_kind), ("crop", self.crop), ("tempo", self.tempo_width), ("swap", self.swap), ("mix", self.mix), ("keys", self.keys)) if v) + "}"


def again(rows: DataFrame, made: DataFrame, kept: list[str]) -> DataFrame:
    """The texts made of rows, with the columns that are kept."""
    made = made.select("song_id", "score")
    return rows.select("song_id", *kept).join(made, "song_id") if kept else made


def drawn_key(keys: Column, song: Column, seed: int) -> Column:
    """One of a map's keys, drawn by a hash in proportion to their scores (the least -ln(u) / score wins; ties by name)."""
    lots = F.transform(F.map_entries(F.map_filter(keys, lambda _, v: v > 0)), lambda e: F.struct(F.round(-F.log((S.hashed(song, e["key"], seed) + 1) / F.lit(float((1 << 60) + 1))) / e["value"], 9).alias("draw"), e["key"].alias("key")))
    return F.array_min(lots)["key"]
