"""Personal data: fixed formats first, then boosted trees over looser candidates, in DataFrame operations alone.

Fixed formats (email, ip, card, phone) are found leftmost and without overlaps for each kind, and matches that fail their
check are dropped. Looser generators then propose spans that may overlap: numbers grouped like phones or cards, addresses
spelled out, addresses with bracketed dots. Boosted trees over a candidate's format and context score it. They are fitted
on a bounded sample: positive are candidates that touch a checked span of their kind, and those that checked spans give
when they are rewritten into the loose forms; negative are candidates that would not pass their check however they were
written. What would pass but is no checked span is not learned from, since nobody knows what it is. The threshold is
calibrated on documents that the trees were not fitted on. Candidates beyond it join the result if they touch no fixed span
of any kind and would pass their check once written plainly (a card in its usual groups, a number not named as another).

Positions are code points, ends exclusive. Null and empty texts have no spans. Repeated rows are searched each, texts of any
length whole. Where spans start together the order of the kinds decides. `redact` works under names of its own, so columns
of any name come back as they were. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import documents

KINDS = ("email", "ip", "card", "phone")
#: Where a long run of one class could be scanned again from each of its characters, a match may only begin at the start of the run or where the last match ended; loops are possessive. Neither changes what is found.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match passes.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": "+"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Loose generators, each with its cheap test.
LOOSE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\[at\]|\(at\)|\bat\b)\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\[dot\]|\(dot\)|\bdot\b)\x20?)[A-Za-z0-9-]++)++", r"dot|[\[(]at[\])]"),
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?![0-9])", r"[0-9]\[?\.\]?[0-9]"),
    "card": (r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])", r"[0-9](?:[\x20.-]?[0-9]){12}"),
    "phone": (r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])", r"[0-9]{3}[\x20.-]?[0-9]{4}"),
}
CONTEXT = 24
SPAN = "array<struct<start:int,end:int,match:string>>"
#: Bounds on the fitting sample, drawn by hashes: documents with candidates, and candidates.
MAX_TRAIN_DOCS, MAX_TRAIN_SPANS = 4_000, 20_000
#: How checked spans are rewritten for fitting (pattern, replacement), in two ways.
REWRITTEN = (
    ((r"([A-Za-z]+)[0-9._%+-]*[13579]@[A-Za-z0-9-]+\.([A-Za-z]+)(?:\.[A-Za-z]+)*\.([A-Za-z]+)", "$1.$1 at $2 dot $3"), (r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9-]+)\.(?:[A-Za-z0-9-]+\.)*([A-Za-z]+)", "$1 at $2 dot $3"), (r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)", "$1[.]$2[.]$3[.]$4"), (r"\+[0-9]{1,2}[\x20.-]?(?=\(?[0-9]{3})", ""), (r"(?<=[0-9]{4})[\x20-](?=[0-9]{4})", ".")),
    ((r"([A-Za-z]+)[0-9._%+-]*[13579]@([A-Za-z]+)[0-9]*((?:\.[A-Za-z0-9-]+)+)", "$1(at)$2$3"), (r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9-]+)\.([A-Za-z]+)", "$1 [at] $2 [dot] $3"), (r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)", "$1.$2[.]$3.$4"), (r"\+[0-9]{1,2}[\x20.-]?\(?([0-9]{3})\)?[\x20.-]?([0-9]{3})[\x20.-]?([0-9]{4})", "($1) $2-$3"), (r"(?<=[0-9]{4})[\x20-](?=[0-9]{4})", ".")),
)
FEATURES = ("kind", "length", "digits", "groups", "first_group", "last_group", "parens", "dashes", "dots", "blanks", "letters", "luhn", "before", "after", "named")


def has(text: Column, hint: str) -> Column:
    return text.contains(hint) if len(hint) == 1 or hint.isalpha() else text.rlike(hint)


def located(text: Column, pattern: str, hint: str) -> Column:
    """All leftmost matches with their positions: lengths of matches and of what lies between them, summed up."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(s["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("match")))).alias("spans"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
    return F.when(has(text, hint), F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda s: s["spans"])).otherwise(none)).otherwise(none)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    n = F.length(digits_of(m))
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits_of(m))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def fixed(docs: DataFrame) -> DataFrame:
    """docs and a column for each kind: the checked spans."""
    text = F.col("text")
    raw = docs.withColumns({k: located(text, PATTERNS[k], HINTS[k]) for k in KINDS})

    def checked(k: str) -> Column:
        return F.filter(k, lambda s: passes(k, s["match"]))

    return raw.withColumns({k: checked(k) for k in KINDS})


def touches(s: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def features(kind: str, text: Column, s: Column) -> Column:
    """The array of FEATURES of a candidate."""
    m, begin = s["match"], F.greatest(s["start"] - CONTEXT, F.lit(0))
    d = digits_of(m)
    count = lambda chars: F.length(m) - F.length(F.translate(m, chars, ""))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    code = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[A-Za-z]"), 2).when(c.rlike("[0-9]"), 3).otherwise(4)
    word = {"email": "mail|contact", "ip": r"\bip\b|host|addr", "card": "card|visa|pay", "phone": "phone|tel|call|mobile|fax"}[kind]
    context = F.lower(F.substr(text, begin + 1, s["start"] - begin))
    before = F.when(s["start"] > 0, F.substr(text, F.greatest(s["start"], F.lit(1)), F.lit(1))).otherwise("")
    values = (
        F.lit(KINDS.index(kind)), F.length(m), F.length(d), F.size(groups), F.length(F.coalesce(F.get(groups, F.lit(0)), F.lit(""))), F.length(F.coalesce(F.get(groups, F.size(groups) - 1), F.lit(""))),
        count("()"), count("-"), count("."), count(" "), F.length(F.regexp_replace(m, "[^A-Za-z]", "")), F.when((d != "") & (F.length(d) < 20), luhn(d).cast("int")).otherwise(0),
        code(before), code(F.substr(text, s["end"] + 1, F.lit(1))), context.rlike(word).cast("int"),
    )
    return F.array(*(v.cast("double") for v in values))


def would_pass(kind: str, m: Column) -> Column:
    """Whether a candidate is what its kind's check accepts, once it is written plainly.

    Bare words "at" and "dot" stand in sentences too: they make an address only where the part before them is more than a word.
    """
    if kind == "email":
        marked = m.rlike(r"@|[\[(]at[\])]") | m.rlike(r"^[A-Za-z]*[0-9._%+-]")
        plain = F.regexp_replace(F.regexp_replace(F.lower(m), r"\s*(?:\[at\]|\(at\)|\bat\b)\s*", "@"), r"\s*(?:\[dot\]|\(dot\)|\bdot\b)\s*", ".")
        return marked & plain.rlike(r"^[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}$")
    if kind == "phone":
        return passes(kind, m) & m.rlike("[^0-9]")
    if kind == "card":  # in groups of four, or of four, six and five or four, by one separator
        return passes(kind, m) & m.rlike(r"^[0-9]+$|^[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}$|^[0-9]{4}([\x20.-])[0-9]{6}\2[0-9]{4,5}$")
    return passes(kind, F.translate(m, "[]", ""))


#: What, right before a number, says that it is no phone.
OTHER = r"(?i)\b(?:part|item|order|ref|serial|model|invoice|ticket|isbn|sku|no|nr|id)\b[\s.:#]*$"


def candidates(found: DataFrame) -> DataFrame:
    """found and, for each kind, loose_<kind>: struct<start, end, x (features), fixed (it touches a fixed span of its kind), over (it touches one of any kind), plain (it would pass)>."""
    text = F.col("text")
    rows = found.withColumns({f"loose_{k}": located(text, *LOOSE[k]) for k in KINDS})

    def described(k: str) -> Column:
        def plain(s: Column) -> Column:
            begin = F.greatest(s["start"] - CONTEXT, F.lit(0))
            ok = would_pass(k, s["match"])
            return ok & ~F.substr(text, begin + 1, s["start"] - begin).rlike(OTHER) if k == "phone" else ok

        def over(s: Column) -> Column:
            return reduce(lambda a, b: a | b, (touches(s, F.col(x)) for x in KINDS))

        return F.transform(f"loose_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), features(k, text, s).alias("x"), touches(s, F.col(k)).alias("fixed"), over(s).alias("over"), plain(s).alias("plain")))

    return rows.withColumns({f"loose_{k}": described(k) for k in KINDS})


def as_column(trees: gbt.Trees, x: Column) -> Column:
    """The trees as one expression."""

    def node(at: int) -> Column:
        if trees.left[at] == at:
            return F.lit(float(trees.value[at]))
        return F.when(x[int(trees.feature[at])] <= float(trees.cut[at]), node(int(trees.left[at]))).otherwise(node(int(trees.right[at])))

    out = F.lit(float(trees.base))
    for root in trees.root:
        out = out + node(int(root))
    return 1 / (1 + F.exp(-out))


def rewritten(text: Column, way: int) -> Column:
    for pattern, to in REWRITTEN[way]:
        text = F.regexp_replace(text, pattern, to)
    return text


def training_spans(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """doc_id, x, y: labelled candidates of sampled documents, as they stand and rewritten."""
    rows = documents(docs).where(F.col("text").rlike("[0-9]{3}|dot|@"))
    share = min(1.0, max_docs / max(rows.count(), 1))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def spans(df: DataFrame) -> DataFrame:
        return candidates(fixed(df)).select("doc_id", F.explode(F.concat(*(f"loose_{k}" for k in KINDS))).alias("s"))

    stand = spans(rows).where("s.fixed or not s.plain").select("doc_id", "s.x", F.col("s.fixed").alias("y"))
    some = rows.where(F.col("text").rlike(r"@|[0-9]\.[0-9]|\+[0-9]|[0-9]{4}[\x20-][0-9]{4}"))
    for way in range(len(REWRITTEN)):
        stand = stand.union(spans(some.withColumn("text", rewritten(F.col("text"), way))).where("s.plain and not s.fixed").select("doc_id", "s.x", F.lit(True)))
    return stand


def fit(docs: DataFrame, precision: float = 0.98, max_docs: int = MAX_TRAIN_DOCS, max_spans: int = MAX_TRAIN_SPANS) -> tuple[gbt.Trees, float]:
    """The trees, fitted on four fifths of the sampled documents, and the least threshold with that precision on the others."""
    spans = training_spans(docs, max_docs)
    counted = spans.groupBy("doc_id").agg(F.count("*").alias("n"))
    share = min(1.0, max_spans / max(counted.agg(F.sum("n")).first()[0] or 0, 1))
    drawn = spans.where(F.pmod(F.xxhash64("doc_id", "x"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = sorted((tuple(r[1]), r[2], r[0] or 0) for r in drawn.select(F.pmod(F.xxhash64("doc_id"), F.lit(5)), "x", "y").collect())
    x, y, held = np.array([r[0] for r in got]).reshape(len(got), len(FEATURES)), np.array([r[1] for r in got], float), np.array([r[2] == 0 for r in got], bool)
    trees = gbt.fit(x[~held], y[~held], trees=12, depth=3, rate=0.4, bins=24)
    if not held.any():
        held[:] = True
    score, truth = trees.score(x[held]), y[held]
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(truth[order]) / np.arange(1, len(truth) + 1)
    last = np.append(np.diff(score[order]) < 0, True)[: len(order)]  # equal scores go together
    good = np.flatnonzero((right >= precision) & last)
    return trees, max(0.5, float(score[order][good[-1]])) if len(good) else 1.1


def ranked(k: str, spans: Column) -> Column:
    """The spans as struct<start, rank, end>, so that they sort by start and then by kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("rank"), s["end"].alias("end")))


def all_spans(docs: DataFrame, model: tuple[gbt.Trees, float]) -> DataFrame:
    """docs, a column of fixed spans for each kind, and spans: array<struct<start, rank, end>> of all, in order."""
    trees, threshold = model
    rows = candidates(fixed(docs))

    def chosen(k: str) -> Column:
        extra = F.filter(f"loose_{k}", lambda s: ~s["over"] & s["plain"] & (as_column(trees, s["x"]) >= threshold))
        return F.concat(ranked(k, F.col(k)), ranked(k, extra))

    return rows.withColumn("spans", F.array_sort(F.concat(*(chosen(k) for k in KINDS)))).drop(*(f"loose_{k}" for k in KINDS))


def text_of(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of fixed spans, base_sha256, spans of every row."""
    rows = all_spans(documents(docs), fit(docs))
    base = F.array_sort(F.concat(*(ranked(k, F.col(k)) for k in KINDS)))
    return rows.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in capitals and angle brackets; overlapping spans become one."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        new = F.concat(s["parts"], F.array(F.substr(text, s["at"] + 1, x["start"] - s["at"]), names[x["rank"]]))
        return F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), new.alias("parts"))).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["parts"].alias("parts")))

    done = F.aggregate("spans", start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(text, s["at"] + 1)))
    own = [f"own_{k}" for k in range(len(docs.columns))]
    rows = all_spans(docs.toDF(*own).withColumn("text", F.col(own[docs.columns.index("text")])), fit(docs))
    rows = rows.withColumn("text", F.when(F.size("spans") > 0, done).otherwise(text))
    back = {"text": text}
    if "n_chars" in docs.columns:
        back["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(back.get(c, F.col(k)).alias(c) for c, k in zip(docs.columns, own, strict=True)))
