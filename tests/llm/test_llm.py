"""The training-data operators against plain versions, exact round trips and held-out labels."""

import hashlib
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from neumata.llm import fingerprints, gbt, license_scan, ngram_join, packing, pii, quality_classifier, quality_rules, queries, sentencepiece_scan, textstats, toxicity, url_filters

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
BPE, PIECES = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, y int, cls long, label int"
ODD = [None, "", " ", "\n\n", "one", "two words", "a b c d e", "Same text twice here.", "Same text twice here.", "x " * 3000, "0" * 3000, "1.1.1.1.1.1 +1 (523) 555-6503 a@b.c_d@e.f", "é ﬁ 日本語 \U0001f600 <|endoftext|> tail ", "\tmixed \r\n white space  \x1c "]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(i, t, None, None, None, 0.5, 1, 2, 3) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def plain_stats(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = defaultdict(list)
    for k in range(len(words) - 4):
        windows[tuple(words[k : k + 5])].append(k)
    again = {k + i for v in windows.values() if len(v) > 1 for k in v for i in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_statistics(docs):
    every = [*texts(docs).values(), *(t or "" for t in ODD), "a b c d e a b c d e f " * 3]
    got = textstats.matrix(every)[:, :5].astype(int).tolist()
    assert got == [list(plain_stats(t)) for t in every]
    assert textstats.matrix([]).shape == (0, len(textstats.NAMES))


def test_trees_learn_and_keep_monotone():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = (x[:, 0] - x[:, 1] + 0.3 * rng.normal(size=2000) > 0).astype(float)
    model = gbt.fit(x, y, monotone={1: -1})
    assert ((model.score(x) > 0.5) == y).mean() > 0.93
    line = np.zeros((200, 3))
    line[:, 1] = np.linspace(-3, 3, 200)
    assert (np.diff(model.score(line)) <= 1e-12).all()
    assert gbt.fit(x, np.ones(2000)).score(x[:2]).tolist() == pytest.approx([2000.5 / 2001] * 2)


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").select("score", "quality", "predicted", "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_quality_edges(odd, empty, labels, no_labels):
    rows = quality_classifier.classify(odd, labels).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality_classifier.classify(odd, no_labels).collect()} == {0.5}
    assert quality_classifier.classify(empty, labels).count() == 0


def test_rules(docs, odd, empty, labels, no_labels):
    for df, l in ((docs, labels), (odd, no_labels)):
        found, all_ = quality_rules.judge(df, quality_rules.fit_rules(df, l)).collect(), texts(df)
        for r in found:
            n, chars, symbols, dup, repeat = plain_stats(all_[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
            assert r.base_failed == (n < 10 or 100 * repeat > 20 * n) and not (r.base_failed and r.kept)
        kept = quality_rules.keep_good(df, l)
        assert kept.columns == df.columns and kept.count() == sum(r.kept for r in found)
    assert quality_rules.judge(empty, quality_rules.fit_rules(empty, no_labels)).count() == 0


def test_rules_fall_as_promised(docs, labels):
    """More symbols, repeated lines, repeated words or capitals never raise the score of a real text."""
    model, x = quality_rules.fit_rules(docs, labels), textstats.matrix(list(texts(docs).values()))
    for name in quality_rules.FALLING:
        for step in (0.01, 1.0, 50.0):
            more = x.copy()
            more[:, textstats.NAMES.index(name)] += step
            assert (model.score(more) <= model.score(x) + 1e-12).all(), name


def plain_walk(model, row):
    total = model.base
    for at in model.root:
        while model.left[at] != at:
            at = model.left[at] if row[model.feature[at]] <= model.cut[at] else model.right[at]
        total += model.value[at]
    return 1 / (1 + np.exp(-total))


def test_trees_walk_like_one_row_at_a_time(docs, labels):
    model, x = quality_rules.fit_rules(docs, labels), textstats.matrix(list(texts(docs).values()))
    assert model.score(x) == pytest.approx([plain_walk(model, r) for r in x])


def test_toxicity(spark, odd, empty, no_labels):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.8 and np.mean([r.predicted for r in rows if not r.toxic]) < 0.02
    all_ = texts(docs)
    r = next(r for r in toxic if r.sentences)
    assert all(0 <= s.start < s.end <= len(all_[r.doc_id]) for s in r.sentences)
    assert {r.score for r in toxicity.classify(odd, no_labels).collect()} == {0.0}
    assert toxicity.classify(empty, no_labels).count() == 0 and toxicity.drop_toxic(odd, no_labels).count() == len(ODD) + 1


def test_toxicity_against_plain_scores():
    """Noisy-or of sentences, one after the other; a harmless text of any length stays harmless."""
    weight = {f: w for word, w in (("scum", 4.0), ("trash", 3.0), ("fine", -2.0)) for f in toxicity.features(word)[:1]}
    model = toxicity.Model(weight, -5.0)
    words = model.words()
    for text in ("You are scum. Fine day.\nTrash and scum!", "Nothing. " * 50, "", "Scum", "trash fine. trash | scum. trash " * 3):
        none = 1.0
        for sentence in re.split(r"[.!?\n|]+", text.lower()):
            z = [weight.get(toxicity.features(w)[0], 0.0) for w in re.findall(r"[^\W\d_]+", sentence)]
            p = 1 / (1 + np.exp(5.0 - sum(z))) if any(z) else 0.0
            none *= 1 - p if p >= toxicity.FLOOR else 1.0
        assert toxicity.noisy_or(model.sentences(words, text)[1]) == pytest.approx(1 - none)
    long = "A plain sentence of harmless words that nobody minds. " * 20_000
    assert toxicity.noisy_or(model.sentences(words, long)[1]) == 0.0
    assert toxicity.noisy_or(model.sentences(words, long + "You scum and trash.")[1]) > 0.8


def test_toxicity_learns_the_sentence_from_document_labels():
    """Bags hold each distinct sentence once, and the gradient is that of the noisy-or likelihood."""
    words = toxicity.Words(toxicity.features, np.int32, 4)
    texts_ = [f"good words here {k}. " + ("vile thing. " if k % 2 else "nice thing. ") + "more good words." for k in range(40)]
    y = np.array([k % 2 for k in range(40)], float)
    held, total = np.zeros((2, toxicity.WIDTH), int), np.array([20, 20])
    split = [toxicity.tokens(t) for t in texts_]
    for (w, _), v in zip(split, y, strict=True):
        held[int(v), np.unique(words(w))] += 1
    used = toxicity.chosen(held, total)
    assert set(toxicity.features("vile")) <= set(used.tolist()) and not set(toxicity.features("good")) & set(used.tolist())
    place = np.full(toxicity.WIDTH, -1, np.int32)
    place[used] = np.arange(len(used))
    bags = [toxicity.bag_of(words(w), s, place) for w, s in split]
    assert all(len(b[1]) == v for b, v in zip(bags, y, strict=True))
    model = toxicity.train(bags, y, used)
    found = model.words()
    score = [toxicity.noisy_or(model.sentences(found, t)[1]) for t in texts_]
    assert min(s for s, v in zip(score, y, strict=True) if v) > 0.9 and max(s for s, v in zip(score, y, strict=True) if not v) == 0.0
    repeated = toxicity.bag_of(*(lambda t: (words(t[0]), t[1]))(toxicity.tokens("vile. vile. plain. vile words")), place)
    assert repeated[1][:, 1].sum() == 3


def luhn(d):
    twice = [2 * int(c) - 9 * (c > "4") if i % 2 else int(c) for i, c in enumerate(reversed(d))]
    return sum(twice) % 10 == 0


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            out += [(m.start(), k, m.end(), kind)] * ok
    return sorted(out)


def test_pii(docs, odd, empty):
    for df in (docs, odd):
        all_ = texts(df)
        for r in pii.find(df).collect():
            spans = plain_spans(all_[r.doc_id])
            base = [f"{kind}:{a}:{e}" for a, _, e, kind in spans]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[3] == k for s in spans) for k in PLAIN]
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(","))
    assert pii.find(empty).count() == 0
    clean = texts(pii.redact(docs))
    assert not any(plain_spans(t) for t in clean.values()) and pii.redact(odd).columns == odd.columns


def test_pii_adds_rewritten_spans(spark):
    """Each generator can add a span that the fixed formats do not find; numbers that are nobody's stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    new = {
        1_000_001: ("Write to jane.doe at example dot com today.", "email"),
        1_000_002: ("The server is 10[.]0[.]12[.]9 in the rack.", "ip"),
        1_000_003: ("Card 4111.1111.1111.1111 was charged.", "card"),
        1_000_004: ("Call (523) 555-6503 before noon.", "phone"),
        1_000_005: ("Version 12 of 2024 sold 1234567 units at 99 percent.", None),
        1_000_006: ("Look at the dot com boom of 1999.", None),
        1_000_007: ("The handbook is ISBN 978-0-306-40615-7 in print.", None),
        1_000_008: ("Please quote part no 523-555-6503 when you reorder.", None),
        1_000_009: ("Reach bob(at)mail.example.org for help.", "email"),
        1_000_010: ("They met at noon dot by dot.", None),
    }
    more = spark.createDataFrame([(i, t) for i, (t, _) in new.items()], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.find(docs.union(more)).where("doc_id > 1000000").collect()}
    found = {i: sorted({x.split(":")[0] for x in s.split(",") if x}) for i, s in got.items()}
    over = spark.createDataFrame([(1, "of +1 (523) 555-4081 190.137.223.204 and 4111 1111 1111 1111.")], "doc_id long, text string")
    spans = pii.all_spans(pii.documents(over), pii.fit(docs)).select(pii.text_of(F.col("spans")).alias("s")).first().s
    assert "card:41:60" in spans and "ip:21:36" in spans and spans.count("card") == spans.count("ip") == 1
    assert {i: (kind in found[i] if kind else not found[i]) for i, (_, kind) in new.items()} == dict.fromkeys(new, True)


def test_redact_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "mail a@b.cc now", "MINE", "s", 3, "x")], "doc_id long, text string, email string, spans string, n_chars long, loose_ip string")
    out = pii.redact(df)
    assert out.schema == df.schema and [tuple(r) for r in out.collect()] == [(1, "mail <EMAIL> now", "MINE", "s", 16, "x")]


def test_pii_long_runs(spark):
    df = spark.createDataFrame([(1, "a" * 200_000), (2, "7" * 200_000), (3, "1." * 60_000), (4, "+1 " * 40_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_email, r.n_card) for r in pii.find(df).collect()) == [(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0)]


@pytest.fixture(scope="module")
def licences(docs):
    return license_scan.fit(docs)


def test_licences(docs, odd, empty, spark, licences):
    notice = "This work is licensed under the GNU General Public License, version 3."
    more = spark.createDataFrame([(10_000, f"words here\n{notice}\nmore"), (10_001, "She renewed her driver's licence at the office.")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.by_document(docs.select("doc_id", "text").union(more), licences).collect()}
    assert got[10_000].families == "GPL" and got[10_001].n_notices == 0
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", notice: "GPL", "Licensed under CC BY-NC 4.0.": "CC-BY-NC"}
    for i, t in texts(docs).items():
        want = [f for line in t.split("\n") for x, f in lines.items() if x == line.strip()]
        assert got[i].families == ",".join(sorted(set(want))) and got[i].n_notices == len(want)
    assert license_scan.by_document(odd, licences).count() == len(ODD) and license_scan.by_document(empty, licences).count() == 0
    assert license_scan.by_document(empty).count() == 0


def wrapped(text, width, mark=""):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


BSD, MIT, APACHE = license_scan.NOTICES["BSD"][0], license_scan.NOTICES["MIT"][1], license_scan.NOTICES["Apache-2.0"][1]


@pytest.mark.parametrize(
    "cases",
    [
        {wrapped(BSD, 60): "BSD", wrapped(BSD, 72, " * "): "BSD", wrapped(MIT, 50, "# "): "MIT", wrapped(APACHE, 60, "// "): "Apache-2.0", f"A line before\n{wrapped(MIT, 72)}\nand one after": "MIT"},
        {license_scan.NOTICES["AGPL"][2]: "AGPL", license_scan.NOTICES["GPL"][1]: "GPL", "Released under the Mozilla Public License 2.0.": "MPL-2.0"},
        {"Released under the MIT License.\nLicensed under CC BY-NC 4.0.": "CC-BY-NC,MIT", "This work is released into the public domain.": "public-domain"},
        {"You must be licensed under state law, version 2.0 of the form.": "", "This work is NOT released into the public domain.": "", "This is not licensed under the MIT License.": ""},
        {"The general public was granted permission to use the library.": "", "license " * 300: "", "Redistribution and use in source\n\nand binary forms, with or without modification": "", "": "", "\n" * 50: ""},
    ],
    ids=["wrapped", "named", "two", "denied", "unknown"],
)
def test_licences_wrapped_named_and_denied(spark, licences, cases):
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.by_document(rows, licences).collect()}
    assert {t: got[k].families for k, t in enumerate(cases)} == cases
    assert all(got[k].n_notices == (len(f.split(",")) if f else 0) for k, f in enumerate(cases.values()))


def test_licences_of_shared_and_null_ids(spark, licences):
    mit, nc = "Released under the MIT License.", "Licensed under CC BY-NC 4.0."
    rows = spark.createDataFrame([(1, mit), (1, nc), (1, nc), (None, mit), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_notices, r.families) for r in license_scan.by_document(rows, licences).collect()}
    assert got == {1: (2, "CC-BY-NC,MIT"), None: (1, "MIT"), 2: (0, "")}


def test_licences_learn_from_every_document(spark):
    """Every text counts: with each of 4,000 texts given twice, model, threshold and needed words stay as they are (a sample drawn by numbers of rows would be another)."""
    rng = np.random.default_rng(3)
    some = ["license", "general", "public", "software", "version", "not", "terms", "the", "of", "river", "stone"]
    made = [(k, "\n".join(" ".join(rng.choice(some, 8)) for _ in range(2)) + f" {k}") for k in range(4000)]
    once = license_scan.fit(spark.createDataFrame(made, "doc_id long, text string"))
    twice = license_scan.fit(spark.createDataFrame([*made, *made], "doc_id long, text string"))
    assert once[3] == twice[3] and once[2] == twice[2] and np.allclose(once[1], twice[1], atol=0.01)
    assert once[0].keys() == twice[0].keys() and all(np.allclose(once[0][g], twice[0][g], atol=0.01) for g in once[0])


def plain_licences(text, model):
    """Every paragraph scored by itself: (first line, lines) of those that are kept."""
    weights, bias, threshold, _ = model
    lines, hits = text.lower().split("\n"), {}
    for at in range(len(lines)):
        for size in range(1, license_scan.MAX_LINES + 1):
            part = lines[at : at + size]
            if len(part) < size or not all(any(c.isalnum() for c in x) for x in part):
                break
            grams = set(license_scan.own_grams(" ".join(part)))
            z = np.array(bias) + sum((np.array(weights[g]) for g in grams if g in weights), np.zeros(len(bias)))
            f = license_scan.FAMILIES[max(range(len(z)), key=lambda k: (z[k], k))]
            share = max(len(grams.intersection(t)) / len(t) for t in map(license_scan.own_grams, license_scan.NOTICES[f]))
            if 1 / (1 + np.exp(-z.max())) >= threshold and share >= license_scan.CONFIRM:
                hits[at, size] = f
    least = {k: f for k, f in hits.items() if not any(a >= k[0] and a + n <= k[0] + k[1] and n < k[1] for a, n in hits)}
    out, until = [], {}
    for (at, size), f in sorted(least.items()):
        if at >= until.get(f, 0):
            out.append((at, size, f))
        until[f] = max(until.get(f, 0), at + size)
    return out


def test_licences_against_plain_scores(spark, licences):
    rng = np.random.default_rng(5)
    notices = [t for x in license_scan.NOTICES.values() for t in x] + license_scan.wrong_notices()
    made = []
    for _ in range(60):
        parts = [wrapped(notices[rng.integers(len(notices))], int(rng.integers(25, 90))) if rng.random() < 0.6 else ["", "***", "plain words of the file", "the license"][rng.integers(4)] for _ in range(6)]
        made.append("\n".join(parts))
    rows = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    got = defaultdict(list)
    for r in license_scan.scan(rows, licences).collect():
        got[r.doc_id].append((r.at, r["size"], r.family))
    assert {k: sorted(got[k]) for k in range(len(made))} == {k: plain_licences(t, licences) for k, t in enumerate(made)}
    assert sum(map(len, got.values())) > 50


def test_sentencepiece(docs, odd, empty, spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    long = spark.createDataFrame([(0, "ab" * 900 + "▁ the   " + "日本" * 200 + "tion" * 500)], "doc_id long, text string")
    for df, chunk in ((docs, 1 << 15), (docs.limit(40), 300), (odd, 400), (long, 64)):
        all_, got = texts(df), defaultdict(dict)
        for r in sentencepiece_scan.encode(df, PIECES, chunk).collect():
            got[r.doc_id][r.chunk] = r.ids
            assert r.round_trip
        whole = {i: [x for k in sorted(c) for x in c[k]] for i, c in got.items()}
        assert whole == {i: sp.encode(t) for i, t in all_.items()}
        got = {(r.doc_id, r.chunk): (r.n_ids, r.ids_crc32) for r in sentencepiece_scan.encode(df, PIECES, chunk, digested=True).collect()}
        if len(got) == len(whole):
            assert got == {(i, 0): (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in whole.items()}
    back = sentencepiece_scan.decode(spark.createDataFrame(list(whole.items()), "doc_id long, ids array<int>"), PIECES)
    assert texts(back) == {i: sp.decode(whole[i]) for i in all_}
    assert sentencepiece_scan.encode(empty, PIECES).count() == 0


def test_sentencepiece_of_long_texts_without_blanks(spark):
    """At the production chunk: several chunks without any place that no piece reaches over, in a few seconds."""
    import sentencepiece

    letters = "".join(np.random.default_rng(2).choice(list("etaoinshrdlu"), 80_000))
    df = spark.createDataFrame([(1, letters), (2, "the" * 15_000 + " word " * 5_000)], "doc_id long, text string")
    got = defaultdict(dict)
    for r in sentencepiece_scan.encode(df, PIECES).collect():
        got[r.doc_id][r.chunk] = r.ids
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert {i: len(c) for i, c in got.items()} == {1: 3, 2: 3}
    assert {i: [x for k in sorted(c) for x in c[k]] for i, c in got.items()} == {r.doc_id: sp.encode(r.text) for r in df.collect()}


def test_max_plus_is_associative():
    rng = np.random.default_rng(3)
    a, b, c = (np.where(rng.random((4, 4)) < 0.5, rng.normal(size=(4, 4)), -np.inf) for _ in range(3))
    left, right = sentencepiece_scan.times(sentencepiece_scan.times(a, b), c), sentencepiece_scan.times(a, sentencepiece_scan.times(b, c))
    assert np.allclose(np.nan_to_num(left, neginf=-99), np.nan_to_num(right, neginf=-99))


def test_urls(spark, empty):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/1", "http://www.example.com/en/1?x", "https://x.net/es/2#y", "http://x.net/es", "http://com/", "ftp://notcom/", "http://x.net/fr/a/b/c/d/e"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)] * 2, "page_id long, url string, rule string, host string")
    got = {r.page_id: r for r in url_filters.judge(df, queries.URL_RULES).collect()}
    assert [got[i].rule for i in range(len(urls))] == [None, None, None, "example.com/en/", "www.example.com/en/", "net/es/", None, "com/", None, "net/fr/"]
    assert got[3].host == "a.example.com" and got[4].path == "/en/1" and got[5].verdict == "block" and got[0].host == got[2].path == ""
    assert url_filters.judge(df, queries.URL_RULES).count() == 2 * len(urls)
    assert url_filters.judge(spark.createDataFrame([], df.schema), queries.URL_RULES).count() == 0


def test_url_templates_are_learnt(spark):
    urls = [f"http://bad.net/es/{k}" for k in range(40)] + [f"http://bad.net/xx/{k}" for k in range(3)]
    rules = [("block", "bad.net", f"/es/{k}") for k in range(30)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filters.judge(df, rules).collect()}
    assert got[39].rule is not None or got[39].verdict == "block"
    assert got[41].verdict == "allow" and got[5].template == "/es/*"


def test_url_templates_without_labels(spark):
    """Templates without labels take their siblings' share, else their host's, else that of all; paths are told apart to their end."""
    urls = [f"http://bad.net/{x}/{k}" for x in ("es", "fr", "en") for k in range(30)] + [f"http://{h}.org/en/{k}" for h in ("a", "b") for k in range(5)]
    urls += ["http://bad.net/en", "http://a.com/1", "http://b.com/2"] + [f"http://c.com/a/b/c/d/{k}/{x}" for x in ("in", "out") for k in range(5)]
    rules = [("block", "net", "/es/"), ("block", "net", "/fr/"), ("allow", "a.com", "/"), ("allow", "b.com", "/"), ("block", "c.com", "/a/b/c/d/1/in")]
    got = {r.path if r.host == "c.com" else f"{r.host}{r.path}": r for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    prior = 61 / 63
    want = (60 + url_filters.PRIOR_WEIGHT * prior) / (60 + url_filters.PRIOR_WEIGHT)
    assert got["bad.net/en/7"].purity == got["bad.net/en"].purity == pytest.approx(want) and got["bad.net/en/7"].verdict == "block"
    assert got["a.org/en/3"].purity == pytest.approx(prior) and got["/a/b/c/d/3/in"].template == "/a/b/c/d/*/in"
    assert got["/a/b/c/d/3/out"].template == "/a/b/c/d/*/out" and all(r.purity is not None for r in got.values())


def plain_vector(t):
    """Every lane of a text, one phrase after the other."""
    xxhash = pytest.importorskip("xxhash")
    equal, signs = [0] * 8, [0] * 128
    for line in t.split("\n"):
        h = hashlib.sha256(line.encode()).hexdigest()
        equal = [(x + int(h[8 * k : 8 * k + 8], 16)) % 2**32 for k, x in enumerate(equal)]
        for phrase in re.split(r"(?<=[adelnrst.,;:!?])[ \t\n\x0b\f\r]+", line):
            of = xxhash.xxh64_intdigest(phrase.encode(), 42)
            for w in range(2):
                # the seed of a column is the hash of the one before
                h = xxhash.xxh64_intdigest(w.to_bytes(4, "little"), of)
                for k in range(32):
                    signs[32 * w + k] += 1 if h >> k & 1 else -1
                    signs[64 + 32 * w + k] += 1 if h >> (k + 32) & 1 else -1
    return equal, signs


def spelled(equal, signs):
    return "".join(f"{x % 2**32:08x}" for x in [*equal, *signs])


def test_fingerprints(docs, odd, empty):
    for df in (docs.where("n_chars < 3000"), odd):
        all_ = texts(df)
        ids = sorted(all_)
        after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
        rows = fingerprints.edited(df).collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in df.select("doc_id").collect())
        for r in rows:
            a, b = all_[r.doc_id], all_[after[r.doc_id]]
            k = len(a) // 4
            new = a[: len(a) - k] + b[:k]
            assert r.n_chars == len(a) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
            x, y, z = plain_vector(a), plain_vector(new), plain_vector(b)
            assert r.fingerprint == spelled(*x) and r.edited_fingerprint == spelled(*y)
            for near, other in ((r.near_edited, y), (r.near_next, z)):
                p, q = np.array(x[1], float), np.array(other[1], float)
                cosine = p @ q / np.sqrt((p @ p) * (q @ q)) if (p @ p) * (q @ q) else 0.0
                assert near == pytest.approx(1.0 if x == other else min(1.0, max(0.0, cosine)), abs=1e-9)
        of = defaultdict(set)
        for r in rows:
            of[r.fingerprint].add(all_[r.doc_id])
        assert all(len(v) == 1 for v in of.values()) and len(of) == len(set(all_.values()))
        assert df is odd or np.mean([r.near_edited > r.near_next for r in rows]) > 0.95
    assert fingerprints.edited(empty).count() == 0


def test_fingerprints_of_shared_and_null_ids(spark):
    rows = [(1, "a\nbc"), (1, "a\nbc"), (1, "other text here"), (None, "no id"), (None, None)]
    got = fingerprints.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 0), (0, 5), (1, 4), (1, 4), (1, 15)]
    assert len({tuple(r) for r in got if r.n_chars == 4}) == 1


def test_fingerprints_add_up(spark):
    df = spark.createDataFrame([(1, "alpha beta\ngamma"), (2, "delta"), (3, "gamma\ndelta\nalpha beta")], "doc_id long, text string")
    v = {r.doc_id: r for r in fingerprints.vectors(df.withColumn("sign", F.lit(1)), ["doc_id"]).collect()}
    for name in ("equal", "signs"):
        x, y, z = (F.array(*map(F.lit, v[i][name])) for i in (1, 2, 3))
        got = spark.range(1).select(fingerprints.combine(x, y).alias("up"), fingerprints.combine(z, y, -1).alias("down")).first()
        assert got.up == [k % 2**32 for k in v[3][name]] and got.down == [k % 2**32 for k in v[1][name]]


def test_fingerprints_of_a_phrase_many_times(spark):
    """40,000 times the same line or phrase: the lanes do not wrap, the edited text is like it."""
    df = spark.createDataFrame([(1, "ab\n" * 40_000), (2, "other words"), (3, "a " * 40_000)], "doc_id long, text string")
    near = {r.doc_id: r.near_edited for r in fingerprints.edited(df).collect()}
    assert near[1] > 0.99 and near[3] > 0.95  # the next text begins otherwise


def test_packing(docs, odd, empty):
    tokenizer = tokenizers.Tokenizer.from_file(BPE)
    for df in (docs, odd):
        rows, count = packing.pack(df, BPE).collect(), Counter(r.doc_id for r in df.select("doc_id").collect())
        ids = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in texts(df).items()}
        assert sum(r.length for r in rows) == sum(len(ids[i]) * n for i, n in count.items())
        windows = defaultdict(list)
        for r in rows:
            assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
            windows[r.sequence_id].append((r.offset, r.length))
        for w in windows.values():
            at = 0
            for offset, length in sorted(w):
                assert offset == at
                at += length
            assert at == 2048 or at & (at - 1) == 0
    assert packing.pack(empty, BPE).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_closest_sum(seed):
    rng = np.random.default_rng(seed)
    counts = {int(n): int(rng.integers(1, 4)) for n in rng.integers(3, 60, 6)}
    reach = {0}
    for n, c in counts.items():
        reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= 100}
    got = packing.closest(counts, 100)
    assert sum(n * k for n, k in got.items()) == max(reach) and all(k <= counts[n] for n, k in got.items())


def plain_components(all_):
    sets = {}
    for i, t in all_.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set()
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_copies(spark):
    """Chains and stars of near copies, copies, subsets of them, and many texts that share one passage."""
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    base, passage, out = word(120), word(60), []
    for k in range(60):
        t = list(base)
        t[(2 * k) % 120] = f"new{k}"
        out.append(" ".join(t))
    chain = word(200)
    for k in range(40):
        chain = [*chain[2:], *word(2)]
        out.append(" ".join(chain))
    out += [" ".join([*word(int(n)), *passage]) for n in rng.integers(4, 80, 60)] + [out[0]] * 5 + [" ".join(base[:m]) for m in (100, 105, 110, 119)]
    return spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")


def test_ngram_join(docs, odd, empty, spark):
    for df in (docs, odd, near_copies(spark)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
        assert got == plain_components(texts(df))
        kept = ngram_join.keep_one(df)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for _, c in got.values()}
    assert ngram_join.join(empty).count() == 0


def test_ngram_join_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = c.execute(queries.oracle_sql()["op10_ngram_join"]).fetchall()
    df = queries.op10_ngram_join(spark, d)
    assert [x[0] for x in c.description] == df.columns and sorted(want) == sorted(map(tuple, df.collect()))


def test_overlaps_in_blocks_of_columns():
    """Accumulated counts against whole intersections, around the threshold."""
    rng = np.random.default_rng(4)
    pivot = np.unique(rng.integers(-(2**63), 2**63 - 1, 400))
    rows = [np.unique(np.concatenate([rng.choice(pivot, k, replace=False), rng.integers(-(2**63), 2**63 - 1, m)])) for k in range(300, 400, 3) for m in (0, 5, 40)]
    rows += [np.zeros(0, np.int64), pivot, pivot[:1]]
    for threshold in (80, 85, 100):
        want = [100 * (both := len(np.intersect1d(pivot, r))) >= threshold * (len(pivot) + len(r) - both) for r in rows]
        assert ngram_join.reaching(pivot, rows, threshold).tolist() == want and any(want)


def test_words_longer_than_a_segment():
    texts_ = ["x" * 5000 + " b c d e", "short words in a text of nine or more", "", "y" * 300, " \t\n"]
    small, large = ngram_join.Shingler(4, segment=64), ngram_join.Shingler(4)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(small(texts_), large(texts_), strict=True))


def test_ngram_join_with_frequent_columns_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    df = near_copies(spark)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()} == plain_components(texts(df))


def test_pipeline(spark, docs):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    labels, step = spark.read.parquet(f"{SF}/labels.parquet"), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, step = texts(step), spark.createDataFrame(stage(spark, step, SF).collect(), docs.schema)
        after = texts(step)
        assert step.columns == docs.columns and set(after) <= set(before)
        if name == "n-gram Jaccard join":
            assert set(after) == {c for _, c in plain_components(before).values()}
        if name == "PII":
            assert set(after) == set(before) and not any(plain_spans(t) for t in after.values())
    assert {r.doc_id for r in rows} == set(after) and labels.count()


def test_pipeline_takes_shingles_of_five_words(spark):
    """The near-duplicate stage against all pairs of 5-word sets at 0.8, with a pair that only this width and threshold links."""
    import corpus_pipeline

    base = [f"u{k}" for k in range(100)]
    other = [f"new{k}" if k in (30, 60) else w for k, w in enumerate(base)]
    pair = spark.createDataFrame([(1000, " ".join(base)), (1001, " ".join(other))], "doc_id long, text string")
    df = near_copies(spark).union(pair)
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, t.split()) for i, t in texts(df).items())}
    root = {i: i for i in sets}
    for b in sorted(sets):
        for a in sorted(sets):
            if a < b and root[a] != root[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert root[1001] == 1000
    assert {r.doc_id for r in corpus_pipeline.single(spark, df, SF).collect()} == set(root.values())


def test_queries_run(spark):
    for name, query in queries.queries().items():
        assert query(spark, SF).count() > 0, name
