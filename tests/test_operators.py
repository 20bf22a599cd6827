"""Operators without SQL counterparts: invariants, round trips and hand-made inputs."""

import io
import json
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from neumata.functions import dims
from neumata.functions import scalars as S
from neumata.operators import harmony, intervals, merges, slots, stats, tokens
from neumata.sources import songs
from neumata.streaming import windows

MIDI = "TimeSig_4/4 Tempo_120 <bar> <melody> p_1/4 d_1 <tup> p_3/4 p_r p_5/4 d_1 </tup> p_r d_2 <bass> p_1/2 d_4 <bar> <bass> p_1/3 d_1/2 p_1/3 d_7/2 </s>"
BROKEN = "Tempo_120 TimeSig_4/4 <bar> <bar> <melody> p_1/4 p_2/4 d_1 <tup> p_1/4 d_1"
IV = "song_id long, part string, bar long, id long, start int, end int, midi int"


@pytest.fixture(scope="module")
def parsed(spark):
    return tokens.parse(spark.createDataFrame([(1, MIDI)], "song_id long, score string"))


def test_elements_and_notes(parsed):
    elms = tokens.elements(parsed)
    got = [(r.bar, r.channel, " ".join(r.toks)) for r in elms.orderBy("elm").collect() if len(r.toks) > 1]
    assert got[1] == (0, "melody", "<tup> p_3/4 p_r p_5/4 d_1 </tup>") and got[-1] == (1, "bass", "p_1/3 d_7/2") and len(got) == 6
    notes = tokens.note_list(elms).orderBy("elm", "k").collect()
    assert [n.midi for n in notes] == [60, 62, -1, 64, -1, 36, 48, 48]
    assert [n.ticks for n in notes][:4] == [dims.TICKS_PER_QUARTER, *[dims.TICKS_PER_QUARTER // 3] * 3]


def test_text_round_trip(parsed):
    elms = tokens.elements(parsed)
    counts = merges.element_counts(elms)
    vocab = counts.select(F.col("elm_text").alias("tok"))
    assert merges.texts_of(merges.tokenised(elms, vocab)).first().score == MIDI


def test_violations(spark, parsed):
    assert tokens.violations(parsed).count() == 0
    bad = tokens.violations(tokens.parse(spark.createDataFrame([(1, BROKEN), (2, ""), (3, None)], "song_id long, score string")))
    assert {r.rule for r in bad.collect()} == {"header", "empty bar", "pitch without duration", "no end"}


def test_transforms(spark):
    df = spark.createDataFrame([(MIDI, "EMinor")], "score string, key string")
    r = df.select(tokens.key_inserted(F.col("score"), F.col("key")).alias("k"), tokens.first_bars(F.col("score"), 1).alias("f"), tokens.without_last_bar(tokens.words(F.col("score"))).alias("w"), tokens.padded(F.array(F.lit(1), F.lit(2)), 4, 0).alias("p"), tokens.padded(F.array(F.lit(1), F.lit(2)), 1, 0).alias("c")).first()
    assert r.k.split()[2] == "Key_EMinor" and r.f.endswith("p_1/2 d_4") and " ".join(r.w) == r.f and r.p == [1, 2, 0, 0] and r.c == [1]


def test_mix_keeps_order(spark):
    scores = spark.createDataFrame([(k, MIDI) for k in range(60)], "song_id long, score string")
    orders = set()
    for r in tokens.mixed(scores, 3).collect():
        bars = r.score.removesuffix(" </s>").split(" <bar> ")
        assert bars[0] == "TimeSig_4/4 Tempo_120" and r.score.endswith(" </s>") and bars[2] == "<bass> p_1/3 d_1/2 p_1/3 d_7/2"
        at, got = None, {"<melody>": [], "<bass>": []}
        for e in re.findall(r"<melody>|<bass>|<tup> .*? </tup>|p_\S+ d_\S+", bars[1]):
            if e in got:
                assert e != at  # a mark stands where the channel changes, and only there
                at = e
            else:
                got[at].append(e)
        assert got == {"<melody>": ["p_1/4 d_1", "<tup> p_3/4 p_r p_5/4 d_1 </tup>", "p_r d_2"], "<bass>": ["p_1/2 d_4"]}
        orders.add(bars[1])
    assert len(orders) == 4  # wherever the bass may stand


def test_share_of_melody_at_each_place(spark):
    """Until a channel is used up, the melody has its share of the elements at every place."""
    text = "TimeSig_4/4 Tempo_120 <bar> <melody> " + "p_1/4 d_1 " * 6 + "<bass> p_1/2 d_1 p_1/2 d_1 </s>"
    rows = tokens.mixed(spark.createDataFrame([(k, text) for k in range(2000)], "song_id long, score string"), 1).collect()
    firsts = [re.findall(r"<melody>|<bass>|p_\S+", r.score) for r in rows]
    assert abs(sum(f[0] == "<melody>" for f in firsts) / 2000 - 0.75) < 0.04
    second = ["<melody>" if (f[2] if f[2].startswith("<") else f[0]) == "<melody>" else "<bass>" for f in firsts]
    assert abs(sum(x == "<melody>" for x in second) / 2000 - 0.75) < 0.04


def test_spellings(spark):
    v = dims.vocab(spark, "step")
    r = {x.tok: x.m for x in v.select("tok", S.midi_of(F.col("tok")).alias("m")).collect() if x.tok.startswith("p_")}
    assert r["p_1/-2_B"] == -12 and r["p_12/9_C"] == 131 and r["p_r"] == -1 and r["p_rare"] is None
    degrees = {t for _, t, _ in dims.vocab_rows("degree")}
    for letter in "CDEFGAB":
        for key, *_ in dims.key_rows():
            deg = (dims.LETTERS.index(letter) - dims.LETTERS.index(key[0])) % 7 + 1
            assert 1 <= deg <= 7 and f"p_1/4_{deg}" in degrees
    assert len({t for _, t, _ in dims.vocab_rows("step")}) == 560


def test_key_of_a_scale(spark):
    rows = [(1, 60 + k, w) for k, w in enumerate(dims.PROFILE["Major"])] + [(2, 60, 5)]
    notes = spark.createDataFrame([(s, m, int(1000 * w), 0, "melody", 1) for s, m, w in rows] + [(3, k, 5, 0, "melody", 1) for k in range(12)], "song_id long, midi int, slots int, bar int, channel string, pos int")
    scores = harmony.key_scores(harmony.class_durations(notes))
    best = {r.song_id: (r.key, r.score) for r in harmony.best_key(scores).collect()}
    assert best[1] == ("CMajor", 1.0) and 2 in best and 3 not in best  # no variance, no key
    ikr = {(r.song_id, r.key): r.ikr for r in harmony.in_key(notes, scores).collect()}
    assert ikr[1, "CMajor"] == pytest.approx(7 / 12) and all(0 <= v <= 1 for v in ikr.values())


def interval_rows(spark):
    import random

    rng, rows = random.Random(4), []
    for bar in range(40):
        for k in range(rng.randint(1, 9)):
            start = rng.randrange(30)
            rows.append((1, "x", bar, len(rows), start, min(32, start + rng.randint(1, 12)), rng.randint(30, 90)))
    return spark.createDataFrame(rows, IV)


@pytest.mark.parametrize("keep", ["high", "low"])
def test_skyline(spark, keep):
    notes = interval_rows(spark)
    best, bars = (max if keep == "high" else min), {}
    for r in intervals.skyline(notes, keep).collect():
        bars.setdefault(r.bar, []).append(r)
    source = {r.id: r for r in notes.collect()}
    for bar, got in bars.items():
        got.sort(key=lambda r: r.start)
        assert all(a.end <= b.start for a, b in zip(got, got[1:], strict=False)) and all(0 <= r.start < r.end <= 32 for r in got)
        first = [n for n in source.values() if n.bar == bar]
        top = best(first, key=lambda n: n.midi)
        if sum(n.midi == top.midi for n in first) == 1:
            same = [r for r in got if r.id == top.id]
            assert same and same[0].start == top.start
        assert all(source[r.id].start <= r.start and r.end <= source[r.id].end for r in got)


def test_rests_fill_the_bar(spark):
    one = intervals.skyline(interval_rows(spark))
    rests = intervals.rests(one)
    total = one.select("bar", (F.col("end") - F.col("start")).alias("n")).unionAll(rests.select("bar", F.col("end") - F.col("start"))).groupBy("bar").agg(F.sum("n").alias("n"))
    assert {r.n for r in total.collect()} == {32}


def test_slots_round_trip(spark):
    notes = spark.createDataFrame([(1, 0, 0, 4, 60), (1, 0, 4, 2, -1), (1, 0, 6, 2, 62), (1, 1, 0, 8, 60)], "song_id long, bar int, start int, slots int, midi int")
    e = slots.encoded(notes)
    assert sorted(map(tuple, slots.decoded(e).collect())) == sorted(map(tuple, notes.collect()))
    assert slots.rows_of(e, 20).first().ids == [60] * 4 + [128] * 2 + [62] * 2 + [-1] + [60] * 8 + [-1] + [-3] * 2
    assert {r.quarters for r in slots.signature(e).collect()} == {1.0}


def test_wordpieces(spark):
    w = spark.createDataFrame([("low", 5), ("lower", 3), ("newest", 6), ("widest", 2)], "word string, n long")
    pieces = merges.train_wordpiece(w, 30)
    got = {r.word: r.pieces for r in merges.wordpieces(w, pieces).collect()}
    assert all("".join(p.removeprefix("##") for p in v) == k for k, v in got.items()) and got["newest"] != list("newest")
    assert merges.wordpieces(spark.createDataFrame([("q",)], "word string"), pieces).first().pieces == ["[UNK]"]


def test_blocks_follow_their_pairs():
    """A block finds the words of a pair by its index, pairs made by earlier merges included: pieces and counts are those of a scan over everything."""
    rng = np.random.default_rng(6)
    words = [rng.integers(0, 4, rng.integers(0, 9)).tolist() for _ in range(300)]
    ids, n = np.array([k for w in words for k in (*w, -1)], np.int32), rng.integers(1, 50, 300)
    block, whole = merges.Block(ids, n), ids.copy()
    for new in range(4, 40):
        codes, _ = merges.pair_counts(whole, n)
        a, b = divmod(int(rng.choice(codes)), 1 << 32) if new % 5 else (3, 99)
        before = dict(zip(*map(list, merges.pair_counts(whole, n)), strict=True))
        whole = merges.merged(whole, a, b, new)
        after = dict(zip(*map(list, merges.pair_counts(whole, n)), strict=True))
        got = block.step((a, b, new), counted=new % 3 > 0)
        want = {k: d for k in before.keys() | after.keys() if (d := after.get(k, 0) - before.get(k, 0))}
        assert dict(zip(*map(list, got), strict=True)) == (want if new % 3 else {}) and block.flat().tolist() == whole.tolist()
    assert len(set(whole.tolist())) > 20


def plain_wordpiece(words, size):
    local = [(n, [c if i == 0 else f"##{c}" for i, c in enumerate(w)]) for w, n in words]
    pieces = sorted({x for _, p in local for x in p})
    while len(pieces) < size:
        pairs = {}
        for n, p in local:
            for x in zip(p, p[1:], strict=False):
                pairs[x] = pairs.get(x, 0) + n
        if not pairs:
            break
        a, b = min(pairs, key=lambda x: (-pairs[x], x))
        pieces.append(a + b.removeprefix("##"))
        for _, p in local:
            k = 0
            while k < len(p) - 1:
                if (p[k], p[k + 1]) == (a, b):
                    p[k : k + 2] = [pieces[-1]]
                k += 1
    return pieces


@pytest.mark.parametrize("letters", ["abc", "ab", "abcdefghijklmnopqrstuvwxyzé日"])
def test_wordpiece_training(spark, letters):
    rng = random.Random(len(letters))
    words = sorted({"".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(400)})
    rows = [(w, rng.randint(1, 9)) for w in words]
    assert merges.train_wordpiece(spark.createDataFrame(rows, "word string, n long"), 150) == plain_wordpiece(rows, 150)


def test_wordpiece_query_takes_all_words(spark):
    """Words of every language, and none of them without its pieces."""
    from neumata import catalog

    d = "/root/testdata/sf0.001"
    got = {r.word: r.pieces for r in catalog.queries()["wordpiece_tokens"](spark, d).collect()}
    counts = {r.tok: r.n for r in catalog.words(spark, d).groupBy("tok").agg(F.count("*").alias("n")).collect()}
    assert set(got) == set(counts) and ["[UNK]"] not in got.values()
    assert all("".join(p.removeprefix("##") for p in v) == k for k, v in got.items())
    some = dict(sorted(counts.items())[::7])
    rows = spark.createDataFrame(sorted(some.items()), "word string, n long")
    assert merges.train_wordpiece(rows, 400) == plain_wordpiece(sorted(some.items()), 400)


def test_longest_match_in_one_pass():
    """The trie against slices of every length, on words with and without a way through."""
    rng = random.Random(8)
    for _ in range(60):
        pieces = sorted({("##" if rng.random() < 0.6 else "") + "".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 14))})
        trie, known = merges.Trie(pieces), set(pieces)
        for _ in range(60):
            word, want, at = "".join(rng.choices("abc", k=rng.randint(0, 9))), [], 0
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in known), None)
                if end is None:
                    want = ["[UNK]"]
                    break
                want.append(("##" if at else "") + word[at:end])
                at = end
            assert trie(word) == want, (pieces, word)


def test_pieces_of_ties_over_the_kept_pairs(spark, monkeypatch):
    """With few pairs kept on the driver, counts run out often, and the pieces are the same."""
    rng = random.Random(2)
    rows = [(w, 1) for w in sorted({"".join(rng.choices("abcdef", k=6)) for _ in range(200)})]
    monkeypatch.setattr(merges, "PAIRS_A_PIECE", 0)
    monkeypatch.setattr(merges, "LEAST_PAIRS", 5)
    assert merges.train_wordpiece(spark.createDataFrame(rows, "word string, n long"), 90) == plain_wordpiece(rows, 90)


def test_smoothing(spark):
    log = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate([1, 2, 4])], "run string, step long, value double")
    assert stats.smoothed(log, "run", 0.5).first()["last"] == 2.75


XML = """<score-partwise><part-list><score-part id="P1"/><score-part id="P2"><midi-instrument id="d"><midi-channel>10</midi-channel></midi-instrument></score-part></part-list>
<part id="P1"><measure><attributes><divisions>2</divisions><time><beats>3</beats><beat-type>4</beat-type></time></attributes><sound tempo="90"/>
<note><pitch><step>C</step><alter>1</alter><octave>4</octave></pitch><duration>2</duration><voice>1</voice></note><note><chord/><pitch><step>G</step><octave>4</octave></pitch><duration>2</duration></note>
<note><rest/><duration>4</duration></note><backup><duration>6</duration></backup><note><pitch><step>E</step><octave>2</octave></pitch><duration>6</duration><voice>2</voice></note></measure></part>
<part id="P2"><measure><note><unpitched/><duration>1</duration></note></measure></part></score-partwise>"""


def test_scores(spark, tmp_path):
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("META-INF/container.xml", "<container/>")
        z.writestr("score.xml", XML)
    (tmp_path / "a.mxl").write_bytes(zipped.getvalue())
    (tmp_path / "b.mxl").write_bytes(XML.encode())
    (tmp_path / "c.mxl").write_bytes(b"no score")
    files = songs.read_scores(spark, str(tmp_path))
    notes, bars = songs.parse(files), songs.parse(files, bars=True)
    q = dims.TICKS_PER_QUARTER
    got = sorted((r.voice, r.start_ticks // q, r.dur_ticks // q, r.midi) for r in songs.without_drums(notes).where("path like '%a.mxl'").collect())
    assert got == [(1, 0, 1, 61), (1, 0, 1, 67), (1, 1, 2, -1), (2, 0, 3, 40)]
    r = {x.path[-5:]: x for x in songs.scan_statistics(notes, bars).collect()}
    assert r["a.mxl"].notes == r["b.mxl"].notes == 3 and r["c.mxl"].errors == 1 and r["a.mxl"].time_signatures == 1


def test_json_and_parquet(spark, tmp_path):
    meta = {"mode": "full", "precision": 5, "with_pitch_step": True, "greedy_tuplet_pitch_threshold": 1}
    song = {"score": MIDI, "title": "Étude", "duration": 4, "keys": {"CMajor": 0.9}, "warnings": [{"warn_name": "Missing Tempo", "bar_num": 1, "args": {"a": "1/2"}}]}
    (tmp_path / "all.json").write_text(json.dumps({"encoding_type": "str", "extractor_meta": meta, "music": [song, song | {"title": "B"}]}))
    (tmp_path / "one.json").write_text(json.dumps({"encoding_type": "str", "extractor_meta": meta, "music": song}))
    many, one = songs.load(spark, str(tmp_path / "all.json"), dataset="x"), songs.load_single(spark, str(tmp_path / "one.json"), dataset="x")
    both = songs.stack(many, one)
    assert both.count() == 3 and many.first()["keys"] == {"CMajor": 0.9}
    songs.combine(both.drop("dataset"), str(tmp_path / "out"))
    assert songs.load(spark, str(tmp_path / "out")).count() == 3
    songs.to_dataset(both.withColumn("split", F.lit("train")), str(tmp_path / "ds"))
    back = songs.read_dataset(spark, str(tmp_path / "ds"), "train", 2)
    assert back.count() == 2 and "warnings" not in back.columns
    with pytest.raises(ValueError):
        songs.stack(many, many.withColumn("extractor_meta", F.col("extractor_meta").withField("precision", F.lit(4)))).count()


def test_exports_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps({"title": str(k)}))
        windows.export_new(spark, source, sink, state, "title string")
        windows.export_new(spark, source, sink, state, "title string")
        assert spark.read.parquet(sink).count() == k + 1


def test_ticks(spark):
    toks = [t for _, t, k in dims.vocab_rows() if k == "duration" and t != "d_rare"]
    got = spark.createDataFrame([(t,) for t in toks], "tok string").select(S.duration_ticks(F.col("tok")).alias("t"), S.slots_token((S.duration_ticks(F.col("tok")) / S.SLOT_TICKS).cast("int")).alias("again"), "tok").collect()
    assert all(r.again == r.tok and r.t % S.SLOT_TICKS == 0 for r in got)


def test_extraction(spark, tmp_path):
    from neumata.plans import extract

    (tmp_path / "a.mxl").write_bytes(XML.encode())
    (tmp_path / "c.mxl").write_bytes(b"no score")
    files = songs.read_scores(spark, str(tmp_path))
    r = extract.extract(files).collect()
    assert [x.score for x in r] == ["TimeSig_3/4 Tempo_90 <bar> <melody> p_8/4 d_1 p_5/2 d_2 <bass> p_5/2 d_3 </s>"] or [x.score for x in r] == ["TimeSig_3/4 Tempo_90 <bar> <melody> p_8/4 d_1 p_r d_2 <bass> p_5/2 d_3 </s>"]
    assert r[0].seconds == 2 and r[0]["keys"]
    assert tokens.violations(tokens.parse(extract.extract(files))).count() == 0
    assert extract.warnings_of(files).count() == 0


def test_characters_round_trip(spark, parsed):
    e = tokens.encoded(parsed, dims.vocab(spark))
    back = merges.from_chars(merges.to_chars(e))
    assert [r.id for r in back.orderBy("pos").collect()] == [r.id for r in e.where("id is not null").orderBy("pos").collect()]
