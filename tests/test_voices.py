"""Tuplets, chords, sweeps, the grid, tracked warnings, slots and envelopes: hand-made cases beside the SQL of the catalogue."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from neumata.functions.dims import TICKS_PER_QUARTER as Q
from neumata.operators import slots, voices
from neumata.plans import extract
from neumata.sources import songs
from neumata.streaming import tracking

ELEMENT = "song_id long, part string, bar long, voice int, id long, start long, dur long, pitches array<int>, n int, room long"


def elements(spark, rows, room=4 * Q):
    return spark.createDataFrame([(1, "score", b, v, i, s, d, p, n, room) for b, v, i, s, d, p, n in rows], ELEMENT)


def test_triplet_becomes_text(spark):
    """A score with a triplet, a chord and a bass, written as MusicXML and extracted again."""
    t = Q // 3
    rows = [(0, 0, k + 1, k * t, t, [60 + k], 3) for k in range(3)] + [(0, 0, 4, Q, Q, [60, 67], 0), (0, 0, 5, 2 * Q, 2 * Q, [72], 0), (0, 1, 6, 0, 4 * Q, [40], 0)]
    bars = spark.createDataFrame([(1, "score", 0, 4, 4, 100)], "song_id long, part string, bar long, ts_num int, ts_den int, tempo int")
    files = songs.musicxml(elements(spark, rows), bars)
    r = extract.extract(files).first()
    assert r.score == "TimeSig_4/4 Tempo_100 <bar> <melody> <tup> p_1/4 p_2/4 p_3/4 d_1 </tup> p_8/4 d_1 p_1/5 d_2 <bass> p_5/2 d_4 </s>" and r.invalid_bars == 0


def test_each_score_is_read_once(spark):
    """Extraction asks for each file once, for its notes and bars together; a broken file has an error and no bars."""
    bars = spark.createDataFrame([(1, "score", 0, 4, 4, 100)], "song_id long, part string, bar long, ts_num int, ts_den int, tempo int")
    made = songs.musicxml(elements(spark, [(0, 0, 1, 0, 4 * Q, [60], 0)]), bars).collect()
    asked = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            asked.add(b.num_rows)
            yield b

    files = spark.createDataFrame([*made, ("broken", bytearray(b"PK none"))], "path string, content binary").mapInArrow(count, "path string, content binary")
    assert extract.extract(files).collect()[0].score == "TimeSig_4/4 Tempo_100 <bar> <melody> p_1/4 d_4 <bass> p_r d_4 </s>"
    assert asked.value == 2
    notes, bars = songs.parsed(files)
    assert [(r.path, r.error is None) for r in notes.orderBy("path").collect()] == [("1", True), ("broken", False)] and [r.path for r in bars.collect()] == ["1"]


def test_choices_are_a_product(spark):
    rng = random.Random(4)
    rows, at = [], 0
    for bar in range(30):
        for k in range(3):
            rows.append((bar, 0, k + 1, k * Q // 3, Q // 3, sorted(rng.sample(range(40, 90), rng.randint(0, 4))), 3))
    groups = voices.tuplets(elements(spark, rows))
    want = {}
    for bar in range(30):
        options = [p or [-1] for b, _, _, _, _, p, _ in rows if b == bar]
        want[bar] = sorted(itertools.product(*options))
    got = {}
    for r in voices.choices(groups).collect():
        got.setdefault(r.bar, []).append(tuple(r.pitches))
    assert {b: sorted(v) for b, v in got.items()} == want
    for r in voices.choices(groups, 5).groupBy("bar").agg(F.count("*").alias("n"), F.first("pitches").alias("p")).collect():
        full = want[r.bar]
        assert r.n == (len(full) if len(full) <= 5 else 1) and (len(full) <= 5 or sum(r.p) == max(map(sum, full)))
    for high in (True, False):
        best = {}
        for r in voices.best_choices(groups, 6, high).collect():
            best.setdefault(r.bar, []).append(sum(r.pitches))
        assert {b: v for b, v in best.items()} == {b: sorted(map(sum, v), reverse=high)[:6] for b, v in want.items()}


@pytest.mark.parametrize("high", [True, False])
def test_best_choice_stands_for_all(high):
    """A sweep over every option of a tuplet keeps what a sweep over the best one keeps."""
    rng = random.Random(7)
    for _ in range(400):
        rows = [(s := rng.randrange(12), s + rng.randint(1, 6), rng.randrange(30), k, False) for k in range(rng.randint(1, 6))]
        group, start = [rng.randrange(30) for _ in range(4)], rng.randrange(10)
        every = [(start, start + 4, h, 100 + k, True) for k, h in enumerate(sorted(set(group)))]
        best = max(every, key=lambda r: r[2]) if high else min(every, key=lambda r: r[2])
        one, _ = voices.sweep([*rows, best], high)
        all_, _ = voices.sweep([*rows, *every], high)
        assert one == all_


def test_sweep_keeps_apart_what_sounds():
    rng = random.Random(9)
    for _ in range(300):
        rows = [(s := rng.randrange(20), s + rng.randint(1, 9), rng.randrange(40), k, rng.random() < 0.3) for k in range(rng.randint(1, 9))]
        out, warned = voices.sweep(rows, True)
        assert all(a[2] <= b[1] for a, b in zip(out, out[1:], strict=False)) and all(s < e for _, s, e in out)
        whole = {i: (s, e) for s, e, _, i, t in rows if t}
        assert all((s, e) == whole[i] for i, s, e in out if i in whole)  # a tuplet is never cut
        assert set(warned) <= {voices.OVER, voices.OVER_TUPLET, voices.MAKEUP}


def test_bars_are_whole(spark):
    rng = random.Random(3)
    rows = []
    for bar in range(40):
        for k in range(rng.randint(0, 7)):
            rows.append((bar, k % 2, k + 1, rng.randrange(48) * Q // 12, rng.randint(1, 30) * Q // 12, rng.sample(range(40, 90), rng.randint(0, 2)), rng.choice((0, 0, 3))))
    e = elements(spark, rows)
    room = spark.createDataFrame([(1, "score", b, 4 * Q) for b in range(40)], "song_id long, part string, bar long, room long")
    notes = voices.plain(voices.placed(voices.skyline(voices.compound(e)), room))
    assert voices.validity(notes, room).where("not valid").count() == 0
    assert notes.where((F.col("start") % voices.SLOT != 0) | (F.col("end") % voices.SLOT != 0)).count() == 0
    odd = room.withColumn("room", F.lit(4 * Q + 1).cast("long"))
    assert voices.validity(notes, odd).where("valid").count() == 0


def test_stream_and_table_agree(spark):
    rng = random.Random(6)
    rows = [(s, k, rng.choice(("start", "end", "warn", "warn", "warn")), rng.choice("ab")) for s in range(5) for k in range(40)]
    df = spark.createDataFrame(rows, "song_id long, seq long, event string, warn_type string")
    want = sorted(map(tuple, tracking.tracked(df).collect()))
    assert want and sorted(map(tuple, tracking.run(spark, [df.where("seq < 17"), df.where("seq >= 17")]).collect())) == want


def test_slots_with_triplets(spark):
    notes = spark.createDataFrame([(1, 0, 0, 4, [60]), (1, 0, 4, 8, [60, 60, 64]), (1, 0, 12, 4, [-1]), (1, 2, 0, 4, [5, 5, 5]), (1, 2, 4, 4, [6, 7, 8])], "song_id long, bar long, start int, slots int, pitches array<int>")
    ids = slots.encoded_groups(notes)
    assert slots.rows_of(ids, 30).first().ids == [60] * 4 + [60] * 4 + [64] * 2 + [-2] * 2 + [128] * 4 + [-1] + [5] * 3 + [-2] + [6, 7, 8, -2] + [-1] + [-3] * 4
    for length in (7, 30):
        back = slots.decoded_groups(slots.slots_of(slots.rows_of(ids, length), length))
        assert sorted(map(tuple, back.collect())) == sorted((s, min(b, 1), a, n, p) for s, b, a, n, p in map(tuple, notes.collect()))
    with pytest.raises(Exception, match="multiple of four"):
        slots.encoded_groups(spark.createDataFrame([(1, 0, 0, 3, [1, 2, 3])], notes.schema)).collect()


def test_envelopes_are_bounded(spark, tmp_path):
    schema = f"encoding_type string, extractor_meta {songs.META}, score string, song_path string, title string, duration int, warnings {songs.WARNING}, keys map<string,double>"
    rows = [("str", ("full", 5, False, None), f"s{k}", None, f"t{k}", k, None, None) for k in range(50)]
    songs.combine(spark.createDataFrame(rows, schema).repartition(2), str(tmp_path / "out"), 7)
    sizes = [r.n for r in spark.read.schema(songs.COMBINED).json(str(tmp_path / "out")).select(F.size("music").alias("n")).collect()]
    assert max(sizes) <= 7 and sum(sizes) == 50
    back = songs.load_combined(spark, str(tmp_path / "out"), "x")
    assert sorted(r.score for r in back.collect()) == sorted(f"s{k}" for k in range(50))


def test_song_slots_like_slots_dealt_out(spark):
    """A song's rows of ids and back within the song give what slots as single rows give, triplets beside notes of the same pitch included, and deal nothing out."""
    rng = random.Random(4)
    rows = []
    for song in range(60):
        for bar in range(rng.randint(1, 5)):
            at = 0
            for _ in range(rng.randint(1, 6)):
                three = rng.random() < 0.4
                length = 4 * rng.randint(1, 6) if three else rng.randint(1, 20)
                rows.append((song, bar, at, length, [rng.choice((60, 61, -1)) for _ in range(3 if three else 1)]))
                at += length
    notes = spark.createDataFrame(rows, "song_id long, bar long, start int, slots int, pitches array<int>")
    dealt = slots.rows_of(slots.encoded_groups(notes), 16)
    made = slots.song_rows(notes, 16)
    assert sorted((r.song_id, r.row, r.ids) for r in dealt.collect()) == sorted((r.song_id, k, x) for r in made.collect() for k, x in enumerate(r.rows))
    key = lambda r: (r.song_id, r.bar, r.start, r.slots, r.pitches)
    assert sorted(map(key, slots.decoded_groups(slots.slots_of(dealt, 16)).collect())) == sorted(map(key, slots.song_notes(made).collect()))
    assert slots.song_notes(made)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_hulls_of_equal_intervals(spark):
    """Bars full of equal intervals, empty ones among them: the hulls of a plain sweep, numbered from 1, however the rows are dealt out."""
    rng = random.Random(8)
    rows = [(1, "score", bar, s := rng.randrange(12), s + rng.choice((0, 1, 2, 4))) for bar in range(20) for _ in range(rng.randint(1, 40))]
    want = []
    for bar in range(20):
        found: list[list[int]] = []
        for s, e in sorted(r[3:] for r in rows if r[2] == bar):
            if found and s < found[-1][1]:
                found[-1] = [found[-1][0], max(found[-1][1], e), found[-1][2] + 1]
            else:
                found.append([s, e, 1])
        want += [(1, "score", bar, k + 1, *h) for k, h in enumerate(found)]
    members = spark.createDataFrame(rows, "song_id long, part string, bar long, start long, end long")
    for n in (1, 7):
        assert sorted(map(tuple, voices.hulls(members.repartition(n)).collect())) == want
