"""Side tables, sinks and the training chain: round trips and hand-made cases."""

import pytest
from pyspark.sql import functions as F

from neumata.functions import dims
from neumata.operators import files, stats, tokens

TEXT = "TimeSig_4/4 Tempo_120 <bar> <melody> p_1/4 d_1 <bass> p_r d_1 <bar> <melody> p_12/3 d_2 </s>"


def test_vocabulary_comes_back(spark, tmp_path):
    vocab = dims.vocab(spark, "step")
    files.write_vocabulary(vocab, f"{tmp_path}/vocab")
    assert sorted(map(tuple, files.read_vocabulary(spark, f"{tmp_path}/vocab").collect())) == sorted((r.id, r.tok, r.tok_type) for r in vocab.collect())


def test_samples_and_side_tables(spark, tmp_path):
    files.write_samples(spark.createDataFrame([(1, "a b", 0.9)], "song_id long, score string, top_p double"), f"{tmp_path}/made")
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/made").select("song_id", "score", "top_p").collect()] == [(1, "a b", 0.9)]
    (tmp_path / "x.csv").write_text("name,year\nFirst,1999\n,2001\n")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "x.csv"), "name string, year int").collect()] == [("First", 1999), (None, 2001)]


def test_statistics_are_kept(spark, tmp_path):
    first = files.kept(spark.range(3), f"{tmp_path}/kept")
    assert files.kept(spark.range(9), f"{tmp_path}/kept").count() == first.count() == 3


def test_steps_become_degrees(spark):
    df = spark.createDataFrame([(1, TEXT, "GMajor")], "song_id long, score string, key string")
    steps = df.withColumn("score", tokens.stepped(F.col("score")))
    assert steps.first().score.split()[4] == "p_1/4_C"
    got = tokens.loaded(steps, "degree").first().score.split()
    assert got[2] == "Key_GMajor" and got[5] == "p_1/4_4" and "p_r" in got and "p_12/3_3" in got
    assert tokens.loaded(steps, "midi").first().score == TEXT
    with pytest.raises(ValueError):
        tokens.loaded(steps, "letters")


def test_sanitized_before_it_is_loaded(spark):
    df = spark.createDataFrame([(1, TEXT.replace("d_2", "d_99"))], "song_id long, score string")
    assert tokens.loaded(df, "step", dims.vocab(spark)).first().score == TEXT.replace("d_2", "d_rare")


def test_training_chain(spark):
    many = "TimeSig_4/4 Tempo_121 " + " ".join(f"<bar> <melody> p_{k + 1}/4 d_1 <bass> p_1/3 d_1" for k in range(12)) + " </s>"
    df = spark.createDataFrame([(k, many) for k in range(20)], "song_id long, score string")
    chain = tokens.Augmented("midi", crop=4, tempo_width=5, swap=True, seed=3)
    one, again, other = (chain(df, e).collect() for e in (1, 1, 2))
    assert sorted(one) == sorted(again) and sorted(one) != sorted(other)
    for r in one:
        t = r.score.split()
        assert t[1] == "Tempo_120/124" and t[-1] == "</s>" and t.count("<bar>") >= 4 and t.count("<melody>") == t.count("<bass>") == t.count("<bar>")
    assert any("<bar> <bass>" in r.score for r in one) and any("[OMIT]" in r.score for r in one)
    assert not any("[OMIT]" in r.score for r in chain(df, 1, train=False).collect())
    assert chain.name == "{pitch=midi, crop=4, tempo=5, swap=True}"
    with pytest.raises(ValueError):
        tokens.Augmented("notes")


def test_texts_taken_apart_within_themselves(spark):
    """Elements, bars, facts and violations of texts are those of their tokens as rows, odd texts included, and no text is shuffled."""
    odd = [TEXT, "", None, "d_1 d_2 p_1/4", "<bar> <tup> <tup> p_1/4 </tup> p_r d_1 </tup> d_2 <bar> p_2/4 d_1 <bass> <bar> </s>", "TimeSig_4/4  Tempo_60 </tup> x <melody> </s> <bar>", "<bass> p_1/3 d_1 </s>"]
    df = spark.createDataFrame(list(enumerate(odd)), "song_id long, score string")
    rows = tokens.parse(df)
    same = lambda a, b, *c: sorted(map(repr, a.select(*c).collect())) == sorted(map(repr, b.select(*c).collect()))
    split = tokens.each_element(tokens.song_elements(df))
    assert same(split, tokens.elements(rows), "song_id", "elm", "bar", "channel", "toks")
    assert same(tokens.song_violations(df), tokens.violations(rows), "song_id", "pos", "rule")
    assert same(stats.song_facts_of(df), stats.song_facts(rows), *stats.song_facts(rows).columns)
    assert same(tokens.song_bars(df), tokens.bar_texts(rows), "song_id", "bar", "text")
    for made in (rows, split, tokens.song_violations(df), stats.song_facts_of(df), tokens.song_bars(df)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
