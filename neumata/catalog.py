"""All registered queries of the score-analytics operators and their SQL counterparts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import Window

from .functions import dims
from .functions import scalars as S
from .functions.lineage import bounded_join, cut
from .operators import files, harmony, intervals, merges, sampling, slots, stats, tokens, voices
from .plans import extract
from .plans import sql as Q
from .plans import voices_sql as V
from .sources import fixtures as X
from .sources import songs
from .streaming import tracking, windows

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


def score_texts(spark, d):
    return X.score_texts(X.songs(spark, d), X.notes(spark, d))


def parsed(spark, d):
    return tokens.parse(score_texts(spark, d))


def counted(spark, d, *by):
    """by, tok, tok_type, n: how often the songs' texts hold each token."""
    return stats.counts(tokens.dealt(score_texts(spark, d), *by), *by, "tok_type", "tok")


# Keys


def scores(spark, d):
    return harmony.key_scores(harmony.class_durations(X.notes(spark, d)))


@query(f"WITH {Q.SCORES}, {Q.SONGS}, {Q.ikr('best')} SELECT dataset, count(*) AS n_songs, round(avg(ikr), 6) AS mean_ikr FROM ikr JOIN songs USING (song_id) GROUP BY dataset")
def ikr_by_dataset(spark, d):
    ikr = harmony.in_key(X.notes(spark, d), harmony.best_key(scores(spark, d)))
    return ikr.join(X.songs(spark, d), "song_id").groupBy("dataset").agg(F.count("*").alias("n_songs"), F.round(F.avg("ikr"), 6).alias("mean_ikr"))


@query(f"WITH {Q.NOTES} SELECT song_id, midi % 12 AS pc, CAST(sum(slots) AS BIGINT) AS dur FROM notes WHERE midi <> -1 GROUP BY ALL")
def pitch_class_durations(spark, d):
    return harmony.class_durations(X.notes(spark, d))


@query(f"WITH {Q.SCORES} SELECT song_id, key, score FROM cands")
def key_candidates(spark, d):
    return harmony.candidates(scores(spark, d)).select("song_id", "key", "score")


@query(f"WITH {Q.SCORES} SELECT song_id, string_agg(key || '=' || score, ',' ORDER BY key) AS keys FROM (SELECT song_id, key, CAST(round(score * 1000000) AS BIGINT) AS score FROM cands) GROUP BY song_id")
def key_maps(spark, d):
    m = harmony.as_map(harmony.candidates(scores(spark, d)))
    text = F.transform(F.map_entries("keys"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 1000000).cast("long").cast("string")))
    return m.select("song_id", F.array_join(text, ",").alias("keys"))


@query(f"WITH {Q.SCORES} SELECT song_id, key, score FROM best")
def best_keys(spark, d):
    return harmony.best_key(scores(spark, d))


@query(f"WITH {Q.SCORES}, {Q.ikr('(SELECT song_id, key FROM scores)')} SELECT song_id, round(max(ikr), 6) AS best_ikr FROM ikr GROUP BY song_id")
def ikr_upper_bound(spark, d):
    return harmony.in_key(X.notes(spark, d), scores(spark, d)).groupBy("song_id").agg(F.round(F.max("ikr"), 6).alias("best_ikr"))


@query(f"WITH {Q.SCORES}, pos AS (SELECT * FROM scores WHERE score > 0), {Q.ikr('pos')} SELECT song_id, round(sum(ikr * score) / sum(score), 6) AS ikr FROM ikr JOIN pos USING (song_id, key) GROUP BY song_id")
def ikr_weighted(spark, d):
    return harmony.weighted_in_key(X.notes(spark, d), scores(spark, d)).select("song_id", F.round("ikr", 6).alias("ikr"))


@query(f"WITH {Q.SCORES} SELECT song_id, key, score FROM (SELECT *, round(-ln(({Q.hashed('song_id', 'key', chr(39) + '7' + chr(39))} + 1) / 1152921504606846977.0::DOUBLE) / score, 9) AS draw FROM cands WHERE score > 0) QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY draw, key) = 1")
def sampled_keys(spark, d):
    return harmony.sampled_key(harmony.candidates(scores(spark, d)), 7)


@query(f"WITH {Q.NOTES}, c AS (SELECT song_id, midi % 12 AS pc, count(*) AS n, min(bar * 1000000 + CAST(channel = 'bass' AS INT) * 100000 + pos) AS met FROM notes WHERE bar < 4 AND midi >= 0 GROUP BY ALL) SELECT song_id, pc, n FROM c QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY n DESC, met, pc) = 1")
def initial_pitch_class(spark, d):
    return harmony.initial_class(X.notes(spark, d))


NAMES = [s[0][0] for s in dims.SPELLINGS]


@query(f"WITH {Q.SCORES}, x AS (SELECT n.song_id, n.midi, CASE WHEN midi < 0 THEN 0 ELSE (instr('CDEFGAB', {NAMES}[midi % 12 + 1]) - instr('CDEFGAB', substr(key, 1, 1)) + 7) % 7 + 1 END AS degree FROM notes n JOIN best USING (song_id)) SELECT CAST(degree AS INT) AS degree, CASE WHEN degree = 0 THEN 'p_r' ELSE {Q.pitch()} || '_' || degree END AS token, count(*) AS n FROM x GROUP BY ALL")
def scale_degrees(spark, d):
    return harmony.shifted(X.notes(spark, d), harmony.best_key(scores(spark, d))).groupBy("degree", "token").agg(F.count("*").alias("n"))


# Vocabularies and tokens


COUNTED = "tc AS (SELECT tok, count(*) AS n FROM tokens GROUP BY tok)"


def used(spark, d, vocab):
    """vocab and how often the songs' texts hold each token."""
    return vocab.join(counted(spark, d).select("tok", "n"), "tok", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def vocab_query(kind):
    def run(spark, d):
        return used(spark, d, dims.vocab(spark, kind))

    run.__name__ = f"vocab_{kind}"
    sizes = {"midi": "SELECT 'p_' || (m % 12 + 1) || '/' || (m // 12 - 1) AS tok, m AS a, 0 AS b FROM range(128) r(m)", "degree": "SELECT 'p_' || (m % 12 + 1) || '/' || (m // 12 - 1) || '_' || g AS tok, m AS a, g AS b FROM range(128) r(m), range(1, 8) s(g)"}
    spelled = Q.values("sp", "pc, k, letter, shift", [(pc, k, x, s) for pc, row in enumerate(dims.SPELLINGS) for k, (x, s) in enumerate(row)])
    pitches = sizes.get(kind, "SELECT 'p_' || (m % 12 + 1) || '/' || (m // 12 - 1 + shift) || '_' || letter AS tok, m AS a, k AS b FROM range(128) r(m) JOIN sp ON sp.pc = m % 12")
    special = Q.values("spc", "a, tok", list(enumerate(dims.SPECIALS)))
    signatures = Q.values("tss", "a, tok", [(k, f"TimeSig_{n}/{e}") for k, (n, e) in enumerate(dims.TIME_SIGNATURES)])
    keys = Q.values("ks", "tok", [(f"Key_{r[0]}",) for r in dims.key_rows()])
    sql = f"""WITH {Q.TOKENS}, {COUNTED}, {spelled}, {special}, {signatures}, {keys}, u AS (
 SELECT 0 AS g, 'special' AS tok_type, a, 0 AS b, tok FROM spc UNION ALL SELECT 1, 'time_sig', -1, 0, 'TimeSig_rare' UNION ALL SELECT 1, 'time_sig', a, 0, tok FROM tss
 UNION ALL SELECT 2, 'tempo', -1, 0, 'Tempo_low' UNION ALL SELECT 2, 'tempo', t, 0, 'Tempo_' || t FROM range(40, 241) r(t) UNION ALL SELECT 2, 'tempo', 999, 0, 'Tempo_high'
 UNION ALL SELECT 3, 'key', row_number() OVER (ORDER BY tok), 0, tok FROM ks UNION ALL SELECT 4, 'pitch', -2, 0, 'p_r' UNION ALL SELECT 4, 'pitch', -1, 0, 'p_rare' UNION ALL SELECT 4, 'pitch', a, b, tok FROM ({pitches})
 UNION ALL SELECT 5, 'duration', -1, 0, 'd_rare' UNION ALL SELECT 5, 'duration', k, 0, {Q.slots('k')} FROM range(1, 49) r(k))
 SELECT id, tok, tok_type, coalesce(n, 0) AS n FROM (SELECT CAST(row_number() OVER (ORDER BY g, a, b) - 1 AS INT) AS id, tok, tok_type FROM u) LEFT JOIN tc USING (tok)"""
    query(sql)(run)


for kind in ("midi", "step", "degree"):
    vocab_query(kind)


@query(f"WITH {Q.TOKENS} SELECT dataset, tok_type, count(*) AS n, count(DISTINCT tok) AS n_distinct FROM tokens JOIN songs USING (song_id) GROUP BY ALL")
def token_type_counts(spark, d):
    return counted(spark, d, "dataset").groupBy("dataset", "tok_type").agg(F.sum("n").alias("n"), F.count("tok").alias("n_distinct"))


@query(f"WITH {Q.TOKENS}, {COUNTED}, {Q.vocab('degree', 'v')} SELECT id, coalesce(n, 0) AS n, CASE WHEN tok = 'p_r' THEN -1 ELSE CAST(nullif(regexp_extract(tok, '^p_(\\d+)/(-?\\d+)', 1), '') AS INT) - 1 + (CAST(nullif(regexp_extract(tok, '^p_(\\d+)/(-?\\d+)', 2), '') AS INT) + 1) * 12 END AS midi, CAST(nullif(regexp_extract(tok, '^p_.*_([1-7])$', 1), '') AS INT) AS degree, CASE WHEN tok = 'Tempo_low' THEN 39 WHEN tok = 'Tempo_high' THEN 241 ELSE CAST(nullif(regexp_extract(tok, '^Tempo_(\\d+)$', 1), '') AS INT) END AS tempo, CAST(nullif(regexp_extract(tok, '^TimeSig_(\\d+)/', 1), '') AS INT) AS ts_num, CAST(nullif(regexp_extract(tok, '^d_(\\d+)', 1), '') AS INT) AS dur_num, CASE WHEN regexp_matches(tok, '^d_\\d') THEN coalesce(CAST(nullif(regexp_extract(tok, '^d_\\d+/(\\d+)$', 1), '') AS INT), 1) END AS dur_den, nullif(regexp_extract(tok, '^Key_(.*)$', 1), '') AS key FROM v LEFT JOIN tc USING (tok)")
def token_meanings(spark, d):
    m = S.meta(F.col("tok"))
    return used(spark, d, dims.vocab(spark, "degree")).select("id", "n", m["midi"].alias("midi"), m["degree"].alias("degree"), m["tempo"].alias("tempo"), m["ts_num"].alias("ts_num"), m["dur_num"].alias("dur_num"), m["dur_den"].alias("dur_den"), m["key"].alias("key"))


@query(f"WITH {Q.TOKENS} SELECT 'd_' || 2 * CAST(substr(tok, 3) AS INT) || '/2' AS tok, count(*) AS n FROM tokens WHERE regexp_matches(tok, '^d_[0-9]+$') GROUP BY ALL")
def vocab_round_trip_violations(spark, d):
    """Tokens of the songs that do not come back from their meaning: whole durations, written on purpose as halves, and no others."""
    m = S.meta(F.col("tok"))
    slots_ = (m["dur_num"] * 8 / m["dur_den"]).cast("int")
    again = F.when(F.col("tok_type") == "pitch", S.pitch_token(m["midi"])).when(F.col("tok_type") == "duration", S.slots_token(slots_)).when(F.col("tok_type") == "time_sig", S.time_sig_token(m["ts_num"], m["ts_den"])).when(F.col("tok_type") == "key", F.concat(F.lit("Key_"), m["key"])).otherwise(F.col("tok"))
    number = F.regexp_extract("tok", "^d_([0-9]+)$", 1)
    broken = F.when(number != "", F.concat(F.lit("d_"), (F.nullif(number, F.lit("")).cast("int") * 2).cast("string"), F.lit("/2"))).otherwise(F.col("tok"))
    rows = counted(spark, d).withColumn("tok", broken).where(F.when(F.col("n") > 0, again != F.col("tok")))  # with n, so that it is asked of each distinct token and not pushed below the count
    return rows.groupBy("tok").agg(F.sum("n").alias("n"))


@query(f"WITH {Q.TOKENS}, {Q.vocab('midi')}, s AS (SELECT t.*, v.tok IS NULL OR t.tok IN ('p_rare', 'd_rare') AS rare, CASE WHEN v.tok IS NOT NULL THEN t.tok WHEN t.tok_type = 'pitch' THEN 'p_rare' WHEN t.tok_type = 'duration' THEN 'd_rare' WHEN t.tok_type = 'time_sig' THEN 'TimeSig_rare' WHEN t.tok_type = 'tempo' AND CAST(substr(t.tok, 7) AS INT) < 40 THEN 'Tempo_low' WHEN t.tok_type = 'tempo' THEN 'Tempo_high' ELSE t.tok END AS clean FROM tokens t LEFT JOIN vocab v USING (tok)) SELECT clean, count(*) AS n, count_if(rare) AS n_rare FROM s GROUP BY clean")
def sanitized_counts(spark, d):
    rows = tokens.sanitized(counted(spark, d), dims.vocab(spark))
    return rows.groupBy("clean").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("rare"), F.col("n")).otherwise(0)).alias("n_rare"))


@query(f"WITH {Q.TOKENS}, {Q.vocab('midi')} SELECT dataset, t.tok_type, round(100.0 * count_if(v.tok IS NULL) / count(*), 6) AS ratio FROM tokens t LEFT JOIN vocab v USING (tok) JOIN songs USING (song_id) GROUP BY ALL")
def rare_token_ratio(spark, d):
    return stats.rare_ratio(tokens.sanitized(counted(spark, d, "dataset"), dims.vocab(spark)), F.col("n"))


@query(f"WITH {Q.TOKENS}, {Q.vocab('midi')} SELECT song_id, count(*) AS n, CAST(sum(id * (pos % 97 + 1)) AS BIGINT) AS checksum, count_if(id IS NULL) AS n_unknown FROM tokens t LEFT JOIN vocab v USING (tok) GROUP BY song_id")
def encoded_ids(spark, d):
    e = tokens.encoded(parsed(spark, d), dims.vocab(spark))
    return e.groupBy("song_id").agg(F.count("*").alias("n"), F.sum(F.col("id") * (F.col("pos") % 97 + 1)).alias("checksum"), F.count_if(F.col("id").isNull()).alias("n_unknown"))


@query(f"WITH {Q.TOKENS} SELECT song_id, bar, string_agg(tok, ' ' ORDER BY pos) AS text FROM tokens WHERE bar >= 0 AND tok <> '</s>' GROUP BY ALL")
def bar_strings(spark, d):
    return tokens.song_bars(score_texts(spark, d))


@query(f"WITH {Q.NOTES}, b AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY song_id ORDER BY bar) - 1 AS INT) AS nth FROM notes) SELECT song_id, nth AS bar, channel, count(*) AS n, CAST(sum(slots) AS BIGINT) * 720720 AS ticks, CAST(sum(midi) AS BIGINT) AS midi_sum FROM b JOIN orders ON o_orderkey = song_id GROUP BY song_id, nth, channel")
def channel_split(spark, d):
    n = tokens.note_list(tokens.each_element(tokens.song_elements(score_texts(spark, d))))
    return n.groupBy("song_id", "bar", "channel").agg(F.count("*").alias("n"), F.sum("ticks").alias("ticks"), F.sum("midi").alias("midi_sum"))


@query(f"WITH {Q.TEXTS}, t AS (SELECT song_id, len(string_split(score, ' ')) AS n, string_split(score, ' ') AS w FROM texts) SELECT song_id, CAST(n - 2 AS INT) AS pos, 'no end' AS rule FROM t WHERE song_id % 5 = 1 UNION ALL SELECT song_id, 1, 'header' FROM t WHERE song_id % 5 = 2 UNION ALL SELECT song_id, CAST(n AS INT), 'empty bar' FROM t WHERE song_id % 5 = 3 UNION ALL SELECT song_id, CAST(n + 1 AS INT), unnest(['empty bar', 'no end']) FROM t WHERE song_id % 5 = 3 UNION ALL SELECT song_id, CAST(n AS INT), 'pitch without duration' FROM t WHERE song_id % 5 = 4 UNION ALL SELECT song_id, CAST(n AS INT), 'no end' FROM t WHERE song_id % 5 = 4")
def grammar_violations(spark, d):
    """Texts broken on purpose in four ways, by their ids; a fifth of them is left whole and must not show up."""
    texts = X.score_texts(X.songs(spark, d), X.notes(spark, d))
    way, score = F.col("song_id") % 5, F.col("score")
    broken = F.when(way == 1, F.regexp_replace(score, " </s>$", "")).when(way == 2, F.regexp_replace(score, " Tempo_[0-9]+", " x")).when(way == 3, F.concat(score, F.lit(" <bar> <bar>"))).when(way == 4, F.concat(score, F.lit(" p_1/4"))).otherwise(score)
    return tokens.song_violations(texts.withColumn("score", broken))


@query(f"WITH {Q.TOKENS} SELECT song_id, count(*) AS n_token, count_if(tok = '<bar>') AS n_bar, count_if(tok LIKE 'p\\_%' ESCAPE '\\' AND tok NOT IN ('p_r', 'p_rare')) AS n_pitch, count_if(tok = 'p_r') AS n_rest, count_if(tok = '<tup>') AS n_tuplet, count(DISTINCT tok) AS n_distinct, max(CASE WHEN tok_type = 'time_sig' THEN tok END) AS time_sig, max(CASE WHEN tok_type = 'tempo' THEN tok END) AS tempo FROM tokens GROUP BY song_id")
def song_facts(spark, d):
    return stats.song_facts_of(score_texts(spark, d))


# Transforms


@query(f"WITH {Q.TEXTS}, p AS (SELECT song_id, string_split(score, ' <bar>') AS parts FROM texts), q AS (SELECT *, CAST({Q.hashed('song_id', chr(39) + '7' + chr(39))} % greatest(len(parts) - 1 - 2 + 1, 1) AS INT) AS dropped FROM p) SELECT song_id, dropped, array_to_string(list_concat([parts[1] || CASE WHEN dropped > 0 THEN ' [OMIT]' ELSE '' END], parts[dropped + 2:]), ' <bar>') AS score FROM q")
def random_crop(spark, d):
    return tokens.cropped(X.score_texts(X.songs(spark, d), X.notes(spark, d)), 7, least=2)


@query(f"WITH {Q.TEXTS}, {Q.values('bins', 'a, z', [(a, z) for a, z, _ in dims.tempo_bins(5)])} SELECT t.song_id, string_split(t.score, ' ')[1] || ' ' || CASE WHEN tempo < 40 THEN 'Tempo_low' WHEN tempo > 240 THEN 'Tempo_high' ELSE 'Tempo_' || a || '/' || z END || ' ' || array_to_string(string_split(t.score, ' ')[3:], ' ') AS score FROM texts t JOIN songs USING (song_id) LEFT JOIN bins ON tempo BETWEEN a AND z")
def tempo_grouped(spark, d):
    return X.score_texts(X.songs(spark, d), X.notes(spark, d)).select("song_id", tokens.tempo_grouped(F.col("score")).alias("score"))


@query(f"WITH {Q.TEXTS}, {Q.SCORES.replace(Q.NOTES + ', ', '')} SELECT t.song_id, array_to_string(list_concat(string_split(score, ' ')[1:2], ['Key_' || key], string_split(score, ' ')[3:]), ' ') AS score FROM texts t JOIN (SELECT song_id, key FROM best) USING (song_id)")
def key_insert(spark, d):
    rows = X.score_texts(X.songs(spark, d), X.notes(spark, d)).join(harmony.best_key(scores(spark, d)).select("song_id", "key"), "song_id")
    return rows.select("song_id", tokens.key_inserted(F.col("score"), F.col("key")).alias("score"))


@query(f"WITH {Q.SCORES} SELECT song_id, round(sum(CASE WHEN c.score IS NULL OR c.score = 0 THEN -1.0 ELSE c.score END * (ordinal + 1)), 6) AS checksum FROM (SELECT DISTINCT song_id FROM cands) CROSS JOIN kdim LEFT JOIN cands c USING (song_id, key) GROUP BY song_id")
def key_vectors(spark, d):
    v = harmony.as_map(harmony.candidates(scores(spark, d))).select("song_id", F.posexplode(tokens.key_vector(F.col("keys"))).alias("k", "v"))
    return v.groupBy("song_id").agg(F.round(F.sum(F.col("v") * (F.col("k") + 1)), 6).alias("checksum"))


@query(f"WITH {Q.TEXTS} SELECT song_id, array_to_string(string_split(score, ' <bar>')[1:3], ' <bar>') AS prompt FROM texts")
def prompts(spark, d):
    t = X.score_texts(X.songs(spark, d), X.notes(spark, d))
    return t.select("song_id", tokens.first_bars(F.col("score"), 2).alias("prompt"))


SPELLED = "list_extract(['C','C','D','D','E','F','F','G','G','A','A','B'], midi % 12 + 1)"


@query(f"WITH {Q.NOTES} SELECT {Q.pitch()} || '_' || {SPELLED} AS tok, {Q.pitch()} AS midi_tok, count(*) AS n FROM notes JOIN orders ON o_orderkey = song_id WHERE midi >= 0 GROUP BY ALL")
def midi_tokens(spark, d):
    """The songs' pitches as step tokens, and these as plain ones again."""
    texts = X.score_texts(X.songs(spark, d), X.notes(spark, d))
    rows = tokens.parse(texts.withColumn("score", tokens.stepped(F.col("score")))).where(S.is_pitch_heard(F.col("tok")))
    return stats.counts(rows, "tok").select("tok", tokens.to_midi(F.col("tok")).alias("midi_tok"), "n")


MIX = f"""mn AS (SELECT song_id, bar, pos, channel, pitch || ' ' || duration AS elm, dense_rank() OVER (PARTITION BY song_id ORDER BY bar) AS nth, row_number() OVER (PARTITION BY song_id, bar, channel ORDER BY pos, pitch, duration) AS rn FROM nt),
mz AS (SELECT song_id, nth, CAST(count_if(channel = 'melody') AS BIGINT) AS m, CAST(count_if(channel = 'bass') AS BIGINT) AS b FROM mn GROUP BY ALL),
mk AS (SELECT *, CAST({Q.hashed('song_id', 'nth', 'k', "'7'")} % (m + b) < m AS INT) AS coin FROM (SELECT *, unnest(range(1, m + b + 1)) AS k FROM mz)),
mc AS (SELECT *, sum(coin) OVER (PARTITION BY song_id, nth ORDER BY k) AS cm, sum(1 - coin) OVER (PARTITION BY song_id, nth ORDER BY k) AS cb FROM mk),
mt AS (SELECT *, min(CASE WHEN cm >= m THEN k END) OVER (PARTITION BY song_id, nth) AS tm, min(CASE WHEN cb >= b THEN k END) OVER (PARTITION BY song_id, nth) AS tb FROM mc),
mh AS (SELECT *, CASE WHEN m = 0 THEN 0 WHEN b = 0 THEN 1 WHEN k > least(coalesce(tm, 1000000), coalesce(tb, 1000000)) THEN CAST(coalesce(tb, 1000000) < coalesce(tm, 1000000) AS INT) ELSE coin END AS high FROM mt),
mo AS (SELECT *, sum(high) OVER (PARTITION BY song_id, nth ORDER BY k) AS hm, k - sum(high) OVER (PARTITION BY song_id, nth ORDER BY k) AS hb, lag(high) OVER (PARTITION BY song_id, nth ORDER BY k) AS prev FROM mh),
ms AS (SELECT mo.song_id, mo.nth, string_agg(CASE WHEN prev IS DISTINCT FROM high THEN CASE WHEN high = 1 THEN '<melody> ' ELSE '<bass> ' END ELSE '' END || elm, ' ' ORDER BY k) AS text FROM mo JOIN mn ON mn.song_id = mo.song_id AND mn.nth = mo.nth AND mn.channel = CASE WHEN high = 1 THEN 'melody' ELSE 'bass' END AND mn.rn = CASE WHEN high = 1 THEN hm ELSE hb END GROUP BY ALL)"""


@query(f"WITH {Q.TEXTS}, {MIX} SELECT s.song_id, 'TimeSig_' || ts_num || '/' || ts_den || ' Tempo_' || tempo || ' ' || string_agg('<bar> ' || text, ' ' ORDER BY nth) || ' </s>' AS score FROM songs s JOIN ms USING (song_id) GROUP BY s.song_id, ts_num, ts_den, tempo")
def channel_mix(spark, d):
    return tokens.mixed(X.score_texts(X.songs(spark, d), X.notes(spark, d)), 7)


@query(f"WITH {Q.SCORES} SELECT song_id, key, count(*) OVER (PARTITION BY song_id) AS n_keys FROM cands")
def songs_with_all_keys(spark, d):
    m = harmony.as_map(harmony.candidates(scores(spark, d)))
    return m.select("song_id", F.explode(F.map_keys("keys")).alias("key"), F.size("keys").cast("long").alias("n_keys"))


# Statistics


@query(f"WITH {Q.SONGS} SELECT dataset, ts_num, ts_den, count(*) AS n FROM songs GROUP BY ALL")
def time_sig_dist(spark, d):
    return stats.counts(X.songs(spark, d), "dataset", "ts_num", "ts_den")


@query(f"WITH {Q.SONGS}, {Q.values('bins', 'a, z, m', dims.tempo_bins(5))} SELECT dataset, CASE WHEN tempo < 40 THEN 'Tempo_low' WHEN tempo > 240 THEN 'Tempo_high' ELSE 'Tempo_' || a || '/' || z END AS tempo_bin, count(*) AS n FROM songs LEFT JOIN bins ON tempo BETWEEN a AND z GROUP BY ALL")
def tempo_binned(spark, d):
    return stats.counts(X.songs(spark, d).withColumn("tempo_bin", S.tempo_bin_token(F.col("tempo"))), "dataset", "tempo_bin")


@query(f"WITH {Q.NOTES}, {Q.SONGS} SELECT dataset, midi, CAST(sum(slots) AS BIGINT) AS w FROM notes JOIN songs USING (song_id) WHERE midi >= 0 GROUP BY ALL")
def weighted_pitch(spark, d):
    rows = X.notes(spark, d).where("midi >= 0").join(X.songs(spark, d).select("song_id", "dataset"), "song_id")
    return stats.weighted(rows, ["dataset"], "midi", F.col("slots"))


@query(f"WITH {Q.NOTES}, {Q.SONGS}, c AS (SELECT dataset, slots, sum(1) AS w FROM notes JOIN songs USING (song_id) GROUP BY ALL) SELECT dataset, slots, round(100.0 * w / sum(w) OVER (PARTITION BY dataset), 6) AS w FROM c")
def duration_share(spark, d):
    rows = X.notes(spark, d).join(X.songs(spark, d).select("song_id", "dataset"), "song_id")
    return stats.weighted(rows, ["dataset"], "slots", F.lit(1), share=True)


@query(f"WITH {Q.SCORES}, {Q.SONGS} SELECT dataset, key, round(sum(score), 4) AS w FROM cands JOIN songs USING (song_id) GROUP BY ALL")
def key_dist(spark, d):
    rows = harmony.candidates(scores(spark, d)).join(X.songs(spark, d).select("song_id", "dataset"), "song_id")
    return stats.weighted(rows, ["dataset"], "key", F.col("score")).withColumn("w", F.round("w", 4))


WORDS = "w AS (SELECT doc_id, lang, unnest(list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS tok FROM documents)"


def words(spark, d):
    return X.table(spark, d, "documents").select("doc_id", "lang", F.explode(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda t: t != "")).alias("tok"))


@query(f"WITH {WORDS}, c AS (SELECT lang, tok, count(*) AS n FROM w GROUP BY ALL) SELECT lang, tok, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tok) AS rank, round(sum(n) OVER (PARTITION BY lang ORDER BY n DESC, tok ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY lang), 9) AS share FROM c")
def token_coverage(spark, d):
    return stats.coverage(words(spark, d), "lang")


@query(f"WITH {WORDS}, c AS (SELECT lang, tok, count(*) AS n FROM w GROUP BY ALL), s AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY n DESC, tok) AS rank, round(sum(n) OVER (PARTITION BY lang ORDER BY n DESC, tok ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY lang), 9) AS share FROM c), r(ratio) AS (VALUES (0.68::DOUBLE), (0.95), (0.986), (0.997)) SELECT lang, ratio, coalesce(min(CASE WHEN share > ratio THEN rank - 1 END), 0) AS first FROM s CROSS JOIN r GROUP BY ALL")
def coverage_thresholds(spark, d):
    return stats.needed(stats.coverage(words(spark, d), "lang"), "lang", [0.68, 0.95, 0.986, 0.997])


@query(f"WITH {WORDS}, n AS (SELECT doc_id, lang, count(*) AS n FROM w GROUP BY ALL) SELECT lang, min(n) AS low, round(quantile_cont(n, 0.997), 6) AS high FROM n GROUP BY lang")
def token_length_percentile(spark, d):
    return stats.ranges(words(spark, d).groupBy("doc_id", "lang").agg(F.count("*").alias("n")), "lang", "n")


@query(f"WITH {Q.TOKENS}, {Q.vocab('midi')}, c AS (SELECT tok, count(*) AS n FROM tokens GROUP BY tok) SELECT v.tok, coalesce(n, 0) AS n FROM vocab v LEFT JOIN c USING (tok)")
def vocab_usage(spark, d):
    return stats.zero_filled(counted(spark, d), dims.vocab(spark))


@query(f"WITH {Q.NOTES}, {Q.SONGS}, b AS (SELECT song_id, bar, max(CASE WHEN channel = 'melody' AND midi >= 0 THEN 1 ELSE 0 END) AS m, max(CASE WHEN channel = 'bass' AND midi >= 0 THEN 1 ELSE 0 END) AS s FROM notes GROUP BY ALL), p AS (SELECT dataset, song_id, count(*) AS bars, sum(1 - m) AS me, sum(1 - s) AS be FROM b JOIN songs USING (song_id) GROUP BY ALL) SELECT dataset, 'melody' AS channel, 'bar' AS by, round(sum(me) / sum(bars), 6) AS ratio FROM p GROUP BY dataset UNION ALL SELECT dataset, 'bass', 'bar', round(sum(be) / sum(bars), 6) FROM p GROUP BY dataset UNION ALL SELECT dataset, 'melody', 'song', round(avg(CAST(me = bars AS INT)), 6) FROM p GROUP BY dataset UNION ALL SELECT dataset, 'bass', 'song', round(avg(CAST(be = bars AS INT)), 6) FROM p GROUP BY dataset")
def empty_channel_ratio(spark, d):
    return stats.empty_channels(X.notes(spark, d), X.songs(spark, d))


@query(f"WITH {Q.NOTES}, {Q.SONGS} SELECT dataset, round(count_if(slots % 3 = 0) / count(*), 6) AS by_count, round(sum(CASE WHEN slots % 3 = 0 THEN slots ELSE 0 END) / sum(slots), 6) AS by_weight FROM notes JOIN songs USING (song_id) GROUP BY dataset")
def tuplet_ratio(spark, d):
    rows = X.notes(spark, d).join(X.songs(spark, d).select("song_id", "dataset"), "song_id")
    return stats.ratio(rows, "dataset", F.col("slots") % 3 == 0, F.col("slots"))


SEVERITY = Q.values("sev", "warn_type, severity", list(dims.WARNINGS.items()))


@query(f"WITH {Q.SONGS}, {Q.NOTES}, {SEVERITY}, ws AS (SELECT dataset, 'Rare Mean Tempo' AS warn_type FROM songs WHERE tempo NOT BETWEEN 40 AND 240 UNION ALL SELECT dataset, 'Rare Time Signature' FROM songs WHERE ts_num || '/' || ts_den NOT IN ('2/2','2/4','3/4','4/4','5/4','6/8','12/8') UNION ALL SELECT dataset, 'Invalid Bar Notes Duration' FROM (SELECT song_id FROM notes GROUP BY song_id, bar, channel HAVING sum(slots) > 60) JOIN songs USING (song_id)), c AS (SELECT dataset, warn_type, count(*) AS n FROM ws GROUP BY ALL UNION ALL SELECT 'all', warn_type, count(*) FROM ws GROUP BY warn_type), z AS (SELECT dataset, count(*) AS songs FROM songs GROUP BY dataset UNION ALL SELECT 'all', count(*) FROM songs) SELECT dataset, warn_type, severity, n, round(n / songs, 6) AS per_song FROM c JOIN z USING (dataset) JOIN sev USING (warn_type)")
def warning_counts(spark, d):
    songs = X.songs(spark, d)
    return stats.warning_counts(stats.warnings(songs, X.notes(spark, d)), songs)


@query(f"WITH {Q.SONGS}, c AS (SELECT artist, tempo, count(*) AS n, min(song_id) AS met FROM songs GROUP BY ALL) SELECT artist, tempo, n FROM c QUALIFY row_number() OVER (PARTITION BY artist ORDER BY n DESC, met) = 1")
def tempo_mode(spark, d):
    return stats.mode_first(X.songs(spark, d), "artist", "tempo", "song_id")


@query(f"WITH {Q.SONGS}, {Q.NOTES} SELECT dataset, round(sum(tempo * slots) / sum(slots), 6) AS tempo FROM notes JOIN songs USING (song_id) GROUP BY dataset")
def weighted_mean_tempo(spark, d):
    rows = X.notes(spark, d).join(X.songs(spark, d), "song_id")
    return rows.groupBy("dataset").agg(F.round(F.sum(F.col("tempo") * F.col("slots")) / F.sum("slots"), 6).alias("tempo"))


@query(f"WITH {Q.SONGS}, {Q.NOTES}, b AS (SELECT song_id, max(bar) + 1 AS bars FROM notes GROUP BY song_id) SELECT song_id, CAST(round_even(bars * (ts_num * 4.0 / ts_den) * 60.0 / tempo, 0) AS BIGINT) AS seconds FROM b JOIN songs USING (song_id)")
def song_seconds(spark, d):
    b = X.notes(spark, d).groupBy("song_id").agg((F.max("bar") + 1).alias("bars")).join(X.songs(spark, d), "song_id")
    return b.select("song_id", F.bround(F.col("bars") * (F.col("ts_num") * 4.0 / F.col("ts_den")) * 60.0 / F.col("tempo")).cast("long").alias("seconds"))


@query(f"WITH {Q.NOTES}, a AS (SELECT song_id, bar, channel, sum(CASE WHEN midi < 0 THEN 0 ELSE 440.0 * pow(2.0, (midi - 69) / 12.0) END * slots) / sum(slots) AS f FROM notes GROUP BY ALL) SELECT song_id, bar, channel FROM a QUALIFY row_number() OVER (PARTITION BY song_id, bar ORDER BY round(f, 6) DESC, channel DESC) = 1")
def highest_part(spark, d):
    f = F.sum(S.frequency(F.col("midi")) * F.col("slots")) / F.sum("slots")
    rows = X.notes(spark, d).groupBy("song_id", "bar", "channel").agg(F.round(f, 6).alias("f"))
    return rows.groupBy("song_id", "bar").agg(F.max_by("channel", F.struct("f", "channel")).alias("channel"))


# Intervals

W = "WINDOW w AS (PARTITION BY song_id, part, bar ORDER BY start, \"end\", midi, id)"


@query(f"WITH {Q.INTERVALS}, x AS (SELECT *, coalesce(lag(\"end\") OVER w, 0) AS b, row_number() OVER (PARTITION BY song_id, part, bar ORDER BY start DESC, \"end\" DESC, midi DESC, id DESC) AS back FROM iv {W}) SELECT song_id, part, bar, bool_or(start > b) OR max(CASE WHEN back = 1 THEN \"end\" END) < 32 AS has_gap, bool_or(start < b) AS has_overlap, CAST(sum(\"end\" - start) AS BIGINT) AS covered FROM x GROUP BY song_id, part, bar")
def note_gaps(spark, d):
    return intervals.gaps(X.intervals(spark, d))


REST = f"{Q.INTERVALS}, x AS (SELECT *, coalesce(max(\"end\") OVER (PARTITION BY song_id, part, bar ORDER BY start, \"end\", midi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS r FROM iv), rest AS (SELECT song_id, part, bar, r AS start, start AS \"end\" FROM x WHERE start > r UNION ALL SELECT song_id, part, bar, max(\"end\"), 32 FROM iv GROUP BY song_id, part, bar HAVING max(\"end\") < 32)"


@query(f'WITH {REST} SELECT song_id, part, bar, start, "end" FROM rest')
def rest_fill(spark, d):
    return intervals.rests(X.intervals(spark, d))


@query(f'WITH {Q.INTERVALS}, m AS (SELECT song_id, part, bar, id, start, "end", CASE WHEN id % 2 = 0 THEN -1 ELSE midi END AS midi FROM iv), l AS (SELECT *, lag("end") OVER w AS le, lag(midi) OVER w AS lm FROM m {W}), n AS (SELECT *, CASE WHEN midi = -1 AND lm = -1 AND le = start THEN 0 ELSE 1 END AS nw FROM l), g AS (SELECT *, sum(nw) OVER (PARTITION BY song_id, part, bar ORDER BY start, "end", midi, id ROWS UNBOUNDED PRECEDING) AS run FROM n) SELECT song_id, part, bar, min(start) AS start, max("end") AS "end", min(midi) AS midi FROM g GROUP BY song_id, part, bar, run')
def rest_merge(spark, d):
    return intervals.joined_rests(X.intervals(spark, d).withColumn("midi", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("midi"))))


SLOTS = f'{Q.INTERVALS}, sl AS (SELECT *, unnest(range(start // 2, ("end" - 1) // 2 + 1)) AS slot FROM iv WHERE "end" > start), q AS (SELECT song_id, part, bar, CAST(slot AS INT) AS slot, id, midi FROM sl WHERE slot < 16 QUALIFY row_number() OVER (PARTITION BY song_id, part, bar, slot ORDER BY least("end", (slot + 1) * 2) - greatest(start, slot * 2) DESC, start, "end", midi, id) = 1)'


@query(f"WITH {SLOTS} SELECT song_id, part, bar, slot, id, midi FROM q")
def quantized_slots(spark, d):
    return intervals.quantized(X.intervals(spark, d))


@query(f"WITH {SLOTS}, r AS (SELECT *, slot - row_number() OVER (PARTITION BY song_id, part, bar, id ORDER BY slot) AS isl FROM q) SELECT song_id, part, bar, id, min(slot) AS first, count(*) AS n FROM r GROUP BY song_id, part, bar, id, isl")
def quantized_runs(spark, d):
    return intervals.runs(intervals.quantized(X.intervals(spark, d)))


@query(f'WITH {Q.INTERVALS}, x AS (SELECT *, CAST(unnest(range(start, "end")) AS INT) AS slot FROM iv) SELECT song_id, part, bar, slot, max(midi) AS midi FROM x GROUP BY song_id, part, bar, slot')
def skyline_slots(spark, d):
    return intervals.slot_top(X.intervals(spark, d))


@query(f"WITH {Q.NOTES} SELECT b.song_id, b.bar, b.midi, b.slots, b.pos FROM notes b WHERE b.channel = 'bass' AND NOT EXISTS (SELECT 1 FROM notes m WHERE m.channel = 'melody' AND m.song_id = b.song_id AND m.bar = b.bar AND m.midi = b.midi AND m.slots = b.slots)")
def bass_anti_melody(spark, d):
    n = X.notes(spark, d)
    melody = n.where("channel = 'melody'").select("song_id", "bar", "midi", "slots")
    return n.where("channel = 'bass'").join(melody, ["song_id", "bar", "midi", "slots"], "left_anti").select("song_id", "bar", "midi", "slots", "pos")


@query("WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN CAST(20 + event_id % 260 AS INT) END AS tempo FROM events) SELECT event_id, user_id, coalesce(last_value(tempo IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 120) AS tempo FROM e")
def asof_tempo(spark, d):
    tempo = F.when(F.col("event_id") % 3 == 0, (20 + F.col("event_id") % 260).cast("int"))
    e = X.table(spark, d, "events").select("event_id", "user_id", "ts", tempo.alias("tempo"))
    return intervals.carried(e, ["user_id"], ["ts", "event_id"], "tempo", 120).drop("ts")


@query(f"WITH {Q.NOTES}, e AS (SELECT song_id, bar, bool_and(midi < 0) AS empty FROM notes GROUP BY ALL), k AS (SELECT song_id, min(bar) AS a, max(bar) AS z FROM e WHERE NOT empty GROUP BY song_id) SELECT song_id, bar FROM e JOIN k USING (song_id) WHERE bar BETWEEN a AND z")
def bars_without_empty_ends(spark, d):
    e = X.notes(spark, d).groupBy("song_id", "bar").agg(F.bool_and(F.col("midi") < 0).alias("empty"))
    k = e.where("not empty").groupBy("song_id").agg(F.min("bar").alias("a"), F.max("bar").alias("z"))
    return e.join(k, "song_id").where("bar between a and z").select("song_id", "bar")


@query(f"WITH {Q.SONGS}, {Q.NOTES}, r AS (SELECT song_id, bar, channel, pos, slots, ts_num * 32 // ts_den AS room, sum(slots) OVER (PARTITION BY song_id, bar, channel ORDER BY pos) AS upto FROM notes JOIN songs USING (song_id)) SELECT song_id, bar, channel, pos, CAST(least(upto, room) - (upto - slots) AS BIGINT) AS slots FROM r WHERE upto - slots < room")
def bar_repair(spark, d):
    upto = F.sum("slots").over(Window.partitionBy("song_id", "bar", "channel").orderBy("pos"))
    r = X.notes(spark, d).join(X.songs(spark, d), "song_id").withColumns({"upto": upto, "room": F.floor(F.col("ts_num") * 32 / F.col("ts_den")).cast("long")})
    return r.where("upto - slots < room").select("song_id", "bar", "channel", "pos", (F.least("upto", "room") - (F.col("upto") - F.col("slots"))).alias("slots"))


@query(f"WITH {Q.NOTES}, s AS (SELECT song_id, bar, sum(CASE WHEN channel = 'melody' THEN slots ELSE 0 END) AS m, sum(CASE WHEN channel = 'bass' THEN slots ELSE 0 END) AS b FROM notes GROUP BY ALL) SELECT song_id, bar, CASE WHEN m < b THEN 'melody' ELSE 'bass' END AS channel, CAST(abs(m - b) AS BIGINT) AS pad FROM s WHERE m <> b")
def channel_padding(spark, d):
    s = X.notes(spark, d).groupBy("song_id", "bar").agg(*(F.sum(F.when(F.col("channel") == c, F.col("slots")).otherwise(0)).alias(c) for c in ("melody", "bass")))
    return s.where("melody <> bass").select("song_id", "bar", F.when(F.col("melody") < F.col("bass"), "melody").otherwise("bass").alias("channel"), F.abs(F.col("melody") - F.col("bass")).alias("pad"))


# Sampling, splits, sets

EPOCH = Q.hashed("song_id", "'epoch3'")


@query(f"WITH {Q.SONGS} SELECT dataset, song_id FROM songs QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY {EPOCH}, song_id) <= 100")
def proportional_mix(spark, d):
    return sampling.proportional(X.songs(spark, d).select("dataset", "song_id"), "dataset", "song_id", 100, epoch=3)


@query(f"WITH {Q.SONGS}, x AS (SELECT dataset, song_id, row_number() OVER (PARTITION BY dataset ORDER BY {Q.hashed('song_id', chr(39) + '77' + chr(39))}, song_id) AS rn, count(*) OVER (PARTITION BY dataset) AS n FROM songs) SELECT dataset, song_id, CASE WHEN rn <= least(greatest(floor(n * 0.02), 50), 500) THEN 'test' ELSE 'train' END AS split FROM x")
def train_test_split(spark, d):
    return sampling.split(X.songs(spark, d).select("dataset", "song_id"), "dataset", "song_id")


@query(f"WITH {Q.SONGS} SELECT song_id FROM songs WHERE {Q.hashed('song_id', chr(39) + '5' + chr(39))} % 10 = 0")
def bernoulli_thinning(spark, d):
    return sampling.thinned(X.songs(spark, d).select("song_id"), "song_id", 10, 5)


@query(f"WITH {Q.SONGS} SELECT dataset, song_id FROM songs QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY song_id) <= 20")
def first_songs(spark, d):
    return sampling.first_rows(X.songs(spark, d).select("dataset", "song_id"), "dataset", ["song_id"], 20)


@query(f"WITH {Q.SONGS}, z AS (SELECT dataset, count(*) AS n FROM songs GROUP BY dataset), b AS (SELECT dataset, n, sum(n) OVER (ORDER BY dataset) AS upto FROM z) SELECT position, dataset, CAST(position - (upto - n) AS BIGINT) AS local FROM (SELECT unnest(range((SELECT count(*) FROM orders))) AS position) JOIN b ON position >= upto - n AND position < upto")
def global_positions(spark, d):
    sizes = stats.counts(X.songs(spark, d), "dataset")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    return sampling.placed(sizes, spark.range(total).select(F.col("id").alias("position")))


@query(f"WITH {Q.SONGS} SELECT count(*) AS rows, count(DISTINCT song_id) AS keys, 0::BIGINT AS doubles FROM songs")
def splits_cover_all(spark, d):
    return sampling.is_partition(sampling.split(X.songs(spark, d), "dataset", "song_id"), "song_id", "split")


@query("SELECT o_custkey AS artist FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def artists_of_one_set_only(spark, d):
    s = X.songs(spark, d)
    return s.where("dataset = '1-URGENT'").select("artist").subtract(s.where("dataset = '5-LOW'").select("artist"))


@query("SELECT o_custkey AS artist FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def artists_of_both_sets(spark, d):
    s = X.songs(spark, d)
    return s.where("dataset = '1-URGENT'").select("artist").intersect(s.where("dataset = '5-LOW'").select("artist"))


# Element merges

ELEMENTS = f"{Q.TEXTS.replace('texts AS', 'texts0 AS')}, el AS (SELECT pitch || ' ' || duration AS elm_text, count(*) AS n FROM nt JOIN songs USING (song_id) GROUP BY 1), er AS (SELECT *, row_number() OVER (ORDER BY n DESC, elm_text) AS rank FROM el)"


@query(f"WITH {ELEMENTS} SELECT elm_text, n, rank FROM er WHERE rank <= 500")
def pair_merge_topk(spark, d):
    return merges.element_counts(tokens.each_element(tokens.song_elements(score_texts(spark, d)))).where("rank <= 500")


@query(f"WITH {ELEMENTS}, s AS (SELECT round(sum(n) OVER (ORDER BY rank) / sum(n) OVER (), 9) AS share FROM er), r(ratio) AS (VALUES (0.5::DOUBLE), (0.68), (0.95)) SELECT ratio, count_if(share <= ratio) AS size FROM s CROSS JOIN r GROUP BY ratio")
def pair_merge_cutoff(spark, d):
    return merges.cutoff(merges.element_counts(tokens.each_element(tokens.song_elements(score_texts(spark, d)))), [0.5, 0.68, 0.95])


@query(f"WITH {Q.TEXTS} SELECT song_id FROM texts WHERE song_id % 5 = 1")
def pair_merge_round_trip_violations(spark, d):
    """Songs whose text does not come back from merged elements: those whose closing token is taken out on purpose, and no others."""
    rows = tokens.song_elements(score_texts(spark, d))
    vocab = merges.merged_vocab(merges.element_counts(tokens.each_element(rows)), dims.vocab(spark), 500)
    merged = merges.song_texts(rows, vocab)
    kept = F.when(F.col("song_id") % 5 == 1, F.filter("toks", lambda t: t != "</s>")).otherwise(F.col("toks"))
    return merged.where(F.col("score") != F.array_join(kept, " ")).select("song_id")


@query(f"WITH {Q.TOKENS}, {Q.vocab('midi')} SELECT song_id, string_agg(chr(CAST(id + 19968 AS INT)), '' ORDER BY pos) AS chars FROM tokens JOIN vocab USING (tok) GROUP BY song_id")
def score_characters(spark, d):
    return merges.to_chars(tokens.encoded(parsed(spark, d), dims.vocab(spark)))


#: Size of the vocabulary that is trained on the documents.
PIECES = 2048


def word_counts(spark, d):
    """word, n of every word, written to the shared folder: training and cutting both read it."""
    return cut(words(spark, d).groupBy(F.col("tok").alias("word")).agg(F.count("*").alias("n")))


@query()
def wordpiece_tokens(spark, d):
    w = word_counts(spark, d)
    return merges.wordpieces(w, merges.train_wordpiece(w, PIECES))


@query(f"WITH {WORDS} SELECT tok AS word, count(*) AS n FROM w GROUP BY tok")
def wordpiece_decoded(spark, d):
    """Every word, from the pieces it was cut into, and how often it occurs."""
    w = word_counts(spark, d)
    pieces = merges.wordpieces(w, merges.train_wordpiece(w, 600), "n")
    return pieces.groupBy(merges.unpieced(F.col("pieces")).alias("word")).agg(F.sum("n").alias("n"))


@query(f"WITH {Q.NOTES} SELECT song_id, count(*) AS n, CAST(sum(midi) AS BIGINT) AS midi_sum FROM notes WHERE song_id IN (SELECT o_orderkey FROM orders) GROUP BY song_id")
def pitches_of_pieces(spark, d):
    """The pitches of each song (a rest is -1), by way of pieces trained on its characters."""
    vocab = dims.vocab(spark)
    chars = cut(merges.song_words(score_texts(spark, d), vocab))
    each = chars.select("song_id", F.explode("words").alias("word"))
    w = each.groupBy("word").agg(F.count("*").alias("n"))
    pieces = merges.wordpieces(w, merges.train_wordpiece(w, 1000)).select("word", F.explode("pieces").alias("piece"))
    pitches = merges.piece_pitches(pieces, vocab)
    per = pieces.join(pitches, "piece").groupBy("word").agg(F.sum(F.size("pitches")).alias("n"), F.sum(F.aggregate("pitches", F.lit(0).cast("long"), lambda a, p: a + p)).alias("m"))
    return bounded_join(each, per, "word").groupBy("song_id").agg(F.sum("n").alias("n"), F.sum("m").alias("midi_sum"))


# Files

URLS = "u AS (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', '', 's'), '/$', '') AS path FROM pages), f AS (SELECT page_id, path, regexp_replace(path, '^.*/', '', 's') AS name FROM u)"


def url_names(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", r"(?s)[?#].*$", ""), "/$", "")
    return X.table(spark, d, "pages").select("page_id", path.alias("path")).withColumn("name", F.substring_index("path", "/", -1))


@query(f"WITH {URLS} SELECT page_id, name, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN '_v' || (row_number() OVER (PARTITION BY name ORDER BY path, page_id) - 1) ELSE '' END AS version FROM f")
def version_dedupe(spark, d):
    return files.versioned(url_names(spark, d), ["name"], ["path", "page_id"]).drop("path")


@query("WITH x AS (SELECT o_custkey AS artist, 'song' || (o_orderkey % 7) || CASE WHEN o_orderkey % 3 > 0 THEN '.' || (o_orderkey % 3) ELSE '' END AS name FROM orders), v AS (SELECT artist, name, CASE WHEN regexp_matches(name, '^(.*)\\.([1-9][0-9]*)$') THEN regexp_extract(name, '^(.*)\\.([1-9][0-9]*)$', 1) ELSE name END AS title, CASE WHEN regexp_matches(name, '^(.*)\\.([1-9][0-9]*)$') THEN CAST(regexp_extract(name, '^(.*)\\.([1-9][0-9]*)$', 2) AS INT) ELSE 0 END AS version FROM x) SELECT artist, title, min_by(name, version) AS name, min(version) AS version FROM v GROUP BY ALL")
def min_version(spark, d):
    o = X.table(spark, d, "orders")
    name = F.concat(F.lit("song"), (F.col("o_orderkey") % 7).cast("string"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("."), (F.col("o_orderkey") % 3).cast("string"))).otherwise(""))
    title, version = files.title_and_version(F.col("name"))
    rows = o.select(F.col("o_custkey").alias("artist"), name.alias("name")).withColumns({"title": title, "version": version})
    return files.lowest_versions(rows, ["artist", "title"], "version", "name")


@query("SELECT p_partkey AS name, CASE WHEN p_partkey % 3 > 0 THEN 'MS' WHEN p_partkey % 2 = 0 THEN 'LP' ELSE 'NA' END AS backend, CASE WHEN p_partkey % 3 > 0 OR p_partkey % 2 = 0 THEN 'converted' ELSE 'error' END AS status FROM part")
def conversion_status(spark, d):
    listing = X.table(spark, d, "part").select(F.col("p_partkey").alias("name"))
    return files.conversion(listing, listing.where("name % 3 > 0"), listing.where("name % 2 = 0"))


@query("SELECT count(*) AS n_file, count(DISTINCT o_custkey) AS n_artist, count(DISTINCT (o_custkey, o_orderpriority)) AS n_song FROM orders")
def corpus_totals(spark, d):
    return files.totals(X.songs(spark, d).select("artist", F.col("dataset").alias("title")))


@query("SELECT p_partkey, lpad(CAST(p_partkey - p_partkey % 1000 AS VARCHAR), 6, '0') || '-' || lpad(CAST(least(p_partkey - p_partkey % 1000 + 1000, 178561) - 1 AS VARCHAR), 6, '0') || '/' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS name FROM part")
def ordinal_names(spark, d):
    return X.table(spark, d, "part").select("p_partkey", files.ordinal_name(F.col("p_partkey"), 178_561, 1000).alias("name"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 4 = 1)")
def split_membership(spark, d):
    songs = X.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("title"))
    titles = X.table(spark, d, "nation").where("n_nationkey % 4 = 1").select(F.col("n_nationkey").cast("string").alias("title"))
    return files.by_title(songs, titles).select("c_custkey")


# Training logs

LOG = "lg AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 + 100 * (ascii(event_type) % 5) AS step, value FROM events)"


def log(spark, d):
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    return X.table(spark, d, "events").select(F.col("event_type").alias("run"), (F.row_number().over(w) - 1 + 100 * (F.ascii("event_type") % 5)).cast("long").alias("step"), "value")


@query("WITH p AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE WHEN event_id % 11 = 0 THEN -100 ELSE event_id % 4 END AS label, (event_id // 2) % 4 AS pred FROM events), x AS (SELECT *, lead(label) OVER (PARTITION BY user_id ORDER BY pos) AS want FROM p) SELECT user_id, round(avg(CAST(pred = want AS INT)), 6) AS accuracy, count(*) AS n FROM x WHERE want IS NOT NULL AND want <> -100 GROUP BY user_id")
def ntp_accuracy(spark, d):
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    label = F.when(F.col("event_id") % 11 == 0, -100).otherwise(F.col("event_id") % 4)
    preds = X.table(spark, d, "events").select("user_id", pos.alias("pos"), label.alias("label"), (F.floor(F.col("event_id") / 2) % 4).alias("pred"))
    return stats.next_token_accuracy(preds, "user_id")


@query(f"WITH {LOG}, r AS (SELECT run, value, row_number() OVER (PARTITION BY run ORDER BY step) AS k, count(*) OVER (PARTITION BY run) AS n FROM lg) SELECT run, round(sum(CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END * pow(0.9::DOUBLE, n - k) * value), 6) AS last FROM r GROUP BY run")
def ema_smooth(spark, d):
    return stats.smoothed(log(spark, d), "run")


@query(f"WITH {LOG}, s AS (SELECT run, min(step) AS first FROM lg GROUP BY run), b AS (SELECT run, lead(first) OVER (ORDER BY run) AS until FROM s) SELECT lg.run, step, value FROM lg JOIN b USING (run) WHERE until IS NULL OR step < until")
def log_stitch(spark, d):
    return stats.stitched(log(spark, d))


@query(f"WITH {LOG} SELECT a.run, a.step FROM lg a WHERE a.step % 97 <> 0 AND (a.step - 1) % 97 = 0 AND EXISTS (SELECT 1 FROM lg b WHERE b.run = a.run AND b.step = a.step - 2)")
def log_breaks(spark, d):
    """Every 97th step is taken out of the log: the steps after the holes must show up."""
    return stats.breaks(log(spark, d).where("step % 97 <> 0"), "run")


@query(f"WITH {LOG} SELECT step, " + ", ".join(f"max(CASE WHEN run = '{k}' THEN round(value, 6) END) AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM lg GROUP BY step")
def log_pivot(spark, d):
    return log(spark, d).groupBy("step").pivot("run").agg(F.round(F.max("value"), 6))


# Streaming


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_stream(spark, d):
    return windows.hourly(spark, f"{d}/events.parquet")


@query(f"WITH {LOG} SELECT run, step // 50 AS window, round(avg(value), 6) AS mean, count(*) AS n FROM lg GROUP BY ALL")
def step_metric_means(spark, d):
    return stats.window_means(log(spark, d), "run", 50)


# Formats, names, admission


@query(f"WITH {Q.NOTES}, c AS (SELECT song_id, channel, slots, count(*) AS n FROM notes GROUP BY ALL) SELECT channel, slots, CAST(sum(n) AS BIGINT) AS n, count(*) AS songs FROM c GROUP BY ALL")
def counters_by_format(spark, d):
    per = X.notes(spark, d).groupBy("song_id", "channel", "slots").agg(F.count("*").alias("n"))
    return stats.merged_by(per, ["channel"], "slots")


@query(f"WITH {Q.NOTES} SELECT channel, count(*) AS n, round(median(slots), 6) AS median FROM notes GROUP BY channel")
def expanded_medians(spark, d):
    per = X.notes(spark, d).groupBy("channel", "slots").agg(F.count("*").alias("n"))
    return stats.expanded(per).groupBy("channel").agg(F.count("*").alias("n"), F.round(F.median("slots"), 6).alias("median"))


@query(f"WITH {Q.NOTES}, {Q.SONGS} SELECT dataset, count(*) AS n, count_if(slots % 8 = 0) AS n_quarter, count_if(slots % 4 = 0) AS n_eighth, count_if(slots % 2 = 0) AS n_sixteenth FROM notes JOIN songs USING (song_id) GROUP BY dataset")
def grid_predicates(spark, d):
    rows = X.notes(spark, d).join(X.songs(spark, d).select("song_id", "dataset"), "song_id")
    ticks = F.col("slots").cast("long") * S.SLOT_TICKS
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), *(F.count_if(S.on_grid(ticks, p)).alias(f"n_{name}") for p, name in ((1, "quarter"), (2, "eighth"), (4, "sixteenth"))))


@query(f"WITH {Q.NOTES}, g AS (SELECT song_id, bool_or(slots % 2 <> 0) AS off_grid, count(DISTINCT channel) < 2 AS one_part, bool_and(midi < 0) AS unheard FROM notes GROUP BY song_id) SELECT *, NOT (off_grid OR one_part OR unheard) AS admitted FROM g")
def song_admission(spark, d):
    return stats.admitted(X.notes(spark, d), 4)


@query("SELECT k AS part, min(url) AS url FROM pages JOIN (VALUES ('/EN/'), ('/fr/'), ('.html'), ('nowhere at all')) t(k) ON contains(lower(url), lower(k)) GROUP BY k")
def example_lookup(spark, d):
    pages = X.table(spark, d, "pages").select("url")
    found = [files.lookup(pages, "url", k).select(F.lit(k).alias("part"), "url") for k in ("/EN/", "/fr/", ".html", "nowhere at all")]
    return reduce(lambda a, b: a.union(b), found)


@query("WITH p AS (SELECT p_brand AS brand, replace(p_name, ' ', '_') || '_' || p_partkey AS name, p_partkey AS k FROM part) SELECT brand, name AS stem, 'a/' || name || '.mxl' AS first, 'b/' || name || '.musicxml.mxl' AS second FROM p WHERE k % 2 = 0 AND k % 3 = 0")
def paired_formats(spark, d):
    name = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey"))
    rows = X.table(spark, d, "part").select(F.col("p_brand").alias("brand"), name.alias("name"), F.col("p_partkey").alias("k"))
    first = rows.where("k % 2 = 0").select("brand", F.concat(F.lit("a/"), "name", F.lit(".mxl")).alias("path"))
    second = rows.where("k % 3 = 0").select("brand", F.concat(F.lit("b/"), "name", F.lit(".musicxml.mxl")).alias("path"))
    return files.paired(first, second, "brand")


@query("SELECT DISTINCT o_custkey AS name FROM orders WHERE o_custkey % 3 = 0 OR o_custkey > (SELECT max(c_custkey) FROM customer WHERE c_custkey % 2 = 0)")
def output_orphans(spark, d):
    top = X.table(spark, d, "customer").where("c_custkey % 2 = 0").agg(F.max("c_custkey").alias("top"))  # one row
    orders = X.table(spark, d, "orders").select(F.col("o_custkey").alias("name")).distinct()
    listing = orders.join(F.broadcast(top), F.col("name") <= F.col("top")).where("name % 3 <> 0").select("name")
    return files.orphans(orders, listing)


@query("WITH a AS (SELECT o_custkey AS artist, o_orderpriority AS k, count(*) AS v FROM orders GROUP BY ALL), b AS (SELECT o_custkey AS artist, o_orderpriority AS k, CAST(-max(o_orderkey) AS BIGINT) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL) SELECT a.artist, a.k AS key, coalesce(b.v, a.v) AS value FROM a LEFT JOIN b ON a.artist = b.artist AND a.k = b.k WHERE a.artist IN (SELECT artist FROM b)")
def merged_settings(spark, d):
    o = X.table(spark, d, "orders").select(F.col("o_custkey").alias("artist"), F.col("o_orderpriority").alias("k"), "o_orderkey", "o_orderstatus")
    as_map = lambda df, v, name: df.groupBy("artist", "k").agg(v.cast("long").alias("v")).groupBy("artist").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(name))
    both = as_map(o, F.count("*"), "a").join(as_map(o.where("o_orderstatus = 'F'"), -F.max("o_orderkey"), "b"), "artist")
    return both.select("artist", F.explode(S.last_wins(F.col("a"), F.col("b"))).alias("key", "value"))


@query(f"WITH {Q.SCORES}, {Q.SONGS} SELECT song_id, CASE WHEN key LIKE '%Major' THEN replace(key, 'Major', '') ELSE replace(key, 'Minor', 'm') END AS short_key, lpad(CAST(tempo * 7 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(tempo * 7 % 60 AS VARCHAR), 2, '0') AS length, round(60e6 / (tempo * 2500), 6) AS bpm, '{{n=' || tempo || ', ts=' || ts_num || '/' || ts_den || '}}' AS meta FROM best JOIN songs USING (song_id)".replace("{{", "{").replace("}}", "}"))
def song_labels(spark, d):
    rows = harmony.best_key(scores(spark, d)).select("song_id", "key").join(X.songs(spark, d), "song_id")
    tempo = F.col("tempo")
    meta = S.meta_text(n=tempo, ts=F.concat_ws("/", "ts_num", "ts_den"))
    return rows.select("song_id", S.short_key(F.col("key")).alias("short_key"), S.minutes((tempo * 7).cast("long")).alias("length"), F.round(S.bpm(tempo * 2500), 6).alias("bpm"), meta.alias("meta"))


@query(f"WITH {Q.TOKENS}, {COUNTED}, {Q.vocab('step', 'v')} SELECT id, nullif(regexp_extract(tok, '^p_.*_([A-G])$', 1), '') AS step, tok_type, coalesce(n, 0) AS n FROM v LEFT JOIN tc USING (tok)")
def vocab_steps(spark, d):
    return used(spark, d, dims.vocab(spark, "step")).select("id", S.meta(F.col("tok"))["step"].alias("step"), "tok_type", "n")


# Tuplets


RUNS = f"{Q.NOTES}, r0 AS (SELECT *, CASE WHEN slots % 4 = 3 THEN NULL ELSE CAST(slots % 4 AS INT) END AS kind FROM notes), r1 AS (SELECT *, sum(CAST(kind IS NOT NULL AND kind IS DISTINCT FROM prev AS INT)) OVER (PARTITION BY song_id, bar, channel ORDER BY pos) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY song_id, bar, channel ORDER BY pos) AS prev FROM r0)), r2 AS (SELECT *, CASE WHEN kind IS NOT NULL THEN run || '/' || ((row_number() OVER (PARTITION BY song_id, bar, channel, run, kind ORDER BY pos) - 1) // 3) END AS chunk FROM r1)"


def chunks(spark, d):
    kind = F.when(F.col("slots") % 4 != 3, (F.col("slots") % 4).cast("int"))
    return intervals.tuplet_chunks(X.notes(spark, d).withColumn("kind", kind), ["song_id", "bar", "channel"], ["pos"], "kind", 3)


@query(f"WITH {RUNS} SELECT song_id, bar, channel, pos, chunk FROM r2")
def tuplet_chunks(spark, d):
    return chunks(spark, d).select("song_id", "bar", "channel", "pos", "chunk")


@query(f"WITH {RUNS}, g AS (SELECT song_id, bar, channel, chunk, count(*) AS n, CAST(sum(slots) AS BIGINT) AS slots FROM r2 WHERE chunk IS NOT NULL GROUP BY ALL) SELECT song_id, bar, channel, chunk, slots % n <> 0 AS tuplet, k, CASE WHEN slots % n = 0 THEN slots // n ELSE slots END AS part FROM (SELECT *, unnest(CASE WHEN slots % n = 0 THEN range(n) ELSE [0::BIGINT] END) AS k FROM g)")
def tuplets_made_plain(spark, d):
    groups = chunks(spark, d).where("chunk is not null").groupBy("song_id", "bar", "channel", "chunk").agg(F.count("*").alias("n"), F.sum("slots").cast("long").alias("slots"))
    return intervals.plain_tuplets(groups).select("song_id", "bar", "channel", "chunk", "tuplet", F.col("k").cast("long").alias("k"), "part")


# Texts for training

LETTER = "list_extract(['C','C','D','D','E','F','F','G','G','A','A','B'], CAST(regexp_extract(tok, '^p_(\\d+)/', 1) AS INT))"
DEGREES = f"{Q.TEXTS}, {Q.SCORES.replace(Q.NOTES + ', ', '')}, dt AS (SELECT song_id, key, unnest(string_split(texts.score, ' ')) AS tok, generate_subscripts(string_split(texts.score, ' '), 1) AS pos FROM texts JOIN best USING (song_id)), dd AS (SELECT song_id, key, pos, CASE WHEN tok LIKE 'p!_%' ESCAPE '!' AND tok <> 'p_r' THEN tok || '_' || ((strpos('CDEFGAB', {LETTER}) - strpos('CDEFGAB', key[1]) + 7) % 7 + 1) ELSE tok END AS tok FROM dt)"


@query(f"WITH {DEGREES} SELECT song_id, string_agg(CASE WHEN pos = 2 THEN tok || ' Key_' || key ELSE tok END, ' ' ORDER BY pos) AS score FROM dd GROUP BY song_id")
def degree_texts(spark, d):
    texts = X.score_texts(X.songs(spark, d), X.notes(spark, d)).join(harmony.best_key(scores(spark, d)).select("song_id", "key"), "song_id")
    return tokens.loaded(texts.withColumn("score", tokens.stepped(F.col("score"))), "degree")


@query(f"WITH {Q.TEXTS}, bn AS (SELECT *, dense_rank() OVER (PARTITION BY song_id ORDER BY bar) AS nth FROM parts), bs AS (SELECT song_id, nth, '<bar> ' || string_agg(part, ' ' ORDER BY (channel = 'bass') <> ({Q.hashed('song_id', 'nth', chr(39) + '3' + chr(39))} % 2 = 1)) AS text FROM bn GROUP BY song_id, nth) SELECT s.song_id, 'TimeSig_' || ts_num || '/' || ts_den || ' Tempo_' || tempo || ' ' || string_agg(text, ' ' ORDER BY nth) || ' </s>' AS score FROM songs s JOIN bs USING (song_id) GROUP BY s.song_id, ts_num, ts_den, tempo")
def channel_swap(spark, d):
    return tokens.swapped(X.score_texts(X.songs(spark, d), X.notes(spark, d)), 3)


# Bars of chords and tuplets

NOTE = "song_id, part, bar, start, \"end\", array_to_string(pitches, ' ') AS pitches, tuplet"


def noted(df, *more):
    return df.select("song_id", "part", "bar", "start", "end", F.array_join(F.transform("pitches", lambda p: p.cast("string")), " ").alias("pitches"), "tuplet", *more)


@query(f"WITH RECURSIVE {V.GROUPS} SELECT song_id, part, bar, voice, CAST(run AS BIGINT) AS run, g, size, total, start, \"end\", odd, severe, low, overlap, run_overlap, run_gap, CAST(n_options AS BIGINT) AS n_options FROM gr")
def tuplet_groups(spark, d):
    g = voices.tuplets(X.elements(spark, d))
    return g.select("song_id", "part", "bar", "voice", F.col("run").cast("long").alias("run"), "g", "size", "total", "start", "end", "odd", "severe", "low", "overlap", "run_overlap", "run_gap", F.col("n_options").cast("long").alias("n_options"))


@query(f"WITH RECURSIVE {V.WAYS.format(most=12)} SELECT song_id, part, bar, voice, g, CAST(run AS BIGINT) AS run, array_to_string(pitches, ' ') AS pitches FROM chosen")
def tuplet_choices(spark, d):
    """Every way through the chords of a group; beyond 12 ways the highest."""
    ways = voices.choices(voices.tuplets(X.elements(spark, d)), 12)
    return ways.select("song_id", "part", "bar", "voice", "g", F.col("run").cast("long").alias("run"), F.array_join(F.transform("pitches", lambda p: p.cast("string")), " ").alias("pitches"))


@query(f"WITH RECURSIVE {V.WAYS.format(most=100_000)}, r AS (SELECT *, list_sum(pitches) AS s FROM chosen) SELECT song_id, part, bar, voice, g, CAST(run AS BIGINT) AS run, CAST(rank - 1 AS INT) AS rank, CAST(s AS BIGINT) AS pitch_sum FROM (SELECT *, row_number() OVER (PARTITION BY song_id, part, bar, voice, run, g ORDER BY s DESC, pitches) AS rank FROM r) WHERE rank <= 4")
def tuplet_best_choices(spark, d):
    """The four highest ways, without building the others."""
    ways = voices.best_choices(voices.tuplets(X.elements(spark, d)), 4)
    return ways.select("song_id", "part", "bar", "voice", "g", F.col("run").cast("long").alias("run"), "rank", F.aggregate("pitches", F.lit(0).cast("long"), lambda a, p: a + p).alias("pitch_sum"))


@query(f"WITH RECURSIVE {V.HIGH} SELECT {NOTE} FROM hi")
def skyline_high(spark, d):
    return noted(voices.skyline(voices.compound(X.elements(spark, d))))


@query(f"WITH RECURSIVE {V.LINES} SELECT {NOTE} FROM lo")
def skyline_low(spark, d):
    return noted(voices.skyline(voices.compound(X.elements(spark, d), "low"), "low"))


@query(f"WITH RECURSIVE {V.LINES} SELECT {NOTE} FROM ba")
def bass_without_melody(spark, d):
    e = X.elements(spark, d)
    return noted(voices.bass_of(e, voices.skyline(voices.compound(e))))


@query(f"WITH RECURSIVE {V.HIGH}, {V.grid('hi', 'gm')} SELECT {NOTE}, how FROM gm")
def bars_on_grid(spark, d):
    """The melody's bars on the grid: kept or dealt out anew, gaps filled, even tuplets made plain, rests joined."""
    room = X.score_bars(spark, d).select("song_id", "part", "bar", "room")
    return noted(voices.plain(voices.placed(voices.skyline(voices.compound(X.elements(spark, d))), room)), "how")


@query(f"WITH RECURSIVE {V.GROUPS}, h0 AS (SELECT *, max(\"end\") OVER (PARTITION BY song_id, part, bar ORDER BY start, \"end\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM gr), h1 AS (SELECT *, sum(CAST(reached IS NULL OR start >= reached AS INT)) OVER (PARTITION BY song_id, part, bar ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS no FROM h0) SELECT song_id, part, bar, CAST(no AS BIGINT) AS hull, min(start) AS start, max(\"end\") AS \"end\", count(*) AS n FROM h1 GROUP BY song_id, part, bar, no")
def tuplet_hulls(spark, d):
    """Stretches of each bar that tuplets of any voice cover together."""
    return voices.hulls(voices.tuplets(X.elements(spark, d)).select("song_id", "part", "bar", "start", "end")).withColumn("hull", F.col("hull").cast("long"))


@query(f"WITH RECURSIVE {V.HIGH} SELECT song_id, part, bar, nth, CAST(sum(len) OVER (PARTITION BY song_id, part, bar ORDER BY nth) - len AS BIGINT) AS start, CAST(sum(len) OVER (PARTITION BY song_id, part, bar ORDER BY nth) AS BIGINT) AS \"end\", pitches FROM (SELECT song_id, part, bar, row_number() OVER (PARTITION BY song_id, part, bar ORDER BY start, \"end\") AS nth, \"end\" - start AS len, array_to_string(pitches, ' ') AS pitches FROM hi)")
def notes_unrolled_and_packed(spark, d):
    """Notes taken apart into single ones, back to back, and put together again: the same notes, none shorter by a tick."""
    got = voices.packed(voices.unrolled(voices.skyline(voices.compound(X.elements(spark, d)))))
    return got.select("song_id", "part", "bar", F.col("nth").cast("long").alias("nth"), "start", "end", F.array_join(F.transform("pitches", lambda p: p.cast("string")), " ").alias("pitches"))


@query(V.TEXTS)
def extracted_texts(spark, d):
    """Scores written as MusicXML, parsed, and extracted to token texts, tuplets included."""
    files = songs.musicxml(X.elements(spark, d), X.score_bars(spark, d))
    return extract.extract(files).select("song_id", "score", "seconds")


@query(V.warnings(12))
def extraction_warnings(spark, d):
    """How often each bar (-1: the whole song) is warned of for each reason."""
    found = extract.every_warning(X.elements(spark, d), X.score_bars(spark, d), 12)
    return found.groupBy("song_id", F.coalesce("bar", F.lit(-1).cast("long")).alias("bar"), "warn_type").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT user_id AS song_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS k, event_id % 4 AS t FROM events), n AS (SELECT *, count_if(k = 'signup') OVER (PARTITION BY song_id ORDER BY seq) AS nth FROM e), u AS (SELECT song_id, nth, min(seq) AS until FROM n WHERE k = 'purchase' AND nth > 0 GROUP BY ALL) SELECT song_id, until AS seq, 'w' || t AS warn_type, count(*) AS n FROM n JOIN u USING (song_id, nth) WHERE k NOT IN ('signup', 'purchase') AND seq < until GROUP BY ALL")
def tracked_warnings(spark, d):
    """Warnings since each start of a song, from a stream that is stopped and goes on halfway."""
    e = X.table(spark, d, "events")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    event = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end").otherwise("warn")
    rows = e.select(F.col("user_id").alias("song_id"), seq.alias("seq"), event.alias("event"), F.concat(F.lit("w"), F.col("event_id") % 4).alias("warn_type"), "ts")
    half = e.agg((F.avg(F.unix_timestamp("ts"))).alias("at")).first().at or 0
    early = F.unix_timestamp("ts") < half
    return tracking.run(spark, [rows.where(early).drop("ts"), rows.where(~early).drop("ts")])


@query(f"WITH {DEGREES}, drawn AS (SELECT song_id, key AS k FROM (SELECT *, round(-ln(({Q.hashed('song_id', 'key', chr(39) + '5' + chr(39))} + 1) / 1152921504606846977.0::DOUBLE) / score, 9) AS draw FROM cands WHERE score > 0) QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY draw, key) = 1), {Q.values('bins', 'a, z', [(a, z) for a, z, _ in dims.tempo_bins(5)])}, ct AS (SELECT dt.song_id, drawn.k, pos, CASE WHEN v.tok IS NOT NULL THEN dt.tok WHEN dt.tok LIKE 'd!_%' ESCAPE '!' THEN 'd_rare' WHEN dt.tok LIKE 'TimeSig!_%' ESCAPE '!' THEN 'TimeSig_rare' WHEN dt.tok LIKE 'Tempo!_%' ESCAPE '!' THEN CASE WHEN CAST(substr(dt.tok, 7) AS INT) < 40 THEN 'Tempo_low' ELSE 'Tempo_high' END ELSE dt.tok END AS tok FROM dt JOIN drawn USING (song_id) LEFT JOIN (SELECT tok FROM ({{'x'}})) v USING (tok)) SELECT song_id, string_agg(CASE WHEN pos = 2 THEN tok || ' Key_' || k WHEN tok LIKE 'p!_%' ESCAPE '!' AND tok <> 'p_r' THEN tok || '_' || ((strpos('CDEFGAB', {LETTER}) - strpos('CDEFGAB', k[1]) + 7) % 7 + 1) ELSE tok END, ' ' ORDER BY pos) AS score FROM ct GROUP BY song_id".replace("(SELECT tok FROM ({'x'}))", f"(WITH {Q.vocab('midi', 'mv')} SELECT tok FROM mv)"))
def training_texts(spark, d):
    """An epoch of the training chain: rare tokens replaced, a key drawn among the candidates, degrees of that key."""
    texts = X.score_texts(X.songs(spark, d), X.notes(spark, d)).join(harmony.as_map(harmony.candidates(scores(spark, d))), "song_id")
    vocab = dims.vocab(spark, "midi")
    rows = tokens.clean(texts, vocab, ["keys"]).withColumn("score", tokens.stepped(F.col("score")))
    return tokens.Augmented("degree", seed=2, keys="keys")(rows, 3)


# Slots, stretches, formats, envelopes

SLOTTED = f"{Q.NOTES}, g0 AS (SELECT song_id, bar, pos, slots, slots % 4 = 0 AND midi >= 0 AND pos % 2 = 1 AS three, midi, CAST(sum(slots) OVER (PARTITION BY song_id, bar ORDER BY pos) - slots AS INT) AS start FROM notes WHERE channel = 'melody')"


def slotted(spark, d):
    """Melodies of triplets (whole quarters of their slots at odd places) and plain notes, back to back."""
    n = X.notes(spark, d).where("channel = 'melody'")
    start = F.sum("slots").over(Window.partitionBy("song_id", "bar").orderBy("pos")) - F.col("slots")
    three = (F.col("slots") % 4 == 0) & (F.col("midi") >= 0) & (F.col("pos") % 2 == 1)
    pitches = F.when(three, F.array("midi", F.col("midi"), (F.col("midi") + 5) % 128)).otherwise(F.array("midi"))
    return n.select("song_id", "bar", start.cast("int").alias("start"), "slots", pitches.alias("pitches"))


@query(f"WITH {SLOTTED}, g1 AS (SELECT *, dense_rank() OVER (PARTITION BY song_id ORDER BY bar) - 1 AS nth, CAST(three OR coalesce(lag(three) OVER w, true) OR lag(midi) OVER w IS DISTINCT FROM midi AS INT) AS new FROM g0 WINDOW w AS (PARTITION BY song_id, bar ORDER BY pos)), g2 AS (SELECT *, sum(new) OVER (PARTITION BY song_id, bar ORDER BY pos) AS run FROM g1) SELECT song_id, nth AS bar, min(start) AS start, CAST(sum(slots) AS INT) AS slots, any_value(CASE WHEN three THEN midi || ' ' || midi || ' ' || (midi + 5) % 128 ELSE CAST(midi AS VARCHAR) END) AS pitches FROM g2 GROUP BY song_id, nth, run")
def slot_round_trip(spark, d):
    """Melodies as rows of 64 ids and back: triplets by their marks, neighbours of one pitch as one note."""
    got = slots.song_notes(slots.song_rows(slotted(spark, d), 64))
    return got.select("song_id", "bar", "start", "slots", F.array_join(F.transform("pitches", lambda p: p.cast("string")), " ").alias("pitches"))


@query(f'WITH {Q.INTERVALS}, st AS (SELECT song_id, part, bar, t AS start, sum(d) AS d FROM (SELECT song_id, part, bar, start AS t, 1 AS d FROM iv WHERE "end" > start UNION ALL SELECT song_id, part, bar, "end", -1 FROM iv WHERE "end" > start) GROUP BY ALL HAVING sum(d) <> 0), r AS (SELECT song_id, part, bar, start, sum(d) OVER w AS n, lead(start) OVER w AS "end" FROM st WINDOW w AS (PARTITION BY song_id, part, bar ORDER BY start)) SELECT song_id, part, bar, start, "end", CAST(n AS BIGINT) AS n FROM r WHERE n > 0')
def simultaneous_notes(spark, d):
    return intervals.simultaneous(X.intervals(spark, d))


@query(f'WITH {Q.INTERVALS}, x AS (SELECT song_id, midi, bar * 32 + start AS a, bar * 32 + "end" AS z FROM iv WHERE "end" > start), st AS (SELECT song_id, midi, t AS start, sum(d) AS d FROM (SELECT song_id, midi, a AS t, 1 AS d FROM x UNION ALL SELECT song_id, midi, z, -1 FROM x) GROUP BY ALL HAVING sum(d) <> 0), r AS (SELECT song_id, midi, start, sum(d) OVER w AS n, lead(start) OVER w AS "end" FROM st WINDOW w AS (PARTITION BY song_id, midi ORDER BY start)) SELECT song_id, midi, start, "end", CAST(n AS BIGINT) AS n FROM r WHERE n > 0')
def piano_roll(spark, d):
    """When each pitch of a song sounds, over all its bars, and how often at once."""
    at = F.col("bar") * 32
    rows = X.intervals(spark, d).select("song_id", "midi", (at + F.col("start")).alias("start"), (at + F.col("end")).alias("end"))
    return intervals.simultaneous(rows, ("song_id", "midi"))


@query(f"WITH {V.BARS} SELECT song_id, bar, tempo FROM (SELECT *, lag(tempo) OVER (PARTITION BY song_id ORDER BY bar) AS before FROM sbars WHERE tempo IS NOT NULL) WHERE before IS NULL OR before <> tempo")
def tempo_changes(spark, d):
    return intervals.changes(X.score_bars(spark, d), ["song_id"], ["bar"], "tempo").select("song_id", "bar", "tempo")


@query(f"WITH {V.ELEMENTS}, f AS (SELECT DISTINCT song_id, ['.mxl', '.musicxml', '.xml', '.musicxml.mxl', ''][song_id % 5 + 1] AS format, song_id % 7 IN (2, 3) AS bad FROM rooms) SELECT format, NULL::BIGINT AS ticks, count(*) AS n, count_if(bad) AS broken FROM f GROUP BY format UNION ALL SELECT format, dur, CAST(sum(len(pitches)) AS BIGINT), 0 FROM el JOIN f USING (song_id) WHERE NOT bad AND len(pitches) > 0 GROUP BY format, dur")
def scanned_formats(spark, d):
    """Files of five formats, some of them cut off or no scores at all: what can be read is counted, what cannot is counted too."""
    files = songs.musicxml(X.elements(spark, d), X.score_bars(spark, d)).withColumn("song_id", F.col("path").cast("long"))
    ending = F.element_at(F.array(*map(F.lit, (".mxl", ".musicxml", ".xml", ".musicxml.mxl", ""))), (F.col("song_id") % 5 + 1).cast("int"))
    broken = F.when(F.col("song_id") % 7 == 2, F.substring("content", 1, 200)).when(F.col("song_id") % 7 == 3, F.encode(F.lit("PK none"), "UTF-8")).otherwise(F.col("content"))
    files = files.select(F.concat("path", ending).alias("path"), broken.alias("content"))
    return songs.by_format(songs.scanned(songs.parse(files)))


@query(f"WITH {Q.TEXTS} SELECT dataset, count(*) AS n, CAST(sum(length(score)) AS BIGINT) AS chars, min(md5(score)) AS least, max(md5(score)) AS most FROM texts GROUP BY dataset")
def combined_songs(spark, d):
    """All songs written as envelopes and read back."""
    meta = F.struct(F.lit("full").alias("mode"), F.lit(5).alias("precision"), F.lit(False).alias("with_pitch_step"), F.lit(None).cast("long").alias("greedy_tuplet_pitch_threshold"))
    rows = X.score_texts(X.songs(spark, d), X.notes(spark, d)).select(F.lit("str").alias("encoding_type"), meta.alias("extractor_meta"), "score", F.col("song_id").cast("string").alias("song_path"), F.col("dataset").alias("title"), F.lit(0).alias("duration"), F.lit(None).cast(songs.WARNING).alias("warnings"), F.lit(None).cast("map<string,double>").alias("keys"))
    at = windows.shared(spark, "combined")
    songs.combine(rows, at)
    back = songs.load_combined(spark, at)
    return back.groupBy(F.col("title").alias("dataset")).agg(F.count("*").alias("n"), F.sum(F.length("score")).alias("chars"), F.min(F.md5("score")).alias("least"), F.max(F.md5("score")).alias("most"))
