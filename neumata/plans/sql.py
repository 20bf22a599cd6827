"""The derived tables of the fixtures in DuckDB SQL, for holding queries against another engine."""

from __future__ import annotations

from ..functions import dims
from ..sources.fixtures import SIGNATURES


def values(name: str, columns: str, rows) -> str:
    lit = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


SONGS = f"""songs AS (SELECT o_orderkey AS song_id, o_custkey AS artist, o_orderpriority AS dataset, CAST(CAST(floor(o_totalprice) AS BIGINT) % 260 + 20 AS INT) AS tempo,
 CAST({[s[0] for s in SIGNATURES]}[o_custkey % {len(SIGNATURES)} + 1] AS INT) AS ts_num, CAST({[s[1] for s in SIGNATURES]}[o_custkey % {len(SIGNATURES)} + 1] AS INT) AS ts_den FROM orders)"""
NOTES = """notes AS (SELECT l_orderkey AS song_id, l_linenumber - 1 AS bar, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_linestatus ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax, l_returnflag) AS pos,
 CASE WHEN l_linestatus = 'O' THEN 'melody' ELSE 'bass' END AS channel, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_partkey % 3 = 0 THEN -1 ELSE CAST(l_partkey % 128 AS INT) END AS midi,
 CAST(CAST(floor(l_quantity) AS INT) % 60 + 1 AS INT) AS slots FROM lineitem)"""
INTERVALS = """ivals AS (SELECT user_id AS song_id, event_type AS part, CAST(floor(floor(epoch(ts)) / 3600) AS BIGINT) AS bar, event_id AS id, least(CAST(floor((CAST(floor(epoch(ts)) AS BIGINT) % 3600) / 112.0) AS INT), 31) AS s0,
 CAST(1 + ((CAST(floor(value) AS BIGINT) % 12) + 12) % 12 AS INT) AS len, CAST(36 + (event_id * 7) % 60 AS INT) AS midi FROM events),
iv AS (SELECT song_id, part, bar, id, s0 AS start, least(s0 + len, 32) AS "end", midi FROM ivals)"""


def pitch(m: str = "midi") -> str:
    return f"(CASE WHEN {m} < 0 THEN 'p_r' ELSE 'p_' || ({m} % 12 + 1) || '/' || (({m} - {m} % 12) // 12 - 1) END)"


def slots(n: str = "slots") -> str:
    return f"(CASE WHEN {n} % 8 = 0 THEN 'd_' || ({n} // 8) WHEN {n} % 4 = 0 THEN 'd_' || ({n} // 4) || '/2' WHEN {n} % 2 = 0 THEN 'd_' || ({n} // 2) || '/4' ELSE 'd_' || {n} || '/8' END)"


def hashed(*parts: str) -> str:
    return f"CAST('0x' || substr(md5({" || '|' || ".join(parts)}), 1, 15) AS BIGINT)"


TEXTS = f"""{SONGS}, {NOTES}, nt AS (SELECT *, {pitch()} AS pitch, {slots()} AS duration FROM notes),
parts AS (SELECT song_id, bar, channel, '<' || channel || '> ' || string_agg(pitch || ' ' || duration, ' ' ORDER BY pos, pitch, duration) AS part FROM nt GROUP BY song_id, bar, channel),
barts AS (SELECT song_id, bar, '<bar> ' || string_agg(part, ' ' ORDER BY channel = 'bass', part) AS text FROM parts GROUP BY song_id, bar),
texts AS (SELECT s.song_id, s.dataset, 'TimeSig_' || ts_num || '/' || ts_den || ' Tempo_' || tempo || ' ' || string_agg(text, ' ' ORDER BY bar) || ' </s>' AS score FROM songs s JOIN barts USING (song_id) GROUP BY s.song_id, s.dataset, ts_num, ts_den, tempo)"""
TOKENS = f"""{TEXTS}, tk0 AS (SELECT song_id, unnest(string_split(score, ' ')) AS tok, generate_subscripts(string_split(score, ' '), 1) - 1 AS pos FROM texts),
tokens AS (SELECT song_id, CAST(pos AS INT) AS pos, tok, CASE WHEN starts_with(tok, 'p_') THEN 'pitch' WHEN starts_with(tok, 'd_') THEN 'duration' WHEN starts_with(tok, 'TimeSig_') THEN 'time_sig' WHEN starts_with(tok, 'Tempo_') THEN 'tempo' WHEN starts_with(tok, 'Key_') THEN 'key' ELSE 'special' END AS tok_type,
 CAST(sum(CAST(tok = '<bar>' AS INT)) OVER w - 1 AS INT) AS bar, last_value(CASE WHEN tok = '<melody>' THEN 'melody' WHEN tok = '<bass>' THEN 'bass' END IGNORE NULLS) OVER w AS channel FROM tk0 WINDOW w AS (PARTITION BY song_id ORDER BY pos))"""
PROFILE = values("prof", "key, mode, pc, w", dims.profile_rows())
KEYS = values("kdim", "key, ordinal, mode, tonic, tonic_pc, off", [(k, o, m, t, p, f) for k, o, m, t, p, f in dims.key_rows(False)])
SCORES = f"""{NOTES}, {PROFILE}, {KEYS}, dur AS (SELECT song_id, midi % 12 AS pc, sum(slots) AS dur FROM notes WHERE midi <> -1 GROUP BY ALL),
sids AS (SELECT DISTINCT song_id FROM dur), grid AS (SELECT song_id, key, mode, w, coalesce(dur, 0) AS d FROM sids CROSS JOIN prof LEFT JOIN dur USING (song_id, pc)),
scores AS (SELECT song_id, key, mode, round((12 * sum(w * d) - sum(w) * sum(d)) / sqrt(nullif((12.0 * sum(d * d) - sum(d) * sum(d)), 0) * (12 * sum(w * w) - sum(w) * sum(w))), 6) AS score FROM grid GROUP BY ALL HAVING score IS NOT NULL),
cands AS (SELECT * FROM scores QUALIFY score >= (CASE mode WHEN 1 THEN 0.8 ELSE 0.7 END) * max(score) OVER (PARTITION BY song_id, mode)),
best AS (SELECT song_id, key, score FROM scores QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY score DESC, key) = 1)"""


def vocab(kind: str, name: str = "vocab", **options) -> str:
    return values(name, "id, tok, tok_type", dims.vocab_rows(kind, **options))


def ikr(keys: str, name: str = "ikr") -> str:
    return f"""{name} AS (SELECT k.song_id, k.key, coalesce(avg(CASE WHEN n.midi IS NULL THEN NULL WHEN list_contains(d.off, (n.midi % 12 - d.tonic_pc + 12) % 12) THEN 0.0 ELSE 1.0 END), 0.0) AS ikr FROM {keys} k JOIN kdim d USING (key) LEFT JOIN (SELECT * FROM notes WHERE midi >= 0) n ON n.song_id = k.song_id GROUP BY ALL)"""
