"""Compound notes in DuckDB SQL: tuplet groups, chord options, the sweep (all by recursion), the grid, texts."""

from __future__ import annotations

from ..functions.dims import TICKS_PER_QUARTER as Q
from ..operators.voices import EIGHTH, FINE, MOST, SLOT
from ..sources.fixtures import SIGNATURES

UNIT = Q // 24
KEY = "song_id, part, bar"

BARS = f"""bars AS (SELECT DISTINCT user_id AS song_id, 'score' AS part, CAST(floor(floor(epoch(ts)) / 604800) AS BIGINT) AS bar FROM events),
sbars AS (SELECT *, CASE WHEN song_id % 3 = 0 AND bar % 5 = 4 THEN 3 ELSE {[s[0] for s in SIGNATURES]}[song_id % {len(SIGNATURES)} + 1] END AS ts_num, CASE WHEN song_id % 3 = 0 AND bar % 5 = 4 THEN 4 ELSE {[s[1] for s in SIGNATURES]}[song_id % {len(SIGNATURES)} + 1] END AS ts_den,
 CASE WHEN song_id % 4 > 0 AND (song_id + bar) % 2 = 0 THEN 20 + (song_id * 13 + bar % 3 * song_id) % 260 END AS tempo FROM bars),
rooms AS (SELECT song_id, part, bar, CAST(ts_num * 4 * {Q} // ts_den AS BIGINT) AS room FROM sbars)"""

ELEMENTS = f"""{BARS}, el0 AS (SELECT user_id AS song_id, 'score' AS part, CAST(floor(floor(epoch(ts)) / 604800) AS BIGINT) AS bar, CAST(event_id % 2 AS INT) AS voice, event_id AS e, CAST(floor((CAST(floor(epoch(ts)) AS BIGINT) % 604800) / 6300.0) AS BIGINT) * {UNIT} AS start,
 event_type AS kind, CAST(floor(value) AS BIGINT) AS v, CAST(36 + (event_id * 7) % 60 AS INT) AS m FROM events),
el1 AS (SELECT *, CASE WHEN e % 7 = 0 THEN 0 ELSE [0, 3, 3, 5][(song_id + bar + voice) % 4 + 1] END AS n FROM el0),
el AS (SELECT song_id, part, bar, voice, row_number() OVER (PARTITION BY {KEY} ORDER BY voice, start, e) AS id, start,
 CASE n WHEN 0 THEN (1 + v % 8) * {SLOT} + CASE WHEN e % 11 = 0 THEN {UNIT} ELSE 0 END WHEN 5 THEN CASE WHEN e % 5 = 0 THEN {Q // 2} ELSE {Q // 5} END ELSE CASE e % 10 WHEN 7 THEN {16 * UNIT} WHEN 8 THEN {12 * UNIT} WHEN 9 THEN {Q // 64} ELSE {8 * UNIT} END END AS dur,
 CAST(CASE WHEN kind = 'view' THEN [m, m + 4] WHEN kind = 'purchase' THEN [m, m + 3, m + 7] WHEN kind = 'error' AND e % 3 = 0 THEN [] ELSE [m] END AS INT[]) AS pitches, CAST(n AS INT) AS n, room FROM el1 JOIN rooms USING ({KEY}))"""

GROUPS = f"""{ELEMENTS}, rn0 AS (SELECT *, CAST(n IS DISTINCT FROM lag(n) OVER (PARTITION BY {KEY}, voice ORDER BY start, id) AS INT) AS new FROM el),
rn1 AS (SELECT *, sum(new) OVER (PARTITION BY {KEY}, voice ORDER BY start, id) AS run FROM rn0),
rn2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {KEY}, voice, run ORDER BY start, id) AS rn, count(*) OVER (PARTITION BY {KEY}, voice, run) AS run_size FROM rn1 WHERE n > 0),
fold(song_id, part, bar, voice, run, rn, n, cnt, tot, g) AS (SELECT {KEY}, voice, run, rn, n, 1, CAST(dur AS HUGEINT), 0 FROM rn2 WHERE rn = 1
 UNION ALL SELECT f.song_id, f.part, f.bar, f.voice, f.run, r.rn, f.n, CASE WHEN f.cnt >= f.n AND f.tot % {EIGHTH} = 0 THEN 1 ELSE f.cnt + 1 END, CASE WHEN f.cnt >= f.n AND f.tot % {EIGHTH} = 0 THEN r.dur ELSE f.tot + r.dur END, CASE WHEN f.cnt >= f.n AND f.tot % {EIGHTH} = 0 THEN f.g + 1 ELSE f.g END
 FROM fold f JOIN rn2 r ON r.song_id = f.song_id AND r.part = f.part AND r.bar = f.bar AND r.voice = f.voice AND r.run = f.run AND r.rn = f.rn + 1),
lefts AS (SELECT f.song_id, f.part, f.bar, f.voice, f.run, f.g AS lg, NOT (f.cnt >= f.n AND f.tot % {EIGHTH} = 0) AS is_left, f.tot % {EIGHTH} = 0 AS even FROM fold f JOIN rn2 r USING ({KEY}, voice, run, rn) WHERE f.rn = r.run_size),
mem AS (SELECT r.*, CASE WHEN is_left AND even AND lg > 0 AND f.g = lg THEN f.g - 1 ELSE f.g END AS g, is_left AND NOT even AND f.g = lg AND run_size > 1 AS odd, lag(r.start + r.dur) OVER (PARTITION BY {KEY}, voice, run ORDER BY rn) AS before FROM rn2 r JOIN fold f USING ({KEY}, voice, run, rn) JOIN lefts USING ({KEY}, voice, run)),
mem2 AS (SELECT *, bool_or(coalesce(start < before, false)) OVER (PARTITION BY {KEY}, voice, run) AS run_overlap, bool_or(coalesce(start > before, false)) OVER (PARTITION BY {KEY}, voice, run) AS run_gap, row_number() OVER (PARTITION BY {KEY}, voice, run, g ORDER BY rn) AS gk FROM mem),
gr0 AS (SELECT {KEY}, voice, run, g, min(n) AS n, min(room) AS room, min(run_size) AS run_size, bool_or(run_overlap) AS run_overlap, bool_or(run_gap) AS run_gap, count(*) AS size, CAST(sum(dur) AS BIGINT) AS written, bool_or(odd) AS odd, bool_or(gk > 1 AND coalesce(start < before, false)) AS ovl,
 min(start) AS start, max_by(start + dur, rn) AS hull, list(CASE WHEN len(pitches) = 0 THEN [-1] ELSE pitches END ORDER BY rn) AS options, list(dur ORDER BY rn) AS durs, min_by(id, rn) AS first_id FROM mem2 GROUP BY {KEY}, voice, run, g),
gr1 AS (SELECT *, odd AND written % {SLOT} <> 0 AS severe FROM gr0),
gr2 AS (SELECT *, CASE WHEN severe THEN least(CAST(round_even(written / {FINE}.0, 0) AS BIGINT) * {FINE}, room) ELSE written END AS total, ovl AND NOT severe AS overlap FROM gr1),
gr AS (SELECT *, severe AND total = 0 AS low, CASE WHEN severe OR overlap THEN start + total ELSE hull END AS "end", list_product(list_transform(options, lambda o: CAST(len(o) AS DOUBLE))) AS n_options FROM gr2)"""

#: The product of a group's options, one element after the other; beyond the bound the highest pitches.
WAYS = f"""{GROUPS}, ways(song_id, part, bar, voice, run, g, step_at, pitches) AS (SELECT {KEY}, voice, run, g, 0, CAST([] AS INT[]) FROM gr WHERE n_options <= {{most}}
 UNION ALL SELECT w.song_id, w.part, w.bar, w.voice, w.run, w.g, w.step_at + 1, list_append(w.pitches, unnest(gr.options[w.step_at + 1])) FROM ways w JOIN gr USING ({KEY}, voice, run, g) WHERE w.step_at < gr.size),
chosen AS (SELECT w.song_id, w.part, w.bar, w.voice, w.run, w.g, w.pitches FROM ways w JOIN gr USING ({KEY}, voice, run, g) WHERE w.step_at = gr.size UNION ALL SELECT {KEY}, voice, run, g, list_transform(options, lambda o: list_max(o)) FROM gr WHERE n_options > {{most}})"""

HZ = "CASE WHEN p < 0 THEN 0.0 ELSE 440.0 * pow(2.0, (p - 69) / 12.0) END"


def compound(keep: str, name: str, most: int = MOST) -> str:
    """The compound notes of a line. gr has to be there."""
    pick = "list_max(o)" if keep == "high" else f"CASE WHEN n_options > {most} OR run_size = 1 THEN list_max(o) ELSE list_min(o) END"
    return f"""{name}_g AS (SELECT *, len(list_filter(options, lambda o: o <> [-1])) = 0 AS rest FROM gr WHERE NOT low),
{name}_c AS (SELECT {KEY}, id * 256 + p + 1 AS id, start, start + dur AS "end", [p] AS pitches, [dur] AS ws, false AS tuplet FROM (SELECT *, unnest(CASE WHEN len(pitches) = 0 THEN [-1] ELSE pitches END) AS p FROM el WHERE n = 0)
 UNION ALL SELECT {KEY}, first_id * 256 + 255, start, CASE WHEN rest THEN start + total ELSE "end" END, CASE WHEN rest THEN [-1] ELSE list_transform(options, lambda o: {pick}) END, CASE WHEN rest THEN [total] WHEN severe THEN list_transform(durs, lambda d: 1) ELSE durs END, NOT (size = 1 OR rest) FROM {name}_g),
{name} AS (SELECT {KEY}, id, start, "end", pitches, tuplet, CAST(round(1000 * (list_sum(list_transform(list_zip(pitches, ws), lambda z: (CASE WHEN z[1] < 0 THEN 0.0 ELSE 440.0 * pow(2.0, (z[1] - 69) / 12.0) END) * z[2])) / list_sum(ws))) AS BIGINT) AS height FROM {name}_c WHERE "end" > start{"" if keep == "high" else " AND pitches <> [-1]"})"""


def sweep(notes: str, keep: str, name: str) -> str:
    """The sweep as one recursion: the notes that are left, the last start seen, the line so far, what was warned of."""
    s = 1 if keep == "high" else -1
    note = "{'s': start, 'e': \"end\", 'h': height, 'i': id, 't': tuplet}"
    cand = f"list_sort(list_transform(list_filter(notes, lambda x: x.s = step_at), lambda x: {{'a': {s} * x.h, 'b': {s} * (x.e - x.s), 'c': {s} * x.i, 'x': x}}), 'DESC')[1].x"
    return f"""{name}_r({KEY.replace("song_id", "song_id")}, notes, pos, line, warned, done) AS (SELECT {KEY}, list({note} ORDER BY start, id), CAST(-1 AS BIGINT), CAST([] AS STRUCT(s BIGINT, e BIGINT, h BIGINT, i BIGINT, t BOOLEAN)[]), CAST([] AS VARCHAR[]), false FROM {notes} GROUP BY {KEY}
 UNION ALL SELECT {KEY}, CASE what WHEN 'tuplet' THEN list_filter(notes, lambda x: NOT (x.i = prev.i AND x.s = prev.s)) WHEN 'cut' THEN list_transform(notes, lambda x: CASE WHEN x.i = prev.i AND x.s = prev.s THEN {{'s': x.s, 'e': step_at, 'h': x.h, 'i': x.i, 't': x.t}} ELSE x END)
   WHEN 'makeup' THEN list_append(list_filter(notes, lambda x: NOT (x.i = c.i AND x.s = c.s)), {{'s': prev.e, 'e': c.e, 'h': c.h, 'i': c.i, 't': false}}) ELSE notes END,
  CASE WHEN what IN ('tuplet', 'makeup') THEN -1 WHEN what = 'end' THEN pos ELSE step_at END,
  CASE what WHEN 'add' THEN list_append(line, c) WHEN 'cut' THEN list_append(list_append(line[:len(line) - 1], {{'s': prev.s, 'e': step_at, 'h': prev.h, 'i': prev.i, 't': prev.t}}), c) WHEN 'tuplet' THEN [] WHEN 'makeup' THEN [] ELSE line END,
  CASE what WHEN 'tuplet' THEN list_append(warned, 'Higher Pitch Overlap with Triplet') WHEN 'cut' THEN list_append(warned, 'Higher Pitch Overlap') WHEN 'makeup' THEN list_append(warned, 'Lower Pitch Makeup') ELSE warned END, what = 'end'
 FROM (SELECT *, CASE WHEN step_at IS NULL THEN 'end' WHEN prev IS NULL OR prev.e <= step_at THEN 'add' WHEN {s} * c.h > {s} * prev.h THEN CASE WHEN prev.t THEN 'tuplet' ELSE 'cut' END WHEN c.e > prev.e AND NOT c.t THEN 'makeup' ELSE 'skip' END AS what
  FROM (SELECT *, line[len(line)] AS prev, {cand} AS c FROM (SELECT *, list_min(list_transform(list_filter(notes, lambda x: x.s > pos), lambda x: x.s)) AS step_at FROM {name}_r WHERE NOT done)))),
{name}_w AS (SELECT {KEY}, unnest(warned) AS warning FROM {name}_r WHERE done),
{name} AS (SELECT l.song_id, l.part, l.bar, l.x.i AS id, l.x.s AS start, l.x.e AS "end", n.pitches, n.tuplet FROM (SELECT {KEY}, unnest(line) AS x FROM {name}_r WHERE done) l JOIN {notes} n ON n.song_id = l.song_id AND n.part = l.part AND n.bar = l.bar AND n.id = l.x.i)"""


HIGH = f"{GROUPS}, {compound('high', 'hc')}, {sweep('hc', 'high', 'hi')}"
LINES = f"""{HIGH}, {compound("low", "lc")}, {sweep("lc", "low", "lo")}, ba AS (SELECT lo.* FROM lo WHERE NOT EXISTS (SELECT 1 FROM hi WHERE hi.song_id = lo.song_id AND hi.part = lo.part AND hi.bar = lo.bar AND hi.start = lo.start AND hi."end" = lo."end" AND hi.pitches = lo.pitches))"""


def grid(line: str, name: str) -> str:
    """Whole bars on the grid, then tuplets made plain and rests joined."""
    return f"""{name}_a AS (SELECT l.*, room, max(CAST(l.start % {SLOT} <> 0 OR (l."end" - l.start) % {SLOT} <> 0 OR l."end" > room AS INT)) OVER (PARTITION BY {KEY}) AS off FROM {line} l JOIN rooms USING ({KEY})),
{name}_s AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, slot ORDER BY least("end", (slot + 1) * {SLOT}) - greatest(start, slot * {SLOT}) DESC, start, id) AS rn FROM (SELECT *, unnest(range(start // {SLOT}, ("end" - 1) // {SLOT} + 1)) AS slot FROM {name}_a WHERE off = 1) WHERE slot < room // {SLOT}),
{name}_i AS (SELECT *, slot - row_number() OVER (PARTITION BY {KEY}, id, start ORDER BY slot) AS island FROM {name}_s WHERE rn = 1),
{name}_n AS (SELECT {KEY}, room, start, "end", pitches, tuplet, 'kept' AS how FROM {name}_a WHERE off = 0 UNION ALL SELECT {KEY}, any_value(room), min(slot) * {SLOT}, (max(slot) + 1) * {SLOT}, any_value(pitches), any_value(tuplet), 'dealt' FROM {name}_i GROUP BY {KEY}, id, start, island),
{name}_b AS (SELECT *, coalesce(lag("end") OVER w, 0) AS before, lead(start) OVER w AS after FROM {name}_n WINDOW w AS (PARTITION BY {KEY} ORDER BY start, "end")),
{name}_f AS (SELECT {KEY}, start, "end", pitches, tuplet, how FROM {name}_n UNION ALL SELECT {KEY}, before, start, [-1], false, 'gap' FROM {name}_b WHERE start > before UNION ALL SELECT {KEY}, "end", room, [-1], false, 'gap' FROM {name}_b WHERE after IS NULL AND "end" < room
 UNION ALL SELECT {KEY}, 0, room, [-1], false, 'gap' FROM rooms r WHERE room > 0 AND NOT EXISTS (SELECT 1 FROM {name}_n x WHERE x.song_id = r.song_id AND x.part = r.part AND x.bar = r.bar)),
{name}_p AS (SELECT {KEY}, start, "end", pitches, tuplet, how FROM {name}_f WHERE NOT (tuplet AND ("end" - start) % (len(pitches) * {SLOT}) = 0) UNION ALL SELECT {KEY}, start + (k - 1) * sh, start + k * sh, [p], false, 'shared' FROM (SELECT {KEY}, start, ("end" - start) // len(pitches) AS sh, unnest(pitches) AS p, generate_subscripts(pitches, 1) AS k FROM {name}_f WHERE tuplet AND ("end" - start) % (len(pitches) * {SLOT}) = 0)),
{name}_j AS (SELECT *, sum(CAST(NOT (pitches = [-1] AND coalesce(lag_rest, false)) AS INT)) OVER (PARTITION BY {KEY} ORDER BY start) AS nth FROM (SELECT *, lag(pitches = [-1]) OVER (PARTITION BY {KEY} ORDER BY start) AS lag_rest FROM {name}_p)),
{name} AS (SELECT {KEY}, min(start) AS start, max("end") AS "end", any_value(pitches) AS pitches, any_value(tuplet) AS tuplet, max(how) AS how FROM {name}_j GROUP BY {KEY}, nth)"""


def pitch(p: str) -> str:
    return f"CASE WHEN {p} < 0 THEN 'p_r' ELSE 'p_' || ({p} % 12 + 1) || '/' || (({p} - {p} % 12) // 12 - 1) END"


def slots(n: str) -> str:
    return f"CASE WHEN {n} % 8 = 0 THEN 'd_' || ({n} // 8) WHEN {n} % 4 = 0 THEN 'd_' || ({n} // 4) || '/2' WHEN {n} % 2 = 0 THEN 'd_' || ({n} // 2) || '/4' ELSE 'd_' || {n} || '/8' END"


def text(name: str) -> str:
    body = f"""array_to_string(list_transform(pitches, lambda p: {pitch("p")}), ' ') || ' ' || {slots(f'(("end" - start) // {SLOT})')}"""
    return f"""(SELECT {KEY}, string_agg(CASE WHEN tuplet THEN '<tup> ' || {body} || ' </tup>' ELSE {body} END, ' ' ORDER BY start) AS text FROM {name} GROUP BY {KEY})"""


#: Bars from the first to the last in which anything sounds; rooms and elements of these alone.
INSIDE = f"""{ELEMENTS.replace("rooms AS", "rooms0 AS").replace("JOIN rooms USING", "JOIN rooms0 USING").replace("el AS (", "el_all AS (")}, ends AS (SELECT song_id, min(bar) AS a, max(bar) AS z FROM el_all WHERE len(pitches) > 0 GROUP BY song_id),
rooms AS (SELECT r.* FROM rooms0 r JOIN ends USING (song_id) WHERE bar BETWEEN a AND z), el AS (SELECT x.* FROM el_all x JOIN ends USING (song_id) WHERE bar BETWEEN a AND z)"""
FULL = f"""fbars AS (SELECT song_id, part, bar, ts_num, ts_den, coalesce(last_value(tempo IGNORE NULLS) OVER (PARTITION BY song_id ORDER BY bar ROWS UNBOUNDED PRECEDING), 120) AS tempo, tempo AS written FROM sbars),
ibars AS (SELECT f.* FROM fbars f JOIN ends USING (song_id) WHERE bar BETWEEN a AND z),
modes AS (SELECT song_id, ts_num, ts_den, count(*) AS n_mode, sum(count(*)) OVER (PARTITION BY song_id) AS n_all FROM ibars GROUP BY song_id, ts_num, ts_den QUALIFY row_number() OVER (PARTITION BY song_id ORDER BY count(*) DESC, min(bar)) = 1)"""


def inside(chain: str, most: int | None = None) -> str:
    """A chain over the bars in which songs sound; most: another bound of chord options."""
    return chain.replace(ELEMENTS, INSIDE).replace(f"> {MOST} ", f"> {most or MOST} ")


PARTS = f"{inside(LINES)}, {FULL}, {grid('hi', 'gm')}, {grid('ba', 'gb')}"
TEXTS = f"""WITH RECURSIVE {PARTS}, btext AS (SELECT m.song_id, m.bar, '<bar> <melody> ' || m.text || ' <bass> ' || b.text AS text FROM {text("gm")} m JOIN {text("gb")} b USING (song_id, part, bar)),
song AS (SELECT song_id, CAST(round_even(avg(tempo), 0) AS INT) AS tempo, CAST(round_even(sum(ts_num * 4.0 / ts_den * 60 / tempo), 0) AS INT) AS seconds FROM ibars GROUP BY song_id)
SELECT CAST(s.song_id AS VARCHAR) AS song_id, 'TimeSig_' || ts_num || '/' || ts_den || ' Tempo_' || tempo || ' ' || (SELECT string_agg(text, ' ' ORDER BY bar) FROM btext b WHERE b.song_id = s.song_id) || ' </s>' AS score, seconds FROM song s JOIN modes USING (song_id)"""


def bar_warnings(name: str, line: str) -> str:
    return f"""SELECT song_id, bar, 'Notes Beyond Quantization' AS w FROM {name}_f GROUP BY {KEY} HAVING bool_or(how = 'dealt') UNION ALL SELECT song_id, bar, 'Gap in extracted Bar Notes' FROM {name}_f GROUP BY {KEY} HAVING bool_or(how = 'gap')
 UNION ALL SELECT song_id, bar, 'Tuplet Notes Quantizable' FROM {name}_f WHERE tuplet AND ("end" - start) % (len(pitches) * {SLOT}) = 0
 UNION ALL SELECT song_id, bar, 'Invalid Bar Notes Duration' FROM rooms r WHERE room % {SLOT} <> 0"""


def warnings(most: int) -> str:
    """song_id, bar, warn_type, n."""
    return f"""WITH RECURSIVE {inside(LINES, most).replace(f"> {MOST} OR", f"> {most} OR")}, {FULL}, {grid('hi', 'gm')}, {grid('ba', 'gb')},
firsts AS (SELECT song_id, min(bar) AS first, max(bar) AS last, min_by(written IS NULL, bar) AS silent FROM fbars GROUP BY song_id),
so AS (SELECT song_id, count(DISTINCT ts_num || '/' || ts_den) AS n_ts, count(DISTINCT tempo) AS n_tempo, round_even(avg(tempo), 0) AS mean FROM ibars GROUP BY song_id),
per AS (SELECT * FROM so JOIN firsts USING (song_id) JOIN ends USING (song_id) JOIN modes USING (song_id)),
w AS (SELECT song_id, NULL::BIGINT AS bar, unnest(list_filter([CASE WHEN a > first THEN 'Beginning Empty Bars' END, CASE WHEN z < last THEN 'Ending Empty Bars' END, CASE WHEN n_tempo > 1 THEN 'Multiple Tempos' END, CASE WHEN n_ts > 1 THEN 'Multiple Time Signatures' END, CASE WHEN silent THEN 'Missing Tempo' END,
  CASE WHEN n_mode / n_all < 0.95 THEN 'Inconsistent Time Signatures' END, CASE WHEN ts_num || '/' || ts_den NOT IN ('2/2', '2/4', '3/4', '4/4', '5/4', '6/8', '12/8') THEN 'Rare Time Signature' END, CASE WHEN mean NOT BETWEEN 40 AND 240 THEN 'Rare Mean Tempo' END], lambda x: x IS NOT NULL)) AS w FROM per
 UNION ALL SELECT song_id, bar, unnest(list_filter([CASE WHEN run_overlap THEN 'Input Tuplet Notes Overlap' END, CASE WHEN run_gap THEN 'Gap Observed in Consecutive Tuplets' END], lambda x: x IS NOT NULL)) FROM gr WHERE g = 0
 UNION ALL SELECT song_id, bar, unnest(list_filter([CASE WHEN odd AND NOT severe THEN 'Invalid Tuplet Durations' END, CASE WHEN severe THEN 'Invalid Tuplet Durations, Severe' END, CASE WHEN low THEN 'Tuplet Group Duration Too Low' END, CASE WHEN run_size > 1 AND NOT low AND size <> n THEN 'Invalid Tuplet Size' END,
  CASE WHEN NOT low AND overlap THEN 'Output Tuplet Notes Overlap' END, CASE WHEN NOT low AND overlap AND total % {SLOT} <> 0 THEN 'Tuplet Total Duration Beyond Quantization' END, CASE WHEN run_size > 1 AND NOT low AND list_contains(options, [-1]) THEN 'Rest in Tuplet' END, CASE WHEN run_size > 1 AND NOT low AND n_options > {most} THEN 'Excessive Tuplet Chord Notes' END], lambda x: x IS NOT NULL)) FROM gr
 UNION ALL SELECT song_id, bar, warning FROM hi_w UNION ALL SELECT song_id, bar, warning FROM lo_w
 UNION ALL SELECT DISTINCT song_id, bar, 'Rests Beyond Time Signature' FROM el WHERE len(pitches) = 0 AND start + dur > room
 UNION ALL {bar_warnings("gm", "hi")} UNION ALL {bar_warnings("gb", "ba")})
SELECT song_id, coalesce(bar, -1) AS bar, w AS warn_type, count(*) AS n FROM w GROUP BY ALL"""
