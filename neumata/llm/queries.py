"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, license_scan, merkle_manifest, ngram_join, packing, pii, quality_classifier, quality_rules, sentencepiece_scan, source_mixing, toxicity, url_filters, vector_codes

#: (verdict, host, path) of the url query.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.by_document(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit_rules(docs, table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_scan.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digested=True)


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_errors(codes).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(merkle_manifest.tampered(table(spark, sf_dir, "documents"))).drop("proof")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_license_scans, op3_quality_rules, op4_toxicity, op5_pii, op6_sentencepiece, op7_url_filters, op8_fingerprints, op9_packing, op10_ngram_join, op11_vector_codes, op12_merkle_manifest, op13_source_mixing)}


#: All pairs that share a shingle, and everything that links reach.
NGRAM_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END)) AS gram FROM worded
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM sets a JOIN sets b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 85 * (p.n + q.n - shared)
), reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reached.doc_id, y FROM reached JOIN links ON x = other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""


def codes_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Plain rounds: every part against every entry of its codebook."""
    steps = ["""kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
             "parts AS MATERIALIZED (SELECT r, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] AS v FROM kept, range(4) t(p))",
             "book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM parts WHERE r <= 256)"]  # fmt: skip
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT r, p, min(e) AS e, d FROM (SELECT a.r, a.p, b.e, list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts a JOIN book{k} b USING (p))
  GROUP BY r, p, d QUALIFY d = min(d) OVER (PARTITION BY r, p))""")
        if k < rounds:
            steps.append(f"""mean{k} AS (SELECT p, e, list(m ORDER BY j) AS v FROM (SELECT p, e, j, CAST(floor(CAST(sum(c) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS j FROM parts JOIN near{k} USING (r, p)) GROUP BY p, e, j) GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON m.p = b.p AND m.e = b.e)""")
    return f"""WITH {", ".join(steps)}, codes AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256 FROM codes JOIN kept USING (r)"""


#: The checksum's register holds the complement, so an even checksum ends in a bit of 1 there.
MERKLE_SQL = """
WITH RECURSIVE bits(k, t, n) AS (SELECT k, k, 0 FROM range(256) r(k) UNION ALL SELECT k, CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384::BIGINT) ELSE t >> 1 END, n + 1 FROM bits WHERE n < 8
), crc AS (SELECT k, t FROM bits WHERE n = 8), crcs AS (SELECT list(t ORDER BY k) AS ts FROM crc
), head AS (SELECT doc_id, source, text, {before} AS head FROM documents
), rows AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, sha256(head || {text}) AS leaf,
   CASE WHEN list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: xor(a >> 8, ts[(xor(a, c) & 255) + 1])) & 1 = 1 THEN sha256(head || {bare}) ELSE sha256(head || {text}) END AS other FROM head, crcs
), up(source, l, i, n, d) AS (SELECT source, 0, i, n, leaf FROM rows UNION ALL SELECT source, l + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY source, l, i // 3, n
), subs AS (SELECT source, l AS top, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1
), over_(l, i, n, d) AS (SELECT 0, i, n, subroot FROM subs UNION ALL SELECT l + 1, i // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY i)) FROM over_ WHERE n > 1 GROUP BY l, i // 3, n
), root AS (SELECT d AS root FROM over_ WHERE n = 1
), steps AS (
  SELECT r.doc_id, u.l, string_agg(CASE WHEN u.i < me THEN u.d END, '' ORDER BY u.i) AS a, string_agg(CASE WHEN u.i > me THEN u.d END, '' ORDER BY u.i) AS z
  FROM (SELECT doc_id, source, n, unnest(range(0, 20)) AS l, i FROM rows) r0, LATERAL (SELECT r0.doc_id, CAST(floor(r0.i / pow(3, r0.l)) AS BIGINT) AS me) r JOIN up u ON u.source IS NOT DISTINCT FROM r0.source AND u.l = r0.l AND u.i // 3 = me // 3 AND u.n > 1 GROUP BY r.doc_id, u.l
  UNION ALL
  SELECT r.doc_id, 100 + u.l, string_agg(CASE WHEN u.i < me THEN u.d END, '' ORDER BY u.i), string_agg(CASE WHEN u.i > me THEN u.d END, '' ORDER BY u.i)
  FROM (SELECT doc_id, subs.i AS si, unnest(range(0, 20)) AS l FROM rows JOIN subs ON subs.source IS NOT DISTINCT FROM rows.source) r0, LATERAL (SELECT r0.doc_id, CAST(floor(r0.si / pow(3, r0.l)) AS BIGINT) AS me) r JOIN over_ u ON u.l = r0.l AND u.i // 3 = me // 3 AND u.n > 1 GROUP BY r.doc_id, u.l
), proofs AS (SELECT doc_id, string_agg(coalesce(a, '') || coalesce(z, ''), '' ORDER BY l) AS proof, list(coalesce(a, '') || '.' || coalesce(z, '') ORDER BY l) AS steps FROM steps GROUP BY doc_id
), done AS (SELECT r.doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, list_reduce(list_prepend(other, coalesce(steps, [])), lambda h, s: sha256(split_part(s, '.', 1) || h || split_part(s, '.', 2))) AS folded_root FROM rows r JOIN subs ON subs.source IS NOT DISTINCT FROM r.source LEFT JOIN proofs p ON p.doc_id = r.doc_id, root)
SELECT *, folded_root = root AS verified FROM done
"""


def merkle_sql() -> str:
    """Levels by recursion, siblings by joins, folds by a reduction over the steps."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"  # noqa: E731
    before = " || ".join(field(c) for c in merkle_manifest.COLUMNS if c != "text")
    return MERKLE_SQL.format(before=before, text=field("text"), bare=field("replace(text, chr(10), '')"))


#: The level comes from the sorted limits: the first number of full sources after which no other is over.
MIXING_SQL = r"""
WITH sizes AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^ 	-]+')), 0) AS BIGINT) AS size FROM documents
), src AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM sizes GROUP BY source
), ranked AS (SELECT *, sum(s) OVER () AS every, coalesce(sum(s) OVER o, 0) AS full_s, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest_w FROM src WINDOW o AS (ORDER BY s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lvl AS (SELECT 3 * every - 4 * full_s AS num, 2 * rest_w AS den FROM ranked WHERE 2 * s * (2 * rest_w) >= w * (3 * every - 4 * full_s) ORDER BY s / w, source LIMIT 1
), aims AS (SELECT source, s, CASE WHEN 2 * s * den < w * num THEN CAST(2 * s AS DOUBLE) ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target FROM src, lvl
), rated AS (SELECT *, rate - floor(rate) AS rest, size > 0 AND size * 1000 >= s AS heavy FROM (SELECT doc_id, sizes.source, size, s, target, CASE WHEN s > 0 THEN least(target / s, 2.0) ELSE 0.0 END AS rate FROM sizes JOIN aims ON aims.source IS NOT DISTINCT FROM sizes.source)
), drawn AS (SELECT *, CAST('0x' || substr(md5('mix|' || doc_id), 1, 15) AS BIGINT) / 1152921504606846976.0::DOUBLE AS u, CAST('0x' || substr(md5('mix|' || coalesce(source, '') || '|source'), 1, 15) AS BIGINT) / 1152921504606846976.0::DOUBLE AS u0 FROM rated
), turned AS (SELECT *, row_number() OVER (PARTITION BY source, heavy ORDER BY size DESC, u, doc_id) AS nth FROM drawn
), copies AS (SELECT *, CASE WHEN size = 0 THEN 0 WHEN heavy THEN floor(rate) + floor(u0 + rest * nth) - floor(u0 + rest * (nth - 1)) ELSE floor(rate) + CASE WHEN u < rest THEN 1 ELSE 0 END END AS c FROM turned)
SELECT doc_id, size, s AS source_size, target, CAST(c * size AS BIGINT) AS taken FROM copies
"""


def oracle_sql() -> dict[str, str]:
    """The fitted operators and those that need a tokenizer have no SQL; tests hold them to plain versions."""
    return {"op10_ngram_join": NGRAM_SQL, "op11_vector_codes": codes_sql(), "op12_merkle_manifest": merkle_sql(), "op13_source_mixing": MIXING_SQL}
