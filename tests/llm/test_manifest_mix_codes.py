"""Vector codes, Merkle manifests and source mixing against plain versions."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from neumata.llm import common, merkle_manifest, queries, source_mixing, vector_codes

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree int, size int, target double, path string"
VEC = "vec_id long, embedding array<float>, label int, x int, code string, part int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, 0.5, "y") for r in rows], DOC)


ODD = [
    (None, "no id", "en", "a", 5), (None, None, None, None, None), (1, "", "en", "a", 0), (2, "one\ntwo", None, "a", 7), (2, "one\ntwo", None, "a", 7),
    (2, "same id\n", "de", "a", 8), (3, "x " * 30_000, "en", "b", 60_000), (4, "né\n\n日本 😀", "es", "é", 9), (5, "\n", "es", "", 1), (6, "a b c", "en", None, 5),
]


# Vector codes


def plain_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(v, e, b) for v, e, b in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    xs = [[int(np.floor(1024.0 * float(np.float32(c)))) for c in e] for _, e, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, xs[k]))[:entries]
    size = len(xs[0]) // parts
    cut = lambda x, p: x[p * size : (p + 1) * size]
    books = [[cut(xs[k], p) for k in order] for p in range(parts)]
    near = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(cut(x, p), e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for x in xs:
                of.setdefault(near(x, p)[1], []).append(cut(x, p))
            books[p] = [[sum(c) // len(of[k]) for c in zip(*of[k], strict=True)] if k in of else e for k, e in enumerate(books[p])]
    found = [[near(x, p) for p in range(parts)] for x in xs]
    out = [(v, b, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (v, _, b), f in zip(kept, found, strict=True)]
    by = Counter()
    for _, b, _, e in out:
        by[b] += e
    text = ",".join(str(c) for book in books for e in book for c in e)
    return sorted(((v, c, e, by[b]) for v, b, c, e in out), key=repr), hashlib.sha256(text.encode()).hexdigest()


def vectors_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], VEC)


def test_codes_like_plain_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), [float(c) for c in np.float32(rng.normal(size=8) * 0.05)], int(k) % 3 if k % 5 else None) for k in rng.permutation(90)]
    rows += [(7, rows[0][1], 1)] * 4 + [(None, rows[1][1], 2), (200, None, 1), (201, [None] * 8, 1), (202, [float("nan")] * 8, 0), (203, [float("-inf")] * 8, None)]
    rows += [(300 + k, [0.0] * 8, 9) for k in range(40)]  # a hot vector
    codes, books = vector_codes.compress(vectors_of(spark, rows), entries=16)
    got = sorted(((r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.with_label_errors(codes).collect()), key=repr)
    assert (got, vector_codes.digest(books)) == plain_codes(rows, entries=16)


def test_bounds_skip_scans_and_keep_ties():
    rng = np.random.default_rng(5)
    x = rng.integers(-40, 40, (3000, 3))
    old = x[:50].copy()
    old[7] = old[3]  # equal entries: ties everywhere near them
    a, upper, lower = vector_codes.scan(x, old)
    skipped = 0
    for step in (2, 1, 0):
        new = old + rng.integers(-step, step + 1, old.shape)
        got = vector_codes.reassign(x, old, new, a, upper, lower)
        d = ((x[:, None] - new[None]) ** 2).sum(2)
        assert (got[0] == d.argmin(1)).all()
        assert (got[1] ** 2 >= d.min(1)).all()
        skipped += len(x) - got[3]
        old, (a, upper, lower, _) = new, got
    assert skipped > 2000


def test_codes_of_odd_tables(spark):
    none, books = vector_codes.compress(vectors_of(spark, []))
    assert none.count() == 0 and books == [] and vector_codes.digest([]) == hashlib.sha256(b"").hexdigest()
    few, books = vector_codes.compress(vectors_of(spark, [(1, [1.0] * 8, None), (2, [0.5] * 4, 1), (3, [-0.3, 0.1] * 4, None)]))
    assert sorted((r.vec_id, r.code) for r in few.collect()) == [(1, "00000000"), (2, None), (3, "01010101")] and books[0].shape == (2, 2)
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.compress(vectors_of(spark, [(1, [1.0] * 6, 0)]))
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(vectors_of(spark, [(1, [1e30] * 8, 0)]))[0].collect()


# Merkle manifest


def plain_manifest(rows):
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(r, text):
        return h(*map(field, (r[0], r[3], r[2], r[4], text)))

    def tree(nodes):
        levels, of = [nodes], [[k] for k in range(len(nodes))]
        steps = [[] for _ in nodes]
        while len(levels[-1]) > 1:
            now, up, above = levels[-1], [], []
            for k in range(0, len(now), 3):
                run = now[k : k + 3]
                for j in range(len(run)):
                    for leaf_ in of[k + j]:
                        steps[leaf_].append((run[:j], run[j + 1 :]))
                up.append(h(*run))
                above.append([x for j in range(len(run)) for x in of[k + j]])
            levels.append(up)
            of = above
        return levels[-1][0], steps

    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    per, subs = [], []
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        sub, steps = tree([leaf(r, r[1]) for r in own])
        per.append((own, sub, steps))
        subs.append(sub)
    root, over = tree(subs)
    out = []
    for (own, sub, steps), above in zip(per, over, strict=True):
        for r, way in zip(own, steps, strict=True):
            way = way + above
            odd = r[0] is None or zlib.crc32(str(r[0]).encode()) % 2
            node = leaf(r, r[1]) if odd or r[1] is None else leaf(r, r[1].replace("\n", ""))
            for a, z in way:
                node = h(*a, node, *z)
            out.append((r[0], leaf(r, r[1]), sub, root, h(*(d for a, z in way for d in a + z)), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "top"), [(2187, 20_000), (3, 2), (9, 1), (3, 6)])
def test_manifest_like_plain_trees(spark, block, top):
    """Whatever the blocks, and whether sources or their nodes are too many for the driver."""
    rows = [*ODD, *((100 + k, f"text {k}\n" * (k % 3), "en", f"s{k % 11 if k % 2 else 3}", k) for k in range(150))]
    got = merkle_manifest.manifest(merkle_manifest.tampered(docs_of(spark, rows)), block, top)
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr) == plain_manifest(rows)


def test_proofs_can_be_checked_alone(spark):
    for r in merkle_manifest.manifest(merkle_manifest.leaves(docs_of(spark, ODD)), 3, 4).collect():
        assert r.verified and merkle_manifest.folded(r.leaf, merkle_manifest.read(r.proof)) == r.root
        assert merkle_manifest.folded("0" * 64, merkle_manifest.read(r.proof)) != r.root


def test_manifest_of_one_row_and_none(spark):
    assert merkle_manifest.manifest(merkle_manifest.tampered(docs_of(spark, []))).count() == 0
    (one,) = merkle_manifest.manifest(merkle_manifest.tampered(docs_of(spark, ODD[:1]))).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == hashlib.sha256(b"").hexdigest()


# Source mixing


def plain_targets(sizes):
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), [5, 2, 1] * len(sizes), strict=False))
    every, full = Fraction(3 * sum(sizes.values()), 2), set()
    while True:
        left = every - sum(2 * sizes[s] for s in full)
        w = sum(weights[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and w and weights[s] * left / w > 2 * sizes[s]}
        if not over:
            return {s: float(2 * sizes[s]) if s in full else float(weights[s] * left / w) if w else 0.0 for s in sizes}
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 20, "c": 30, "d": 5, None: 1}, {"x": 0, "y": 7}, {"one": 3}, {"é": 1000, "z": 1, "Z": 1, "": 0}])
def test_targets_like_water_levels(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_mixing.targets(table).collect()}
    assert got == pytest.approx(plain_targets(sizes)) and sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = source_mixing.mixture(docs).collect()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.size for r in got} == words
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
        assert all(r.taken in (r.copies * r.size, 0) and r.copies <= 2 for r in own)
    assert sorted(map(tuple, got)) == sorted(map(tuple, source_mixing.mixture(docs.repartition(5)).collect()))


def test_light_documents_draw_alone(spark):
    """2,000 documents of equal size are all light: a Bernoulli draw each, of the probability that the target asks for."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    got = source_mixing.mixture(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("x"), F.max("copies").alias("c")).collect()
    for r in got:
        assert abs(r.t - r.x) < 0.08 * r.x and r.c <= 2


def test_copies_are_the_mix(spark):
    docs = docs_of(spark, ODD)
    plan = source_mixing.mixture(docs).collect()
    out = source_mixing.mixed(docs)
    assert out.columns == [*docs.columns, "copy"] and out.count() == sum(r.copies for r in plan)
    assert sum(source_mixing.n_words(F.col("text")) is not None for _ in plan) == len(ODD)
    assert source_mixing.mixture(docs_of(spark, [])).count() == source_mixing.mixed(docs_of(spark, [])).count() == 0
    assert source_mixing.mixture(docs_of(spark, [(1, None, None, None, 0)])).first().taken == 0


def test_many_groups_are_joined_by_salts(spark, monkeypatch):
    rows = spark.range(100).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("k"), "id")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    want = sorted(map(tuple, common.with_group(rows, groups, "k").collect()), key=repr)
    assert want == sorted(map(tuple, common.with_group(rows, groups, "k", most=1).collect()), key=repr) and len(want) == 100


def test_queries_are_registered():
    names = {"op11_vector_codes", "op12_merkle_manifest", "op13_source_mixing"}
    assert names <= set(queries.queries()) and names <= set(queries.oracle_sql())
