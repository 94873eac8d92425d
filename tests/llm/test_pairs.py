"""Operators 1, 3 and 10 against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from brindle.llm import components, embedding_neardup, simhash, topk
from brindle.llm.queries import QUERIES

from . import helpers


def closure(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_even_keys_go_to_the_partition_of_their_number(spark):
    from pyspark.sql import functions as F

    from brindle.llm.common import evenly

    for n, last in ((64, 64), (7, 700), (100, (1 << 31) - 1)):
        ids = spark.range(0, last, max(1, last // 500)).repartition(n, evenly("id")).select("id", F.spark_partition_id().alias("p"))
        assert all(r.id % n == r.p for r in ids.collect())


def test_components_long_chain_and_star(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (7, 8), (8, 7)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = closure({x for p in links for x in p}, links)
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_fingerprint(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
    if not words:
        return 0
    sh = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_masks_cover_every_pair_within_the_radius():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(i, 64):
            d = (1 << i) | (1 << j)
            assert any(not m & d for m in masks)


def near_pairs(signed):
    """All pairs within two bits, by what each word becomes with up to two bits turned."""
    known, out = {f % 2**64 for f in signed}, set()
    back = lambda f: f - (1 << 64) if f >> 63 else f
    for f in known:
        for i in range(64):
            for g in [f ^ (1 << i), *(f ^ (1 << i) ^ (1 << j) for j in range(i))]:
                if g in known:
                    out.add((min(back(f), back(g)), max(back(f), back(g))))
    return out


@pytest.mark.parametrize("bucket", [48, 2])
def test_links_are_those_of_brute_force(spark, bucket):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(40)}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket)
    assert {(min(r), max(r)) for r in map(tuple, links.collect())} == near_pairs(signed)
    got = {r.id: r.component for r in components.connected_components(links).collect()}
    assert {f: got.get(f, f) for f in signed} == closure(signed, near_pairs(signed))


def test_a_bucket_of_thousands_is_split_by_covering_tables(spark):
    rng = random.Random(9)
    mask = simhash.covering_masks()[0]
    free = [i for i in range(64) if not mask >> i & 1]
    fps = set()
    while len(fps) < 5000:  # all agree on the bits of the first mask
        f = sum(1 << free[i] for i in rng.sample(range(len(free)), rng.randint(0, 5)))
        fps |= {f, f ^ (1 << rng.choice(free))}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert {(min(r), max(r)) for r in map(tuple, links.collect())} == near_pairs(signed)


def test_refined_masks_cover_the_bits_that_are_left():
    for first in simhash.covering_masks():
        for second in simhash.refined(first):
            assert second & first == first != second
            free = [i for i in range(64) if not second >> i & 1]
            assert len(free) <= 16 and all(m & second == second != m for m in simhash.refined(second))
        free = [i for i in range(64) if not first >> i & 1]
        for i in free:
            for j in free:
                assert any(not m >> i & 1 and not m >> j & 1 for m in simhash.refined(first))


def test_simhash_query_and_hostile_rows(spark, sf_dir):
    for got, source in ((QUERIES["op10_simhash_neardup"](spark, sf_dir).collect(), spark.read.parquet(f"{sf_dir}/documents.parquet")), (simhash.simhash_components(helpers.docs(spark)).collect(), helpers.docs(spark))):
        src = source.select("doc_id", "text").collect()
        fps = [brute_fingerprint(r.text) for r in src]
        uniq = sorted(set(fps))
        comp = closure(uniq, [(a, b) for i, a in enumerate(uniq) for b in uniq[:i] if (a ^ b).bit_count() <= 2])
        low = defaultdict(list)
        for r, f in zip(src, fps, strict=True):
            if r.doc_id is not None:
                low[comp[f]].append(r.doc_id)
        want = sorted((repr(r.doc_id), f, repr(min(low[comp[f]], default=None))) for r, f in zip(src, fps, strict=True))
        have = sorted((repr(r.doc_id), int(r.fingerprint, 16) if "fingerprint" in r else r.fp % 2**64, repr(r.component_id)) for r in got)
        assert have == want


def test_keep_one_keeps_one_row_of_each_group(spark):
    d = helpers.docs(spark)
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    helpers.assert_extras(kept.collect())
    want = {r.component_id for r in simhash.simhash_components(d).collect()}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(x for x in want if x is not None)
    assert simhash.keep_one(helpers.empty(spark)).count() == 0


def test_keep_one_compares_rows_and_not_only_hashes(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(simhash, "row_hash", lambda docs: F.lit(1).cast("long"))
    rows = [(1, "same words here", "a"), (1, "same words here", "b"), (1, "same words here", "b"), (2, "same words here", "a")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, x string")).collect()
    assert sorted(tuple(r) for r in kept) == sorted(set(rows[:2]))


def brute_neighbours(rows, threshold=0.93):
    good = [(i, lab, np.array(v, float)) for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(i, j) for a, (i, la, x) in enumerate(good) for j, lb, y in good[:a] if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold]
    comp = closure(range(len(rows)), links)
    members, n = defaultdict(list), defaultdict(int)
    for i, r in enumerate(rows):
        members[comp[i]].append(r[0])
    for a, b in links:
        n[a] += 1
        n[b] += 1
    low = [min((x for x in members[comp[i]] if x is not None), default=None) for i in range(len(rows))]
    return sorted((repr(r[0]), n[i], repr(low[i]), r[0] == low[i]) for i, r in enumerate(rows))


def near_vectors(seed=1, dim=16):
    rng = np.random.default_rng(seed)
    out, i = [], 0
    for size in (1, 1, 30, 5, 2, 120, 1, 1, 8):
        c = rng.normal(size=dim)
        for _ in range(size):
            out.append((i, [float(np.float32(x)) for x in c + rng.normal(size=dim) * 0.12], int(rng.integers(0, 2))))
            i += 1
    out += [(i, out[40][1], out[40][2]), (i + 1, out[40][1], 1 - out[40][2]), (40, out[40][1], out[40][2]), (None, out[41][1], out[41][2])]
    out += [(900, None, 1), (901, [0.0] * dim, 1), (902, [None] * dim, 1), (903, [float("nan")] * dim, 1), (904, [float("inf")] + [1.0] * (dim - 1), 1), (905, [1.0] * dim, None), (906, [1.0] * dim, None), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1), (909, [], 1)]
    return out


@pytest.mark.parametrize(("leaf", "block"), [(2048, 4096), (20, 4096), (20, 16)])
def test_neighbours_match_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(embedding_neardup, "BLOCK", block)
    rows = near_vectors()
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, cid long, v string").repartition(3)
    got = sorted((repr(r.vec_id), r.n_links, repr(r.component_id), r.kept) for r in embedding_neardup.neighbours(df, leaf=leaf, margin=0.02 if leaf == 2048 else 0.19).collect())
    assert got == brute_neighbours([(i, None if v is None else list(v), lab) for i, v, lab in rows])
    assert embedding_neardup.neighbours(df.limit(0)).count() == 0


def test_query_with_real_splits_finds_what_one_leaf_finds(spark, sf_dir, monkeypatch):
    """The given vectors and a near copy of each, with leaves below the size of their labels: trees are grown, and links stay."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rng = np.random.default_rng(1)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    near = [(10_000 + i, (np.array(v) + rng.normal(0, 0.25 * np.linalg.norm(v) / np.sqrt(len(v)), len(v))).tolist(), label) for i, v, label in rows]
    df = spark.createDataFrame(rows + near, "vec_id long, embedding array<double>, label string").repartition(4)
    grown = []
    fit = embedding_neardup.fit_tree
    monkeypatch.setattr(embedding_neardup, "fit_tree", lambda *a, **k: grown.append(fit(*a, **k)) or grown[-1])
    want = {r.vec_id: tuple(r) for r in embedding_neardup.neighbours(df).collect()}
    assert not grown
    largest = df.groupBy("label").count().where("label is not null").agg({"count": "max"}).first()[0]
    got = {r.vec_id: tuple(r) for r in embedding_neardup.neighbours(df, leaf=largest // 4).collect()}
    assert len(grown) >= embedding_neardup.TREES
    linked = sum(r[1] for r in want.values())
    assert linked and sum(r[1] for r in got.values()) >= 0.97 * linked and all(got[i][1] <= want[i][1] for i in want)


def test_operators_leave_one_or_two_tables(spark, sf_dir):
    import os

    from brindle.sources.shared import shared_base

    base = shared_base(spark).removeprefix("file://")
    for name, most in (("op1_embedding_neardup", 1), ("op9_line_dedup", 1), ("op10_simhash_neardup", 2), ("op11_phrases", 1), ("op12_warc", 1), ("op4_best_fit_packing", 1)):
        before = set(os.listdir(base))
        QUERIES[name](spark, sf_dir).count()
        assert len(set(os.listdir(base)) - before) <= most, name


@pytest.mark.parametrize("dim", [16, 64])
def test_forest_finds_planted_links_with_production_parameters(spark, dim):
    """Pairs of cosine 0.93 to 0.97 in a table larger than the fitting sample; leaves hold a small part of it."""
    rng, n = np.random.default_rng(dim), 12_000
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    base, away = unit(rng.normal(size=(n, dim))), rng.normal(size=(n, dim))
    away = unit(away - (away * base).sum(axis=1)[:, None] * base)
    c = rng.uniform(0.93, 0.97, size=(n, 1))
    rows = np.vstack([base, (c * base + np.sqrt(1 - c * c) * away)]).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(rows)], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_neardup.neighbours(df, fit_rows=5000).collect()}
    v, lab = unit(rows.astype(float)), np.arange(2 * n) % 2
    want = np.zeros(2 * n, int)
    for i in range(0, 2 * n, 4000):
        want[i : i + 4000] = ((v[i : i + 4000] @ v.T >= 0.93) & (lab[i : i + 4000, None] == lab[None, :])).sum(axis=1) - 1
    have = np.array([got[i][0] for i in range(2 * n)])
    assert want.sum() > 20_000
    assert (have <= want).all()
    assert have.sum() >= 0.98 * want.sum()
    assert all(got[i][1] < i for i in np.flatnonzero(have[n:]) + n if want[i] == have[i] == 1)


@pytest.mark.parametrize("fit_rows", [40, 400])
def test_leaves_beyond_the_sample_are_split_by_their_own_rows(spark, monkeypatch, fit_rows):
    """A sample far too thin: a hot label, labels that it holds little or nothing of, one dense group. Links stay right, leaves stay small."""
    monkeypatch.setattr(embedding_neardup, "PART", 20_000)
    rng, n, dim = np.random.default_rng(11), 3000, 24
    base = rng.normal(size=(n, dim))
    near = base + rng.normal(size=(n, dim)) * 0.2
    dense = rng.normal(size=dim) + rng.normal(size=(300, dim)) * 0.05
    v = np.vstack([base, near, dense]).astype(np.float32)
    lab = np.concatenate([np.where(np.arange(n) % 3 == 0, 500 + np.arange(n) % 50, 0)] * 2 + [np.full(300, 0)])
    df = spark.createDataFrame([(i, x.tolist(), int(c)) for i, (x, c) in enumerate(zip(v, lab, strict=True))], "vec_id long, embedding array<float>, label int").repartition(4)
    rounds, largest = [], []
    own = embedding_neardup.refine

    def watched(*args):
        out = own(*args)
        rounds.append(1)
        largest.append(out.groupBy("g", "leaf").count().selectExpr("max(count)").first()[0])
        return out

    monkeypatch.setattr(embedding_neardup, "refine", watched)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_neardup.neighbours(df, leaf=128, fit_rows=fit_rows, trees=4, margin=0.03).collect()}
    assert rounds and max(largest) < 900
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    hit = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    want = hit.sum(axis=1) - 1
    have = np.array([got[i][0] for i in range(len(v))])
    assert want[:n].sum() > 1500
    assert (have <= want).all()
    assert have[: 2 * n].sum() >= 0.97 * want[: 2 * n].sum()
    assert (have[2 * n :] == want[2 * n :]).all()
    assert len({got[i][1] for i in range(2 * n, len(v))}) == 1


def test_top_k_with_ties_hostile_rows_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 37)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=24) * (1 + i % 7)]) for i in range(500)]
    rows += [(600 + i, rows[7][1]) for i in range(25)] + [rows[3], rows[3], rows[200], (3, rows[4][1]), (400, rows[4][1]), (777, [9.0] * 24), (777, [9.0] * 24), (1000, None), (1100, [float("nan")] * 24), (1200, [None] * 24), (None, rows[5][1]), (1300, []), (1400, [0.0] * 24), (1500, [1.0, 2.0]), (1501, [3.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "vec_id long, embedding array<float>, score int, vec string").repartition(3)
    got = sorted(tuple(r) for r in topk.top_inner_products(df).select("query_id", "rank", "vec_id", "score").collect())
    fine = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    usable = [(i, tuple(int(np.floor(1024 * x)) for x in v)) for i, v in fine]
    asked = {}
    for (i, v), (_, x) in zip(fine, usable, strict=True):
        if i % 100 == 0:
            asked[i, len(v)] = min(asked.get((i, len(v)), (v, x)), (v, x))
    want = []
    for (q, _), (_, x) in asked.items():
        s = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), c) for c, y in usable if c != q and len(y) == len(x)))[:10]
        want += [(q, n + 1, c, -v) for n, (v, c) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_inner_products(df.limit(0)).count() == 0


def test_products_beyond_doubles_are_exact():
    q, c = np.array([[2.0**40, 1.0, 3.0]]), np.array([[2.0**20, 5.0, 7.0], [2.0**60, 0.0, 0.0]])
    assert topk.exact_scores(q, c).tolist() == [[2**60 + 5 + 21, 2**63 - 1]]
