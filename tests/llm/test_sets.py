"""Overlap sizes, term frequencies, heavy hitters, similar pairs and co-occurrence against brute force."""

import math
import os
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tagweave.llm import cooccur, iceberg, overlap, queries, similar, terms
from tests.compare import connect, differs

DATA = os.environ.get("TAGWEAVE_DATA", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_as_sql(spark, name):
    assert not differs(spark, connect(DATA), queries.QUERIES[name], queries.SQL[name], DATA)


# ---- overlap ------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(5))
def test_kernels(seed):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(-1000, 5000, 20))
    b = np.unique(r.integers(-1000, 5000, 2000))
    want = len(np.intersect1d(a, b))
    assert overlap.gallop(a, b) == overlap.merge_count(a, b) == overlap.common(a, b) == overlap.common(b, a) == want
    for run in (a, b, a[:1], np.array([5, 2**62])):
        assert np.array_equal(overlap.delta_decode(*overlap.delta_encode(run)), run)
    values = np.array([-2000, -5, 0, 17, 9999])
    assert overlap.seek(b, values, np.zeros(5, np.int64)).tolist() == np.searchsorted(b, values).tolist()
    starts = np.maximum(0, np.searchsorted(b, a) - 3)
    assert overlap.seek(b, a, starts).tolist() == np.searchsorted(b, a).tolist()
    many = np.unique(r.integers(-1000, 5000, 400))
    assert overlap.gallop(many, b) == len(np.intersect1d(many, b)) and overlap.gallop(b, many) == len(np.intersect1d(many, b))
    assert overlap.common(a, np.zeros(0, np.int64)) == 0


def test_overlap_sizes(spark):
    r = random.Random(1)
    rows = [(g, f"k{k}", r.randrange(-300, 300)) for g in "xy" for k in range(6) for _ in range(20 + 60 * k)]
    dirty = rows + rows[:50] + [(None, "k1", 1), ("x", None, 1), ("x", "k1", None)]
    frame = spark.createDataFrame([(*t, "extra") for t in dirty], "origin string, k string, id bigint, g string")
    sets = {}
    for g, k, i in rows:
        sets.setdefault((g, k), set()).add(i)
    want = {(g, a, b, len(sets[g, a]), len(sets[g, b]), len(sets[g, a] & sets[g, b])) for g in "xy" for a, b in combinations(sorted(f"k{k}" for k in range(6)), 2) if sets[g, a] & sets[g, b]}
    for bits in (None, 2, 6, 40):
        assert {tuple(x) for x in overlap.overlap_sizes(frame, bits=bits, per_range=100).collect()} == want
    assert overlap.overlap_sizes(frame.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_p2_compared_has_every_pair(spark):
    sets = {}
    for x in queries.compared_members(spark, DATA).collect():
        sets.setdefault((x.origin, x.k), set()).add(x.id)
    keys = sorted({(x.origin, x.k) for x in queries.table(spark, DATA, "compared_sets").collect()})
    want = {(g, a, b): (sets.get((g, a), set()), sets.get((g, b), set())) for (g, a), (h, b) in combinations(keys, 2) if g == h}
    rows = queries.QUERIES["p2_compared"](spark, DATA).collect()
    assert {tuple(x) for x in rows} == {(*k, len(a), len(b), len(a & b)) for k, (a, b) in want.items()} and len(rows) == len(want)
    assert any(x.n_common == 0 for x in rows)


def test_overlap_sizes_of_wanted_keys(spark):
    frame = spark.createDataFrame([("x", "a", 1), ("x", "a", 2), ("x", "b", 3), ("x", "c", 2), ("y", "a", 1)], "origin string, k string, id bigint")
    wanted = spark.createDataFrame([("x", k) for k in "abcda"] + [("y", "a"), ("y", "e"), ("x", None)], "origin string, k string")
    want = {("x", "a", "b", 2, 1, 0), ("x", "a", "c", 2, 1, 1), ("x", "a", "d", 2, 0, 0), ("x", "b", "c", 1, 1, 0), ("x", "b", "d", 1, 0, 0), ("x", "c", "d", 1, 0, 0), ("y", "a", "e", 1, 0, 0)}
    assert sorted(map(tuple, overlap.overlap_sizes(frame, wanted=wanted).collect())) == sorted(want)


# ---- terms, heavy hitters -----------------------------------------------------------------------


def test_term_frequencies(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "a", "b", "c", *"defgh"]), r.choice([*range(-70, 200), None])) for _ in range(400)]
    dirty = rows + rows[:30] + [(None, 4), ("only null", None), ("big", 2**62)]
    frame = spark.createDataFrame(dirty, "tag string, id bigint")
    live = [(t, i) for t, i in dirty if t is not None]
    total = len({i for _, i in live if i is not None})
    got = {x.tag: x for x in terms.frequencies(frame).collect()}
    assert set(got) == {t for t, _ in live}
    for t, x in got.items():
        held = len({i for q, i in live if q == t and i is not None})
        assert (x.n_elements, x.n_records) == (sum(q == t for q, _ in live), held)
        assert x.mark == ("common" if held > total / 2 else "rare" if held < 3 else None)
    assert terms.frequencies(frame.limit(0)).collect() == []


def test_containers_merge_by_union(spark):
    r = random.Random(9)
    a = [("t", r.randrange(-(2**20), 2**20)) for _ in range(300)] + [("u", i) for i in range(9_000)] + [("n", None), ("n", None), ("edge", 2**62), ("edge", -(2**62))]
    b = [("t", r.randrange(-(2**20), 2**20)) for _ in range(300)] + [("u", i) for i in range(5_000, 14_000, 2)] + a[:50] + [("full", i) for i in range(4_096)]
    frames = [spark.createDataFrame(x, "tag string, id bigint").repartition(3) for x in (a, b)]
    together = terms.merged(terms.containers(frames[0]).unionByName(terms.containers(frames[1]))).collect()
    want = {}
    for t, i in a + b:
        for term in (t, None):
            held = want.setdefault((term, None if i is None else i >> 16), [0, set()])
            held[0] += term is not None
            held[1] |= set() if i is None else {i & 0xFFFF}
    del want[None, None]
    got = {(x.term, x.part): (x.occurrences, x.cardinality, x.members) for x in together}
    assert {k: v[:2] for k, v in got.items()} == {k: (n, len(low)) for k, (n, low) in want.items()} and len(got) == len(together)
    for k, (_, low) in want.items():
        owner, back = terms.unpacked(pa.array([bytes(got[k][2])], pa.binary()))
        assert back.tolist() == sorted(low) and not owner.any()
        assert len(got[k][2]) == (2 * len(low) if len(low) < terms.DENSE else 8_192)


def test_heavy_hitters(spark):
    r = random.Random(3)
    rows = ["hot"] * 300 + ["warm"] * 60 + [f"v{r.randrange(400)}" for _ in range(600)] + ["edge"] * 40
    frame = spark.createDataFrame([(v, 1) for v in rows] + [(None, 2)] * 50, "tag string, n int")
    counts = Counter(rows)
    for share in (0.04, 0.05, 0.3, 0.9):
        want = {v: n for v, n in counts.items() if n >= share * len(rows)}
        # few buckets: collisions make survivors, the exact count drops them
        for buckets in (8, 1 << 16):
            assert {x.tag: x.n for x in iceberg.heavy_hitters(frame, "tag", share, buckets=buckets).collect()} == want
    assert iceberg.heavy_hitters(frame.limit(0), "tag", 0.01).collect() == []


# ---- similar pairs ------------------------------------------------------------------------------


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def sets():
    r = random.Random(4)
    out = {}
    for i in range(150):
        if out and r.random() < 0.5:
            base = set(r.choice(list(out.values())))
            for _ in range(r.randrange(3)):
                base.symmetric_difference_update({r.randrange(40)})
        else:
            base = set(r.sample(range(40), r.randrange(1, 14)))
        out[i] = base or {1}
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.7, 1.0])
def test_similar_pairs(spark, sets, threshold):
    rows = [(i, f"t{t}", "x", 1) for i, s in sets.items() for t in s]
    frame = spark.createDataFrame(rows + rows[:40] + [(None, "t1", "x", 1), (5, None, "x", 1)], "id bigint, item string, class string, n int")
    big = {i: s for i, s in sets.items() if len(s) >= 4}
    want = {(a, b) for a, b in combinations(sorted(big), 2) if jaccard(big[a], big[b]) >= threshold - 1e-12}
    for pivots in (1, 5):
        found = similar.similar_pairs(frame, threshold, 4, pivots).collect()
        assert {tuple(x) for x in found} == want and len(found) == len(want)


def test_copies_above_the_limit_hang_on_their_representative(spark, sets):
    same = {f"q{t}" for t in range(6)}
    groups = {**{i: same for i in range(1000, 1020)}, 2000: same - {"q0"}}
    frame = spark.createDataFrame([(i, t) for i, s in groups.items() for t in s], "id bigint, item string")
    found = {tuple(x) for x in similar.similar_pairs(frame, 0.7, 4, expand=10).collect()}
    assert found == {(1000, i) for i in range(1001, 1020)} | {(1000, 2000)}
    members = {x.id: (x.class_id, x.n_links) for x in similar.class_members(frame, 0.7, 4).collect()}
    assert members == {**{i: (1000, 1) for i in range(1000, 1020)}, 2000: (2000, 1)}


def test_classes_expand_to_every_pair(spark):
    same = {f"q{t}" for t in range(6)}
    groups = {**{i: same for i in range(1000, 1020)}, **{i: same - {"q0"} for i in range(2000, 2012)}, 3000: same | {"r"}, 4000: {"a", "b", "c", "d"}}
    frame = spark.createDataFrame([(i, t) for i, s in groups.items() for t in s], "id bigint, item string")
    class_of = {x.id: x.class_id for x in similar.class_members(frame, 0.7, 4).collect()}
    of_class = {}
    for i, c in class_of.items():
        of_class.setdefault(c, []).append(i)
    found = similar.similar_pairs(frame, 0.7, 4, expand=10).collect()
    across = {tuple(sorted((a, b))) for x in found for a in of_class[class_of[x.id_a]] for b in of_class[class_of[x.id_b]] if a != b}
    within = {p for ids in of_class.values() for p in combinations(sorted(ids), 2)}
    assert across | within == {(a, b) for a, b in combinations(sorted(groups), 2) if jaccard(groups[a], groups[b]) >= 0.7}
    assert "p5_classes" in queries.p5_found.__doc__


def test_every_class_expanded_gives_the_exact_pairs(spark):
    same = {f"q{t}" for t in range(6)}
    groups = {**{i: same for i in range(1000, 1020)}, **{i: same - {"q0"} for i in range(2000, 2012)}, 3000: same | {"r"}, 4000: {"a", "b", "c", "d"}}
    frame = spark.createDataFrame([(i, t) for i, s in groups.items() for t in s], "id bigint, item string")
    found = similar.similar_pairs(frame, 0.7, 4, expand=None).collect()
    want = {(a, b) for a, b in combinations(sorted(groups), 2) if jaccard(groups[a], groups[b]) >= 0.7}
    assert {tuple(x) for x in found} == want and len(found) == len(want)


@pytest.mark.parametrize("size,salted", [(5, False), (40, True), (1000, True)])
def test_cells_of_large_groups_meet_each_pair_once(monkeypatch, size, salted):
    """Every token's group counts as large; batches end anywhere; a home cell is dealt out by salts."""
    r = np.random.default_rng(size)
    pool = r.integers(-(2**62), 2**62, 25)
    sets = sorted({tuple(sorted(int(x) for x in r.choice(pool, r.integers(4, 12), replace=False))) for _ in range(250)})
    for k in range(0, len(sets), 3):
        sets.append(tuple(sorted({*sets[k][1:], int(pool[k % 25]), int(pool[(k + 7) % 25])})))
    sets = sorted(set(sets)) + [tuple(sorted(r.integers(0, 2**62, 40).tolist()))]
    sets.append(sets[-1][:36])
    monkeypatch.setattr(similar, "HOMES", 3 if salted else 10**9)
    counts = np.bincount([c & (similar.BUCKETS - 1) for s in sets for c in s], minlength=similar.BUCKETS)
    batch = pa.RecordBatch.from_arrays([pa.array([list(s) for s in sets], pa.list_(pa.int64())), pa.array(range(len(sets)), pa.int64())], names=["codes", "class"])
    for pivots in ([], [np.array(s, np.int64) for s in sets[:5]]):
        laid = similar.place(batch, counts, counts if pivots else np.zeros_like(counts), pivots, 0.6)
        assert not pivots or len(set(laid.column(1).to_pylist())) > 3
        n = laid.column(5).to_numpy()
        laid = laid.take(pa.array(np.lexsort((laid.column(3).to_numpy(), n, laid.column(2).to_numpy(zero_copy_only=False), laid.column(1).to_numpy(), laid.column(0).to_numpy()))))
        found = [(a, b) for out in similar.stream((laid.slice(k, size) for k in range(0, laid.num_rows, size)), 0.6) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())]
        want = {(a, b) for a, b in combinations(range(len(sets)), 2) if jaccard(set(sets[a]), set(sets[b])) >= 0.6 - 1e-12}
        assert len(want) > 50 and set(found) == want


def test_similar_pairs_of_nothing(spark):
    frame = spark.createDataFrame([], "id bigint, item string")
    assert similar.similar_pairs(frame).collect() == [] and similar.class_members(frame).collect() == []
    one = spark.createDataFrame([(1, c) for c in "abcd"], "id bigint, item string")
    assert similar.similar_pairs(one).collect() == []


# ---- co-occurrence ------------------------------------------------------------------------------


def exact_tail(n, q, m):
    p = np.ones(1)
    for chance, times in zip(q, m):
        for _ in range(int(times)):
            p = np.convolve(p, [1 - chance, chance])
    return p[n:].sum()


def test_saddlepoint_against_the_exact_distribution():
    q, m = np.array([0.02, 0.1, 0.35]), np.array([40.0, 30.0, 12.0])
    mean = (q * m).sum()
    for n in range(int(mean) + 2, 40, 3):
        got = cooccur.log_tail(np.array([n]), q[None, :], m)[0]
        want = math.log(exact_tail(n, q, m))
        assert abs(got - want) < 0.05 * max(1, abs(want)), n
    assert cooccur.log_tail(np.array([0, 3]), np.stack([q, q]), m).tolist() == [0.0, 0.0]


def test_null_keeps_degrees():
    d, c = np.array([2.0, 5.0, 20.0, 60.0]), np.array([50, 20, 5, 2])
    k = np.array([2.0, 4.0, 7.0])
    m = np.array([40.0, 30.0, 100 / 7 * 1.0])
    m[2] = ((d * c).sum() - (k[:2] * m[:2]).sum()) / k[2]
    null = cooccur.fit_null(d, c, k, m)
    p = null.chances(d)
    assert np.allclose((p * m).sum(1), d, rtol=1e-6) and np.allclose((p * c[:, None]).sum(0), k, rtol=1e-6)


def test_cooccurrences(spark):
    r = random.Random(6)
    data = {}
    for b in range(300):
        s = {f"i{r.choice([0, 0, 0, 1, 2, *range(12)])}" for _ in range(r.randrange(1, 6))}
        if r.random() < 0.15:
            s |= {"left", "right"}
        data[b] = s
    rows = [(b, i, 0) for b, s in data.items() for i in s]
    frame = spark.createDataFrame(rows + rows[:30] + [(None, "i1", 0), (3, None, 0)], "id bigint, tag string, n int")
    single, pair = Counter(), Counter()
    for s in data.values():
        single.update(s)
        pair.update(combinations(sorted(s), 2))
    got = {(x.item_a, x.item_b): x for x in cooccur.cooccurrences(frame, min_count=3).collect()}
    assert {p: x.n_ab for p, x in got.items()} == {p: n for p, n in pair.items() if n >= 3}
    for (a, b), x in got.items():
        assert (x.n, x.n_a, x.n_b) == (len(data), single[a], single[b])
        assert math.isclose(x.lift, pair[a, b] * len(data) / (single[a] * single[b]))
    planted = got["left", "right"]
    assert planted.significant and planted.log10_p == min(x.log10_p for x in got.values())
    assert sum(x.significant for x in got.values()) < len(got) / 2
    assert cooccur.cooccurrences(frame.limit(0)).collect() == []
    shared = {(x.item_a, x.item_b) for x in cooccur.cooccurrences(frame, min_count=1, min_share=0.1).collect()}
    assert shared == {p for p, n in pair.items() if n >= 30}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_p6_pairs_has_every_pair_of_tags(spark):
    held = {}
    for x in queries.records(spark, DATA).collect():
        held.setdefault(x.id, set()).add(x.tag)
    single, pair = Counter(), Counter()
    for s in held.values():
        single.update(s)
        pair.update(combinations(sorted(s), 2))
    got = queries.p6_pairs(spark, DATA).collect()
    assert {(x.tag_a, x.tag_b): (x.n, x.n_a, x.n_b, x.n_ab) for x in got} == {(a, b): (len(held), single[a], single[b], n) for (a, b), n in pair.items()}
    assert len(got) == len(pair) and all(math.isclose(x.lift, x.n_ab * x.n / (x.n_a * x.n_b)) for x in got)


def test_wide_baskets(spark):
    frame = spark.createDataFrame([(1, [1, 2, 3, 4]), (2, [2, 3])], "id bigint, codes array<bigint>")
    for wide in (1, 10):
        got = {(x.a, x.b): x.n_ab for x in cooccur.pair_counts(frame, wide).collect()}
        assert got == {(1, 2): 1, (1, 3): 1, (1, 4): 1, (2, 3): 2, (2, 4): 1, (3, 4): 1}
