"""Key ranges, leaf layout, manifests and replicas."""

import random

import pytest

from tagweave.operators import nodes as nd
from tagweave.plans.replica import Replica
from tagweave.plans.snapshot import manifest, ranges, root, store, to_fetch


def frame(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "k bigint")


def test_separator_goes_right(spark):
    nodes = nd.bounds_frame(spark, [179, 210])
    got = {r.k: r.node_id for r in nd.node_of_key(frame(spark, [5, 179, 200, 210, 215, -4]), nodes).collect()}
    assert got == {5: 0, 179: 1, 200: 1, 210: 2, 215: 2, -4: 0}


def test_many_nodes_without_the_driver(spark, monkeypatch):
    seps = list(range(0, 24_000, 2))
    keys = [-5, 0, 1, 2, 3, 11_999, 23_998, 30_000]
    got = {r.k: r.node_id for r in nd.node_of_key(frame(spark, keys), nd.bounds_frame(spark, seps)).collect()}
    assert got == {k: sum(s <= k for s in seps) for k in keys}


@pytest.mark.parametrize("least,most,want", [(None, 2, [0]), (None, 6, [0, 1]), (None, 12, [0, 1, 2, 3]), (11, None, [3]), (8, None, [2, 3]), (3, None, [0, 1, 2, 3]), (7, 7, [2]), (5, 6, [1])])
def test_trim(spark, least, most, want):
    assert sorted(r.node_id for r in nd.trim(nd.bounds_frame(spark, [5, 7, 10]), least, most).collect()) == want


@pytest.mark.parametrize("nested", [4, 256])
def test_places_over_buckets(spark, monkeypatch, nested):
    """Binary search, and what is carried over from earlier buckets, with buckets by expression or numpy."""
    monkeypatch.setattr(nd, "PER_BUCKET", 30)
    monkeypatch.setattr(nd, "NESTED", nested)
    r = random.Random(5)
    keys, probes = r.sample(range(-400, 400), 150), [r.randrange(-450, 450) for _ in range(200)] + [-450, 450]
    for or_equal in (False, True):
        got = sorted((x.k, x.place) for x in nd.lower_bound(frame(spark, keys), frame(spark, probes), or_equal).collect())
        assert got == sorted((p, sum(k <= p if or_equal else k < p for k in keys)) for p in probes)
    seps = sorted(r.sample(range(-300, 300), 60))
    got = {x.k: x.node_id for x in nd.node_of_key(frame(spark, [*probes, None]), nd.bounds_frame(spark, seps)).collect()}
    assert got == {p: sum(s <= p for s in seps) for p in probes} | {None: None}
    assert nd.lower_bound(frame(spark, []), frame(spark, [3])).first().place == 0


def test_parts_of_an_index(spark):
    rows = lambda df: sorted(map(tuple, df.select("node_id", "lo", "hi").collect()))
    whole = nd.bounds_frame(spark, [5, 7, 10])
    for at in (5, 7, 10):
        left, right = nd.parted(whole, at)
        n = left.count()
        assert rows(nd.joined(left, at, right.withColumn("node_id", right.node_id - n))) == rows(whole)
    first, last = nd.ends(whole)
    assert (first.first().node_id, last.first().node_id) == (0, 3)
    assert tuple(nd.size(whole).first()) == (4, 3) and tuple(nd.size(whole.limit(0)).first()) == (0, 0)


def test_different_contents_have_different_hashes(spark):
    contents = [{1: "a,2=b"}, {1: "a", 2: "b"}, {1: None}, {1: ""}, {1: "-"}, {1: "1:a"}, {1: "a"}, {11: "a"}, {1: "1", 2: None}, {1: None, 2: "1"}]
    hashes = [manifest(spark.createDataFrame(list(c.items()), "k bigint, v string")).first().hash for c in contents]
    assert len(set(hashes)) == len(contents) and {len(h) for h in hashes} == {64}


def test_manifest_of_text_keys(spark, monkeypatch):
    monkeypatch.setattr(nd, "PER_BUCKET", 40)
    r = random.Random(8)
    rows = {"".join(r.choice("abcdé") for _ in range(6)): str(i) for i in range(300)}
    make = lambda x: ranges(spark.createDataFrame(list(x.items()), "k string, v string"), 8).orderBy("node_id").collect()
    nodes = make(rows)
    assert make(dict(sorted(rows.items(), reverse=True))) == nodes
    assert sum(n.n_rows for n in nodes) == len(rows) and nodes[0].lo is None and nodes[-1].hi is None
    assert all(a.hi == b.lo for a, b in zip(nodes, nodes[1:]))
    for n in nodes:
        assert n.n_rows == sum((n.lo is None or k >= n.lo) and (n.hi is None or k < n.hi) for k in rows)
    key = sorted(rows)[150]
    changed = make({**rows, key: "other"})
    assert len({n.hash for n in changed} - {n.hash for n in nodes}) == 1
    assert ranges(spark.createDataFrame([], "k string, v string")).collect() == []


def test_empty_index(spark):
    nodes = nd.bounds_frame(spark, []).limit(0)
    assert [r.node_id for r in nd.node_of_key(frame(spark, [1]), nodes).collect()] == [None]


def test_order_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(nd, "PER_BUCKET", 40)
    keys = random.Random(1).sample(range(100_000), 500)
    ordered = sorted(keys)
    whole = nd.ordered_index(frame(spark, keys), "k")
    monkeypatch.setattr(nd, "PER_BUCKET", 10**6)
    assert dict(nd.ordered_index(frame(spark, keys), "k").dtypes) == dict(whole.dtypes)
    monkeypatch.setattr(nd, "PER_BUCKET", 40)
    got = {r.k: (r.i, r.n) for r in whole.collect()}
    assert got == {k: (i, 500) for i, k in enumerate(ordered)}
    near = {r.k: (r.prev, r.next) for r in nd.neighbours(frame(spark, keys + keys[:5]), "k").collect()}
    assert near == {k: (ordered[i - 1] if i else None, ordered[i + 1] if i < 499 else None) for i, k in enumerate(ordered)}


@pytest.mark.parametrize("n", [0, 1, 3, 4, 6, 7, 8, 20])
def test_leaf_sizes(spark, n, most=3):
    got = [r.leaf for r in nd.leaf_layout(frame(spark, range(n)), "k", most).orderBy("k").collect()]
    want, left, leaf = [], n, 0
    while left > 2 * most:
        want += [leaf] * most
        left, leaf = left - most, leaf + 1
    want += [leaf] * left if left <= most else [leaf] * (left // 2) + [leaf + 1] * (left - left // 2)
    assert got == want


def state(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "k bigint, v string")


def test_manifest_depends_on_content_only(spark):
    rows = {k: f"v{k}" for k in random.Random(2).sample(range(-500, 3000), 200)}
    a = manifest(state(spark, rows))
    b = manifest(spark.createDataFrame(list(rows.items())[::-1], "k bigint, v string").repartition(5))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert root(a).first() == root(b).first()
    changed = dict(rows)
    key = next(iter(rows))
    changed[key] = "other"
    c = manifest(state(spark, changed))
    assert [r.node_id for r in to_fetch(c, a).collect()] == [key // 16]
    assert root(c).first().hash != root(a).first().hash and root(c).first().n_rows == 200
    assert store(c, a).count() == a.count() + 1
    assert root(a.limit(0)).first().n_rows == 0


def test_replica_fetches_what_it_lacks_once(spark):
    rows = {k: f"v{k}" for k in range(0, 120, 3)}
    source = state(spark, rows)
    nodes = manifest(source)
    keys = frame(spark, range(-2, 125))
    replica = Replica.from_root(nodes)
    asked = replica.ensure_range(20, 40)
    assert sorted(r.node_id for r in asked.collect()) == [1, 2]
    statuses = {r.status for r in replica.lookup(keys).collect()}
    assert statuses == {"FETCH", "ABSENT"}
    replica = replica.fetched(asked, source.filter("k >= 16 AND k < 48"))
    assert replica.ensure_range(20, 40).isEmpty() and not replica.ensure_range(20, 48).isEmpty()
    got = {r.k: (r.status, r.v) for r in replica.lookup(keys).collect()}
    for k in range(16, 48):
        assert got[k] == (("FOUND", rows[k]) if k in rows else ("ABSENT", None))
    assert got[51][0] == "FETCH"

    changed = {**rows, 21: "new", 99: "new"}
    after = replica.update_root(manifest(state(spark, changed)))
    assert sorted(r.node_id for r in after.ensure_range(16, 47).collect()) == [1]  # node 2 is still held
    want = after.ensure_range()
    fresh = state(spark, changed).filter("NOT (k >= 32 AND k < 48)")
    full = after.fetched(want, fresh)
    assert full.missing().isEmpty()
    assert {r.k: r.v for r in full.lookup(keys).collect() if r.status == "FOUND"} == changed
    assert replica.update_root(None).lookup(keys).filter("status != 'ABSENT'").isEmpty()


def test_wrong_content_is_an_error(spark):
    source = state(spark, {1: "a", 2: "b"})
    nodes = manifest(source)
    bad = Replica.from_root(nodes).fetched(nodes.select("node_id", "hash"), state(spark, {1: "a", 2: "x"}))
    with pytest.raises(Exception, match="requested hash"):
        bad.lookup(frame(spark, [1])).collect()
