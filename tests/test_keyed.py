"""Maps, sets and multimaps against dict and set models, probing every key."""

import random

import pytest
from pyspark.sql import functions as F

from tagweave.operators.buffer import BufferedMap
from tagweave.operators.keyed import MapTable, SetMapTable, SetTable, pairs_present, unnest


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def log_rows(seed, n=60, keys=20):
    r = random.Random(seed)
    return [(r.randrange(keys), "".join(r.choices("abcxyz", k=r.randrange(4))), i, r.choice("UUUD")) for i in range(n)]


def model(rows):
    out = {}
    for k, v, _, op in sorted(rows, key=lambda x: x[2]):
        if op == "U":
            out[k] = v
        else:
            out.pop(k, None)
    return out


SCHEMA = "k bigint, v string, seq bigint, op string"


@pytest.mark.parametrize("seed", range(3))
def test_replay_is_the_fold_of_its_operations(spark, seed):
    rows = log_rows(seed)
    shuffled = rows + rows[:10]  # repeated rows
    random.Random(seed).shuffle(shuffled)
    table = MapTable.from_log(spark.createDataFrame(shuffled + [(None, "x", 999, "U")], SCHEMA))
    assert pairs(table.df) == model(rows)


def test_map_insert_lookup_delete(spark):
    table = MapTable(spark.createDataFrame([(1, "a"), (2, "b"), (3, "")], "k bigint, v string"))
    assert pairs(table.insert(2, "z").df) == {1: "a", 2: "z", 3: ""}
    assert pairs(table.insert(9, "n").df) == {1: "a", 2: "b", 3: "", 9: "n"}
    batch = spark.createDataFrame([(1, "q"), (7, "r"), (None, "s")], "k bigint, v string")
    many = table.insert_many(batch)
    assert pairs(many.df) == {1: "q", 2: "b", 3: "", 7: "r"}
    assert pairs(many.lookup(1, 2, 77)) == {1: "q", 2: "b"}
    assert pairs(many.lookup_many(batch)) == {1: "q", 7: "r"}
    for k in (1, 2, 3, 5):
        assert pairs(table.delete(k).df) == {x: v for x, v in {1: "a", 2: "b", 3: ""}.items() if x != k}
        assert pairs(table.delete(k).insert(k, "again").df)[k] == "again"
    assert pairs(table.delete_many(batch).df) == {2: "b", 3: ""}
    assert pairs(MapTable.empty(spark, "k bigint, v string").insert(1, "a").df) == {1: "a"}


@pytest.mark.parametrize("key", [0, 1, 2, 3, 9])
def test_split_at_a_key(spark, key):
    rows = [(1, 5), (2, 6), (2, 7), (3, 8)]
    frame = spark.createDataFrame(rows, "k bigint, v bigint")
    below, above = SetMapTable.of(frame).split(key)
    assert sorted(map(tuple, below.df.collect())) == [x for x in rows if x[0] < key]
    assert sorted(map(tuple, above.df.collect())) == [x for x in rows if x[0] >= key]
    below, above = SetTable.of(frame).split(key)
    assert sorted(x.k for x in below.df.collect()) == [k for k in (1, 2, 3) if k < key]
    assert sorted(x.k for x in above.df.collect()) == [k for k in (1, 2, 3) if k >= key]
    below, above = MapTable(frame.filter("v <> 7").withColumnRenamed("k", "name"), "name").split(key)
    assert pairs(below.df) == {k: v for k, v in ((1, 5), (2, 6), (3, 8)) if k < key}
    assert pairs(above.insert(10, 0).df) == {**{k: v for k, v in ((1, 5), (2, 6), (3, 8)) if k >= key}, 10: 0}


def test_buffered_read_is_the_same_after_compaction(spark, tmp_path):
    rows = log_rows(5, 80)
    base = MapTable.from_log(spark.createDataFrame(rows[:40], SCHEMA)).df
    buffered = BufferedMap(base, spark.createDataFrame(rows[40:60], SCHEMA), limit=10).write(spark.createDataFrame(rows[60:], SCHEMA))
    want = model(rows)
    assert pairs(buffered.read().df) == want
    assert buffered.needs_compaction()
    compact = buffered.compact(str(tmp_path / "base"))
    assert pairs(compact.read().df) == want and not compact.needs_compaction()
    for k in range(20):
        assert pairs(buffered.lookup(k)) == pairs(compact.lookup(k)) == {x: v for x, v in want.items() if x == k}


@pytest.mark.parametrize("a,b", [([1, 2, 2, -3], [2, 5]), ([], [1, 2]), ([4], []), ([], [])])
def test_set_algebra(spark, a, b):
    left, right = (SetTable.of(spark.createDataFrame([(x,) for x in v] + [(None,)], "k bigint")) for v in (a, b))
    values = lambda s: {r.k for r in s.df.collect()}
    assert values(left) == set(a) and left.df.count() == len(set(a))
    assert values(left.union(right)) == set(a) | set(b)
    assert values(left.intersection(right)) == set(a) & set(b)
    assert values(left.insert(2)) == set(a) | {2} and left.insert(2).df.count() == len(set(a) | {2})
    assert values(left.delete(2)) == set(a) - {2}
    assert values(left.delete_many(right.df)) == set(a) - set(b)
    assert left.is_null() == (not a)
    probes = spark.createDataFrame([(x,) for x in (1, 2, 9)], "k bigint")
    assert {r.k: r.is_member for r in left.member(probes).collect()} == {x: x in a for x in (1, 2, 9)}
    assert [r.k for r in left.to_rows().collect()] == sorted(set(a))


def test_set_singleton_and_empty(spark):
    assert [r.k for r in SetTable.singleton(spark, 5).df.collect()] == [5]
    assert SetTable.empty(spark).is_null()


def test_multimap(spark):
    table = SetMapTable.of(spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("a", 1), (None, 3), ("c", None)], "k string, v bigint"))
    rows = lambda t: {tuple(r) for r in t.df.collect()}
    assert rows(table) == {("a", 1), ("a", 2), ("b", 1)}
    assert rows(table.insert("b", 7)) == rows(table) | {("b", 7)} and table.insert("a", 1).df.count() == 3
    assert rows(table.delete("a", 1)) == {("a", 2), ("b", 1)}
    assert rows(table.delete("b", 1)) == {("a", 1), ("a", 2)}
    assert {r.k for r in table.lookup("a").df.collect()} == {1, 2}
    assert table.lookup("zzz").is_null()
    assert {r.k: list(r.vs) for r in table.grouped().collect()} == {"a": [1, 2], "b": [1]}
    assert {r.k: r.n for r in table.sizes().collect()} == {"a": 2, "b": 1}
    assert {tuple(r) for r in unnest(table.grouped(), "k", "vs").collect()} == rows(table)
    assert rows(SetMapTable.empty(spark).insert("a", 1)) == {("a", 1)}
    assert rows(table.delete_many(spark.createDataFrame([("a", 1), ("x", 1)], "k string, v bigint"))) == {("a", 2), ("b", 1)}


def test_pairs_present_takes_the_last_operation(spark):
    rows = [("a", 1, 5, "D"), ("a", 1, 3, "U"), ("a", 2, 1, "D"), ("a", 2, 2, "U"), ("b", 1, 9, "U"), ("b", 1, 9, "U"), (None, 1, 1, "U"), ("b", None, 2, "U")]
    got = pairs_present(spark.createDataFrame(rows, "k string, v bigint, seq bigint, op string"), ["k", "v"])
    assert {tuple(r) for r in got.collect()} == {("a", 2), ("b", 1)}


def test_hot_key_is_reduced_before_the_shuffle(spark):
    log = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("string").alias("v"), F.col("id").alias("seq"), F.lit("U").alias("op"))
    plan = MapTable.from_log(log).df._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
