"""Batch search by blocks: what it shuffles, and its answers."""

import hashlib
import json
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tagweave import catalog
from tagweave.operators.blocks import tag_sets, tell_hits


def shuffled(spark, run):
    """(result, records written to shuffles) of a run."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the tables were large
    try:
        got = run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return got, written() - before


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Ids that lie far apart and hold most of ten tags; each set of two or three tags is asked for three times."""
    d = str(tmp_path_factory.mktemp("blocks"))
    tags = "abcdefghij"
    rows = [(i, (i - 500) * 1_000_003, [t for k, t in enumerate(tags) if (i + k) % 7], f"http://x/{i}?é\"") for i in range(1_000)]
    rows += [(2_000 + i, (i - 500) * 1_000_003, [" A ", None, "_"], None if i % 5 else "new") for i in range(0, 1_000, 3)] + [(9_000, None, ["a"], "none"), (None, 7, ["a", "b", "c"], "no item")]
    asked = [list(c) for n in (2, 3) for c in combinations(tags, n)] * 3 + [["a"], ["zz", "a", "zz"], [], ["b", "a", "b"]]
    spark.createDataFrame(rows, "reply_id bigint, id bigint, tags array<string>, imgurl string").write.parquet(f"{d}/search_response_info.parquet")
    bodies = [(n, json.dumps({"tag": "Search", "contents": w})) for n, w in enumerate(asked)] + [(10_000, '{"tag":"Info","contents":-500001500}'), (10_001, '{"tag":')]
    spark.createDataFrame(bodies, "cmd_id bigint, body string").write.parquet(f"{d}/user_cmds.parquet")
    held: dict[int, set] = {}
    for _, i, own, _ in rows:
        held.setdefault(i, set()).update(t.strip(" _").lower() for t in own if t)
    held.pop(None)
    last = {i: url for reply, i, _, url in rows if i is not None and reply is not None}
    return d, {n: (w, sorted(i for i, own in held.items() if w and set(w) <= own)) for n, w in enumerate(asked)}, last


def test_responses_shuffle_no_row_per_hit(spark, folder):
    d, want, last = folder
    got, records = shuffled(spark, lambda: {r.cmd_id: json.loads(r.response) for r in catalog.respond_requests(spark, d).collect()})
    assert got.pop(10_000)["tag"] == "Info" and set(got) == set(want)
    for n, (asked, ids) in want.items():
        if "zz" in asked:
            assert got[n] == {"tag": "BadTag", "contents": ["zz", "zz"]}
        else:
            assert got[n] == {"tag": "OK", "contents": [[i, last[i]] for i in ids if i in last]}
    assert sum(len(ids) for _, ids in want.values()) > 200_000 and records < 50_000


def test_counts_shuffle_no_row_per_hit(spark, folder):
    d, want, _ = folder
    got, records = shuffled(spark, lambda: {r.cmd_id: (r.n, r.first_id, r.last_id) for r in catalog.search_requests(spark, d).collect()})
    assert got == {n: (len(ids), ids[0], ids[-1]) for n, (_, ids) in want.items() if ids}
    assert records < 20_000


def test_many_requests_for_the_same_tags(spark, tmp_path):
    rows = [(i, i, ["x"], "u") for i in range(3)]
    spark.createDataFrame(rows, "reply_id bigint, id bigint, tags array<string>, imgurl string").write.parquet(f"{tmp_path}/search_response_info.parquet")
    spark.createDataFrame([(n, '{"tag":"Search","contents":["x"]}') for n in range(1_000)], "cmd_id bigint, body string").write.parquet(f"{tmp_path}/user_cmds.parquet")
    got = catalog.respond_requests(spark, str(tmp_path)).collect()
    assert sorted(r.cmd_id for r in got) == list(range(1_000)) and {r.response for r in got} == {'{"tag":"OK","contents":[[0,"u"],[1,"u"],[2,"u"]]}'}


def test_copies_are_made_for_few_requests_at_a_time(spark):
    records = spark.createDataFrame([(1, ["x"]), (2, ["x", "y"])], "id bigint, tags array<string>")
    asked = spark.createDataFrame([(n, ["x"] if n % 3 else ["y"]) for n in range(900)], "k bigint, wanted array<string>")
    pieces = records.selectExpr("id", "concat('p', id) AS piece")
    told = tell_hits(records, tag_sets(asked, "k", "wanted"), pieces, "k", "[", "]", at_once=20)
    assert {r.k: r.response for r in told.collect()} == {n: "[p1,p2]" if n % 3 else "[p2]" for n in range(900)} and told.count() == 900


def told_by_tasks(told):
    """Responses by key, bytes of each task."""
    rows = told.select("k", F.spark_partition_id().alias("task"), F.md5("response").alias("text"), F.octet_length("response").alias("size")).collect()
    tasks = Counter()
    for r in rows:
        tasks[r.task] += r.size
    return {r.k: r.text for r in rows}, tasks, len(rows)


def test_a_task_gives_few_large_responses(spark):
    """Parquet's writer looks at its buffers after 100 rows; all responses of a task may be in them."""
    records = spark.createDataFrame([(1, ["x"]), (2, ["x", "y"])], "id bigint, tags array<string>")
    asked = spark.createDataFrame([(n, ["x"] if n % 100 else ["y"]) for n in range(200)], "k bigint, wanted array<string>")
    pieces = records.selectExpr("id", "repeat(cast(id AS string), 1000000) AS piece")
    got, tasks, n = told_by_tasks(tell_hits(records, tag_sets(asked, "k", "wanted"), pieces, "k", "[", "]"))
    one, two = b"1" * 1_000_000, b"2" * 1_000_000
    both, last = (hashlib.md5(b"[" + t + b"]").hexdigest() for t in (one + b"," + two, two))
    assert n == 200 and got == {k: both if k % 100 else last for k in range(200)}
    assert max(tasks.values()) <= 64_000_000 and len(tasks) < 30


def test_responses_of_tasks_that_hold_parts_of_sets(spark):
    rows = [(i * 7, [t for k, t in enumerate("abcde") if (i + k) % 3]) for i in range(400)]
    records = spark.createDataFrame(rows, "id bigint, tags array<string>")
    wanted = [["a"], ["a", "b"], ["e", "d"], ["c", "a", "e"], ["c", "zz"], [], ["d"]]
    asked = spark.createDataFrame([(n, wanted[n * n % 7]) for n in range(150)] + [(None, ["b"])], "k bigint, wanted array<string>")
    pieces = records.selectExpr("id", "concat('é', id) AS piece")
    got, tasks, n = told_by_tasks(tell_hits(records, tag_sets(asked, "k", "wanted"), pieces, "k", "[", "]", task=6_000))
    text = {tuple(w): "[" + ",".join(f"é{i}" for i, own in rows if w and set(w) <= set(own)) + "]" for w in [*wanted, ["b"]]}
    assert n == 151 and got == {k: hashlib.md5(text[tuple(wanted[k * k % 7] if k is not None else ["b"])].encode()).hexdigest() for k in [*range(150), None]}
    assert max(tasks.values()) <= 6_000 and len(tasks) > 10


def test_requests_to_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "reply_id bigint, id bigint, tags array<string>, imgurl string").write.parquet(f"{tmp_path}/search_response_info.parquet")
    spark.createDataFrame([(1, '{"tag":"Search","contents":["x"]}'), (2, '{"tag":"Search","contents":[]}')], "cmd_id bigint, body string").write.parquet(f"{tmp_path}/user_cmds.parquet")
    assert catalog.search_requests(spark, str(tmp_path)).collect() == []
    got = {r.cmd_id: json.loads(r.response) for r in catalog.respond_requests(spark, str(tmp_path)).collect()}
    assert got == {1: {"tag": "BadTag", "contents": ["x"]}, 2: {"tag": "OK", "contents": []}}
