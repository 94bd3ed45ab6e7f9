"""JSON pages, search and the request protocol, tokenizers, streaming, eager aggregation."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tagweave import catalog
from tagweave.functions.text import elements, split_console, split_web, tag_form
from tagweave.operators.eager import eager_join, with_share
from tagweave.operators.search import TagIndex, decode_requests, respond, search_batch, top
from tagweave.plans.snapshot import manifest
from tagweave.sources import json_pages as jp
from tagweave.streaming.oplog import follow_log, published


def image(i, tags, thumb="t", medium="m", **more):
    return {"id": i, "tags": tags, "representations": {"thumb": thumb, "medium": medium}, **more}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("json")
    pages = {
        "a.json": json.dumps({"images": [image(1, ["x", "y"], "t1"), image(2, ["x"], "t2", extra=3)], "total": 2}),
        "b.json": json.dumps({"images": [image(1, ["z"], "t1b")]}),
        "c.json": json.dumps({"images": []}),
        "d.json": '{"images": [{"id": 5',
        "e.json": json.dumps({"other": []}),
        "f.json": json.dumps({"images": [image(7, ["x"]), {"id": 8, "tags": [], "representations": {"medium": "m"}}]}),
        "g.json": json.dumps({"images": [image("9", ["x"])]}),
        "h.json": json.dumps({"images": [image(10, ["x", None])]}),
        "i.json": json.dumps({"images": [image(11, [])]}),
        "j.json": json.dumps({"images": [image(12, ["x"], thumb=5)]}),
    }
    for name, text in pages.items():
        (d / name).write_text(text)
    return str(d)


def test_pages(spark, folder):
    decoded = jp.decode(jp.read_folder(spark, folder))
    assert sorted(r.file_name for r in jp.rejected(decoded).collect()) == ["d.json", "e.json", "f.json", "g.json", "h.json", "j.json"]
    items, tags = jp.items_and_tags(jp.entries(decoded, ["file_name"]), ["file_name"])
    assert {r.id: (r.tags, r.thumb) for r in items.collect()} == {1: (["z"], "t1b"), 2: (["x"], "t2"), 11: ([], "t")}
    assert {tuple(r) for r in tags.collect()} == {("x", 1), ("y", 1), ("z", 1), ("x", 2)}
    nothing = jp.decode(spark.createDataFrame([(None,), ("",)], "body string"))
    assert jp.rejected(nothing).count() == 2


@pytest.fixture(scope="module")
def index(spark):
    items = spark.createDataFrame([(1, ["a"], "t1", "m1"), (2, ["b"], "t2", "m2"), (3, [], "t3", "m3")], "id bigint, tags array<string>, thumb string, img string")
    tags = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3), ("c", 9), ("", 1)], "tag string, id bigint")
    return TagIndex(items, tags)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_search(index):
    assert ids(index.search(["a", "b"])) == [2]
    assert ids(index.search(["a", "a"])) == [1, 2]
    assert ids(index.search([])) == [] and ids(index.search(["a", "nope"])) == []
    assert [tuple(r) for r in index.unknown(["n", "a", "n"]).collect()] == [(0, "n"), (2, "n")]
    assert [tuple(r) for r in index.lookup_items(index.search(["c"])).collect()] == []
    assert [tuple(r) for r in index.lookup_items(index.search(["b"])).collect()] == [(2, "t2"), (3, "t3")]
    assert [tuple(r) for r in top(index.search(["b"]), 1).collect()] == [(2, 2)]
    assert [tuple(r) for r in index.info(2).collect()] == [(2, ["b"], "m2")]
    assert [r.status for r in index.console("a, q").collect()] == ["INVALID TAG"]
    assert [r.id for r in index.console("a, b").collect()] == [2] and [r.id for r in index.console("").collect()] == [1]


def test_protocol(spark, index):
    bodies = ['{"tag":"Search","contents":["a","b"]}', '{"tag":"Search","contents":["x","a","x"]}', '{"tag":"Search","contents":[]}', '{"tag":"Info","contents":2}', '{"tag":"Info","contents":77}', '{"tag":"Info","contents":"2"}', '{"tag":"Sea', None, '{"tag":"Other","contents":[]}', '{"tag":"Search","contents":["b"]}', '{"tag":"Search","contents":["c"]}', '{"tag":"Search","contents":[null]}']
    cmds = spark.createDataFrame(list(enumerate(bodies)) + [(0, bodies[0])], "cmd_id bigint, body string")
    got = {r.cmd_id: json.loads(r.response) for r in respond(index, cmds).collect()}
    assert got == {
        0: {"tag": "OK", "contents": [[2, "t2"]]},
        1: {"tag": "BadTag", "contents": ["x", "x"]},
        2: {"tag": "OK", "contents": []},
        3: {"tag": "Info", "contents": {"id": 2, "tags": ["b"], "img": "m2"}},
        4: {"tag": "Info", "contents": None},
        9: {"tag": "OK", "contents": [[2, "t2"], [3, "t3"]]},
        10: {"tag": "OK", "contents": []},
    }
    assert decode_requests(cmds.limit(0)).count() == 0


def test_a_known_image_without_a_picture(spark):
    items = spark.createDataFrame([(7, None, "t", None)], "id bigint, tags array<string>, thumb string, img string")
    cmds = spark.createDataFrame([(1, '{"tag":"Info","contents":7}'), (2, '{"tag":"Info","contents":8}')], "cmd_id bigint, body string")
    got = {r.cmd_id: json.loads(r.response)["contents"] for r in respond(TagIndex(items, TagIndex.empty(spark).tags), cmds).collect()}
    assert got == {1: {"id": 7, "tags": None, "img": None}, 2: None}


def test_entries_of_an_empty_index(spark):
    index = TagIndex.empty(spark)
    assert ids(index.search(["a"])) == [] and [r.status for r in index.console("a").collect()] == ["INVALID TAG"]
    index = index.add(1, ["a"], "t1", "m1").add(1, ["b"], "t2", "m2")
    assert ids(index.search(["a", "b"])) == [1] and index.info(1).first().img == "m2"
    assert [(r.status, r.id, r.thumb) for r in index.console(":showitems").collect()] == [("ITEM", 1, "t2")]
    assert sorted((r.status, r.tag, r.id) for r in index.console(" :showtags ").collect()) == [("TAG", "a", 1), ("TAG", "b", 1)]


def test_batch_search_is_search(spark):
    r = random.Random(4)
    postings = {(t, i) for i in range(60) for t in "abcdefgh" if r.random() < (0.9 if t < "c" else 0.2)}
    tags = spark.createDataFrame(sorted(postings), "tag string, id bigint")
    asked = [(n, r.choices("abcdefghz", k=r.randrange(5))) for n in range(25)]
    hits, unknown = search_batch(tags, spark.createDataFrame(asked, "cmd_id bigint, wanted array<string>"))
    got = {tuple(x) for x in hits.collect()}
    known = {t for t, _ in postings}
    assert got == {(n, i) for n, w in asked if w and set(w) <= known for i in range(60) if all((t, i) in postings for t in w)}
    assert {(x.cmd_id, x.pos, x.tag) for x in unknown.collect()} == {(n, p, t) for n, w in asked for p, t in enumerate(w) if t not in known}


def test_tokenizers(spark):
    texts = ["a, b ,c", "", " x ,,\ty\n, ", "a,   b", ","]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    web = [r[0] for r in df.select(split_web(F.col("s"))).collect()]
    console = [r[0] for r in df.select(split_console(F.col("s"))).collect()]
    assert web == [["a", "b", "c"], [], ["x", "y"], ["a", "b"], []]
    assert console == [["a", "b ", "c"], [""], [" x ", "", "\ty\n", ""], ["a", "b"], ["", ""]]


def test_tag_form(spark):
    raw = ["Open_shelf", " a\t b ", "__", "", None, "x", "A  B", " ", "a_b c"]
    df = spark.createDataFrame([(1, raw)], "id bigint, tags array<string>")
    assert [r.tag for r in elements(df).collect()] == ["open shelf", "a b", "x", "a b", "a b c"]
    forms = [r[0] for r in spark.createDataFrame([(t,) for t in raw], "t string").select(tag_form(F.col("t"))).collect()]
    assert forms == ["open shelf", "a b", "", "", None, "x", "a b", "", "a b c"]


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_eager_join_is_the_aggregate_of_the_join(spark, how):
    r = random.Random(3)
    left = [(r.choice([None, "hot", "hot", "hot", *"abc"]), r.choice("gh"), r.randrange(9)) for _ in range(80)]
    right = [(r.choice([None, "hot", "hot", *"bcd"]), r.randrange(9)) for _ in range(50)]
    a = spark.createDataFrame(left, "k string, g string, x int")
    b = spark.createDataFrame(right, "k string, x int")
    got = {tuple(row)[0]: row for row in eager_join(a, b, "k", left_sums=["x"], right_sums=["x"], how=how, distinct_right="x").collect()}
    keys_a, keys_b = {k for k, _, _ in left if k}, {k for k, _ in right if k}
    assert set(got) == {"inner": keys_a & keys_b, "left": keys_a, "full": keys_a | keys_b}[how]
    for k, row in got.items():
        ls, rs = [x for q, _, x in left if q == k], [x for q, x in right if q == k]
        assert (row.left_rows, row.right_rows, row.join_rows, row.right_distinct) == (len(ls), len(rs), len(ls) * len(rs), len(set(rs)))
        assert row.left_sum_x == sum(ls) * len(rs) and row.right_sum_x == sum(rs) * len(ls)
    by_group = {row.g: row for row in eager_join(a, b, "k", group=["g"], right_sums=["x"]).collect()}
    for g, row in by_group.items():
        rows = [(x, y) for k, q, x in left for j, y in right if k and k == j and q == g]
        assert row.join_rows == len(rows) and row.right_sum_x == sum(y for _, y in rows)


def test_p1_found_runs_its_join(spark, tmp_path):
    rows = [(1, 5, ["a", "b"]), (2, None, ["a", "c"]), (2, None, ["a", "c"]), (3, 6, None), (4, 5, ["a", None, " "])]
    spark.createDataFrame(rows, "reply_id bigint, id bigint, tags array<string>").write.parquet(str(tmp_path / "search_response_info.parquet"))
    found = catalog.p1_found(spark, str(tmp_path))
    assert sorted(r.tag for r in found.collect()) == ["a", "b", "c"]
    assert {r.tag: (r.n_elements, r.n_ids) for r in catalog.p1_tags(spark, str(tmp_path)).collect()} == {"a": (4, 1), "b": (1, 1), "c": (2, 0)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join FullOuter" in plan and "isnull(id" in plan and "isnotnull(id" in plan


def test_eager_join_of_nothing(spark):
    a = spark.createDataFrame([], "k string, x int")
    assert with_share(eager_join(a, a, "k", distinct_right="x", how="left"), "left_rows").collect() == []
    none = with_share(spark.createDataFrame([("a", 0)], "k string, n bigint"), "n")
    assert none.first().share is None


def test_share(spark):
    rows = [("a",)] * 6 + [("b",)] * 2
    got = with_share(eager_join(spark.createDataFrame(rows, "k string"), spark.createDataFrame(rows, "k string"), "k"), "left_rows")
    assert {r.k: (r.left_rows, r.share) for r in got.collect()} == {"a": (6, 0.75), "b": (2, 0.25)}
    assert Counter(x for (x,) in rows)["a"] == 6


def test_stream_of_operations(spark, tmp_path):
    schema = "k bigint, v string, seq bigint, op string"
    rows = [(i % 7, f"v{i}", i, "D" if i % 11 == 0 else "U") for i in range(60)]
    source = str(tmp_path / "log")
    spark.createDataFrame(rows[30:], schema).write.parquet(source)  # late half first
    run = lambda: follow_log(spark, source, spark.createDataFrame([], schema).schema, str(tmp_path / "delta"), str(tmp_path / "cp")).awaitTermination(60)
    run()
    spark.createDataFrame(rows[:30], schema).write.mode("append").parquet(source)
    run()
    base = spark.createDataFrame([], "k bigint, v string")
    got = published(base, str(tmp_path / "delta"))
    last = {k: (v, op) for k, v, _, op in rows}
    want = manifest(spark.createDataFrame([(k, v) for k, (v, op) in last.items() if op == "U"], "k bigint, v string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
