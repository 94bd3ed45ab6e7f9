"""Queries over the test tables, one or more per operator, with the same in SQL as a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.text import elements, tag_form, tag_forms
from tagweave.operators import nodes as nd
from tagweave.operators.buffer import BufferedMap
from tagweave.operators.eager import eager_join, with_share
from tagweave.operators.keyed import MapTable, SetMapTable, SetTable, latest, pairs_present, unnest
from tagweave.operators.search import TagIndex, decode_requests, respond, search_counts, tokenized, top, unknown_tags
from tagweave.plans.replica import Replica
from tagweave.plans.snapshot import manifest, ranges, root, to_fetch
from tagweave.session import table
from tagweave.sources.json_pages import decode, entries, items_and_tags, rejected

Query = Callable[[SparkSession, str], DataFrame]
WANTED = ["red", "ECONOMY"]
SEPARATORS = [40, 80, 120]


# ---- inputs -------------------------------------------------------------------------------------


def part_index(spark: SparkSession, d: str) -> TagIndex:
    """`part` as items with tags: the words of the name, the brand and the type."""
    part = table(spark, d, "part")
    tags = F.concat(F.split("p_name", " "), F.array("p_brand", "p_type"))
    items = part.select(F.col("p_partkey").alias("id"), tags.alias("tags"), F.col("p_name").alias("thumb"), F.lit(None).cast("string").alias("img"))
    return TagIndex(items, items.select(F.explode("tags").alias("tag"), "id").distinct())


def reply_index(spark: SparkSession, d: str) -> TagIndex:
    """`search_response_info` as items (the last reply of an id) and tags over all its replies."""
    replies = table(spark, d, "search_response_info")
    tags = elements(replies.filter("id IS NOT NULL"), keep=("id",)).distinct()
    items = latest(replies.select("id", "reply_id", "imgurl").filter("reply_id IS NOT NULL"), ["id"], "reply_id")
    return TagIndex(items.select("id", F.lit(None).cast("array<string>").alias("tags"), F.col("imgurl").alias("thumb"), F.col("imgurl").alias("img")), tags)


def reply_records(spark: SparkSession, d: str) -> DataFrame:
    """The replies of `search_response_info` as (id, tags), with the tags in their form; rows of one id
    belong together."""
    return table(spark, d, "search_response_info").filter("id IS NOT NULL").select("id", tag_forms(F.col("tags")).alias("tags"))


def ops(spark: SparkSession, d: str) -> DataFrame:
    """`events` as a log of operations on a map user_id -> event_type."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("k"),
        F.col("event_type").alias("v"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "D").otherwise("U").alias("op"),
    )


def state(spark: SparkSession, d: str) -> MapTable:
    return MapTable.from_log(ops(spark, d))


def last_seq(df: DataFrame, n: int) -> int:
    """The sequence number before which all but the last `n` operations lie."""
    return df.count() - n


# ---- maps ---------------------------------------------------------------------------------------


def map_insert_lww(spark, d):
    return MapTable.from_log(ops(spark, d).drop("op"), op=None).df


def map_insert_many(spark, d):
    log = ops(spark, d).drop("op")
    at = last_seq(log, 100)
    base = MapTable.from_log(log.filter(F.col("seq") < at), op=None)
    return base.insert_many(MapTable.from_log(log.filter(F.col("seq") >= at), op=None).df).df


def map_lookup(spark, d):
    return state(spark, d).lookup(1, 2, 3, 42, 999999)


def map_delete(spark, d):
    return state(spark, d).delete(42).df


def map_replay(spark, d):
    return state(spark, d).df


def map_buffered(spark, d):
    """The same state read as base and delta of the last tenth of the log."""
    log = ops(spark, d)
    at = last_seq(log, log.count() // 10)
    base = MapTable.from_log(log.filter(F.col("seq") < at)).df
    return BufferedMap(base, log.filter(F.col("seq") >= at)).read().df


def map_from_empty(spark, d):
    return MapTable.empty(spark, "k bigint, v string").insert_many(state(spark, d).df).df


def map_insert(spark, d):
    return state(spark, d).insert(42, "new").insert(-5, "first").df


def map_split(spark, d):
    below, above = state(spark, d).split(50)
    return below.df.withColumn("side", F.lit("below")).unionByName(above.df.withColumn("side", F.lit("from")))


def map_written(spark, d):
    """Operations written to the buffer in two batches, the later one first, and read through it."""
    log = ops(spark, d)
    at = last_seq(log, log.count() // 10)
    base = MapTable.from_log(log.filter(F.col("seq") < at - 200)).df
    buffered = BufferedMap(base, log.filter("false")).write(log.filter(F.col("seq") >= at)).write(log.filter((F.col("seq") >= at - 200) & (F.col("seq") < at)))
    return buffered.read().df


def map_compacted(spark, d):
    """The same after the buffer was flushed."""
    log = ops(spark, d)
    at = last_seq(log, log.count() // 10)
    return BufferedMap(MapTable.from_log(log.filter(F.col("seq") < at)).df, log.filter(F.col("seq") >= at)).folded().read().df


# ---- sets ---------------------------------------------------------------------------------------


def _users(spark, d, condition: str) -> SetTable:
    return SetTable.of(table(spark, d, "events").filter(condition), "user_id")


def set_from(spark, d):
    return _users(spark, d, "event_type = 'purchase'").df


def set_is_null(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg((F.count_if(F.col("value") > 1e9) == 0).alias("is_null"))


def set_insert_many(spark, d):
    batch = table(spark, d, "customer").filter("c_custkey < 300").select(F.col("c_custkey").alias("k"))
    return _users(spark, d, "value > 50").insert_many(batch).df


def set_delete(spark, d):
    return _users(spark, d, "true").delete(42).df


def set_member(spark, d):
    probes = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return _users(spark, d, "true").member(probes)


def set_intersection(spark, d):
    low = SetTable.of(table(spark, d, "orders").filter("o_orderpriority = '5-LOW'"), "o_custkey")
    return _users(spark, d, "value > 40").intersection(low).df


def set_union(spark, d):
    dear = SetTable.of(table(spark, d, "orders").filter("o_totalprice > 400000"), "o_custkey")
    return _users(spark, d, "value > 40").union(dear).df


def set_null(spark, d):
    """Whether a set that has members, and one that has none, is null."""
    some, none = _users(spark, d, "true"), _users(spark, d, "value > 1e9")
    return some.null_flag().select(F.lit("some").alias("name"), "is_null").unionByName(none.null_flag().select(F.lit("none").alias("name"), "is_null"))


def set_from_empty(spark, d):
    return SetTable.empty(spark).insert_many(_users(spark, d, "value > 50").df).df


def set_singleton(spark, d):
    return SetTable.singleton(spark, 7).union(_users(spark, d, "value > 1e9")).df


def set_rows(spark, d):
    return _users(spark, d, "value > 50").to_rows()


def set_insert(spark, d):
    return _users(spark, d, "value > 50").insert(-1).insert(-1).df


def set_split(spark, d):
    below, above = _users(spark, d, "true").split(50)
    return below.df.select("k", F.lit("below").alias("side")).unionByName(above.df.select("k", F.lit("from").alias("side")))


# ---- multimaps ----------------------------------------------------------------------------------


def _tag_map(spark, d) -> SetMapTable:
    return SetMapTable(part_index(spark, d).tags.select(F.col("tag").alias("k"), F.col("id").alias("v")))


def setmap_pairs(spark, d):
    return _tag_map(spark, d).df


def setmap_group(spark, d):
    return _tag_map(spark, d).grouped().withColumn("vs", F.array_join(F.col("vs").cast("array<string>"), ","))


def setmap_lookup(spark, d):
    return _tag_map(spark, d).lookup("red").df.select(F.col("k").alias("v"))


def setmap_replay(spark, d):
    e = table(spark, d, "events")
    log = e.select(F.col("event_type").alias("k"), F.col("user_id").alias("v"), F.col("event_id").alias("seq"), F.when(F.col("value") >= 5, "U").otherwise("D").alias("op"))
    return SetMapTable.from_log(log).df


def setmap_state(spark, d):
    """Sizes of the sets at both roots of `hitchhiker_set_map` after its log."""
    log = table(spark, d, "hitchhiker_set_map").select("root", tag_form(F.col("k")).alias("k"), "v", "seq", "op")
    return pairs_present(log, ["root", "k", "v"]).groupBy("root", "k").agg(F.count(F.lit(1)).alias("n"))


def setmap_from_empty(spark, d):
    return SetMapTable.empty(spark).insert_many(_tag_map(spark, d).df).df


def setmap_insert(spark, d):
    return _tag_map(spark, d).insert("red", 0).insert("red", 0).insert("new", 1).df


def setmap_delete(spark, d):
    """Without the smallest id of 'red', and without every pair of 'blue'."""
    tags = _tag_map(spark, d)
    least = tags.lookup("red").df.agg(F.min("k").alias("k")).first().k
    return tags.delete("red", least).delete_many(tags.lookup_many(["blue"])).df


def setmap_split(spark, d):
    below, above = _tag_map(spark, d).split("m")
    return below.df.withColumn("side", F.lit("below")).unionByName(above.df.withColumn("side", F.lit("from")))


def mapset_to_list(spark, d):
    return unnest(table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("vs")), "p_partkey", "vs")


# ---- search -------------------------------------------------------------------------------------


def search_all(spark, d):
    return part_index(spark, d).search(WANTED)


def search_unknown(spark, d):
    return part_index(spark, d).unknown(["red", "nope", "zzz", "nope"])


def lookup_items(spark, d):
    index = part_index(spark, d)
    return index.lookup_items(index.search(WANTED))


def search_top25(spark, d):
    return top(part_index(spark, d).search(["red"]))


def search_requests(spark, d):
    """Hits of every search in `user_cmds` over the tags of `search_response_info`, counted."""
    asked = decode_requests(table(spark, d, "user_cmds")).filter("kind = 'Search' AND cmd_id IS NOT NULL").select("cmd_id", "wanted").dropDuplicates(["cmd_id"])
    return search_counts(reply_records(spark, d), asked)


def search_requests_unknown(spark, d):
    asked = decode_requests(table(spark, d, "user_cmds")).filter("kind = 'Search' AND cmd_id IS NOT NULL").select("cmd_id", "wanted").dropDuplicates(["cmd_id"])
    return unknown_tags(reply_records(spark, d), asked).select("cmd_id", F.col("pos").cast("bigint").alias("pos"), "tag")


def info_requests(spark, d):
    """`Info` requests of `user_cmds` with the picture of the image they name."""
    asked = decode_requests(table(spark, d, "user_cmds")).filter("kind = 'Info' AND cmd_id IS NOT NULL").select("cmd_id", F.col("item").alias("id")).distinct()
    return asked.join(reply_index(spark, d).items.select("id", "img"), "id", "left").select("cmd_id", "id", "img")


def respond_requests(spark, d):
    """The answer to every request of `user_cmds` that can be read."""
    return respond(reply_index(spark, d), table(spark, d, "user_cmds").filter("cmd_id IS NOT NULL"), records=reply_records(spark, d))


def console_search(spark, d):
    return part_index(spark, d).console("red, ECONOMY ANODIZED STEEL").unionByName(part_index(spark, d).console("red, no such tag"))


def console_items(spark, d):
    return part_index(spark, d).console(":showitems").select("status", "id", "thumb")


def console_tags(spark, d):
    return part_index(spark, d).console(":showtags").select("status", "tag", "id")


def tag_index_add(spark, d):
    """Tags and items of an empty index after three entries, two of them of one id."""
    index = TagIndex.empty(spark).add(1, ["a", "b"], "t1", "m1").add(2, ["b"], "t2", "m2").add(1, ["c"], "t1b", "m1b")
    return index.tags.join(index.items.select("id", "thumb"), "id").select("tag", "id", "thumb")


def tokenize_web(spark, d):
    return tokenized(table(spark, d, "documents"), "text", ["doc_id"], web=True)


def tokenize_console(spark, d):
    return tokenized(table(spark, d, "documents"), "text", ["doc_id"], web=False)


def json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


# ---- JSON pages ---------------------------------------------------------------------------------


def pages_items(spark, d):
    """Items after ingesting all pages in the order of (fetched_at, page_id)."""
    order = ["fetched_at", "page_id"]
    ingested = entries(decode(table(spark, d, "image_pages").select(*order, "body").distinct()), order)
    return items_and_tags(ingested, order)[0].select("id", "thumb", "img", F.size("tags").cast("bigint").alias("n_tags"))


def pages_tags(spark, d):
    order = ["fetched_at", "page_id"]
    return items_and_tags(entries(decode(table(spark, d, "image_pages").select(*order, "body").distinct()), order), order)[1]


def pages_rejected(spark, d):
    return rejected(decode(table(spark, d, "image_pages").select("page_id", "body").distinct())).select("page_id").distinct()


# ---- nodes --------------------------------------------------------------------------------------


def node_of_key(spark, d):
    return nd.node_of_key(_users(spark, d, "true").df, nd.bounds_frame(spark, SEPARATORS))


def node_sizes(spark, d):
    """Pairs of `hitchhiker_set_map` by the node of `index_nodes` that holds their value."""
    rows = table(spark, d, "hitchhiker_set_map").filter("v IS NOT NULL").select(F.col("v").alias("k"))
    return nd.node_of_key(rows, table(spark, d, "index_nodes")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


def trim_nodes(spark, d):
    return nd.trim(nd.bounds_frame(spark, SEPARATORS), 80, 100).select("node_id")


def index_triples(spark, d):
    return nd.neighbours(table(spark, d, "part").select(F.col("p_size").alias("lo")), "lo")


def leaf_split(spark, d):
    return nd.leaf_layout(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), "k", 127)


def index_from_list(spark, d):
    return nd.bounds_frame(spark, SEPARATORS).unionByName(nd.bounds_frame(spark, []).withColumn("node_id", F.lit(99).cast("bigint")))


def index_size(spark, d):
    return nd.size(table(spark, d, "index_nodes")).unionByName(nd.size(nd.bounds_frame(spark, []))).unionByName(nd.size(nd.bounds_frame(spark, []).limit(0)))


def index_joined(spark, d):
    """The index that was cut at 80, put together again."""
    left, right = nd.parted(nd.bounds_frame(spark, SEPARATORS), 80)
    return nd.joined(left, 80, right.withColumn("node_id", F.col("node_id") - 2))


def index_parted(spark, d):
    left, right = nd.parted(nd.bounds_frame(spark, SEPARATORS), 80)
    return left.withColumn("side", F.lit("below")).unionByName(right.withColumn("side", F.lit("from")))


def index_ends(spark, d):
    first, last = nd.ends(table(spark, d, "index_nodes"))
    return first.select("node_id", F.lit("first").alias("at")).unionByName(last.select("node_id", F.lit("last").alias("at")))


def key_places(spark, d):
    """Of each customer's key, the numbers of users below it and up to it."""
    users, probes = _users(spark, d, "true").df, table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    below = nd.lower_bound(users, probes).withColumnRenamed("place", "below")
    return below.join(nd.lower_bound(users, probes, or_equal=True).withColumnRenamed("place", "up_to"), "k")


def _contents(spark, d):
    return nd.node_of_key(state(spark, d).df, nd.bounds_frame(spark, SEPARATORS))


def node_contents(spark, d):
    """Rows of the node at place 2."""
    return _contents(spark, d).filter("node_id = 2").select("k", "v")


def node_changed(spark, d):
    """All rows, with those of the node at place 2 changed."""
    return nd.mapped(_contents(spark, d), lambda rows: rows.withColumn("v", F.upper("v")), node=2)


def nodes_with_bounds(spark, d):
    """Of each node, its bounds and the rows between them."""
    sizes = _contents(spark, d).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    return nd.bounds_frame(spark, SEPARATORS).join(sizes, "node_id")


# ---- snapshots ----------------------------------------------------------------------------------


def publish_manifest(spark, d):
    return manifest(state(spark, d).df).select("node_id", "n_rows", "hash")


def publish_root(spark, d):
    """Rows and hash of the root."""
    return root(manifest(state(spark, d).df))


def publish_tags(spark, d):
    """Manifest of a map with text keys: each tag of `part` with its number of ids."""
    return ranges(_tag_map(spark, d).sizes().withColumnRenamed("n", "v")).select("lo", "hi", "n_rows", "hash")


def publish_diff(spark, d):
    log = ops(spark, d)
    old = MapTable.from_log(log.filter(F.col("seq") < last_seq(log, 10)))
    return to_fetch(manifest(state(spark, d).df), manifest(old.df)).select("node_id", "hash")


def subscriber_lookup(spark, d):
    """A replica that fetched nodes 0 to 4 looks up every user."""
    source = state(spark, d).df
    nodes = manifest(source)
    wanted = nodes.filter("node_id <= 4").select("node_id", "hash")
    replica = Replica.from_root(nodes).fetched(wanted, source.filter("k < 80"))
    keys = _users(spark, d, "true").df
    # a key beyond the manifest's nodes is absent; the SQL counts every node above 4 as not held
    return replica.lookup(keys)


def _early_replica(spark, d) -> tuple[Replica, DataFrame]:
    """A replica that fetched nodes 0 to 4 before the last tenth of the log, and the manifest of now."""
    log = ops(spark, d)
    old = MapTable.from_log(log.filter(F.col("seq") < last_seq(log, log.count() // 10))).df
    nodes = manifest(old)
    return Replica.from_root(nodes).fetched(nodes.filter("node_id <= 4").select("node_id", "hash"), old.filter("k < 80")), manifest(state(spark, d).df)


def subscriber_ensure(spark, d):
    """Nodes to fetch for the keys 20 to 130."""
    return _early_replica(spark, d)[0].ensure_range(20, 130).select("node_id")


def subscriber_update(spark, d):
    """Nodes to fetch after the root has changed."""
    replica, now = _early_replica(spark, d)
    return replica.update_root(now).missing().select("node_id", "hash")


# ---- a few keys holding most records ------------------------------------------------------------


def p1_tags(spark, d):
    """Of each tag of `search_response_info`: elements (every row counts), ids that hold it, and its
    share of all elements that are tags. Tags of rows with a null id only have 0 ids. An empty table
    gives no rows. The two inputs are the elements of replies without an id and of those with one: each
    is brought to one state per tag, the states meet in a full join, and their counts add up."""
    replies = table(spark, d, "search_response_info")
    nameless = elements(replies.filter("id IS NULL"), keep=())
    held = elements(replies.filter("id IS NOT NULL"), keep=("id",))
    joined = eager_join(nameless, held, "tag", how="full", distinct_right="id").withColumn("n_elements", F.col("left_rows") + F.col("right_rows"))
    return with_share(joined, "n_elements").select("tag", "n_elements", F.col("right_distinct").alias("n_ids"), "share")


def p1_index_join(spark, d):
    """Of each tag: rows of the join of its elements with its operations at root `tags` of
    `hitchhiker_set_map`, and the sum of the operations' numbers over that join; no row of the join
    is made."""
    rows = elements(table(spark, d, "search_response_info"), keep=())
    log = table(spark, d, "hitchhiker_set_map").filter("root = 'tags' AND v IS NOT NULL").select(tag_form(F.col("k")).alias("tag"), "seq").filter("tag != ''")
    return eager_join(rows, log, "tag", right_sums=["seq"]).select("tag", F.col("left_rows").alias("n_elements"), F.col("right_rows").alias("n_ops"), "join_rows", F.col("right_sum_seq").alias("sum_seq"))


def p1_found(spark, d):
    """Tags that make up more than 3 % of all elements that are tags."""
    return p1_tags(spark, d).filter("share > 0.03").select("tag")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        map_insert_lww, map_insert_many, map_lookup, map_delete, map_replay, map_buffered,
        set_from, set_is_null, set_insert_many, set_delete, set_member, set_intersection, set_union,
        setmap_pairs, setmap_group, setmap_lookup, setmap_replay, setmap_state, mapset_to_list,
        search_all, search_unknown, lookup_items, search_top25, search_requests, search_requests_unknown, info_requests,
        tokenize_web, tokenize_console, json_field, pages_items, pages_tags, pages_rejected,
        node_of_key, node_sizes, trim_nodes, index_triples, leaf_split,
        publish_manifest, publish_root, publish_diff, subscriber_lookup,
        map_from_empty, map_insert, map_split, map_written, map_compacted,
        set_null, set_from_empty, set_singleton, set_rows, set_insert, set_split,
        setmap_from_empty, setmap_insert, setmap_delete, setmap_split,
        respond_requests, console_search, console_items, console_tags, tag_index_add,
        index_from_list, index_size, index_joined, index_parted, index_ends, key_places, node_contents, node_changed, nodes_with_bounds,
        publish_tags, subscriber_ensure, subscriber_update,
        p1_found, p1_tags, p1_index_join,
    )
}

# ---- the same in SQL ----------------------------------------------------------------------------

_TAGS = "tags AS (SELECT DISTINCT unnest(list_concat(string_split(p_name,' '),[p_brand,p_type])) AS tag, p_partkey AS id FROM part)"
_OPS = "ops AS (SELECT user_id AS k, event_type AS v, event_id AS seq, CASE WHEN event_type='error' THEN 'D' ELSE 'U' END AS op FROM events)"
_STATE = _OPS + ", state AS (SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM ops) WHERE rn=1 AND op='U')"
_NODES = "nodes AS (SELECT * FROM (VALUES (0,NULL,40),(1,40,80),(2,80,120),(3,120,NULL)) AS t(node_id,lo,hi))"
_HASH = "sha256(count(*)::VARCHAR||';'||string_agg(length(k::VARCHAR)||':'||k||CASE WHEN v IS NULL THEN '-' ELSE '+'||length(v::VARCHAR)||':'||v END, '' ORDER BY k))"
_MAN = f"man AS (SELECT k//16 AS node_id, count(*) AS n_rows, {_HASH} AS hash FROM state GROUP BY 1)"
_OLD = f"old AS (SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM ops WHERE seq < (SELECT count(*) - count(*)//10 FROM ops)) WHERE rn=1 AND op='U'), old_man AS (SELECT k//16 AS node_id, {_HASH} AS hash FROM old GROUP BY 1)"
_UP = "SELECT node_id//64 AS node_id, sha256(string_agg(node_id::VARCHAR||':'||hash, ',' ORDER BY node_id)) AS hash FROM"


def form_sql(column: str) -> str:
    return rf"lower(trim(regexp_replace({column}, '[ \t\x{{00A0}}_]+', ' ', 'g')))"


#: elements (tag, id) of every reply; record tags (tag, id) without repetition
ELEMENTS_SQL = f"el AS (SELECT tag, id FROM (SELECT {form_sql('raw')} AS tag, id FROM (SELECT unnest(tags) AS raw, id FROM search_response_info)) WHERE tag <> '')"
RECORDS_SQL = ELEMENTS_SQL + ", rec AS (SELECT DISTINCT tag, id FROM el WHERE id IS NOT NULL)"
_PAGES = """pg AS (SELECT DISTINCT page_id, fetched_at, body FROM image_pages),
 ok AS (SELECT * FROM pg WHERE json_valid(body) AND coalesce(json_type(body,'$.images'),'') = 'ARRAY'),
 im AS (SELECT page_id, fetched_at, body, unnest(CAST(json_extract(body,'$.images[*]') AS JSON[])) AS i, unnest(range(len(json_extract(body,'$.images[*]')))) AS pos FROM ok),
 ch AS (SELECT *, coalesce(json_type(i,'$.id') IN ('UBIGINT','BIGINT') AND json_type(i,'$.tags')='ARRAY' AND json_type(i,'$.representations.thumb')='VARCHAR' AND json_type(i,'$.representations.medium')='VARCHAR'
   AND len(list_filter(CAST(json_extract(i,'$.tags[*]') AS JSON[]), lambda t: json_type(t)<>'VARCHAR'))=0, false) AS good FROM im),
 bad AS (SELECT page_id, fetched_at, body FROM ch WHERE NOT good UNION SELECT page_id, fetched_at, body FROM pg WHERE body IS NULL OR NOT (json_valid(body) AND coalesce(json_type(body,'$.images'),'') = 'ARRAY')),
 en AS (SELECT CAST(json_extract(i,'$.id') AS BIGINT) AS id, fetched_at, page_id, pos, CAST(json_extract_string(i,'$.tags[*]') AS VARCHAR[]) AS tags, json_extract_string(i,'$.representations.thumb') AS thumb, json_extract_string(i,'$.representations.medium') AS img
   FROM ch c WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.page_id IS NOT DISTINCT FROM c.page_id AND b.fetched_at IS NOT DISTINCT FROM c.fetched_at AND b.body IS NOT DISTINCT FROM c.body))"""
_CMDS = """rq AS (SELECT DISTINCT cmd_id, body FROM user_cmds WHERE cmd_id IS NOT NULL AND json_valid(body)),
 sq AS (SELECT cmd_id, CAST(json_extract_string(body,'$.contents[*]') AS VARCHAR[]) AS wanted FROM rq WHERE json_extract_string(body,'$.tag')='Search' AND json_type(body,'$.contents')='ARRAY'
   AND len(list_filter(CAST(json_extract(body,'$.contents[*]') AS JSON[]), lambda t: json_type(t)<>'VARCHAR'))=0),
 iq AS (SELECT cmd_id, CAST(json_extract(body,'$.contents') AS BIGINT) AS id FROM rq WHERE json_extract_string(body,'$.tag')='Info' AND json_type(body,'$.contents') IN ('UBIGINT','BIGINT'))"""

SQL: dict[str, str] = {
    "map_insert_lww": "SELECT user_id AS k, arg_max(event_type, event_id) AS v FROM events GROUP BY 1",
    "map_insert_many": "WITH b AS (SELECT user_id AS k, arg_max(event_type,event_id) AS v FROM events WHERE event_id < (SELECT count(*) - 100 FROM events) GROUP BY 1), d AS (SELECT user_id AS k, arg_max(event_type,event_id) AS v FROM events WHERE event_id >= (SELECT count(*) - 100 FROM events) GROUP BY 1) SELECT k, v FROM d UNION ALL SELECT k, v FROM b WHERE k NOT IN (SELECT k FROM d)",
    "map_lookup": f"WITH {_STATE} SELECT k, v FROM state WHERE k IN (1, 2, 3, 42, 999999)",
    "map_delete": f"WITH {_STATE} SELECT k, v FROM state WHERE k <> 42",
    "map_replay": f"WITH {_STATE} SELECT k, v FROM state",
    "map_buffered": f"WITH {_STATE} SELECT k, v FROM state",
    "set_from": "SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'purchase'",
    "set_is_null": "SELECT event_type AS name, count(*) FILTER (WHERE value > 1e9) = 0 AS is_null FROM events GROUP BY 1",
    "set_insert_many": "SELECT user_id AS k FROM events WHERE value > 50 UNION SELECT c_custkey FROM customer WHERE c_custkey < 300",
    "set_delete": "SELECT DISTINCT user_id AS k FROM events WHERE user_id <> 42",
    "set_member": "SELECT c_custkey AS k, c_custkey IN (SELECT user_id FROM events) AS is_member FROM customer",
    "set_intersection": "SELECT user_id AS k FROM events WHERE value > 40 INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'",
    "set_union": "SELECT user_id AS k FROM events WHERE value > 40 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 400000",
    "setmap_pairs": f"WITH {_TAGS} SELECT tag AS k, id AS v FROM tags",
    "setmap_group": f"WITH {_TAGS} SELECT tag AS k, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS vs FROM tags GROUP BY 1",
    "setmap_lookup": f"WITH {_TAGS} SELECT id AS v FROM tags WHERE tag = 'red'",
    "setmap_replay": "SELECT k, v FROM (SELECT event_type AS k, user_id AS v, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1 AND value >= 5",
    "setmap_state": f"SELECT root, k, count(*) AS n FROM (SELECT root, k, v, arg_max(op, seq) AS op FROM (SELECT root, {form_sql('k')} AS k, v, op, seq FROM hitchhiker_set_map WHERE k IS NOT NULL AND v IS NOT NULL AND root IS NOT NULL) GROUP BY ALL) WHERE op = 'U' GROUP BY ALL",
    "mapset_to_list": "SELECT p_partkey AS k, unnest(string_split(p_name,' ')) AS v FROM part",
    "search_all": f"WITH {_TAGS} SELECT id FROM tags WHERE tag IN ('red','ECONOMY') GROUP BY id HAVING count(DISTINCT tag) = 2",
    "search_unknown": f"WITH {_TAGS}, q AS (SELECT * FROM (VALUES (0,'red'),(1,'nope'),(2,'zzz'),(3,'nope')) AS t(pos,tag)) SELECT pos::BIGINT AS pos, tag FROM q WHERE tag NOT IN (SELECT tag FROM tags)",
    "lookup_items": f"WITH {_TAGS} SELECT p.p_partkey AS id, p.p_name AS thumb FROM part p JOIN (SELECT id FROM tags WHERE tag IN ('red','ECONOMY') GROUP BY id HAVING count(DISTINCT tag) = 2) s ON s.id = p.p_partkey",
    "search_top25": f"WITH {_TAGS} SELECT id, count(*) OVER () AS n_found FROM tags WHERE tag = 'red' ORDER BY id LIMIT 25",
    "search_requests": f"WITH {RECORDS_SQL}, {_CMDS}, q AS (SELECT cmd_id, unnest(list_distinct(wanted)) AS tag, len(list_distinct(wanted)) AS n FROM sq), h AS (SELECT cmd_id, id FROM q JOIN rec USING (tag) GROUP BY cmd_id, id, n HAVING count(*) = n) SELECT cmd_id, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM h GROUP BY 1",
    "search_requests_unknown": f"WITH {RECORDS_SQL}, {_CMDS}, q AS (SELECT cmd_id, unnest(wanted) AS tag, unnest(range(len(wanted))) AS pos FROM sq) SELECT cmd_id, pos, tag FROM q WHERE tag NOT IN (SELECT tag FROM rec)",
    "info_requests": f"WITH {_CMDS}, it AS (SELECT id, arg_max(imgurl, reply_id) AS any_img, (SELECT r.imgurl FROM search_response_info r WHERE r.id = s.id ORDER BY reply_id DESC LIMIT 1) AS img FROM search_response_info s WHERE id IS NOT NULL AND reply_id IS NOT NULL GROUP BY id) SELECT DISTINCT cmd_id, iq.id AS id, it.img AS img FROM iq LEFT JOIN it ON iq.id = it.id",
    "tokenize_web": r"SELECT doc_id, unnest(list_filter(list_transform(string_split(text,','), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS tag FROM documents",
    "tokenize_console": "SELECT doc_id, unnest(string_split_regex(text, ', *')) AS tag FROM documents",
    "json_field": "SELECT event_id, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events",
    "pages_items": f"WITH {_PAGES} SELECT id, thumb, img, CAST(len(tags) AS BIGINT) AS n_tags FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, page_id DESC NULLS LAST, pos DESC) AS rn FROM en) WHERE rn = 1",
    "pages_tags": f"WITH {_PAGES} SELECT DISTINCT unnest(tags) AS tag, id FROM en",
    "pages_rejected": f"WITH {_PAGES} SELECT DISTINCT page_id FROM bad",
    "node_of_key": f"WITH {_NODES} SELECT DISTINCT e.user_id AS k, n.node_id::BIGINT AS node_id FROM events e JOIN nodes n ON (n.lo IS NULL OR e.user_id >= n.lo) AND (n.hi IS NULL OR e.user_id < n.hi)",
    "node_sizes": "SELECT n.node_id::BIGINT AS node_id, count(*) AS n FROM hitchhiker_set_map h JOIN index_nodes n ON (n.lo IS NULL OR h.v >= n.lo) AND (n.hi IS NULL OR h.v < n.hi) GROUP BY 1",
    "trim_nodes": f"WITH {_NODES} SELECT node_id::BIGINT AS node_id FROM nodes WHERE (lo IS NULL OR lo <= 100) AND (hi IS NULL OR hi > 80)",
    "index_triples": "WITH b AS (SELECT DISTINCT p_size AS lo FROM part) SELECT lag(lo) OVER (ORDER BY lo) AS prev, lo, lead(lo) OVER (ORDER BY lo) AS next FROM b",
    "leaf_split": "WITH r AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey)-1 AS i, count(*) OVER () AS n FROM customer), c AS (SELECT *, CASE WHEN n <= 2*127 THEN 0 ELSE (n - 2*127 + 126)//127 END AS full_leaves FROM r), d AS (SELECT *, n - full_leaves*127 AS rest FROM c) SELECT k, CASE WHEN i < full_leaves*127 THEN i//127 WHEN rest <= 127 THEN full_leaves WHEN i - full_leaves*127 < rest//2 THEN full_leaves ELSE full_leaves+1 END AS leaf FROM d",
    "publish_manifest": f"WITH {_STATE}, {_MAN} SELECT node_id, n_rows, hash FROM man",
    "publish_root": f"WITH {_STATE}, {_MAN}, u1 AS ({_UP} man GROUP BY 1), u2 AS ({_UP} u1 GROUP BY 1), u3 AS ({_UP} u2 GROUP BY 1), m AS (SELECT max(node_id) AS b FROM man) SELECT (SELECT count(*) FROM state) AS n_rows, sha256((SELECT CASE WHEN b = 0 THEN (SELECT max(hash) FROM man) WHEN b < 64 THEN (SELECT max(hash) FROM u1) WHEN b < 4096 THEN (SELECT max(hash) FROM u2) ELSE (SELECT max(hash) FROM u3) END FROM m)) AS hash",
    "map_from_empty": f"WITH {_STATE} SELECT k, v FROM state",
    "map_insert": f"WITH {_STATE} SELECT k, v FROM state WHERE k <> 42 UNION ALL SELECT * FROM (VALUES (42, 'new'), (-5, 'first')) AS t(k, v)",
    "map_split": f"WITH {_STATE} SELECT k, v, CASE WHEN k < 50 THEN 'below' ELSE 'from' END AS side FROM state",
    "map_written": f"WITH {_STATE} SELECT k, v FROM state",
    "map_compacted": f"WITH {_STATE} SELECT k, v FROM state",
    "set_null": "SELECT 'some' AS name, count(*) = 0 AS is_null FROM events WHERE user_id IS NOT NULL UNION ALL SELECT 'none', count(*) = 0 FROM events WHERE value > 1e9 AND user_id IS NOT NULL",
    "set_from_empty": "SELECT DISTINCT user_id AS k FROM events WHERE value > 50 AND user_id IS NOT NULL",
    "set_singleton": "SELECT 7::BIGINT AS k UNION SELECT user_id FROM events WHERE value > 1e9",
    "set_rows": "SELECT DISTINCT user_id AS k FROM events WHERE value > 50 AND user_id IS NOT NULL ORDER BY k",
    "set_insert": "SELECT user_id AS k FROM events WHERE value > 50 UNION SELECT -1",
    "set_split": "SELECT DISTINCT user_id AS k, CASE WHEN user_id < 50 THEN 'below' ELSE 'from' END AS side FROM events",
    "setmap_from_empty": f"WITH {_TAGS} SELECT tag AS k, id AS v FROM tags",
    "setmap_insert": f"WITH {_TAGS} SELECT tag AS k, id AS v FROM tags UNION SELECT * FROM (VALUES ('red', 0), ('new', 1)) AS t(k, v)",
    "setmap_delete": f"WITH {_TAGS} SELECT tag AS k, id AS v FROM tags WHERE tag <> 'blue' AND NOT (tag = 'red' AND id = (SELECT min(id) FROM tags WHERE tag = 'red'))",
    "setmap_split": f"WITH {_TAGS} SELECT tag AS k, id AS v, CASE WHEN tag < 'm' THEN 'below' ELSE 'from' END AS side FROM tags",
    "console_search": f"WITH {_TAGS} SELECT 'OK' AS status, NULL::VARCHAR AS tag, p.p_partkey AS id, p.p_name AS thumb FROM part p JOIN (SELECT id FROM tags WHERE tag IN ('red','ECONOMY ANODIZED STEEL') GROUP BY id HAVING count(*) = 2) s ON s.id = p.p_partkey UNION ALL SELECT 'INVALID TAG', q.tag, NULL, NULL FROM (VALUES ('red'), ('ECONOMY ANODIZED STEEL'), ('red'), ('no such tag')) AS q(tag) WHERE q.tag NOT IN (SELECT tag FROM tags)",
    "console_items": "SELECT 'ITEM' AS status, p_partkey AS id, p_name AS thumb FROM part",
    "console_tags": f"WITH {_TAGS} SELECT 'TAG' AS status, tag, id FROM tags",
    "tag_index_add": "SELECT * FROM (VALUES ('a', 1, 't1b'), ('b', 1, 't1b'), ('c', 1, 't1b'), ('b', 2, 't2')) AS t(tag, id, thumb)",
    "index_from_list": f"WITH {_NODES} SELECT node_id::BIGINT AS node_id, lo::BIGINT AS lo, hi::BIGINT AS hi FROM nodes UNION ALL SELECT 99, NULL, NULL",
    "index_size": "SELECT count(*) AS n_nodes, count(lo) AS n_separators FROM index_nodes UNION ALL SELECT 1, 0 UNION ALL SELECT 0, 0",
    "index_joined": f"WITH {_NODES} SELECT node_id::BIGINT AS node_id, lo::BIGINT AS lo, hi::BIGINT AS hi FROM nodes",
    "index_parted": f"WITH {_NODES} SELECT node_id::BIGINT AS node_id, nullif(lo, 80)::BIGINT AS lo, nullif(hi, 80)::BIGINT AS hi, CASE WHEN node_id < 2 THEN 'below' ELSE 'from' END AS side FROM nodes",
    "index_ends": "SELECT node_id, 'first' AS at FROM index_nodes WHERE lo IS NULL UNION ALL SELECT node_id, 'last' FROM index_nodes WHERE hi IS NULL",
    "key_places": "WITH u AS (SELECT DISTINCT user_id AS k FROM events WHERE user_id IS NOT NULL) SELECT c_custkey AS k, (SELECT count(*) FROM u WHERE u.k < c_custkey) AS below, (SELECT count(*) FROM u WHERE u.k <= c_custkey) AS up_to FROM customer",
    "node_contents": f"WITH {_STATE} SELECT k, v FROM state WHERE k >= 80 AND k < 120",
    "node_changed": f"WITH {_STATE}, {_NODES} SELECT k, CASE WHEN node_id = 2 THEN upper(v) ELSE v END AS v, node_id::BIGINT AS node_id FROM state JOIN nodes ON (lo IS NULL OR k >= lo) AND (hi IS NULL OR k < hi)",
    "nodes_with_bounds": f"WITH {_STATE}, {_NODES} SELECT node_id::BIGINT AS node_id, lo::BIGINT AS lo, hi::BIGINT AS hi, count(*) AS n FROM state JOIN nodes ON (lo IS NULL OR k >= lo) AND (hi IS NULL OR k < hi) GROUP BY ALL",
    "publish_tags": f"WITH {_TAGS}, s AS (SELECT tag AS k, count(*) AS v FROM tags GROUP BY 1), p AS (SELECT *, max(CASE WHEN ('0x'||substr(md5(k), 1, 8))::UBIGINT % 16 = 0 THEN k END) OVER (ORDER BY k) AS lo FROM s), g AS (SELECT lo, count(*) AS n_rows, {_HASH} AS hash FROM p GROUP BY lo) SELECT lo, lead(lo) OVER (ORDER BY lo NULLS FIRST) AS hi, n_rows, hash FROM g",
    "subscriber_ensure": f"WITH {_STATE}, {_OLD} SELECT node_id FROM old_man WHERE node_id BETWEEN 20//16 AND 130//16 AND hash NOT IN (SELECT hash FROM old_man WHERE node_id <= 4)",
    "subscriber_update": f"WITH {_STATE}, {_MAN}, {_OLD} SELECT node_id, hash FROM man WHERE hash NOT IN (SELECT hash FROM old_man WHERE node_id <= 4)",
    "respond_requests": f"""WITH {RECORDS_SQL}, {_CMDS}, it AS (SELECT id, (arg_max(row(imgurl), reply_id))[1] AS img FROM search_response_info WHERE id IS NOT NULL AND reply_id IS NOT NULL GROUP BY id),
 q AS (SELECT cmd_id, unnest(list_distinct(wanted)) AS tag, len(list_distinct(wanted)) AS n FROM sq), h AS (SELECT cmd_id, id FROM q JOIN rec USING (tag) GROUP BY cmd_id, id, n HAVING count(*) = n),
 ok AS (SELECT cmd_id, string_agg('['||id||','||coalesce(to_json(img)::VARCHAR, 'null')||']', ',' ORDER BY id) AS body FROM h JOIN it USING (id) GROUP BY 1),
 un AS (SELECT cmd_id, list(tag ORDER BY pos) AS bad FROM (SELECT cmd_id, unnest(wanted) AS tag, unnest(range(len(wanted))) AS pos FROM sq) WHERE tag NOT IN (SELECT tag FROM rec) GROUP BY 1)
 SELECT cmd_id, CASE WHEN bad IS NOT NULL THEN '{{"tag":"BadTag","contents":'||to_json(bad)::VARCHAR||'}}' ELSE '{{"tag":"OK","contents":['||coalesce(body, '')||']}}' END AS response FROM sq LEFT JOIN ok USING (cmd_id) LEFT JOIN un USING (cmd_id)
 UNION ALL SELECT cmd_id, CASE WHEN it.id IS NULL THEN '{{"tag":"Info","contents":null}}' ELSE '{{"tag":"Info","contents":{{"id":'||it.id||',"tags":null,"img":'||coalesce(to_json(img)::VARCHAR, 'null')||'}}}}' END FROM iq LEFT JOIN it ON it.id = iq.id""",
    "publish_diff": f"WITH {_STATE}, {_MAN}, old_state AS (SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM ops WHERE seq < (SELECT count(*) - 10 FROM ops)) WHERE rn=1 AND op='U'), old_man AS (SELECT k//16 AS node_id, {_HASH} AS hash FROM old_state GROUP BY 1) SELECT node_id, hash FROM man WHERE hash NOT IN (SELECT hash FROM old_man)",
    "subscriber_lookup": f"WITH {_STATE}, live AS (SELECT DISTINCT k//16 AS node_id FROM state) SELECT q.k, CASE WHEN q.k//16 NOT IN (SELECT node_id FROM live) THEN 'ABSENT' WHEN q.k//16 > 4 THEN 'FETCH' WHEN s.k IS NULL THEN 'ABSENT' ELSE 'FOUND' END AS status, CASE WHEN q.k//16 <= 4 THEN s.v END AS v FROM (SELECT DISTINCT user_id AS k FROM events) q LEFT JOIN state s ON s.k = q.k",
    "p1_found": f"WITH {ELEMENTS_SQL} SELECT tag FROM el GROUP BY tag HAVING count(*) > 0.03 * (SELECT count(*) FROM el)",
    "p1_tags": f"WITH {ELEMENTS_SQL} SELECT tag, count(*) AS n_elements, count(DISTINCT id) AS n_ids, count(*)::DOUBLE / (SELECT count(*) FROM el) AS share FROM el GROUP BY tag",
    "p1_index_join": f"WITH {ELEMENTS_SQL}, a AS (SELECT tag, count(*) AS n FROM el GROUP BY 1), b AS (SELECT {form_sql('k')} AS tag, count(*) AS n, sum(seq) AS s FROM hitchhiker_set_map WHERE root = 'tags' AND k IS NOT NULL AND v IS NOT NULL GROUP BY 1) SELECT tag, a.n AS n_elements, b.n AS n_ops, a.n * b.n AS join_rows, CAST(a.n * b.s AS BIGINT) AS sum_seq FROM a JOIN b USING (tag)",
}
