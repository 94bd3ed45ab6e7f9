"""Conjunctive tag search over an inverted index, item lookup, and the JSON request protocol."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions.text import split_console, split_web
from tagweave.operators.blocks import count_hits, list_hits, tag_sets, tell_hits
from tagweave.operators.keyed import MapTable
from tagweave.session import cut


@dataclass(frozen=True)
class TagIndex:
    """`items` (id, tags, thumb, img), unique id; `tags` (tag, id), unique pairs."""

    items: DataFrame
    tags: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> TagIndex:
        """Neither items nor tags."""
        return cls(spark.createDataFrame([], "id bigint, tags array<string>, thumb string, img string"), spark.createDataFrame([], "tag string, id bigint"))

    def add(self, entry_id: int, tags: list[str], thumb: str, img: str) -> TagIndex:
        """With one more entry: it replaces the item of its id, and takes no tag away."""
        spark = self.items.sparkSession
        item = spark.createDataFrame([(entry_id, tags, thumb, img)], "id bigint, tags array<string>, thumb string, img string")
        pairs = spark.createDataFrame([(t, entry_id) for t in tags], "tag string, id bigint")
        return TagIndex(MapTable(self.items, "id").insert_many(item).df, self.tags.unionByName(pairs).distinct())

    def search(self, wanted: list[str]) -> DataFrame:
        """Ids that hold every wanted tag. Repeated tags count once; an unknown tag, or no tag at
        all, gives no id."""
        want = list(dict.fromkeys(wanted))
        if not want:
            return self.tags.select("id").limit(0)
        hits = self.tags.filter(F.col("tag").isin(*want))
        return hits.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(want)).select("id")

    def unknown(self, wanted: list[str]) -> DataFrame:
        """(pos, tag) of the wanted tags that no id holds, in input order, repetitions kept."""
        spark = self.tags.sparkSession
        asked = spark.createDataFrame(list(enumerate(wanted)), "pos bigint, tag string")
        known = self.tags.filter(F.col("tag").isin(*dict.fromkeys(wanted))) if wanted else self.tags.limit(0)
        return asked.join(known.select("tag").distinct(), "tag", "left_anti").select("pos", "tag").orderBy("pos")

    def lookup_items(self, ids: DataFrame) -> DataFrame:
        """(id, thumb) of the ids that have an item, ascending."""
        return self.items.select("id", "thumb").join(ids.select("id"), "id", "left_semi").orderBy("id")

    def console(self, line: str) -> DataFrame:
        """A console line: rows (status 'INVALID TAG', tag), else rows ('OK', id, thumb); a command lists
        all items or tags, see `shown`."""
        spark = self.tags.sparkSession
        if line.strip() in (":showitems", ":showtags"):
            return self.shown(line.strip())
        wanted = spark.range(1).select(split_console(F.lit(line)).alias("t")).first().t
        bad = self.unknown(wanted).select(F.lit("INVALID TAG").alias("status"), "tag", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("thumb"))
        good = self.lookup_items(self.search(wanted)).select(F.lit("OK").alias("status"), F.lit(None).cast("string").alias("tag"), "id", "thumb")
        return bad.unionByName(good)

    def shown(self, command: str) -> DataFrame:
        """What the console's ':showitems' and ':showtags' list, in the columns of `console`: status 'ITEM'
        with id and thumb, or 'TAG' with a tag and each id that holds it."""
        if command == ":showitems":
            return self.items.select(F.lit("ITEM").alias("status"), F.lit(None).cast("string").alias("tag"), "id", "thumb")
        return self.tags.select(F.lit("TAG").alias("status"), "tag", "id", F.lit(None).cast("string").alias("thumb"))

    def info(self, *ids: int) -> DataFrame:
        return self.items.filter(F.col("id").isin(*ids)).select("id", "tags", "img")


def top(ids: DataFrame, n: int = 25) -> DataFrame:
    """The first `n` ids with the number of all: a count and a top-k, no global window."""
    total = ids.agg(F.count(F.lit(1))).scalar()
    return ids.orderBy("id").limit(n).withColumn("n_found", total)


def decode_requests(cmds: DataFrame, body: str = "body") -> DataFrame:
    """`cmds` with `kind` ('Search', 'Info' or null), `wanted` (array of tags) and `item` (id).

    Text that is no JSON, an unknown kind and contents of the wrong type are null: ignored.
    """
    request = F.try_parse_json(F.col(body))
    contents = F.try_variant_get(request, "$.contents", "variant")
    shape = F.schema_of_variant(contents)
    asked = F.try_variant_get(request, "$.contents", "array<string>")
    is_search = shape.isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(asked, lambda t: t.isNull())
    named = F.try_variant_get(request, "$.tag", "string")
    kind = F.when((named == "Search") & is_search, "Search").when((named == "Info") & (shape == "BIGINT"), "Info")
    return (
        cmds.withColumn("kind", kind)
        .withColumn("wanted", F.when(F.col("kind") == "Search", asked))
        .withColumn("item", F.when(F.col("kind") == "Info", F.try_variant_get(request, "$.contents", "bigint")))
    )


def search_batch(tags: DataFrame, requests: DataFrame, key: str = "cmd_id", wanted: str = "wanted") -> tuple[DataFrame, DataFrame]:
    """Answer many searches at once: (hits, unknown).

    hits (key, id): as `TagIndex.search` for every request. unknown (key, pos, tag): tags that no id
    holds; such a request has no hits. Requests with the same tags are answered once, see `blocks`.
    """
    records = tags.select("id", F.array("tag").alias("tags"))
    return list_hits(records, tag_sets(requests, key, wanted), key), unknown_tags(records, requests, key, wanted)


def unknown_tags(records: DataFrame, requests: DataFrame, key: str = "cmd_id", wanted: str = "wanted") -> DataFrame:
    """(key, pos, tag) of the wanted tags that no id of `records` (id, tags) holds."""
    known = records.filter("id IS NOT NULL").select(F.explode("tags").alias("tag")).distinct()
    return requests.select(F.col(key), F.posexplode(wanted).alias("pos", "tag")).join(known, "tag", "left_anti").select(key, "pos", "tag")


def search_counts(records: DataFrame, requests: DataFrame, key: str = "cmd_id", wanted: str = "wanted") -> DataFrame:
    """(key, n, first_id, last_id) of the requests that have hits among `records` (id, tags), whose rows
    of one id belong together; no row per hit is made."""
    return count_hits(records, tag_sets(requests, key, wanted), key)


def respond(index: TagIndex, cmds: DataFrame, key: str = "cmd_id", records: DataFrame | None = None) -> DataFrame:
    """(key, response): the JSON answer to each request that can be read.

    {"tag":"OK","contents":[[id,thumb],...]} ascending by id, {"tag":"BadTag","contents":[...]} with
    the unknown tags in input order, {"tag":"Info","contents":{id,tags,img}} with null for an unknown
    id; a known image without tags or a picture has null in their place. A response is one message and holds all of its rows.
    `records` (id, tags, several rows of an id allowed) stand in for the index's tags where they are at hand.
    """
    asked = decode_requests(cmds).filter("kind IS NOT NULL").select(key, "kind", "wanted", "item").dropDuplicates([key])
    searches = asked.filter("kind = 'Search'")
    records = index.tags.select("id", F.array("tag").alias("tags")) if records is None else records
    bad = unknown_tags(records, searches, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "tag"))).alias("_bad"))
    judged = cut(searches.join(bad, key, "left").select(key, "wanted", "_bad"))
    thumb = F.to_json(F.array("thumb"))
    pieces = index.items.select("id", F.concat(F.lit("["), F.col("id").cast("string"), F.lit(","), thumb.substr(F.lit(2), F.length(thumb) - 1)).alias("piece"))
    good = tell_hits(records, tag_sets(judged.filter("_bad IS NULL"), key, "wanted"), pieces, key, '{"tag":"OK","contents":[', "]}")
    refused = judged.filter("_bad IS NOT NULL").select(key, F.concat(F.lit('{"tag":"BadTag","contents":'), F.to_json(F.transform("_bad", lambda b: b["tag"])), F.lit("}")).alias("response"))
    infos = asked.filter("kind = 'Info'").select(key, F.col("item").alias("id")).join(index.items.select("id", "tags", "img", F.lit(True).alias("_known")), "id", "left")
    # a known image without a picture or tags has null fields of its own
    shown = F.when(F.col("_known"), F.struct("id", "tags", "img"))
    told = infos.select(key, F.concat(F.lit('{"tag":"Info","contents":'), F.coalesce(F.to_json(shown, {"ignoreNullFields": "false"}), F.lit("null")), F.lit("}")).alias("response"))
    return good.unionByName(refused).unionByName(told)


def tokenized(df: DataFrame, text: str, keep: list[str], web: bool = True) -> DataFrame:
    """(*keep, tag): the tags of a query text, by the browser's or the console's rule."""
    split = split_web if web else split_console
    return df.select(*keep, F.explode(split(F.col(text))).alias("tag"))
