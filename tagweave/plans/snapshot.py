"""Content-addressed snapshots of a map: a manifest of nodes with hashes, a root, differences.

A hash depends on the content of a node only, so two histories that lead to the same state give the
same manifest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.operators.nodes import carried, neighbours, ordered_index


def node_id(key: Column, width: int = 16) -> Column:
    """Node of an integer key: `width` neighbouring keys share one."""
    return F.floor(key / width).cast("long")


def manifest(state: DataFrame, width: int = 16, key: str = "k", value: str = "v") -> DataFrame:
    """(node_id, lo, hi, n_rows, hash) of a state (key, value) with unique keys.

    A node holds at most `width` rows, so its text is bounded. See `content_hash` for the hash.
    """
    rows = state.select(node_id(F.col(key), width).alias("node_id"), F.struct(F.col(key).alias("k"), F.col(value).cast("string").alias("v")).alias("_row"))
    nodes = rows.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_rows"), content_hash("_row").alias("hash"))
    return nodes.select("node_id", (F.col("node_id") * width).alias("lo"), ((F.col("node_id") + 1) * width).alias("hi"), "n_rows", "hash")


def content_hash(row: str) -> Column:
    """SHA-256 of the rows (k, v) of a node. The text is one-to-one with the content: the number of rows,
    then each key and value in key order with its length in front; a null value is a sign of its own."""
    field = lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)
    one = lambda r: F.concat(field(r["k"].cast("string")), F.coalesce(F.concat(F.lit("+"), field(r["v"])), F.lit("-")))
    text = F.concat(F.count(F.lit(1)).cast("string"), F.lit(";"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), one), ""))
    return F.sha2(text, 256)


def ranges(state: DataFrame, width: int = 16, key: str = "k", value: str = "v") -> DataFrame:
    """(node_id, lo, hi, n_rows, hash) of a state (key, value) with unique keys of any ordered type.

    A key begins a node if its hash is divisible by `width`, so where nodes begin depends on the content
    only, a change moves the ends of its own node at most, and a node has `width` rows on average. The
    first node has a null `lo`, the last a null `hi`; node_id is the place in key order, from 0 for the
    node without a lower end, or from 1 where no row lies in it.
    """
    begins = F.conv(F.md5(F.col(key).cast("string").cast("binary")).substr(1, 8), 16, 10).cast("long") % width == 0
    placed = carried(state.select(key, value), key, begins, "lo")
    row = placed.select("lo", F.struct(F.col(key).alias("k"), F.col(value).cast("string").alias("v")).alias("_row"))
    nodes = row.groupBy("lo").agg(F.count(F.lit(1)).alias("n_rows"), content_hash("_row").alias("hash"))
    inner = nodes.filter("lo IS NOT NULL")
    after = neighbours(inner, "lo").select("lo", F.col("next").alias("hi"))
    some = ordered_index(inner, "lo").join(after, "lo").select((F.col("i") + 1).cast("bigint").alias("node_id"), "lo", "hi", "n_rows", "hash")
    least = inner.agg(F.min("lo")).scalar()
    first = nodes.filter("lo IS NULL").select(F.lit(0).cast("bigint").alias("node_id"), "lo", least.alias("hi"), "n_rows", "hash")
    return some.unionByName(first)


def root(nodes: DataFrame, fanout: int = 64) -> DataFrame:
    """(n_rows, hash): one row. Nodes are hashed level by level, `fanout` at a time, so no task
    holds the hashes of more than `fanout` nodes. An empty manifest has the hash of no text."""
    level = nodes.select("node_id", "n_rows", "hash")
    ends = nodes.agg(F.min("node_id").alias("a"), F.max("node_id").alias("b")).first()
    a, b = (ends.a, ends.b) if ends.a is not None else (0, 0)
    while a != b or a != 0:
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "hash"))), lambda r: F.concat(r["node_id"].cast("string"), F.lit(":"), r["hash"])), ",")
        level = level.groupBy(F.floor(F.col("node_id") / fanout).cast("long").alias("node_id")).agg(F.sum("n_rows").alias("n_rows"), F.sha2(text, 256).alias("hash"))
        if (a // fanout, b // fanout) == (a, b):  # the levels of negative ids end at -1
            break
        a, b = a // fanout, b // fanout
    total = F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows")
    return level.agg(total, F.sha2(F.coalesce(F.array_join(F.array_sort(F.collect_list("hash")), ","), F.lit("")), 256).alias("hash"))


def to_fetch(new: DataFrame, held_hashes: DataFrame) -> DataFrame:
    """Nodes of a new manifest whose content isn't held under any hash."""
    return new.join(held_hashes.select("hash").distinct(), "hash", "left_anti")


def store(nodes: DataFrame, storage: DataFrame) -> DataFrame:
    """Storage of nodes by hash after adding `nodes`; equal nodes are kept once."""
    return storage.unionByName(nodes.select(*storage.columns)).dropDuplicates(["hash"])
