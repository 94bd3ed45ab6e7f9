"""Key ranges: node of a key, trimming to a range, neighbours and the layout of leaves.

Everything that needs a global order is done per key bucket, with bounds taken from a sample, and
then stitched over the few buckets; no window runs over the whole table in one task. The sample
only decides how even the buckets are, never the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_BUCKET = 1_000_000  # rows of a bucket, about
MAX_BUCKETS = 10_000
SAMPLE = 20_000  # keys that the driver takes bounds from, or 20 a bucket
NESTED = 256  # bounds up to which a key's bucket is an expression; beyond it is looked up in numpy


def bounds_frame(spark, separators: list) -> DataFrame:
    """(node_id, lo, hi) of the children around sorted separators; null means open."""
    edges = [None, *separators, None]
    rows = [(i, edges[i], edges[i + 1]) for i in range(len(separators) + 1)]
    return spark.createDataFrame(rows, "node_id bigint, lo bigint, hi bigint")


def size(nodes: DataFrame) -> DataFrame:
    """(n_nodes, n_separators) of an index: one row; an empty one has 0 of both."""
    return nodes.agg(F.count(F.lit(1)).alias("n_nodes"), F.count("lo").alias("n_separators"))


def joined(left: DataFrame, separator: object, right: DataFrame) -> DataFrame:
    """One index of two: all keys of `left` lie below the separator, those of `right` from it on; the
    nodes of `right` are numbered on."""
    at = left.agg(F.coalesce(F.max("node_id") + 1, F.lit(0))).scalar()
    a = left.select("node_id", "lo", F.coalesce("hi", F.lit(separator)).alias("hi"))
    return a.unionByName(right.select((F.col("node_id") + at).alias("node_id"), F.coalesce("lo", F.lit(separator)).alias("lo"), "hi"))


def parted(nodes: DataFrame, separator: object) -> tuple[DataFrame, DataFrame]:
    """The nodes below a separator of the index, and those from it on; their new outer ends are open."""
    left = nodes.filter(F.col("hi") <= F.lit(separator)).select("node_id", "lo", F.when(F.col("hi") != F.lit(separator), F.col("hi")).alias("hi"))
    right = nodes.filter(F.col("lo") >= F.lit(separator)).select("node_id", F.when(F.col("lo") != F.lit(separator), F.col("lo")).alias("lo"), "hi")
    return left, right


def ends(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first node, last node) of an index; none of an empty one."""
    return nodes.filter("lo IS NULL"), nodes.filter("hi IS NULL")


def lower_bound(sorted_keys: DataFrame, probes: DataFrame, or_equal: bool = False, key: str = "k") -> DataFrame:
    """`probes` (key, ...) with `place`: the number of the unique keys of `sorted_keys` that lie below the
    probe, or, with `or_equal`, don't lie above it. These are the places that a binary search gives,
    found by one ordered merge of both. Null probes are left out."""
    numbered = ordered_index(sorted_keys.select(key).filter(F.col(key).isNotNull()), key).select(key, (F.col("i") + 1).cast("long").alias("_i"), F.lit(0).alias("_is"))
    mixed = probes.filter(F.col(key).isNotNull()).withColumn("_is", F.lit(1 if or_equal else -1)).unionByName(numbered, allowMissingColumns=True)
    found = carried(mixed, key, F.col("_i").isNotNull(), "place", F.col("_i"), ["_is"])
    return found.filter("_is <> 0").select(*probes.columns, F.coalesce("place", F.lit(0)).cast("bigint").alias("place"))


def mapped(contents: DataFrame, change, node: int | None = None) -> DataFrame:
    """`contents` (node_id, ...) after `change`, a function of a DataFrame, of the rows of one node, or of
    all; the other nodes stay, and so do the separators."""
    if node is None:
        return change(contents)
    return contents.filter(F.col("node_id") != node).unionByName(change(contents.filter(F.col("node_id") == node)))


def contains(key: Column, lo: Column, hi: Column) -> Column:
    return (lo.isNull() | (key >= lo)) & (hi.isNull() | (key < hi))


def bisected(key: Column, bounds: list, values: list[Column]) -> Column:
    """values[number of bounds that aren't above the key], by bisection; one more value than bounds."""
    if not bounds:
        return values[0]
    middle = len(bounds) // 2
    return F.when(key < F.lit(bounds[middle]), bisected(key, bounds[:middle], values[: middle + 1])).otherwise(bisected(key, bounds[middle + 1 :], values[middle + 1 :]))


def node_of_key(keys: DataFrame, nodes: DataFrame, key: str = "k") -> DataFrame:
    """`keys` with the `node_id` of the node whose range holds the key; a key equal to a separator
    belongs to the node that begins there. A null key has no node.

    `nodes` (node_id, lo, ...) is an index of separators. Up to NESTED nodes it is an expression that
    bisects them; only so many are taken to the driver. Beyond that a window finds the greatest lower
    bound among keys and bounds of one bucket.
    """
    some = nodes.select("node_id", "lo").limit(NESTED + 1).collect()
    if len(some) <= NESTED:
        first = [r.node_id for r in some if r.lo is None]
        rows = sorted((r.lo, r.node_id) for r in some if r.lo is not None)
        ids = [F.lit(n).cast("long") for n in [first[0] if first else None, *(n for _, n in rows)]]
        return keys.withColumn("node_id", F.when(F.col(key).isNotNull(), bisected(F.col(key), [lo for lo, _ in rows], ids)))
    kind = keys.schema[key].dataType
    marks = nodes.filter("lo IS NOT NULL").select(F.col("lo").cast(kind).alias(key), F.col("node_id").cast("long").alias("_node"), F.lit(0).alias("_is"))
    mixed = keys.filter(F.col(key).isNotNull()).withColumn("_node", F.lit(None).cast("long")).withColumn("_is", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    open_end = nodes.filter("lo IS NULL").agg(F.max(F.col("node_id").cast("long"))).scalar()
    found = carried(mixed, key, F.col("_is") == 0, "node_id", F.col("_node"), ["_is"]).filter("_is = 1")
    placed = found.withColumn("node_id", F.coalesce(F.col("node_id"), open_end)).select(*keys.columns, "node_id")
    return placed.unionByName(keys.filter(F.col(key).isNull()).withColumn("node_id", F.lit(None).cast("long")))


def carried(df: DataFrame, key: str, mark: Column, name: str, value: Column | None = None, then: list[str] | None = None) -> DataFrame:
    """`df` with the `value` (the key itself) of the last marked row up to each row in the order of `key`
    and the columns `then`; null where none is. Keys are not null, marked rows have different ones."""
    value = F.col(key) if value is None else value
    bounds = sample_bounds(df, key)
    put = df.withColumn("_v", F.when(mark, value)).withColumn("_b", bucket(F.col(key), bounds))
    inside = Window.partitionBy("_b").orderBy(key, *(then or [])).rowsBetween(Window.unboundedPreceding, 0)
    put = put.withColumn("_here", F.last("_v", ignorenulls=True).over(inside))
    if not bounds:
        return put.withColumn(name, F.col("_here")).drop("_b", "_v", "_here")
    # the buckets are few: what each ends with is handed on to those behind it
    ends = put.groupBy("_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(key))).alias("_end"))
    behind = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_b", F.last("_end", ignorenulls=True).over(behind).alias("_carry"))
    return put.join(before, "_b").withColumn(name, F.coalesce("_here", "_carry")).drop("_b", "_v", "_here", "_carry")


def trim(nodes: DataFrame, least: object | None = None, most: object | None = None) -> DataFrame:
    """The nodes that overlap the inclusive range [least, most]; null is an open end."""
    kept = nodes
    if most is not None:
        kept = kept.filter(F.col("lo").isNull() | (F.col("lo") <= F.lit(most)))
    if least is not None:
        kept = kept.filter(F.col("hi").isNull() | (F.col("hi") > F.lit(least)))
    return kept


def sample_bounds(df: DataFrame, key: str, per: int | None = None) -> list:
    """Keys that split `df` into buckets of about `per` rows; 20 keys a bucket reach the driver, or SAMPLE."""
    n = df.count()
    buckets = min(MAX_BUCKETS, -(-n // (per or PER_BUCKET)))
    if buckets <= 1:
        return []
    most = max(SAMPLE, 20 * buckets)
    part = df.select(key).filter(F.col(key).isNotNull())
    if n > most:
        part = part.sample(fraction=most / n, seed=7)
    keys = sorted(r[0] for r in part.limit(2 * most).collect())
    return sorted({keys[len(keys) * i // buckets] for i in range(1, buckets)}) if keys else []


def bucket(key: Column, bounds: list) -> Column:
    """Number of bounds that aren't above the key."""
    if len(bounds) <= NESTED:
        return bisected(key, bounds, [F.lit(i) for i in range(len(bounds) + 1)])
    edges = np.array(bounds)

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, keys.to_numpy(edges.dtype), side="right").astype(np.int32))

    return place(key)


def ordered_index(df: DataFrame, key: str) -> DataFrame:
    """`df` (unique, non-null `key`) with `i`, its place from 0 in key order, and `n`, the count."""
    bounds = sample_bounds(df, key)
    put = df.withColumn("_b", bucket(F.col(key), bounds))
    if not bounds:  # one bucket
        return put.withColumn("i", F.row_number().over(Window.partitionBy("_b").orderBy(key)).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("_b"))).drop("_b")
    sizes = put.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy()).alias("n"))
    local = put.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy(key)) - 1)
    return local.join(offsets, "_b").withColumn("i", F.col("_off") + F.col("_i")).drop("_b", "_i", "_off")


def neighbours(df: DataFrame, key: str) -> DataFrame:
    """(prev, key, next) of each distinct key in key order; null at the ends."""
    keys = df.select(key).filter(F.col(key).isNotNull()).distinct()
    bounds = sample_bounds(keys, key)
    put = keys.withColumn("_b", bucket(F.col(key), bounds))
    if not bounds:
        over = Window.partitionBy("_b").orderBy(key)
        return put.select(F.lag(key).over(over).alias("prev"), F.col(key), F.lead(key).over(over).alias("next"))
    edges = put.groupBy("_b").agg(F.min(key).alias("_min"), F.max(key).alias("_max"))
    over = Window.orderBy("_b")
    edges = edges.select("_b", F.lag("_max").over(over).alias("_before"), F.lead("_min").over(over).alias("_after"))
    inside = Window.partitionBy("_b").orderBy(key)
    local = put.withColumn("_p", F.lag(key).over(inside)).withColumn("_n", F.lead(key).over(inside)).join(edges, "_b")
    return local.select(F.coalesce("_p", "_before").alias("prev"), F.col(key), F.coalesce("_n", "_after").alias("next"))


def leaf_layout(df: DataFrame, key: str, most: int) -> DataFrame:
    """(key, leaf): full leaves of `most` keys until at most 2 * most remain, then one leaf, or two
    halves of which the first is the smaller."""
    indexed = ordered_index(df.select(key), key)
    full = F.when(F.col("n") <= 2 * most, F.lit(0)).otherwise(F.floor((F.col("n") - 2 * most + most - 1) / most))
    placed = indexed.withColumn("_full", full.cast("long")).withColumn("_rest", F.col("n") - F.col("_full") * most)
    at = F.col("i") - F.col("_full") * most
    leaf = (
        F.when(at < 0, F.floor(F.col("i") / most))
        .when((F.col("_rest") <= most) | (at < F.floor(F.col("_rest") / 2)), F.col("_full"))
        .otherwise(F.col("_full") + 1)
    )
    return placed.select(key, leaf.cast("long").alias("leaf"))
