"""Maps, sets and multimaps in long form: one row per key, or per key and value.

All three are immutable: each update gives a new collection over a new logical plan. Rows whose
key (or, in a multimap, value) is null are ignored at the boundary, so that `=` and `<=>` agree.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(ops: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The row with the greatest `seq` of each key.

    row_number() = 1 is planned with a group limit before the shuffle, so a hot key sends one row
    per task. Rows that share a `seq` are told apart by their other columns, for a defined result.
    """
    rest = [c for c in ops.columns if c not in (*keys, seq)]
    orderable = [F.col(c).desc() for c in rest if not isinstance(ops.schema[c].dataType, T.MapType)]
    order = Window.partitionBy(*keys).orderBy(F.col(seq).desc(), *orderable)
    live = ops
    for k in keys:
        live = live.filter(F.col(k).isNotNull())
    return live.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def replay(ops: DataFrame, keys: list[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """State after a log of upserts (op 'U') and deletions ('D'): the last operation decides."""
    return latest(ops, keys, seq).filter(F.col(op) == "U").drop(seq, op)


def pairs_present(ops: DataFrame, keys: list[str], seq: str = "seq", op: str = "op") -> DataFrame:
    """As `replay` where the row has nothing but its keys: a hash aggregation on one long.

    The operation travels in the lowest bit of `seq` (|seq| < 2**62), so the state of a key is
    eight bytes, combined before the shuffle however hot the key is.
    """
    live = ops
    for k in keys:
        live = live.filter(F.col(k).isNotNull())
    coded = F.shiftleft(F.col(seq).cast("long"), 1) + F.when(F.col(op) == "U", 1).otherwise(0)
    last = live.groupBy(*keys).agg(F.max(coded).alias("_last"))
    return last.filter(F.col("_last").bitwiseAND(F.lit(1)) == 1).select(*keys)


@dataclass(frozen=True)
class MapTable:
    """key -> row of values; the last write wins. `df` has one row per key."""

    df: DataFrame
    key: str = "k"

    @classmethod
    def empty(cls, spark: SparkSession, schema: str, key: str = "k") -> MapTable:
        return cls(spark.createDataFrame([], schema), key)

    @classmethod
    def from_log(cls, ops: DataFrame, key: str = "k", seq: str = "seq", op: str | None = "op") -> MapTable:
        if op is None:
            return cls(latest(ops, [key], seq).drop(seq), key)
        return cls(replay(ops, [key], seq, op), key)

    def insert_many(self, batch: DataFrame) -> MapTable:
        """Upsert a batch with unique keys; a batch row replaces the old one."""
        batch = batch.filter(F.col(self.key).isNotNull()).select(*self.df.columns)
        return MapTable(self.df.join(batch.select(self.key), self.key, "left_anti").select(*batch.columns).unionByName(batch), self.key)

    def insert(self, *row: object) -> MapTable:
        return self.insert_many(self.df.sparkSession.createDataFrame([row], self.df.schema))

    def delete(self, key: object) -> MapTable:
        return MapTable(self.df.filter(F.col(self.key) != F.lit(key)), self.key)

    def delete_many(self, keys: DataFrame) -> MapTable:
        return MapTable(self.df.join(keys.select(self.key), self.key, "left_anti"), self.key)

    def lookup(self, *keys: object) -> DataFrame:
        """Rows of the given keys, absent keys have none; the predicate reaches the scan."""
        return self.df.filter(F.col(self.key).isin(*keys))

    def lookup_many(self, keys: DataFrame) -> DataFrame:
        return self.df.join(keys.select(self.key).distinct(), self.key, "left_semi")

    def split(self, key: object) -> tuple[MapTable, MapTable]:
        """The parts with keys below `key`, and from it on."""
        return MapTable(self.df.filter(F.col(self.key) < F.lit(key)), self.key), MapTable(self.df.filter(F.col(self.key) >= F.lit(key)), self.key)


@dataclass(frozen=True)
class SetTable:
    """A set of keys. `df` has the one column `k` without repetition."""

    df: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, kind: str = "bigint") -> SetTable:
        return cls(spark.createDataFrame([], f"k {kind}"))

    @classmethod
    def singleton(cls, spark: SparkSession, key: object, kind: str = "bigint") -> SetTable:
        return cls(spark.createDataFrame([(key,)], f"k {kind}"))

    @classmethod
    def of(cls, df: DataFrame, key: str | Column = "k") -> SetTable:
        column = F.col(key) if isinstance(key, str) else key
        return cls(df.select(column.alias("k")).filter("k IS NOT NULL").distinct())

    def is_null(self) -> bool:
        return self.df.isEmpty()

    def null_flag(self) -> DataFrame:
        """(is_null): one row, as `is_null` without leaving the plan; one row is read at most."""
        return self.df.limit(1).agg((F.count(F.lit(1)) == 0).alias("is_null"))

    def to_rows(self) -> DataFrame:
        return self.df.orderBy("k")

    def insert_many(self, batch: DataFrame) -> SetTable:
        return SetTable.of(self.df.union(batch.select("k")))

    def insert(self, key: object) -> SetTable:
        return self.insert_many(self.df.sparkSession.createDataFrame([(key,)], self.df.schema))

    def delete(self, key: object) -> SetTable:
        return SetTable(self.df.filter(F.col("k") != F.lit(key)))

    def delete_many(self, keys: DataFrame) -> SetTable:
        return SetTable(self.df.join(keys.select("k"), "k", "left_anti"))

    def member(self, probes: DataFrame) -> DataFrame:
        """`probes` (k, ...) with `is_member`; one row per probe."""
        found = self.df.withColumn("_in", F.lit(True))
        return probes.join(found, "k", "left").withColumn("is_member", F.coalesce("_in", F.lit(False))).drop("_in")

    def intersection(self, other: SetTable) -> SetTable:
        # both sides are sets already: a semi join needs no aggregation after it
        return SetTable(self.df.join(other.df, "k", "left_semi"))

    def union(self, other: SetTable) -> SetTable:
        """Algebraic union: an empty side gives the other one."""
        return SetTable.of(self.df.union(other.df))

    def split(self, key: object) -> tuple[SetTable, SetTable]:
        """The parts with keys below `key`, and from it on."""
        return SetTable(self.df.filter(F.col("k") < F.lit(key))), SetTable(self.df.filter(F.col("k") >= F.lit(key)))


@dataclass(frozen=True)
class SetMapTable:
    """key -> set of values: an inverted index. `df` has one row (k, v) per pair."""

    df: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession, schema: str = "k string, v bigint") -> SetMapTable:
        return cls(spark.createDataFrame([], schema))

    @classmethod
    def of(cls, pairs: DataFrame) -> SetMapTable:
        return cls(pairs.select("k", "v").filter("k IS NOT NULL AND v IS NOT NULL").distinct())

    @classmethod
    def from_log(cls, ops: DataFrame, seq: str = "seq", op: str = "op") -> SetMapTable:
        return cls(pairs_present(ops, ["k", "v"], seq, op))

    def insert_many(self, batch: DataFrame) -> SetMapTable:
        return SetMapTable.of(self.df.unionByName(batch.select("k", "v")))

    def insert(self, key: object, value: object) -> SetMapTable:
        return self.insert_many(self.df.sparkSession.createDataFrame([(key, value)], self.df.schema))

    def delete(self, key: object, value: object) -> SetMapTable:
        """Remove one value; a key without values is gone."""
        return SetMapTable(self.df.filter((F.col("k") != F.lit(key)) | (F.col("v") != F.lit(value))))

    def delete_many(self, pairs: DataFrame) -> SetMapTable:
        return SetMapTable(self.df.join(pairs.select("k", "v"), ["k", "v"], "left_anti"))

    def lookup(self, key: object) -> SetTable:
        return SetTable(self.df.filter(F.col("k") == F.lit(key)).select(F.col("v").alias("k")))

    def lookup_many(self, keys: Iterable[object]) -> DataFrame:
        return self.df.filter(F.col("k").isin(*keys))

    def split(self, key: object) -> tuple[SetMapTable, SetMapTable]:
        """The parts with keys below `key`, and from it on."""
        return SetMapTable(self.df.filter(F.col("k") < F.lit(key))), SetMapTable(self.df.filter(F.col("k") >= F.lit(key)))

    def sizes(self) -> DataFrame:
        return self.df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))

    def grouped(self) -> DataFrame:
        """(k, n, vs): values as a sorted array. For output: a row holds a whole set."""
        return self.df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("v")).alias("vs"))


def unnest(grouped: DataFrame, key: str, values: str) -> DataFrame:
    """(k, array of v) back to rows (k, v); an empty or null array gives none."""
    return grouped.select(F.col(key).alias("k"), F.explode(values).alias("v"))
