"""Most frequent values by iceberg multi-hash filtering, with memory that doesn't grow with the
number of distinct values.

Pass 1 counts rows per bucket under several independent hashes: exact counts of a fixed number of
buckets. A value can only reach the threshold if each of its buckets does. Pass 2 keeps the rows of
such values and counts those exactly. A hash has at most 1 / share buckets that reach a share of all
rows, so what goes to all tasks has a bound of hashes / share bucket numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagweave.session import cut

HASHES = 4
BUCKETS = 1 << 16


def bucket(value: Column, seed: int, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), value), F.lit(buckets)).cast("int")


def coarse_counts(rows: DataFrame, value: str, hashes: int = HASHES, buckets: int = BUCKETS) -> DataFrame:
    """(h, b, n): rows per bucket under each hash; at most hashes * buckets rows in any task."""
    spread = rows.select(F.explode(F.array(*[F.struct(F.lit(h).alias("h"), bucket(F.col(value), h, buckets).alias("b")) for h in range(hashes)])).alias("_x"))
    return spread.groupBy("_x.h", "_x.b").agg(F.count(F.lit(1)).alias("n"))


def heavy_hitters(rows: DataFrame, value: str = "tag", share: float = 0.01, hashes: int = HASHES, buckets: int = BUCKETS) -> DataFrame:
    """(value, n, share) of every value that makes up at least `share` of all rows with a value.

    Counts are exact. Null values are left out, repeated rows count; values that tie at the threshold
    are all kept; an empty table gives no row.
    """
    live = rows.select(value).filter(F.col(value).isNotNull())
    coarse = cut(coarse_counts(live, value, hashes, buckets))
    total = coarse.filter("h = 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    need = share * total
    counted = coarse.filter(F.col("n") >= F.lit(need)).select("h", "b").collect()  # hashes / share rows at most
    kept = live
    for h in range(hashes):
        heavy = sorted(r.b for r in counted if r.h == h)
        kept = kept.filter(bucket(F.col(value), h, buckets).isin(heavy) if heavy else F.lit(False))
    exact = kept.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return exact.filter(F.col("n") >= F.lit(need)).withColumn("share", F.col("n") / F.lit(float(total or 1)))
