"""Per-key results over a join without the join's rows, and without one task per hot key.

Eager aggregation: both inputs are aggregated by join key and output group before they meet (each
task combines its own rows first, so a key with a third of all rows sends one row per task), the
compact states are joined, and the join's sums follow by algebra:

    rows(join)    = rows(left) * rows(right)
    sum_left(x)   = sum(x over left) * rows(right)
    sum_right(y)  = rows(left) * sum(y over right)
    min and max are those of the side.

The states are then rolled up from (join key, group) to the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state(df: DataFrame, keys: Sequence[str], sums: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """(keys, {prefix}rows, {prefix}sum_x for each x): the compact state of one input."""
    totals = [F.sum(F.col(x)).alias(f"{prefix}sum_{x}") for x in sums]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{prefix}rows"), *totals)


def eager_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    group: Sequence[str] = (),
    left_sums: Sequence[str] = (),
    right_sums: Sequence[str] = (),
    how: str = "inner",
    distinct_right: str | None = None,
) -> DataFrame:
    """Aggregates of `left JOIN right ON on` by `group` (columns of left or the join key).

    Returns (*group, left_rows, right_rows, join_rows, left_sum_x over the join, right_sum_y over
    the join, and, with `distinct_right`, right_distinct: the number of distinct non-null values of
    that column). right_rows and right_distinct are only defined where a group holds one join
    key, which is so when `group` is the key itself; otherwise they are totals over its keys.

    `how` is 'inner', 'left' or 'full'; a side without a partner has 0 rows. Null keys join nothing
    and are left out. Empty inputs give no row. Columns of the same name in both inputs don't clash:
    only the named ones are read, and each side's results carry its prefix.
    """
    group = list(group) or [on]
    l_keys = list(dict.fromkeys([on, *group]))
    a = state(left.filter(F.col(on).isNotNull()), l_keys, left_sums, "left_")
    b_in = right.filter(F.col(on).isNotNull())
    if distinct_right:
        # first by (key, value): the value spreads a hot key over all tasks, and the second
        # aggregation gets one row per task and key
        inner = b_in.groupBy(on, F.col(distinct_right).alias("_value")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(y).alias(f"_s_{y}") for y in right_sums])
        b = inner.groupBy(on).agg(
            F.sum("_n").alias("right_rows"),
            F.count("_value").alias("right_distinct"),
            *[F.sum(f"_s_{y}").alias(f"right_sum_{y}") for y in right_sums],
        )
    else:
        b = state(b_in, [on], right_sums, "right_")
    met = a.join(b, on, how)
    zero = [c for c in met.columns if c not in l_keys]
    met = met.fillna(0, zero)
    multiplied = met.select(
        *l_keys,
        "left_rows",
        "right_rows",
        *(["right_distinct"] if distinct_right else []),
        (F.col("left_rows") * F.col("right_rows")).alias("join_rows"),
        *[(F.col(f"left_sum_{x}") * F.col("right_rows")).alias(f"left_sum_{x}") for x in left_sums],
        *[(F.col("left_rows") * F.col(f"right_sum_{y}")).alias(f"right_sum_{y}") for y in right_sums],
    )
    if group == [on]:
        return multiplied
    return multiplied.groupBy(*group).agg(*[F.sum(c).alias(c) for c in multiplied.columns if c not in l_keys])


def with_share(states: DataFrame, value: str, share: str = "share") -> DataFrame:
    """`states` with its share of the total of `value`. The total is one row, rolled up from the
    compact states; an empty table has no row and a total of 0 gives a null share."""
    total = states.agg(F.sum(value)).scalar()
    return states.withColumn(share, F.try_divide(F.col(value).cast("double"), total))
