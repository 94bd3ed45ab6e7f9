"""Overlap sizes of many pairs of large sets: galloping intersection of sorted, delta-encoded runs.

Identifiers are cut into ranges. Each task sorts its rows and encodes them as runs, one per set and
range: the first identifier and the gaps behind it, so what is shuffled is a byte or two per member.
Runs of one set and range are united. A task holds one range of the compared sets, however large the
sets are, and decodes each run once. For each pair of sets present in a range the smaller run gallops
through the larger one, or both are merged, by the ratio of their sizes. Counts of a pair are summed
over the ranges. No intersection leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.session import cut

MEMBERS = 200_000  # of a range, about
RATIO = 8
ROWS = 1_000_000  # that a task sorts together


def delta_encode(ids: np.ndarray) -> tuple[int, np.ndarray]:
    """(first, gaps) of sorted distinct ids; gaps in the smallest unsigned type that holds them."""
    gaps = np.diff(ids)
    top = int(gaps.max()) if len(gaps) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return int(ids[0]), gaps.astype(kind)


def delta_decode(first: int, gaps: np.ndarray) -> np.ndarray:
    out = np.empty(len(gaps) + 1, np.int64)
    out[0] = first
    np.cumsum(gaps, out=out[1:], dtype=np.int64)
    out[1:] += first
    return out


def seek(run: np.ndarray, values: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Of each value, the first place from its `low` on whose element isn't below it: steps of doubling
    length until it is passed, then bisection within the last step; all values in lockstep."""
    n = len(run)
    low, step = low.copy(), np.ones(len(values), np.int64)
    live = np.flatnonzero((low < n) & (run[np.minimum(low, n - 1)] < values))
    high = low.copy()
    while len(live):
        ahead = low[live] + step[live]
        high[live] = np.minimum(ahead, n)
        on = (ahead < n) & (run[np.minimum(ahead, n - 1)] < values[live])
        low[live[on]] = ahead[on]
        step[live[on]] *= 2
        live = live[on]
    # run[low] < value <= run[high], or low == high
    while True:
        live = np.flatnonzero(high - low > 1)
        if not len(live):
            break
        middle = (low[live] + high[live]) >> 1
        below = run[middle] < values[live]
        low[live[below]], high[live[~below]] = middle[below], middle[~below]
    return high


def gallop(small: np.ndarray, large: np.ndarray) -> int:
    """Common elements of two sorted runs of very different length: an exponential search through `large`
    for each element of `small`, from where the last of every 64 elements before it was found."""
    start = np.zeros(len(small), np.int64)
    if len(small) > 64:
        pilots = seek(large, small[::64], np.arange(0, len(small), 64) * 0)
        start = np.repeat(pilots, 64)[: len(small)]
    place = seek(large, small, start)
    place[place == len(large)] = 0
    return int(np.count_nonzero(large[place] == small))


def merge_count(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements by one merge of both runs: equal neighbours after it."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")  # two runs: timsort merges them in one pass
    return int(np.count_nonzero(both[1:] == both[:-1]))


def common(a: np.ndarray, b: np.ndarray, ratio: int = RATIO) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or a[-1] < b[0] or b[-1] < a[0]:
        return 0
    return gallop(a, b) if len(a) * ratio <= len(b) else merge_count(a, b)


def runs(members: DataFrame, bits: int) -> DataFrame:
    """(g, k, part, first, n, width, gaps): sorted delta-encoded runs of the rows (g, k, id) of each task,
    one per key and range of 2 ** bits identifiers; repeated rows count once."""
    names = ["g", "k", "part", "first", "n", "width", "gaps"]

    def make(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        g, k = (table.column(i).combine_chunks().dictionary_encode() for i in (0, 1))
        key = g.indices.to_numpy().astype(np.int64) * len(k.dictionary) + k.indices.to_numpy()
        ids = table.column(2).to_numpy()
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        part = ids >> bits
        same = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
        keep = np.append(True, ~same | (ids[1:] != ids[:-1]))
        key, ids, part = key[keep], ids[keep], part[keep]
        begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        n = np.diff(np.append(begin, len(ids)))
        gaps = np.diff(ids, prepend=0)
        gaps[begin] = 0  # the first of a run stands beside it
        top = np.maximum.reduceat(gaps, begin)
        width = np.where(top < 1 << 8, 1, np.where(top < 1 << 16, 2, np.where(top < 1 << 32, 4, 8)))
        inner = np.ones(len(ids), bool)
        inner[begin] = False
        run_of = np.repeat(np.arange(len(begin)), n)
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            data = gaps[inner & (width == w)[run_of]].astype(f"u{w}")
            offsets = np.append(0, np.cumsum((n[at] - 1) * w)).astype(np.int32)
            coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            code = key[begin[at]]
            columns = [g.dictionary.take(pa.array(code // len(k.dictionary))), k.dictionary.take(pa.array(code % len(k.dictionary))), pa.array(part[begin[at]]), pa.array(ids[begin[at]]), pa.array(n[at].astype(np.int32)), pa.array(np.full(len(at), w, np.int8)), coded]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= ROWS:
                yield from make(waiting)
                waiting = []
        if sum(b.num_rows for b in waiting):
            yield from make(waiting)

    return members.mapInArrow(run, "g string, k string, part bigint, first bigint, n int, width tinyint, gaps binary")


def count_range(rows: list[dict], ratio: int) -> tuple[list[str], list[str | None], list[int]]:
    """(key_a, key_b, number) of the runs of one range: common identifiers of each pair of keys that has
    any, and the size of each key beside a null."""
    by: dict[str, list[np.ndarray]] = {}
    for r in rows:
        by.setdefault(r["k"], []).append(delta_decode(r["first"], np.frombuffer(r["gaps"], f"u{r['width']}")))
    keys = sorted(by)
    decoded = [by[k][0] if len(by[k]) == 1 else np.unique(np.concatenate(by[k])) for k in keys]
    a, b, n = list(keys), [None] * len(keys), [len(x) for x in decoded]
    for i, x in enumerate(decoded):
        for j in range(i + 1, len(decoded)):
            if m := common(x, decoded[j], ratio):
                a.append(keys[i])
                b.append(keys[j])
                n.append(m)
    return a, b, n


def range_bits(members: DataFrame, per_range: int) -> int:
    """Bits of a range that holds `per_range` members on average."""
    span = members.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b")).first()
    if not span.n:
        return 16
    return min(62, max(4, ((span.b - span.a + 1) * per_range // span.n).bit_length() - 1))


def overlap_sizes(members: DataFrame, group: str = "origin", key: str = "k", ident: str = "id", bits: int | None = None, ratio: int = RATIO, wanted: DataFrame | None = None, per_range: int = MEMBERS) -> DataFrame:
    """(group, key_a, key_b, size_a, size_b, n_common) of every pair of keys of one group that share
    an identifier, key_a < key_b.

    `members` has rows (group, key, ident), ident a bigint; rows with a null in any of them are left
    out, repeated rows count once, negative identifiers are allowed, an empty table gives no row.
    The cost is pairs of sets per range, so `members` should hold the sets to compare only. A range has
    2 ** bits identifiers, so no set has more members in it, however skewed they are; without `bits`
    one pass over the members chooses them for `per_range` members a range on average.

    With `wanted`, rows (group, key), the result is every pair of its keys of one group instead, with
    0 where they share nothing or a key has no members.
    """
    live = members.select(F.col(group).cast("string").alias("g"), F.col(key).cast("string").alias("k"), F.col(ident).cast("long").alias("id")).dropna()
    bits = range_bits(live, per_range) if bits is None else bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def emit() -> pa.RecordBatch:
            a, b, n = count_range(held, ratio)
            return pa.RecordBatch.from_arrays([pa.array([held[0]["g"]] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(n, pa.int64())], names=["g", "key_a", "key_b", "n"])

        for batch in batches:
            for row in batch.to_pylist():  # a row is a run
                if held and (held[0]["g"], held[0]["part"]) != (row["g"], row["part"]):
                    yield emit()
                    held = []
                held.append(row)
        if held:
            yield emit()

    spread = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = runs(live, bits).repartition(spread, "g", "part").sortWithinPartitions("g", "part", "k")
    summed = placed.mapInArrow(run, "g string, key_a string, key_b string, n bigint").groupBy("g", "key_a", "key_b").agg(F.sum("n").alias("n"))
    # pairs and sizes are small: a row per pair; they are counted once and read from there
    counted = cut(summed)
    size = counted.filter("key_b IS NULL").select("g", F.col("key_a").alias("k"), "n")
    summed = counted.filter("key_b IS NOT NULL")
    if wanted is not None:
        keys = wanted.select(F.col(group).alias("g"), F.col(key).alias("k")).dropna().distinct()
        pairs = keys.withColumnRenamed("k", "key_a").join(keys.withColumnRenamed("k", "key_b"), "g").filter("key_a < key_b")
        none = F.lit(0).cast("long")
        return (
            pairs.join(summed, ["g", "key_a", "key_b"], "left")
            .join(size.select("g", F.col("k").alias("key_a"), F.col("n").alias("size_a")), ["g", "key_a"], "left")
            .join(size.select("g", F.col("k").alias("key_b"), F.col("n").alias("size_b")), ["g", "key_b"], "left")
            .select(F.col("g").alias(group), "key_a", "key_b", *[F.coalesce(c, none).alias(to) for c, to in (("size_a", "size_a"), ("size_b", "size_b"), ("n", "n_common"))])
        )
    return (
        summed.join(size.select("g", F.col("k").alias("key_a"), F.col("n").alias("size_a")), ["g", "key_a"])
        .join(size.select("g", F.col("k").alias("key_b"), F.col("n").alias("size_b")), ["g", "key_b"])
        .select(F.col("g").alias(group), "key_a", "key_b", "size_a", "size_b", F.col("n").alias("n_common"))
    )
