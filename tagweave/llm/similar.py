"""All similar pairs of set-valued records by metric pivot partitioning under Jaccard distance.

Records with the same set are one class, joined once. A pair that reaches the threshold t shares a
token among the rarest |x| - ceil(t * |x|) + 1 tokens of either side, so records are first grouped by
these tokens, and pivots divide a group only where it is large (by a sample; this too changes the work alone). A class of a large group has its home
cell with its nearest pivot. With e = 1 - t, a class y can only be similar to a class at home with pivot
p if, by the triangle inequality,

    d(y, p) <= d(y, nearest pivot of y) + 2 e,

so y also visits each such cell. A cell's homes are dealt out further by a salt, so that none holds more
than a bounded number of them however many sets lie alike, and its visitors stream past the homes. A pair is joined in
the home of the one that comes first by (size, id), at the first token that both share.

Within a cell, pairs pass the sizes, the places of the shared token in both sets, the pivots again
(|d(x, p) - d(y, p)| <= e for each), and are then compared by their tokens from the shared one on, for
none in front of the first shared one is common. A later one gives a smaller number: the greatest holds. Tokens are 64-bit hashes
of the items. Rarity comes from exact counts of a fixed number of hash buckets, so what every task needs
to know does not grow with the data; sharing a bucket costs work, not results.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.session import cut

PIVOTS = 8
PIVOT_SAMPLE = 400  # sets that the driver chooses the pivots from, at most
BUCKETS = 1 << 18
LARGE = 10_000  # members of a token's group, from which on it is divided by pivots
GROUP_SAMPLE = 100_000  # records that large groups are looked for in
HOMES = 40_000  # of a cell and salt, about, at most
EXPAND = 1_000
MEET = 1 << 20  # pairs looked at together
SLACK = 1e-9


def classes(records: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(whole, sets) of rows (id, item): whole (id, codes) with the sorted token codes of each record of
    at least `least` items, and sets (codes, class, copies), one row per distinct set, `class` being
    its smallest id."""
    coded = records.filter("id IS NOT NULL AND item IS NOT NULL").select("id", F.xxhash64("item").alias("code"))
    grouped = coded.groupBy("id").agg(F.sort_array(F.collect_set("code")).alias("codes")).filter(F.size("codes") >= least)
    whole = cut(grouped)
    return whole, whole.groupBy("codes").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies"))


def members(whole: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, class, copies) of the records of the given sets, met by 96 bits of hash, not by the sets."""
    by = [F.xxhash64("codes").alias("_h"), F.hash("codes").alias("_g")]
    return whole.select("id", *by).join(sets.select("class", "copies", *by), ["_h", "_g"]).select("id", "class", "copies")


def bucket_counts(whole: DataFrame) -> np.ndarray:
    """Records per bucket of token codes: BUCKETS numbers, whatever the size of the table."""
    rows = whole.select(F.explode("codes").alias("c")).groupBy(F.col("c").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[rows["b"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def choose_pivots(whole: DataFrame, n: int, pivots: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> list[np.ndarray]:
    """Pivots of a sample of at most `sample` sets, each the farthest from those before it; which ones
    are chosen changes the work, not the result."""
    some = whole.sample(fraction=min(1.0, sample / max(1, n)), seed=3).limit(sample).collect()
    pool = [frozenset(r.codes) for r in sorted(some, key=lambda r: r["id"])]
    if not pool:
        return []
    random.Random(1).shuffle(pool)
    chosen = [pool[0]]
    distance = lambda x, y: 1 - len(x & y) / len(x | y)
    near = [distance(x, chosen[0]) for x in pool]
    while len(chosen) < pivots and max(near) > 0:
        far = pool[near.index(max(near))]
        chosen.append(far)
        near = [min(d, distance(x, far)) for d, x in zip(near, pool)]
    return [np.array(sorted(p), np.int64) for p in chosen]


def prefix_size(n: np.ndarray, threshold: float) -> np.ndarray:
    return n - np.ceil(n * threshold - SLACK).astype(np.int64) + 1


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values one after the other, length of each list)."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def by_rarity(column: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, sizes) of sets of sorted codes, each set's rarest code first: one order for all sets."""
    codes, n = flat(column)
    n = n.astype(np.int64)
    rank = np.repeat(np.arange(len(n)), n) << 40 | np.minimum(counts[codes & (BUCKETS - 1)], (1 << 40) - 1)
    return codes[np.argsort(rank, kind="stable")], n


def large_groups(whole: DataFrame, n: int, counts: np.ndarray, threshold: float) -> dict[int, int]:
    """Buckets of tokens by which more than LARGE records meet, with that number, by a sample."""
    share = min(1.0, GROUP_SAMPLE / max(1, n))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            codes, sizes = by_rarity(batch.column(0), counts)
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[row]
            total += np.bincount(codes[pos < prefix_size(sizes, threshold)[row]] & (BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    met = whole.sample(share, seed=5).select("codes").mapInArrow(count, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n"))
    return {r.b: int(r.n / share) for r in met.filter(F.col("n") > F.lit(LARGE * share)).collect()}


def place(batch: pa.RecordBatch, counts: np.ndarray, sizes: np.ndarray, pivots: list[np.ndarray], threshold: float) -> pa.RecordBatch:
    """Layout rows of a batch (codes, class): one per token of the prefix and cell. `sizes`: members of
    the large groups by bucket, else 0."""
    codes, n = by_rarity(batch.column(0), counts)
    row = np.repeat(np.arange(len(n)), n)
    starts = np.cumsum(n) - n
    pos = np.arange(len(codes)) - starts[row]
    rarity = sizes[codes & (BUCKETS - 1)]
    marks = np.unique(np.concatenate(pivots)) if pivots else np.zeros(1, np.int64)
    holds = np.array([np.isin(marks, p) for p in pivots] + [marks != marks] * (PIVOTS - len(pivots))).T  # token x pivot
    which = np.minimum(np.searchsorted(marks, codes), len(marks) - 1)
    hit = np.flatnonzero(marks[which] == codes)
    owners, inside = row[hit], holds[which[hit]]
    both = np.stack([np.bincount(owners[inside[:, p]], minlength=len(n)) for p in range(PIVOTS)], 1)
    width = np.array([len(p) for p in pivots] + [1] * (PIVOTS - len(pivots)))
    far = (1 - both / (n[:, None] + width - both)).astype(np.float32)
    far[:, len(pivots) :] = 2
    near, home = far.min(1), far.argmin(1)
    # a token that no other record has brings none together
    at = np.flatnonzero((pos < prefix_size(n, threshold)[row]) & (counts[codes & (BUCKETS - 1)] > 1))
    large = rarity[at] > 0
    owner, token, place_of = [row[at]], [codes[at]], [pos[at]]
    salts = 1 + rarity[at] // HOMES
    own_salt = (batch.column(1).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
    cell = [np.where(large, home[row[at]] + PIVOTS * (own_salt[row[at]] % salts), -1)]
    visits = [np.zeros(len(at), bool)]
    hot = at[large]
    if len(hot):
        reach = far[row[hot]] <= near[row[hot], None] + 2 * (1 - threshold) + 1e-6
        times = salts[large]
        who, to = np.nonzero(reach)
        spread = np.repeat(np.arange(len(who)), times[who])
        salt = np.arange(len(spread)) - np.repeat(np.cumsum(times[who]) - times[who], times[who])
        who, to = who[spread], to[spread] + PIVOTS * salt
        other = to != cell[0][large][who]
        who, to = who[other], to[other]
        for parts, values in ((owner, row[hot[who]]), (token, codes[hot[who]]), (place_of, pos[hot[who]]), (cell, to), (visits, np.ones(len(who), bool))):
            parts.append(values)
    owner, token, place_of, cell, visits = map(np.concatenate, (owner, token, place_of, cell, visits))
    packed = np.minimum(255, np.round(far * 255)).astype(np.uint8)
    left = n[owner] - place_of - 1
    rest = np.repeat(starts[owner] + place_of + 1 - (np.cumsum(left) - left), left) + np.arange(left.sum())
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(left)).astype(np.int32)), pa.array(codes[rest]))
    numbers = [pa.array(x.astype(np.int32)) for x in (place_of, n[owner])]
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(cell.astype(np.int32)), pa.array(visits), batch.column(1).take(pa.array(owner)), *numbers, pa.array(packed.view(np.int64)[:, 0][owner]), lists], names=[*Rows.NAMES, "rest"])


class Rows:
    """Layout rows as arrays; `codes` are those behind the token, `left` their number in each row."""

    NAMES = ("token", "cell", "visits", "class", "pos", "n", "far")

    def __init__(self, parts: dict[str, np.ndarray], codes: np.ndarray, left: np.ndarray):
        self.__dict__.update(parts)
        self.codes, self.left, self.start = codes, left, np.cumsum(left) - left

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Rows:
        codes, left = flat(batch.column(7))
        parts = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(cls.NAMES)}
        return cls(parts | {x: parts[x].astype(np.int64) for x in ("pos", "n")}, codes, left.astype(np.int64))

    def take(self, at: np.ndarray) -> Rows:
        left = self.left[at]
        where = np.repeat(self.start[at] - (np.cumsum(left) - left), left) + np.arange(left.sum())
        return Rows({x: self.__dict__[x][at] for x in self.NAMES}, self.codes[where], left)

    def then(self, more: Rows) -> Rows:
        return Rows({x: np.concatenate([self.__dict__[x], more.__dict__[x]]) for x in self.NAMES}, np.concatenate([self.codes, more.codes]), np.concatenate([self.left, more.left]))

    def __len__(self) -> int:
        return len(self.n)


def shared(rows: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of common tokens of pairs of rows, from their token on."""
    count = np.ones(len(i), np.int64)
    width = np.maximum(rows.left[i], rows.left[j])
    for low, high in ((0, 8), (8, 16), (16, 32)):
        at = np.flatnonzero((width > low) & (width <= high))
        step = np.arange(high)
        for part in np.array_split(at, 1 + len(at) * high * high // (1 << 24)):
            a, b = (rows.codes[np.minimum(rows.start[k][:, None] + step, len(rows.codes) - 1)] for k in (i[part], j[part]))
            same = (a[:, :, None] == b[:, None, :]) & (step < rows.left[i[part]][:, None])[:, :, None] & (step < rows.left[j[part]][:, None])[:, None, :]
            count[part] += same.sum((1, 2))
    for k in np.flatnonzero(width > 32).tolist():
        a, b = (rows.codes[rows.start[x] : rows.start[x] + rows.left[x]] for x in (i[k], j[k]))
        count[k] += len(np.intersect1d(a, b, assume_unique=True))
    return count


def meet(rows: Rows, homes: int, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(class_a, class_b, n_common, similarity) of the pairs to be found in these rows, sorted by group,
    homes before visitors, and size; of the first `homes` rows the pairs among them are known already.

    The first of a pair is a home whose token lies among its rarest |x| - ceil(2 t / (1 + t) |x|) + 1.
    """
    m, which = len(rows), rows.__dict__["class"]
    new = np.ones(m, bool)
    new[1:] = (rows.token[1:] != rows.token[:-1]) | (rows.cell[1:] != rows.cell[:-1])
    group, visits = np.cumsum(new) - 1, rows.visits.astype(bool)
    wide = int(rows.n.max()) + 2
    base = group * wide
    first = np.flatnonzero(~visits & (rows.pos < prefix_size(rows.n, 2 * threshold / (1 + threshold))))
    keys = base[first] + rows.n[first]
    low = np.searchsorted(keys, base + np.ceil(rows.n * threshold - SLACK).astype(np.int64))
    high = np.where(visits, np.searchsorted(keys, base + rows.n, side="right"), np.searchsorted(first, np.arange(m)))
    partners = np.maximum(0, high - low)
    partners[:homes] = 0
    upto = np.cumsum(partners)
    far = rows.far.view(np.uint8).reshape(m, 8).astype(np.int16)
    edge = int((1 - threshold) * 255) + 2
    lo = 0
    while lo < m:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + MEET, side="right")))
        here = partners[lo:hi]
        j = np.repeat(np.arange(lo, hi), here)
        i = first[np.repeat(low[lo:hi] - (np.cumsum(here) - here), here) + np.arange(len(j))]
        lo = hi
        a, b = rows.n[i], rows.n[j]
        ok = np.minimum(a - rows.pos[i], b - rows.pos[j]) >= np.ceil((a + b) * (threshold / (1 + threshold)) - SLACK)
        i, j = i[ok], j[ok]
        ok = ~visits[j] | (rows.n[i] < rows.n[j]) | (which[i] < which[j])  # ties at a visitor
        ok &= (np.abs(far[i] - far[j]) <= edge).all(1)
        i, j = i[ok], j[ok]
        both, total = shared(rows, i, j), rows.n[i] + rows.n[j]
        ok = both >= threshold * (total - both) - SLACK
        if ok.any():
            x, y, both, total = which[i[ok]], which[j[ok]], both[ok], total[ok]
            yield np.minimum(x, y), np.maximum(x, y), both, both / (total - both)


def stream(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of layout rows that come in order; of a group that goes on, the homes are kept."""
    kept: Rows | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, homes = Rows.of(batch), 0
        if kept is not None and (kept.token[0], kept.cell[0]) == (rows.token[0], rows.cell[0]):
            homes = len(kept)
            rows = kept.then(rows)
        for a, b, n, s in meet(rows, homes, threshold):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n), pa.array(s)], names=["class_a", "class_b", "n_common", "similarity"])
        last = (rows.token == rows.token[-1]) & (rows.cell == rows.cell[-1]) & ~rows.visits.astype(bool)
        kept = rows.take(np.flatnonzero(last)) if last.any() else None


def class_links(sets: DataFrame, counts: np.ndarray, large: dict[int, int], pivots: list[np.ndarray], threshold: float) -> DataFrame:
    """(class_a, class_b, n_common, similarity) of the pairs of different classes that reach the
    threshold, class_a < class_b, exactly."""
    kind = sets.schema["class"].dataType.simpleString()
    sizes = np.zeros(BUCKETS, np.int64)
    sizes[list(large)] = list(large.values())

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield place(batch, counts, sizes, pivots, threshold)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return stream(batches, threshold)

    # (the condition always holds; with it this reads the same columns as the other uses of the sets)
    laid = sets.filter("copies > 0").select("codes", "class").mapInArrow(lay, f"token bigint, cell int, visits boolean, class {kind}, pos int, n int, far bigint, rest array<bigint>")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = laid.repartition(parts, "token", "cell").sortWithinPartitions("token", "cell", "visits", "n", "class")
    met = ordered.mapInArrow(join, f"class_a {kind}, class_b {kind}, n_common bigint, similarity double")
    return met.groupBy("class_a", "class_b").agg(F.max("n_common").alias("n_common"), F.max("similarity").alias("similarity"))


def _prepared(records: DataFrame, threshold: float, least: int, pivots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    whole, sets = classes(records.select(F.col("id").cast("bigint").alias("id"), "item"), least)
    counts = bucket_counts(whole)
    n = whole.count()
    return whole, sets, class_links(sets, counts, large_groups(whole, n, counts, threshold), choose_pivots(whole, n, min(pivots, PIVOTS)), threshold)


def similar_pairs(records: DataFrame, threshold: float = 0.7, least: int = 4, pivots: int = PIVOTS, expand: int | None = EXPAND) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of records with Jaccard similarity of at least `threshold`.

    `records` has rows (id, item), id an integer. Rows with a null are left out and repeated rows count
    once; records of fewer than `least` items take no part; ties at the threshold are pairs; an empty
    table gives no row; other columns are not read. Records with equal sets are paired among
    themselves and with every partner of their class. A class of more than `expand` copies is paired
    through its representative only (representative with each copy, and with its partners), so that
    copies never give a quadratic result; `class_members` tells the rest. With `expand` None every
    class is expanded.
    """
    whole, sets, links = _prepared(records, threshold, least, pivots)
    most = (1 << 30) if expand is None else expand
    own = members(whole, sets.filter("copies > 1"))  # most classes have one record; the others are looked up
    speakers = cut(own.filter((F.col("copies") <= most) | (F.col("id") == F.col("class"))).select("id", "class", "copies"))
    across = (
        links.join(speakers.select(F.col("class").alias("class_a"), F.col("id").alias("x")), "class_a", "left")
        .join(speakers.select(F.col("class").alias("class_b"), F.col("id").alias("y")), "class_b", "left")
        .select(F.coalesce("x", "class_a").alias("x"), F.coalesce("y", "class_b").alias("y"))
    )
    if expand is None:
        within = speakers.select("class", F.col("id").alias("x")).join(speakers.select("class", F.col("id").alias("y")), "class").filter("x < y").select("x", "y")
    else:
        small = speakers.filter(F.col("copies") <= most).groupBy("class").agg(F.array_sort(F.collect_list("id")).alias("ids"))
        within = small.select(F.posexplode("ids").alias("i", "x"), "ids").select("x", F.explode(F.slice("ids", F.col("i") + 2, F.lit(most))).alias("y"))
    star = own.filter((F.col("copies") > most) & (F.col("id") != F.col("class"))).select(F.col("class").alias("x"), F.col("id").alias("y"))
    pairs = across.unionByName(within).unionByName(star)
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def class_members(records: DataFrame, threshold: float = 0.7, least: int = 4, pivots: int = PIVOTS) -> DataFrame:
    """(id, class_id, n_links): one row per record that takes part, with the class of equal sets it
    belongs to and the number of other classes that are similar to it."""
    whole, sets, links = _prepared(records, threshold, least, pivots)
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    return members(whole, sets).join(ends, "class", "left").select("id", F.col("class").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
