"""Filling containers of fixed capacity with documents by swap-based local search.

Each task measures the documents of its own partition and packs them in blocks, so nothing is
shuffled, no group of documents can grow hot, and the space lost at the edge of a block is at most
part of one container in some thousands. A block begins with best fit in decreasing order. The local
search then goes over the underfull containers, the emptiest first: it moves documents out of it and
exchanges one for one, two for one or one for two with other underfull containers, always the step that
raises the sum of squared fills most, until it is empty or no step raises the sum. So free space gathers
in few containers until these are empty. Rounds are repeated until one changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.bpe import encoder
from tagweave.llm.tokens import ROWS, VOCABULARY

CAPACITY = 2048
BLOCK = 16_384  # documents packed together
PAIR_ITEMS = 32  # of a container, its largest, are looked at for exchanges of two
ROUNDS = 8  # of the local search over all underfull containers of a block, at most


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: each item, largest first, into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            at = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
            bins[at].append(i)
        else:
            free, at = capacity, len(bins)
            bins.append([i])
        room[free - size].append(at)
        mask |= 1 << (free - size)
    return bins


class _Search:
    def __init__(self, sizes: np.ndarray, bins: list[list[int]], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins = [list(b) for b in bins]
        self.fill = np.array([int(sizes[b].sum()) for b in self.bins], np.int64)

    def groups(self, b: int) -> list[tuple[int, ...]]:
        """No item, each item, and each pair of the largest items of a bin."""
        items = sorted(self.bins[b], key=lambda i: -self.sizes[i])
        return [(), *((i,) for i in items), *combinations(items[:PAIR_ITEMS], 2)]

    def best(self, source: int, table: list) -> tuple | None:
        """The exchange (out of source, into it, target) that raises the squared fill most."""
        owner, sums, counts, takes = table
        mine = self.groups(source)[1:]
        give = np.array([int(self.sizes[list(g)].sum()) for g in mine])
        n_give = np.array([len(g) for g in mine])
        free = self.capacity - self.fill[owner]
        live = (self.fill[owner] >= self.fill[source]) & (free > 0) & (owner != source)
        places = np.flatnonzero(live)
        if not len(places) or not len(give):
            return None
        shift = give[:, None] - sums[places][None, :]
        # one-for-one, two-for-one, one-for-two and plain moves; not two for two
        fine = (shift > 0) & (shift <= free[places][None, :]) & (n_give[:, None] + counts[places][None, :] < 4)
        gain = np.where(fine, shift * (self.fill[owner[places]][None, :] - self.fill[source] + shift), 0)
        at = int(gain.argmax())
        g, p = divmod(at, len(places))
        if gain[g, p] <= 0:
            return None
        return mine[g], takes[places[p]], int(owner[places[p]])

    def table(self, targets: np.ndarray) -> list:
        owner, takes = [], []
        for b in targets.tolist():
            for g in self.groups(b):
                owner.append(b)
                takes.append(g)
        sums = np.array([int(self.sizes[list(g)].sum()) if g else 0 for g in takes], np.int64)
        return [np.array(owner, np.int64), sums, np.array([len(g) for g in takes], np.int64), takes]

    def replace_rows(self, table: list, b: int) -> list:
        owner, sums, counts, takes = table
        keep = np.flatnonzero(owner != b)
        groups = self.groups(b) if 0 < self.fill[b] < self.capacity else []
        return [
            np.concatenate([owner[keep], np.full(len(groups), b, np.int64)]),
            np.concatenate([sums[keep], np.array([int(self.sizes[list(g)].sum()) if g else 0 for g in groups], np.int64)]),
            np.concatenate([counts[keep], np.array([len(g) for g in groups], np.int64)]),
            [takes[i] for i in keep.tolist()] + groups,
        ]

    def run(self) -> list[list[int]]:
        """Rounds over all underfull bins, the emptiest first; each gives what it can. Ends when the bins are
        as few as can be, or a round changes nothing, or after ROUNDS."""
        least = -(-int(self.sizes.sum()) // self.capacity)
        underfull = lambda: np.flatnonzero((self.fill > 0) & (self.fill < self.capacity))
        table = self.table(underfull())
        for _ in range(ROUNDS):
            changed = False
            done = np.zeros(len(self.bins), bool)
            while np.count_nonzero(self.fill) > least:
                rest = underfull()
                rest = rest[~done[rest]]
                if not len(rest):
                    break
                source = int(rest[self.fill[rest].argmin()])
                done[source] = True
                moved = False
                while self.fill[source] > 0 and (step := self.best(source, table)):
                    self.exchange(source, *step)
                    table = self.replace_rows(table, step[2])
                    moved = True
                if moved:
                    table = self.replace_rows(table, source)
                changed |= moved
            if not changed or np.count_nonzero(self.fill) <= least:
                break
        return [b for b in self.bins if b]

    def exchange(self, source: int, out: tuple[int, ...], into: tuple[int, ...], target: int) -> None:
        for i in out:
            self.bins[source].remove(i)
        for i in into:
            self.bins[target].remove(i)
        self.bins[source] += into
        self.bins[target] += out
        moved = int(self.sizes[list(out)].sum()) - (int(self.sizes[list(into)].sum()) if into else 0)
        self.fill[source] -= moved
        self.fill[target] += moved


def pack(sizes: np.ndarray, capacity: int = CAPACITY, said: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, size, bin) of every piece of items of the given sizes.

    An item above the capacity is cut into full pieces and a rest, no other is. An item of size 0 is
    one piece and lies in the first bin. `said` gets (items, least bins, bins of best fit, bins after the
    local search).
    """
    sizes = np.asarray(sizes, np.int64)
    pieces = np.maximum(1, -(-sizes // capacity))
    item = np.repeat(np.arange(len(sizes)), pieces)
    start = (np.arange(len(item)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
    part = np.minimum(capacity, sizes[item] - start)
    where = np.zeros(len(item), np.int64)
    full = np.flatnonzero(part == capacity)
    loose = np.flatnonzero((part > 0) & (part < capacity))
    where[full] = np.arange(len(full))
    first, bins = [], []
    if len(loose):
        first = best_fit(part[loose], capacity)
        bins = _Search(part[loose], first, capacity).run()
        for n, b in enumerate(bins):
            where[loose[b]] = len(full) + n
    if said is not None:
        said.append((len(sizes), -(-int(sizes.sum()) // capacity), len(full) + len(first), len(full) + len(bins)))
    return item, start, part, where


def fill_containers(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(key, piece, container, start, n_tokens): where each document, or piece of one, lies.

    Sizes are in tokens of the vocabulary. Only a text of more than `capacity` tokens is cut, into full
    pieces and a rest, numbered from 0, `start` being the first token. Empty and null texts take no
    space and lie in some container. Repeated rows are packed as often as they occur, a null key stays
    null, an empty table gives no row; other columns are not read. A container's number holds those of
    task, block and bin.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "piece", "container", "start", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary)
        task = TaskContext.get().partitionId()
        number, waiting, keys, sizes = 0, 0, [], []

        def flush() -> pa.RecordBatch:
            item, start, part, where = pack(np.concatenate(sizes), capacity)
            column = pa.concat_arrays(keys).take(pa.array(item))
            box = (task << 40) + (number << 24) + where
            return pa.RecordBatch.from_arrays([column, pa.array(start // capacity, pa.int32()), pa.array(box), pa.array(start), pa.array(part)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                keys.append(rows.column(0))
                sizes.append(tokenizer.encode(rows.column(1), want_ids=False)[1])
                waiting += rows.num_rows
                if waiting >= block:
                    yield flush()
                    number, waiting, keys, sizes = number + 1, 0, [], []
        if waiting:
            yield flush()

    schema = f"key {kind}, piece int, container bigint, start bigint, n_tokens bigint"
    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, schema).withColumnRenamed("key", key)


def block_fill(docs: DataFrame, text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """(block, n_texts, least_containers, n_best_fit, n_containers): what the local search gains on each
    block of `fill_containers`. `block` holds task and number; an empty table gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task, number, sizes, said = encoder(vocabulary), TaskContext.get().partitionId(), 0, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                sizes.append(tokenizer.encode(batch.slice(at, ROWS).column(0), want_ids=False)[1])
                if sum(map(len, sizes)) >= block:
                    pack(np.concatenate(sizes), capacity, said)
                    sizes = []
        if sum(map(len, sizes)):
            pack(np.concatenate(sizes), capacity, said)
        rows = [((task << 20) + number, *x) for number, x in enumerate(said)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=["block", "n_texts", "least_containers", "n_best_fit", "n_containers"])

    return docs.select(text).mapInArrow(run, "block bigint, n_texts bigint, least_containers bigint, n_best_fit bigint, n_containers bigint")


def laws(packed: DataFrame, counted: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(n_texts, n_overfull, n_cut, n_gaps, n_wrong) of a packing: one row. Texts in it; containers above
    the capacity; texts within it that were cut; texts whose pieces don't lie end to end; texts whose
    pieces don't add up to `counted` (key, n_tokens), or that are in one table only. Keys are unique."""
    boxes = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("n_overfull"))
    texts = packed.groupBy(key).agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.min("start").alias("a"), F.max(F.col("start") + F.col("n_tokens")).alias("b"))
    met = texts.join(counted.select(key, F.col("n_tokens").alias("want")), key, "full")
    each = met.agg(
        F.count("n").alias("n_texts"),
        F.count_if((F.col("pieces") > 1) & (F.col("n") <= capacity)).alias("n_cut"),
        F.count_if((F.col("a") != 0) | (F.col("b") != F.col("n"))).alias("n_gaps"),
        F.count_if(~F.col("n").eqNullSafe(F.col("want"))).alias("n_wrong"),
    )
    return each.crossJoin(boxes)  # two tables of one row


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(n_containers, n_tokens, least_containers, unused_share) of a packing: one row."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    total = each.agg(F.count(F.lit(1)).alias("n_containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tokens"))
    return total.select(
        "n_containers",
        "n_tokens",
        F.ceil(F.col("n_tokens") / capacity).alias("least_containers"),
        F.try_divide(F.col("n_containers") * capacity - F.col("n_tokens"), F.col("n_containers") * capacity).alias("unused_share"),
    )
