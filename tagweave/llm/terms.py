"""Frequency of every distinct term by a vertical layout: per term compressed bitmaps of the records
that hold it, with a counter of its occurrences beside.

A record identifier is cut into its upper part and its lower 16 bits. The identifiers of a term with the
same upper part are one container: a sorted array of two-byte numbers where they are few, a bitmap of
8 KB where they are 4,096 or more. Each task makes containers of its own rows, so what is shuffled is
about two bytes per record and term; containers of one term and upper part are merged by union, and the
document frequency is the sum of their cardinalities. A term that most records hold is spread over
all tasks by the upper parts. The union over all terms, for the number of records, is one more term
(null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RARE_BELOW = 3
COMMON_ABOVE = 0.5
DENSE = 4_096  # members from which on a container is a bitmap
ROWS = 500_000  # that a task makes containers of together


def packed(owner: np.ndarray, low: np.ndarray, groups: int) -> pa.Array:
    """Containers of (group, low 16 bits) rows, sorted and without repetition; of `groups` groups."""
    sizes = np.bincount(owner, minlength=groups)
    dense = sizes >= DENSE
    length = np.where(dense, DENSE, sizes)  # in two-byte numbers
    at = np.cumsum(length) - length
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(length.sum(), np.uint16)
    few = ~dense[owner]
    out[(at[owner] + np.arange(len(owner)) - begin[owner])[few]] = low[few]
    for g in np.flatnonzero(dense).tolist():
        bits = np.zeros(1 << 16, np.uint8)
        bits[low[begin[g] : begin[g] + sizes[g]]] = 1
        out[at[g] : at[g] + DENSE] = np.packbits(bits, bitorder="little").view(np.uint16)
    offsets = np.append(2 * at, 2 * len(out)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), groups, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(container, low 16 bits) rows of containers."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]].view(np.uint16) if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint16)
    sizes = np.diff(offsets) // 2
    owner = np.repeat(np.arange(n), sizes)
    dense = sizes == DENSE
    few = ~dense[owner]
    owners, lows = [owner[few]], [data[few]]
    begin = np.cumsum(sizes) - sizes
    for c in np.flatnonzero(dense).tolist():
        low = np.flatnonzero(np.unpackbits(data[begin[c] : begin[c] + DENSE].view(np.uint8), bitorder="little"))
        owners.append(np.full(len(low), c))
        lows.append(low.astype(np.uint16))
    return np.concatenate(owners), np.concatenate(lows)


def distinct(owner: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(owner.astype(np.int64) << 16 | low.astype(np.int64))
    return key >> 16, (key & 0xFFFF).astype(np.uint16)


def groups_of(*columns: np.ndarray) -> np.ndarray:
    """Number of the run of equal rows that each row belongs to."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def containers(rows: DataFrame, term: str = "tag", record: str = "id") -> DataFrame:
    """(term, part, occurrences, members): containers of the rows of each task.

    A null term is left out. Rows with a null record occur but are in no record: they are counted under
    a null part. The null term has the records of all rows, without occurrences.
    """
    kind = rows.schema[term].dataType.simpleString()

    def make(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        terms = table.column(0).combine_chunks().dictionary_encode()
        code, ids = terms.indices.to_numpy().astype(np.int64), table.column(1).combine_chunks()
        real = ids.is_valid().to_numpy(zero_copy_only=False)
        empty = np.bincount(code[~real], minlength=len(terms.dictionary))
        if empty.any():
            at = np.flatnonzero(empty)
            nothing = packed(np.zeros(0, np.int64), np.zeros(0, np.uint16), len(at))
            yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(at)), pa.nulls(len(at), pa.int64()), pa.array(empty[at].astype(np.int64)), nothing], names=names)
        code, ids = code[real], ids.drop_null().to_numpy()
        if not len(ids):
            return
        order = np.lexsort((ids, code))
        code, ids = code[order], ids[order]
        group = groups_of(code, ids >> 16)
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        owner, low = distinct(group, (ids & 0xFFFF).astype(np.uint16))
        counts = np.bincount(group).astype(np.int64)
        yield pa.RecordBatch.from_arrays([terms.dictionary.take(pa.array(code[begin])), pa.array(ids[begin] >> 16), pa.array(counts), packed(owner, low, len(begin))], names=names)
        ids = np.unique(ids)
        group = groups_of(ids >> 16)
        begin = np.flatnonzero(np.diff(group, prepend=-1))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(begin), terms.dictionary.type), pa.array(ids[begin] >> 16), pa.array(np.zeros(len(begin), np.int64)), packed(group, (ids & 0xFFFF).astype(np.uint16), len(begin))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= ROWS:
                yield from make(waiting)
                waiting = []
        if sum(b.num_rows for b in waiting):
            yield from make(waiting)

    names = ["term", "part", "occurrences", "members"]
    live = rows.filter(F.col(term).isNotNull()).select(F.col(term), F.col(record).cast("bigint"))
    return live.mapInArrow(run, f"term {kind}, part bigint, occurrences bigint, members binary")


def merged(parts: DataFrame) -> DataFrame:
    """(term, part, occurrences, cardinality, members): containers of each term and part as one, by union."""
    kind = parts.schema["term"].dataType.simpleString()
    names = ["term", "part", "occurrences", "cardinality", "members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # what the last group has come to; it may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
            codes = table.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
            part = table.column(1)
            group = groups_of(codes, part.fill_null(0).to_numpy(), part.is_null().to_numpy(zero_copy_only=False))
            begin = np.flatnonzero(np.diff(group, prepend=-1))
            container, low = unpacked(table.column(3))
            owner, low = distinct(group[container], low)
            counts = np.bincount(group, table.column(2).to_numpy()).astype(np.int64)
            sizes = np.bincount(owner, minlength=len(begin)).astype(np.int64)
            first = pa.array(begin)
            one = pa.RecordBatch.from_arrays([table.column(0).take(first), part.take(first), pa.array(counts), pa.array(sizes), packed(owner, low, len(begin))], names=names)
            yield one.slice(0, len(begin) - 1)
            last = one.slice(len(begin) - 1).select(["term", "part", "occurrences", "members"])
        if last is not None:
            _, low = unpacked(last.column(3))
            yield pa.RecordBatch.from_arrays([*last.columns[:3], pa.array([len(low)], pa.int64()), last.column(3)], names=names)

    spread = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = parts.repartition(spread, "term", "part").sortWithinPartitions("term", "part")
    return ordered.mapInArrow(run, f"term {kind}, part bigint, occurrences bigint, cardinality bigint, members binary")


def frequencies(rows: DataFrame, term: str = "tag", record: str = "id", rare_below: int = RARE_BELOW, common_above: float = COMMON_ABOVE) -> DataFrame:
    """(term, n_elements, n_records, mark) of every distinct term of rows (term, record).

    n_elements counts every row, repeated rows and rows with a null record too; n_records is the
    cardinality of the term's bitmap. mark is 'rare' below `rare_below` records (a term that only
    occurs with null records has 0), 'common' above the share `common_above` of all records that hold
    any term, else null; a term that is both, in a collection of very few records, is 'common'. Records
    are integers. An empty table gives no row.
    """
    each = merged(containers(rows, term, record)).groupBy("term").agg(F.sum("occurrences").alias("n_elements"), F.sum("cardinality").alias("n_records"))
    # not a filter, and with a condition that always holds: so both uses of `each` read the same columns,
    # and Spark makes it once
    total = each.agg(F.max(F.when(F.col("term").isNull() & (F.col("n_elements") >= 0), F.col("n_records")))).scalar()
    share = F.col("n_records") / F.coalesce(total, F.lit(1))
    mark = F.when(share > common_above, "common").when(F.col("n_records") < rare_below, "rare")
    return each.filter("n_elements > 0").select(F.col("term").alias(term), "n_elements", "n_records", mark.alias("mark"))
