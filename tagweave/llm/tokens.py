"""Encoding, counting and decoding of a text column with a public tokenizer.

The vocabulary is a rank file (base64 token, id) at a path that every executor can read. Texts go
to Python as Arrow buffers and come back as Arrow lists; no Python string is made on the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.bpe import decode, encoder

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ROWS = 1024  # texts encoded at once within an Arrow batch


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): ids of each text without special tokens, exactly as stored.

    An empty and a null text have an empty list, a null key stays null, repeated rows stay repeated,
    an empty table gives no rows; texts of any length are encoded whole. Other columns of `docs` are
    not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids, counts = tokenizer.encode(part.column(1))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["key", "ids"])

    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def count(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): as `encode`, without the ids; an empty or null text has 0."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                _, counts = tokenizer.encode(part.column(1), want_ids=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts)], names=["key", "n_tokens"])

    return docs.select(F.col(key).alias("key"), F.col(text)).mapInArrow(run, f"key {kind}, n_tokens bigint").withColumnRenamed("key", key)


def decoded(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text): the text of each list of ids; a null or empty list is an empty text, an id
    without a token and bytes that are no UTF-8 give U+FFFD."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary).vocabulary
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [decode(words, x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return encoded.select(F.col(key).alias("key"), F.col(ids)).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
