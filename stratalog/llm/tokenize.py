"""Encoding of a text column with a public byte-level tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stratalog.llm.bpe import PairIndexBPE, Vocabulary, token_bytes
from stratalog.llm.scan import gather
from stratalog.model import fresh

#: Where the vocabulary files are found unless a path is given.
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.json"

#: Tokens that are decoded at once; a longer list by itself.
DECODED = 1 << 18

_held: list[PairIndexBPE] = []


def shared_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary, read on the driver and broadcast: about 2 MB, whatever the corpus."""
    return spark.sparkContext.broadcast(Vocabulary(path))


def encoder(b: Broadcast) -> PairIndexBPE:
    """The encoder of this Python worker, with the words that its earlier tasks met."""
    v = b.value
    if not _held or _held[0].v.key != v.key:
        _held[:] = [PairIndexBPE(v)]
    return _held[0]


def with_column(batch: pa.RecordBatch, i: int, j: int, name: str, column: pa.Array) -> pa.RecordBatch:
    """Rows i to j of batch with the column added, or put in place of one of that name."""
    part = batch.slice(i, j - i)
    cols = {n: c for n, c in zip(part.schema.names, part.columns, strict=True) if n != name} | {name: column}
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def encode(df: DataFrame, text: str, out: str = "ids", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """df with ``out``: the token ids of the text column as array<int>, special tokens' strings being ordinary text.

    Null and empty texts get an empty list. A column named like out is replaced; others are kept. No row moves: each
    partition is read batch by batch, in chunks of bounded size, and written. A text of any length is encoded whole."""
    if text == out:
        (held,) = fresh(df, "text")
        return encode(df.withColumnRenamed(text, held), held, out, vocabulary).drop(held)
    b = shared_vocabulary(df.sparkSession, vocabulary)
    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(b)
        for batch in batches:
            at = 0
            for ids in e.encode(batch.column(text)):
                yield with_column(batch, at, at + len(ids), out, ids)
                at += len(ids)

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str, out: str = "text", vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """df with ``out``: the bytes (binary) that the token ids of a row stand for, empty for a null or empty list. An id that the vocabulary doesn't have
    raises. A column named like out is replaced. No row moves."""
    if ids == out:
        (held,) = fresh(df, "ids")
        return decode(df.withColumnRenamed(ids, held), held, out, vocabulary).drop(held)
    b = df.sparkSession.sparkContext.broadcast(token_bytes(vocabulary))  # half a megabyte, whatever the corpus
    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, width, tokens = b.value
        for batch in batches:
            column = batch.column(ids)
            lists = column.fill_null([]) if column.null_count else column
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + DECODED, "right")) - 1)
                flat = lists.slice(i, j - i).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                data, off = gather(tokens, begin[flat], width[flat])
                texts = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(off[ends[i : j + 1] - ends[i]]), pa.py_buffer(data)])
                yield with_column(batch, i, j, out, texts.cast(pa.binary()))
                i = j

    return kept.mapInArrow(run, schema)
