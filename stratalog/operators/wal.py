"""The write-ahead log as framed records: writing, rotation and replay of what a crash left."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions.codecs import encode_entry
from stratalog.operators.ordered import running_sum
from stratalog.operators.writes import encoded_size

#: A record: length u32, CRC-32 u32, encoded entry; little endian.
HEADER, HEADER_BYTES = "<II", 8
#: Bytes of a log file after which the next one begins.
LOG_BYTES = 64 << 20


def log_files(entries: DataFrame, order: str, log_bytes: int = LOG_BYTES) -> DataFrame:
    """(file, content): the framed records of entries in the order of a unique column, in files from 0. A record belongs to the file in which it begins, so a file has log_bytes and
    one record at most, which bounds what a task puts together."""
    framed = entries.withColumn("size", (encoded_size() + HEADER_BYTES).cast("bigint"))
    placed = running_sum(framed, [order], F.col("size"), "at", before=True)
    records = placed.select(F.expr(f"at div {log_bytes}").alias("file"), "at", encode_entry(F.col("key"), F.col("value"), F.col("ts"), F.col("namespace")).alias("b"))

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        return pd.DataFrame({"file": rows["file"].iloc[:1], "content": [b"".join(struct.pack(HEADER, len(b), zlib.crc32(b)) + b for b in map(bytes, rows["b"]))]})

    return records.groupBy("file").applyInPandas(join, "file bigint, content binary")


def _decoded(b: bytes) -> tuple[bytes, bytes | None, int, str]:
    (k,) = struct.unpack_from("<H", b, 0)
    dead, v = struct.unpack_from("<BI", b, 2 + k)
    at = 7 + k + v
    ts, n = struct.unpack_from("<QH", b, at)
    if len(b) < at + 10 + n or dead > 1:
        raise ValueError("the record ends early")
    return b[2 : 2 + k], None if dead else b[7 + k : at], ts, b[at + 10 : at + 10 + n].decode()


def replay(files: DataFrame, file: str, content: str) -> DataFrame:
    """What log files hold: file, at (byte of the record), outcome, and of a whole record namespace, key, value, ts.

    outcome: ``entry``; ``bad_crc`` or ``bad_entry`` for a record that is passed over; ``truncated`` where a file ends inside a record or has one of no length, behind which
    nothing is read. Resolve the entries to undo repeats. A task reads a file at a time; files are bounded by rotation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "at", "outcome", "namespace", "key", "value", "ts"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64()]
        for b in batches:
            for f, data in zip(b.column("f").to_pylist(), b.column("c").to_pylist(), strict=True):
                data, at, out = data or b"", 0, []
                while at < len(data):
                    size, crc = struct.unpack_from(HEADER, data, at) if at + HEADER_BYTES <= len(data) else (0, 0)
                    end = at + HEADER_BYTES + size
                    if not size or end > len(data):
                        out.append((f, at, "truncated", None, None, None, None))
                        break
                    record = data[at + HEADER_BYTES : end]
                    try:
                        key, value, ts, ns = _decoded(record)
                        good = (f, at, "entry", ns, key, value, ts)
                    except (struct.error, ValueError):
                        good = (f, at, "bad_entry", None, None, None, None)
                    out.append(good if zlib.crc32(record) == crc else (f, at, "bad_crc", None, None, None, None))
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return files.select(F.col(file).cast("bigint").alias("f"), F.col(content).alias("c")).mapInArrow(run, "file bigint, at bigint, outcome string, namespace string, key binary, value binary, ts bigint")
