"""Byte layouts and encryption of entries."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("ts", T.LongType()), T.StructField("namespace", T.StringType())])


def _le(n: Column, size: int) -> Column:
    """n as size bytes, lowest first."""
    h = F.lpad(F.hex(n.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(size))))


def encode_entry(key: Column, value: Column, ts: Column, namespace: Column) -> Column:
    """Fixed layout, little endian: key length u16, key, tombstone u8, value length u32, value, ts u64, namespace length u16, namespace."""
    v = F.coalesce(value, F.lit(bytearray()))
    ns = namespace.cast("binary")
    return F.concat(_le(F.octet_length(key), 2), key, F.when(value.isNull(), F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), _le(F.octet_length(v), 4), v, _le(ts, 8), _le(F.octet_length(ns), 2), ns)


def _uint(b: Column, at: Column, size: int) -> Column:
    """The number in size bytes from at (from 1), lowest first."""
    part = F.hex(b.substr(at, F.lit(size)))
    return F.conv(F.concat(*(F.substring(part, 2 * (size - i) - 1, 2) for i in range(size))), 16, 10).cast("bigint")


def decode_entry(b: Column) -> Column:
    """A struct (key, value, ts, namespace) of an encoded entry; null if the bytes end early. Numbers from 2^63 on don't fit."""
    n = F.octet_length(b)
    klen = _uint(b, F.lit(1), 2)
    at_tomb = klen + 3
    vlen = _uint(b, (at_tomb + 1).cast("int"), 4)
    at_ts = at_tomb + 5 + vlen
    nslen = _uint(b, (at_ts + 8).cast("int"), 2)
    whole = (n >= 17) & (n >= at_ts + 9) & (n >= at_ts + 9 + nslen)
    i = lambda c: c.cast("int")
    key = b.substr(F.lit(3), i(klen))
    value = F.when(F.hex(b.substr(i(at_tomb), F.lit(1))) == "00", b.substr(i(at_tomb + 5), i(vlen)))
    return F.when(whole, F.struct(key.alias("key"), value.alias("value"), _uint(b, i(at_ts), 8).alias("ts"), b.substr(i(at_ts + 10), i(nslen)).cast("string").alias("namespace")))


def log_record_crc(encoded: Column) -> Column:
    """The IEEE CRC-32 of an encoded entry, as its log record holds it."""
    return F.crc32(encoded)


def block_key(master: bytes, info: bytes) -> object:
    """A vectorised function from block id (binary) to its 32-byte key: HKDF with SHA-256, the block id as salt."""

    @F.pandas_udf(T.BinaryType())
    def derive(ids: pd.Series) -> pd.Series:
        def one(i: bytes | None) -> bytes | None:
            if i is None:
                return None
            prk = hmac.new(bytes(i), master, hashlib.sha256).digest()
            return hmac.new(prk, info + b"\x01", hashlib.sha256).digest()

        return ids.map(one)

    return derive


def encrypt_block(data: Column, key: Column) -> Column:
    """AES-256-GCM: nonce (12 bytes), ciphertext, tag (16 bytes); 28 bytes more than data."""
    return F.aes_encrypt(data, key, F.lit("GCM"))


def decrypt_block(data: Column, key: Column) -> Column:
    """The plain bytes, null if the data or the key is wrong."""
    return F.try_aes_decrypt(data, key, F.lit("GCM"))


def xxh3_64(data: Column) -> Column:
    """The 64-bit XXH3 hash of binary data, seed 0, as 16 hexadecimal digits; null of null. Spark's own xxhash64 is the older XXH64."""

    @F.pandas_udf(T.StringType())
    def digest(x: pd.Series) -> pd.Series:
        import xxhash

        return x.map(lambda b: None if b is None else xxhash.xxh3_64_hexdigest(bytes(b)))

    return digest(data)


def compress_block(data: Column, level: int = 3) -> Column:
    """data as a zstd frame; null of null."""

    @F.pandas_udf(T.BinaryType())
    def packed(x: pd.Series) -> pd.Series:
        import zstandard

        c = zstandard.ZstdCompressor(level=level)
        return x.map(lambda b: None if b is None else c.compress(bytes(b)))

    return packed(data)


def decompress_block(data: Column) -> Column:
    """The bytes of a zstd frame; null of null and of what isn't a whole frame."""

    @F.pandas_udf(T.BinaryType())
    def plain(x: pd.Series) -> pd.Series:
        import zstandard

        d = zstandard.ZstdDecompressor()

        def one(b: bytes | None) -> bytes | None:
            try:
                return None if b is None else d.decompress(bytes(b))
            except zstandard.ZstdError:
                return None

        return x.map(one)

    return plain(data)
