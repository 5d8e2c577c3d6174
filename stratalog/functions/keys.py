"""Master keys of block encryption in a file that all nodes can reach."""

from __future__ import annotations

import secrets

from pyspark.sql import SparkSession

from stratalog.model import StorageFailure
from stratalog.scratch import filesystem

KEY_BYTES = 32


def master_key(spark: SparkSession, path: str) -> bytes:
    """The 32 bytes of the key file; a missing file is made with a random key, for its owner alone. StorageFailure for a file of another length. Of two
    drivers that make one at once the later one reads the other's. Only the driver calls this; ``codecs.block_key`` takes the key to the rows."""
    fs, p = filesystem(spark, path)
    if not fs.exists(p):
        jvm, made = spark._jvm, secrets.token_bytes(KEY_BYTES)
        fs.mkdirs(p.getParent())
        permission = jvm.org.apache.hadoop.fs.permission.FsPermission("600")
        try:
            # created empty and closed to others first, so that the key never lies open
            out = fs.create(p, permission, False, 4096, fs.getDefaultReplication(p), fs.getDefaultBlockSize(p), None)
            fs.setPermission(p, permission)
            out.write(bytearray(made))
            out.close()
        except Exception:
            if not fs.exists(p):
                raise
    held = bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])
    if len(held) != KEY_BYTES:
        raise StorageFailure(f"{path} has {len(held)} bytes, not {KEY_BYTES}")
    return held
