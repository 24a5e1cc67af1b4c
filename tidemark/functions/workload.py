"""Deterministic records for load tests, their validation, and the value codec of key-value backends."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The state that stands for 0, the shifts of the generator, the rotations and domains of the seeds.
ZERO_STATE = 0x9E3779B97F4A7C15
SHIFTS = (13, 7, 17)
METADATA_ROTATION, PAYLOAD_ROTATION = 17, 31
METADATA_DOMAIN, PAYLOAD_DOMAIN = 0x6D65746164617461, 0x7061796C6F616421


def rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def pattern(state: np.ndarray, length: int) -> np.ndarray:
    """Bytes (one row a seed) of the xorshift generator, eight a step, all seeds at once."""
    state = np.where(state == 0, np.uint64(ZERO_STATE), state).astype(np.uint64)
    steps = np.empty((len(state), -(-length // 8)), "<u8")
    a, b, c = (np.uint64(s) for s in SHIFTS)
    for i in range(steps.shape[1]):
        state = state ^ (state << a)
        state = state ^ (state >> b)
        state = state ^ (state << c)
        steps[:, i] = state
    return steps.view(np.uint8)[:, :length]


def _seeds(stream: pd.Series, sequence: pd.Series, rotation: int, domain: int) -> np.ndarray:
    s, q = (x.to_numpy(np.int64).view(np.uint64) for x in (stream, sequence))
    return rotated(s, rotation) ^ q ^ np.uint64(domain)


def _bytes(rotation: int, domain: int, length: int) -> object:
    @F.pandas_udf(T.BinaryType())
    def made(stream: pd.Series, sequence: pd.Series) -> pd.Series:
        return pd.Series([row.tobytes() for row in pattern(_seeds(stream, sequence, rotation, domain), length)])

    return made


def metadata(stream: Column, sequence: Column, length: int) -> Column:
    return _bytes(METADATA_ROTATION, METADATA_DOMAIN, length)(stream, sequence)


def payload(stream: Column, sequence: Column, length: int) -> Column:
    return _bytes(PAYLOAD_ROTATION, PAYLOAD_DOMAIN, length)(stream, sequence)


def records(spark: SparkSession, count: int, streams: int, metadata_bytes: int = 32, payload_bytes: int = 4096) -> DataFrame:
    """``count`` records dealt to ``streams`` in turn: (append_order, stream_id, seq, metadata, payload)."""
    rows = spark.range(count).select(F.col("id").alias("append_order"), (F.col("id") % streams).alias("stream_id"), F.floor(F.col("id") / streams).alias("seq"))
    return rows.withColumn("metadata", metadata(F.col("stream_id"), F.col("seq"), metadata_bytes)).withColumn("payload", payload(F.col("stream_id"), F.col("seq"), payload_bytes))


def invalid(df: DataFrame, metadata_bytes: int, payload_bytes: int) -> DataFrame:
    """Records whose bytes are not those of their stream and sequence; null bytes are not."""
    right = F.col("metadata").eqNullSafe(metadata(F.col("stream_id"), F.col("seq"), metadata_bytes)) & F.col("payload").eqNullSafe(payload(F.col("stream_id"), F.col("seq"), payload_bytes))
    return df.where(~right)


@F.pandas_udf(T.BinaryType())
def encode_value(metadata: pd.Series, payload: pd.Series) -> pd.Series:
    """u32 length of the metadata, metadata, payload, XXH3-64 of these; nulls are empty."""
    import xxhash

    out = []
    for m, p in zip(metadata, payload):
        body = len(m or b"").to_bytes(4, "little") + bytes(m or b"") + bytes(p or b"")
        out.append(body + xxhash.xxh3_64_intdigest(body).to_bytes(8, "little"))
    return pd.Series(out)


VALUE = T.StructType([T.StructField("metadata", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("error", T.StringType())])


@F.pandas_udf(VALUE)
def decode_value(value: pd.Series) -> pd.DataFrame:
    """Metadata and payload, or an error: truncated, checksum, length."""
    import xxhash

    rows = []
    for v in value:
        v = bytes(v or b"")
        if len(v) < 12:
            rows.append((None, None, "truncated"))
        elif xxhash.xxh3_64_intdigest(v[:-8]) != int.from_bytes(v[-8:], "little"):
            rows.append((None, None, "checksum"))
        elif 4 + int.from_bytes(v[:4], "little") > len(v) - 8:
            rows.append((None, None, "length"))
        else:
            cut = 4 + int.from_bytes(v[:4], "little")
            rows.append((v[4:cut], v[cut:-8], None))
    return pd.DataFrame(rows, columns=["metadata", "payload", "error"])


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder of any store; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
