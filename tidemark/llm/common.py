"""Shared pieces: shared-folder tables, vectorised text hashing, connected components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import shared_dir

def materialise(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    # the driver deletes a shuffle's files once nothing refers to it, which only a collection of its heap finds out
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes what ``materialise`` wrote; for a table that nothing reads again."""
    files = table.inputFiles()
    if files:
        sc = table.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(os.path.dirname(files[0]))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fan_in(n: int) -> int:
    """Groups of the first of two levels of a tree reduction over ``n`` partial results."""
    return max(1, int(np.ceil(np.sqrt(max(1, n)))))


# ---------------------------------------------------------------- Arrow strings as numpy buffers

def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(offsets: np.ndarray, size: int = 1 << 20):
    """Runs [i, j) of rows of about ``size`` bytes; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


# ---------------------------------------------------------------- hashing

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = powers(256)


def runs_hash(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, 64-bit hash) of each maximal run of bytes that are ``inside``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    length = ends - starts
    longest = int(length.max())
    power = _POWERS if longest <= len(_POWERS) else powers(longest)
    kept = np.flatnonzero(inside)
    first = np.concatenate(([0], np.cumsum(length)[:-1]))
    values = (data[kept].astype(np.uint64) + np.uint64(1)) * power[np.arange(len(kept)) - np.repeat(first, length)]
    return starts, ends, mix(np.add.reduceat(values, first) + length.astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of consecutive rows: hash, row, start and end (from offsets[0])."""
    base, n = offsets[0], len(offsets) - 1
    part = data[base : offsets[-1]]
    if lower:
        part = _LOWER[part]
    # a gap byte before each row keeps words of neighbouring rows apart
    rel = offsets[:-1] - base
    spaced = np.insert(part, rel, 32)
    starts, ends, h = runs_hash(spaced, ~_SPACE[spaced])
    row = np.searchsorted(rel + np.arange(n), starts, "right") - 1
    return h, row, starts - row - 1, ends - row - 1


_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, n: int) -> list[np.ndarray]:
    """Sorted distinct ``n``-word shingle hashes of each row; fewer words make one shingle; none make none."""
    count = np.bincount(row, minlength=n_rows)
    end = np.cumsum(count)
    place = _PLACE if n <= 64 else mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    full = max(0, len(h) - n + 1)
    s = np.zeros(full, np.uint64)
    for j in range(n):
        s += h[j : j + full] * place[j]
    s = mix(s)
    out = []
    for c, e in zip(count.tolist(), end.tolist()):
        if c >= n:
            out.append(np.unique(s[e - c : e - n + 1]))
        elif c:
            out.append(mix(np.array([(h[e - c : e] * place[:c]).sum(dtype=np.uint64) + np.uint64(c)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# ---------------------------------------------------------------- graphs

#: Edges that one task ties together; rounds of joins are for more.
TASK_EDGES = 1_000_000


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest node reachable, node) of every other node of the edges: at most an edge a node."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[u], root[v]
        apart = x != y
        if not apart.any():
            break
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[other]], ids[other]


def _tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches]
    if edges:
        u, v = stars(*(np.concatenate(x) for x in zip(*edges)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with component the smallest node reachable; alternating large and small stars.

    Every round is one aggregation and one join per star (both combine or split hot keys); rounds grow with the
    logarithm of the longest chain, and end once the edges are stars or no more than one task ties together.  Each
    round is written to the shared folder, so no lineage piles up; the round before it is deleted.
    """
    now = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    now = materialise(now, "cc")
    while (left := now.count()) > TASK_EDGES:
        both = now.union(now.select("v", "u"))
        # in stars a node has one smaller neighbour and no other, or none
        near = both.groupBy("u").agg(F.count(F.when(F.col("v") < F.col("u"), 1)).alias("less"), F.count("*").alias("all"))
        if not near.where("less > 0 and all > 1").limit(1).count():
            break
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u < v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        star = large.join(down, "v")
        small = star.select(F.col("m").alias("u"), "v").union(star.where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        before, now = now, materialise(small, "cc")
        discard(before)
    if 0 < left <= TASK_EDGES:
        before, now = now, materialise(now.coalesce(1).mapInArrow(_tie, "u long, v long"), "cc")
        discard(before)
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
