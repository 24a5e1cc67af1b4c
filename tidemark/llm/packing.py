"""Best-fit packing of documents into sequences with vector capacities.

A bin has residual tokens, documents and attention cost (a piece of n tokens costs n * n).  Pieces go in falling
length, each into the bin that fits under every constraint and is best by weighted dot product or by the weighted
norm of what would be left.  Groups of pieces, drawn by hash and large enough that a group's last bins do not matter,
are packed apart, so no task holds more than one group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chunks, materialise, utf8
from tidemark.llm.tokens import WordBpe, WordTable

_TABLES: dict[str, WordTable] = {}


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds, the weight of each dimension, and the rule: ``norm`` or ``dot``.

    With the default capacities only tokens can run out (a piece has one at least, and a sum of squares is at most the
    square of the sum), so the other weights decide among bins of like tokens: one with more documents is filled up
    before one with few.  They are small enough to cost no sequence (see the tests).
    """

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 4.0, 0.05)
    rule: str = "norm"


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece.  A piece alone always fits a fresh bin."""
    order = np.argsort(-lengths, kind="stable")
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    w = np.array(cap.weights)
    left, ids, n = np.empty((64, 3)), np.empty(64, np.int64), 0
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    bins, least = 0, int(lengths.min()) if len(lengths) else 0
    for k, i in enumerate(order.tolist()):
        need = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        best = -1
        if n:
            live = left[:n]
            fits = np.flatnonzero((live[:, 0] >= need[0]) & (live[:, 1] >= 1) & (live[:, 2] >= need[2]))
            if len(fits):
                rest = (live[fits] - need) / full
                score = (rest * rest) @ w if cap.rule == "norm" else -((live[fits] / full) @ (w * need / full))
                best = int(fits[np.argmin(score)])
        if best < 0:
            if n == len(ids):
                left, ids = np.concatenate([left, np.empty_like(left)]), np.concatenate([ids, np.empty_like(ids)])
            left[n], ids[n], best = full, bins, n
            n, bins = n + 1, bins + 1
        where[i], offset[i] = ids[best], cap.tokens - int(left[best, 0])
        left[best] -= need
        if k % 256 == 255:  # bins in which no piece fits any more
            open_ = np.flatnonzero((left[:n, 0] >= least) & (left[:n, 1] >= 1))
            left[: len(open_)], ids[: len(open_)], n = left[open_], ids[open_], len(open_)
    return where, offset


def pack(pieces: DataFrame, cap: Capacity = Capacity(), group_pieces: int = 16_384) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, uid) with sequence_id and offset; uid is unique.

    Pieces that fill a sequence are sequences of their own; the rest are packed.  A piece longer than the capacity is
    an error.  No pieces, no rows.
    """
    spent = pieces.filter("length = %d" % cap.tokens)
    rest = pieces.filter("length < %d" % cap.tokens)
    groups = max(1, -(-rest.count() // group_pieces))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("uid")
        where, offset = best_fit(table.column("length").to_numpy(), cap)
        group = table.column("grp")[0].as_py() if len(table) else 0
        table = table.drop_columns(["grp", "uid"])
        return table.append_column("sequence_id", pa.array(where + (group << 32))).append_column("offset", pa.array(offset))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    packed = rest.withColumn("grp", F.pmod(F.xxhash64("uid"), F.lit(groups))).groupBy("grp").applyInArrow(run, schema)
    alone = spent.select("doc_id", "piece", "start", "length", "ids_crc32", (F.lit(1 << 62) + F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def _cut(path: str, tokens: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TABLES:
            _TABLES[path] = WordTable(WordBpe(path), [end])
        table = _TABLES[path]
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            data, offsets = utf8(batch.column("text"))
            for i, j in chunks(offsets):
                _, ids, n, words = table.encode(table.encode_words.spread(data, offsets[i : j + 1]))
                ids = ids.astype("<u4")
                stop = np.cumsum(n)[np.cumsum(words) - 1]
                out, at = [], 0
                for doc, e in zip(docs[i:j], stop.tolist()):
                    for k, s in enumerate(range(at, e, tokens)):
                        t = min(e, s + tokens)
                        out.append((doc, k, s - at, t - s, zlib.crc32(ids[s:t])))
                    at = e
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def cut_documents(docs: DataFrame, tokenizer: str, tokens: int = 2048, end: int = 0) -> DataFrame:
    """Pieces of at most ``tokens`` ids of each row's ids and end id, with a unique ``uid``; written to the shared folder.

    A null text is empty: its only id is the end.  Repeated rows are cut each; columns besides doc_id and text are
    not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = rows.mapInArrow(_cut(tokenizer, tokens, end), "doc_id long, piece int, start long, length long, ids_crc32 long")
    return materialise(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")


def pack_documents(docs: DataFrame, tokenizer: str, cap: Capacity = Capacity()) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) cut and packed: a row per piece.

    A null or empty text is one piece of one token, its end; a null doc_id stays null; repeated rows are packed each;
    an empty table gives no rows; other columns are not read, whatever their names.
    """
    return pack(cut_documents(docs, tokenizer, cap.tokens), cap)
