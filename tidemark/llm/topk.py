"""Exact top-k inner products with a bit-sliced index.

Vectors become integers.  A block of rows is indexed as bit slices: slice b of attribute i holds bit b of that
attribute, quantised by a shift, of all rows as a bitmap.  The weighted sum of a query is added up from the slices
with bitmap arithmetic alone (carry-save adders, for all queries of the block at once), which gives the slices of a
coarse score.  Rows are then selected from the most significant slice of the score downward, until k rows are above:
that gives the k-th best coarse score.  What quantising can have changed is bounded, so every row within that bound
of it is a boundary row, and boundary rows get their exact scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _bitmap(bits: np.ndarray) -> np.ndarray:
    """uint64 words of a boolean vector."""
    words = np.zeros(-(-len(bits) // 64) * 8, np.uint8)
    packed = np.packbits(bits, bitorder="little")
    words[: len(packed)] = packed
    return words.view(np.uint64)


class SliceIndex:
    """Bit slices of a block of integer vectors (rows x attributes), quantised to ``bits`` bits an attribute."""

    def __init__(self, vectors: np.ndarray, bits: int = 6):
        self.vectors, self.rows = vectors, len(vectors)
        low, high = vectors.min(0), vectors.max(0)
        self.low = low
        # the shift that leaves ``bits`` bits of the widest attribute; attributes count from their least value
        self.shift = max(0, int((high - low).max()).bit_length() - bits)
        coarse = (vectors - low) >> self.shift
        self.depth = [int(c).bit_length() for c in coarse.max(0)]
        self.slices = [[_bitmap(coarse[:, i] >> b & 1) for b in range(n)] for i, n in enumerate(self.depth)]
        self.valid = _bitmap(np.ones(self.rows, bool))
        # half the range of a quantised attribute: the farthest it lies from its middle
        self.reach = (coarse.max(0) << self.shift) / 2

    def scores(self, queries: np.ndarray, bits: int = 6) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(slices of the coarse scores by weight, queries x words each; slack below, slack above).

        For a query, exact / 2^(shifts) lies in [coarse + const - slack below, coarse + const + slack above], with a
        constant of the query, so coarse scores rank rows up to the slack.
        """
        q_shift = max(0, int(np.abs(queries).max(initial=0)).bit_length() - bits)
        size = (np.abs(queries) + (1 << q_shift >> 1)) >> q_shift  # rounded
        self_low = np.zeros(len(queries))
        self_high = np.zeros(len(queries))
        unit = float(1 << self.shift) * float(1 << q_shift)
        rounding = np.abs(queries) - (size << q_shift)
        # rounding of the query times the attribute, and what the attribute lost times the query
        self_low += (np.abs(rounding) * self.reach).sum(1) / unit
        self_high += (np.abs(rounding) * self.reach).sum(1) / unit
        most = (1 << self.shift) - 1
        self_high += np.where(queries > 0, queries, 0).sum(1) * most / unit
        self_low += np.where(queries < 0, -queries, 0).sum(1) * most / unit
        columns: list[list[np.ndarray]] = [[]]

        def put(weight: int, bitmap: np.ndarray) -> None:
            while len(columns) <= weight:
                columns.append([])
            columns[weight].append(bitmap)
            w = weight
            while w < len(columns) and len(columns[w]) == 3:  # three of a weight: a sum and a carry
                a, b, c = columns[w]
                ab = a ^ b
                columns[w] = [ab ^ c]
                carry = (a & b) | (ab & c)
                if len(columns) == w + 1:
                    columns.append([])
                columns[w + 1].append(carry)
                w += 1

        for i, slices in enumerate(self.slices):
            if not slices:
                continue
            flip = np.where(queries[:, i] < 0, _FULL, np.uint64(0))[:, None]  # a negative weight counts what is missing
            for b, bitmap in enumerate(slices):
                own = bitmap[None] ^ flip
                for qb in range(int(size[:, i].max()).bit_length()):
                    has = np.where(size[:, i] >> qb & 1, _FULL, np.uint64(0))[:, None]
                    put(b + qb, own & has)
        out, carry, w = [], None, 0
        while w < len(columns) or carry is not None:  # ripple what is left: at most two and a carry of a weight
            left = (columns[w] if w < len(columns) else []) + ([carry] if carry is not None else [])
            if not left:
                out.append(np.zeros((len(queries), len(self.valid)), np.uint64))
                carry = None
            elif len(left) == 1:
                out.append(left[0])
                carry = None
            elif len(left) == 2:
                out.append(left[0] ^ left[1])
                carry = left[0] & left[1]
            else:
                a, b, c = left
                out.append(a ^ b ^ c)
                carry = (a & b) | (c & (a ^ b))
            if carry is not None and not carry.any():
                carry = None
            w += 1
        return out, self_low, self_high

    def above(self, slices: list[np.ndarray], least: np.ndarray) -> np.ndarray:
        """Bitmap, by query, of the rows whose coarse score is at least ``least``."""
        over = np.zeros((len(least), len(self.valid)), np.uint64)
        even = np.repeat(self.valid[None], len(least), 0)
        for w in range(len(slices) - 1, -1, -1):
            bit = (least >> w & 1).astype(bool)[:, None]
            over |= np.where(bit, np.uint64(0), even & slices[w])
            even &= np.where(bit, slices[w], ~slices[w])
        return over | even

    def top(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(rows, exact scores) of each query: every row that can be among its k best, the k best among them."""
        if not len(queries):
            return []
        slices, below, above = self.scores(queries)
        n = len(queries)
        # descend: rows even with the k-th so far; the value of the k-th best is settled bit by bit
        even, got, kth = np.repeat(self.valid[None], n, 0), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for w in range(len(slices) - 1, -1, -1):
            ones = even & slices[w]
            count = np.bitwise_count(ones).sum(1, dtype=np.int64)
            enough = got + count >= k
            kth += np.where(enough, 1 << w, 0)
            even = np.where(enough[:, None], ones, even & ~slices[w])
            got += np.where(enough, 0, count)
        least = np.maximum(kth - np.ceil(below + above).astype(np.int64) - 1, 0)
        if self.rows <= k:
            least[:] = 0
        maps = self.above(slices, least)
        out = []
        for i in range(n):
            rows = np.flatnonzero(np.unpackbits(maps[i].view(np.uint8), bitorder="little")[: self.rows])
            out.append((rows, self.vectors[rows] @ queries[i]))
        return out


# ---------------------------------------------------------------- tables

def _matrix(lists: list[list[int]], width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _group(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows, queries = left.column("ints").to_pylist(), right.column("ints").to_pylist()
        names = ["query_id", "query_key", "vec_id", "score"]
        if not rows or not queries:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        width = max(map(len, rows + queries))
        row_id, query_id, query_key = (t.column(c).to_numpy() for t, c in ((left, "vec_id"), (right, "vec_id"), (right, "key")))
        vectors, wanted = _matrix(rows, width), _matrix(queries, width)
        index = SliceIndex(vectors)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for i in range(0, len(wanted), 256):
            # one more than k for the query's own row, which is among its best as a rule, and all rows of its id
            own = np.array([(row_id == q).sum() for q in query_id[i : i + 256].tolist()])
            for j, (found, score) in enumerate(index.top(wanted[i : i + 256], k + int(own.max(initial=0))), i):
                other = row_id[found] != query_id[j]
                found, score = found[other], score[other]
                best = np.lexsort((row_id[found], -score))[:k]
                out[0].append(np.full(len(best), query_id[j]))
                out[1].append(np.full(len(best), query_key[j]))
                out[2].append(row_id[found][best])
                out[3].append(score[best])
        return pa.table({c: pa.array(np.concatenate(x)) for c, x in zip(names, out)})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 8_192, block_queries: int = 1_024) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query; ties go to the smaller vec_id.

    Both tables have vec_id and ``ints`` (an array of integers; the shorter of two is padded with zeros).  A query's
    own row, and any other of the same vec_id, is no candidate; equal query rows count once, and different vectors
    under one id are queries of their own.  Scores must fit a long.  Blocks of queries meet blocks of rows in a grid,
    so no task holds more than one of each, and only k rows a query leave a block.
    """
    n, m = vectors.count(), queries.count()
    rows, cells = max(1, -(-n // block_rows)), max(1, -(-m // block_queries))
    deal = lambda df, parts: F.pmod(F.xxhash64("vec_id", "ints", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    left = vectors.withColumn("r", deal(vectors, rows)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    right = queries.dropDuplicates(["vec_id", "ints"]).withColumn("key", F.xxhash64("ints")).withColumn("c", F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int"))
    right = right.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    part = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInArrow(_group(k), "query_id long, query_key long, vec_id long, score long")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integers(table: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and ``ints`` = floor(scale * x) of rows whose id is not null and whose vector is whole and finite."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return table.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("ints"))


def search_embeddings(table: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k best rows for each row whose vec_id is divisible by ``every``, against all rows.

    Null identifiers and vectors that are null or hold a null or non-finite component take no part; repeated vectors
    are candidates each; an empty table gives no rows; other columns are not read.  As the queries are a share of the
    rows, the work is theirs times all rows: each row is sent once per block of queries.
    """
    rows = integers(table)
    return top_k(rows, rows.where(F.col("vec_id") % every == 0), k)
