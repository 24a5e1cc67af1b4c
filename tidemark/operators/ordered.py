"""Ordered-scan operators: running ranks and sums, prefixes, islands and greedy packing.

Running values of a key are worked out in lanes (runs of the order column), so that one very long stream is spread
over many tasks: totals per lane are small, their running sums are offsets, and only a lane is sorted in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANE = 1 << 16


def running(df: DataFrame, by: list[str], order: str, sums: dict[str, str] | None = None, rank: str = "rank", lane: int = LANE, ties: list[str] | None = None) -> DataFrame:
    """``df`` with ``rank`` (from 1, by ``order`` inside ``by``) and inclusive running sums {new column: column}.

    ``order`` is an integer column; ``ties`` order rows that are equal in it.  No rows are dropped; nulls in a summed column count as 0.
    """
    sums = sums or {}
    df = df.withColumn("__lane", F.floor(F.col(order) / lane))
    totals = df.groupBy(*by, "__lane").agg(F.count("*").alias("__n"), *(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"__{n}") for n, c in sums.items()))
    before = Window.partitionBy(*by).orderBy("__lane").rowsBetween(Window.unboundedPreceding, -1)
    names = ["__n", *(f"__{n}" for n in sums)]
    offsets = totals.select(*by, "__lane", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in names))
    inside = Window.partitionBy(*by, "__lane").orderBy(order, *(ties or []))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({rank: F.row_number().over(inside).cast("long")} | {n: F.sum(F.coalesce(F.col(c), F.lit(0))).over(so_far) for n, c in sums.items()})
    df = df.join(offsets, [*by, "__lane"])
    return df.withColumns({rank: F.col(rank) + F.col("__n_0")} | {n: F.col(n) + F.col(f"__{n}_0") for n in sums}).drop("__lane", *(f"{c}_0" for c in names))


def assign_sequences(records: DataFrame, highwaters: DataFrame | None = None, order: str = "append_order", lane: int = LANE) -> DataFrame:
    """``seq`` per stream: contiguous, in order, from the stream's highwater + 1 (or 0 for a new stream)."""
    out = running(records, ["stream_id"], order, rank="__rank", lane=lane)
    if highwaters is None:
        return out.withColumn("seq", F.col("__rank") - 1).drop("__rank")
    out = out.join(highwaters.select("stream_id", F.col("highwater").alias("__hw")), "stream_id", "left")
    return out.withColumn("seq", F.coalesce("__hw", F.lit(-1)) + F.col("__rank")).drop("__rank", "__hw")


def bounded_prefix(pending: DataFrame, max_records: int, max_bytes: int) -> DataFrame:
    """Per stream the longest prefix with at most ``max_records`` records and ``max_bytes`` payload bytes.

    The rank filter comes first, so each task keeps at most ``max_records`` rows a stream before the shuffle.
    """
    if max_records < 1:
        raise ValueError("max_records must be positive")
    order = Window.partitionBy("stream_id").orderBy("seq")
    first = pending.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_records)
    total = F.sum("payload_len").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("cum_bytes", total).where(F.col("cum_bytes") <= max_bytes)


def too_large_first(pending: DataFrame, max_bytes: int) -> DataFrame:
    """Streams whose first pending payload alone exceeds the read limit: a typed error, never a skip."""
    first = pending.groupBy("stream_id").agg(F.min_by(F.struct("seq", "payload_len"), "seq").alias("f"))
    return first.where(F.col("f.payload_len") > max_bytes).select("stream_id", F.col("f.seq").alias("seq"), F.col("f.payload_len").alias("required_bytes"), F.lit(max_bytes).cast("long").alias("max_bytes"))


def coalesce_ranges(released: DataFrame, lane: int = LANE) -> DataFrame:
    """Sorted distinct sequences to maximal ranges (stream_id, range_start, len).

    An island's key is sequence minus rank; ranks are counted in lanes, and an island may span lanes.
    """
    kinds = released.select("stream_id", "seq").distinct()
    ranked = running(kinds, ["stream_id"], "seq", rank="__rank", lane=lane)
    return ranked.groupBy("stream_id", (F.col("seq") - F.col("__rank")).alias("__island")).agg(F.min("seq").alias("range_start"), F.count("*").alias("len")).drop("__island")


def previous(df: DataFrame, by: list[str], key: str, value: Column, step: int = 1) -> DataFrame:
    """``df`` with ``prev``: ``value`` of the row whose ``key`` is less by ``step``; an equi-join, so no key is hot."""
    other = df.select(*by, (F.col(key) + step).alias(key), value.alias("prev"))
    return df.join(other, [*by, key], "left")


def folded(rows: DataFrame, root: list[str], order: str, schema: str, start: tuple, step) -> DataFrame:
    """``rows`` folded in order, one output row each: ``step(state, row) -> (state, values of the new columns)``.

    For what depends on all that came before: a root is folded in one place, a batch of rows at a time, with a state
    of fixed size.  ``schema`` names the new columns; ``row`` is a tuple of the columns after ``root``.
    """
    kinds = dict(rows.dtypes)
    keep = rows.columns
    made = [c.split()[0] for c in schema.split(", ")]
    rest = [c for c in keep if c not in root]
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, start
        for frame in frames:
            out = []
            for row in zip(zip(*(frame[c] for c in root)), zip(*(frame[c] for c in rest))):
                if row[0] != key:
                    key, state = row[0], start
                state, values = step(state, row[1])
                out.append(values)
            yield frame.assign(**dict(zip(made, zip(*out))))

    full = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + schema
    return rows.repartition(parts, *root).sortWithinPartitions(*root, order).mapInPandas(fold, full)


def greedy(rows: DataFrame, root: list[str], order: str, size: str, first: int, bound: int, count: int | None = None, name: str = "bin", at: str = "offset") -> DataFrame:
    """Greedy filling in order: a row opens a new bin when it would pass ``bound`` (or ``count`` rows).

    Filling is sequential by nature, so a root is folded in one place, a batch of rows at a time, with a state of
    three numbers.  A bin starts at ``first``; a row larger than a bin gets its own.  Bins count from 1.
    """
    keep = [*root, order, size]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + f", `{name}` long, `{at}` long"
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, number, used, n = None, 0, 0, 0
        for frame in frames:
            bins, offsets = [], []
            for row in zip(*(frame[c] for c in root), frame[size]):
                if row[:-1] != key:
                    key, number, used, n = row[:-1], 1, first, 0
                elif n and (used + row[-1] > bound or (count is not None and n >= count)):
                    number, used, n = number + 1, first, 0
                bins.append(number)
                offsets.append(used)
                used, n = used + row[-1], n + 1
            yield frame.assign(**{name: bins, at: offsets})

    return rows.select(*keep).repartition(parts, *root).sortWithinPartitions(*root, order).mapInPandas(fold, schema)
