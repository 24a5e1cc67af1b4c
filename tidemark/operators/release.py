"""Release algebra: pending sets, effective releases, validation, ranges and bitmaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID = ["stream_id", "seq"]


def pending(records: DataFrame, released: DataFrame) -> DataFrame:
    """Records that no release covers."""
    return records.join(released.select(*ID), ID, "left_anti")


def effective(requests: DataFrame, pending_records: DataFrame) -> DataFrame:
    """What a group of release units changes: requested and pending, each id claimed by its first unit."""
    return requests.join(pending_records.select(*ID), ID, "left_semi").groupBy(*ID).agg(F.min("unit_id").alias("unit_id"))


def classify(requests: DataFrame, highwaters: DataFrame, root: str) -> DataFrame:
    """``outcome`` of each requested id: scope_mismatch before unknown_record_id before ok.

    ``requests`` (request_id, root, handle_stream, stream_id, seq): the id and the stream it is released on.
    """
    out = requests.join(highwaters.select("stream_id", "highwater"), "stream_id", "left")
    scope = (F.col("root") != root) | (F.col("stream_id") != F.col("handle_stream"))
    unknown = F.col("highwater").isNull() | (F.col("seq") > F.col("highwater"))
    return out.withColumn("outcome", F.when(scope, "scope_mismatch").when(unknown, "unknown_record_id").otherwise("ok"))


def outside_ranges(records: DataFrame, ranges: DataFrame, bucket: int = 1024) -> DataFrame:
    """Records in no range (stream_id, range_start, len): an equi-join on buckets of sequences and a residual.

    A range goes to each bucket it touches, so no stream's records meet all of its ranges.
    """
    ends = ranges.select("stream_id", "range_start", (F.col("range_start") + F.col("len") - 1).alias("range_end"))
    touched = ends.withColumn("b", F.explode(F.sequence(F.floor(F.col("range_start") / bucket), F.floor(F.col("range_end") / bucket)))).withColumnRenamed("stream_id", "s")
    rows = records.withColumn("__b", F.floor(F.col("seq") / bucket))
    inside = (F.col("stream_id") == F.col("s")) & (F.col("__b") == F.col("b")) & F.col("seq").between(F.col("range_start"), F.col("range_end"))
    return rows.join(touched, inside, "left_anti").drop("__b")


def range_violations(ranges: DataFrame) -> DataFrame:
    """Per stream how many ranges, in order of start, begin before the previous end + 2.

    Ranks are counted in lanes and the range before is an equi-join on them, so one stream is not one task.
    """
    from tidemark.operators.ordered import previous, running

    ranked = running(ranges.select("stream_id", "range_start", "len"), ["stream_id"], "range_start", ties=["len"])
    rows = previous(ranked, ["stream_id"], "rank", F.col("range_start") + F.col("len") - 1)
    return rows.groupBy("stream_id").agg(F.count_if(F.col("range_start") < F.col("prev") + 2).alias("violations"))


def bitmap(positions: DataFrame, by: str = "stream_id", position: str = "seq") -> DataFrame:
    """64-bit words (by, word_index, word, released) of distinct positions; bit 63 makes a word negative."""
    bit = F.expr(f"shiftleft(1L, cast({position} % 64 as int))")
    words = positions.groupBy(by, F.floor(F.col(position) / 64).alias("word_index")).agg(F.bit_or(bit).alias("word"))
    return words.withColumn("released", F.bit_count("word").cast("long"))


def bitmap_runs(words: DataFrame, by: str = "stream_id") -> DataFrame:
    """Runs of set bits: those that begin in a word, less one where the previous word's last bit carries in."""
    from tidemark.operators.ordered import previous

    rows = previous(words, [by], "word_index", F.col("word"))
    carry = F.coalesce(F.col("prev") < 0, F.lit(False)) & (F.col("word").bitwiseAND(F.lit(1)) == 1)
    starts = F.expr("bit_count(word & ~shiftleft(word, 1))").cast("long") - carry.cast("long")
    return rows.groupBy(by).agg(F.sum(starts).alias("runs"))


def encoding(record_count, range_count):
    """Canonical encoding: ranges iff they take no more bytes than the bitmap."""
    return F.when(16 * range_count <= 8 * F.ceil(record_count / 64), "ranges").otherwise("bitmap")
