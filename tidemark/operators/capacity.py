"""Capacity and maintenance arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed sizes of the storage format, in bytes.
ROOT, SEGMENT_HEADER, DESCRIPTOR, EPOCH_HEADER, EPOCH_COMMIT, SEGMENT_FOOTER = 40, 48, 40, 48, 40, 48
LOG_HEADER, FRAME_HEADER, CHECKPOINT_HEADER = 40, 48, 56
EPOCH, SEALED_FRAME, CHECKPOINT_BASE, STREAM_ENTRY, SEGMENT_ENTRY = EPOCH_HEADER + EPOCH_COMMIT, 80, CHECKPOINT_HEADER + 24, 16, 72
RELEASE_BASE, REMOVED_BASE, RANGE = FRAME_HEADER + 24, 64, 16
#: Defaults: ids in one release, segments removed by one job, the log size that is compacted.
MAX_RELEASE, RECLAIM_JOB, COMPACT_AT = 65_536, 4, 8 << 20


def record_bytes(metadata: Column, payload: Column) -> Column:
    return F.lit(DESCRIPTOR) + metadata + payload


def bitmap_bytes(records: Column) -> Column:
    return (F.floor((records + 63) / 64) * 8).cast("long")


def largest_manifest_group(segment_streams: Column, max_release: int = MAX_RELEASE) -> Column:
    return F.greatest(F.lit(RELEASE_BASE + RANGE * max_release).cast("long"), F.lit(SEALED_FRAME).cast("long"), RECLAIM_JOB * (REMOVED_BASE + STREAM_ENTRY * segment_streams))


def checkpoint_base(streams: Column) -> Column:
    return CHECKPOINT_BASE + STREAM_ENTRY * streams


def minimum_weight(streams: Column, records: Column, segment_streams: Column, group: Column, max_release: int = MAX_RELEASE) -> Column:
    """The least a root weighs that holds nothing but this group."""
    base = checkpoint_base(streams)
    actual = ROOT + base + LOG_HEADER + SEGMENT_HEADER + group
    return actual + base + SEGMENT_ENTRY + bitmap_bytes(records) + largest_manifest_group(segment_streams, max_release) + SEGMENT_FOOTER


def admission(s: dict[str, Column], group: dict[str, Column], total: Column, max_release: int = MAX_RELEASE) -> dict[str, Column]:
    """Whether a group of appends is admitted: {decision, needed, available}.

    ``s`` is the root: actual (file bytes), streams, entries (checkpoint bytes of its segments), most (streams of the
    segment with most), active (whether there is one), active_free (bytes its epochs may still take; an expired one
    has none), active_records, active_streams.  ``group``: bytes, records, streams, new_streams (unknown so far) and
    joining (not last written in the active segment).  Admitted if the projected bytes and maintenance headroom fit;
    otherwise it exceeds the root for good if an empty one could not hold it, and else waits.  A null total is no bound.
    """
    fits = s["active"] & (group["bytes"] <= s["active_free"])
    bits = bitmap_bytes
    streams = s["streams"] + group["new_streams"]
    actual = s["actual"] + group["bytes"] + F.when(fits, 0).otherwise(SEGMENT_HEADER) + F.when(s["active"] & ~fits, SEGMENT_FOOTER + SEALED_FRAME).otherwise(0)
    grown = F.when(fits, bits(s["active_records"] + group["records"]) - bits(s["active_records"])).otherwise(SEGMENT_ENTRY + bits(group["records"]))
    most = F.greatest(s["most"], F.when(fits, s["active_streams"] + group["joining"]).otherwise(group["streams"]))
    weight = actual + checkpoint_base(streams) + s["entries"] + grown + largest_manifest_group(most, max_release) + SEGMENT_FOOTER
    now = s["actual"] + maintenance_headroom(s["streams"], s["entries"], s["most"], s["active"], max_release)
    least = minimum_weight(streams, group["records"], group["streams"], group["bytes"], max_release)
    admit, exceeds = total.isNull() | (weight <= total), least > total
    return {
        "decision": F.when(admit, "admit").when(exceeds, "exceeds").otherwise("wait"),
        "needed": F.when(admit, None).when(exceeds, least).otherwise(F.greatest(weight - now, F.lit(0))).cast("long"),
        "available": F.when(admit | exceeds, None).otherwise(F.greatest(total - now, F.lit(0))).cast("long"),
    }


def maintenance_headroom(streams: Column, entries: Column, most: Column, active: Column, max_release: int = MAX_RELEASE) -> Column:
    """Bytes that must stay free for the largest checkpoint and manifest group, and the footer of an active segment."""
    return checkpoint_base(streams) + entries + largest_manifest_group(most, max_release) + F.when(active, SEGMENT_FOOTER).otherwise(0)


def age(now: Column, created: Column) -> Column:
    """A clock that went back makes it 0, not negative."""
    return F.greatest(now - created, F.lit(0))


def age_delay(now: Column, created: Column, max_age: Column) -> Column:
    """Milliseconds until a segment reaches its bound."""
    return F.greatest(max_age - age(now, created), F.lit(0))


def expired(now: Column, created: Column, max_age: Column) -> Column:
    """Whether a segment's age has reached its bound."""
    return age(now, created) >= max_age


def compacts(log_bytes: Column, weight: Column, total: Column) -> Column:
    """Whether the manifest log is folded into a checkpoint; a null total is no bound."""
    return (log_bytes >= COMPACT_AT) | F.coalesce(weight > total, F.lit(False))
