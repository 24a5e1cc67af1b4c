"""A log on Spark tables with the calls, limits and errors of a staged append/read/release buffer.

Each append is one atomic epoch of one stream; a group of appends is one write, and each effective release one control
write.  Records lie in a folder per segment, so reclaiming a segment deletes files.  Writes of one ``Log`` are serial,
as a root has one owner.  What a storage engine promises beyond that (a sync per call, an unknown outcome after a
cancelled one, advisory locks) Spark's commit protocol does not, and neither does this.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import capacity as C
from tidemark.operators.ordered import bounded_prefix, coalesce_ranges
from tidemark.operators.release import pending

RECORDS = "segment_id long, stream_id long, seq long, ordinal long, epoch_id long, created_ms long, metadata binary, payload binary, metadata_len long, payload_len long"
CONTROL = "manifest_seq long, kind string, stream_id long, seq long, segment_id long"


class LogError(Exception):
    """Base of all errors; ``label`` is the stable name of the kind."""

    label = "error"
    poisons = False

    def __init__(self, message: str = "", **detail: object):
        super().__init__(message or self.label)
        self.detail = detail


def _kind(name: str, label: str, poisons: bool = False) -> type[LogError]:
    return type(name, (LogError,), {"label": label, "poisons": poisons})


InvalidConfig = _kind("InvalidConfig", "invalid_config")
EmptyAppend = _kind("EmptyAppend", "empty_append")
EpochTooLarge = _kind("EpochTooLarge", "epoch_too_large")
SequenceExhausted = _kind("SequenceExhausted", "sequence_exhausted")
ExceedsCapacity = _kind("ExceedsCapacity", "exceeds_capacity")
Full = _kind("Full", "full")
InvalidReadLimits = _kind("InvalidReadLimits", "invalid_read_limits")
ReadLimitTooSmall = _kind("ReadLimitTooSmall", "read_limit_too_small")
ReleaseTooLarge = _kind("ReleaseTooLarge", "release_too_large")
RecordIdScopeMismatch = _kind("RecordIdScopeMismatch", "record_id_scope_mismatch")
UnknownRecordId = _kind("UnknownRecordId", "unknown_record_id")
Closed = _kind("Closed", "closed")
Poisoned = _kind("Poisoned", "poisoned")
Cancelled = _kind("Cancelled", "cancelled")
StorageFailure = _kind("StorageFailure", "io", True)


@dataclass(frozen=True)
class Config:
    """Limits of a root; None for a capacity without bound.

    An append that does not fit is rejected, or waits if ``reject_when_full`` is off.  A group commit takes at most
    ``commit_units`` appends and ``commit_bytes`` encoded bytes.
    """

    capacity: int | None = None
    reject_when_full: bool = True
    segment_bytes: int = 256 << 20
    max_epoch_bytes: int = 8 << 20
    max_release_records: int = 65_536
    commit_units: int = 64
    commit_bytes: int = 8 << 20
    max_segment_age_ms: int | None = None

    def __post_init__(self) -> None:
        release = C.RELEASE_BASE + C.RANGE * self.max_release_records
        checks = {
            "max_epoch_bytes must hold a record": self.max_epoch_bytes >= C.EPOCH + C.DESCRIPTOR,
            "segment_bytes must hold an epoch": self.segment_bytes >= C.SEGMENT_HEADER + C.SEGMENT_FOOTER + self.max_epoch_bytes,
            "max_release_records must be positive": self.max_release_records > 0,
            "commit_units must be positive": self.commit_units > 0,
            "commit_bytes must hold an epoch and a release": self.commit_bytes >= max(self.max_epoch_bytes, release),
            "segment_bytes is not a whole number": isinstance(self.segment_bytes, int),
            "max_epoch_bytes is not a whole number": isinstance(self.max_epoch_bytes, int),
            "max_segment_age_ms is not whole milliseconds": self.max_segment_age_ms is None or isinstance(self.max_segment_age_ms, int),
            "capacity must be positive": self.capacity is None or self.capacity > 0,
            "max_segment_age_ms must be positive": self.max_segment_age_ms is None or self.max_segment_age_ms > 0,
        }
        wrong = [k for k, ok in checks.items() if not ok]
        if wrong:
            raise InvalidConfig(wrong[0])


@dataclass(frozen=True)
class RecordId:
    root: bytes
    stream_id: int
    sequence: int

    def to_bytes(self) -> bytes:
        return self.root + self.stream_id.to_bytes(8, "little") + self.sequence.to_bytes(8, "little")

    @staticmethod
    def from_bytes(data: bytes) -> RecordId:
        return RecordId(data[:16], int.from_bytes(data[16:24], "little"), int.from_bytes(data[24:32], "little"))

    def __str__(self) -> str:
        return self.to_bytes().hex()


@dataclass(frozen=True)
class Record:
    id: RecordId
    metadata: bytes
    payload: bytes


@dataclass
class Counters:
    started: int = 0
    succeeded: int = 0
    failed: int = 0
    cancelled: int = 0
    records: int = 0
    payload_bytes: int = 0
    changed: int = 0


@dataclass
class _Segment:
    records: int = 0
    streams: int = 0
    bytes: int = C.SEGMENT_HEADER
    created_ms: int = 0


@dataclass
class _State:
    """What the driver keeps: an entry per live segment and the streams of the active one, none per record."""

    streams: int = 0
    segments: dict[int, _Segment] = field(default_factory=dict)
    active: int | None = None
    active_streams: set[int] = field(default_factory=set)
    next_segment: int = 0
    epoch: int = 0
    manifest: int = 0
    log_bytes: int = C.LOG_HEADER


@dataclass
class Commits:
    """Group commits of a kind: their number, units and bytes, and the largest."""

    groups: int = 0
    units: int = 0
    bytes: int = 0
    max_units: int = 0
    max_bytes: int = 0

    def add(self, units: int, size: int) -> None:
        self.groups, self.units, self.bytes = self.groups + 1, self.units + units, self.bytes + size
        self.max_units, self.max_bytes = max(self.max_units, units), max(self.max_bytes, size)


class Log:
    """One exclusively owned root directory."""

    #: Highwaters that are remembered; those of other streams are looked up.
    REMEMBERED = 65_536

    def __init__(self, spark: SparkSession, path: str, config: Config, root: bytes, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.config, self.root, self.clock = spark, path.rstrip("/"), config, root, clock
        self.lifecycle, self.failure = "running", None
        self.operations = {k: Counters() for k in ("append", "read", "release", "reclaim")}
        self.commits = {"append": Commits(), "release": Commits()}
        self._lock, self._state = threading.RLock(), _State()
        self._changed = threading.Condition(self._lock)
        self._high: OrderedDict[int, int] = OrderedDict()
        self._version = 0

    # ---- opening

    @staticmethod
    def open(spark: SparkSession, path: str, config: Config | None = None, clock: Callable[[], float] = time.time) -> Log:
        """Opens or creates a root; state is recovered by aggregates over its tables, never by collecting records.

        A root that weighs more than its capacity is refused.
        """
        path, config = path.rstrip("/"), config or Config()
        if not _exists(spark, f"{path}/root"):
            for table in ("records", "control"):
                if _exists(spark, f"{path}/{table}"):
                    raise InvalidConfig(f"{path} holds {table} but no root")
            spark.createDataFrame([], CONTROL).write.parquet(f"{path}/control/{0:020d}")
            spark.createDataFrame([(bytearray(uuid.uuid4().bytes),)], "root binary").coalesce(1).write.parquet(f"{path}/root")
        log = Log(spark, path, config, bytes(spark.read.parquet(f"{path}/root").first().root), clock)
        whole = [v for v in _names(spark, f"{path}/control") if _exists(spark, f"{path}/control/{v}/_SUCCESS")]
        log._version = int(max(whole))  # a checkpoint that was not written to its end does not count
        log._recover()
        if config.capacity is not None and log.weight() > config.capacity:
            raise InvalidConfig(f"the root weighs {log.weight()} bytes, more than {config.capacity}")
        return log

    def _recover(self) -> None:
        s = self._state
        rows, control = self._records(), self._control()
        part = rows.groupBy("segment_id", "stream_id").agg(F.count("*").alias("n"), F.sum(C.record_bytes(F.col("metadata_len"), F.col("payload_len"))).alias("b"), F.count_distinct("epoch_id").alias("e"), F.max("epoch_id").alias("top"), F.min("created_ms").alias("c"))
        for r in part.groupBy("segment_id").agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum("b") + C.EPOCH * F.sum("e")).alias("b"), F.max("top").alias("top"), F.min("c").alias("c")).collect():
            s.segments[r.segment_id] = _Segment(r.n, r.k, C.SEGMENT_HEADER + r.b, r.c)
            s.epoch = max(s.epoch, r.top)
        seals = [r.segment_id for r in control.where("kind = 'sealed'").join(control.where("kind = 'removed'").select("segment_id"), "segment_id", "left_anti").select("segment_id").collect()]  # of live segments
        for segment in seals:
            if segment in s.segments:
                s.segments[segment].bytes += C.SEGMENT_FOOTER
        gone = control.agg(F.max("segment_id").alias("s"), F.max("manifest_seq").alias("m"), F.sum(F.when(F.col("kind") == "frame", F.col("seq"))).alias("b")).first()
        s.manifest, s.log_bytes = gone.m or 0, C.LOG_HEADER + (gone.b or 0)
        s.next_segment = max([x + 1 for x in (*s.segments, gone.s) if x is not None], default=0)
        open_ = [x for x in s.segments if x not in set(seals)]
        s.active = max(open_) if open_ else None
        if s.active is not None:
            s.active_streams = {r.stream_id for r in rows.where(F.col("segment_id") == s.active).select("stream_id").distinct().collect()}
        s.streams = self._highwaters().select("stream_id").distinct().count()

    def _records(self) -> DataFrame:
        """Records of live segments; a reclaimed segment has no folder any more, or is left out until it is gone."""
        if not _exists(self.spark, f"{self.path}/records"):
            return self.spark.createDataFrame([], RECORDS)
        removed = self._control().where("kind = 'removed'").select("segment_id")
        return self.spark.read.schema(RECORDS).parquet(f"{self.path}/records").join(removed, "segment_id", "left_anti")

    def _control(self) -> DataFrame:
        return self.spark.read.schema(CONTROL).parquet(self._control_path())

    def _control_path(self) -> str:
        return f"{self.path}/control/{self._version:020d}"

    def _highwaters(self) -> DataFrame:
        """(stream_id, seq): each stream's records and what the removal of others has kept."""
        return self._records().select("stream_id", "seq").unionByName(self._control().where("kind = 'highwater'").select("stream_id", "seq"))

    def highwater(self, stream_id: int) -> int:
        """The last sequence of a stream; -1 if there is none."""
        if stream_id not in self._high:
            top = self._highwaters().where(F.col("stream_id") == stream_id).agg(F.max("seq")).first()[0]
            self._high[stream_id] = -1 if top is None else top
        self._high.move_to_end(stream_id)
        while len(self._high) > self.REMEMBERED:
            self._high.popitem(last=False)
        return self._high[stream_id]

    def _pending(self, stream_id: int | None = None) -> DataFrame:
        """The filter stands below the join; an append's file holds one stream, so its statistics prune files."""
        rows, gone = self._records(), self._control().where("kind = 'release'")
        if stream_id is not None:
            rows, gone = rows.where(F.col("stream_id") == stream_id), gone.where(F.col("stream_id") == stream_id)
        return pending(rows, gone)

    def _guarded(self, write: Callable[[], None]) -> None:
        try:
            write()
        except Exception as e:
            if self.lifecycle == "running":
                self.lifecycle, self.failure = "poisoned", e
            raise StorageFailure(str(e)) from e

    def _write_control(self, rows: list[tuple], frames: list[int]) -> None:
        """Control rows as one write; ``frames`` are the sizes of the frames that the format would take for them."""
        s = self._state
        rows = rows + [(s.manifest + 1 + i, "frame", None, size, None) for i, size in enumerate(frames)]
        self._guarded(lambda: self.spark.createDataFrame(rows, CONTROL).coalesce(1).write.mode("append").parquet(self._control_path()))
        s.manifest, s.log_bytes = s.manifest + len(frames), s.log_bytes + sum(frames)

    def compact(self, always: bool = True) -> bool:
        """Folds the control rows into a checkpoint; without ``always`` only a log of ``COMPACT_AT`` bytes, or one whose
        weight passes the capacity.

        What stays: releases and seals of live segments, a highwater per stream, and the last numbers.  The new rows
        are a folder of their own, which counts once it is whole; the old one goes then.
        """
        with self._lock:
            self._check_open()
            s, total = self._state, self.config.capacity
            if not (always or s.log_bytes >= C.COMPACT_AT or (total is not None and self.weight() > total)):
                return False
            control, none = self._control(), F.lit(None).cast("long")
            live = self._records().select("stream_id", "seq")
            kept = control.where("kind = 'release'").join(live, ["stream_id", "seq"], "left_semi").dropDuplicates(["stream_id", "seq"]).select(*control.columns)
            kept = kept.unionByName(control.where("kind = 'sealed'").join(control.where("kind = 'removed'").select("segment_id"), "segment_id", "left_anti").select(*control.columns))
            high = self._highwaters().groupBy("stream_id").agg(F.max("seq").alias("seq"))
            kept = kept.unionByName(high.select(F.lit(s.manifest).cast("long").alias("manifest_seq"), F.lit("highwater").alias("kind"), "stream_id", "seq", none.alias("segment_id")))
            last = self.spark.createDataFrame([(s.manifest, "last", None, None, s.next_segment - 1 if s.next_segment else None)], CONTROL)
            old, self._version = self._control_path(), self._version + 1
            self._guarded(lambda: kept.unionByName(last).write.parquet(self._control_path()))
            s.log_bytes = C.LOG_HEADER
            _delete(self.spark, old)
            return True

    def _check_open(self) -> None:
        if self.lifecycle == "poisoned":
            raise Poisoned(str(self.failure))
        if self.lifecycle != "running":
            raise Closed()

    # ---- capacity

    def _root(self) -> dict[str, object]:
        s = self._state
        active = s.segments.get(s.active) if s.active is not None else None
        entries = sum(C.SEGMENT_ENTRY + -(-g.records // 64) * 8 for g in s.segments.values())
        free = 0
        if active is not None and not self._expired():
            free = self.config.segment_bytes - active.bytes - C.SEGMENT_FOOTER
        return {
            "actual": C.ROOT + C.CHECKPOINT_BASE + C.STREAM_ENTRY * s.streams + s.log_bytes + sum(g.bytes for g in s.segments.values()), "streams": s.streams, "entries": entries, "most": max([g.streams for g in s.segments.values()], default=0),
            "active": active is not None, "active_free": free, "active_records": active.records if active else 0, "active_streams": active.streams if active else 0,
        }

    def weight(self) -> int:
        """File bytes and maintenance headroom."""
        r = {k: F.lit(v) for k, v in self._root().items()}
        return self.spark.range(1).select((r["actual"] + C.maintenance_headroom(r["streams"], r["entries"], r["most"], r["active"], self.config.max_release_records)).cast("long")).first()[0]

    def _admit(self, group: dict[str, int]) -> None:
        """The admission of the format (``capacity.admission``), evaluated over one row."""
        if self.config.capacity is None:
            return
        lit = lambda d: {k: F.lit(v) if isinstance(v, bool) else F.lit(v).cast("long") for k, v in d.items()}
        verdict = C.admission(lit(self._root()), lit(group), F.lit(self.config.capacity).cast("long"), self.config.max_release_records)
        r = self.spark.range(1).select(*(c.alias(k) for k, c in verdict.items())).first()
        if r.decision == "exceeds":
            raise ExceedsCapacity(needed=r.needed, total=self.config.capacity)
        if r.decision == "wait":
            raise Full(needed=r.needed, available=r.available)

    def _expired(self) -> bool:
        s, age = self._state, self.config.max_segment_age_ms
        return age is not None and s.active is not None and max(0, int(self.clock() * 1000) - s.segments[s.active].created_ms) >= age

    def age_delay_ms(self) -> int | None:
        """Milliseconds until the active segment is too old; the bound itself without one, None without a bound."""
        s, age = self._state, self.config.max_segment_age_ms
        if age is None or s.active is None:
            return age
        return max(0, age - max(0, int(self.clock() * 1000) - s.segments[s.active].created_ms))

    def _seal(self) -> None:
        s = self._state
        self._write_control([(s.manifest + 1, "sealed", None, None, s.active)], [C.SEALED_FRAME])
        s.segments[s.active].bytes += C.SEGMENT_FOOTER
        s.active, s.active_streams = None, set()

    def maintain(self) -> dict[str, int]:
        """What an idle owner does: seals an active segment that is too old, reclaims, and compacts a long log."""
        with self._lock:
            self._check_open()
            if self._expired():
                self._seal()
            done = self.reclaim()
            self.compact(always=False)
            return done

    # ---- surface

    def stream(self, stream_id: int) -> Stream:
        return Stream(self, stream_id)

    def known_streams(self) -> list[int]:
        return sorted(r.stream_id for r in self._highwaters().select("stream_id").distinct().collect())

    def health(self) -> dict[str, object]:
        return {"lifecycle": self.lifecycle, "failure": self.failure}

    def stats(self) -> dict[str, int]:
        left = self._pending().agg(F.count("*").alias("n"), F.coalesce(F.sum("payload_len"), F.lit(0)).alias("b")).first()
        state = self.segments()
        seg = state.agg(F.count("*").alias("n"), F.count_if("sealed").alias("s"), F.count_if(F.expr("sealed and unreleased = 0")).alias("r")).first()
        return {"streams": self._state.streams, "pending_records": left.n, "pending_payload_bytes": left.b, "live_segments": seg.n, "sealed_segments": seg.s, "reclaimable_segments": seg.r, "actual_file_bytes": self._root()["actual"]}

    def segments(self) -> DataFrame:
        """(segment_id, records, unreleased, bytes, sealed) of the live segments; bytes are those of their records."""
        gone = self._control().where("kind = 'release'").select("stream_id", "seq", F.lit(1).alias("g")).distinct()
        state = self._records().join(gone, ["stream_id", "seq"], "left").groupBy("segment_id").agg(F.count("*").alias("records"), (F.count("*") - F.count("g")).alias("unreleased"), F.sum(C.record_bytes(F.col("metadata_len"), F.col("payload_len"))).alias("bytes"))
        sealed = F.lit(True) if self._state.active is None else F.col("segment_id") != self._state.active
        return state.withColumn("sealed", sealed)

    def released_ranges(self) -> DataFrame:
        return coalesce_ranges(self._control().where("kind = 'release'"))

    def append_group(self, units: list[tuple[int, list[tuple[bytes, bytes]]]]) -> list[list[RecordId]]:
        """Group commit: one epoch a unit (stream, records), as many in one write as the limits allow, in order."""
        done: list[list[RecordId]] = []
        while len(done) < len(units):
            group, size = [], 0
            for stream_id, records in units[len(done) :]:
                more = epoch_bytes(records)
                if group and (len(group) >= self.config.commit_units or size + more > self.config.commit_bytes):
                    break
                group.append((stream_id, records))
                size += more
            done += self._append(group)
        return done

    def _append(self, group: list[tuple[int, list[tuple[bytes, bytes]]]], timeout: float | None = None) -> list[list[RecordId]]:
        """One write of whole epochs.  Order of errors: empty, too large, exhausted, lifecycle, capacity."""
        config, count = self.config, self.operations["append"]
        with self._lock:
            count.started += len(group)
            try:
                for stream_id, records in group:
                    if not records:
                        raise EmptyAppend()
                    if epoch_bytes(records) > config.max_epoch_bytes:
                        raise EpochTooLarge(bytes=epoch_bytes(records), limit=config.max_epoch_bytes)
                    if self.highwater(stream_id) + len(records) >= 2**63:
                        raise SequenceExhausted()
                self._check_open()
                size, streams = sum(epoch_bytes(r) for _, r in group), {i for i, _ in group}
                self._wait_until_admitted(size, sum(len(r) for _, r in group), streams, timeout)
                return self._commit(group, size, streams)
            except Cancelled:
                count.cancelled += len(group)
                raise
            except LogError:
                count.failed += len(group)
                raise

    def _wait_until_admitted(self, size: int, records: int, streams: set[int], timeout: float | None) -> None:
        until = None if timeout is None else time.monotonic() + timeout
        while True:
            s = self._state
            try:
                return self._admit({"bytes": size, "records": records, "streams": len(streams), "new_streams": sum(self.highwater(i) < 0 for i in streams), "joining": len(streams - s.active_streams)})
            except Full:
                if self.config.reject_when_full:
                    raise
            left = None if until is None else until - time.monotonic()
            if left is not None and left <= 0:
                raise Cancelled("the append was given up while it waited for capacity")
            self._changed.wait(left)
            self._check_open()

    def _commit(self, group: list[tuple[int, list[tuple[bytes, bytes]]]], size: int, streams: set[int]) -> list[list[RecordId]]:
        s, count = self._state, self.operations["append"]
        if s.active is not None and (self._expired() or s.segments[s.active].bytes + size > self.config.segment_bytes - C.SEGMENT_FOOTER):
            self._seal()
        fresh = s.active is None
        segment = s.next_segment if fresh else s.active
        state = _Segment(created_ms=int(self.clock() * 1000)) if fresh else s.segments[segment]
        high = {i: self.highwater(i) for i in streams}
        rows, ids = [], []
        for n, (stream_id, records) in enumerate(group):
            own = []
            for metadata, payload in records:
                high[stream_id] += 1
                rows.append((segment, stream_id, high[stream_id], state.records + len(rows), s.epoch + 1 + n, state.created_ms, bytearray(metadata), bytearray(payload), len(metadata), len(payload)))
                own.append(RecordId(self.root, stream_id, high[stream_id]))
            ids.append(own)
        made = self.spark.createDataFrame(rows, RECORDS).repartition(min(len(streams), 8), "stream_id").sortWithinPartitions("stream_id", "seq")
        self._guarded(lambda: made.write.mode("append").partitionBy("segment_id").parquet(f"{self.path}/records"))
        if fresh:
            s.segments[segment], s.active, s.next_segment = state, segment, segment + 1
        s.streams += sum(self.highwater(i) < 0 for i in streams)
        s.active_streams |= streams
        state.records, state.bytes, state.streams = state.records + len(rows), state.bytes + size, len(s.active_streams)
        s.epoch += len(group)
        self._high.update(high)
        count.succeeded += len(group)
        count.records += len(rows)
        count.payload_bytes += sum(r[9] for r in rows)
        self.commits["append"].add(len(group), size)
        self._changed.notify_all()
        return ids

    def reclaim(self) -> dict[str, int]:
        """Removes sealed segments without pending records, four a group, and deletes their files.

        Of their highwaters only those are written that no live segment and no earlier removal holds.
        """
        with self._lock:
            self._check_open()
            s, freed = self._state, 0
            done = [r.segment_id for r in self.segments().where("sealed and unreleased = 0").select("segment_id").orderBy("segment_id").collect()]  # of the live ones
            for i in range(0, len(done), C.RECLAIM_JOB):
                job = done[i : i + C.RECLAIM_JOB]
                freed += self._remove(job)
            self.operations["reclaim"].succeeded += 1
            self._changed.notify_all()
            return {"segments": len(done), "bytes": freed}

    def _remove(self, job: list[int]) -> int:
        s = self._state
        kept = self._control().where("kind = 'highwater'").groupBy("stream_id").agg(F.max("seq").alias("kept"))
        tops = self._records().where(F.col("segment_id").isin(job)).groupBy("segment_id", "stream_id").agg(F.max("seq").alias("seq"))
        rises = tops.join(kept, "stream_id", "left").where("kept is null or seq > kept")
        rows = [(s.manifest + 1 + job.index(r.segment_id), "highwater", r.stream_id, r.seq, None) for r in rises.collect()]  # streams of four segments
        named = [sum(r[0] == s.manifest + 1 + k for r in rows) for k in range(len(job))]
        rows += [(s.manifest + 1 + k, "removed", None, None, segment) for k, segment in enumerate(job)]
        self._write_control(rows, [C.REMOVED_BASE + C.STREAM_ENTRY * n for n in named])
        freed = sum(s.segments.pop(segment).bytes for segment in job)
        for segment in job:  # the removal is durable, so files that a crash leaves are not read again
            _delete(self.spark, f"{self.path}/records/segment_id={segment}")
        return freed

    def shutdown(self) -> None:
        """Closes admission; those who wait are let go with ``Closed``."""
        with self._lock:
            if self.lifecycle == "running":
                self.lifecycle = "closed"
            self._changed.notify_all()


def epoch_bytes(records: list[tuple[bytes, bytes]]) -> int:
    return C.EPOCH + sum(C.DESCRIPTOR + len(m) + len(p) for m, p in records)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, store = _path(spark, path)
    return store.exists(p)


def _names(spark: SparkSession, path: str) -> list[str]:
    p, store = _path(spark, path)
    return [f.getPath().getName() for f in store.listStatus(p)]


def _delete(spark: SparkSession, path: str) -> None:
    p, store = _path(spark, path)
    store.delete(p, True)


class Stream:
    """A handle on one stream of a log; it need not exist yet."""

    def __init__(self, log: Log, stream_id: int):
        self.log, self.id = log, stream_id

    def stats(self) -> dict[str, object]:
        left = self.log._pending(self.id).agg(F.count("*").alias("n"), F.coalesce(F.sum("payload_len"), F.lit(0)).alias("b")).first()
        return {"durable_known": self.log.highwater(self.id) >= 0, "pending_records": left.n, "pending_payload_bytes": left.b}

    def append(self, metadata: bytes, payload: bytes, timeout: float | None = None) -> RecordId:
        return self.append_batch([(metadata, payload)], timeout)[0]

    def append_batch(self, records: list[tuple[bytes, bytes]], timeout: float | None = None) -> list[RecordId]:
        """One epoch: all of it or nothing.  ``timeout`` bounds the wait for capacity of a root that blocks."""
        return self.log._append([(self.id, records)], timeout)[0]

    def read(self, max_records: int, max_bytes: int) -> list[Record]:
        """The longest pending prefix within the limits; payload bytes count, metadata does not.  Nothing is []."""
        log = self.log
        count = log.operations["read"]
        count.started += 1
        try:
            if max_records < 1 or max_bytes < 0:
                raise InvalidReadLimits()
            log._check_open()
            mine = log._pending(self.id)
            rows = bounded_prefix(mine, max_records, max_bytes).orderBy("seq").collect()  # bounded by both limits
            if not rows:
                first = mine.orderBy("seq").select("seq", "payload_len").limit(1).collect()
                if first:
                    raise ReadLimitTooSmall(sequence=first[0].seq, required=first[0].payload_len, limit=max_bytes)
        except LogError:
            count.failed += 1
            raise
        count.succeeded += 1
        count.records += len(rows)
        return [Record(RecordId(log.root, self.id, r.seq), bytes(r.metadata), bytes(r.payload)) for r in rows]

    def read_wait(self, max_records: int, max_bytes: int, timeout: float) -> list[Record]:
        """Like ``read``, but waits until something is pending; a wait that is given up counts as cancelled."""
        log, until = self.log, time.monotonic() + timeout
        while True:
            with log._lock:
                got = self.read(max_records, max_bytes)
                if got:
                    return got
                left = until - time.monotonic()
                if left <= 0:
                    log.operations["read"].cancelled += 1
                    raise Cancelled("the read was given up while nothing was pending")
                log._changed.wait(left)

    def release(self, ids: list[RecordId]) -> int:
        """Releases exactly these records; those gone already are no-ops.  One bad id rejects the whole call.

        Order of errors: too large (before duplicates go), scope, unknown; an empty call succeeds on a closed log.
        """
        log = self.log
        with log._lock:
            count, s = log.operations["release"], log._state
            count.started += 1
            try:
                if len(ids) > log.config.max_release_records:
                    raise ReleaseTooLarge(records=len(ids), limit=log.config.max_release_records)
                for i in ids:
                    if i.root != log.root or i.stream_id != self.id:
                        raise RecordIdScopeMismatch(id=str(i))
                for i in ids:
                    if not 0 <= i.sequence <= log.highwater(self.id):
                        raise UnknownRecordId(id=str(i))
                if not ids:
                    count.succeeded += 1
                    return 0
                log._check_open()
                wanted = log.spark.createDataFrame([(self.id, n) for n in sorted({i.sequence for i in ids})], "stream_id long, seq long")
                new = sorted(r.seq for r in log._pending(self.id).join(wanted, ["stream_id", "seq"], "left_semi").select("seq").collect())  # at most the ids given
                if new:
                    ranges = 1 + sum(b != a + 1 for a, b in zip(new, new[1:]))
                    size = C.RELEASE_BASE + C.RANGE * ranges
                    log._write_control([(s.manifest + 1, "release", self.id, n, None) for n in new], [size])
                    log.commits["release"].add(1, size)
                    log._changed.notify_all()
            except LogError:
                count.failed += 1
                raise
            count.succeeded, count.records, count.changed = count.succeeded + 1, count.records + len(ids), count.changed + len(new)
            return len(new)
