"""Golden cases and a sequential model of the log against the Spark operators."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark import api
from tidemark.functions import codec
from tidemark.operators import capacity, metrics, ordered, recovery, release

REC = "stream_id long, append_order long, payload_len long"


def test_prefix_goldens(spark):
    rows = spark.createDataFrame([(1, i, len(p)) for i, p in enumerate(["one", "three", "two"])], "stream_id long, seq long, payload_len long")
    read = lambda n, b: [r.seq for r in ordered.bounded_prefix(rows, n, b).orderBy("seq").collect()]
    assert read(8, 2) == [] and read(8, 7) == [0] and read(2, 8) == [0, 1]
    assert [tuple(r) for r in ordered.too_large_first(rows, 2).collect()] == [(1, 0, 3, 2)]
    zero = spark.createDataFrame([(1, 0, 5), (1, 1, 0), (1, 2, 0), (1, 3, 1)], rows.schema)
    assert ordered.bounded_prefix(zero, 9, 5).count() == 3


@pytest.mark.parametrize("lane", [1, 7, 1 << 16])
def test_sequential_model(spark, lane):
    rng, model, high = random.Random(lane), defaultdict(dict), {3: 41}
    records = [(rng.choice([0, 0, 0, 3, 9]), i, rng.randrange(0, 40)) for i in range(0, 600, 2)]
    for s, _, n in records:
        high[s] = high.get(s, -1) + 1
        model[s][high[s]] = n
    rel = sorted({(s, q) for s in model for q in model[s] if rng.random() < 0.6})
    seqs = ordered.assign_sequences(spark.createDataFrame(records, REC), spark.createDataFrame([(3, 41)], "stream_id long, highwater long"), lane=lane)
    assert {(r.stream_id, r.seq): r.payload_len for r in seqs.collect()} == {(s, q): n for s in model for q, n in model[s].items()}
    gone = spark.createDataFrame(rel, "stream_id long, seq long")
    left = release.pending(seqs, gone)
    runs = defaultdict(list)
    for s, q in rel:
        if runs[s] and sum(runs[s][-1]) == q:
            runs[s][-1][1] += 1
        else:
            runs[s].append([q, 1])
    ranges = ordered.coalesce_ranges(gone.union(gone), lane=lane)
    assert sorted((r.stream_id, r.range_start, r.len) for r in ranges.collect()) == sorted((s, a, n) for s in runs for a, n in runs[s])
    assert sorted(map(tuple, release.outside_ranges(seqs, ranges, 8).select("stream_id", "seq").collect())) == sorted(map(tuple, left.select("stream_id", "seq").collect()))
    assert {r.stream_id: r.runs for r in release.bitmap_runs(release.bitmap(gone)).collect()} == {s: len(r) for s, r in runs.items()}
    for n, b in ((1, 0), (5, 60), (100, 300)):
        want = []
        for s in model:
            total = 0
            for k, q in enumerate(q for q in sorted(model[s]) if (s, q) not in set(rel)):
                total += model[s][q]
                if k >= n or total > b:
                    break
                want.append((s, q))
        assert sorted((r.stream_id, r.seq) for r in ordered.bounded_prefix(left, n, b).collect()) == sorted(want)


def test_greedy_is_the_loop(spark):
    rng = random.Random(2)
    rows = [(r, i, rng.randrange(1, 130)) for i in range(400) for r in range(3)]
    got = ordered.greedy(spark.createDataFrame(rows, "root long, i long, n long"), ["root"], "i", "n", 4, 100, 5).collect()
    state, want = {}, {}
    for r, i, n in sorted(rows):
        b, used, c = state.get(r, (1, 4, 0))
        if c and (used + n > 100 or c >= 5):
            b, used, c = b + 1, 4, 0
        want[r, i] = (b, used)
        state[r] = (b, used + n, c + 1)
    assert {(x.root, x.i): (x.bin, x.offset) for x in got} == want


def test_formulas(spark):
    one = spark.range(1)
    val = lambda c: one.select(c.alias("v")).first().v
    enc = lambda n, r: val(release.encoding(F.lit(n), F.lit(r)))
    assert enc(8, 1) == "bitmap" and enc(128, 1) == "ranges" and enc(0, 0) == "ranges" and enc(129, 2) == "bitmap"
    assert val(capacity.largest_manifest_group(F.lit(1), 16)) == 72 + 16 * 16 and val(capacity.largest_manifest_group(F.lit(100), 1)) == 4 * (64 + 1600)
    assert capacity.LOG_HEADER + 2 * (capacity.RELEASE_BASE + capacity.RANGE) == 40 + 2 * (48 + 40)
    assert 40 + 7 * (capacity.RELEASE_BASE + 16 * 65_536) == 7_340_576 and capacity.RELEASE_BASE + 16 * 65_536 == 1_048_648
    assert val(metrics.escape_label(F.lit('a\\b"c\nd'))) == 'a\\\\b\\"c\\nd'
    assert val(metrics.duration_text(F.lit(0.001))) == "≤1.000 ms" and val(metrics.duration_text(F.lit(2.0))) == "≤2.000 s"
    h = spark.createDataFrame([("x", 0.001, 50), ("x", 0.01, 95), ("x", 0.1, 100), ("x", None, 100), ("none", None, 0)], "op string, le double, cumulative long")
    got = {(r.op, r.quantile): r.upper_bound for r in metrics.bucket_quantile(h, ["op"], [0.5, 0.99]).collect()}
    assert got["x", 0.5] == "≤1.000 ms" and got["x", 0.99] == "≤100.000 ms" and got["none", 0.5] == "n/a"
    two = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v long")
    assert metrics.nearest_rank(two, ["k"], "v", {"p": 0.5}).first().p == 2 and metrics.upper_median(two, ["k"], "v", "m").first().m == 2
    assert val(metrics.percent_change(F.lit(0.0), F.lit(5.0))) == 0 and val(metrics.ratio(F.lit(1.0), F.lit(-1.0))) == 0


def test_identifiers(spark):
    top = 2**63 - 1
    ids = spark.createDataFrame([(0, 1), (1, 256), (top, top), (-1, 0)], "s long, q long")
    root = F.lit(bytearray(range(16)))
    for r in ids.select("s", "q", codec.record_id(root, F.col("s"), F.col("q")).alias("id"), codec.from_le64(codec.le64(F.col("s")), 1).alias("u")).collect():
        assert bytes(r.id) == bytes(range(16)) + (r.s % 2**64).to_bytes(8, "little") + r.q.to_bytes(8, "little") and int(r.u) == r.s % 2**64
    names = spark.createDataFrame([("segment-00000000000000000012.log",), ("segment-1.log",), (f"segment-{2**64 - 1:020d}.log",), (f"segment-{2**64 - 2:020d}.log",)], "n string")
    assert [r[0] and int(r[0]) for r in names.select(codec.segment_number(F.col("n"))).collect()] == [12, None, None, 2**64 - 2]
    import xxhash

    assert int(spark.range(1).select(codec.checksum(F.lit(bytearray(b"abc")))).first()[0]) == xxhash.xxh3_64_intdigest(b"abc", codec.SEED)
    assert codec.SEED.to_bytes(8, "little").isascii()


def test_replay_and_gaps(spark):
    frames = spark.createDataFrame([(1,), (2,), (4,), (5,), (7,)], "manifest_seq long")
    got = {r.manifest_seq: (r.applied, r.gap) for r in recovery.replay(frames, 3).collect()}
    assert got == {1: (False, False), 2: (False, False), 4: (True, False), 5: (True, False), 7: (True, True)}
    rows = spark.createDataFrame([(1, 0), (1, 2), (2, 0), (2, 1)], "stream_id long, seq long")
    assert {r.stream_id: r.gaps for r in recovery.gaps(rows).collect()} == {1: 1, 2: 0}


def test_log_surface(spark, tmp_path):
    log = api.Log.open(spark, str(tmp_path / "root"), api.Config(segment_bytes=400, max_epoch_bytes=300, max_release_records=4, commit_bytes=8 << 20))
    a, b = log.stream(7), log.stream(9)
    ids = a.append_batch([(b"m", b"one"), (b"", b"three"), (b"", b"")])
    more = [b.append(b"", b"x" * 150), a.append(b"", b"tail")]
    assert log.known_streams() == [7, 9] and [i.sequence for i in ids] == [0, 1, 2] and api.RecordId.from_bytes(ids[1].to_bytes()) == ids[1]
    with pytest.raises(api.ReadLimitTooSmall) as e:
        a.read(8, 2)
    assert e.value.detail["required"] == 3
    assert [r.payload for r in a.read(8, 8)] == [b"one", b"three", b""] and a.read(1, 99)[0].metadata == b"m"
    for bad, call in ((api.InvalidReadLimits, lambda: a.read(0, 1)), (api.EmptyAppend, lambda: a.append_batch([])), (api.EpochTooLarge, lambda: a.append(b"", b"x" * 300)), (api.ReleaseTooLarge, lambda: a.release([ids[0]] * 5)), (api.RecordIdScopeMismatch, lambda: a.release([ids[0], more[0]])), (api.UnknownRecordId, lambda: a.release([ids[0], api.RecordId(log.root, 7, 99)]))):
        with pytest.raises(bad):
            call()
    assert a.release([ids[0], ids[0], ids[1]]) == 2 and a.release(ids[:2]) == 0 and a.release([]) == 0
    assert log.operations["release"].records == 5 and log.operations["release"].changed == 2
    assert [r.id.sequence for r in a.read(9, 99)] == [2, 3]
    assert a.release([ids[2]]) == 1 and log.stats()["pending_records"] == 2
    before = log.stats()
    report = log.reclaim()
    assert report["segments"] == before["reclaimable_segments"] > 0
    log.shutdown()
    assert a.release([]) == 0
    with pytest.raises(api.Closed):
        a.append(b"", b"late")
    again = api.Log.open(spark, str(tmp_path / "root"), log.config)
    assert again.root == log.root and [r.payload for r in again.stream(7).read(9, 99)] == [b"tail"] and again.stream(7).append(b"", b"n").sequence == 4
    assert again.stream(7).release([ids[0]]) == 0 and again.stream(5).stats() == {"durable_known": False, "pending_records": 0, "pending_payload_bytes": 0}


def test_config_and_capacity(spark, tmp_path):
    for wrong in ({"max_epoch_bytes": 127}, {"segment_bytes": 100}, {"max_release_records": 0}, {"commit_units": 0}, {"capacity": 0}, {"max_segment_age_ms": 0.5}, {"max_segment_age_ms": 0}, {"commit_bytes": 100}):
        with pytest.raises(api.InvalidConfig):
            api.Config(**wrong)
    with pytest.raises(api.ExceedsCapacity):  # the largest release frame alone takes over a megabyte
        api.Log.open(spark, str(tmp_path / "large"), api.Config(capacity=1_100_000)).stream(1).append(b"", b"x" * 100_000)
    # headroom of the golden case of 12 KiB: one release of 16 records
    small = api.Config(capacity=12 * 1024, max_release_records=16)
    with pytest.raises(api.InvalidConfig):
        api.Log.open(spark, str(tmp_path / "none"), api.Config(capacity=400, max_release_records=16))
    log = api.Log.open(spark, str(tmp_path / "small"), small)
    with pytest.raises(api.ExceedsCapacity):
        log.stream(1).append(b"", b"x" * 12_000)
    ids = []
    with pytest.raises(api.Full) as e:
        while True:
            ids += log.stream(1).append_batch([(b"", b"x" * 512)] * 4)
    root = log._root()
    assert len(ids) >= 12 and log.weight() <= 12 * 1024 < log.weight() + e.value.detail["needed"] and e.value.detail["available"] == 12 * 1024 - log.weight()
    again = api.Log.open(spark, str(tmp_path / "small"), small)
    assert again._root() == root and again.weight() == log.weight()


def test_blocked_append_goes_on_after_reclaim(spark, tmp_path):
    import threading

    config = api.Config(capacity=6_000, reject_when_full=False, max_release_records=16, segment_bytes=2_000, max_epoch_bytes=1_900)
    log = api.Log.open(spark, str(tmp_path / "root"), config)
    a, ids = log.stream(1), []
    with pytest.raises(api.Cancelled):
        while True:
            ids.append(a.append(b"", b"x" * 800, timeout=0))
    assert log.operations["append"].cancelled == 1 and len(log._state.segments) > 1
    got = []
    waiting = threading.Thread(target=lambda: got.append(a.append(b"", b"y" * 800, timeout=60)))
    waiting.start()
    assert a.release(ids) == len(ids)
    files = [p.name for p in (tmp_path / "root" / "records").iterdir() if p.is_dir()]
    report = log.reclaim()
    waiting.join()
    left = {p.name for p in (tmp_path / "root" / "records").iterdir() if p.is_dir()}
    assert report["segments"] > 0 and got[0].sequence == len(ids) and len(set(files) - left) == report["segments"]
    assert [r.payload for r in a.read(9, 10_000)] == [b"y" * 800]
    with pytest.raises(api.Cancelled):
        log.stream(2).read_wait(1, 1, 0.1)
    threading.Timer(0.5, lambda: log.stream(2).append(b"", b"now")).start()
    assert log.stream(2).read_wait(1, 9, 60)[0].payload == b"now" and log.operations["read"].cancelled == 1


def test_compaction_of_a_log(spark, tmp_path):
    config = api.Config(segment_bytes=400, max_epoch_bytes=300)
    log = api.Log.open(spark, str(tmp_path / "root"), config)
    a, b = log.stream(1), log.stream(2)
    ids = [a.append(b"", b"x" * 100) for _ in range(5)] + [b.append(b"", b"y")]
    a.release(ids[:3])
    a.release(ids[:1] + ids[4:5])
    assert log.reclaim()["segments"] > 0
    before, size = log.stats(), log._state.log_bytes
    assert not log.compact(always=False) and log.compact() and log._state.log_bytes == 40 < size
    after = log.stats()
    assert after["actual_file_bytes"] == before["actual_file_bytes"] - size + 40 and {k: v for k, v in after.items() if k != "actual_file_bytes"} == {k: v for k, v in before.items() if k != "actual_file_bytes"}
    (tmp_path / "root" / "control" / f"{9:020d}").mkdir()  # a checkpoint that never came to its end
    again = api.Log.open(spark, str(tmp_path / "root"), config)
    assert again._root() == log._root() and again.highwater(1) == 4 and again._state.next_segment == log._state.next_segment
    assert [r.id.sequence for r in again.stream(1).read(9, 999)] == [3] and again.stream(1).append(b"", b"").sequence == 5 and again.stream(1).release(ids[:3]) == 0


def test_group_commit_and_age(spark, tmp_path):
    now = [1000.0]
    log = api.Log.open(spark, str(tmp_path / "root"), api.Config(commit_units=3, max_segment_age_ms=5_000), clock=lambda: now[0])
    ids = log.append_group([(i % 2, [(b"", bytes([i]))] * (i + 1)) for i in range(7)])
    assert [[(r.stream_id, r.sequence) for r in u] for u in ids][:3] == [[(0, 0)], [(1, 0), (1, 1)], [(0, 1), (0, 2), (0, 3)]]
    commits = log.commits["append"]
    assert (commits.groups, commits.units, commits.max_units) == (3, 7, 3) and log.known_streams() == [0, 1] and log.age_delay_ms() == 5_000
    now[0] = 1004.0
    assert log.age_delay_ms() == 1_000 and log._state.active == 0
    now[0] = 1005.0
    assert log.maintain() == {"segments": 0, "bytes": 0} and log._state.active is None
    log.stream(0).append(b"", b"next")
    assert log._state.active == 1 and {r.segment_id: r.sealed for r in log.segments().collect()} == {0: True, 1: False}
    again = api.Log.open(spark, str(tmp_path / "root"), log.config, clock=lambda: now[0])
    assert again._root() == log._root() and again.highwater(0) == log.highwater(0)


def test_streaming_state_is_the_batch_state(spark, sf, tmp_path):
    from tidemark.plans.relations import Log
    from tidemark.streaming.lifecycle import log_state

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = Log(spark, sf)
    rec, rel = log.rec(), log.rel()
    command = lambda df, kind: df.select("stream_id", F.lit(kind).alias("kind"), F.col("append_order").alias("order"), "seq", F.lit(0).cast("long").alias("payload_len") if kind == "release" else "payload_len")
    appends, releases = command(rec, "append"), command(rel, "release")
    unknown = releases.limit(3).withColumn("seq", F.lit(10**9))
    schema, source = appends.schema, str(tmp_path / "in")

    def run():
        out = {}

        def keep(batch, _):
            out.update({r.stream_id: tuple(r) for r in batch.collect()})

        q = log_state(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return out

    appends.coalesce(1).write.mode("append").parquet(source)
    run()
    releases.union(releases).union(unknown).coalesce(1).write.mode("append").parquet(source)  # a restart on the same checkpoint
    out = run()
    left = {r.stream_id: (r.n, r.b) for r in release.pending(rec, rel).groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("payload_len").alias("b")).collect()}
    high = {r.stream_id: r.h for r in rec.groupBy("stream_id").agg(F.max("seq").alias("h")).collect()}
    done = {r.stream_id: r.n for r in rel.groupBy("stream_id").agg(F.count("*").alias("n")).collect()}
    assert {s: o[1:4] for s, o in out.items()} == {s: (high[s], *left.get(s, (0, 0))) for s in done}
    assert {s: o[4] for s, o in out.items()} == done and sum(o[5] for o in out.values()) == sum(done.values()) and sum(o[6] for o in out.values()) == 3
