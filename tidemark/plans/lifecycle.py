"""Queries of a root's opening, of its ageing and compaction, and of counters over time."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import capacity as C
from tidemark.operators import metrics, ordered, recovery, release
from tidemark.plans.relations import Log, div, seconds_div, sql
from tidemark.plans.reports import COMMIT, kind_runs
from tidemark.plans.state import HEADROOM, STATE, actual_bytes, headroom, root_state
from tidemark.sources import format_v1, root_v1
from tidemark.storage import shared_dir

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str, *names: str, recursive: bool = False):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Log(spark, sf_dir))
        text = sql(oracle, *names) if names else oracle
        ORACLE_SQL[f.__name__] = text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text
        return f

    return register


def seg():
    return F.col("segment_id")


# ---------------------------------------------------------------- opening a root


@query("""SELECT id AS segment_id, id = 4 OR p IS NOT NULL AS in_order FROM (SELECT segment_id AS id FROM segment WHERE segment_id % 6 <> 0 AND segment_id % 10 <> 1 AND segment_id >= 4 UNION SELECT segment_id FROM segment WHERE segment_id % 5 = 0 AND segment_id >= 4
UNION SELECT segment_id FROM segment WHERE segment_id % 7 <> 0 AND segment_id % 6 = 0) LEFT JOIN (SELECT DISTINCT id + 1 AS id, 1 AS p FROM (SELECT segment_id AS id FROM segment WHERE segment_id % 6 <> 0 AND segment_id % 10 <> 1 AND segment_id >= 4
UNION SELECT segment_id FROM segment WHERE segment_id % 5 = 0 AND segment_id >= 4 UNION SELECT segment_id FROM segment WHERE segment_id % 7 <> 0 AND segment_id % 6 = 0)) USING (id)""", "rec", "rel", "segment")
def segment_continuity(log):
    """Identifiers allocated since a checkpoint at segment 4, from frames, removals and files; some are left out."""
    ids = log.events().select("segment_id").distinct()
    live = ids.where(seg() % 6 != 0).withColumn("checkpointed", (seg() < 4) | (seg() % 10 == 1))
    return recovery.continuity(live, ids.where(seg() % 5 == 0), ids.where(seg() % 7 != 0), 4)


@query("SELECT CAST(row_number() OVER (ORDER BY segment_id) AS BIGINT) AS position, segment_id, bytes AS segment_bytes, records AS epoch_count FROM segment WHERE sealed AND segment_id % 9 = 0", "rec", "rel", "segment")
def missing_seals(log):
    state = log.segment()
    disk = state.select("segment_id", F.col("bytes").alias("segment_bytes"), F.col("records").alias("epoch_count"), F.col("sealed").alias("footer"))
    return recovery.missing_seals(disk, state.select("segment_id", (F.col("sealed") & (seg() % 9 != 0)).alias("sealed"))).drop("footer")


GROUPED = "e AS (SELECT epoch_id // 16 AS segment_id, epoch_id, record_count FROM epoch), b AS (SELECT segment_id, CAST(sum(record_count) + CASE WHEN segment_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS records FROM e WHERE epoch_id % 16 < 8 GROUP BY segment_id)"


@query(f", {GROUPED} SELECT segment_id, records, EXISTS (SELECT 1 FROM (SELECT segment_id AS s, sum(record_count) OVER (PARTITION BY segment_id ORDER BY epoch_id) AS upto FROM e) WHERE s = b.segment_id AND upto = b.records) AS on_boundary FROM b", "epoch")
def checkpoint_boundary(log):
    """Baselines after 8 of each segment's 16 epochs; each fifth is off by one."""
    epochs = log.epoch().select(div("epoch_id", 16).alias("segment_id"), "epoch_id", "record_count")
    baselines = epochs.where("epoch_id % 16 < 8").groupBy("segment_id").agg(F.sum("record_count").alias("n"))
    baselines = baselines.select("segment_id", (F.col("n") + F.when(seg() % 5 == 0, 1).otherwise(0)).alias("records"))
    return recovery.on_boundary(baselines, epochs)


@query("""SELECT segment_id, CASE WHEN segment_id % 4 = 0 THEN 'segment_bytes' WHEN segment_id % 6 = 0 THEN 'epoch_count' WHEN segment_id % 7 = 0 THEN 'segment_digest' END AS differs FROM segment WHERE sealed""", "rec", "rel", "segment")
def footer_equality(log):
    """Sealed frames against footers in four columns, some of them changed."""
    digest = F.md5(F.concat_ws("-", "segment_id", "bytes").cast("binary"))
    frames = log.segment().where("sealed").select("segment_id", F.col("bytes").alias("segment_bytes"), F.col("records").alias("epoch_count"), digest.alias("segment_digest"))
    off = lambda c, n: (F.col(c) + F.when(seg() % n == 0, 1).otherwise(0)).alias(c)
    footers = frames.select("segment_id", off("segment_bytes", 4), off("epoch_count", 6), F.when(seg() % 7 != 0, F.col("segment_digest")).alias("segment_digest"))
    return recovery.footer_differences(frames, footers)


@query("""SELECT CAST((SELECT count(DISTINCT manifest_seq) FROM rel) AS BIGINT) AS frames, CAST(count(*) FILTER (segment_id % 5 <> 0) AS BIGINT) AS segments, CAST(sum(records) FILTER (segment_id % 5 <> 0) AS BIGINT) AS epochs, CAST(sum(records) FILTER (segment_id % 5 <> 0) AS BIGINT) AS records,
CAST(count(*) FILTER (segment_id % 5 <> 0 AND NOT sealed) AS BIGINT) AS repaired_segment_tails, CAST((SELECT max(manifest_seq) FROM rel) % 2 AS BIGINT) AS repaired_log_tails, CAST(count(*) FILTER (segment_id % 5 <> 0 AND sealed AND segment_id % 9 = 0) AS BIGINT) AS completed_seals,
CAST(count(*) FILTER (segment_id % 5 = 0 AND segment_id % 2 = 0) AS BIGINT) AS completed_deletions, CAST(count(*) FILTER (segment_id % 11 = 0) AS BIGINT) AS removed_temporaries FROM segment""", "rec", "rel", "segment")
def recovery_scan(log):
    """What a recovery has scanned, repaired and completed, from a listing of files and the replayed frames."""
    state = log.segment()
    there = seg() % 5 != 0  # the others are removed, some of them still on disk; each eleventh left a temporary file
    counts = state.agg(
        F.count_if(there).alias("segments"), F.sum(F.when(there, F.col("records"))).alias("epochs"), F.sum(F.when(there, F.col("records"))).alias("records"), F.count_if(there & ~F.col("sealed")).alias("repaired_segment_tails"),
        F.count_if(there & F.col("sealed") & (seg() % 9 == 0)).alias("completed_seals"), F.count_if(~there & (seg() % 2 == 0)).alias("completed_deletions"), F.count_if(seg() % 11 == 0).alias("removed_temporaries"),
    )
    frames = log.released(log.events()).agg(F.count_distinct("manifest_seq").alias("frames"), (F.max("manifest_seq") % 2).alias("repaired_log_tails"))
    return counts.crossJoin(frames)  # one row each


@query("SELECT p.stream_id, p.seq, p.segment_id, p.ordinal, CAST(48 + e - p.payload_len AS BIGINT) AS payload_offset FROM pending p JOIN (SELECT segment_id, ordinal, sum(128 + metadata_len + payload_len) OVER (PARTITION BY segment_id ORDER BY ordinal) - 40 AS e FROM rec) USING (segment_id, ordinal)", "rec", "rel", "pending")
def pointer_lookup(log):
    """Pending pointers looked up in the index of their segment: where the payload begins."""
    size = F.lit(C.EPOCH + C.DESCRIPTOR) + F.col("metadata_len") + F.col("payload_len")
    index = ordered.running(log.events().select("segment_id", "ordinal", size.alias("size"), "payload_len"), ["segment_id"], "ordinal", {"end": "size"})
    # each record is an epoch of its own, which ends with its commit
    start = F.lit(C.SEGMENT_HEADER - C.EPOCH_COMMIT) + F.col("end") - F.col("payload_len")
    return recovery.dereference(log.pending(), index.select("segment_id", "ordinal", start.cast("long").alias("payload_offset")))


@query("SELECT epoch_id, e.stream_id + 12 AS stream_id FROM epoch e WHERE e.stream_id + 12 NOT IN (SELECT stream_id FROM rec)", "rec", "epoch")
def new_streams(log):
    """Streams of a group that the root does not know yet."""
    asked = log.epoch().select("epoch_id", (F.col("stream_id") + 12).alias("stream_id"))
    return asked.join(log.events().select("stream_id").distinct(), "stream_id", "left_anti").select("epoch_id", "stream_id")


# ---------------------------------------------------------------- age and compaction

AGE = 5 * 86_400_000


@query(f"""SELECT segment_id, CAST(age AS BIGINT) AS age_ms, age >= {AGE} AS expired, CAST(greatest({AGE} - age, 0) AS BIGINT) AS delay_ms FROM (SELECT segment_id, greatest(now - created, 0) AS age FROM (SELECT segment_id, epoch_us(min(ts)) // 1000 + CASE WHEN segment_id % 4 = 0 THEN 10000000000 ELSE 0 END AS created FROM rec GROUP BY segment_id),
(SELECT max(epoch_us(ts) // 1000) AS now FROM rec))""", "rec")
def segment_age(log):
    """Age of each segment from its first record; the clock of each fourth went back."""
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = log.events()
    created = rows.groupBy("segment_id").agg(F.min(millis).alias("c")).withColumn("c", F.col("c") + F.when(seg() % 4 == 0, 10_000_000_000).otherwise(0))
    now, c, most = F.col("now"), F.col("c"), F.lit(AGE)
    both = created.crossJoin(rows.agg(F.max(millis).alias("now")))  # one row
    return both.select("segment_id", C.age(now, c).alias("age_ms"), C.expired(now, c, most).alias("expired"), C.age_delay(now, c, most).alias("delay_ms"))


@query(f""", {STATE}, g AS (SELECT manifest_seq, 40 + sum(n) OVER (ORDER BY manifest_seq) AS log_bytes FROM (SELECT manifest_seq, 30000 * count(*) AS n FROM rel GROUP BY manifest_seq)), c AS (SELECT unnest([3000000::BIGINT, 4000000000::BIGINT, NULL]) AS total)
SELECT manifest_seq, total AS capacity_bytes, CAST(log_bytes AS BIGINT) AS log_bytes, log_bytes >= 8388608 OR coalesce(168 + 16 * streams + bytes - 40 + log_bytes + {HEADROOM} > total, false) AS compacts FROM g, c, state""", "rec", "rel", "segment")
def compaction_policy(log):
    """After each group of releases of 30,000 bytes: at 8 MiB, or where bytes and headroom pass the capacity."""
    per = log.released(log.events()).groupBy("manifest_seq").agg((F.count("*") * 30_000).alias("n")).withColumn("root", F.lit(0))
    total = ordered.running(per, ["root"], "manifest_seq", {"sum": "n"}).select("manifest_seq", (F.col("sum") + C.LOG_HEADER).alias("log_bytes"))
    rows = total.crossJoin(F.broadcast(root_state(log))).withColumn("c", F.explode(F.array(*(F.lit(x).cast("long") for x in (3_000_000, 4_000_000_000, None)))))  # one row
    weight = actual_bytes() - C.LOG_HEADER + F.col("log_bytes") + headroom()
    return rows.select("manifest_seq", F.col("c").alias("capacity_bytes"), "log_bytes", C.compacts(F.col("log_bytes"), weight, F.col("c")).alias("compacts"))


# ---------------------------------------------------------------- commits, counters and samples


@query(COMMIT.rsplit("SELECT run AS run_id", 1)[0] + """, u AS (SELECT run, grp, kind, count(*) AS units, sum(bytes) AS bytes FROM s GROUP BY run, grp, kind)
SELECT kind, CAST(count(*) AS BIGINT) AS groups, CAST(sum(units) AS BIGINT) AS units, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(max(units) AS BIGINT) AS max_units, CAST(max(bytes) AS BIGINT) AS max_bytes FROM u GROUP BY kind""", "ops", recursive=True)
def commit_stats(log):
    """Sums and maxima over the groups of group commit."""
    groups = ordered.greedy(kind_runs(log), ["run_id", "kind"], "op_id", "bytes", 0, 64, 3, name="group_id").groupBy("run_id", "group_id", "kind").agg(F.count("*").alias("u"), F.sum("bytes").alias("b"))
    return groups.groupBy("kind").agg(F.count("*").alias("groups"), F.sum("u").alias("units"), F.sum("b").alias("bytes"), F.max("u").alias("max_units"), F.max("b").alias("max_bytes"))


@query("""SELECT operation, CAST(count(*) AS BIGINT) AS started, CAST(count(*) FILTER (outcome = 'succeeded') AS BIGINT) AS succeeded, CAST(count(*) FILTER (outcome = 'failed') AS BIGINT) AS failed, CAST(count(*) FILTER (outcome = 'cancelled') AS BIGINT) AS cancelled, CAST(count(*) FILTER (outcome IS NULL) AS BIGINT) AS running
FROM (SELECT operation, CASE WHEN op_id % 41 = 0 THEN NULL WHEN op_id % 37 = 0 THEN 'cancelled' WHEN failed THEN 'failed' ELSE 'succeeded' END AS outcome FROM ops) GROUP BY operation""", "ops")
def cancellation_counters(log):
    """A call that was dropped counts as cancelled, one without an outcome is still running."""
    op = F.col("op_id")
    outcome = F.when(op % 41 == 0, None).when(op % 37 == 0, "cancelled").when(F.col("failed"), "failed").otherwise("succeeded")
    rows = log.ops().select("operation", outcome.alias("outcome"))
    named = [F.count_if(F.col("outcome") == o).alias(o) for o in ("succeeded", "failed", "cancelled")]
    return rows.groupBy("operation").agg(F.count("*").alias("started"), *named, F.count_if(F.col("outcome").isNull()).alias("running"))


DAY = "CAST(epoch(ts) AS BIGINT) // 86400"


@query(f"""SELECT operation, day, CAST(greatest(n - coalesce(bn, 0), 0) AS BIGINT) AS observations, CAST(greatest(t - coalesce(bt, 0), 0) AS BIGINT) AS total_ns, CASE WHEN m > coalesce(bm, 0) THEN m END AS new_max_ns
FROM (SELECT *, lag(n) OVER w AS bn, lag(t) OVER w AS bt, lag(m) OVER w AS bm FROM (SELECT operation, {DAY} AS day, CASE WHEN {DAY} % 7 = 0 THEN 5 ELSE count(*) END AS n, sum(elapsed_ns) AS t, max(elapsed_ns) AS m FROM ops GROUP BY operation, {DAY}) WINDOW w AS (PARTITION BY operation ORDER BY day))""", "ops")
def duration_deltas(log):
    """Differences of counters read once a day; where one began anew it grew by nothing, and a maximum counts if new."""
    day = seconds_div("ts", 86_400).alias("day")
    read = log.ops().groupBy("operation", day).agg(F.count("*").alias("n"), F.sum("elapsed_ns").alias("t"), F.max("elapsed_ns").alias("m"))
    read = read.withColumn("n", F.when(F.col("day") % 7 == 0, 5).otherwise(F.col("n")))
    before = lambda c: F.coalesce(F.lag(c).over(Window.partitionBy("operation").orderBy("day")), F.lit(0))  # noqa: E731  a row a day
    rows = read.withColumns({f"b{c}": before(c) for c in "ntm"})
    delta = lambda c: metrics.counter_delta(F.col(f"b{c}"), F.col(c)).cast("long")
    return rows.select("operation", "day", delta("n").alias("observations"), delta("t").alias("total_ns"), F.when(F.col("m") > F.col("bm"), F.col("m")).alias("new_max_ns"))


@query("""SELECT CAST(max(p) AS BIGINT) AS max_pending_records, CAST(max(b) AS BIGINT) AS max_file_bytes, CAST(count(*) AS BIGINT) AS samples FROM (SELECT sum(a - r) OVER (ORDER BY manifest_seq) AS p, sum(w) OVER (ORDER BY manifest_seq) AS b FROM (SELECT append_order // 256 + 1 AS manifest_seq, count(*) AS a, count(g) AS r,
sum(128 + metadata_len + payload_len) AS w FROM rec LEFT JOIN (SELECT append_order, 1 AS g FROM rel) USING (append_order) GROUP BY 1))""", "rec", "rel")
def observed_watermarks(log):
    """High-water marks of gauges sampled after each group of 256 appends and its releases."""
    rows = log.events()
    gone = log.released(rows).groupBy("manifest_seq").agg(F.count("*").alias("r"))
    put = rows.groupBy((div("append_order", 256) + 1).alias("manifest_seq")).agg(F.count("*").alias("a"), F.sum(F.lit(C.EPOCH + C.DESCRIPTOR) + F.col("metadata_len") + F.col("payload_len")).alias("w"))
    both = put.join(gone, "manifest_seq", "left").select(F.lit(0).alias("root"), "manifest_seq", "w", (F.col("a") - F.coalesce("r", F.lit(0))).alias("d"))
    gauges = ordered.running(both, ["root"], "manifest_seq", {"p": "d", "b": "w"})
    return gauges.agg(F.max("p").alias("max_pending_records"), F.max("b").alias("max_file_bytes"), F.count("*").alias("samples"))


@query("SELECT operation AS kind, CAST(count(*) AS BIGINT) AS observations, round(sum(elapsed_ns)::DOUBLE / count(*) / 1e6::DOUBLE, 6) AS average_ms, round(max(elapsed_ns)::DOUBLE / 1e6::DOUBLE, 6) AS max_ms FROM ops GROUP BY operation", "ops")
def kind_durations(log):
    """From cumulative counters sampled each hour: the last value of each is its largest; their guarded ratio."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3_600).cast("long")
    own = log.ops().groupBy(F.col("operation").alias("kind"), hour.alias("hour")).agg(F.count("*").alias("n"), F.sum("elapsed_ns").alias("t"), F.max("elapsed_ns").alias("m"))
    series = ordered.running(own, ["kind"], "hour", {"observations_total": "n", "ns_total": "t"})
    last = series.groupBy("kind").agg(F.max("observations_total").alias("observations"), F.max("ns_total").alias("t"), F.max("m").alias("m"))
    average = metrics.ratio(F.col("t").cast("double"), F.col("observations")) / 1e6
    return last.select("kind", "observations", F.round(average, 6).alias("average_ms"), F.round(F.col("m") / 1e6, 6).alias("max_ms"))


QUANTILE = "min(elapsed_ns) FILTER (r >= ceil((n - 1) * {}::DOUBLE) + 1)"


@query(f"""SELECT operation, day, CAST(max(n) AS BIGINT) AS calls, CAST(count(*) FILTER (failed) AS BIGINT) AS failures, {QUANTILE.format(0.5)} AS p50_ns, {QUANTILE.format(0.95)} AS p95_ns, {QUANTILE.format(0.99)} AS p99_ns, max(elapsed_ns) AS max_ns
FROM (SELECT operation, {DAY} AS day, elapsed_ns, failed, row_number() OVER (PARTITION BY operation, {DAY} ORDER BY elapsed_ns) AS r, count(*) OVER (PARTITION BY operation, {DAY}) AS n FROM ops) GROUP BY operation, day""", "ops")
def interval_quantiles(log):
    """Calls, failures and latency quantiles of each interval and operation."""
    day = seconds_div("ts", 86_400)
    ops = log.ops().withColumn("day", day)
    by = ["operation", "day"]
    ranks = metrics.nearest_rank(ops, by, "elapsed_ns", {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99})
    return ops.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if("failed").alias("failures"), F.max("elapsed_ns").alias("max_ns")).join(ranks, by)


@query("""SELECT phase AS scenario, CAST(count(*) AS BIGINT) AS samples, CAST(sum(elapsed_ns) AS BIGINT) AS total_elapsed_ns, round(sum(records)::DOUBLE / (sum(elapsed_ns)::DOUBLE / 1e9::DOUBLE), 6) AS records_per_second, CAST(max(records) AS BIGINT) AS max_pending_records, CAST(max(bytes) AS BIGINT) AS max_file_bytes,
list_sort(list(bytes))[count(*) // 2 + 1] AS median_file_bytes, round(CASE WHEN count(DISTINCT op_id // 64) FILTER (operation = 'append') > 0 THEN coalesce(sum(records) FILTER (operation = 'append'), 0)::DOUBLE / count(DISTINCT op_id // 64) FILTER (operation = 'append') ELSE 0 END, 6) AS records_per_append_group FROM ops GROUP BY phase""", "ops")
def scenario_aggregate(log):
    """Totals, high-water marks, upper medians and records per commit group of each scenario."""
    ops = log.ops().withColumn("grp", F.when(F.col("operation") == "append", div("op_id", 64)))
    appended = F.coalesce(F.sum(F.when(F.col("operation") == "append", F.col("records"))), F.lit(0)).alias("appended")
    part = ops.groupBy("phase").agg(F.count("*").alias("samples"), F.sum("elapsed_ns").alias("total_elapsed_ns"), F.sum("records").alias("r"), F.max("records").alias("max_pending_records"), F.max("bytes").alias("max_file_bytes"), appended)
    groups = ops.where("grp is not null").select("phase", "grp").distinct().groupBy("phase").agg(F.count("*").alias("g"))
    rows = part.join(groups, "phase", "left").join(metrics.upper_median(ops, ["phase"], "bytes", "median_file_bytes"), "phase")
    rate = metrics.ratio(F.col("r").cast("double"), F.col("total_elapsed_ns") / 1e9)
    per = F.coalesce(metrics.ratio(F.col("appended").cast("double"), F.col("g")), F.lit(0.0))
    return rows.select(F.col("phase").alias("scenario"), "samples", "total_elapsed_ns", F.round(rate, 6).alias("records_per_second"), "max_pending_records", "max_file_bytes", "median_file_bytes", F.round(per, 6).alias("records_per_append_group"))


@query("""SELECT CAST(w * 300 AS BIGINT) AS window_start, CAST(n AS BIGINT) AS calls, CAST(f AS BIGINT) AS failures, greatest(t, coalesce(max(t + i) OVER (ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS sampled_ms
FROM (SELECT w, n, f, t, 0 AS i FROM (SELECT epoch_us(ts) // 300000000 AS w, count(*) AS n, count(*) FILTER (failed) AS f, max(epoch_us(ts) // 1000) AS t FROM ops GROUP BY 1))""", "ops")
def sample_windows(log):
    """Tumbling windows of five minutes: what each interval counted, and sample times that never go back."""
    seconds = F.col("ts").cast("timestamp")
    own = log.ops().groupBy(F.window(seconds, "5 minutes").alias("w")).agg(F.count("*").alias("calls"), F.count_if("failed").alias("failures"), F.max(F.unix_millis(seconds)).alias("sampled_ms"))
    # windows do not overlap, so the last time in one is above all before it
    return own.select(F.unix_seconds("w.start").alias("window_start"), "calls", "failures", "sampled_ms")


@query("""SELECT operation AS workload, 3 AS schema_version, CAST(count(*) AS BIGINT) AS samples, CAST(sum(records) AS BIGINT) AS records, round(sum(records)::DOUBLE / (sum(elapsed_ns)::DOUBLE / 1e9::DOUBLE), 3) AS records_per_second FROM ops WHERE operation <> 'reclaim' GROUP BY operation""", "ops")
def benchmark_report(log):
    """Reports written as JSON lines and read back; one of another schema version is not read."""
    made = log.ops().groupBy("operation").agg(F.count("*").alias("samples"), F.sum("records").alias("records"), F.round(metrics.ratio(F.sum("records").cast("double"), F.sum("elapsed_ns") / 1e9), 3).alias("records_per_second"))
    version = F.when(F.col("operation") == "reclaim", 2).otherwise(3)
    lines = made.select(F.to_json(F.struct(version.alias("schema_version"), F.col("operation").alias("workload"), "samples", "records", "records_per_second")).alias("line"))
    report = F.from_json("line", "schema_version int, workload string, samples bigint, records bigint, records_per_second double")
    return lines.select(report.alias("r")).where("r.schema_version = 3").select("r.workload", "r.schema_version", "r.samples", "r.records", "r.records_per_second")


# ---------------------------------------------------------------- a root of bytes


ROOT_ID = bytes(range(16))


def byte_root(log: Log):
    """The events as a root on disk: written by the segment codec, then opened again with verified bodies.

    A checkpoint covers the first half of the segments, the manifest log the rest.  Control state is one checkpoint and
    one log by the format, a bit a record and a pair a range, so the driver writes those; the tasks write segments.
    """
    path = f"{shared_dir(log.spark)}/root-{uuid.uuid4().hex}"
    number = (seg() - 1).alias("segment_id")
    rows = log.rec().join(log.table("events").select(F.col("event_id").cast("long").alias("append_order"), "props"), "append_order")
    rows = rows.select(number, "ordinal", "stream_id", "seq", F.col("event_type").cast("binary").alias("metadata"), F.col("props").cast("binary").alias("payload"))
    last = log.events().agg((F.max("segment_id") - 1).alias("m")).first().m or 0
    half = last // 2
    sealed = log.events().select(number).distinct().where(seg() < last)
    footers = sorted(root_v1.write_segments(rows, path, ROOT_ID, sealed).where("sealed").collect(), key=lambda r: r.segment_id)
    rel = log.rel().select(number, "ordinal", "stream_id", "seq")
    flags = {r.segment_id: [False] * r.epoch_count for r in footers if r.segment_id <= half}
    for w in release.bitmap(rel.where(seg() <= half).select("segment_id", "ordinal").distinct(), "segment_id", "ordinal").collect():
        for bit in range(64 if w.segment_id in flags else 0):
            if w.word >> bit & 1:
                flags[w.segment_id][64 * w.word_index + bit] = True
    entries = [{"segment_id": r.segment_id, "sealed": True, "length": r.segment_bytes, "epochs": r.epoch_count, "digest": int(r.segment_digest), "flags": flags[r.segment_id]} for r in footers if r.segment_id in flags]
    high = {r.stream_id: r.h for r in rows.where(seg() < len(entries)).groupBy("stream_id").agg(F.max("seq").alias("h")).collect()}
    later = root_v1.release_bodies(ordered.coalesce_ranges(rel.where(seg() >= len(entries)))).collect()
    frames = [format_v1.sealed_frame(r.segment_id, r.segment_bytes, r.epoch_count, int(r.segment_digest)) for r in footers[len(entries) :]]
    frames += [(format_v1.RELEASE, bytes(r.body)) for r in sorted(later, key=lambda r: r.stream_id)]
    root_v1.write_control(path, ROOT_ID, 0, len(entries), high, entries, frames)
    return root_v1.recover(log.spark, path, bodies=True)


@query("SELECT p.stream_id, p.seq, p.segment_id - 1 AS segment_id, p.ordinal, props AS payload FROM pending p JOIN events e ON e.event_id = p.append_order", "rec", "rel", "pending")
def root_pending(log):
    """What is pending in a root of bytes, with its verified payloads."""
    long = lambda c, name=None: F.col(c).cast("long").alias(name or c)
    return byte_root(log).pending().select(long("stream_id"), long("sequence", "seq"), long("segment_id"), "ordinal", F.col("payload").cast("string").alias("payload"))


@query("""SELECT CAST(count(*) FILTER (segment_id - 1 >= k AND segment_id - 1 < m) + (SELECT count(DISTINCT stream_id) FROM rel, x WHERE segment_id - 1 >= k) AS BIGINT) AS frames, CAST(count(*) AS BIGINT) AS segments, CAST(sum(records) AS BIGINT) AS epochs, CAST(sum(records) AS BIGINT) AS records,
CAST(0 AS BIGINT) AS repaired_segment_tails, CAST(0 AS BIGINT) AS completed_seals, CAST(0 AS BIGINT) AS completed_deletions, CAST(0 AS BIGINT) AS removed_temporaries FROM segment, x GROUP BY k, m""".replace("SELECT CAST(count", ", x AS (SELECT max(segment_id) - 1 AS m, CASE WHEN max(segment_id) = 1 THEN 0 ELSE (max(segment_id) - 1) // 2 + 1 END AS k FROM rec) SELECT CAST(count", 1), "rec", "rel", "segment")
def root_recovery(log):
    """The counts of that recovery."""
    stats = byte_root(log).stats
    return log.spark.createDataFrame([tuple(stats.values())], ", ".join(f"{k} long" for k in stats))
