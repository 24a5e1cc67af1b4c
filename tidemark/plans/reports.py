"""Queries of recovery, of commits and counters, and of the report analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.operators import capacity as C
from tidemark.operators import metrics, ordered, recovery, release
from tidemark.plans.relations import Log, div, seconds_div, sql
from tidemark.plans.state import frames, highwaters

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None, *names: str, recursive: bool = False):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Log(spark, sf_dir))
        if oracle:
            text = sql(oracle, *names) if names else oracle
            ORACLE_SQL[f.__name__] = text.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else text
        return f

    return register


# ---------------------------------------------------------------- recovery

DISK = """, last AS (SELECT max(segment_id) AS m FROM segment),
disk AS (SELECT segment_id, CASE WHEN segment_id % 13 = 0 THEN false ELSE segment_id <= m - 1 END AS footer, records, bytes + CASE WHEN segment_id % 11 = 0 THEN 1 ELSE 0 END AS bytes FROM segment, last WHERE segment_id % 17 <> 0 UNION ALL SELECT m + 1, false, 0, 48 FROM last UNION ALL SELECT 0, false, 1, 100),
live AS (SELECT segment_id, sealed AND segment_id <> m - 1 AS sealed, records, bytes FROM segment, last), removed AS (SELECT segment_id FROM segment WHERE segment_id % 5 = 0)
SELECT segment_id, CASE WHEN d.segment_id IS NOT NULL AND r.segment_id IS NOT NULL THEN 'finish_delete' WHEN d.segment_id IS NULL THEN 'corrupt_missing' WHEN l.segment_id IS NULL AND segment_id <= (SELECT m FROM last) THEN 'corrupt_unexplained'
WHEN l.segment_id IS NULL THEN 'created' WHEN sealed AND NOT footer THEN 'corrupt_no_footer' WHEN sealed AND (d.records <> l.records OR d.bytes <> l.bytes) THEN 'corrupt_footer' WHEN sealed THEN 'sealed' WHEN footer THEN 'complete_seal' ELSE 'active' END AS status
FROM disk d FULL JOIN live l USING (segment_id) LEFT JOIN removed r USING (segment_id)"""


@query(DISK, "rec", "rel", "segment")
def segment_reconciliation(log):
    """A root with some footers, files and frames changed, so that every status occurs."""
    state = log.segment()
    last = log.table("events").agg((F.floor(F.max("event_id") / 512) + 1).alias("m")).first().m or 0
    seg = F.col("segment_id")
    disk = state.where(seg % 17 != 0).select("segment_id", F.when(seg % 13 == 0, False).otherwise(seg <= last - 1).alias("footer"), "records", (F.col("bytes") + F.when(seg % 11 == 0, 1).otherwise(0)).alias("bytes"))
    disk = disk.unionByName(log.spark.createDataFrame([(last + 1, False, 0, 48), (0, False, 1, 100)], disk.schema))
    live = state.select("segment_id", (F.col("sealed") & (seg != last - 1)).alias("sealed"), "records", "bytes")
    return recovery.reconcile(disk, live, state.where(seg % 5 == 0), last + 1)


@query("SELECT m AS manifest_seq, m > 7 AS applied, m > 7 AND m <> 8 AND p IS NULL AS gap FROM (SELECT DISTINCT manifest_seq AS m FROM rel WHERE manifest_seq % 10 <> 0) LEFT JOIN (SELECT DISTINCT manifest_seq + 1 AS m, 1 AS p FROM rel WHERE manifest_seq % 10 <> 0) USING (m)", "rec", "rel")
def manifest_replay(log):
    return recovery.replay(log.rel().where("manifest_seq % 10 <> 0").select("manifest_seq").distinct(), 7)


@query("SELECT stream_id, CAST(count(*) FILTER (seq > 0 AND (before IS NULL OR before <> seq - 1)) AS BIGINT) AS gaps, max(seq) AS highwater FROM (SELECT *, lag(seq) OVER (PARTITION BY stream_id ORDER BY seq) AS before FROM rec WHERE append_order % 101 <> 0) GROUP BY stream_id", "rec")
def sequence_contiguity(log):
    return recovery.gaps(log.rec().where("append_order % 101 <> 0"))


@query("SELECT segment_id, ordinal, r.seq IS NOT NULL AS released FROM rec LEFT JOIN (SELECT stream_id, seq FROM rel) r USING (stream_id, seq)", "rec", "rel")
def released_flags(log):
    """Checkpoints keep ordinals, not sequences: ranges over ordinals, then back to flags."""
    places = log.events()
    by_ordinal = log.released(places).select(F.col("segment_id").alias("stream_id"), F.col("ordinal").alias("seq"))
    ranges = ordered.coalesce_ranges(by_ordinal).withColumnRenamed("stream_id", "segment_id")
    return recovery.released_flags(places, ranges)


@query("""SELECT 'stream' AS entity, stream_id AS key, max(seq) AS value FROM rec GROUP BY stream_id UNION ALL SELECT 'segment_records', segment_id, records FROM segment UNION ALL SELECT 'segment_released', segment_id, records - unreleased FROM segment
UNION ALL SELECT 'last_applied', 0, max(manifest_seq) FROM rel UNION ALL SELECT 'next_segment', 0, max(segment_id) + 1 FROM rec""", "rec", "rel", "segment")
def checkpoint_snapshot(log):
    row = lambda df, entity, key, value: df.select(F.lit(entity).alias("entity"), key.cast("long").alias("key"), value.cast("long").alias("value"))
    seg, c = log.segment(), F.col
    parts = [
        row(highwaters(log), "stream", c("stream_id"), c("highwater")), row(seg, "segment_records", c("segment_id"), c("records")), row(seg, "segment_released", c("segment_id"), c("records") - c("unreleased")),
        row(log.rel().agg(F.max("manifest_seq").alias("v")), "last_applied", F.lit(0), c("v")), row(log.rec().agg((F.max("segment_id") + 1).alias("v")), "next_segment", F.lit(0), c("v")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT CAST(count(*) AS BIGINT) AS segments, CAST(sum(records) AS BIGINT) AS records, CAST(sum(records - unreleased) AS BIGINT) AS released, CAST(count(*) FILTER (NOT sealed) AS BIGINT) AS active, (SELECT CAST(count(DISTINCT manifest_seq) AS BIGINT) FROM rel) AS frames FROM segment", "rec", "rel", "segment")
def recovery_stats(log):
    s = log.segment().agg(F.count("*").alias("segments"), F.sum("records").alias("records"), F.sum(F.col("records") - F.col("unreleased")).alias("released"), F.count_if(~F.col("sealed")).alias("active"))
    return s.crossJoin(log.rel().agg(F.count_distinct("manifest_seq").alias("frames")))  # one row each


# ---------------------------------------------------------------- commits and counters

COMMIT = """, c AS (SELECT root, op_id, operation AS kind, bytes, row_number() OVER (PARTITION BY root ORDER BY op_id) - row_number() OVER (PARTITION BY root, operation ORDER BY op_id) AS g FROM ops WHERE operation IN ('append', 'release')),
r AS (SELECT *, row_number() OVER (PARTITION BY root, kind, g ORDER BY op_id) AS i, min(op_id) OVER (PARTITION BY root, kind, g) AS run FROM c),
s AS (SELECT root, kind, g, run, i, bytes, CAST(1 AS BIGINT) AS grp, bytes AS used, 1 AS n FROM r WHERE i = 1 UNION ALL
  SELECT r.root, r.kind, r.g, r.run, r.i, r.bytes, CASE WHEN s.used + r.bytes > 64 OR s.n >= 3 THEN s.grp + 1 ELSE s.grp END, CASE WHEN s.used + r.bytes > 64 OR s.n >= 3 THEN 0 ELSE s.used END + r.bytes, CASE WHEN s.used + r.bytes > 64 OR s.n >= 3 THEN 0 ELSE s.n END + 1
  FROM s JOIN r ON r.root = s.root AND r.kind = s.kind AND r.g = s.g AND r.i = s.i + 1)
SELECT run AS run_id, grp AS group_id, kind, CAST(count(*) AS BIGINT) AS units, CAST(sum(bytes) AS BIGINT) AS bytes FROM s GROUP BY run, grp, kind"""


def kind_runs(log: Log):
    """Commands with the first command of their run of equal kinds; runs are islands of ranks counted in lanes."""
    rows = log.ops().where(F.col("operation").isin("append", "release")).select("root", "op_id", F.col("operation").alias("kind"), "bytes")
    rows = ordered.running(ordered.running(rows, ["root"], "op_id", rank="all"), ["root", "kind"], "op_id", rank="own")
    rows = rows.withColumn("g", F.col("all") - F.col("own"))
    return rows.join(rows.groupBy("root", "kind", "g").agg(F.min("op_id").alias("run_id")), ["root", "kind", "g"])


@query(COMMIT, "ops", recursive=True)
def commit_groups(log):
    """Group commit: consecutive commands of a kind, at most 3 units and 64 bytes, never skipping over another kind."""
    groups = ordered.greedy(kind_runs(log), ["run_id", "kind"], "op_id", "bytes", 0, 64, 3, name="group_id")
    return groups.groupBy("run_id", "group_id", "kind").agg(F.count("*").alias("units"), F.sum("bytes").alias("bytes"))


@query("SELECT operation, CAST(count(*) AS BIGINT) AS started, CAST(count(*) FILTER (NOT failed) AS BIGINT) AS succeeded, CAST(count(*) FILTER (failed) AS BIGINT) AS failed, CAST(coalesce(sum(records) FILTER (NOT failed), 0) AS BIGINT) AS records, CAST(coalesce(sum(bytes) FILTER (NOT failed), 0) AS BIGINT) AS bytes, CAST(sum(elapsed_ns) AS BIGINT) AS total_ns, max(elapsed_ns) AS max_ns FROM ops GROUP BY operation", "ops")
def operation_counters(log):
    ok = lambda c: F.coalesce(F.sum(F.when(~F.col("failed"), F.col(c))), F.lit(0)).alias(c)
    return log.ops().groupBy("operation").agg(F.count("*").alias("started"), F.count_if(~F.col("failed")).alias("succeeded"), F.count_if("failed").alias("failed"), ok("records"), ok("bytes"), F.sum("elapsed_ns").alias("total_ns"), F.max("elapsed_ns").alias("max_ns"))


@query("SELECT stream_id, batch, CAST(count(*) AS BIGINT) AS records, CAST(sum(payload_len) AS BIGINT) AS bytes FROM (SELECT stream_id, payload_len, CAST((row_number() OVER (PARTITION BY stream_id ORDER BY seq) - 1) // 256 AS BIGINT) AS batch FROM rec) GROUP BY stream_id, batch", "rec")
def drain_batches(log):
    """Reads of 256 records until a stream is empty; sequences have no gaps, so they number the batches themselves."""
    return log.rec().groupBy("stream_id", div("seq", 256).alias("batch")).agg(F.count("*").alias("records"), F.sum("payload_len").alias("bytes"))


@query("""SELECT 'unique_ids' AS check_name, (SELECT count(*) FROM (SELECT DISTINCT stream_id, seq FROM rec)) = (SELECT count(*) FROM rec) AS passed UNION ALL SELECT 'released_were_appended', (SELECT count(*) FROM rel ANTI JOIN rec USING (stream_id, seq)) = 0
UNION ALL SELECT 'counts_add_up', (SELECT count(*) FROM pending) + (SELECT count(*) FROM (SELECT DISTINCT stream_id, seq FROM rel)) = (SELECT count(*) FROM rec) UNION ALL SELECT 'nothing_pending', (SELECT count(*) FROM pending) = 0""", "rec", "rel", "pending")
def handoff_invariants(log):
    rec, rel = log.rec().select("stream_id", "seq"), log.rel().select("stream_id", "seq")
    both = rec.withColumn("a", F.lit(1)).withColumn("r", F.lit(0)).unionByName(rel.distinct().withColumn("a", F.lit(0)).withColumn("r", F.lit(1)))
    ids = both.groupBy("stream_id", "seq").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    s = ids.agg(F.coalesce(F.max("a"), F.lit(0)).alias("most"), F.count_if(F.expr("a = 0")).alias("strange"), F.count_if(F.expr("a > 0 and r = 0")).alias("left"), F.sum("a").alias("appended"), F.sum("r").alias("released"))
    checks = {"unique_ids": "most <= 1", "released_were_appended": "strange = 0", "counts_add_up": "left + released = appended", "nothing_pending": "left = 0"}
    return s.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check_name"), F.expr(v).alias("passed")) for k, v in checks.items()))).alias("c")).select("c.*")


# ---------------------------------------------------------------- analytics

RANK = "min(elapsed_ns) FILTER (r >= ceil((n - 1) * {}::DOUBLE) + 1)"


@query(f"SELECT operation, min(elapsed_ns) AS min_ns, round(avg(elapsed_ns), 3) AS avg_ns, {RANK.format(0.5)} AS p50_ns, {RANK.format(0.95)} AS p95_ns, {RANK.format(0.99)} AS p99_ns, max(elapsed_ns) AS max_ns, round(avg(CAST(elapsed_ns > 50000000 AS INT)::DOUBLE), 6) AS slow_fraction FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY elapsed_ns) AS r, count(*) OVER (PARTITION BY operation) AS n FROM ops) GROUP BY operation", "ops")
def latency_summary(log):
    ops = log.ops()
    ranks = metrics.nearest_rank(ops, ["operation"], "elapsed_ns", {"p50_ns": 0.5, "p95_ns": 0.95, "p99_ns": 0.99})
    rest = ops.groupBy("operation").agg(F.min("elapsed_ns").alias("min_ns"), F.round(F.avg("elapsed_ns"), 3).alias("avg_ns"), F.max("elapsed_ns").alias("max_ns"), F.round(F.avg((F.col("elapsed_ns") > 50_000_000).cast("double")), 6).alias("slow_fraction"))
    return rest.join(ranks, "operation").select("operation", "min_ns", "avg_ns", "p50_ns", "p95_ns", "p99_ns", "max_ns", "slow_fraction")


BUCKETS = "unnest([" + ", ".join(f"{b}::DOUBLE" for b in metrics.BOUNDS) + ", 'inf'::DOUBLE]) AS le"


@query(f"SELECT bucket_start, operation, CASE WHEN le = 'inf'::DOUBLE THEN NULL ELSE le END AS le, CAST(count(*) FILTER (elapsed_ns / 1e9::DOUBLE <= le) AS BIGINT) AS cumulative FROM (SELECT CAST(epoch(ts) AS BIGINT) // 86400 * 86400 AS bucket_start, operation, elapsed_ns, {BUCKETS} FROM ops) GROUP BY bucket_start, operation, le", "ops")
def interval_histogram(log):
    day = seconds_div("ts", 86_400) * 86_400
    return metrics.cumulative_buckets(log.ops().withColumn("bucket_start", day), ["bucket_start", "operation"], F.col("elapsed_ns") / 1e9)


@query(f""", h AS (SELECT operation, le, CAST(count(*) FILTER (elapsed_ns / 1e9::DOUBLE <= le) AS BIGINT) AS cumulative FROM (SELECT operation, elapsed_ns, {BUCKETS} FROM ops) GROUP BY operation, le), t AS (SELECT operation, max(cumulative) AS total FROM h GROUP BY operation)
SELECT operation, quantile, CASE WHEN le = 'inf'::DOUBLE THEN '>300 s' WHEN le < 1 THEN printf('≤%.3f ms', le * 1000) ELSE printf('≤%.3f s', le) END AS upper_bound FROM (SELECT operation, quantile, min(le) AS le FROM h JOIN t USING (operation), (SELECT unnest([0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS quantile) WHERE cumulative >= total * quantile GROUP BY operation, quantile)""", "ops")
def bucket_quantiles(log):
    h = metrics.cumulative_buckets(log.ops(), ["operation"], F.col("elapsed_ns") / 1e9)
    return metrics.bucket_quantile(h, ["operation"], [0.5, 0.95, 0.99]).select("operation", "quantile", "upper_bound")


@query("SELECT coalesce(phase, 'all') AS phase, CAST(sum(records) AS BIGINT) AS records, round(CASE WHEN sum(elapsed_ns) > 0 THEN CAST(sum(records) AS DOUBLE) / (CAST(sum(elapsed_ns) AS DOUBLE) / 1e9::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS rate FROM ops GROUP BY GROUPING SETS ((phase), ())", "ops")
def phase_throughput(log):
    seconds = F.sum("elapsed_ns").cast("double") / 1e9
    return log.ops().groupingSets([[F.col("phase")], []], F.col("phase")).agg(F.sum("records").alias("records"), F.round(metrics.ratio(F.sum("records").cast("double"), seconds), 6).alias("rate")).withColumn("phase", F.coalesce("phase", F.lit("all")))


@query("SELECT operation, round(CAST(coalesce(sum(v), 0) AS DOUBLE), 4) AS total, greatest(coalesce(max(v), 0), 0)::DOUBLE AS top, CAST(max(t) AS BIGINT) AS last_ms FROM (SELECT event_type AS operation, CASE WHEN event_id % 9 = 0 THEN -value ELSE value END AS v, epoch_us(ts) // 1000 AS t, event_id FROM events) WHERE event_id % 13 <> 0 AND operation IN ('view', 'click') GROUP BY operation")
def series_select(log):
    """Values x timestamps series with labels: filtered by label, flattened, non-finite values dropped, then aggregated."""
    v = F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).when(F.col("event_id") % 9 == 0, -F.col("value")).otherwise(F.col("value"))
    samples = log.table("events").select("event_type", v.alias("v"), div("event_id", 1024).alias("chunk"), F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    # a line of such a file holds a chunk of a series, 1024 samples at most
    series = samples.groupBy("event_type", "chunk").agg(F.collect_list(F.struct("t", "v")).alias("s")).select(F.create_map(F.lit("__name__"), F.lit("latency"), F.lit("operation"), F.col("event_type")).alias("metric"), F.col("s.v").alias("values"), F.col("s.t").alias("timestamps"))
    label = F.try_element_at("metric", F.lit("operation"))
    chosen = series.where((F.try_element_at("metric", F.lit("__name__")) == "latency") & label.isin("view", "click"))
    flat = chosen.select(label.alias("operation"), F.explode(F.arrays_zip("values", "timestamps")).alias("p")).where(~F.isnan("p.values") & (F.abs("p.values") < float("inf")))
    return flat.groupBy("operation").agg(F.round(F.coalesce(F.sum("p.values"), F.lit(0.0)), 4).alias("total"), F.greatest(F.coalesce(F.max("p.values"), F.lit(0.0)), F.lit(0.0)).alias("top"), F.max("p.timestamps").alias("last_ms"))


@query("SELECT operation AS workload, phase, CAST(count(*) AS BIGINT) AS samples, round(CAST(sum(records) AS DOUBLE) / (CAST(sum(elapsed_ns) AS DOUBLE) / 1e9::DOUBLE), 6) AS records_per_second, round(CAST(sum(bytes) AS DOUBLE) / 1048576 / (CAST(sum(elapsed_ns) AS DOUBLE) / 1e9::DOUBLE), 9) AS mib_per_second, list_sort(list(bytes))[count(*) // 2 + 1] AS median_bytes FROM ops GROUP BY operation, phase", "ops")
def benchmark_aggregate(log):
    ops = log.ops()
    seconds = F.sum("elapsed_ns").cast("double") / 1e9
    by = ["operation", "phase"]
    rates = ops.groupBy(*by).agg(F.count("*").alias("samples"), F.round(metrics.ratio(F.sum("records").cast("double"), seconds), 6).alias("records_per_second"), F.round(metrics.ratio(F.sum("bytes").cast("double") / 1048576, seconds), 9).alias("mib_per_second"))
    return rates.join(metrics.upper_median(ops, by, "bytes", "median_bytes"), by).withColumnRenamed("operation", "workload")


CASES = ", k AS (SELECT concat_ws('|', o_orderstatus, o_orderpriority, o_custkey % 5) AS identity, o_orderdate < TIMESTAMP '1998-06-01' AS base, o_totalprice FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1998-06-01' AND o_custkey % 5 = 3)), a AS (SELECT identity, base, avg(o_totalprice) AS rate, max(o_totalprice) AS p99 FROM k GROUP BY identity, base)"


@query(CASES[2:].join(["WITH ", ""]) + """ SELECT b.identity, round(CASE WHEN c.identity IS NULL THEN NULL WHEN b.rate = 0 THEN 0.0::DOUBLE ELSE (c.rate - b.rate) / b.rate * 100.0::DOUBLE END, 6) AS throughput_change, round(CASE WHEN c.identity IS NULL THEN NULL WHEN b.p99 = 0 THEN 0.0::DOUBLE ELSE (c.p99 - b.p99) / b.p99 * 100.0::DOUBLE END, 6) AS p99_change,
CASE WHEN c.identity IS NULL THEN 'missing' WHEN (c.rate - b.rate) / b.rate * 100 < -15 OR (c.p99 - b.p99) / b.p99 * 100 > 25 THEN 'regression' ELSE 'ok' END AS status FROM (SELECT * FROM a WHERE base) b LEFT JOIN (SELECT * FROM a WHERE NOT base) c ON b.identity = c.identity""")
def benchmark_compare(log):
    base = F.col("o_orderdate").cast("timestamp") < F.to_timestamp(F.lit("1998-06-01"))
    cases = log.table("orders").select(F.concat_ws("|", "o_orderstatus", "o_orderpriority", (F.col("o_custkey") % 5).cast("string")).alias("identity"), base.alias("base"), (F.col("o_custkey") % 5).alias("five"), "o_totalprice").where("base or five <> 3")
    a = cases.groupBy("identity", "base").agg(F.avg("o_totalprice").alias("rate"), F.max("o_totalprice").alias("p99"))
    pair = a.where("base").alias("b").join(a.where("not base").alias("c"), F.col("b.identity") == F.col("c.identity"), "left")
    gone = F.col("c.identity").isNull()
    t, p = metrics.percent_change(F.col("b.rate"), F.col("c.rate")), metrics.percent_change(F.col("b.p99"), F.col("c.p99"))
    return pair.select(F.col("b.identity").alias("identity"), F.when(~gone, F.round(t, 6)).alias("throughput_change"), F.when(~gone, F.round(p, 6)).alias("p99_change"), F.when(gone, "missing").when((t < -15) | (p > 25), "regression").otherwise("ok").alias("status"))


@query("SELECT stream_id, seq, CAST((epoch_us(r.at) - epoch_us(ts)) * 1000 AS BIGINT) AS latency_ns FROM rec JOIN (SELECT stream_id, seq, manifest_seq FROM rel) USING (stream_id, seq) JOIN (SELECT append_order // 256 + 1 AS manifest_seq, max(ts) AS at FROM rec GROUP BY append_order // 256 + 1) r USING (manifest_seq)", "rec", "rel")
def handoff_latency(log):
    rec = log.rec()
    ends = rec.groupBy((div("append_order", 256) + 1).alias("manifest_seq")).agg(F.max("ts").alias("at"))
    rows = rec.select("stream_id", "seq", "ts").join(log.rel().select("stream_id", "seq", "manifest_seq"), ["stream_id", "seq"]).join(ends, "manifest_seq")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.select("stream_id", "seq", ((micros("at") - micros("ts")) * 1000).alias("latency_ns"))


@query("SELECT producer_id, CAST(count(*) FILTER (before >= k) AS BIGINT) AS violations FROM (SELECT producer_id, k, lag(k) OVER (PARTITION BY producer_id ORDER BY append_order) AS before FROM (SELECT producer_id, append_order, append_order - append_order % 7 * 20 AS k FROM rec)) GROUP BY producer_id", "rec")
def producer_order(log):
    """Sequences of each producer must rise; here some are moved back."""
    rows = log.rec().select("producer_id", "append_order", (F.col("append_order") - F.col("append_order") % 7 * 20).alias("k"))
    rows = ordered.running(rows, ["producer_id"], "append_order")
    return ordered.previous(rows, ["producer_id"], "rank", F.col("k")).groupBy("producer_id").agg(F.count_if(F.col("prev") >= F.col("k")).alias("violations"))


PHASES = """WITH RECURSIVE h AS (SELECT CAST(epoch(ts) AS BIGINT) // 3600 AS sample_idx, avg(value) / 60.0::DOUBLE AS u FROM events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY sample_idx) AS i, max(sample_idx) OVER () - 24 AS deadline FROM h),
s AS (SELECT i, sample_idx, CASE WHEN sample_idx > deadline THEN 'final_drain' WHEN u >= 0.65::DOUBLE THEN 'steady' ELSE 'warmup' END AS phase, 0 AS held FROM o WHERE i = 1 UNION ALL
SELECT i, sample_idx, coalesce(t, phase), CASE WHEN t IS NULL THEN held + 1 ELSE 0 END FROM (SELECT o.i, o.sample_idx, s.phase, s.held, CASE WHEN s.phase = 'final_drain' THEN NULL WHEN o.sample_idx > o.deadline THEN 'final_drain' WHEN s.phase = 'warmup' AND o.u >= 0.65::DOUBLE THEN 'steady'
WHEN s.phase = 'steady' AND s.held >= 2 THEN 'pressure_fill' WHEN s.phase = 'pressure_fill' AND o.u >= 0.95::DOUBLE THEN 'pressure_hold' WHEN s.phase = 'pressure_hold' AND s.held >= 2 THEN 'recovery' WHEN s.phase = 'recovery' AND o.u <= 0.45::DOUBLE THEN 'steady' END AS t FROM s JOIN o ON o.i = s.i + 1))
SELECT sample_idx, phase FROM s"""


def _phase(state: tuple[str, int], row: tuple[int, float, int]) -> tuple[tuple[str, int], tuple[str]]:
    (phase, held), (hour, u, deadline) = state, row
    ready = {"warmup": ("steady", u >= 0.65), "steady": ("pressure_fill", held >= 2), "pressure_fill": ("pressure_hold", u >= 0.95), "pressure_hold": ("recovery", held >= 2), "recovery": ("steady", u <= 0.45), "final_drain": ("", False)}
    to, go = ready[phase]
    if phase != "final_drain" and hour > deadline:
        to, go = "final_drain", True
    state = (to, 0) if go else (phase, held + 1)
    return state, (state[0],)


@query(PHASES)
def phase_machine(log):
    """Hysteresis over hourly utilisation samples, and the drain of the last day; hours, not rows, are folded."""
    hour = seconds_div("ts", 3600)
    samples = log.table("events").groupBy(hour.alias("sample_idx")).agg((F.avg("value") / 60.0).alias("u"))
    rows = samples.crossJoin(log.table("events").agg((F.max(hour) - 24).alias("deadline")))  # one row
    rows = rows.select(F.lit(0).alias("run"), "sample_idx", "u", "deadline")
    return ordered.folded(rows, ["run"], "sample_idx", "phase string", ("warmup", -1), _phase).select("sample_idx", "phase")


@query(r"""SELECT 'root_pending_records{stream="' || stream_id || '",run="a\\b\"c\n"} ' || n || ' 1700000000000' AS line FROM (SELECT stream_id, count(*) AS n FROM pending GROUP BY stream_id)""".replace(r'a\\b\"c\n', "a\\\\b\\\"c\\n"), "rec", "rel", "pending")
def prometheus_lines(log):
    run = metrics.escape_label(F.lit('a\\b"c\n'))
    n = log.pending().groupBy("stream_id").agg(F.count("*").alias("n"))
    return n.select(F.concat(F.lit('root_pending_records{stream="'), F.col("stream_id").cast("string"), F.lit('",run="'), run, F.lit('"} '), F.col("n").cast("string"), F.lit(" 1700000000000")).alias("line"))


@query("SELECT CAST(event_id % 12 % 5 AS BIGINT) AS stream_id, CAST(count(*) AS BIGINT) AS target FROM events GROUP BY event_id % 12 % 5")
def stream_targets(log):
    """Record i goes to producer i mod 12, which writes to stream mod 5."""
    return log.table("events").groupBy((F.col("event_id") % 12 % 5).cast("long").alias("stream_id")).agg(F.count("*").alias("target"))


@query("SELECT append_order AS event_id, lower('00112233445566778899AABBCCDDEEFF' || le(stream_id) || le(seq)) AS id_hex, be(stream_id) || be(seq) AS key_hex, stream_id AS decoded_stream, seq AS decoded_seq FROM rec".replace("le(stream_id)", "{0}").replace("le(seq)", "{1}").replace("be(stream_id)", "{2}").replace("be(seq)", "{3}").format(*(("(" + " || ".join(f"substr(lpad(hex({c}), 16, '0'), {i}, 2)" for i in (15, 13, 11, 9, 7, 5, 3, 1)) + ")") for c in ("stream_id", "seq")), *(f"lower(lpad(hex({c}), 16, '0'))" for c in ("stream_id", "seq"))), "rec")
def record_id_codec(log):
    root = F.unhex(F.lit("00112233445566778899AABBCCDDEEFF"))
    rows = log.rec().select(F.col("append_order").alias("event_id"), codec.record_id(root, F.col("stream_id"), F.col("seq")).alias("id"), codec.kv_key(F.col("stream_id"), F.col("seq")).alias("key"))
    return rows.select("event_id", F.lower(F.hex("id")).alias("id_hex"), F.lower(F.hex("key")).alias("key_hex"), codec.id_stream(F.col("id")).alias("decoded_stream"), codec.id_sequence(F.col("id")).alias("decoded_seq"))


# ---------------------------------------------------------------- streaming

@query("SELECT stream_id, highwater, CAST(coalesce(n, 0) AS BIGINT) AS pending_records, CAST(coalesce(b, 0) AS BIGINT) AS pending_payload_bytes, CAST(r AS BIGINT) AS released FROM (SELECT stream_id, max(seq) AS highwater FROM rec GROUP BY stream_id) LEFT JOIN (SELECT stream_id, count(*) AS n, sum(payload_len) AS b FROM pending GROUP BY stream_id) USING (stream_id) JOIN (SELECT stream_id, count(*) AS r FROM rel GROUP BY stream_id) USING (stream_id)", "rec", "rel", "pending")
def streaming_state_final(log):
    """Appends, then releases (each twice), as a stream of commands drained through the state processor."""
    from tidemark.streaming.lifecycle import cut, drain

    command = lambda df, kind, size: df.select("stream_id", F.lit(kind).alias("kind"), F.col("append_order").alias("order"), "seq", size.cast("long").alias("payload_len"))
    appends, releases = command(log.rec(), "append", F.col("payload_len")), command(log.rel(), "release", F.lit(0))
    final = drain(log.spark, [*cut(appends), *cut(releases.unionByName(releases))])
    return final.select("stream_id", "highwater", "pending_records", "pending_payload_bytes", "released")
