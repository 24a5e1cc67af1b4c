"""Queries of the log state: sequences, pending sets, releases, segments and capacity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import capacity as C
from tidemark.operators import ordered, release
from tidemark.plans.relations import Log, div, sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None, *names: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Log(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, *names) if names else oracle
        return f

    return register


HIGHWATER = "SELECT stream_id, max(seq) AS highwater FROM rec GROUP BY stream_id"


def highwaters(log: Log):
    return log.rec().groupBy("stream_id").agg(F.max("seq").alias("highwater"))


# ---------------------------------------------------------------- streams

@query("SELECT stream_id, seq, payload_len, CAST(c AS BIGINT) AS cum_bytes FROM (SELECT *, row_number() OVER w AS r, sum(payload_len) OVER w AS c FROM doc_pending WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) WHERE r <= 32 AND c <= 100000", "doc")
def pending_prefix(log):
    return ordered.bounded_prefix(log.doc_pending(), 32, 100_000).select("stream_id", "seq", "payload_len", "cum_bytes")


@query("SELECT append_order AS event_id, stream_id, seq FROM rec", "rec")
def assign_sequences(log):
    return log.rec().select(F.col("append_order").alias("event_id"), "stream_id", "seq")


@query(f"SELECT stream_id, highwater, CAST(coalesce(n, 0) AS BIGINT) AS pending_records, CAST(coalesce(b, 0) AS BIGINT) AS pending_payload_bytes FROM ({HIGHWATER}) LEFT JOIN (SELECT stream_id, count(*) AS n, sum(payload_len) AS b FROM pending GROUP BY stream_id) USING (stream_id)", "rec", "rel", "pending")
def stream_stats(log):
    left = log.pending().groupBy("stream_id").agg(F.count("*").alias("n"), F.sum("payload_len").alias("b"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return highwaters(log).join(left, "stream_id", "left").select("stream_id", "highwater", zero("n", "pending_records"), zero("b", "pending_payload_bytes"))


@query("SELECT DISTINCT stream_id FROM rec ORDER BY stream_id", "rec")
def known_streams(log):
    return log.events().select("stream_id").distinct().orderBy("stream_id")


@query("SELECT stream_id, seq, payload_len AS required_bytes, CAST(1500 AS BIGINT) AS max_bytes FROM (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS r FROM doc_pending) WHERE r = 1 AND payload_len > 1500", "doc")
def read_limit_errors(log):
    return ordered.too_large_first(log.doc_pending(), 1500)


@query("SELECT CAST((SELECT count(DISTINCT stream_id) FROM rec) AS BIGINT) AS streams, CAST(sum(unreleased) AS BIGINT) AS pending_records, CAST((SELECT sum(payload_len) FROM pending) AS BIGINT) AS pending_payload_bytes, CAST(count(*) AS BIGINT) AS live_segments, CAST(count(*) FILTER (sealed) AS BIGINT) AS sealed_segments, CAST(count(*) FILTER (sealed AND unreleased = 0) AS BIGINT) AS reclaimable_segments, CAST(sum(bytes) AS BIGINT) AS live_bytes, CAST(coalesce(sum(bytes) FILTER (sealed AND unreleased = 0), 0) AS BIGINT) AS reclaimable_bytes, coalesce(bool_or(sealed AND unreleased = 0 OR NOT sealed AND unreleased = 0), false) AS automatic_work FROM segment", "rec", "rel", "pending", "segment")
def root_storage_stats(log):
    done = F.col("unreleased") == 0
    root = log.segment().agg(F.sum("unreleased").alias("pending_records"), F.count("*").alias("live_segments"), F.count_if("sealed").alias("sealed_segments"), F.count_if(F.col("sealed") & done).alias("reclaimable_segments"), F.sum("bytes").alias("live_bytes"), F.coalesce(F.sum(F.when(F.col("sealed") & done, F.col("bytes"))), F.lit(0)).cast("long").alias("reclaimable_bytes"), F.coalesce(F.bool_or(done), F.lit(False)).alias("automatic_work"))
    left = log.pending().agg(F.sum("payload_len").alias("pending_payload_bytes"))
    streams = log.rec().agg(F.count_distinct("stream_id").alias("streams"))
    return root.crossJoin(left).crossJoin(streams)  # one row each


# ---------------------------------------------------------------- release algebra

@query("SELECT stream_id, seq, min(u) AS unit_id FROM (SELECT stream_id, seq, unit_id AS u FROM rel UNION ALL SELECT stream_id, seq, unit_id + 1 FROM rel WHERE append_order % 3 = 0 UNION ALL SELECT stream_id, seq, unit_id - 1 FROM rel WHERE append_order % 7 = 0) WHERE seq % 11 <> 0 GROUP BY stream_id, seq", "rec", "rel")
def effective_release(log):
    rel = log.rel()
    more = rel.where("append_order % 3 = 0").withColumn("unit_id", F.col("unit_id") + 1)
    less = rel.where("append_order % 7 = 0").withColumn("unit_id", F.col("unit_id") - 1)
    requests = rel.unionByName(more).unionByName(less).select("stream_id", "seq", "unit_id")
    return release.effective(requests, log.rec().where("seq % 11 <> 0"))


@query(f"SELECT append_order AS request_id, CASE WHEN append_order % 97 = 0 OR append_order % 89 = 0 THEN 'scope_mismatch' WHEN highwater IS NULL OR seq + CASE WHEN append_order % 83 = 0 THEN 1000000000 ELSE 0 END > highwater THEN 'unknown_record_id' ELSE 'ok' END AS outcome FROM rec LEFT JOIN ({HIGHWATER}) USING (stream_id)", "rec")
def release_validation(log):
    when = lambda n, a, b: F.when(F.col("append_order") % n == 0, a).otherwise(b)
    requests = log.rec().select(F.col("append_order").alias("request_id"), "stream_id", when(97, "other", "this").alias("root"), when(89, F.col("stream_id") + 1, F.col("stream_id")).alias("handle_stream"), (F.col("seq") + when(83, 1_000_000_000, 0)).alias("seq"))
    return release.classify(requests, highwaters(log), "this").select("request_id", "outcome")


@query("SELECT stream_id, range_start, len FROM ranges", "rec", "rel", "ranges")
def release_ranges(log):
    return log.ranges()


@query("SELECT stream_id, seq FROM pending", "rec", "rel", "pending")
def pending_by_range_antijoin(log):
    return release.outside_ranges(log.rec(), log.ranges()).select("stream_id", "seq")


MOVED = "SELECT stream_id, range_start - range_start % 3 AS range_start, len FROM ranges"


@query(f"SELECT stream_id, CAST(count(*) FILTER (range_start < before + 2) AS BIGINT) AS violations FROM (SELECT *, lag(range_start + len - 1) OVER (PARTITION BY stream_id ORDER BY range_start, len) AS before FROM ({MOVED})) GROUP BY stream_id", "rec", "rel", "ranges")
def range_validation(log):
    return release.range_violations(log.ranges().withColumn("range_start", F.col("range_start") - F.col("range_start") % 3))


@query("SELECT stream_id, word_index, word, released FROM words", "rec", "rel", "words")
def release_bitmap(log):
    return log.words()


@query("SELECT stream_id, CAST(count(*) AS BIGINT) AS runs FROM ranges GROUP BY stream_id", "rec", "rel", "ranges")
def bitmap_run_count(log):
    return release.bitmap_runs(log.words())


@query(f"SELECT stream_id, highwater + 1 AS record_count, CAST(count(*) AS BIGINT) AS range_count, CASE WHEN 16 * count(*) <= 8 * ((highwater + 64) // 64) THEN 'ranges' ELSE 'bitmap' END AS encoding FROM ranges JOIN ({HIGHWATER}) USING (stream_id) GROUP BY stream_id, highwater", "rec", "rel", "ranges")
def canonical_encoding(log):
    counts = log.ranges().groupBy("stream_id").agg(F.count("*").alias("range_count")).join(highwaters(log), "stream_id")
    out = counts.withColumn("record_count", F.col("highwater") + 1)
    return out.select("stream_id", "record_count", "range_count", release.encoding(F.col("record_count"), F.col("range_count")).alias("encoding"))


@query("SELECT stream_id, seq, CAST(count(*) AS BIGINT) AS n FROM (SELECT stream_id, seq FROM rec UNION ALL SELECT stream_id, seq FROM rec WHERE append_order % 50 = 0) GROUP BY stream_id, seq HAVING count(*) > 1", "rec")
def duplicate_identities(log):
    ids = log.rec().select("stream_id", "seq", "append_order")
    return ids.unionByName(ids.where("append_order % 50 = 0")).groupBy("stream_id", "seq").agg(F.count("*").alias("n")).where("n > 1")


# ---------------------------------------------------------------- segments and reclaim

@query("SELECT epoch_id, record_count, encoded_bytes FROM epoch", "epoch")
def epoch_sizes(log):
    return log.epoch().select("epoch_id", "record_count", "encoded_bytes")


@query("SELECT epoch_id, ordinal, d AS descriptor_offset, d + 40 + metadata_len AS payload_offset FROM (SELECT *, CAST(48 + sum(40 + metadata_len + payload_len) OVER (PARTITION BY epoch_id ORDER BY ordinal ROWS UNBOUNDED PRECEDING) - (40 + metadata_len + payload_len) AS BIGINT) AS d FROM conv)", "epoch")
def record_offsets(log):
    rows = log.conv().withColumn("size", C.record_bytes(F.col("metadata_len"), F.col("payload_len")))
    rows = ordered.running(rows, ["epoch_id"], "ordinal", {"end": "size"})
    start = F.col("end") - F.col("size") + C.EPOCH_HEADER
    return rows.select("epoch_id", "ordinal", start.alias("descriptor_offset"), (start + C.DESCRIPTOR + F.col("metadata_len")).alias("payload_offset"))


PACKED = """, o AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY epoch_id) AS i FROM epoch),
p AS (SELECT root, epoch_id, i, encoded_bytes, CAST(1 AS BIGINT) AS segment_id, CAST(48 AS BIGINT) AS pos FROM o WHERE i = 1 UNION ALL
  SELECT o.root, o.epoch_id, o.i, o.encoded_bytes, CASE WHEN p.pos + p.encoded_bytes + o.encoded_bytes > 16336 THEN p.segment_id + 1 ELSE p.segment_id END, CASE WHEN p.pos + p.encoded_bytes + o.encoded_bytes > 16336 THEN 48 ELSE p.pos + p.encoded_bytes END FROM p JOIN o ON o.root = p.root AND o.i = p.i + 1)"""


def _recursive(body: str) -> str:
    return body.replace("WITH ", "WITH RECURSIVE ", 1)


@query(None)
def segment_packing(log):
    packed = ordered.greedy(log.epoch(), ["root"], "epoch_id", "encoded_bytes", C.SEGMENT_HEADER, 16_384 - C.SEGMENT_FOOTER, name="segment_id")
    return packed.select("epoch_id", "segment_id", F.col("offset").alias("segment_offset"), F.concat(F.lit("segment-"), F.lpad(F.col("segment_id").cast("string"), 20, "0"), F.lit(".log")).alias("file_name"))


ORACLE_SQL["segment_packing"] = _recursive(sql("", "epoch").rstrip() + PACKED + " SELECT epoch_id, segment_id, pos AS segment_offset, 'segment-' || lpad(CAST(segment_id AS VARCHAR), 20, '0') || '.log' AS file_name FROM p")


@query(None)
def read_spans(log):
    rows = log.conv().withColumn("size", C.record_bytes(F.col("metadata_len"), F.col("payload_len")))
    spans = ordered.greedy(rows, ["epoch_id"], "ordinal", "size", 0, 2048, name="span_id")
    return spans.groupBy("epoch_id", "span_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("records"))


ORACLE_SQL["read_spans"] = _recursive(sql("", "epoch").rstrip() + """, s AS (SELECT epoch_id, ordinal, CAST(1 AS BIGINT) AS span_id, 40 + metadata_len + payload_len AS size, 40 + metadata_len + payload_len AS used FROM conv WHERE ordinal = 0 UNION ALL
  SELECT c.epoch_id, c.ordinal, CASE WHEN s.used + 40 + c.metadata_len + c.payload_len > 2048 THEN s.span_id + 1 ELSE s.span_id END, 40 + c.metadata_len + c.payload_len, CASE WHEN s.used + 40 + c.metadata_len + c.payload_len > 2048 THEN 0 ELSE s.used END + 40 + c.metadata_len + c.payload_len
  FROM s JOIN conv c ON c.epoch_id = s.epoch_id AND c.ordinal = s.ordinal + 1) SELECT epoch_id, span_id, CAST(sum(size) AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS records FROM s GROUP BY epoch_id, span_id""")


@query("SELECT segment_id, records, streams, unreleased, sealed, sealed AND unreleased = 0 AS reclaimable FROM segment", "rec", "rel", "segment")
def segment_state(log):
    return log.segment().select("segment_id", "records", "streams", "unreleased", "sealed", (F.col("sealed") & (F.col("unreleased") == 0)).alias("reclaimable"))


def reclaimable(log: Log):
    return log.segment().where("sealed and unreleased = 0")


@query("SELECT CAST((row_number() OVER (ORDER BY segment_id) - 1) // 4 AS BIGINT) AS batch, segment_id, bytes FROM segment WHERE sealed AND unreleased = 0", "rec", "rel", "segment")
def reclaim_batches(log):
    ranked = ordered.running(reclaimable(log).withColumn("root", F.lit(0)), ["root"], "segment_id")
    return ranked.select(F.floor((F.col("rank") - 1) / C.RECLAIM_JOB).cast("long").alias("batch"), "segment_id", "bytes")


@query("SELECT segment_id, stream_id, max(seq) AS sequence FROM rec JOIN segment USING (segment_id) LEFT JOIN (SELECT stream_id, max(seq) AS persisted FROM rec WHERE append_order < 1024 GROUP BY stream_id) USING (stream_id) WHERE sealed AND unreleased = 0 GROUP BY segment_id, stream_id, persisted HAVING persisted IS NULL OR max(seq) > persisted", "rec", "rel", "segment")
def removal_highwaters(log):
    top = log.rec().join(reclaimable(log).select("segment_id"), "segment_id", "left_semi").groupBy("segment_id", "stream_id").agg(F.max("seq").alias("sequence"))
    persisted = log.rec().where("append_order < 1024").groupBy("stream_id").agg(F.max("seq").alias("persisted"))
    return top.join(persisted, "stream_id", "left").where("persisted is null or sequence > persisted").select("segment_id", "stream_id", "sequence")


# ---------------------------------------------------------------- capacity

STATE = "state AS (SELECT CAST((SELECT count(DISTINCT stream_id) FROM rec) AS BIGINT) AS streams, CAST(sum(72 + 8 * ((records + 63) // 64)) AS BIGINT) AS entries, max(streams) AS most, bool_or(NOT sealed) AS active, CAST(sum(bytes) AS BIGINT) AS bytes FROM segment)"
MANIFEST = "greatest(72 + 16 * 65536, 80, 4 * (64 + 16 * most))"
HEADROOM = f"(80 + 16 * streams + entries + {MANIFEST} + CASE WHEN active THEN 48 ELSE 0 END)"


def root_state(log: Log):
    s = log.segment().agg(F.sum(C.SEGMENT_ENTRY + C.bitmap_bytes(F.col("records"))).alias("entries"), F.max("streams").alias("most"), F.bool_or(~F.col("sealed")).alias("active"), F.sum("bytes").alias("bytes"))
    return s.crossJoin(log.rec().agg(F.count_distinct("stream_id").alias("streams")))  # one row each


def headroom():
    return C.maintenance_headroom(F.col("streams"), F.col("entries"), F.col("most"), F.col("active"))


def actual_bytes():
    """Superblock, checkpoint, log header and segments of a root."""
    return F.col("bytes") + C.ROOT + C.LOG_HEADER + 8 + C.checkpoint_base(F.col("streams"))


@query(f", {STATE} SELECT streams, CAST({MANIFEST} AS BIGINT) AS manifest_bytes, CAST({HEADROOM} AS BIGINT) AS headroom_bytes FROM state", "rec", "rel", "segment")
def maintenance_headroom(log):
    return root_state(log).select("streams", C.largest_manifest_group(F.col("most")).cast("long").alias("manifest_bytes"), headroom().cast("long").alias("headroom_bytes"))


@query(f", {STATE} SELECT CAST(168 + 16 * streams + bytes AS BIGINT) AS actual_bytes, CAST(greatest(c - (168 + 16 * streams + bytes + {HEADROOM}), 0) AS BIGINT) AS admissible_bytes, c AS capacity_bytes, round(CASE WHEN c > 0 THEN CAST(168 + 16 * streams + bytes + {HEADROOM} AS DOUBLE) / c ELSE 0.0::DOUBLE END, 9) AS utilization FROM state, (SELECT unnest([0::BIGINT, 1000000::BIGINT, 4000000000::BIGINT]) AS c)", "rec", "rel", "segment")
def capacity_utilization(log):
    rows = root_state(log).withColumn("c", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 1_000_000, 4_000_000_000)))))
    actual = actual_bytes()
    weight = actual + headroom()
    return rows.select(actual.alias("actual_bytes"), F.greatest(F.col("c") - weight, F.lit(0)).cast("long").alias("admissible_bytes"), F.col("c").alias("capacity_bytes"), F.round(F.when(F.col("c") > 0, weight.cast("double") / F.col("c")).otherwise(F.lit(0.0)), 9).alias("utilization"))


GROUPS = "g AS (SELECT epoch_id AS group_id, record_count AS n, encoded_bytes AS b, unnest([3000::BIGINT, 2500000::BIGINT, 5000000::BIGINT, 3000000000::BIGINT]) AS c FROM epoch)"
ADMIT = f""", {STATE}, {GROUPS}, w AS (SELECT *, 168 + 16 * streams + bytes AS actual, {HEADROOM} AS head, 80 + 16 * streams + entries + 72 + 8 * ((n + 63) // 64) + {MANIFEST} + 48 AS head_after,
  2 * (80 + 16 * streams) + 40 + 40 + 48 + b + 72 + 8 * ((n + 63) // 64) + greatest(72 + 16 * 65536, 80, 4 * (64 + 16)) + 48 AS least FROM g, state),
  v AS (SELECT *, actual + b + 48 + 128 + head_after AS weight FROM w)
  SELECT group_id, c AS capacity_bytes, CASE WHEN weight <= c THEN 'admit' WHEN least > c THEN 'exceeds' ELSE 'wait' END AS decision,
  CASE WHEN weight <= c THEN NULL WHEN least > c THEN CAST(least AS BIGINT) ELSE CAST(weight - actual - head AS BIGINT) END AS needed, CASE WHEN weight <= c OR least > c THEN NULL ELSE CAST(greatest(c - actual - head, 0) AS BIGINT) END AS available FROM v"""


@query(ADMIT, "rec", "rel", "segment", "epoch")
def append_admission(log):
    """Each epoch as a group of a known stream that has to open a new segment, under several capacities."""
    caps = F.array(*(F.lit(x).cast("long") for x in (3_000, 2_500_000, 5_000_000, 3_000_000_000)))
    groups = log.epoch().select(F.col("epoch_id").alias("group_id"), F.col("record_count").alias("n"), F.col("encoded_bytes").alias("b"), F.explode(caps).alias("c"))
    rows = groups.crossJoin(F.broadcast(root_state(log)))  # the state is one row
    none = F.lit(0).cast("long")
    root = {"actual": actual_bytes(), "streams": F.col("streams"), "entries": F.col("entries"), "most": F.col("most"), "active": F.col("active"), "active_free": F.lit(-1), "active_records": none, "active_streams": none}
    group = {"bytes": F.col("b"), "records": F.col("n"), "streams": F.lit(1), "new_streams": none, "joining": none}
    return rows.select("group_id", F.col("c").alias("capacity_bytes"), *(c.alias(k) for k, c in C.admission(root, group, F.col("c")).items()))


CASES = """cases AS (SELECT 'active' AS root_case, 168 + 16 * streams + bytes AS actual, streams, entries, most, true AS active, 3000 AS free, 100 AS ar, 2 AS ast FROM state UNION ALL SELECT 'empty', 168, 0, 0, 0, false, 0, 0, 0),
groups AS (SELECT epoch_id AS group_id, record_count AS n, encoded_bytes AS b, CASE WHEN stream_id % 3 = 0 THEN 1 ELSE 0 END AS fresh, CASE WHEN stream_id % 2 = 0 THEN 1 ELSE 0 END AS joining, unnest([1000::BIGINT, 1053000::BIGINT, 2500000::BIGINT, NULL]) AS c FROM epoch)"""
ADMIT_CASES = f""", {STATE}, {CASES}, f AS (SELECT *, active AND b <= free AS fits, streams + fresh AS after FROM groups, cases),
  w AS (SELECT *, actual + b + CASE WHEN fits THEN 0 ELSE 48 END + CASE WHEN active AND NOT fits THEN 128 ELSE 0 END + 80 + 16 * after + entries + CASE WHEN fits THEN 8 * ((ar + n + 63) // 64 - (ar + 63) // 64) ELSE 72 + 8 * ((n + 63) // 64) END
    + greatest(72 + 16 * 65536, 80, 4 * (64 + 16 * greatest(most, CASE WHEN fits THEN ast + joining ELSE 1 END))) + 48 AS weight, actual + 80 + 16 * streams + entries + {MANIFEST} + CASE WHEN active THEN 48 ELSE 0 END AS now,
    2 * (80 + 16 * after) + 40 + 40 + 48 + b + 72 + 8 * ((n + 63) // 64) + greatest(72 + 16 * 65536, 80, 4 * (64 + 16)) + 48 AS least FROM f)
  SELECT group_id, root_case, fits, c AS capacity_bytes, CASE WHEN c IS NULL OR weight <= c THEN 'admit' WHEN least > c THEN 'exceeds' ELSE 'wait' END AS decision,
  CAST(CASE WHEN c IS NULL OR weight <= c THEN NULL WHEN least > c THEN least ELSE greatest(weight - now, 0) END AS BIGINT) AS needed, CAST(CASE WHEN c IS NULL OR weight <= c OR least > c THEN NULL ELSE greatest(c - now, 0) END AS BIGINT) AS available FROM w"""


@query(ADMIT_CASES, "rec", "rel", "segment", "epoch")
def admission_cases(log):
    """Each epoch as a group, its stream known or new, against an empty root and one whose active segment has 3000
    bytes left: it fits there, rolls over, or opens the first segment."""
    caps = F.array(*(F.lit(x).cast("long") for x in (1_000, 1_053_000, 2_500_000, None)))
    flag = lambda n: F.when(F.col("stream_id") % n == 0, 1).otherwise(0).cast("long")
    groups = log.epoch().select(F.col("epoch_id").alias("group_id"), F.col("record_count").alias("n"), F.col("encoded_bytes").alias("b"), flag(3).alias("fresh"), flag(2).alias("joining"), F.explode(caps).alias("c"))
    long = lambda x: F.lit(x).cast("long")
    full = root_state(log).select(F.lit("active").alias("root_case"), actual_bytes().alias("actual"), "streams", "entries", "most", F.lit(True).alias("active"), long(3000).alias("free"), long(100).alias("ar"), long(2).alias("ast"))
    empty = log.spark.range(1).select(F.lit("empty").alias("root_case"), long(168).alias("actual"), *(long(0).alias(c) for c in ("streams", "entries", "most")), F.lit(False).alias("active"), *(long(0).alias(c) for c in ("free", "ar", "ast")))
    rows = groups.crossJoin(F.broadcast(full.unionByName(empty)))  # two rows
    root = {"actual": "actual", "streams": "streams", "entries": "entries", "most": "most", "active": "active", "active_free": "free", "active_records": "ar", "active_streams": "ast"}
    group = {"bytes": F.col("b"), "records": F.col("n"), "streams": long(1), "new_streams": F.col("fresh"), "joining": F.col("joining")}
    verdict = C.admission({k: F.col(v) for k, v in root.items()}, group, F.col("c"))
    return rows.select("group_id", "root_case", (F.col("active") & (F.col("b") <= F.col("free"))).alias("fits"), F.col("c").alias("capacity_bytes"), *(c.alias(k) for k, c in verdict.items()))


@query("SELECT root, CAST(count(*) FILTER (t <= 20000) AS BIGINT) AS selected, CAST(coalesce(max(t) FILTER (t <= 20000), 0) AS BIGINT) AS selected_bytes FROM (SELECT root, sum(encoded_bytes) OVER (PARTITION BY root ORDER BY epoch_id ROWS UNBOUNDED PRECEDING) AS t FROM epoch) GROUP BY root", "epoch")
def admissible_prefix(log):
    rows = ordered.running(log.epoch(), ["root"], "epoch_id", {"total": "encoded_bytes"})
    fits = F.col("total") <= 20_000
    return rows.groupBy("root").agg(F.count_if(fits).alias("selected"), F.coalesce(F.max(F.when(fits, F.col("total"))), F.lit(0)).cast("long").alias("selected_bytes"))


FRAMES = "f AS (SELECT manifest_seq, CAST(sum(72 + 16 * n) AS BIGINT) AS frame_bytes FROM (SELECT manifest_seq, stream_id, count(DISTINCT i) AS n FROM (SELECT manifest_seq, stream_id, seq - row_number() OVER (PARTITION BY manifest_seq, stream_id ORDER BY seq) AS i FROM rel) GROUP BY manifest_seq, stream_id) GROUP BY manifest_seq)"


def frames(log: Log):
    """Release frames of a group: one per stream, with its ranges."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("manifest_seq", "stream_id").orderBy("seq"))
    islands = log.rel().select("manifest_seq", "stream_id", (F.col("seq") - rank).alias("i")).distinct()
    per = islands.groupBy("manifest_seq", "stream_id").agg(F.count("*").alias("n"))
    return per.groupBy("manifest_seq").agg(F.sum(C.RELEASE_BASE + C.RANGE * F.col("n")).alias("frame_bytes"))


@query(f", {FRAMES} SELECT manifest_seq AS group_idx, CAST(40 + sum(frame_bytes) OVER (ORDER BY manifest_seq) AS BIGINT) AS manifest_bytes, 40 + sum(frame_bytes) OVER (ORDER BY manifest_seq) >= 65536 AS triggers FROM f", "rec", "rel")
def compaction_trigger(log):
    rows = ordered.running(frames(log).withColumn("root", F.lit(0)), ["root"], "manifest_seq", {"total": "frame_bytes"})
    size = F.col("total") + C.LOG_HEADER
    return rows.select(F.col("manifest_seq").alias("group_idx"), size.alias("manifest_bytes"), (size >= 65_536).alias("triggers"))
