import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import capacity
from tidemark.sources import reports
from tidemark.streaming.health import HealthWatch


def test_series(spark, tmp_path):
    rows = [{"metric": {"__name__": "a", "op": "x"}, "values": [1.0, -2.5], "timestamps": [10, 20]}, {"metric": {"__name__": "a"}, "values": [7.0], "timestamps": [5]}, {"metric": {"__name__": "b", "op": "x"}, "values": [], "timestamps": []}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, rows)))
    series = reports.read_series(spark, str(tmp_path / "s.jsonl"))
    assert [(r.value, r.timestamp) for r in reports.samples(series, "a", op="x").collect()] == [(1.0, 10), (-2.5, 20)]
    nan = series.withColumn("values", F.array(F.lit(float("nan")), F.lit(float("inf"))))
    assert reports.samples(nan, "a").count() == 0 and reports.samples(series, "a", gone="x").count() == 0


def test_benchmark_reports(spark, tmp_path):
    result = {"engine": "e", "workload": "w", "records_per_sample": 4, "metadata_bytes": 1, "payload_bytes": 2, "concurrency": 1, "logical_streams": 3, "batch_records": 5, "records_per_second": 10.5, "latency_ns": {"p99": 8}}
    (tmp_path / "ok.json").write_text(json.dumps({"schema_version": 3, "results": [result]}, indent=1))
    (tmp_path / "old.json").write_text(json.dumps({"schema_version": 2, "results": [result]}))
    row = reports.read_benchmark(spark, str(tmp_path / "ok.json")).first()
    assert row.identity == "e|w|4|1|2|1|3|5" and row.latency_ns.p99 == 8
    with pytest.raises(Exception, match="unsupported report version 2"):
        reports.read_benchmark(spark, str(tmp_path / "old.json")).collect()
    reports.write_benchmark(reports.read_benchmark(spark, str(tmp_path / "ok.json")), str(tmp_path / "again"))
    assert reports.read_benchmark(spark, str(tmp_path / "again")).first() == row


def test_lines_and_tables(spark):
    rows = spark.createDataFrame([('q"\\\n', None, 2, 9)], "a string, b string, v long, t long")
    assert reports.prometheus(rows, "m", ["a", "b"], "v", "t").first().value == 'm{a="q\\"\\\\\\n",b=""} 2 9'
    assert reports.markdown(rows.select("v", "b")) == "| v | b |\n| --- | --- |\n| 2 |  |"
    assert reports.markdown_report("Run", {"Capacity": rows.select("v")}) == "# Run\n\n## Capacity\n\n| v |\n| --- |\n| 2 |\n"
    with pytest.raises(ValueError):
        reports.markdown(spark.range(5), 4)


def test_predicates(spark):
    val = lambda c: spark.range(1).select(c).first()[0]
    age = lambda n, c, m: val(capacity.expired(F.lit(n), F.lit(c), F.lit(m)))
    assert age(30, 10, 20) and not age(29, 10, 20) and not age(5, 10, 1)
    policy = lambda log, w, t: val(capacity.compacts(F.lit(log), F.lit(w), F.lit(t).cast("long")))
    assert not policy((8 << 20) - 1, 0, None) and policy(8 << 20, 0, None) and policy(0, 201, 200) and not policy(0, 200, 200)


def test_health(spark, tmp_path):
    watch = HealthWatch()
    spark.streams.addListener(watch)
    try:
        spark.range(3).write.parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))

        def run(f, name):
            return source.writeStream.foreachBatch(f).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()

        run(lambda df, n: df.count(), "a").awaitTermination()
        health = watch.current()
        while health.lifecycle != "closed":
            now = watch.changed(health.generation, 30)
            assert now.generation > health.generation
            health = now

        def fail(df, n):
            raise ValueError("broken sink")

        with pytest.raises(Exception, match="broken sink"):
            run(fail, "b").awaitTermination()
        while health.lifecycle != "poisoned":
            now = watch.changed(health.generation, 30)
            assert now.generation > health.generation
            health = now
        assert "broken sink" in health.failure
    finally:
        spark.streams.removeListener(watch)
