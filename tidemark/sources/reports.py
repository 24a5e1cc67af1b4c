"""Sources and sinks of reports: time series as JSON lines, benchmark reports, metric lines, Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.metrics import escape_label

SERIES = "metric map<string,string>, `values` array<double>, timestamps array<bigint>"
LATENCY = "struct<p50:bigint,p95:bigint,p99:bigint,max:bigint>"
RESULT = f"struct<engine:string,workload:string,samples:bigint,records_per_sample:bigint,operations_per_sample:bigint,metadata_bytes:bigint,payload_bytes:bigint,concurrency:bigint,logical_streams:bigint,batch_records:bigint,total_elapsed_ns:bigint,records_per_second:double,operations_per_second:double,logical_mib_per_second:double,latency_ns:{LATENCY},median_storage_bytes:bigint>"
#: The version of benchmark reports, and what identifies a result.
VERSION = 3
IDENTITY = ["engine", "workload", "records_per_sample", "metadata_bytes", "payload_bytes", "concurrency", "logical_streams", "batch_records"]


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """One series a line: labels, values and their times."""
    return spark.read.schema(SERIES).json(path)


def samples(series: DataFrame, name: str, **labels: str) -> DataFrame:
    """(metric, value, timestamp) of the series with this name and all these labels; non-finite values are dropped."""
    wanted = {"__name__": name, **labels}
    chosen = series
    for key, value in wanted.items():
        chosen = chosen.where(F.try_element_at("metric", F.lit(key)).eqNullSafe(F.lit(value)))
    flat = chosen.select("metric", F.explode(F.arrays_zip("values", "timestamps")).alias("p"))
    return flat.select("metric", F.col("p.values").alias("value"), F.col("p.timestamps").alias("timestamp")).where(~F.isnan("value") & (F.abs("value") < float("inf")))


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """One row per result of benchmark reports, with ``identity``; a report of another version is an error."""
    reports = spark.read.schema(f"schema_version bigint, results array<{RESULT}>").option("multiLine", "true").json(path)
    wrong = F.concat(F.lit("unsupported report version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("none")))
    gate = F.when(F.col("schema_version").eqNullSafe(F.lit(VERSION)), F.col("results")).otherwise(F.raise_error(wrong).cast(f"array<{RESULT}>"))
    rows = reports.select(F.explode(gate).alias("r")).select("r.*")
    return rows.withColumn("identity", F.concat_ws("|", *(F.col(c).cast("string") for c in IDENTITY)))


def write_benchmark(results: DataFrame, path: str) -> None:
    """One report of this version with all ``results`` (the columns of RESULT that are there), a JSON document.

    A report is a few cases, gathered into one row; ``read_benchmark`` reads it back.
    """
    row = results.agg(F.collect_list(F.struct(*(F.col(c) for c in results.columns if c != "identity"))).alias("results"))
    row.select(F.lit(VERSION).cast("long").alias("schema_version"), "results").coalesce(1).write.json(path)


def prometheus(rows: DataFrame, name: str, labels: list[str], value: str, timestamp: str) -> DataFrame:
    """``name{label="value",...} value timestamp`` lines, labels escaped; write them with ``write.text``."""
    pairs = [F.concat(F.lit(f'{c}="'), escape_label(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit('"')) for c in labels]
    return rows.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col(value).cast("string"), F.lit(" "), F.col(timestamp).cast("string")).alias("value"))


def markdown_report(title: str, tables: dict[str, DataFrame], limit: int = 1_000) -> str:
    """A Markdown report: a heading, and under one of its own each table (capacity, throughput, latency, commits)."""
    parts = [f"# {title}", *(f"## {name}\n\n{markdown(rows, limit)}" for name, rows in tables.items())]
    return "\n\n".join(parts) + "\n"


def markdown(rows: DataFrame, limit: int = 1_000) -> str:
    """A Markdown table of a report, which is a few rows; more than ``limit`` are an error, not cut."""
    got = rows.limit(limit + 1).collect()
    if len(got) > limit:
        raise ValueError(f"a report of more than {limit} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = [rows.columns, ["---"] * len(rows.columns), *([cell(v) for v in r] for r in got)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)
