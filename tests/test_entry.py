import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rounded(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_is_its_sql(spark, sf, oracle, name):
    got = entry.queries()[name](spark, sf)
    want = oracle.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert sorted((tuple(rounded(r[c]) for c in columns) for r in got.collect()), key=repr) == sorted((tuple(rounded(r[c]) for c in columns) for r in rows), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_no_other_module_imports_the_optional_subpackage():
    code = "import sys; sys.modules['tidemark.llm'] = None\nimport tidemark.api, tidemark.plans.catalog, tidemark.sources.format_v1, tidemark.streaming.lifecycle"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


@pytest.mark.parametrize("name", ["duration_deltas", "interval_histogram", "interval_quantiles", "phase_machine"])
def test_the_last_half_second_counts_in_the_next_interval(spark, tmp_path, name):
    times = ["2024-01-01 10:00:00", "2024-01-01 22:59:59.5", "2024-01-01 23:59:59.499999", "2024-01-01 23:59:59.5", "2024-01-02 00:59:58.5", "2024-01-02 00:59:59.7", "2024-01-03 05:59:59.9", "1969-12-31 23:00:00"]
    con = duckdb.connect()
    rows = ", ".join(f"({i}, TIMESTAMP '{t}', {i}, 'view', {10.25 * i + 30}, 'x')" for i, t in enumerate(times))
    con.sql(f"CREATE TABLE events AS SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type, value::DOUBLE AS value, props FROM (VALUES {rows}) t(event_id, ts, user_id, event_type, value, props)")
    con.sql(f"COPY events TO '{tmp_path}/events.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).select(want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
