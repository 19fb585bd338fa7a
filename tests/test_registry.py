"""Registered queries against their SQL twins, run by DuckDB on the same files."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tradeaxis.plans.registry import callables, oracles
from tradeaxis.views import VIEW_SQL, Views

ROOT = Path(__file__).resolve().parents[1]
SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="driver tables are not here")

# Rows of each domain view at sf0.01.
VIEW_ROWS = {
    "session": 1733,
    "asset": 100,
    "bar": 53307,
    "aggregate": 53307,
    "global_series": 6797,
    "event": 10000,
    "position": 2686,
    "ingest_run": 10000,
    "ranking": 53307,
    "account_position": 6000,
    "account": 1500,
}

# One query of each family; PARITY=all runs the whole catalogue.
SAMPLE = [
    "a01_block_unpack",
    "b06_date_in_text",
    "c12_total_reconciliation",
    "d05_work_list",
    "e09_coverage_report",
    "f07_upsert_bars",
    "f13_upsert_assets",
    "g14_latest_ready",
    "h05_incomplete_by_session",
    "h06_readiness",
    "j08_content_digest",
    "k06_run_states",
    "l14_weight_after",
    "m06_late_arrivals",
    "m07_progress_stream",
]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return connection


def _names():
    return sorted(callables()) if os.environ.get("PARITY") == "all" else SAMPLE


@pytest.mark.parametrize("name", _names())
def test_query_equals_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    found = duck.execute(entry.oracle_sql()[name])
    order = [x[0] for x in found.description]
    assert sorted(order) == columns
    theirs = [tuple(row[order.index(c)] for c in columns) for row in found.fetchall()]
    ours = [tuple(row[c] for c in columns) for row in df.collect()]

    def key(row):
        return tuple((x is None, x or "") for x in row)

    assert sorted(ours, key=key) == sorted(theirs, key=key)


@pytest.mark.parametrize("name", ["k04_result_store", "m01_stored_bars", "m01_stored_aggregates", "m04_stored_bars", "k07_run_detail_computed"])
def test_stored_tables_equal_their_sql(spark, duck, name):
    test_query_equals_its_sql(spark, duck, name)


def test_only_the_run_of_other_content_is_stale(spark):
    from pyspark.sql import functions as F

    from tradeaxis.operators import dataset as ds
    from tradeaxis.plans import q_dataset, q_ranking

    v = Views(spark, SMALL)
    last = v.session.agg(F.max("session_date")).first()[0]
    parts, windows = ds.build_parts(v.tables, v.session, v.ingest_run, last, q_dataset.SETTINGS)
    now = ds.digest(ds.series_hashes(parts), ds.header(last, windows)).first().digest
    for digest, stale in ((now, False), ("0" * 64, True)):
        run = spark.createDataFrame([(1, last, f"sha256:{digest}")], "id INT, asof_date DATE, dataset_digest STRING")
        assert q_ranking.stale_by_content(v, run).first().stale is stale


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() == 5


def test_view_rows(spark):
    views = Views(spark, MIDDLE)
    assert {name: getattr(views, name).count() for name in VIEW_ROWS} == VIEW_ROWS


def test_names_are_shared_and_ordered_by_inventory_id():
    queries, sql = callables(), oracles()
    assert set(sql) == set(queries)
    assert set(queries) <= set(entry.queries()) and set(sql) <= set(entry.oracle_sql())
    assert all(re.fullmatch(r"[a-m]\d\d_[a-z0-9_]+", name) for name in queries)


def test_every_inventory_id_has_a_query_or_is_named_as_covered():
    have = {name[:3] for name in callables()}
    sizes = dict(a=20, b=28, c=14, d=14, e=22, f=21, g=15, h=13, j=11, k=7, l=16, m=7)
    wanted = {f"{k}{i:02d}" for k, n in sizes.items() for i in range(1, n + 1)}
    assert wanted - have == set()


def test_catalogue_loads_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)


def test_every_view_is_used():
    text = " ".join(entry.oracle_sql().values())
    assert all(re.search(rf"\b{name} as \(", text) for name in VIEW_SQL)
