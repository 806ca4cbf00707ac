"""Registered queries against their SQL on the smallest tables.

CATALOG_ALL=1 runs every query; by default a choice that touches each module.
"""

import math
import os

import duckdb
import pandas as pd
import pytest

from ordermetrics import catalog

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
CHOICE = [
    "m01_noncohort_summary", "m02_cohort_summary", "m03_payment_extract", "m04_mtd_samples", "m05_pipeline_cutoffs", "m07_correction_rate",
    "m08_mean_days", "m12_turnaround_percent", "m15_adjudication_totals", "m17_latest_denial", "m19_appeals_by_type", "m22_gap_to_goal",
    "m23_orders_by_source_pivot", "m25_received_within", "j17_program_rows", "m30_kit_shipments", "m31_cumulative_by_source", "m32_enriched_orders",
    "m33_last24h_hourly", "m01_by_product", "m01_presented", "m01_presented_wide", "m32_label_counts", "m42_arm_comparison", "r02_transposed", "r03_merged_spend",
    "j08_aligned_series", "a14_source_domain", "a08_described", "w4_numbered", "c10_utm_from_pages", "s01_csv_text", "s07_json_import", "s09_newest_snapshot", "s11_archive",
    "s13_daily_upsert_by_type", "s14_freshness", "st02_hourly_counts", "st02_hourly_entities", "st04_upsert", "m35_cac", "m37_waterfall", "m39_mtd_cards", "m43_return_curve", "m45_payer_benchmark", "s06_incremental_pull", "st03_rolling_24h", "t12_day_spans",
    "m06_monthly_counts", "c11_utm_rules", "c11_wildcard_rules", "a01_period_sketches", "o2_first_checkouts", "l01_month_folders", "l02_bucketed_join",
]
NAMES = sorted(catalog.oracle_sql()) if os.environ.get("CATALOG_ALL") else CHOICE


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(FOLDER):
        pytest.skip(f"no tables in {FOLDER}")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def cell(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return round(float(value), 6) if isinstance(value, (int, float)) or hasattr(value, "dtype") else value


def table(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted([tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None)], key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got = table(catalog.queries()[name](spark, FOLDER).toPandas())
    want = table(duck.execute(catalog.oracle_sql()[name]).df())
    assert got == want


def test_layouts_save_reading_and_moving(spark):
    months = catalog.queries()["l01_month_folders"](spark, FOLDER)
    assert "PartitionFilters: [isnotnull(event_month" in months._jdf.queryExecution().executedPlan().toString()
    joined = catalog.queries()["l02_bucketed_join"](spark, FOLDER)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan  # only the counts per state move


def test_monthly_counts_read_each_table_once(spark):
    plan = catalog.queries()["m06_monthly_counts"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    # orders, order types, and samples, results and releases, which are views of one table here
    assert plan.count("FileScan parquet") == 5


def test_payer_benchmark_without_a_broadcast_card(spark, duck):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        got = table(catalog.queries()["m45_payer_benchmark"](spark, FOLDER).toPandas())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert got == table(duck.execute(catalog.oracle_sql()["m45_payer_benchmark"]).df())
