import json
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from ordermetrics.functions.vocabulary import Vocabulary
from ordermetrics.plans import billing, checkout, experiments, lab_ops, marketing, ops_summary
from ordermetrics.plans.common import ProductCodes

NAMES = Vocabulary("acme", "starter", ("BrandA", "BrandB", "Starter"), ("BA", "BB"))


@pytest.fixture()
def workflow(frame):
    """Two orders of January and one of February, with several shipments, bills and payments."""
    return {
        "orders": frame(
            [("o1", "2024-01-05 10:00:00", "gut", "APPROVED", "s1", "d1"), ("o2", "2024-01-31 23:59:59", "jane", "RELEASED", None, None),
             ("o3", "2024-02-01 00:00:00", "gut", "RELEASED", "s3", "d3")],
            "order_id string, order_created_at timestamp_ntz, code string, state string, sample_id string, delivery_id string"),
        "kits": frame(
            [("k2", "d1", "NORMAL", "2024-01-09"), ("k1", "d1", "NORMAL", "2024-01-07"), ("k3", "d9", "NORMAL", "2024-02-02")],
            "shipment_id string, order_item_id string, type string, ship_date timestamp_ntz"),
        "samples": frame([("s1", "2024-01-20", 16), ("s3", "2024-02-20", 17)], "sample_id string, sample_received timestamp_ntz, product int"),
        "reports": frame([("o1", "r2", "2024-02-09"), ("o1", "r1", "2024-02-01")], "order_id string, status_id string, report_created_at timestamp_ntz"),
        "bills": frame([("b1", "o1", "2024-02-10", "gut"), ("b2", "o1", "2024-02-11", "gut")], "bill_id string, order_id string, billing_date timestamp_ntz, product string"),
        "payments": frame(
            [("c1", "o1", 10.0, "2024-03-01", "gut"), ("c2", "o1", 5.25, "2024-03-02", "gut"), ("c3", "o1", None, "2024-03-03", "gut")],
            "claim_id string, order_id string, payment double, issue_date timestamp_ntz, product string"),
    }


MEASURES = ["period", "orders_generated", "kits_shipped", "samples_accessioned", "reports_released", "claims_billed", "claims_with_eob", "aggregate_payment", "average_payment"]


def test_noncohort_counts_each_event_in_its_own_month(workflow, rows):
    got = ops_summary.noncohort_summary(**workflow, start="2024-01-01", end="2024-03-31")
    assert rows(got, *MEASURES) == [
        ("1/2024", 2, 2, 1, 0, 0, 0, 0.0, 0.0), ("2/2024", 1, 1, 1, 1, 2, 0, 0.0, 0.0), ("3/2024", 0, 0, 0, 0, 0, 3, 15.25, 7.62),
    ]
    assert rows(got, "orders_approved") == [(0,), (0,), (1,)]


def test_cohort_multiplies_payments_by_bills_like_the_detail_rows(workflow, rows):
    no_samples = {k: v for k, v in workflow.items() if k != "samples"}
    got = ops_summary.cohort_summary(**no_samples, start="2024-01-01", end="2024-02-29")
    assert rows(got, *MEASURES) == [("1/2024", 2, 1, 1, 1, 1, 3, 30.5, 7.62), ("2/2024", 1, 0, 1, 0, 0, 0, 0.0, 0.0)]
    detail = ops_summary.cohort_orders(
        workflow["orders"], workflow["kits"], workflow["samples"], workflow["reports"], workflow["bills"],
        workflow["payments"].withColumn("version", F.lit(1)),
    )
    january = detail.where("order_created_at < '2024-02-01'").agg(F.sum("payment"), F.count("payment"), F.count_distinct("claim_id")).first()
    assert tuple(january) == (30.5, 4, 3)
    assert {r["shipment_id"] for r in detail.where("order_id = 'o1'").collect()} == {"k1"}
    once = ops_summary.cohort_summary(**no_samples, start="2024-01-01", end="2024-02-29", dedupe_payments=True)
    assert rows(once, "aggregate_payment") == [(0.0,), (15.25,)]


def test_product_codes_filter_each_table_by_its_own_column(workflow, rows):
    codes = ProductCodes({"gut": {"orders": ("code", "gut"), "kits": ("type", "NORMAL"), "samples": ("product", 16), "reports": ("order_id", "o1"), "bills": ("product", "gut"), "payments": ("product", "gut")}})
    got = ops_summary.noncohort_summary(**workflow, start="2024-01-01", end="2024-03-31", product="gut", codes=codes)
    assert rows(got, "period", "orders_generated", "samples_accessioned") == [("1/2024", 1, 1), ("2/2024", 1, 0), ("3/2024", 0, 0)]


def test_presented_tables(workflow):
    summary = ops_summary.noncohort_summary(**workflow, start="2024-01-01", end="2024-03-31")
    table = ops_summary.presented(summary)
    assert table.columns[-1] == "Date" or "Date" in table.columns
    assert [r["Date"] for r in table.collect()] == ["3/2024", "2/2024", "1/2024"]
    assert table.first()["Aggregate Payment*"] == "15.25"
    wide = ops_summary.presented(summary, "Horizontal", ["1/2024", "3/2024"])
    assert {r["Date"]: r["3/2024"] for r in wide.collect()}["Claims w/ EOB (Payments)*"] == "3.0"


def test_month_to_date_fills_days_and_projects(frame):
    df = frame([("2024-02-01", 1), ("2024-02-02", 2), ("2024-02-02", 3), ("2024-02-03", 3), ("2024-01-31", 9), ("2024-02-09", 8)], "t timestamp_ntz, id int")
    got = {r["day"]: r for r in lab_ops.month_to_date(df, "t", "id", "2024-02-04").collect()}
    assert len(got) == 31
    assert [got[d]["current_month_daily"] for d in range(1, 6)] == [1, 2, 1, 0, None]
    assert got[4]["current_month_count"] == 4 and got[5]["current_month_count"] is None
    assert got[31]["previous_month_count"] == 1 and got[30]["previous_month_daily"] == 0
    assert got[5]["predicted_count"] == 6.0 and got[4]["predicted_count"] is None and got[30]["predicted_count"] is None
    first = {r["day"]: r for r in lab_ops.month_to_date(df, "t", "id", "2024-02-01").collect()}
    assert first[2]["predicted_count"] is None  # one point makes no line
    assert lab_ops.month_to_date(df.where("false"), "t", "id", "2024-02-04").agg(F.sum("current_month_daily")).first()[0] == 0


def test_digest_reads_the_previous_month_on_the_first(frame):
    df = frame([("2024-02-29", 1), ("2024-02-28", 2)], "t timestamp_ntz, id int")
    mtd = lab_ops.month_to_date(df, "t", "id", "2024-03-01")
    assert tuple(lab_ops.daily_digest(mtd, "2024-03-01").first()) == (1, 2)


def test_pipeline_stages_never_grow(frame):
    orders = frame([(i, f"2024-01-{1 + i % 28:02d}", i, i) for i in range(60)], "order_id int, order_created_at timestamp_ntz, delivery_id int, sample_id int")
    kits = frame([(i, f"2024-02-{1 + (i * 7) % 28:02d}") for i in range(50)] + [(1, "2024-01-03"), (1, "2024-01-04")], "delivery_id int, ship_date timestamp_ntz")
    samples = frame([(i, f"2024-03-{1 + (i * 5) % 28:02d}") for i in range(45)], "sample_id int, sample_received timestamp_ntz")
    reports = frame([(i, f"2024-04-{1 + (i * 3) % 28:02d}", "RELEASED", "RELEASED") for i in range(40)], "sample_id int, report_created_at timestamp_ntz, report_status string, state string")
    got = lab_ops.pipeline_cutoffs(orders, kits, samples, reports, "2024-01-15", "2024-06-30", 40, 45, 40).first()
    assert got["orders"] == 60 and 60 >= got["kits_shipped"] >= got["samples_accessioned"] >= got["reports_released"] > 0
    # brute force over all combinations of rows
    chain = orders.join(kits, "delivery_id", "left").join(samples, "sample_id", "left").join(reports, "sample_id", "left")
    ship = "ship_date - order_created_at <= INTERVAL 40 DAYS"
    recv = f"{ship} AND sample_received - ship_date <= INTERVAL 45 DAYS"
    rep = f"{recv} AND report_created_at - sample_received <= INTERVAL 40 DAYS"
    brute = [chain.where(c).select("order_id").distinct().count() for c in (ship, recv, rep)]
    assert brute == [got["kits_shipped"], got["samples_accessioned"], got["reports_released"]]


def test_turnaround_percentages_sum_to_100(frame):
    df = frame([("a", i, "2024-05-03", f"2024-05-{4 + i % 25:02d}") for i in range(40)], "product string, sample_id int, received timestamp_ntz, released timestamp_ntz")
    row = lab_ops.turnaround_table(df, "product", "received", "released", "2024-06-10", "percentages").first()
    assert sum(row[c] for c in lab_ops.BAND_COLUMNS) == pytest.approx(100) and row["total_accessioned"] == 40


def test_correction_rate_is_null_outside_the_numerators_months(frame, rows):
    reports = frame([(i, f"2024-0{i}-10") for i in range(1, 6)], "order_id int, report_created_at timestamp_ntz")
    results = frame([(i, "corrected" if i in (2, 4) else "final") for i in range(1, 6)], "order_id int, result_status string")
    got = rows(lab_ops.correction_rate(reports, results))
    assert [r[1] for r in got] == [None, 1.0, 0.0, 1.0, None] and got[1][0] == dt(2024, 2, 29)


def test_blocked_reports_keep_unknown_issues(frame, rows):
    orders = frame([("o1", "APPROVED", "s1", "d1"), ("o2", "RELEASED", "s2", "d2"), ("o3", None, "s3", None)], "order_id string, state string, sample_id string, delivery_id string")
    kits = frame([("d1", "k2", "2024-01-02"), ("d1", "k1", "2024-01-01")], "delivery_id string, shipment_id string, ship_date timestamp_ntz")
    blocked = frame([("s1", 16, "r1", "i1"), ("s1", 16, "r2", "i2"), ("s2", 16, "r3", "i1"), ("s3", 17, "r4", "i9"), ("sX", 17, "r5", "i1")], "sample_id string, kit_type int, ssr string, issue_id string")
    issues = frame([("i1", "B", "broken"), ("i2", "N", "note")], "issue_id string, issue_type string, issue_type_description string")
    got = lab_ops.blocked_reports(orders, kits, blocked, issues, vocab=NAMES)
    assert rows(got, "ssr", "shipment_id", "issue_type") == [("r1", "k1", "B"), ("r2", "k1", "N"), ("r4", None, None)]
    assert rows(lab_ops.outstanding_counts(got, {"first": 16, "second": 17})) == [(1, 1)]
    assert rows(lab_ops.blocked_by_issue(got)) == [("broken", 1)]


def test_goal_messages(frame):
    daily = frame([("2024-01-01", 3), ("2024-01-02", 4)], "billing_date timestamp_ntz, counts bigint")
    assert tuple(billing.gap_to_goal(daily, 10).first()) == (7, 3, "Gap To Goal: 3 Claims")
    assert billing.gap_to_goal(daily, 7).first()["message"] == "Gap To Goal: Goal Met!"
    assert billing.gap_to_goal(daily, None).first()["message"] == "Gap To Goal: Please Enter Goal"


def test_latest_benefits_take_one_row_of_equal_rows(frame, rows):
    linked = frame([("z1", "c1", "o1"), ("z2", "c1", "o1")], "zc_id string, claim_id string, order_id string")
    eobs = frame([("z1", "2024-01-02", "2024-01-03", 5.0), ("z1", "2024-01-02", "2024-01-03", 5.0), ("z2", "2024-01-01", "2024-01-03", 7.0), ("z2", "2024-02-01", "2024-05-03", 9.0)],
                 "zc_id string, production_date timestamp_ntz, issue_date timestamp_ntz, payment double")
    latest = billing.latest_benefits(linked, eobs, "2024-01-01", "2024-01-31", ["zc_id"])
    assert rows(latest, "claim_id", "payment") == [("c1", 5.0)]


def test_pivot_and_display_names(frame):
    carts = frame([("2024-01-02 01:00:00", "A_B", 1), ("2024-01-02 02:00:00", "A_B", 2), ("2024-01-03", "C", 2)], "cart_created_date timestamp_ntz, source string, order_id_modified int")
    wide = checkout.orders_by_wide(checkout.orders_by(carts, "Daily", "source"), "source", ["A_B", "C"], names={"A_B": "A B"})
    assert [tuple(r) for r in wide.orderBy("cart_created_date").collect()] == [(dt(2024, 1, 2), 2, None), (dt(2024, 1, 3), None, 1)]
    assert wide.columns == ["cart_created_date", "A B", "C"]


def test_kit_numbers_ignore_single_kits_of_equal_id(frame, rows):
    orders = frame([(1, None, "2024-01-01", 1), (2, 1, "2024-01-02", 2), (3, 1, "2024-01-03", 3)], "order_id int, prescription_id int, created_at timestamp_ntz, delivery_id int").withColumn("sample_id", F.col("order_id")).withColumn("order_type_id", F.col("order_id"))
    types = frame([(2, "First")], "order_type_id int, clinical_type_name string")
    carts = frame([(10, 1, "2024-01-01"), (11, 99, "2024-01-01")], "cart_id int, order_id_modified int, cart_created_date timestamp_ntz").withColumns({"product": F.lit("p"), "program": F.lit("pap"), "source": F.lit("s")})
    ships = frame([(2, "2024-01-09"), (3, "2024-01-08")], "delivery_id int, ship_date timestamp_ntz").withColumns({"type": F.lit("NORMAL"), "delivered_date": F.col("ship_date")})
    samples = frame([(2, "2024-01-12", "2024-01-10"), (3, None, "2024-01-10")], "sample_id int, received timestamp_ntz, arrived timestamp_ntz")
    meta = frame([(2, "Upgraded from BAv1")], "order_id int, value string")
    got = checkout.program_orders(carts, orders, types, meta, ships, samples, vocab=NAMES)
    assert rows(got, "cart_id", "order_id", "kit_number", "mk_upg_stat", "kit_received_time_in_days", "clinical_type_name") == [
        (10, 1, 1, "Single Kit", None, None), (10, 2, 2, "Upgrade", 3, "First"), (10, 3, 1, "Multi Kit", 2, None), (11, None, None, None, None, None)]


def test_step_conversion(frame):
    got = checkout.step_totals(
        frame([(1,), (2,)], "cart_id int"), frame([(1,)], "order_id int"), frame([(1, "NORMAL"), (1, "RETURN")], "order_id int, type string"))
    assert [tuple(r) for r in got.orderBy("step").collect()] == [("1. Carts", 2, None), ("2. Orders", 1, 0.5), ("3. Kits Sent", 1, 1.0), ("4. Kits Returned", 1, 1.0)]


def test_recent_hours_and_enriched_share_labels(frame, rows):
    vocab = Vocabulary("acme", "starter", ("BrandA", "BrandB", "Starter"), ("BA", "BB"))
    orders = frame([(1, "2024-01-01 10:30:00", "APPROVED", 5, "d"), (2, "2023-12-31 09:00:00", "APPROVED", None, None), (3, "2024-01-01 11:00:00", "REJECTED_BY_ACME", None, None)],
                   "order_id int, created_at timestamp_ntz, state string, prescription_id int, delivery_id string").withColumns(
        {"order_flow": F.lit(None).cast("string"), "billed": F.lit(None).cast("boolean"), "order_type_id": F.lit(1)})
    meta = frame([(1, "Upgraded from BAv1"), (1, "VIP")], "order_id int, value string")
    tracking = frame([("1", None, None)], "order_id string, utm_source string, utm_medium string")
    types = frame([(1, "Gut")], "order_type_id int, clinical_type_name string")
    got = marketing.recent_hours(orders, meta, tracking, types, "2024-01-01 12:00:00", vocab=vocab)
    assert rows(got, "created_at_hour", "mk_upg_stat", "utm_fillna", "count_order_id", "count_order_kit1only") == [
        (dt(2024, 1, 1, 10), "Upgrade", "Upgrades with no UTM", 1, 1)]
    for text in (False, True):
        year = marketing.enriched_orders(orders, meta, tracking, types, "2024-06-01", vocab=vocab, with_text=text)
        assert rows(year, "order_id", "upg_details", "order_funnel") == [(1, "V1 to V2 Upgrade", "4. Orders that shipped Kits"), (3, "Nonupgrade", "Misc.")]


def test_iso_weeks_of_different_years_stay_apart(frame, rows):
    df = frame([("2024-12-30", 1), ("2024-01-02", 2)], "created_at timestamp_ntz, order_id_modified int").withColumn("label", F.lit("x"))
    assert rows(marketing.weekly_by(df, "label"), "iso_year", "week_number", "orders") == [(2024, 1, 1), (2025, 1, 1)]


def test_merged_spend_prefers_the_first_source(frame, rows):
    a, b = frame([(1, 5.0), (2, None)], "w int, spend double"), frame([(1, 7.0), (2, 8.0), (3, 9.0)], "w int, spend double")
    assert rows(marketing.merged_spend(a, b, ["w"])) == [(1, 5.0), (2, 8.0), (3, 9.0)]


def test_return_curve_ends_at_the_returned_share(frame):
    data = [("x:0", "RELEASED", 3), ("x:0", "RECEIVED", 3), ("x:0", "APPROVED", 1), ("x:0", "RECOLLECTED", 9), ("x:1", "APPROVED", None)]
    got = experiments.return_curve(frame(data, "checkout_version string, order_state string, time_to_sample_return int"))
    assert [tuple(r) for r in got.orderBy("time_to_sample_return").collect()] == [("x:0", 3, 50.0), ("x:0", 9, 75.0)]


def test_experiment_lookup(spark, frame):
    arms = experiments.experiment_map(spark, [{"exp_name": "E", "product": "P", "exp_id": "id1"}])
    table = frame([("id1:0", 0.5), ("id1:1", 0.75)], "checkout_version string, ratio double")
    assert experiments.measure_of_arm(table, arms, "ratio", "E", "P", "experiment").first()["ratio"] == 0.75


def test_registered_names_and_checks():
    from ordermetrics import catalog

    queries, checks = catalog.queries(), catalog.oracle_sql()
    assert set(checks) <= set(queries) and len(queries) > 110
    assert set(queries) - set(checks) == set()
    assert json.dumps(checks)
