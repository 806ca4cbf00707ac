"""Stand-alone checks of building blocks whose edge cases matter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermetrics.catalog.checks import with_views
from ordermetrics.catalog.views import TEST_NAMES, Tables
from ordermetrics.functions import classify as C
from ordermetrics.functions import predicates as P
from ordermetrics.functions import scalars as S
from ordermetrics.functions.timeframe import days_calendar, days_floor
from ordermetrics.operators import joins, rank, sketches
from ordermetrics.operators.calendar import GRAINS, period_start
from ordermetrics.operators.distinct import distinct_count
from ordermetrics.operators.metadata import array_values, joined_values, phrase_flags
from ordermetrics.operators.prefix import numbered
from ordermetrics.operators.trend import running_share, running_total
from ordermetrics.session import scratch_folder

A, B = "1997-03-01", "1997-09-30"


def p_range_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Rows each kind of range keeps of claims with times of day."""
    claims = Tables(spark, folder).claims()
    ts = "billing_date"
    kinds = {
        "whole_days": P.in_days(ts, A, B), "left_open": P.after_until(ts, A, B), "midnights": P.between_midnights(ts, A, B),
        "trailing": P.within_last(ts, "2001-07-15", "30 DAYS"), "year": P.in_year_of(ts, "1999-06-30"),
        "week_since": P.since_week_of(ts, "2001-07-15", 31),
    }
    return claims.agg(*[F.count_if(cond).alias(name) for name, cond in kinds.items()])


def p_null_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Negated lists with and without nulls, null-or-false, prefix and pattern filters."""
    orders = Tables(spark, folder).orders().join(Tables(spark, folder).claims().select("order_id", "resubmitted"), "order_id")
    flows = ["trf_transcribed", "free_of_approval"]
    kinds = {
        "kept_nulls": P.not_in_keep_null("order_flow", flows), "dropped_nulls": P.not_in_drop_null("order_flow", flows),
        "not_resubmitted": P.null_or_false("resubmitted"), "cash": P.mentions("order_flow", "CASH"),
        "prefix": P.has_prefix("order_flow", "patient"), "has_sample": P.reached("sample_id"),
    }
    return orders.agg(*[F.count_if(cond).alias(name) for name, cond in kinds.items()])


def p_selectors(spark: SparkSession, folder: str) -> DataFrame:
    orders = P.filter_choices(Tables(spark, folder).orders(), {"source": "3-MEDIUM", "state": "all"})
    return orders.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def p_group_size(spark: SparkSession, folder: str) -> DataFrame:
    groups = Tables(spark, folder).orders().groupBy("owner_id").agg(F.count(F.lit(1)).alias("n"))
    return P.min_group_size(groups, "n", 15)


def t12_day_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Elapsed whole days against calendar days, with negative spans."""
    t = Tables(spark, folder)
    joined = t.claims().select("order_id", "billing_date", "creation_date").join(t.results().select("order_id", "result_created_at"), "order_id")
    return joined.groupBy(
        days_floor("result_created_at", "billing_date").alias("elapsed"), days_calendar("result_created_at", "billing_date").alias("calendar")
    ).agg(F.count(F.lit(1)).alias("n"))


def w1_latest(spark: SparkSession, folder: str) -> DataFrame:
    rows = rank.latest_per_key(Tables(spark, folder).eobs(), ["zc_id"], ["production_date", "status_code_id"], ["part_id", "payer_id"])
    return rows.select("zc_id", "production_date", "status_code_id", "part_id", "payer_id")


def w2_first_child(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    child = t.shipments().select("delivery_id", "shipment_id", "ship_date", "part_id")
    rows = joins.with_first_child(t.orders().select("order_id", "delivery_id"), child, {"delivery_id": "delivery_id"}, ["ship_date"], ["shipment_id", "part_id"])
    return rows.select("order_id", "ship_date", F.col("shipment_id").cast("string").alias("shipment_id"))


def w4_numbered(spark: SparkSession, folder: str) -> DataFrame:
    """Kit numbers within each customer, exact however many orders one has."""
    orders = Tables(spark, folder).orders().select("owner_id", "order_id", "created_at")
    return numbered(orders, ["owner_id"], ["created_at", "order_id"], "kit_number")


def w5_running(spark: SparkSession, folder: str) -> DataFrame:
    daily = Tables(spark, folder).orders().groupBy("state", "created_at").agg(F.count(F.lit(1)).alias("n"))
    total = running_total(daily, "created_at", {"so_far": "n"}, ["state"])
    return running_share(total, "created_at", "n", F.lit(1000), "share", ["state"])


def o3_top_parts(spark: SparkSession, folder: str) -> DataFrame:
    return rank.top_groups(Tables(spark, folder).raw("lineitem"), "l_partkey", F.count(F.lit(1)), 25, "n")


def j01_join_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each join kind between orders and return shipments."""
    t = Tables(spark, folder)
    orders, ships = t.orders().select("order_id", "delivery_id"), t.shipments().where("type = 'RETURN'").select("delivery_id", "shipment_id")
    stacked = None
    for how in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        rows = joins.join_on(orders, ships, {"delivery_id": "delivery_id"}, how)
        part = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("delivery_id").alias("keys")).withColumn("kind", F.lit(how))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def a01_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return distinct_count(Tables(spark, folder).raw("lineitem"), ["l_returnflag", "l_linestatus"], "l_suppkey", "suppliers")


def a01_period_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Customers per priority for every grain from one stored table of daily sketches, built by two overlapping loads.

    Beside the exact count stands whether the estimate is within 3 % of it.
    """
    path, groups = scratch_folder(spark, "sketches"), ["o_orderpriority"]
    orders = Tables(spark, folder).raw("orders")
    for load in (orders.where("o_orderdate < TIMESTAMP_NTZ '1996-06-15 00:00:00'"), orders.where("o_orderdate >= TIMESTAMP_NTZ '1996-03-01 00:00:00'")):
        stored = sketches.merge_days(path, sketches.daily_sketches(load, "o_orderdate", groups, "o_custkey"), groups)
    about = sketches.period_distinct(stored, groups)
    exact = reduce(lambda a, b: a.unionByName(b), [
        orders.groupBy(F.lit(g).alias("grain"), period_start("o_orderdate", g).alias("period_start"), *groups).agg(F.count_distinct("o_custkey").alias("customers"))
        for g in GRAINS])
    near = F.abs(F.col("n") - F.col("customers")) <= 0.03 * F.col("customers")
    return exact.join(about, ["grain", "period_start", *groups], "left").select("grain", "period_start", *groups, "customers", F.coalesce(near, F.lit(False)).alias("within"))


def a09_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return rank.frequency(Tables(spark, folder).orders(), "order_flow")


def a10_joined_text(spark: SparkSession, folder: str) -> DataFrame:
    return joined_values(Tables(spark, folder).metadata(), "order_id", "value", "order_meta_values")


def a11_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Array sizes with the exact-label and the pattern flag."""
    arrays = array_values(Tables(spark, folder).metadata(), "order_id", "value", "items")
    return arrays.select(
        "order_id", F.size("items").alias("n"), C.upgrade_by_label("items", vocab=TEST_NAMES).alias("by_label"), C.upgrade_by_pattern("items", vocab=TEST_NAMES).alias("by_pattern")
    )


def c02_phrase_flags(spark: SparkSession, folder: str) -> DataFrame:
    return phrase_flags(Tables(spark, folder).metadata(), "order_id", "value", {"upgraded": ["upgraded from", "starter upgrade"], "vip": ["vip"]})


def f03_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Display texts of order totals per state."""
    orders = Tables(spark, folder).raw("orders")
    exact = orders.groupBy("o_orderstatus").agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("s"), F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("d")
    )
    return exact.select(
        "o_orderstatus", S.money("s").alias("money"), S.thousands("n").alias("grouped"), S.fixed("n", 3).alias("fixed"),
        S.spaced(F.concat("o_orderstatus", F.lit("_a_b"))).alias("spaced"), S.date_text("d").alias("day"),
        S.date_text("d", "month_day").alias("month_day"), S.date_text("d", "month_year").alias("month_year"), S.date_text("d", "stamp").alias("stamp"),
        S.count_present("o_orderstatus", "s", F.lit(None)).alias("present"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        p_range_filters, p_null_lists, p_selectors, p_group_size, t12_day_spans, w1_latest, w2_first_child, w4_numbered,
        w5_running, o3_top_parts, j01_join_kinds, a01_distinct, a01_period_sketches, a09_frequency, a10_joined_text, a11_arrays, c02_phrase_flags, f03_formats,
    )
}

_RETURNS = "(SELECT l_orderkey AS delivery_id FROM lineitem WHERE l_returnflag = 'R')"


def _kind(name: str, sql: str) -> str:
    return f"SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS keys, '{name}' AS kind FROM ({sql})"


_US = "epoch_us(result_created_at) - epoch_us(billing_date)"

ORACLE = {
    "p_range_filters": with_views(
        "v_claim",
        body=f"""SELECT count(*) FILTER (billing_date >= TIMESTAMP '{A}' AND billing_date < TIMESTAMP '1997-10-01') AS whole_days,
        count(*) FILTER (billing_date > TIMESTAMP '{A}' AND billing_date <= TIMESTAMP '{B}') AS left_open,
        count(*) FILTER (billing_date BETWEEN TIMESTAMP '{A}' AND TIMESTAMP '{B}') AS midnights,
        count(*) FILTER (billing_date < TIMESTAMP '2001-07-15' AND billing_date >= TIMESTAMP '2001-06-15') AS trailing,
        count(*) FILTER (year(billing_date) = 1999) AS year, count(*) FILTER (billing_date >= TIMESTAMP '2001-06-11') AS week_since FROM v_claim"""),
    "p_null_lists": with_views(
        "v_order", "v_claim",
        body="""SELECT count(*) FILTER (order_flow IS NULL OR order_flow NOT IN ('trf_transcribed', 'free_of_approval')) AS kept_nulls,
        count(*) FILTER (order_flow NOT IN ('trf_transcribed', 'free_of_approval')) AS dropped_nulls,
        count(*) FILTER (resubmitted IS NULL OR resubmitted = false) AS not_resubmitted, count(*) FILTER (lower(order_flow) LIKE '%cash%') AS cash,
        count(*) FILTER (order_flow LIKE 'patient%') AS prefix, count(sample_id) AS has_sample
        FROM v_order o JOIN v_claim c ON c.order_id = o.order_id"""),
    "p_selectors": with_views("v_order", body="SELECT state, count(*) AS n FROM v_order WHERE source = '3-MEDIUM' GROUP BY 1"),
    "p_group_size": "SELECT o_custkey AS owner_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15",
    "t12_day_spans": with_views(
        "v_claim", "v_result",
        body=f"""SELECT CAST(floor(({_US}) / 86400000000.0) AS BIGINT) AS elapsed,
        date_diff('day', CAST(billing_date AS DATE), CAST(result_created_at AS DATE)) AS calendar, count(*) AS n
        FROM v_claim c JOIN v_result r ON r.order_id = c.order_id GROUP BY 1, 2"""),
    "w1_latest": with_views(
        "v_eob", body="""SELECT zc_id, production_date, status_code_id, part_id, payer_id FROM v_eob
        QUALIFY row_number() OVER (PARTITION BY zc_id ORDER BY production_date DESC, status_code_id DESC, part_id, payer_id) = 1"""),
    "w2_first_child": with_views(
        "v_order", "v_shipment",
        body="""WITH f AS (SELECT * FROM v_shipment QUALIFY row_number() OVER (PARTITION BY delivery_id ORDER BY ship_date, shipment_id, part_id) = 1)
        SELECT o.order_id, f.ship_date, CAST(f.shipment_id AS VARCHAR) AS shipment_id FROM v_order o LEFT JOIN f ON f.delivery_id = o.delivery_id"""),
    "w4_numbered": """SELECT o_custkey AS owner_id, o_orderkey AS order_id, o_orderdate AS created_at,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS kit_number FROM orders""",
    "w5_running": with_views(
        "v_order", body="""WITH d AS (SELECT state, created_at, count(*) AS n FROM v_order GROUP BY 1, 2)
        SELECT state, created_at, n, CAST(sum(n) OVER (PARTITION BY state ORDER BY created_at) AS BIGINT) AS so_far,
        CAST(sum(n) OVER (PARTITION BY state ORDER BY created_at) AS DOUBLE) / 1000 * 100 AS share FROM d"""),
    "o3_top_parts": "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "j01_join_kinds": with_views(
        "v_order",
        body=" UNION ALL ".join([
            _kind("inner", f"SELECT o.delivery_id AS k FROM v_order o JOIN {_RETURNS} s ON s.delivery_id = o.delivery_id"),
            _kind("left", f"SELECT o.delivery_id AS k FROM v_order o LEFT JOIN {_RETURNS} s ON s.delivery_id = o.delivery_id"),
            _kind("right", f"SELECT s.delivery_id AS k FROM v_order o RIGHT JOIN {_RETURNS} s ON s.delivery_id = o.delivery_id"),
            _kind("full", f"SELECT coalesce(o.delivery_id, s.delivery_id) AS k FROM v_order o FULL JOIN {_RETURNS} s ON s.delivery_id = o.delivery_id"),
            _kind("left_semi", f"SELECT o.delivery_id AS k FROM v_order o WHERE EXISTS (SELECT 1 FROM {_RETURNS} s WHERE s.delivery_id = o.delivery_id)"),
            _kind("left_anti", f"SELECT o.delivery_id AS k FROM v_order o WHERE NOT EXISTS (SELECT 1 FROM {_RETURNS} s WHERE s.delivery_id = o.delivery_id)"),
        ])),
    "a01_distinct": "SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2",
    "a01_period_sketches": " UNION ALL ".join(
        f"SELECT '{grain}' AS grain, CAST({start} AS TIMESTAMP) AS period_start, o_orderpriority, count(DISTINCT o_custkey) AS customers, true AS within FROM orders GROUP BY ALL"
        for grain, start in (("Weekly", "date_trunc('week', o_orderdate + INTERVAL 1 DAY) - INTERVAL 1 DAY"), ("Monthly", "date_trunc('month', o_orderdate)"),
                             ("Quarterly", "date_trunc('quarter', o_orderdate)"), ("Yearly", "date_trunc('year', o_orderdate)"))),
    "a09_frequency": with_views("v_order", body="SELECT order_flow, count(*) AS n FROM v_order WHERE order_flow IS NOT NULL GROUP BY 1"),
    "a10_joined_text": with_views("v_meta_text", body="SELECT order_id, order_meta_values FROM v_meta_text"),
    "a11_arrays": with_views(
        "v_meta",
        body="""SELECT order_id, CAST(count(*) AS INTEGER) AS n, CASE WHEN bool_or(value IN ('Starter Upgrade', 'Upgraded from BAv1', 'Upgraded from BBv1', 'Upgraded from BAv2',
        'Upgraded from BBv2', 'Upgraded from BAv3', 'Upgraded from BBv3')) THEN 'Upgrade' END AS by_label,
        bool_or(value LIKE '%Upgraded from%' OR value LIKE '%Starter upgrade%') AS by_pattern FROM v_meta GROUP BY 1"""),
    "c02_phrase_flags": with_views(
        "v_meta_text", body="""SELECT order_id, lower(order_meta_values) LIKE '%upgraded from%' OR lower(order_meta_values) LIKE '%starter upgrade%' AS upgraded,
        lower(order_meta_values) LIKE '%vip%' AS vip FROM v_meta_text"""),
    "f03_formats": """SELECT o_orderstatus, '$' || format('{:,}', CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT)) || '.' ||
        lpad(CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0') AS money,
        format('{:,}', count(*)) AS grouped, count(*) || '.000' AS fixed, o_orderstatus || ' a b' AS spaced, strftime(max(o_orderdate), '%Y-%m-%d') AS day,
        strftime(max(o_orderdate), '%m/%d') AS month_day, strftime(max(o_orderdate), '%B %Y') AS month_year, strftime(max(o_orderdate), '%b %d, %Y %H:%M') AS stamp,
        CAST(2 AS INTEGER) AS present FROM orders GROUP BY 1""",
}
