"""Operations summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermetrics.catalog.checks import half_even_money, period_columns, with_views
from ordermetrics.catalog.views import END, START, TEST_NAMES, Tables
from ordermetrics.functions.timeframe import at_zone, day
from ordermetrics.operators.calendar import fiscal_calendar, with_label, with_period
from ordermetrics.plans import billing, ops_summary
from ordermetrics.plans.common import ProductCodes

SINCE = "1995-12-31"
IN_RANGE = f">= TIMESTAMP '{START}' AND {{}} < TIMESTAMP '{END}' + INTERVAL 1 DAY"
# One logical product; each table has its own column and code for it.
CODES = ProductCodes({"first": {
    "orders": ("version", 1), "kits": ("type", "NORMAL"), "samples": ("product", 16), "reports": ("report_status", "RELEASED"),
    "bills": ("product", "1-URGENT"), "payments": ("version", 1)}})


def _orders(t: Tables) -> DataFrame:
    return t.orders().withColumnRenamed("created_at", "order_created_at")


def _kits(t: Tables) -> DataFrame:
    return t.shipments().where("type = 'NORMAL'").selectExpr("shipment_id", "delivery_id AS order_item_id", "type", "ship_date")


def _samples(t: Tables) -> DataFrame:
    return t.samples().selectExpr("sample_id", "received AS sample_received", "kit_type AS product")


def _reports(t: Tables) -> DataFrame:
    return t.reports().where("report_status = 'RELEASED'").select("order_id", "status_id", "report_status", "report_created_at")


def _bills(t: Tables) -> DataFrame:
    return t.claims().selectExpr("id AS bill_id", "order_id", "billing_date", "product", "resubmitted")


def _payments(t: Tables) -> DataFrame:
    return t.eobs().selectExpr("zc_id AS claim_id", "zc_id AS order_id", "payment", "issue_date", "production_date",
                               "payer_id AS product", "status_code_id AS version")


def m01_noncohort_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return ops_summary.noncohort_summary(
        _orders(t), _kits(t), _samples(t), _reports(t), _bills(t), _payments(t), START, END, "Monthly"
    )


def m01_noncohort_weekly(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly grain over a supplied fiscal calendar table."""
    t = Tables(spark, folder)
    calendar = fiscal_calendar(spark, "1994-12-25", "2001-12-31")
    return ops_summary.noncohort_summary(
        _orders(t), _kits(t), _samples(t), _reports(t), _bills(t), _payments(t), START, END, "Weekly", calendar=calendar
    )


def m01_by_product(spark: SparkSession, folder: str) -> DataFrame:
    """One product, which each table knows under its own column and code."""
    t = Tables(spark, folder)
    return ops_summary.noncohort_summary(
        _orders(t), _kits(t), _samples(t), _reports(t), _bills(t), _payments(t), START, END, "Monthly", product="first", codes=CODES
    )


def m01_presented(spark: SparkSession, folder: str) -> DataFrame:
    """The summary with display names and grouped digits."""
    shown = ops_summary.presented(m01_noncohort_summary(spark, folder))
    return shown.select("Date", "Orders Generated", "Kits Shipped", "Claims Billed")


def m01_presented_wide(spark: SparkSession, folder: str) -> DataFrame:
    """The same with a column a period."""
    summary = m01_noncohort_summary(spark, folder).select("period", "period_start", "orders_generated", "kits_shipped", "claims_billed")
    wide = ops_summary.presented(summary, "Horizontal", ["1/1997", "2/1997"])
    return wide.withColumnsRenamed({"Date": "measure", "1/1997": "january", "2/1997": "february"})


def m02_cohort_summary(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return ops_summary.cohort_summary(_orders(t), _kits(t), _reports(t), _bills(t), _payments(t), START, END, "Monthly")


def j15_cohort_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Size and sums of the detail rows per order state."""
    t = Tables(spark, folder)
    rows = ops_summary.cohort_orders(_orders(t), _kits(t), _samples(t), _reports(t), _bills(t), _payments(t))
    return rows.groupBy("state").agg(
        F.count(F.lit(1)).alias("rows_total"), F.count("shipment_id").alias("shipped"), F.count("status_id").alias("reported"),
        F.sum("payment").cast("double").alias("payment"), F.min("ship_date").alias("first_ship"),
        F.sum(F.datediff("ship_date", F.lit("1990-01-01"))).alias("ship_days"),
    )


def m03_order_extract(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    rows = ops_summary.order_extract(t.orders(), t.order_types(), t.metadata(), SINCE, vocab=TEST_NAMES)
    return rows.withColumns({c: F.col(c).cast("string") for c in ("sample_id", "delivery_id")})


def m03_kit_extract(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return ops_summary.kit_extract(t.shipments(), t.order_items(), [0, 1, 2], SINCE)


def m03_sample_extract(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return ops_summary.sample_extract(t.samples().drop("kit_type"), t.kits(), SINCE)


def m03_report_extract(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return ops_summary.report_extract(t.orders(), t.status_history())


def m03_bill_extract(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return ops_summary.bill_extract(t.claims(), since=SINCE).withColumn("resubmitted", F.col("resubmitted").cast("string"))


def m03_payment_extract(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    linked = billing.linked_claims(t.payer_claims(), t.links(), t.claims(), billed_after="1990-01-01")
    latest = ops_summary.payment_extract(linked, t.eobs(), SINCE, ["zc_id", "status_code_id", "part_id", "payer_id"])
    return latest.select("claim_id", "zc_id", "production_date", "issue_date", F.col("payment").cast("double").alias("payment"),
                         "product", "version")


def t02_fiscal_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per fiscal period in all four grains."""
    t = Tables(spark, folder)
    orders = t.orders().select("order_id", "created_at")
    parts = [
        with_label(with_period(orders, "created_at", grain).groupBy("period_start").agg(F.count("order_id").alias("n")), grain)
        .select(F.lit(grain).alias("grain"), "period", "period_start", "n")
        for grain in ("Weekly", "Monthly", "Quarterly", "Yearly")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def t11_zone_shift(spark: SparkSession, folder: str) -> DataFrame:
    """Claims per local billing day."""
    t = Tables(spark, folder)
    local = t.claims().select(at_zone("billing_date", "America/Los_Angeles").alias("local_time"))
    return local.groupBy(day("local_time").alias("local_day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("local_time").alias("first_time")
    )


QUERIES = {
    f.__name__: f
    for f in (
        m01_noncohort_summary, m01_noncohort_weekly, m01_by_product, m01_presented, m01_presented_wide, m02_cohort_summary, j15_cohort_rows, m03_order_extract,
        m03_kit_extract, m03_sample_extract, m03_report_extract, m03_bill_extract, m03_payment_extract,
        t02_fiscal_periods, t11_zone_shift,
    )
}


def _part(name: str, entity: str, ts: str, table: str, cond: str = "true", columns=period_columns) -> str:
    return (
        f"SELECT {columns(ts)}, '{name}' AS m, CAST({entity} AS VARCHAR) AS e, 0.00::DECIMAL(18,2) AS pay, 0 AS np "
        f"FROM {table} WHERE {ts} {IN_RANGE.format(ts)} AND {cond}"
    )


def _week_columns(ts: str) -> str:
    start = f"date_trunc('week', {ts} + INTERVAL 1 DAY) - INTERVAL 1 DAY"
    return f"strftime({start}, '%Y-%m-%d') AS period, CAST({start} AS TIMESTAMP) AS period_start"


def _noncohort(columns, orders: str = "true", samples: str = "true", bills: str = "true", payments: str = "true") -> str:
    parts = [
        _part("orders_generated", "order_id", "created_at", "v_order", orders, columns),
        _part("orders_approved", "order_id", "created_at", "v_order", f"state = 'APPROVED' AND {orders}", columns),
        _part("kits_shipped", "shipment_id", "ship_date", "v_shipment", "type = 'NORMAL'", columns),
        _part("samples_accessioned", "sample_id", "received", "v_sample", samples, columns),
        _part("reports_released", "order_id", "created_at", "v_status", "status = 'RELEASED'", columns),
        _part("claims_billed", "id", "billing_date", "v_claim", bills, columns),
        f"SELECT {columns('issue_date')}, 'claims_with_eob', CAST(zc_id AS VARCHAR), payment, 1 FROM v_eob "
        f"WHERE issue_date {IN_RANGE.format('issue_date')} AND {payments}",
    ]
    names = ["orders_generated", "orders_approved", "kits_shipped", "samples_accessioned", "reports_released",
             "claims_billed", "claims_with_eob"]
    counts = ", ".join(f"count(DISTINCT e) FILTER (m = '{n}') AS {n}" for n in names)
    average = half_even_money("sum(pay)", "sum(np)")
    return with_views(
        "v_order", "v_shipment", "v_sample", "v_status", "v_claim", "v_eob",
        body=f"""WITH facts AS ({' UNION ALL '.join(parts)})
        SELECT period, period_start, {counts}, CAST(sum(pay) AS DOUBLE) AS aggregate_payment,
        coalesce({average}, 0) AS average_payment FROM facts GROUP BY 1, 2""",
    )


_COHORT = f"""WITH ship AS (SELECT delivery_id AS d, count(*) AS k FROM v_shipment WHERE type = 'NORMAL' GROUP BY 1),
rep AS (SELECT order_id AS r FROM v_status WHERE status = 'RELEASED' GROUP BY 1),
chain AS (SELECT o.order_id, o.created_at, o.sample_id, ship.k, rep.r, b.id AS bill_id, e.zc_id AS claim_id, e.payment
  FROM v_order o LEFT JOIN ship ON ship.d = o.delivery_id LEFT JOIN rep ON rep.r = o.order_id
  LEFT JOIN v_claim b ON b.order_id = o.order_id LEFT JOIN v_eob e ON e.zc_id = o.order_id
  WHERE o.created_at {IN_RANGE.format('o.created_at')})
SELECT {period_columns('created_at')}, count(DISTINCT order_id) AS orders_generated,
  count(DISTINCT CASE WHEN k IS NOT NULL THEN order_id END) AS kits_shipped,
  count(DISTINCT CASE WHEN sample_id IS NOT NULL THEN order_id END) AS samples_accessioned,
  count(DISTINCT CASE WHEN r IS NOT NULL THEN order_id END) AS reports_released,
  count(DISTINCT CASE WHEN bill_id IS NOT NULL THEN order_id END) AS claims_billed,
  count(DISTINCT claim_id) AS claims_with_eob, CAST(coalesce(sum(payment), 0) AS DOUBLE) AS aggregate_payment,
  coalesce({half_even_money('sum(payment)', 'count(payment)')}, 0) AS average_payment
FROM chain GROUP BY 1, 2"""

ORACLE = {
    "m01_noncohort_summary": _noncohort(period_columns),
    "m01_noncohort_weekly": _noncohort(_week_columns),
    "m01_by_product": _noncohort(period_columns, "version = 1", "kit_type = 16", "product = '1-URGENT'", "status_code_id = 1"),
    "m01_presented": f"""SELECT period AS "Date", format('{{:,}}', orders_generated) AS "Orders Generated", format('{{:,}}', kits_shipped) AS "Kits Shipped",
        format('{{:,}}', claims_billed) AS "Claims Billed" FROM ({_noncohort(period_columns)})""",
    "m01_presented_wide": "SELECT measure, " + ", ".join(
        f"max(CASE WHEN period = '{n}/1997' THEN shown END) AS {month}" for n, month in ((1, "january"), (2, "february"))) + f"""
        FROM (SELECT period, unnest(['Orders Generated', 'Kits Shipped', 'Claims Billed']) AS measure,
        unnest([format('{{:,}}.0', orders_generated), format('{{:,}}.0', kits_shipped), format('{{:,}}.0', claims_billed)]) AS shown
        FROM ({_noncohort(period_columns)})) GROUP BY 1""",
    "m02_cohort_summary": with_views("v_order", "v_shipment", "v_status", "v_claim", "v_eob", body=_COHORT),
    "j15_cohort_rows": with_views(
        "v_order", "v_shipment", "v_sample", "v_status", "v_claim", "v_eob",
        body="""WITH s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY ship_date, shipment_id) AS rn
            FROM v_shipment WHERE type = 'NORMAL') WHERE rn = 1),
        r AS (SELECT order_id, min(status_id) AS status_id FROM v_status WHERE status = 'RELEASED' GROUP BY 1)
        SELECT o.state, count(*) AS rows_total, count(s.shipment_id) AS shipped, count(r.status_id) AS reported,
        CAST(sum(e.payment) AS DOUBLE) AS payment, min(s.ship_date) AS first_ship,
        CAST(sum(date_diff('day', DATE '1990-01-01', CAST(s.ship_date AS DATE))) AS BIGINT) AS ship_days
        FROM v_order o LEFT JOIN s ON s.delivery_id = o.delivery_id LEFT JOIN v_sample x ON x.sample_id = o.sample_id
        LEFT JOIN r ON r.order_id = o.order_id LEFT JOIN v_claim b ON b.order_id = o.order_id
        LEFT JOIN v_eob e ON e.zc_id = o.order_id GROUP BY 1""",
    ),
    "m03_order_extract": with_views(
        "v_order", "v_type", "v_meta_text",
        body=f"""SELECT o.order_id, o.created_at AS order_created_at, t.code,
        CASE WHEN prescription_id IS NULL THEN 'singlekit' ELSE 'multikit' END AS kit_type,
        CASE WHEN lower(m.order_meta_values) LIKE '%upgraded from%' THEN 'upgrade'
             WHEN lower(m.order_meta_values) LIKE '%starter upgrade%' THEN 'upgrade' ELSE 'nonupgrade' END AS upgrade_type,
        coalesce(prescription_id, o.order_id) AS kit_1_id, version, state,
        CAST(sample_id AS VARCHAR) AS sample_id, CAST(delivery_id AS VARCHAR) AS delivery_id
        FROM v_order o LEFT JOIN v_meta_text m ON m.order_id = o.order_id JOIN v_type t ON t.order_type_id = o.order_type_id
        WHERE state NOT IN ('DRAFT') AND created_at > TIMESTAMP '{SINCE}'""",
    ),
    "m03_kit_extract": with_views(
        "v_shipment",
        body=f"""SELECT s.shipment_id, s.order_id AS order_item_id, CAST(o.o_custkey % 4 AS INTEGER) AS item_type_id, s.type, s.ship_date
        FROM v_shipment s JOIN orders o ON o.o_orderkey = s.order_id
        WHERE o.o_custkey % 4 IN (0, 1, 2) AND s.type = 'NORMAL' AND s.ship_date > TIMESTAMP '{SINCE}'""",
    ),
    "m03_sample_extract": with_views(
        "v_sample", "v_kit",
        body=f"""SELECT s.received AS sample_received, s.sample_id, k.kit_type AS product FROM v_sample s
        JOIN v_kit k ON k.barcode = s.kit_barcode WHERE k.barcode NOT LIKE 'study-%' AND s.received > TIMESTAMP '{SINCE}'""",
    ),
    "m03_report_extract": with_views(
        "v_order", "v_status",
        body="""SELECT o.order_id, o.order_type_id, f.status_id, f.status, f.created_at AS report_created_at
        FROM v_order o JOIN v_status f ON f.order_id = o.order_id AND f.status = 'RELEASED' WHERE o.state = 'RELEASED'""",
    ),
    "m03_bill_extract": with_views(
        "v_claim",
        body=f"""SELECT id AS bill_id, order_id,
        (billing_date AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS billing_date, product,
        CAST(resubmitted AS VARCHAR) AS resubmitted
        FROM v_claim WHERE billing_date > TIMESTAMP '{SINCE}'""",
    ),
    "m03_payment_extract": with_views(
        "v_linked", "v_eob",
        body=f"""SELECT claim_id, zc_id, production_date, issue_date, CAST(payment AS DOUBLE) AS payment, product, version FROM (
        SELECT l.claim_id, l.zc_id, e.production_date, e.issue_date, e.payment, l.product, l.version,
        row_number() OVER (PARTITION BY l.claim_id ORDER BY e.production_date DESC, l.zc_id, e.status_code_id, e.part_id, e.payer_id) AS rk
        FROM v_linked l JOIN v_eob e ON e.zc_id = l.zc_id WHERE e.issue_date > TIMESTAMP '{SINCE}') WHERE rk = 1""",
    ),
    "t02_fiscal_periods": with_views(
        "v_order",
        body="""WITH d AS (SELECT order_id, created_at AS c, date_trunc('week', created_at + INTERVAL 1 DAY) - INTERVAL 1 DAY AS w FROM v_order)
        SELECT 'Weekly' AS grain, strftime(w, '%Y-%m-%d') AS period, CAST(w AS TIMESTAMP) AS period_start, count(*) AS n FROM d GROUP BY 2, 3
        UNION ALL SELECT 'Monthly', CAST(month(c) AS VARCHAR) || '/' || CAST(year(c) AS VARCHAR), CAST(date_trunc('month', c) AS TIMESTAMP), count(*) FROM d GROUP BY 2, 3
        UNION ALL SELECT 'Quarterly', CAST(year(c) AS VARCHAR) || 'Q' || CAST(quarter(c) AS VARCHAR), CAST(date_trunc('quarter', c) AS TIMESTAMP), count(*) FROM d GROUP BY 2, 3
        UNION ALL SELECT 'Yearly', CAST(year(c) AS VARCHAR), CAST(date_trunc('year', c) AS TIMESTAMP), count(*) FROM d GROUP BY 2, 3""",
    ),
    "t11_zone_shift": with_views(
        "v_claim",
        body="""WITH l AS (SELECT (billing_date AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles' AS t FROM v_claim)
        SELECT CAST(date_trunc('day', t) AS TIMESTAMP) AS local_day, count(*) AS n, min(t) AS first_time FROM l GROUP BY 1""",
    ),
}
