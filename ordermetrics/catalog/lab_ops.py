"""Laboratory operations queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermetrics.catalog.checks import half_even_quotient, ratio, with_views
from ordermetrics.catalog.views import AS_OF, TEST_NAMES, Tables
from ordermetrics.operators.joins import join_on
from ordermetrics.plans import lab_ops

SINCE = "1995-12-31"
FIRST_MONTH = "1996-01-31"


def _lab_orders(t: Tables) -> DataFrame:
    return lab_ops.lab_orders(t.orders(), t.order_types(), SINCE)


def _lab_kits(t: Tables) -> DataFrame:
    return lab_ops.lab_kits(t.shipments(), t.order_items(), [0, 1, 2], SINCE)


def m04_mtd_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = Tables(spark, folder).orders()
    return _doubles(lab_ops.month_to_date(orders, "created_at", "order_id", AS_OF))


def m04_mtd_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Per product, as the charts show them."""
    samples = Tables(spark, folder).lab_samples()
    return _doubles(lab_ops.month_to_date(samples, "sample_received", "sample_id", AS_OF, ["kit_type"]))


def m04_mtd_processed(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    first = lab_ops.first_success(_lab_orders(t), t.lab_samples(), t.results().drop("part_id"))
    return _doubles(lab_ops.month_to_date(first, "result_created_at", "order_id", AS_OF))


def m04_mtd_reports(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    released = t.reports().where("report_status = 'RELEASED' AND state = 'RELEASED'")
    return _doubles(lab_ops.month_to_date(released, "report_created_at", "order_id", AS_OF))


def _doubles(mtd: DataFrame) -> DataFrame:
    # null beyond today, so no integer column
    return mtd.withColumns({c: F.col(c).cast("double") for c in ("current_month_daily", "current_month_count")})


def m05_pipeline_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    reports = t.reports().drop("order_id", "status_id")
    return lab_ops.pipeline_cutoffs(
        _lab_orders(t), _lab_kits(t), t.lab_samples(), reports, "2000-03-01", AS_OF, 300, 200, 250
    )


def m06_monthly_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The five monthly count series, stacked."""
    t = Tables(spark, folder)
    return lab_ops.monthly_counts(_lab_orders(t), t.lab_samples(), t.results(), t.reports(), FIRST_MONTH)


def m07_return_rate(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return lab_ops.sample_return_rate(_lab_orders(t), _lab_kits(t), t.lab_samples(), FIRST_MONTH)


def m07_success_rate(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return lab_ops.process_success_rate(_lab_orders(t), t.lab_samples(), t.results())


def m07_correction_rate(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return lab_ops.correction_rate(t.reports(), t.results())


def m08_mean_days(spark: SparkSession, folder: str) -> DataFrame:
    """The three mean-duration series, stacked."""
    t = Tables(spark, folder)
    orders, samples = _lab_orders(t), t.lab_samples()
    shipping = lab_ops.shipping_timelines(orders, _lab_kits(t), samples, t.reports().drop("order_id"))
    return shipping.unionByName(lab_ops.process_turnaround(orders, samples, t.results()).withColumn("series", F.lit("processing")))


def _blocked(t: Tables) -> DataFrame:
    kits = t.shipments().where("type = 'NORMAL'").select("delivery_id", "shipment_id", "ship_date", "part_id")
    return lab_ops.blocked_reports(
        _lab_orders(t), kits, t.blocked(), t.issue_types(), tie=["shipment_id", "part_id"], vocab=TEST_NAMES
    )


def m09_blocked_detail(spark: SparkSession, folder: str) -> DataFrame:
    rows = _blocked(Tables(spark, folder))
    return rows.select("sample_id", "ssr", "order_id", "state", "ship_date", F.col("shipment_id").cast("string").alias("shipment_id"),
                       "issue_id", "issue_type", "issue_type_description")


def m10_blocked_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Outstanding runs per product and day, last 30 days before the clock."""
    blocked = _blocked(Tables(spark, folder)).withColumn("date", lab_ops.day("sample_received"))
    daily = lab_ops.outstanding_counts(blocked, {"first": 16, "second": 17}, ["date"])
    return lab_ops.recent_days(daily, AS_OF)


def m11_blocked_by_issue(spark: SparkSession, folder: str) -> DataFrame:
    return lab_ops.blocked_by_issue(_blocked(Tables(spark, folder)))


def _released_samples(t: Tables) -> DataFrame:
    released = t.reports().where("report_status = 'RELEASED'").groupBy("sample_id").agg(F.min("report_created_at").alias("released"))
    return join_on(t.lab_samples(), released, {"sample_id": "sample_id"})


def m12_turnaround_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return lab_ops.turnaround_table(_released_samples(Tables(spark, folder)), "kit_type", "sample_received", "released", AS_OF)


def m12_turnaround_percent(spark: SparkSession, folder: str) -> DataFrame:
    return lab_ops.turnaround_table(
        _released_samples(Tables(spark, folder)), "kit_type", "sample_received", "released", AS_OF, "percentages"
    )


def m13_daily_digest(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    mtd = lab_ops.month_to_date(t.lab_samples(), "sample_received", "sample_id", AS_OF, ["kit_type"])
    return lab_ops.daily_digest(mtd, AS_OF, ["kit_type"], _blocked(t))


def m46_lab_orders(spark: SparkSession, folder: str) -> DataFrame:
    rows = _lab_orders(Tables(spark, folder))
    return rows.withColumns({c: F.col(c).cast("string") for c in ("prescription_id", "sample_id", "delivery_id")})


def m46_lab_kits(spark: SparkSession, folder: str) -> DataFrame:
    return _lab_kits(Tables(spark, folder))


def m46_lab_samples(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return lab_ops.lab_samples(t.samples().drop("kit_type", "sample_process_status"), t.kits(), t.sample_statuses(), SINCE)


def m46_lab_reports(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    rows = lab_ops.lab_reports(t.orders(), t.status_history(), SINCE)
    return rows.withColumn("sample_id", F.col("sample_id").cast("string"))


def m46_lab_results(spark: SparkSession, folder: str) -> DataFrame:
    results = Tables(spark, folder).results().withColumnsRenamed({"result_status": "status", "result_created_at": "created_at"})
    return lab_ops.lab_results(results, SINCE)


def j06_blocked_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Seven tables joined, the last pair on run and version."""
    t = Tables(spark, folder)
    samples = t.samples().drop("kit_type", "sample_process_status").selectExpr("*", "sample_id AS vial_barcode")
    lines = t.raw("lineitem")
    loadings = lines.selectExpr("l_orderkey AS tubeId", "l_orderkey * 10 + l_linenumber AS loading_id").distinct()
    sequencing = lines.selectExpr(
        "l_orderkey * 10 + l_linenumber AS ssr", "l_suppkey % 3 AS version",
        "CASE WHEN l_returnflag = 'A' THEN 'pending' ELSE 'done' END AS report_status",
    )
    issues = lines.selectExpr("l_orderkey * 10 + l_linenumber AS ssr", "l_partkey % 3 AS version", "CAST(l_suppkey % 25 AS INT) AS issue_id")
    names = t.raw("nation").selectExpr("n_nationkey AS issue_id", "n_name AS issue_name")
    return lab_ops.blocked_extract(samples, t.kits(), t.sample_statuses(), loadings, sequencing, issues, names, SINCE)


QUERIES = {
    f.__name__: f
    for f in (
        m04_mtd_orders, m04_mtd_samples, m04_mtd_processed, m04_mtd_reports, m05_pipeline_cutoffs, m06_monthly_counts,
        m07_return_rate, m07_success_rate, m07_correction_rate, m08_mean_days, m09_blocked_detail, m10_blocked_daily,
        m11_blocked_by_issue, m12_turnaround_buckets, m12_turnaround_percent, m13_daily_digest, m46_lab_orders,
        m46_lab_kits, m46_lab_samples, m46_lab_reports, m46_lab_results, j06_blocked_extract,
    )
}

# --- checking SQL ---------------------------------------------------------

V_LAB_ORDER = f"""lab_order AS (SELECT o.*, t.code FROM v_order o JOIN v_type t ON t.order_type_id = o.order_type_id
  WHERE state NOT IN ('DRAFT') AND created_at > TIMESTAMP '{SINCE}')"""
V_LAB_KIT = f"""lab_kit AS (SELECT s.shipment_id, s.order_id AS delivery_id, s.ship_date FROM v_shipment s
  JOIN orders i ON i.o_orderkey = s.order_id WHERE i.o_custkey % 4 IN (0, 1, 2) AND s.type = 'NORMAL'
  AND s.ship_date > TIMESTAMP '{SINCE}')"""


def _mtd(source: str, group: str = "") -> str:
    """Month-to-date over ``ev`` (ts, id, optional g) for the clock 2001-07-15."""
    g, gc, gj = ("g, ", "c.g", "AND x.g = c.g") if group else ("", "1", "")
    out = f"g AS {group}, " if group else ""
    groups = "(SELECT DISTINCT g FROM daily)" if group else "(SELECT 1 AS one)"
    pick = "c.g AS g, " if group else ""
    part = "PARTITION BY g" if group else ""
    return f"""WITH {source},
    daily AS (SELECT {g}day(ts) AS d, count(DISTINCT CASE WHEN ts >= TIMESTAMP '2001-07-01' THEN id END) AS cur,
      count(DISTINCT CASE WHEN ts < TIMESTAMP '2001-07-01' THEN id END) AS prev
      FROM ev WHERE ts >= TIMESTAMP '2001-06-01' AND ts < TIMESTAMP '2001-07-16' GROUP BY ALL),
    spine AS (SELECT {pick}s.d, CASE WHEN s.d <= 15 THEN coalesce(x.cur, 0) END AS cur, coalesce(x.prev, 0) AS prev
      FROM {groups} c CROSS JOIN (SELECT unnest(generate_series(1, 31)) AS d) s LEFT JOIN daily x ON x.d = s.d {gj}),
    total AS (SELECT *, sum(cur) OVER ({part} ORDER BY d) AS curt, sum(prev) OVER ({part} ORDER BY d) AS prevt FROM spine),
    fit AS (SELECT {g}regr_slope(curt, d) AS b, regr_intercept(curt, d) AS a FROM total WHERE d <= 15 {('GROUP BY g') if group else ''})
    SELECT {out.replace('g AS', 't.g AS')}CAST(t.d AS INTEGER) AS day, CAST(prev AS BIGINT) AS previous_month_daily,
      CAST(cur AS DOUBLE) AS current_month_daily,
      CAST(CASE WHEN t.d <= 30 THEN prevt ELSE 0 END AS BIGINT) AS previous_month_count,
      CAST(CASE WHEN t.d <= 15 THEN curt END AS DOUBLE) AS current_month_count,
      CASE WHEN t.d > 15 THEN round_even(b * t.d + a, 0) END AS predicted_count
    FROM total t JOIN fit f ON {'f.g = t.g' if group else 'true'}"""


_FIRST = """first_result AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY result_created_at, result_id) AS rn
  FROM v_result) WHERE rn = 1)"""


def _processed(statuses: str) -> str:
    return (
        "SELECT f.result_created_at AS ts, o.order_id AS id FROM lab_order o JOIN v_sample s ON s.sample_id = o.sample_id "
        f"JOIN first_result f ON f.order_id = o.order_id WHERE s.sample_process_status IN ({statuses})"
    )


def _filled(counts: str, columns: str, select: str, since: str | None = None) -> str:
    """Months between the first and last of ``counts`` (m, columns)."""
    tail = "" if since is None else f" WHERE last_day(g.m) >= DATE '{since}'"
    return (
        f"SELECT CAST(last_day(g.m) AS TIMESTAMP) AS month, {select} FROM (SELECT unnest(generate_series((SELECT min(m) FROM {counts}), "
        f"(SELECT max(m) FROM {counts}), INTERVAL 1 MONTH)) AS m) g LEFT JOIN {counts} c ON c.m = g.m{tail}"
    )


def _count_series(name: str, rows: str) -> tuple[str, str]:
    cte = f"c_{name} AS (SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, count(DISTINCT id) AS n FROM ({rows}) GROUP BY 1)"
    return cte, _filled(f"c_{name}", "n", f"coalesce(c.n, 0) AS n, '{name}' AS series", FIRST_MONTH)


_SERIES = [
    _count_series("samples", "SELECT received AS ts, sample_id AS id FROM v_sample"),
    _count_series("processed", _processed("'success'")),
    _count_series("failures", _processed("'recollected', 'recollection', 'final-rejected'")),
    _count_series("released", "SELECT created_at AS ts, order_id AS id FROM v_status WHERE status = 'RELEASED'"),
    _count_series("corrected", "SELECT result_created_at AS ts, r.order_id AS id FROM v_result r JOIN v_status s ON s.order_id = r.order_id "
                               "WHERE result_status = 'corrected'"),
]


def _rate(rows: str, span: bool = True) -> str:
    """Monthly rate over rows (ts, part id, whole id); null outside the numerator's months."""
    inside = "CASE WHEN g.m BETWEEN (SELECT min(m) FROM c WHERE p > 0) AND (SELECT max(m) FROM c WHERE p > 0) THEN {} END" if span else "{}"
    value = half_even_quotient("coalesce(c.p, 0)", "coalesce(c.w, 0)")
    return (
        f"c AS (SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, count(DISTINCT part) AS p, count(DISTINCT whole) AS w "
        f"FROM ({rows}) GROUP BY 1) " + _filled("c", "p, w", inside.format(value) + " AS rate")
    )


def _mean_days(name: str, rows: str) -> tuple[str, str]:
    # whole days rounded down: exact on microseconds
    micros = "epoch_us(later) - epoch_us(earlier)"
    floor = f"(CASE WHEN {micros} < 0 THEN -((-({micros}) + 86399999999) // 86400000000) ELSE ({micros}) // 86400000000 END)"
    cte = (f"d_{name} AS (SELECT CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, sum({floor}) AS s, count({floor}) AS n "
           f"FROM ({rows}) WHERE ts IS NOT NULL GROUP BY 1)")
    value = half_even_quotient("CAST(c.s AS BIGINT)", "coalesce(c.n, 0)")
    return cte, _filled(f"d_{name}", "s, n", f"{value} AS mean_days, '{name}' AS series")


_DAYS = [
    _mean_days("accession", "SELECT ship_date AS ts, s.received AS later, ship_date AS earlier FROM lab_order o JOIN lab_kit k "
               "ON k.delivery_id = o.delivery_id LEFT JOIN v_sample s ON s.sample_id = o.sample_id "
               "WHERE o.order_flow IS NULL OR o.order_flow NOT IN ('trf_transcribed', 'doctor_transcribed')"),
    _mean_days("processing", "SELECT s.received AS ts, f.result_created_at AS later, s.received AS earlier FROM lab_order o "
               "JOIN v_sample s ON s.sample_id = o.sample_id JOIN first_result f ON f.order_id = o.order_id"),
    _mean_days("release", "SELECT ship_date AS ts, r.created_at AS later, ship_date AS earlier FROM lab_order o JOIN lab_kit k "
               "ON k.delivery_id = o.delivery_id JOIN v_sample s ON s.sample_id = o.sample_id "
               "JOIN v_status r ON r.order_id = o.sample_id AND r.status = 'RELEASED'"),
]

_BLOCKED = f"""{V_LAB_ORDER}, ship AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delivery_id ORDER BY ship_date, shipment_id, part_id) AS rn
  FROM v_shipment WHERE type = 'NORMAL') WHERE rn = 1),
blocked AS (SELECT b.sample_id, b.sample_received, b.kit_type, b.ssr, b.issue_id, o.order_id, o.state, s.ship_date, s.shipment_id,
  i.issue_type, i.issue_type_description FROM v_blocked b JOIN lab_order o ON o.sample_id = b.sample_id
  LEFT JOIN ship s ON s.delivery_id = o.delivery_id LEFT JOIN v_issue i ON i.issue_id = b.issue_id
  WHERE o.state NOT IN ('RELEASED', 'CANCELLED', 'CANCELLED_BY_PATIENT', 'REJECTED_BY_COMPANY', 'RECOLLECTED'))"""
_BLOCKED_VIEWS = ("v_order", "v_type", "v_shipment", "v_blocked", "v_issue")

_TAT = """rel AS (SELECT order_id AS sid, min(created_at) AS released FROM v_status WHERE status = 'RELEASED' GROUP BY 1),
tat AS (SELECT kit_type, sample_id, date_diff('day', received, released) AS days FROM v_sample LEFT JOIN rel ON sid = sample_id
  WHERE received >= TIMESTAMP '2001-06-01' AND received < TIMESTAMP '2001-07-01'),
bands AS (SELECT kit_type, count(DISTINCT sample_id) FILTER (days <= 7) AS a, count(DISTINCT sample_id) FILTER (days BETWEEN 8 AND 14) AS b,
  count(DISTINCT sample_id) FILTER (days >= 15) AS c FROM tat GROUP BY 1)"""

ORACLE = {
    "m04_mtd_orders": with_views("v_order", body=_mtd("ev AS (SELECT created_at AS ts, order_id AS id FROM v_order)")),
    "m04_mtd_samples": with_views(
        "v_sample", body=_mtd("ev AS (SELECT received AS ts, sample_id AS id, kit_type AS g FROM v_sample)", "kit_type")),
    "m04_mtd_processed": with_views(
        "v_order", "v_type", "v_sample", "v_result",
        body=_mtd(f"{V_LAB_ORDER}, {_FIRST}, ev AS ({_processed(chr(39) + 'success' + chr(39))})")),
    "m04_mtd_reports": with_views(
        "v_status", body=_mtd("ev AS (SELECT created_at AS ts, order_id AS id FROM v_status WHERE status = 'RELEASED')")),
    "m05_pipeline_cutoffs": with_views(
        "v_order", "v_type", "v_shipment", "v_sample", "v_status",
        body=f"""WITH {V_LAB_ORDER}, {V_LAB_KIT},
        chain AS (SELECT o.order_id, o.created_at, k.ship_date, s.received, r.created_at AS reported FROM lab_order o
          LEFT JOIN lab_kit k ON k.delivery_id = o.delivery_id LEFT JOIN v_sample s ON s.sample_id = o.sample_id
          LEFT JOIN v_status r ON r.order_id = o.sample_id AND r.status = 'RELEASED'
          WHERE o.created_at >= TIMESTAMP '2000-03-01' AND o.created_at < TIMESTAMP '2000-04-01'
          AND TIMESTAMP '{AS_OF}' - o.created_at >= INTERVAL 750 DAYS)
        SELECT count(DISTINCT order_id) AS orders,
        count(DISTINCT order_id) FILTER (ship_date - created_at <= INTERVAL 300 DAYS) AS kits_shipped,
        count(DISTINCT order_id) FILTER (ship_date - created_at <= INTERVAL 300 DAYS AND received - ship_date <= INTERVAL 200 DAYS) AS samples_accessioned,
        count(DISTINCT order_id) FILTER (ship_date - created_at <= INTERVAL 300 DAYS AND received - ship_date <= INTERVAL 200 DAYS
          AND reported - received <= INTERVAL 250 DAYS) AS reports_released FROM chain"""),
    "m06_monthly_counts": with_views(
        "v_order", "v_type", "v_sample", "v_result", "v_status",
        body=f"WITH {V_LAB_ORDER}, {_FIRST}, " + ", ".join(c for c, _ in _SERIES) + " " + " UNION ALL ".join(s for _, s in _SERIES)),
    "m07_return_rate": with_views(
        "v_order", "v_type", "v_shipment",
        body=f"WITH {V_LAB_ORDER}, {V_LAB_KIT}, " + _rate(
            "SELECT ship_date AS ts, sample_id AS part, shipment_id AS whole FROM lab_order o JOIN lab_kit k ON k.delivery_id = o.delivery_id",
            span=False) + f" WHERE last_day(g.m) >= DATE '{FIRST_MONTH}'"),
    "m07_success_rate": with_views(
        "v_order", "v_type", "v_sample", "v_result",
        body=f"WITH {V_LAB_ORDER}, " + _rate(
            "SELECT result_created_at AS ts, CASE WHEN sample_process_status = 'success' THEN o.order_id END AS part, o.order_id AS whole "
            "FROM lab_order o JOIN v_sample s ON s.sample_id = o.sample_id JOIN v_result r ON r.order_id = o.order_id")),
    "m07_correction_rate": with_views(
        "v_status", "v_result",
        body="WITH " + _rate("SELECT s.created_at AS ts, CASE WHEN result_status = 'corrected' THEN s.order_id END AS part, s.order_id AS whole "
                             "FROM v_status s JOIN v_result r ON r.order_id = s.order_id")),
    "m08_mean_days": with_views(
        "v_order", "v_type", "v_shipment", "v_sample", "v_result", "v_status",
        body=f"WITH {V_LAB_ORDER}, {V_LAB_KIT}, {_FIRST}, " + ", ".join(c for c, _ in _DAYS) + " " + " UNION ALL ".join(s for _, s in _DAYS)),
    "m09_blocked_detail": with_views(
        *_BLOCKED_VIEWS,
        body=f"""WITH {_BLOCKED} SELECT sample_id, ssr, order_id, state, ship_date, CAST(shipment_id AS VARCHAR) AS shipment_id,
        issue_id, issue_type, issue_type_description FROM blocked"""),
    "m10_blocked_daily": with_views(
        *_BLOCKED_VIEWS,
        body=f"""WITH {_BLOCKED} SELECT CAST(date_trunc('day', sample_received) AS TIMESTAMP) AS date,
        count(DISTINCT ssr) FILTER (kit_type = 16) AS first_count, count(DISTINCT ssr) FILTER (kit_type = 17) AS second_count
        FROM blocked WHERE (issue_type <> 'N' OR issue_type IS NULL) AND sample_received >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS GROUP BY 1"""),
    "m11_blocked_by_issue": with_views(
        *_BLOCKED_VIEWS,
        body=f"""WITH {_BLOCKED} SELECT issue_type_description, count(DISTINCT ssr) AS runs FROM blocked
        WHERE issue_type <> 'N' AND issue_type_description IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    "m12_turnaround_buckets": with_views(
        "v_sample", "v_status", body=f"""WITH {_TAT} SELECT kit_type, a + b + c AS total_accessioned, a AS up_to_7_days,
        b AS days_8_to_14, c AS days_15_or_more FROM bands"""),
    "m12_turnaround_percent": with_views(
        "v_sample", "v_status", body=f"""WITH {_TAT} SELECT kit_type, a + b + c AS total_accessioned, {ratio('a', 'a + b + c')} * 100 AS up_to_7_days,
        {ratio('b', 'a + b + c')} * 100 AS days_8_to_14, {ratio('c', 'a + b + c')} * 100 AS days_15_or_more FROM bands"""),
    "m13_daily_digest": with_views(
        "v_sample", *_BLOCKED_VIEWS,
        body=f"""WITH {_BLOCKED}, ob AS (SELECT kit_type AS kt, count(DISTINCT ssr) AS n FROM blocked WHERE issue_type <> 'N' OR issue_type IS NULL GROUP BY 1)
        SELECT kit_type, coalesce(max(n), 0) AS outstanding_blocked, count(DISTINCT sample_id) FILTER (received >= TIMESTAMP '2001-07-14' AND received < TIMESTAMP '2001-07-15') AS daily,
        count(DISTINCT sample_id) FILTER (received >= TIMESTAMP '2001-07-01' AND received < TIMESTAMP '2001-07-15') AS month_to_date
        FROM v_sample LEFT JOIN ob ON kt = kit_type WHERE received >= TIMESTAMP '2001-06-01' AND received < TIMESTAMP '2001-07-16' GROUP BY 1"""),
    "m46_lab_orders": with_views(
        "v_order", "v_type",
        body=f"""WITH {V_LAB_ORDER} SELECT order_id, order_flow, created_at AS order_created_at, code, owner_id, state,
        CAST(prescription_id AS VARCHAR) AS prescription_id, CAST(sample_id AS VARCHAR) AS sample_id,
        CAST(delivery_id AS VARCHAR) AS delivery_id FROM lab_order"""),
    "m46_lab_kits": with_views(
        "v_shipment",
        body=f"""SELECT s.shipment_id, s.order_id AS delivery_id, CAST(o.o_custkey % 4 AS INTEGER) AS item_type_id, s.ship_date
        FROM v_shipment s JOIN orders o ON o.o_orderkey = s.order_id
        WHERE o.o_custkey % 4 IN (0, 1, 2) AND s.type = 'NORMAL' AND s.ship_date > TIMESTAMP '{SINCE}'"""),
    "m46_lab_samples": with_views(
        "v_sample", "v_kit",
        body=f"""SELECT s.received AS sample_received, s.sample_id, k.kit_type, k.registered,
        CASE WHEN s.sample_process_status <> 'final-rejected' THEN s.sample_process_status END AS sample_process_status
        FROM v_sample s JOIN v_kit k ON k.barcode = s.kit_barcode WHERE k.barcode NOT LIKE 'study-%' AND s.received > TIMESTAMP '{SINCE}'"""),
    "m46_lab_reports": with_views(
        "v_order", "v_status",
        body=f"""SELECT o.order_id, o.state, CAST(o.sample_id AS VARCHAR) AS sample_id, o.order_type_id, f.status AS report_status,
        f.created_at AS report_created_at FROM v_order o JOIN v_status f ON f.order_id = o.order_id WHERE f.created_at > TIMESTAMP '{SINCE}'"""),
    "m46_lab_results": with_views(
        "v_result", body=f"""SELECT result_id, order_id, result_status, result_created_at FROM v_result
        WHERE result_created_at > TIMESTAMP '{SINCE}'"""),
    "j06_blocked_extract": with_views(
        "v_sample", "v_kit",
        body=f"""WITH load AS (SELECT DISTINCT l_orderkey AS tube, l_orderkey * 10 + l_linenumber AS id FROM lineitem),
        seq AS (SELECT l_orderkey * 10 + l_linenumber AS ssr, l_suppkey % 3 AS version FROM lineitem WHERE l_returnflag = 'A'),
        iss AS (SELECT l_orderkey * 10 + l_linenumber AS ssr, l_partkey % 3 AS version, l_suppkey % 25 AS issue_id FROM lineitem)
        SELECT s.received AS sample_received, s.sample_id, s.sample_id AS vial_barcode, k.kit_type, k.registered,
        s.sample_process_status, s.sample_id AS "tubeId", load.id AS ssr, CAST(n.n_nationkey AS INTEGER) AS issue_id, n.n_name AS issue_name
        FROM v_sample s JOIN v_kit k ON k.barcode = s.kit_barcode JOIN load ON load.tube = s.sample_id
        JOIN seq ON seq.ssr = load.id JOIN iss ON iss.ssr = seq.ssr AND iss.version = seq.version
        JOIN nation n ON n.n_nationkey = iss.issue_id
        WHERE k.barcode NOT LIKE 'study-%' AND s.received > TIMESTAMP '{SINCE}' AND s.sample_process_status <> 'final-rejected'"""),
}
