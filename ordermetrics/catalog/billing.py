"""Billing queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermetrics.catalog.checks import ratio, with_views
from ordermetrics.catalog.views import Tables
from ordermetrics.plans import billing
from ordermetrics.session import written

START, END = "1997-01-01", "1999-12-31"
PRODUCTS = ["1-URGENT", "3-MEDIUM", "5-LOW"]
VERSIONS = [1, 2]
TIE = ["zc_id", "status_code_id", "part_id", "payer_id"]
GOAL = 5000


def _linked(t: Tables) -> DataFrame:
    return billing.linked_claims(t.payer_claims(), t.links(), t.claims(), PRODUCTS, VERSIONS, billed_after="1990-01-01")


def _latest(t: Tables, linked: DataFrame | None = None) -> DataFrame:
    return billing.latest_benefits(linked or _linked(t), t.eobs(), START, END, TIE)


def _denied(t: Tables, linked: DataFrame | None = None) -> DataFrame:
    return billing.latest_denials(linked or _linked(t), t.history(), t.claim_events(), t.eobs(), START, END)


def m14_claims_generated(spark: SparkSession, folder: str) -> DataFrame:
    return billing.claims_generated(Tables(spark, folder).claims(), START, END, PRODUCTS)


def m14_claims_submitted(spark: SparkSession, folder: str) -> DataFrame:
    return billing.claims_submitted(Tables(spark, folder).claims(), START, END, PRODUCTS)


def m15_adjudication_totals(spark: SparkSession, folder: str) -> DataFrame:
    return billing.adjudication_totals(_latest(Tables(spark, folder)))


def m16_days_to_bill(spark: SparkSession, folder: str) -> DataFrame:
    return billing.days_to_submission(Tables(spark, folder).claims(), START, END, PRODUCTS)


def m16_days_to_adjudication(spark: SparkSession, folder: str) -> DataFrame:
    return billing.days_to_adjudication(_latest(Tables(spark, folder)))


def m17_latest_denial(spark: SparkSession, folder: str) -> DataFrame:
    return billing.denied_count(_denied(Tables(spark, folder)))


def m17_denial_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _denied(Tables(spark, folder)).select("claim_id", "zc_id", "date", "product")


def m18_ratios(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    linked = written(_linked(t), "linked")  # both sides below start from it
    return billing.claim_ratios(
        billing.adjudication_totals(_latest(t, linked)),
        billing.claims_submitted(t.claims(), START, END, PRODUCTS),
        billing.denied_count(_denied(t, linked)),
    )


def m19_appeals_by_type(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return billing.appeals_by_type(t.documents_sent(), t.eobs(), _linked(t), t.first_appeals(), START, END)


def m20_daily_running(spark: SparkSession, folder: str) -> DataFrame:
    return billing.daily_submitted(Tables(spark, folder).claims(), START, END)


def m21_predictions(spark: SparkSession, folder: str) -> DataFrame:
    return billing.predicted_claims(Tables(spark, folder).orders(), START, END)


def m21_projection(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return billing.projected_range(
        billing.daily_submitted(t.claims(), START, END), billing.predicted_claims(t.orders(), START, END)
    )


def m22_gap_to_goal(spark: SparkSession, folder: str) -> DataFrame:
    return billing.gap_to_goal(billing.daily_submitted(Tables(spark, folder).claims(), START, END), GOAL)


QUERIES = {
    f.__name__: f
    for f in (
        m14_claims_generated, m14_claims_submitted, m15_adjudication_totals, m16_days_to_bill, m16_days_to_adjudication,
        m17_latest_denial, m17_denial_rows, m18_ratios, m19_appeals_by_type, m20_daily_running, m21_predictions,
        m21_projection, m22_gap_to_goal,
    )
}

# --- checking SQL ---------------------------------------------------------

_B = f"BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"
_P = "product IN ('1-URGENT', '3-MEDIUM', '5-LOW')"
_SUBMITTED = f"""SELECT count(DISTINCT id) AS count_claims_submitted FROM v_claim
  WHERE (resubmitted IS NULL OR resubmitted = false) AND billing_date {_B} AND {_P}"""
_LATEST = f"""latest AS (SELECT * FROM (SELECT l.claim_id, l.zc_id, l.billing_date, e.issue_date, e.payment, e.allowed,
  row_number() OVER (PARTITION BY l.claim_id ORDER BY e.production_date DESC, l.zc_id, e.status_code_id, e.part_id, e.payer_id) AS rk
  FROM v_linked l LEFT JOIN v_eob e ON e.zc_id = l.zc_id WHERE e.issue_date {_B} AND {_P} AND version IN (1, 2)) WHERE rk = 1)"""
_DENIAL = f"""denial AS (SELECT * FROM (SELECT l.claim_id, l.zc_id, l.product, v.l_shipdate AS date,
  row_number() OVER (PARTITION BY l.claim_id ORDER BY v.l_shipdate DESC, l.zc_id) AS rk
  FROM v_linked l JOIN lineitem v ON v.l_orderkey = l.zc_id AND v.l_returnflag = 'R'
  WHERE {_P} AND version IN (1, 2) AND EXISTS (SELECT 1 FROM v_eob e WHERE e.zc_id = l.zc_id AND e.issue_date {_B})) WHERE rk = 1)"""
_DAILY = f"""daily AS (SELECT date_trunc('day', billing_date) AS d, count(id) AS counts FROM v_claim
  WHERE (resubmitted IS NULL OR resubmitted = false) AND billing_date {_B} GROUP BY 1)"""
_PREDICTION = f"""prediction AS (SELECT CASE WHEN created_at + INTERVAL 45 DAYS >= TIMESTAMP '{START}'
    AND created_at + INTERVAL 52 DAYS < TIMESTAMP '{END}' THEN 'lower_bound'
  WHEN created_at + INTERVAL 17 DAYS < TIMESTAMP '{END}' AND created_at + INTERVAL 52 DAYS > TIMESTAMP '{END}' THEN 'upper_bound' END AS prediction
  FROM v_order WHERE state = 'APPROVED')"""

ORACLE = {
    "m14_claims_generated": with_views(
        "v_claim", body=f"SELECT count(DISTINCT id) AS count_claims_generated FROM v_claim WHERE creation_date {_B} AND {_P}"),
    "m14_claims_submitted": with_views("v_claim", body=_SUBMITTED),
    "m15_adjudication_totals": with_views(
        "v_linked", "v_eob",
        body=f"""WITH {_LATEST} SELECT count(DISTINCT claim_id) AS count_adjudicated, CAST(sum(payment) AS DOUBLE) AS total_payment,
        CAST(sum(payment) AS DOUBLE) / count(payment) AS avg_payment, CAST(sum(allowed) AS DOUBLE) AS total_allowed,
        CAST(sum(allowed) AS DOUBLE) / count(allowed) AS avg_allowed FROM latest"""),
    "m16_days_to_bill": with_views(
        "v_claim",
        body=f"""SELECT avg(date_diff('day', CAST(creation_date AS DATE), CAST(billing_date AS DATE))) AS avg_time_to_submission FROM v_claim
        WHERE (resubmitted IS NULL OR resubmitted = false) AND creation_date {_B} AND {_P}"""),
    "m16_days_to_adjudication": with_views(
        "v_linked", "v_eob",
        body=f"""WITH {_LATEST} SELECT avg(date_diff('day', CAST(billing_date AS DATE), CAST(issue_date AS DATE))) AS avg_time_to_adjudication
        FROM latest"""),
    "m17_latest_denial": with_views(
        "v_linked", "v_eob", body=f"WITH {_DENIAL} SELECT count(DISTINCT zc_id) AS count_denied FROM denial"),
    "m17_denial_rows": with_views("v_linked", "v_eob", body=f"WITH {_DENIAL} SELECT claim_id, zc_id, date, product FROM denial"),
    "m18_ratios": with_views(
        "v_linked", "v_eob",
        body=f"""WITH {_LATEST}, {_DENIAL}, sub AS ({_SUBMITTED})
        SELECT {ratio('(SELECT count(DISTINCT claim_id) FROM latest)', '(SELECT count_claims_submitted FROM sub)')} AS adjudicated_to_submitted,
        {ratio('(SELECT count(DISTINCT claim_id) FROM latest)', '(SELECT count(DISTINCT zc_id) FROM denial)')} AS adjudicated_to_denied"""),
    "m19_appeals_by_type": with_views(
        "v_linked", "v_eob",
        body=f"""WITH eobs AS (SELECT *, row_number() OVER (PARTITION BY zc_id ORDER BY production_date DESC, status_code_id) AS rk FROM v_eob),
        sent AS (SELECT l_orderkey AS zc_id, l_shipdate AS created_at, l_linenumber % 2 = 0 AS first FROM lineitem WHERE l_returnflag <> 'N'),
        fa AS (SELECT o_orderkey AS zc_id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS t FROM orders WHERE o_orderstatus <> 'P')
        SELECT coalesce(fa.t, 'medical_necessity') AS appeal_type, count(CASE WHEN ds.first THEN 1 END) AS total_first_appeal_sent
        FROM sent ds LEFT JOIN eobs se ON se.zc_id = ds.zc_id AND se.rk = 1 AND se.production_date > ds.created_at + INTERVAL 5 DAYS
        JOIN v_linked l ON l.zc_id = ds.zc_id LEFT JOIN fa ON fa.zc_id = ds.zc_id
        WHERE se.issue_date {_B} AND {_P} AND version IN (1, 2) GROUP BY 1 ORDER BY 2 DESC"""),
    "m20_daily_running": with_views(
        "v_claim",
        body=f"""WITH {_DAILY} SELECT CAST(d AS TIMESTAMP) AS billing_date, counts, CAST(sum(counts) OVER (ORDER BY d) AS BIGINT) AS cumulative_sum
        FROM daily"""),
    "m21_predictions": with_views(
        "v_order", body=f"WITH {_PREDICTION} SELECT prediction, count(prediction) AS counts FROM prediction GROUP BY 1"),
    "m21_projection": with_views(
        "v_order", "v_claim",
        body=f"""WITH {_PREDICTION}, {_DAILY}, n AS (SELECT (SELECT CAST(sum(counts) AS BIGINT) FROM daily) AS t,
        (SELECT count(*) FROM prediction WHERE prediction = 'lower_bound') AS lo, (SELECT count(*) FROM prediction WHERE prediction = 'upper_bound') AS hi)
        SELECT t AS total, lo AS expected_lower_bound, hi AS expected_upper_bound, t + lo AS projected_lower_bound, t + hi AS projected_upper_bound FROM n"""),
    "m22_gap_to_goal": with_views(
        "v_claim",
        body=f"""WITH {_DAILY}, n AS (SELECT CAST(sum(counts) AS BIGINT) AS t FROM daily) SELECT t AS total, {GOAL} - t AS gap,
        CASE WHEN {GOAL} - t > 0 THEN 'Gap To Goal: ' || ({GOAL} - t) || ' Claims' ELSE 'Gap To Goal: Goal Met!' END AS message FROM n"""),
}
