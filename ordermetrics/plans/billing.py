"""Billing: claims, adjudication, denials, appeals, projection and goal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermetrics.functions import vocabulary as V
from ordermetrics.functions.classify import claim_prediction
from ordermetrics.functions.predicates import between_midnights, in_list, null_or_false
from ordermetrics.functions.scalars import mean, ratio
from ordermetrics.functions.timeframe import day, days_calendar
from ordermetrics.operators.joins import join_on
from ordermetrics.operators.rank import latest_per_key
from ordermetrics.operators.trend import running_total
from ordermetrics.plans.common import side_by_side


def _of_products(products: Sequence[str] | None) -> Column:
    return F.lit(True) if products is None else in_list("product", products)


def claims_generated(claims: DataFrame, start, end, products: Sequence[str] | None = None) -> DataFrame:
    """Distinct claims created in the range."""
    chosen = claims.where(between_midnights("creation_date", start, end) & _of_products(products))
    return chosen.agg(F.count_distinct("id").alias("count_claims_generated"))


def claims_submitted(claims: DataFrame, start, end, products: Sequence[str] | None = None) -> DataFrame:
    """Distinct claims billed in the range, resubmissions left out."""
    chosen = claims.where(
        null_or_false("resubmitted") & between_midnights("billing_date", start, end) & _of_products(products)
    )
    return chosen.agg(F.count_distinct("id").alias("count_claims_submitted"))


def linked_claims(payer_claims: DataFrame, links: DataFrame, claims: DataFrame,
                  products: Sequence[str] | None = None, versions: Sequence[int] | None = None,
                  billed_after: str = "2010-01-01") -> DataFrame:
    """Payer claims with the order's claim; claims billed up to ``billed_after`` are test rows."""
    billed = claims.where((F.to_date("billing_date") > F.lit(billed_after).cast("date")) & _of_products(products))
    if versions is not None:
        billed = billed.where(in_list("version", versions))
    linked = join_on(payer_claims, links, {"zc_id": "payer_claim_id"}, "inner")
    kept = billed.select("order_id", "product", "version", "billing_date")
    return join_on(linked, kept, {"order_id": "order_id"}, "inner")


def latest_benefits(linked: DataFrame, eobs: DataFrame, start, end, tie: Sequence[str] = ()) -> DataFrame:
    """The latest explanation of benefits per claim, among those issued in the range.

    Equal rows need no removal first: the rank keeps one row either way.
    """
    issued = eobs.where(between_midnights("issue_date", start, end))
    return latest_per_key(join_on(linked, issued, {"zc_id": "zc_id"}, "inner"), ["claim_id"], ["production_date"], tie)


def adjudication_totals(latest: DataFrame) -> DataFrame:
    """Claims, payments and allowed amounts over the latest benefits."""
    return latest.agg(
        F.count_distinct("claim_id").alias("count_adjudicated"),
        F.sum("payment").cast("double").alias("total_payment"),
        mean("payment").alias("avg_payment"),
        F.sum("allowed").cast("double").alias("total_allowed"),
        mean("allowed").alias("avg_allowed"),
    )


def days_to_submission(claims: DataFrame, start, end, products: Sequence[str] | None = None) -> DataFrame:
    """Mean calendar days from creation to billing, resubmissions left out."""
    chosen = claims.where(
        null_or_false("resubmitted") & between_midnights("creation_date", start, end) & _of_products(products)
    )
    return chosen.agg(mean(days_calendar("billing_date", "creation_date")).alias("avg_time_to_submission"))


def days_to_adjudication(latest: DataFrame) -> DataFrame:
    """Mean calendar days from billing to issue over the latest benefits."""
    return latest.agg(mean(days_calendar("issue_date", "billing_date")).alias("avg_time_to_adjudication"))


def latest_denials(linked: DataFrame, history: DataFrame, events: DataFrame, eobs: DataFrame, start, end) -> DataFrame:
    """Latest denial event per claim that has benefits issued in the range.

    Benefits only decide whether a claim is in range, hence a semi-join.
    """
    denied = events.where(F.col("raw_message") == V.DENIAL_MESSAGE)
    told = join_on(history, denied, {"history_id": "history_id"}, "inner")
    issued = eobs.where(between_midnights("issue_date", start, end)).select("zc_id")
    in_range = linked.join(issued, "zc_id", "left_semi")
    joined = join_on(in_range, told, {"zc_id": "zc_id"}, "inner")
    return latest_per_key(joined, ["claim_id"], ["date"], ["zc_id"])


def denied_count(latest: DataFrame) -> DataFrame:
    return latest.agg(F.count_distinct("zc_id").alias("count_denied"))


def claim_ratios(adjudicated: DataFrame, submitted: DataFrame, denied: DataFrame) -> DataFrame:
    """Adjudicated over submitted and over denied, from the three one-row results."""
    row = side_by_side(adjudicated.select("count_adjudicated"), submitted, denied)
    return row.select(
        ratio("count_adjudicated", "count_claims_submitted").alias("adjudicated_to_submitted"),
        ratio("count_adjudicated", "count_denied").alias("adjudicated_to_denied"),
    )


def appeals_by_type(sent: DataFrame, eobs: DataFrame, linked: DataFrame, first_appeals: DataFrame, start, end) -> DataFrame:
    """First appeals sent per type, where the payer answered more than five days later.

    Only the claim's latest benefits count as the answer.
    """
    latest = latest_per_key(eobs, ["zc_id"], ["production_date"], ["status_code_id"])
    answers = latest.where(between_midnights("issue_date", start, end)).select(
        F.col("zc_id").alias("answered_id"), "production_date"
    )
    answered = sent.join(
        answers,
        (sent["zc_id"] == answers["answered_id"])
        & (answers["production_date"] > sent["created_at"] + F.expr("INTERVAL 5 DAYS")),
    )
    known = join_on(answered, linked.select("zc_id"), {"zc_id": "zc_id"}, "inner")
    typed = join_on(known, first_appeals.select("zc_id", "appeal_type"), {"zc_id": "zc_id"})
    return (
        typed.groupBy(F.coalesce("appeal_type", F.lit(V.DEFAULT_APPEAL)).alias("appeal_type"))
        .agg(F.count_if(F.col("source_type") == V.FIRST_APPEAL).alias("total_first_appeal_sent"))
        .orderBy(F.col("total_first_appeal_sent").desc(), "appeal_type")
    )


def daily_submitted(claims: DataFrame, start, end) -> DataFrame:
    """Claims billed per day with running total, resubmissions left out."""
    chosen = claims.where(null_or_false("resubmitted") & between_midnights("billing_date", start, end))
    daily = chosen.groupBy(day("billing_date").alias("billing_date")).agg(F.count("id").alias("counts"))
    return running_total(daily, "billing_date", {"cumulative_sum": "counts"})


def predicted_claims(orders: DataFrame, start, end) -> DataFrame:
    """Approved orders by prediction (lower_bound, upper_bound, none)."""
    approved = orders.where(F.col("state") == "APPROVED")
    labelled = approved.select(claim_prediction("created_at", start, end).alias("prediction"))
    return labelled.groupBy("prediction").agg(F.count("prediction").alias("counts"))


def projected_range(daily: DataFrame, predictions: DataFrame) -> DataFrame:
    """Submitted total and the total expected at the end of the range."""
    total = daily.agg(F.coalesce(F.sum("counts"), F.lit(0)).alias("total"))
    bounds = predictions.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("prediction") == b, F.col("counts"))), F.lit(0)).alias(f"expected_{b}")
            for b in ("lower_bound", "upper_bound")
        ]
    )
    row = side_by_side(total, bounds)
    return row.select(
        "total",
        "expected_lower_bound",
        "expected_upper_bound",
        (F.col("total") + F.col("expected_lower_bound")).alias("projected_lower_bound"),
        (F.col("total") + F.col("expected_upper_bound")).alias("projected_upper_bound"),
    )


def gap_to_goal(daily: DataFrame, goal: int | None) -> DataFrame:
    """Claims still missing to the goal, with the report's wording (fixed texts)."""
    row = daily.agg(F.coalesce(F.sum("counts"), F.lit(0)).cast("long").alias("total"))
    if not goal:
        return row.select("total", F.lit(None).cast("long").alias("gap"), F.lit("Gap To Goal: Please Enter Goal").alias("message"))
    gap = F.lit(int(goal)) - F.col("total")
    text = F.when(gap > 0, F.concat(F.lit("Gap To Goal: "), gap.cast("string"), F.lit(" Claims"))).otherwise(
        F.lit("Gap To Goal: Goal Met!")
    )
    return row.select("total", gap.alias("gap"), text.alias("message"))
