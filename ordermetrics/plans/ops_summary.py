"""Operations summary: counts per fiscal period, by event date or by order cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermetrics.functions.classify import canonical_order_id, kit_type, relabel
from ordermetrics.functions.predicates import in_days, reached
from ordermetrics.functions.scalars import half_even, half_even_cents, sum_or_zero, thousands, thousands_float
from ordermetrics.functions.timeframe import at_zone
from ordermetrics.functions.vocabulary import Vocabulary
from ordermetrics.operators.calendar import period_keys, with_label, with_period
from ordermetrics.operators.distinct import stacked_distinct
from ordermetrics.operators.joins import join_on, with_first_child
from ordermetrics.operators.metadata import phrase_flags
from ordermetrics.operators.rank import append_rows, latest_per_key
from ordermetrics.operators.reshape import transposed
from ordermetrics.plans.common import NO_PRODUCTS, ProductCodes

PERIOD = ["period", "period_start"]

# Display names of the report columns (fixed values).
LABELS = {
    "period": "Date",
    "orders_generated": "Orders Generated",
    "orders_approved": "Orders Approved*",
    "kits_shipped": "Kits Shipped",
    "samples_accessioned": "Samples Accessioned",
    "reports_released": "Reports Released",
    "claims_billed": "Claims Billed",
    "claims_with_eob": "Claims w/ EOB (Payments)*",
    "aggregate_payment": "Aggregate Payment*",
    "average_payment": "Average Payment*",
}


def noncohort_summary(orders: DataFrame, kits: DataFrame, samples: DataFrame, reports: DataFrame, bills: DataFrame,
                      payments: DataFrame, start, end, grain: str = "Monthly", product: str | None = None,
                      codes: ProductCodes = NO_PRODUCTS, calendar: DataFrame | None = None) -> DataFrame:
    """Nine measures, each in the period of its own event date."""

    def dated(df: DataFrame, ts: str, table: str) -> DataFrame:
        chosen = codes.only(df.where(in_days(ts, start, end)), product, table)
        return with_period(chosen, ts, grain, calendar).where(F.col("period_start").isNotNull())

    keys = period_keys(calendar)
    placed = dated(orders, "order_created_at", "orders")
    paid = dated(payments, "issue_date", "payments")
    counts = stacked_distinct(
        {
            "orders_generated": (placed, F.col("order_id")),
            "orders_approved": (placed, F.when(F.col("state") == "APPROVED", F.col("order_id"))),
            "kits_shipped": (dated(kits, "ship_date", "kits"), F.col("shipment_id")),
            "samples_accessioned": (dated(samples, "sample_received", "samples"), F.col("sample_id")),
            "reports_released": (dated(reports, "report_created_at", "reports"), F.col("order_id")),
            "claims_billed": (dated(bills, "billing_date", "bills"), F.col("bill_id")),
            "claims_with_eob": (paid, F.col("claim_id")),
        },
        keys,
    )
    money = paid.groupBy(*keys).agg(
        half_even(sum_or_zero("payment")).alias("aggregate_payment"),
        half_even_cents("payment").alias("average_payment"),
    )
    return with_label(counts.join(money, keys, "full").fillna(0), grain)


def cohort_orders(orders: DataFrame, kits: DataFrame, samples: DataFrame, reports: DataFrame, bills: DataFrame,
                  payments: DataFrame) -> DataFrame:
    """Detail rows: orders with first shipment, sample, first report, bills and payments.

    Several bills and payments of one order multiply, as in the source report.
    """
    shipped = with_first_child(orders, kits.drop("type"), {"delivery_id": "order_item_id"}, ["ship_date"], ["shipment_id"])
    sampled = join_on(shipped, samples.withColumnRenamed("product", "sample_product"), {"sample_id": "sample_id"})
    reported = with_first_child(sampled, reports, {"order_id": "order_id"}, ["report_created_at"], ["status_id"])
    billed = join_on(reported, bills.withColumnRenamed("product", "bill_product"), {"order_id": "order_id"})
    paid = payments.withColumnsRenamed({"product": "payment_product", "version": "payment_version"})
    return join_on(billed, paid, {"order_id": "order_id"})


def cohort_summary(orders: DataFrame, kits: DataFrame, reports: DataFrame, bills: DataFrame, payments: DataFrame,
                   start, end, grain: str = "Monthly", product: str | None = None, codes: ProductCodes = NO_PRODUCTS,
                   calendar: DataFrame | None = None, dedupe_payments: bool = False) -> DataFrame:
    """Eight measures for the orders created in each period.

    A stage counts when its id is present. The source report multiplies an
    order's payments by its bills; the same sums come from per-order totals,
    weighted by the number of bills, so no product of rows is ever built.
    ``dedupe_payments`` counts each payment once instead.
    """
    chosen = codes.only(orders.where(in_days("order_created_at", start, end)), product, "orders")
    keys = period_keys(calendar)
    cohort = with_period(chosen, "order_created_at", grain, calendar).where(F.col("period_start").isNotNull())
    shipped = kits.where(reached("shipment_id")).select("order_item_id").distinct().withColumn("shipped", F.lit(1))
    staged = join_on(cohort.select(*keys, "order_id", "sample_id", "delivery_id"), shipped, {"delivery_id": "order_item_id"})
    # Stages meet their order in one aggregation instead of a join each: an
    # order's many reports or bills shrink before they are moved.
    facts = append_rows(
        staged.select("order_id", *keys, "shipped", reached("sample_id").cast("int").alias("sampled")),
        reports.where(reached("status_id")).select("order_id", F.lit(1).alias("released")),
        bills.where(reached("bill_id")).select("order_id", F.lit(1).alias("bill")),
    )
    flags = {"kits_shipped": "shipped", "samples_accessioned": "sampled", "reports_released": "released"}
    per_order = facts.groupBy("order_id").agg(
        *[F.max(k).alias(k) for k in keys],
        *[F.coalesce(F.max(c), F.lit(0)).alias(name) for name, c in flags.items()],
        F.coalesce(F.sum("bill"), F.lit(0)).alias("bills"),
    ).where(reached("order_id") & F.col("period_start").isNotNull())
    counts = per_order.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("orders_generated"),
        *[F.sum(name).cast("long").alias(name) for name in flags],
        F.count_if(F.col("bills") > 0).alias("claims_billed"),
    )
    weight = F.lit(1) if dedupe_payments else F.greatest(F.col("bills"), F.lit(1))
    paid = payments.select("order_id", "claim_id", "payment").join(per_order.select("order_id", *keys, weight.alias("weight")), "order_id")
    per_claim = paid.groupBy(*keys, "claim_id").agg(
        F.sum(F.col("payment") * F.col("weight")).alias("paid"),
        F.sum(F.when(reached("payment"), F.col("weight"))).alias("n"),
    )
    money = per_claim.groupBy(*keys).agg(
        F.count("claim_id").alias("claims_with_eob"),
        half_even(sum_or_zero("paid")).alias("aggregate_payment"),
        half_even(F.try_divide(F.sum("paid").cast("double"), F.sum("n").cast("double"))).alias("average_payment"),
    )
    return with_label(counts.join(money, keys, "left").fillna(0), grain)


def presented(summary: DataFrame, orientation: str = "Vertical", periods: Sequence[str] = ()) -> DataFrame:
    """Display form: grouped digits, labelled columns, newest period first.

    'Horizontal' puts metrics in rows and the given ``periods`` in columns.
    """
    metrics = [c for c in summary.columns if c not in PERIOD]
    if orientation == "Horizontal":
        wide = transposed(summary, "period", metrics, periods, "Date")
        names = F.create_map(*[F.lit(x) for m in metrics for x in (m, LABELS[m])])
        return wide.withColumns({"Date": names[F.col("Date")], **{p: thousands_float(F.col(f"`{p}`")) for p in periods}})
    money = ("aggregate_payment", "average_payment")
    text = {m: thousands_float(m) if m in money else thousands(m) for m in metrics}
    ordered = summary.withColumns(text).orderBy(F.col("period_start").desc()).drop("period_start")
    return relabel(ordered, LABELS)


# --- source extracts ------------------------------------------------------

SINCE = "2017-12-31"


def order_extract(orders: DataFrame, order_types: DataFrame, metadata: DataFrame, since: str = SINCE, *, vocab: Vocabulary) -> DataFrame:
    """Orders with type code, kit type and upgrade type; drafts left out."""
    recent = orders.where((F.col("state") != "DRAFT") & (F.col("created_at") > F.lit(since).cast("timestamp_ntz")))
    upgraded = phrase_flags(metadata, "order_id", "value", {"upgraded": vocab.upgrade_phrases})
    typed = join_on(recent, order_types, {"order_type_id": "order_type_id"}, "inner")
    return typed.join(upgraded, "order_id", "left").select(
        "order_id",
        F.col("created_at").alias("order_created_at"),
        "code",
        kit_type().alias("kit_type"),
        F.when(F.col("upgraded"), "upgrade").otherwise("nonupgrade").alias("upgrade_type"),
        canonical_order_id().alias("kit_1_id"),
        "version",
        "state",
        "sample_id",
        "delivery_id",
    )


def kit_extract(shipments: DataFrame, order_items: DataFrame, item_types: Sequence, since: str = SINCE) -> DataFrame:
    """Outgoing shipments of the given item types."""
    sent = shipments.where((F.col("type") == "NORMAL") & (F.col("ship_date") > F.lit(since).cast("timestamp_ntz")))
    items = order_items.where(F.col("item_type_id").isin(list(item_types)))
    return join_on(sent, items, {"order_id": "order_id"}, "inner").select(
        "shipment_id", F.col("order_id").alias("order_item_id"), "item_type_id", "type", "ship_date"
    )


def sample_extract(samples: DataFrame, kits: DataFrame, since: str = SINCE) -> DataFrame:
    """Received samples with their kit's product; study kits left out."""
    clinical = kits.where(~F.col("barcode").like("study-%"))
    recent = samples.where(F.col("received") > F.lit(since).cast("timestamp_ntz"))
    return join_on(recent, clinical, {"kit_barcode": "barcode"}, "inner").select(
        F.col("received").alias("sample_received"), "sample_id", F.col("kit_type").alias("product")
    )


def report_extract(orders: DataFrame, status_history: DataFrame) -> DataFrame:
    """Release events of released orders."""
    released = orders.where(F.col("state") == "RELEASED").select("order_id", "order_type_id")
    events = status_history.where(F.col("status") == "RELEASED")
    return released.join(events, "order_id").select(
        "order_id", "order_type_id", "status_id", "status", F.col("created_at").alias("report_created_at")
    )


def bill_extract(claims: DataFrame, zone: str = "America/Los_Angeles", since: str = SINCE) -> DataFrame:
    """Claims with billing time in local wall-clock time."""
    recent = claims.where(F.col("billing_date") > F.lit(since).cast("timestamp_ntz"))
    return recent.select(
        F.col("id").alias("bill_id"), "order_id", at_zone("billing_date", zone).alias("billing_date"), "product", "resubmitted"
    )


def payment_extract(linked_claims: DataFrame, eobs: DataFrame, since: str = SINCE, tie: Sequence[str] = ()) -> DataFrame:
    """Latest explanation of benefits per claim."""
    recent = eobs.where(F.col("issue_date") > F.lit(since).cast("timestamp_ntz"))
    joined = join_on(linked_claims, recent, {"zc_id": "zc_id"}, "inner")
    return latest_per_key(joined, ["claim_id"], ["production_date"], tie)
