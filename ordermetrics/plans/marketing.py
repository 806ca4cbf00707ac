"""Marketing: enriched orders, recent hours, channel weeks, spend, campaigns, order cards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordermetrics.functions import classify as C
from ordermetrics.functions.predicates import ALL, filter_choices, in_days, in_year_of, moment, within_last
from ordermetrics.functions.scalars import first_present, half_even, ratio, sum_or_zero
from ordermetrics.functions.timeframe import bucket_end, days_floor, iso_week, iso_year, month_bounds, truncated
from ordermetrics.functions.vocabulary import Vocabulary
from ordermetrics.operators.calendar import fill_periods
from ordermetrics.operators.distinct import distinct_when
from ordermetrics.operators.joins import join_on
from ordermetrics.operators.metadata import joined_values, phrase_digest
from ordermetrics.operators.rank import frequency, sorted_by
from ordermetrics.operators.trend import running_total
from ordermetrics.plans.common import side_by_side

EXCLUDED = ["DRAFT"]


# Phrases the labels look for in an order's metadata (fixed values).
LABEL_PHRASES = ["sample received", "vip", "ntrf", "recollected_from", "kit_barcode_replaced"]


def label_digest(metadata: DataFrame, vocab: Vocabulary, name: str = "order_meta_values") -> DataFrame:
    """Per order, a short text that gives every label the same answer as the full metadata text."""
    phrases = [*vocab.upgrade_phrases, *LABEL_PHRASES]
    return phrase_digest(metadata, "order_id", "value", name, phrases, vocab.upgrade_phrases[0], ["v1", "v2", "v3", "v4"])


def _labelled(orders: DataFrame, metadata: DataFrame, tracking: DataFrame, order_types: DataFrame, vocab: Vocabulary,
              recent: bool, with_text: bool = False) -> DataFrame:
    # Child rows of other orders never reach the aggregation.
    own = metadata.join(orders.select("order_id"), "order_id", "left_semi")
    texts = joined_values(own, "order_id", "value", "order_meta_values") if with_text else label_digest(own, vocab)
    tagged = orders.join(texts, "order_id", "left")
    tracked = join_on(tagged, tracking, {"order_id": "order_id"}, as_text=True)
    typed = join_on(tracked, order_types.select("order_type_id", "clinical_type_name"), {"order_type_id": "order_type_id"})
    return typed.withColumns(
        {
            "created_year": F.year("created_at"),
            "multikit_stat": C.kit_type(single="Single Kit", multi="Multi Kit"),
            "mk_upg_stat": C.kit_upgrade_status(vocab=vocab),
            "upg_details": C.upgrade_detail(vocab=vocab),
            "upgrade_stat": C.upgrade_type(vocab=vocab, yes="Upgrade", no="Nonupgrade"),
            "order_id_modified": C.canonical_order_id(),
            "order_channel": C.order_channel(vocab=vocab),
            "sample_receival_stat": C.sample_status(vocab=vocab),
            "pending_items": C.pending_items(),
            "order_funnel": C.order_funnel(vocab=vocab),
            "utm_fillna": C.utm_filled(vocab=vocab, recent=recent),
        }
    )


def enriched_orders(orders: DataFrame, metadata: DataFrame, tracking: DataFrame, order_types: DataFrame, as_of,
                    excluded_states: Sequence[str] = tuple(EXCLUDED),
                    with_text: bool = False, *, vocab: Vocabulary) -> DataFrame:
    """This year's orders with every label; ``as_of=None`` takes those of all years.

    ``with_text`` adds each order's whole metadata text as ``order_meta_values``;
    without it that column holds only the phrases the labels rest on.
    """
    chosen = orders.where((F.lit(True) if as_of is None else in_year_of("created_at", as_of)) & ~F.col("state").isin(list(excluded_states)))
    return _labelled(chosen, metadata, tracking, order_types, vocab, recent=False, with_text=with_text)


HOURLY = ["clinical_type_name", "mk_upg_stat", "upgrade_stat", "multikit_stat", "order_channel", "order_flow", "utm_fillna"]


def recent_hours(orders: DataFrame, metadata: DataFrame, tracking: DataFrame, order_types: DataFrame, as_of, *, vocab: Vocabulary) -> DataFrame:
    """Orders of the last 24 hours per hour and seven attributes."""
    chosen = orders.where(
        within_last("created_at", as_of, "24 HOURS") & ~F.col("state").isin(vocab.excluded_recent_states)
    )
    labelled = _labelled(chosen, metadata, tracking, order_types, vocab, recent=True)
    counts = labelled.groupBy(truncated("hour", "created_at").alias("created_at_hour"), *HOURLY).agg(
        F.count_distinct("order_id").alias("count_order_id"),
        F.count_distinct("order_id_modified").alias("count_order_kit1only"),
    )
    return counts.orderBy(F.col("created_at_hour").desc(), *HOURLY)


def weekly_by(orders: DataFrame, label: str, labelled_weeks: bool = True) -> DataFrame:
    """First-kit orders per week and label.

    Weeks are ISO weeks with their year, so equal week numbers of different
    years stay apart; ``labelled_weeks`` adds the week's Sunday.
    """
    known = orders.where(F.col(label).isNotNull() & F.col("created_at").isNotNull())
    keys = [iso_year("created_at").alias("iso_year"), iso_week("created_at").alias("week_number")]
    if labelled_weeks:
        keys.append(bucket_end("created_at", "Weekly").alias("week_ending"))
    return known.groupBy(label, *keys).agg(F.count_distinct("order_id_modified").alias("orders"))


def weekly_by_each(orders: DataFrame, labels: Sequence[str]) -> DataFrame:
    """:func:`weekly_by` for several labels at once, as (label, value) rows.

    The orders are read and joined once; a row is repeated per label only
    inside the task that counts it.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in labels]))
    long = orders.select("created_at", "order_id_modified", pairs.alias("pair")).select(
        "created_at", "order_id_modified", "pair.label", "pair.value"
    )
    known = long.where(F.col("value").isNotNull() & F.col("created_at").isNotNull())
    keys = [iso_year("created_at").alias("iso_year"), iso_week("created_at").alias("week_number"),
            bucket_end("created_at", "Weekly").alias("week_ending")]
    return known.groupBy("label", "value", *keys).agg(F.count_distinct("order_id_modified").alias("orders"))


def weekly_spend(spend: DataFrame, day: str = "day") -> DataFrame:
    return spend.groupBy(iso_year(day).alias("iso_year"), iso_week(day).alias("week_number")).agg(
        half_even(F.sum("spend")).alias("spend")
    )


WEEK = ["iso_year", "week_number"]


def acquisition_cost(orders: DataFrame, spend_by_channel: Mapping[str, DataFrame]) -> DataFrame:
    """Weekly orders, spend and cost per order by sub-channel.

    ``spend_by_channel`` maps a sub-channel to its spend rows (day, spend).
    """
    filled = orders.withColumn("mapped_sub_channel", F.coalesce("mapped_sub_channel", F.lit("No Channel")))
    weeks = weekly_by(filled, "mapped_sub_channel", labelled_weeks=False).withColumnRenamed("orders", "kit_1_orders")
    spends = None
    for channel, rows in spend_by_channel.items():
        part = weekly_spend(rows).withColumn("mapped_sub_channel", F.lit(channel))
        spends = part if spends is None else spends.unionByName(part)
    joined = weeks.join(spends, ["mapped_sub_channel", *WEEK], "left")
    return joined.withColumn("cac", ratio("spend", "kit_1_orders"))


def channel_cost(orders: DataFrame, channel: str, spend: DataFrame) -> DataFrame:
    """Weekly cost of one channel: every week with spend, orders where there are any."""
    own = weekly_by(orders.where(F.col("mapped_sub_channel") == channel), "mapped_sub_channel", labelled_weeks=False)
    joined = weekly_spend(spend).join(own, WEEK, "left")
    return joined.withColumn("cac", ratio("spend", "orders"))


def merged_spend(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spend from the first source where present, else from the second."""
    a, b = first.withColumnRenamed("spend", "spend_x"), second.withColumnRenamed("spend", "spend_y")
    joined = a.join(b, list(keys), "full")
    return joined.withColumn("spend", first_present("spend_x", "spend_y")).drop("spend_x", "spend_y")


def blended_cost(costs: DataFrame) -> DataFrame:
    """All channels together per week."""
    totals = costs.groupBy(*WEEK).agg(
        half_even(sum_or_zero("spend")).alias("spend"), F.sum("kit_1_orders").alias("kit_1_orders")
    )
    return totals.withColumn("cac", half_even(ratio("spend", "kit_1_orders")))


def source_performance(orders: DataFrame, start, end, product: str = ALL, kit: str = ALL, upgrade: str = ALL,
                       sort_by: str = "count_of_orders", descending: bool = True) -> DataFrame:
    """Stage counts and payments by traffic source."""
    chosen = filter_choices(
        orders.where(in_days("order_created_at", start, end) & F.col("utm_source").isNotNull()),
        {"clinical_type_name": product, "kit_type": kit, "upgrade_marker": upgrade},
    )
    paid, claims = sum_or_zero("net_payment"), F.count("first_billing_date")
    output = chosen.groupBy("utm_source").agg(
        F.count("order_created_at").alias("count_of_orders"),
        F.count("ship_date").alias("count_of_shipments"),
        F.count("sample_received_date").alias("count_of_samples"),
        claims.alias("count_of_claims"),
        F.count("first_issue_date").alias("count_of_payments"),
        half_even(paid).alias("sum_of_payments"),
        half_even(ratio(paid, claims)).alias("average_payment_per_claim"),
    )
    return sorted_by(output, sort_by, "utm_source", ascending=[not descending, True])


def source_span(orders: DataFrame) -> DataFrame:
    """First tracked and last order date, the range a selector starts with."""
    return orders.agg(
        F.min(F.when(F.col("utm_campaign").isNotNull(), F.col("order_created_at"))).alias("start_date"),
        F.max("order_created_at").alias("end_date"),
    )


def campaign_days(orders: DataFrame, ts: str, campaign: str = "utm_campaign") -> DataFrame:
    """Add days since the campaign's first order.

    The start comes from a small aggregate per campaign joined back, not from
    a window over the campaign's rows.
    """
    starts = orders.where(F.col(campaign).isNotNull()).groupBy(campaign).agg(F.min(ts).alias("__start"))
    return orders.join(starts, campaign).withColumn("day", days_floor(ts, "__start")).drop("__start")


def campaign_waterfall(rows: DataFrame, measure: str, count: bool = False, campaign: str = "utm_campaign") -> DataFrame:
    """Running order count (days with orders) or running amount (every day) per campaign."""
    value = F.count(measure) if count else F.coalesce(F.sum(measure), F.lit(0))
    daily = rows.groupBy(campaign, "day").agg(value.alias("n"))
    if not count:
        daily = _fill_days(daily, campaign)
    return running_total(daily, "day", {"cumulative": "n"}, [campaign]).withColumn("cumulative", F.col("cumulative").cast("double"))


def _fill_days(daily: DataFrame, campaign: str) -> DataFrame:
    epoch = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    dated = daily.withColumn("day", (epoch + F.make_dt_interval(F.col("day").cast("int"))).cast("timestamp_ntz"))
    filled = fill_periods(dated, "day", "DAY", zero=["n"], groups=[campaign])
    return filled.withColumn("day", F.datediff("day", epoch).cast("long"))


def top_payments(rows: DataFrame, chosen: str, n: int = 5, campaign: str = "utm_campaign", tie: Sequence[str] = ("order_id",)) -> DataFrame:
    """The greatest single payments of a campaign with their payer."""
    return rows.where(F.col(campaign) == chosen).orderBy(F.col("payment").desc_nulls_last(), *tie).limit(n)


def medium_frequency(rows: DataFrame, chosen: str, campaign: str = "utm_campaign") -> DataFrame:
    return frequency(rows.where(F.col(campaign) == chosen), "utm_medium")


def _order_choices(product: str, kit: str, upgrade: str) -> dict[str, str]:
    return {"code": product, "kit_type": kit, "upgrade_type": upgrade}


def order_cards(orders: DataFrame, as_of, product: str = ALL, kit: str = ALL, upgrade: str = ALL) -> DataFrame:
    """Orders, upgrades and first-kit orders, month to date and same span of the previous month."""
    bounds = month_bounds(as_of)
    ts = F.col("order_created_at")
    chosen = filter_choices(
        orders.where((ts >= moment(bounds.previous_start)) & (ts < moment(bounds.today) + F.expr("INTERVAL 1 DAY"))),
        _order_choices(product, kit, upgrade),
    )
    current = ts >= moment(bounds.current_start)
    previous = ts < F.least(
        moment(bounds.same_day_previous) + F.expr("INTERVAL 1 DAY"), moment(bounds.current_start)
    )
    upgraded = F.col("upgrade_type") == "upgrade"
    by_order = distinct_when(
        chosen, [], "order_id",
        {
            "orders_mtd": current, "upgrades_mtd": current & upgraded,
            "orders_previous_mtd": previous, "upgrades_previous_mtd": previous & upgraded,
        },
    )
    by_kit = distinct_when(chosen, [], "kit_1_id", {"kit_1_orders_mtd": current, "kit_1_orders_previous_mtd": previous})
    return side_by_side(by_order, by_kit)


def orders_by_hour(orders: DataFrame, as_of, product: str = ALL, kit: str = ALL, upgrade: str = ALL) -> DataFrame:
    """Distinct orders by hour of day, previous and current month; no orders in a month is null."""
    bounds = month_bounds(as_of)
    ts = F.col("order_created_at")
    chosen = filter_choices(
        orders.where((ts >= moment(bounds.previous_start)) & (ts < moment(bounds.next_start))),
        _order_choices(product, kit, upgrade),
    )
    current = ts >= moment(bounds.current_start)
    hourly = distinct_when(
        chosen.withColumn("hour", F.hour("order_created_at")), ["hour"], "order_id",
        {"previous_month_hourly": ~current, "current_month_hourly": current},
    )
    return hourly.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in ("previous_month_hourly", "current_month_hourly")})
