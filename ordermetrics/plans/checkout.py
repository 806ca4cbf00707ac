"""Checkout and carts: orders per bucket, ratios, cart counts, program cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordermetrics.functions.classify import (
    canonical_order_id,
    code_label,
    first_match,
    kit_type,
    paid_category,
    program_category,
    sample_flag,
    value_has_upgrade_phrase,
)
from ordermetrics.functions.predicates import after_until, in_days, in_year_of, since_week_of, trailing, where_optional
from ordermetrics.functions.scalars import ratio
from ordermetrics.functions.timeframe import bucket, bucket_end, day, days_calendar, truncated
from ordermetrics.functions.vocabulary import Vocabulary
from ordermetrics.operators.calendar import fill_periods
from ordermetrics.operators.joins import join_on
from ordermetrics.operators.metadata import condition_flags
from ordermetrics.operators.prefix import numbered, running_sum
from ordermetrics.operators.reshape import long_to_wide

DATE = "cart_created_date"


def cart_range(carts: DataFrame, start, end, product: str = "All") -> DataFrame:
    chosen = carts.where(in_days(DATE, start, end))
    return chosen if product.lower() == "all" else chosen.where(F.col("product") == product)


def orders_by(carts: DataFrame, frequency: str, category: str, labels: str = "left") -> DataFrame:
    """Distinct orders per time bucket and source or program.

    ``labels='right'`` uses week-ending and month-end labels instead.
    """
    place = bucket if labels == "left" else bucket_end
    known = carts.where(F.col(DATE).isNotNull() & F.col(category).isNotNull())
    return known.groupBy(place(DATE, frequency).alias(DATE), category).agg(
        F.count_distinct("order_id_modified").alias("orders")
    )


def orders_by_wide(long: DataFrame, category: str, values: Sequence[str], as_of=None, days: int = 30,
                   names: Mapping[str, str] | None = None) -> DataFrame:
    """One column per source or program, limited to the last days."""
    recent = long if as_of is None else long.where(trailing(DATE, as_of, f"{int(days)} DAYS"))
    wide = long_to_wide(recent, DATE, category, "orders", values)
    return wide.withColumnsRenamed(dict(names or {}))


_UNITS = {"daily": "DAY", "weekly": "WEEK", "monthly": "MONTH"}


def _ratio_by(carts: DataFrame, frequency: str, category: str | None, top: Column, bottom: str, names: Sequence[str]) -> DataFrame:
    # Both counts come from one frame, so one aggregation replaces two and the
    # outer join that would line them up.
    keys = [bucket(DATE, frequency).alias(DATE)] + ([F.col(category)] if category else [])
    known = carts.where(F.col(DATE).isNotNull())
    known = known.where(F.col(category).isNotNull()) if category else known
    counts = known.groupBy(*keys).agg(F.count_distinct(top).alias(names[0]), F.count_distinct(bottom).alias(names[1]))
    if category is None:
        counts = fill_periods(counts, DATE, _UNITS[frequency.lower()], zero=list(names[:2]))
    return counts.withColumn(names[2], ratio(names[0], names[1]))


def orders_to_carts(carts: DataFrame, frequency: str, category: str | None = None) -> DataFrame:
    """Distinct orders over distinct carts per bucket (and source)."""
    return _ratio_by(carts, frequency, category, F.col("order_id_modified"), "cart_id",
                     ["orders", "carts", "orders_to_cart_ratio"])


def received_to_shipped(carts: DataFrame, frequency: str, within_days: int, category: str | None = None) -> DataFrame:
    """Samples received within the day limit over kits shipped per bucket."""
    in_time = F.when(F.col("kit_received_time_in_days") <= int(within_days), F.col("sample_id"))
    return _ratio_by(carts, frequency, category, in_time, "delivery_id",
                     ["samples", "shipments", "sample_received_to_kit_shipped_ratio"])


def cart_ratio_query(carts: DataFrame, unit: str = "day", extra: Column | None = None) -> DataFrame:
    """Stored-query form: orders to carts per truncated day or week and source, newest first."""
    base = where_optional(carts, extra)
    counts = base.groupBy(truncated(unit, DATE).alias(DATE), "source").agg(
        ratio(F.count_distinct("order_id_modified"), F.count_distinct("cart_id")).alias("orders_to_cart_ratio")
    )
    return counts.orderBy(F.col(DATE).desc(), "source")


def cart_number(carts: DataFrame, extra: Column | None = None) -> DataFrame:
    """Distinct carts per day and program, newest first."""
    base = where_optional(carts, extra)
    return base.groupBy(day(DATE).alias(DATE), "program").agg(F.count_distinct("cart_id").alias("cart_number")).orderBy(
        F.col(DATE).desc(), "program"
    )


def cart_totals(numbers: DataFrame, start, end) -> DataFrame:
    """Cart counts per program over a left-open range."""
    return numbers.where(after_until(DATE, start, end) & F.col("program").isNotNull()).groupBy("program").agg(
        F.sum("cart_number").alias("cart_number")
    )


def state_counts(orders: DataFrame, unit: str = "day") -> DataFrame:
    """Distinct orders per period and state, newest first."""
    return orders.groupBy(truncated(unit, "created_at").alias("created"), "state").agg(
        F.count_distinct("order_id").alias("n")
    ).orderBy(F.col("created").desc(), "state")


def program_orders(carts: DataFrame, orders: DataFrame, order_types: DataFrame, metadata: DataFrame, shipments: DataFrame, samples: DataFrame,
                   *, vocab: Vocabulary) -> DataFrame:
    """Carts with their order and its clinical type, first labels, kit number and return time.

    Every cart is kept. A sample without a receipt time counts from its arrival. Kits of a prescription are numbered by delivery, then
    creation; single kits are number 1 and never enter a shared window.
    """
    keyed = orders.withColumn("use_for_join", canonical_order_id())
    upgraded = condition_flags(metadata, "order_id", {"upgraded": value_has_upgrade_phrase("value", vocab=vocab)})
    typed = join_on(keyed, order_types.select("order_type_id", "clinical_type_name"), {"order_type_id": "order_type_id"})
    tagged = typed.join(upgraded, "order_id", "left")
    sent = shipments.where(F.col("type") == "NORMAL").select("delivery_id", "ship_date", "delivered_date")
    shipped = join_on(tagged, sent, {"delivery_id": "delivery_id"}, spread=["order_id"])
    received = join_on(shipped, samples.select("sample_id", F.coalesce("received", "arrived").alias("sample_received_date")),
                       {"sample_id": "sample_id"}, spread=["order_id"])
    cart = carts.select("cart_id", "product", DATE, "program", "source", F.col("order_id_modified").alias("use_for_join"))
    overlapping = [c for c in cart.columns if c != "use_for_join"]
    # most carts have no order
    joined = join_on(cart, received.drop(*overlapping), {"use_for_join": "use_for_join"}, spread=["cart_id", DATE]).withColumn(
        "__single", F.when(F.col("prescription_id").isNull(), F.coalesce("order_id", "cart_id"))
    )
    counted = numbered(
        joined, ["prescription_id", "__single"], ["delivered_date", "created_at", "order_id", "cart_id", "ship_date"], "__number")
    kit_number = first_match(
        [
            (F.col("prescription_id").isNull() & F.col("order_id").isNull(), None),
            (F.col("prescription_id").isNotNull(), F.col("__number")),
        ],
        1,
    )
    status = first_match(
        [
            (F.col("order_id").isNull(), None),
            (F.coalesce("upgraded", F.lit(False)), "Upgrade"),
            (F.col("prescription_id").isNotNull(), "Multi Kit"),
        ],
        "Single Kit",
    )
    return counted.withColumns(
        {
            "kit_received_time_in_days": days_calendar("sample_received_date", "delivered_date"),
            "program_category": program_category(),
            "kit_number": kit_number.cast("long"),
            "mk_upg_stat": status,
            "sample_receival_stat": sample_flag(),
        }
    ).drop("__single", "__number", "upgraded")


def weekly_program_orders(carts: DataFrame, orders: DataFrame, as_of, days: int = 31) -> DataFrame:
    """First-kit orders per week and program since the week ``days`` before ``as_of``.

    Of the wide rows above only the order's existence is counted, so carts
    meet one row per canonical order id instead.
    """
    recent = carts.where(since_week_of(DATE, as_of, days) & F.col("source").isNotNull())
    known = orders.select(canonical_order_id().alias("ordered_id")).distinct()
    joined = join_on(recent.select(DATE, "program", "order_id_modified"), known.withColumn("found", F.lit(True)),
                     {"order_id_modified": "ordered_id"}, spread=[DATE, "program"])
    return joined.groupBy(truncated("week", DATE).alias(DATE), program_category().alias("program_category")).agg(
        F.count_distinct(F.when(F.col("found"), F.col("order_id_modified"))).alias("kit1_count_of_orders_generated")
    )


def completed_checkouts(carts: DataFrame, orders: DataFrame, tracking: DataFrame, metadata: DataFrame, as_of,
                        unit: str = "day", limit: int | None = None, *, vocab: Vocabulary) -> DataFrame:
    """This year's carts that led to an order, with acquisition category and upgrade flag.

    ``limit`` keeps the first rows by order, cart day and all other columns, so equal inputs give equal rows; the sort before
    it keeps only that many rows in each task.
    """
    done = carts.where(in_year_of("created_at", as_of) & (F.col("order_id").isNotNull() | F.col("prescription_id").isNotNull()))
    cart = done.select(
        truncated(unit, "created_at").alias("created_date"),
        canonical_order_id().alias("order_id_coalesced"),
        "product",
        kit_type(single="SingleKit", multi="MultiKit").alias("mk_sk"),
    )
    tracked = join_on(orders, tracking.select("order_id", "utm_source", "utm_medium"), {"order_id": "order_id"})
    upgraded = condition_flags(metadata, "order_id", {"upgraded": F.col("value").isin(vocab.upgrade_labels)})
    tagged = tracked.join(upgraded, "order_id", "left")
    order = tagged.select(
        canonical_order_id().alias("order_id_coalesced"), "order_id", "state", "order_flow", "utm_source", "utm_medium",
        paid_category(vocab=vocab).alias("mapped_category"),
        F.when(F.col("upgraded"), F.lit("Upgrade")).alias("upg_status"),
    )
    joined = cart.join(order, "order_id_coalesced", "left")
    if limit is None:
        return joined
    first = ["order_id_coalesced", "created_date", "order_id"]
    return joined.orderBy(*[F.col(c).asc_nulls_last() for c in [*first, *[c for c in joined.columns if c not in first]]]).limit(limit)


def cash_pay(carts: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cash-pay carts and orders."""
    flow = F.col("order_flow")
    return carts.where(F.col("program") == "cash_pay_program"), orders.where(flow.like("%cashpay%") | flow.like("%cash%"))


def cumulative_ids(df: DataFrame, ident: str, ts: str = "created_at", groups: Sequence[str] = ()) -> DataFrame:
    """Running total of the distinct ids of each timestamp, per group or overall.

    Timestamps may be as many as rows, so the sum runs over ranges of them.
    """
    moments = df.where(F.col(ts).isNotNull()).groupBy(*groups, ts).agg(F.count_distinct(ident).alias("n"))
    return running_sum(moments, list(groups), [ts], "n", "cumulative")


def id_counts(df: DataFrame, group: str, idents: Sequence[str]) -> DataFrame:
    """Non-null ids per source."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*[F.count(c).alias(c) for c in idents])


def step_totals(carts: DataFrame, orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Carts, orders, kits sent and kits returned, each with its share of the step before."""
    steps = [
        ("1. Carts", carts.agg(F.count_distinct("cart_id").alias("total"))),
        ("2. Orders", orders.agg(F.count_distinct("order_id").alias("total"))),
        ("3. Kits Sent", shipments.where(F.col("type") == "NORMAL").agg(F.count_distinct("order_id").alias("total"))),
        ("4. Kits Returned", shipments.where(F.col("type") == "RETURN").agg(F.count_distinct("order_id").alias("total"))),
    ]
    frames = [frame.select(F.lit(name).alias("step"), "total") for name, frame in steps]
    stacked = frames[0]
    for frame in frames[1:]:
        stacked = stacked.unionByName(frame)
    before = F.lag("total").over(Window.partitionBy().orderBy("step"))
    return stacked.withColumn("conversion", ratio("total", before))
