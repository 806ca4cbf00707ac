"""Laboratory operations: month-to-date, monthly series, blocked reports, turnaround."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordermetrics.functions import vocabulary as V
from ordermetrics.functions.classify import first_match, turnaround_band
from ordermetrics.functions.predicates import in_list, moment, not_in_keep_null, trailing
from ordermetrics.functions.scalars import half_even, mean, percent_text, ratio
from ordermetrics.functions.timeframe import NTZ, day, days_floor, month_bounds, parse_moment, truncated
from ordermetrics.functions.vocabulary import Vocabulary
from ordermetrics.operators.calendar import fill_periods
from ordermetrics.operators.distinct import distinct_when
from ordermetrics.operators.gaps import day_gap_sums
from ordermetrics.operators.joins import join_on, with_first_child
from ordermetrics.operators.rank import append_rows, first_per_key, top_groups
from ordermetrics.operators.trend import running_total, straight_line
from ordermetrics.plans.common import side_by_side


# --- source extracts ------------------------------------------------------

def lab_orders(orders: DataFrame, order_types: DataFrame, since: str = "2017-12-31") -> DataFrame:
    """Orders with type code; drafts left out."""
    recent = orders.where((F.col("state") != "DRAFT") & (F.col("created_at") > moment(since)))
    return join_on(recent, order_types, {"order_type_id": "order_type_id"}, "inner").select(
        "order_id", "order_flow", F.col("created_at").alias("order_created_at"), "code", "owner_id", "state",
        "prescription_id", "sample_id", "delivery_id",
    )


def lab_kits(shipments: DataFrame, order_items: DataFrame, item_types: Sequence, since: str = "2017-12-31") -> DataFrame:
    """Outgoing shipments of the given item types, keyed by delivery."""
    sent = shipments.where((F.col("type") == "NORMAL") & (F.col("ship_date") > moment(since)))
    items = order_items.where(F.col("item_type_id").isin(list(item_types)))
    return join_on(sent, items, {"order_id": "order_id"}, "inner").select(
        "shipment_id", F.col("order_id").alias("delivery_id"), "item_type_id", "ship_date"
    )


def lab_samples(samples: DataFrame, kits: DataFrame, statuses: DataFrame, since: str = "2017-12-31") -> DataFrame:
    """Received samples with process status where known; study kits left out."""
    clinical = kits.where(~F.col("barcode").like("study-%"))
    received = join_on(samples.where(F.col("received") > moment(since)), clinical, {"kit_barcode": "barcode"}, "inner")
    return join_on(received, statuses, {"sample_id": "sample_id"}).select(
        F.col("received").alias("sample_received"), "sample_id", "kit_type", "registered",
        F.col("status").alias("sample_process_status"),
    )


def lab_reports(orders: DataFrame, status_history: DataFrame, since: str = "2017-12-31") -> DataFrame:
    """Status history of orders."""
    events = status_history.where(F.col("created_at") > moment(since)).select(
        "order_id", F.col("status").alias("report_status"), F.col("created_at").alias("report_created_at")
    )
    return orders.select("order_id", "state", "sample_id", "order_type_id").join(events, "order_id")


def lab_results(results: DataFrame, since: str = "2017-12-31") -> DataFrame:
    """Result status history."""
    return results.where(F.col("created_at") > moment(since)).select(
        "result_id", "order_id", F.col("status").alias("result_status"), F.col("created_at").alias("result_created_at")
    )


def blocked_extract(samples: DataFrame, kits: DataFrame, statuses: DataFrame, loadings: DataFrame,
                    sequencing: DataFrame, sample_issues: DataFrame, issues: DataFrame,
                    since: str = "2017-12-31") -> DataFrame:
    """Pending reports with their issues; run id and version together key the issue join."""
    received = join_on(samples.where(F.col("received") > moment(since)), kits.where(~F.col("barcode").like("study-%")),
                       {"kit_barcode": "barcode"}, "inner")
    processed = join_on(received, statuses, {"sample_id": "sample_id"}, "inner")
    loaded = join_on(processed, loadings, {"vial_barcode": "tubeId"}, "inner")
    pending = join_on(loaded, sequencing.where(F.col("report_status") == "pending"), {"loading_id": "ssr"}, "inner")
    flagged = join_on(pending, sample_issues, {"loading_id": "ssr", "version": "version"}, "inner")
    return flagged.join(issues, "issue_id").select(
        F.col("received").alias("sample_received"), "sample_id", "vial_barcode", "kit_type", "registered",
        F.col("status").alias("sample_process_status"), F.col("vial_barcode").alias("tubeId"),
        F.col("loading_id").alias("ssr"), "issue_id", "issue_name",
    )


# --- month to date --------------------------------------------------------

def month_to_date(df: DataFrame, ts: str, entity: str, as_of, groups: Sequence[str] = ()) -> DataFrame:
    """Previous and current month by day: daily distinct counts, running totals, projection.

    The current month is filled up to ``as_of``; later days carry the rounded
    straight-line projection of the running total. Rows after ``as_of`` are
    not read. The day axis comes from the at most 31 counts a group has.
    """
    bounds = month_bounds(as_of)
    groups = list(groups)
    days = max(bounds.days_in_current, bounds.days_in_previous)
    window = df.where(
        (F.col(ts) >= moment(bounds.previous_start))
        & (F.col(ts) < moment(bounds.today) + F.expr("INTERVAL 1 DAY"))
    )
    current = F.col(ts) >= moment(bounds.current_start)
    daily = distinct_when(
        window.withColumn("__day", F.dayofmonth(ts)), [*groups, "__day"], entity,
        {"current": current, "previous": ~current},
    )
    packed = daily.groupBy(*groups).agg(
        F.map_from_entries(F.collect_list(F.struct("__day", F.struct("current", "previous")))).alias("__by_day")
    )
    spread = packed.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))
    counts = F.try_element_at("__by_day", F.col("day"))
    elapsed = F.col("day") <= F.lit(bounds.today.day)
    rows = spread.select(
        *groups,
        "day",
        F.coalesce(counts["previous"], F.lit(0)).alias("previous_month_daily"),
        F.when(elapsed, F.coalesce(counts["current"], F.lit(0))).alias("current_month_daily"),
    )
    totals = running_total(
        rows, "day", {"previous_month_count": "previous_month_daily", "current_month_count": "current_month_daily"}, groups
    )
    shown = totals.withColumns(
        {
            "previous_month_count": F.when(
                F.col("day") <= F.lit(bounds.days_in_previous), F.col("previous_month_count")
            ).otherwise(F.lit(0)),
            "current_month_count": F.when(elapsed, F.col("current_month_count")),
        }
    )
    fitted = straight_line(shown, "day", "current_month_count", "__fit", groups)
    ahead = ~elapsed & (F.col("day") <= F.lit(bounds.days_in_current))
    return fitted.withColumn("predicted_count", F.when(ahead, F.col("__fit"))).drop("__fit")


def first_success(orders: DataFrame, samples: DataFrame, results: DataFrame,
                  statuses: Sequence[str] = tuple(V.PROCESS_SUCCESS)) -> DataFrame:
    """First result per order whose sample has one of the process statuses."""
    processed = samples.where(in_list("sample_process_status", statuses))
    sampled = join_on(orders, processed, {"sample_id": "sample_id"}, "inner")
    first = first_per_key(results, ["order_id"], ["result_created_at"], ["result_id"])
    return join_on(sampled, first, {"order_id": "order_id"}, "inner")


def daily_digest(mtd: DataFrame, as_of, groups: Sequence[str] = (), blocked: DataFrame | None = None) -> DataFrame:
    """Yesterday's daily and month-to-date value from a month-to-date frame.

    On the first of a month yesterday lies in the previous month's columns.
    ``blocked`` (see :func:`blocked_reports`) adds the outstanding reports.
    """
    now = parse_moment(as_of)
    month = "previous" if now.day == 1 else "current"
    yesterday = month_bounds(as_of).days_in_previous if now.day == 1 else now.day - 1
    digest = mtd.where(F.col("day") == yesterday).select(
        *groups, F.col(f"{month}_month_daily").alias("daily"), F.col(f"{month}_month_count").alias("month_to_date")
    )
    if blocked is None:
        return digest
    waiting = outstanding(blocked).groupBy(*groups).agg(F.count_distinct("ssr").alias("outstanding_blocked"))
    if not groups:
        return side_by_side(digest, waiting)
    return digest.join(waiting, list(groups), "left").fillna(0, ["outstanding_blocked"])


# --- fulfilment with cutoffs ----------------------------------------------

def pipeline_cutoffs(orders: DataFrame, kits: DataFrame, samples: DataFrame, reports: DataFrame, month, as_of,
                     kit_days: int, sample_days: int, report_days: int) -> DataFrame:
    """One month's orders old enough to have finished, then those meeting each day limit in turn."""
    first = month_bounds(month)
    total = F.make_dt_interval(F.lit(int(kit_days + sample_days + report_days)))

    def limit(days: int) -> Column:
        return F.make_dt_interval(F.lit(int(days)))

    aged = orders.where(
        (F.col("order_created_at") >= moment(first.current_start))
        & (F.col("order_created_at") < moment(first.next_start))
        & (F.col("order_created_at") <= moment(as_of) - total)
    )
    # only the earliest release of a sample can meet the limit first
    released = reports.where((F.col("report_status") == "RELEASED") & (F.col("state") == "RELEASED")).groupBy(
        "sample_id"
    ).agg(F.min("report_created_at").alias("report_created_at"))
    # likewise only the last shipment sent in time; an order's many shipments go no further
    in_time = (
        join_on(aged.select("order_id", "order_created_at", "delivery_id"), kits.select("delivery_id", "ship_date"),
                {"delivery_id": "delivery_id"}, "inner")
        .where(F.col("ship_date") <= F.col("order_created_at") + limit(kit_days))
        .groupBy("order_id").agg(F.max("ship_date").alias("ship_date"))
    )
    chain = aged.select("order_id", "sample_id").join(in_time, "order_id", "left")
    chain = join_on(chain, samples.select("sample_id", "sample_received"), {"sample_id": "sample_id"})
    chain = join_on(chain, released, {"sample_id": "sample_id"})
    shipped = F.col("ship_date").isNotNull()
    received = shipped & (F.col("sample_received") <= F.col("ship_date") + limit(sample_days))
    reported = received & (F.col("report_created_at") <= F.col("sample_received") + limit(report_days))
    return distinct_when(
        chain, [], "order_id",
        {"orders": F.lit(True), "kits_shipped": shipped, "samples_accessioned": received, "reports_released": reported},
    )


# --- monthly series -------------------------------------------------------

def _as_month_ends(df: DataFrame, since: str | None) -> DataFrame:
    labelled = df.withColumn("month", F.last_day("month").cast(NTZ))
    return labelled if since is None else labelled.where(F.col("month") >= moment(since))


def monthly_count(df: DataFrame, ts: str, entity: str, since: str | None = None) -> DataFrame:
    """Distinct entities per month, empty months as 0; months labelled by their last day."""
    months = df.where(F.col(ts).isNotNull()).groupBy(truncated("month", ts).alias("month")).agg(
        F.count_distinct(entity).alias("n")
    )
    return _as_month_ends(fill_periods(months, "month", "MONTH", zero=["n"]), since)


def monthly_counts(orders: DataFrame, samples: DataFrame, results: DataFrame, reports: DataFrame, since: str | None = None,
                   success: Sequence[str] = tuple(V.PROCESS_SUCCESS), failure: Sequence[str] = tuple(V.PROCESS_FAILURES)) -> DataFrame:
    """The series ``samples``, ``processed``, ``failures``, ``released`` and ``corrected`` per month, stacked: (month, n, series).

    Every table is read once: what is known of an order or a sample meets in one aggregation by its id, whose conditional minima,
    flags and month sets combine map-side. An order then counts once in each month of a series, so no distinct count follows.
    """
    none = F.lit(None)
    month_of = lambda ts: truncated("month", ts)

    def events(df: DataFrame, **columns: Column) -> DataFrame:
        empty = {
            "order_id": none.cast(orders.schema["order_id"].dataType), "sample_id": none.cast(samples.schema["sample_id"].dataType),
            "received": none.cast(NTZ), "status": none.cast("string"), "first": none.cast(NTZ), "corrected": none.cast(NTZ),
            "released": none.cast(NTZ), "reported": none.cast("boolean"),
        }
        return df.select(*[c.alias(n) for n, c in {**empty, **columns}.items()])

    # each sample with a row for itself and one for each of its orders
    linked = join_on(samples.select("sample_id", "sample_received", "sample_process_status"), orders.select("order_id", "sample_id"), {"sample_id": "sample_id"})
    two = linked.withColumn("__of_order", F.explode(F.array(F.lit(False), F.lit(True))))
    of_order = F.col("__of_order")
    parts = [
        events(two, order_id=F.when(of_order, F.col("order_id")), sample_id=F.when(~of_order, F.col("sample_id")),
               received=F.when(~of_order, month_of("sample_received")), status=F.when(of_order, F.col("sample_process_status"))),
        events(results, order_id=F.col("order_id"), first=F.col("result_created_at").cast(NTZ),
               corrected=F.when(F.col("result_status") == "corrected", month_of("result_created_at"))),
        events(reports, order_id=F.col("order_id"), reported=F.lit(True),
               released=F.when(F.col("report_status") == "RELEASED", month_of("report_created_at"))),
    ]
    known = append_rows(*parts).where(F.col("order_id").isNotNull() | F.col("sample_id").isNotNull()).groupBy("order_id", "sample_id").agg(
        F.collect_set("received").alias("received"), F.collect_set("released").alias("released"), F.collect_set("corrected").alias("corrected"),
        F.min("first").alias("first"), F.bool_or("reported").alias("reported"),
        F.bool_or(in_list("status", success)).alias("succeeded"), F.bool_or(in_list("status", failure)).alias("failed"))
    first, no = month_of("first"), F.array().cast("array<timestamp_ntz>")
    series = {
        "samples": F.col("received"), "processed": F.when(F.col("succeeded"), F.array(first)), "failures": F.when(F.col("failed"), F.array(first)),
        "released": F.col("released"), "corrected": F.when(F.col("reported"), F.col("corrected")),
    }
    def named(name: str, at: Column) -> Column:
        return F.transform(F.coalesce(at, no), lambda m: F.struct(F.lit(name).alias("series"), m.alias("month")))

    months = F.explode(F.flatten(F.array(*[named(name, at) for name, at in series.items()])))
    counts = known.select(months.alias("m")).select("m.series", "m.month").where(F.col("month").isNotNull()).groupBy("series", "month").agg(
        F.count(F.lit(1)).alias("n"))
    return _as_month_ends(fill_periods(counts, "month", "MONTH", zero=["n"], groups=["series"]), since).select("month", "n", "series")


def _rate_rows(months: DataFrame, top: str, bottom: str) -> DataFrame:
    # The series of a filtered numerator starts and ends with its own data;
    # months outside that span have no rate.
    everything = Window.partitionBy()
    seen = F.when(F.col(top) > 0, F.col("month"))
    inside = F.col("month").between(F.min(seen).over(everything), F.max(seen).over(everything))
    return months.withColumn("rate", F.when(inside, half_even(ratio(top, bottom))))


def monthly_rate(df: DataFrame, ts: str, entity: str, condition: Column, since: str | None = None) -> DataFrame:
    """Share of distinct entities that meet the condition, per month."""
    monthly = df.where(F.col(ts).isNotNull()).withColumn("month", truncated("month", ts))
    counts = distinct_when(monthly, ["month"], entity, {"part": condition, "whole": F.lit(True)})
    filled = fill_periods(counts, "month", "MONTH", zero=["part", "whole"])
    return _as_month_ends(_rate_rows(filled, "part", "whole"), since).select("month", "rate")


def sample_return_rate(orders: DataFrame, kits: DataFrame, samples: DataFrame, since: str | None = None) -> DataFrame:
    """Distinct samples over distinct shipments by ship month.

    The sample id is the order's own; whether the sample was received plays
    no part, as in the source report, so ``samples`` need not be joined.
    """
    shipped = join_on(orders.select("delivery_id", "sample_id"), kits, {"delivery_id": "delivery_id"}, "inner")
    monthly = shipped.where(F.col("ship_date").isNotNull()).groupBy(truncated("month", "ship_date").alias("month")).agg(
        F.count_distinct("sample_id").alias("samples"), F.count_distinct("shipment_id").alias("shipments")
    )
    filled = fill_periods(monthly, "month", "MONTH", zero=["samples", "shipments"])
    rated = filled.withColumn("rate", half_even(ratio("samples", "shipments")))
    return _as_month_ends(rated, since).select("month", "rate")


def process_success_rate(orders: DataFrame, samples: DataFrame, results: DataFrame, since: str | None = None) -> DataFrame:
    """Orders with a successful sample over all orders with a result, by result month."""
    sampled = join_on(orders.select("order_id", "sample_id"), samples, {"sample_id": "sample_id"}, "inner")
    joined = join_on(sampled, results, {"order_id": "order_id"}, "inner")
    success = in_list("sample_process_status", V.PROCESS_SUCCESS)
    return monthly_rate(joined, "result_created_at", "order_id", success, since)


def correction_count(reports: DataFrame, results: DataFrame, since: str | None = None) -> DataFrame:
    """Corrected orders per correction month.

    Only whether an order has a report matters, hence a semi-join.
    """
    corrected = results.where(F.col("result_status") == "corrected")
    known = corrected.join(reports.select("order_id"), "order_id", "left_semi")
    return monthly_count(known, "result_created_at", "order_id", since)


def correction_rate(reports: DataFrame, results: DataFrame, since: str | None = None) -> DataFrame:
    """Corrected over all reported orders that have results, by report month."""
    per_order = results.groupBy("order_id").agg(
        F.max((F.col("result_status") == "corrected").cast("int")).alias("corrected")
    )
    joined = reports.select("order_id", "report_created_at").join(per_order, "order_id")
    return monthly_rate(joined, "report_created_at", "order_id", F.col("corrected") == 1, since)


def monthly_mean_days(df: DataFrame, month_of: str, later: str, earlier: str, since: str | None = None) -> DataFrame:
    """Mean whole days between two events per month of ``month_of``; empty months are null."""
    months = df.where(F.col(month_of).isNotNull()).groupBy(truncated("month", month_of).alias("month")).agg(
        half_even(mean(days_floor(later, earlier))).alias("mean_days")
    )
    return _as_month_ends(fill_periods(months, "month", "MONTH"), since)


def _pair_timeline(kits: DataFrame, ends: DataFrame, since: str | None) -> DataFrame:
    """Mean days from each ship date to each end of its delivery, by ship month and series; months without a pair are null."""
    starts = kits.select("delivery_id", "ship_date", truncated("month", "ship_date").alias("month"))
    sums = day_gap_sums(starts, ends, ["delivery_id"], ["series", "month"], "ship_date", "ended", "n")
    means = sums.select("series", "month", half_even(ratio("gap_days", "gap_pairs")).alias("mean_days"))
    return _as_month_ends(fill_periods(means, "month", "MONTH", groups=["series"]), since)


def _accessions(orders: DataFrame, samples: DataFrame) -> DataFrame:
    """When the samples of a delivery's patient orders were received; without a time where they weren't."""
    patient = orders.where(not_in_keep_null("order_flow", V.TRANSCRIBED_FLOWS))
    linked = patient.groupBy("delivery_id", "sample_id").agg(F.count(F.lit(1)).alias("n"))
    received = join_on(linked, samples.select("sample_id", F.col("sample_received").alias("ended")), {"sample_id": "sample_id"})
    return received.select(F.lit("accession").alias("series"), "delivery_id", "ended", "n")


def _releases(orders: DataFrame, samples: DataFrame, reports: DataFrame) -> DataFrame:
    """When the reports of a delivery's known samples were released, each as often as orders, samples and reports say."""
    released = reports.where((F.col("report_status") == "RELEASED") & (F.col("state") == "RELEASED"))
    linked = orders.groupBy("delivery_id", "sample_id").agg(F.count(F.lit(1)).alias("orders"))
    known = samples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("samples"))
    dates = released.groupBy("sample_id", F.col("report_created_at").alias("ended")).agg(F.count(F.lit(1)).alias("reports"))
    ends = join_on(join_on(linked, known, {"sample_id": "sample_id"}, "inner"), dates, {"sample_id": "sample_id"}, "inner")
    return ends.select(F.lit("release").alias("series"), "delivery_id", "ended", (F.col("orders") * F.col("samples") * F.col("reports")).alias("n"))


def accession_timeline(orders: DataFrame, kits: DataFrame, samples: DataFrame, since: str | None = None) -> DataFrame:
    """Mean days from shipping to accession; transcribed order flows left out."""
    return _pair_timeline(kits, _accessions(orders, samples), since).drop("series")


def process_turnaround(orders: DataFrame, samples: DataFrame, results: DataFrame, since: str | None = None) -> DataFrame:
    """Mean days from accession to the order's first result, by accession month."""
    # of the first result only its time counts, so no rows are ranked
    first = results.groupBy("order_id").agg(F.min("result_created_at").alias("result_created_at"))
    received = samples.select("sample_id", "sample_received")
    sampled = join_on(orders.select("order_id", "sample_id"), received, {"sample_id": "sample_id"}, "inner")
    joined = join_on(sampled, first, {"order_id": "order_id"}, "inner")
    return monthly_mean_days(joined, "sample_received", "result_created_at", "sample_received", since)


def release_timeline(orders: DataFrame, kits: DataFrame, samples: DataFrame, reports: DataFrame,
                     since: str | None = None) -> DataFrame:
    """Mean days from shipping to release, by ship month."""
    return _pair_timeline(kits, _releases(orders, samples, reports), since).drop("series")


def shipping_timelines(orders: DataFrame, kits: DataFrame, samples: DataFrame, reports: DataFrame,
                       since: str | None = None) -> DataFrame:
    """Both timelines from shipping, as series ``accession`` and ``release`` of one pass over shipments and ends."""
    ends = append_rows(_accessions(orders, samples), _releases(orders, samples, reports))
    return _pair_timeline(kits, ends, since)


# --- blocked reports ------------------------------------------------------

def blocked_reports(orders: DataFrame, kits: DataFrame, blocked: DataFrame, issue_types: DataFrame, tie: Sequence[str] = ("shipment_id",), *, vocab: Vocabulary) -> DataFrame:
    """Blocked reports of open orders with first shipment and issue type."""
    kept = orders.where(F.col("order_id").isNotNull() & not_in_keep_null("state", vocab.closed_report_states))
    shipped = with_first_child(kept, kits, {"delivery_id": "delivery_id"}, ["ship_date"], tie)
    return join_on(join_on(blocked, shipped, {"sample_id": "sample_id"}, "inner"), issue_types, {"issue_id": "issue_id"})


def outstanding(blocked: DataFrame) -> DataFrame:
    """Blocked reports whose issue is not merely informative."""
    return blocked.where(not_in_keep_null("issue_type", [V.UNINFORMATIVE_ISSUE]))


def outstanding_counts(blocked: DataFrame, kit_types: Mapping[str, object], groups: Sequence[str] = ()) -> DataFrame:
    """Distinct outstanding runs per product, one column each."""
    return distinct_when(
        outstanding(blocked), groups, "ssr",
        {f"{name}_count": F.col("kit_type") == F.lit(code) for name, code in kit_types.items()},
    )


def recent_days(daily: DataFrame, as_of, days: int = 30, date: str = "date") -> DataFrame:
    """The stored daily counts of the last days."""
    return daily.where(trailing(date, as_of, f"{int(days)} DAYS"))


def blocked_by_issue(blocked: DataFrame, n: int = 10) -> DataFrame:
    """Issues with the most distinct outstanding runs."""
    known = outstanding(blocked).where(F.col("issue_type_description").isNotNull())
    return top_groups(known, "issue_type_description", F.count_distinct("ssr"), n, "runs")


# --- turnaround -----------------------------------------------------------

BAND_COLUMNS = ["up_to_7_days", "days_8_to_14", "days_15_or_more"]


def turnaround_table(samples: DataFrame, product: str, received: str, released: str, as_of,
                     display: str = "counts") -> DataFrame:
    """Products by turnaround band for samples received in the previous month."""
    bounds = month_bounds(as_of)
    window = samples.where(
        (F.col(received) >= moment(bounds.previous_start)) & (F.col(received) < moment(bounds.current_start))
    )
    banded = window.withColumn("__band", turnaround_band(days_floor(released, received)))
    names = [name for name, _ in V.TURNAROUND_BANDS]
    counts = distinct_when(banded, [product], "sample_id",
                           {c: F.col("__band") == name for c, name in zip(BAND_COLUMNS, names, strict=True)})
    table = counts.withColumn("total_accessioned", sum((F.col(c) for c in BAND_COLUMNS), F.lit(0)))
    if display == "percentages":
        table = table.withColumns({c: ratio(c, "total_accessioned") * 100 for c in BAND_COLUMNS})
    return table.select(product, "total_accessioned", *BAND_COLUMNS)
