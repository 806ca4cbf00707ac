"""Marketing queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermetrics.catalog.checks import half_even_money, ratio, with_views
from ordermetrics.catalog.views import AS_OF, EVENTS_AS_OF, TEST_NAMES, Tables
from ordermetrics.functions import classify as C
from ordermetrics.operators.distinct import distinct_domain
from ordermetrics.operators.joins import aligned_series, join_on, with_first_child
from ordermetrics.operators.rules import MISSING, labelled
from ordermetrics.plans import marketing
from ordermetrics.session import scratch_folder

# The order table's clock lies before the tracking start, so it is moved.
VOCAB = replace(TEST_NAMES, utm_start="1998-01-01")
YEAR = "1999-07-15"
START, END = "1996-01-01", "2000-12-31"


def _enriched(t: Tables, as_of: str = YEAR) -> DataFrame:
    return marketing.enriched_orders(t.orders(), t.metadata(), t.tracking(), t.order_types(), as_of, vocab=VOCAB)


def m32_enriched_orders(spark: SparkSession, folder: str) -> DataFrame:
    rows = _enriched(Tables(spark, folder))
    return rows.select(
        "order_id", "created_at", "created_year", "clinical_type_name", "utm_source", "utm_medium",
        "multikit_stat", "mk_upg_stat", "upg_details", "upgrade_stat", "order_id_modified", "order_channel",
        "sample_receival_stat", "pending_items", "order_funnel", "utm_fillna",
    )


def m32_metadata_text(spark: SparkSession, folder: str) -> DataFrame:
    """The variant that carries each order's metadata text; more states left out."""
    t = Tables(spark, folder)
    rows = marketing.enriched_orders(
        t.orders(), t.metadata(), t.tracking(), t.order_types(), YEAR, VOCAB.excluded_recent_states, vocab=VOCAB, with_text=True
    )
    return rows.select("order_id", "order_meta_values", "upg_details", "order_funnel", "utm_fillna")


def m32_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All years' orders per label combination."""
    t = Tables(spark, folder)
    orders = t.orders().where(F.col("created_at").between(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("2001-12-31 23:59:59").cast("timestamp_ntz")))
    rows = marketing.enriched_orders(orders, t.metadata(), t.tracking(), t.order_types(), None, vocab=VOCAB)
    return rows.groupBy(*LABELS).agg(F.count(F.lit(1)).alias("n"))


LABELS = ["mk_upg_stat", "upg_details", "order_channel", "sample_receival_stat", "pending_items", "order_funnel", "utm_fillna"]


def m33_last24h_hourly(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    orders = t.orders().withColumn(
        # order dates carry no time of day; spread them over the day
        "created_at", F.col("created_at") + F.make_dt_interval(F.lit(0), (F.col("order_id") % 24).cast("int"))
    )
    return marketing.recent_hours(orders, t.metadata(), t.tracking(), t.order_types(), AS_OF, vocab=VOCAB)


def c10_utm_from_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Traffic source read from page addresses, inferred with the page's host as medium where none is tracked."""
    pages = Tables(spark, folder).raw("pages")
    source, host = F.try_parse_url("url", F.lit("QUERY"), F.lit("utm_source")), F.try_parse_url("url", F.lit("HOST"))
    nothing, later = F.lit(None).cast("string"), F.lit("2024-01-01").cast("timestamp_ntz")
    filled = C.utm_filled(source, host, nothing, nothing, later, vocab=VOCAB)
    labels = pages.select(source.alias("utm_source"), filled.alias("filled"))
    return labels.groupBy("utm_source", "filled").agg(F.count(F.lit(1)).alias("n"))


def c11_utm_mapping(spark: SparkSession, folder: str) -> DataFrame:
    tracking = C.with_utm_mapping(Tables(spark, folder).tracking(), vocab=VOCAB)
    mapped = ["mapped_category", "mapped_channel", "mapped_sub_channel"]
    return tracking.groupBy("utm_source", "utm_medium", *mapped).agg(F.count(F.lit(1)).alias("n"))


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """Rules as a deployment has them: a table that is read."""
    path = scratch_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def c11_utm_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The utm labels by a stored rule table."""
    rules = _stored(C.utm_rule_table(spark, VOCAB), "rules")
    tracking = labelled(Tables(spark, folder).tracking(), rules, ["utm_source", "utm_medium"], C.UTM_LABELS)
    return tracking.groupBy("utm_source", "utm_medium", *C.UTM_LABELS).agg(F.count(F.lit(1)).alias("n"))


def c11_wildcard_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rules with wildcards below and above the exact ones, paid pairs between them."""
    paid = C.paid_rule_table(spark, VOCAB).withColumn("priority", F.lit(5))
    more = spark.createDataFrame(
        [("google", None, 1, "any google"), (None, "email", 2, "any email"), (None, None, 0, "anything"), (MISSING, None, 9, "no source"), ("google", "cpc", 7, "google cpc")],
        paid.schema)
    rows = labelled(Tables(spark, folder).tracking(), _stored(paid.unionByName(more), "rules"), ["utm_source", "utm_medium"], ["mapped_category"])
    return rows.groupBy("utm_source", "utm_medium", "mapped_category").agg(F.count(F.lit(1)).alias("n"))


def _mapped_orders(t: Tables) -> DataFrame:
    """Every order of every year with funnel stage and mapped channel."""
    orders = t.orders().where("state <> 'DRAFT'")
    tracked = join_on(orders, t.tracking().drop("utm_campaign"), {"order_id": "order_id"})
    flags = t.metadata().groupBy("order_id").agg(F.bool_or(F.col("value") == "Sample Received").alias("got"))
    staged = tracked.join(flags, "order_id", "left").withColumn("order_meta_values", F.when(F.col("got"), F.lit("sample received")))
    return C.with_utm_mapping(staged, vocab=VOCAB).withColumns(
        {"order_id_modified": C.canonical_order_id(), "order_funnel": C.order_funnel(vocab=VOCAB)}
    )


def m34_weekly_channel(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly orders by category, channel, sub-channel and funnel stage, stacked."""
    labels = ["mapped_category", "mapped_channel", "mapped_sub_channel", "order_funnel"]
    return marketing.weekly_by_each(_mapped_orders(Tables(spark, folder)), labels)


def m34_weekly_category(spark: SparkSession, folder: str) -> DataFrame:
    return marketing.weekly_by(_mapped_orders(Tables(spark, folder)), "mapped_category")


def _costs(t: Tables) -> DataFrame:
    # spend rows are moved to the orders' years so that weeks meet
    def moved(event_type: str) -> DataFrame:
        return t.spend(event_type).withColumn("day", F.col("day") - F.expr("INTERVAL 24 YEARS"))

    return marketing.acquisition_cost(_mapped_orders(t), {"Google": moved("click"), "Facebook": moved("view")})


def m35_cac(spark: SparkSession, folder: str) -> DataFrame:
    return _costs(Tables(spark, folder))


def m35_blended(spark: SparkSession, folder: str) -> DataFrame:
    return marketing.blended_cost(_costs(Tables(spark, folder)))


def m35_channel_cost(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    spend = t.spend("view").withColumn("day", F.col("day") - F.expr("INTERVAL 24 YEARS"))
    rows = marketing.channel_cost(_mapped_orders(t), "Facebook", spend)
    return rows.withColumn("orders", F.col("orders").cast("double"))


def _performance_rows(t: Tables) -> DataFrame:
    """One row per order with stage dates, payments and tracking."""
    orders = t.orders().select("order_id", F.col("created_at").alias("order_created_at"), "prescription_id", "delivery_id", "sample_id", "owner_id")
    segments = join_on(orders, t.segments(), {"owner_id": "owner_id"}).withColumnRenamed("product", "clinical_type_name")
    tracked = join_on(segments, t.tracking(), {"order_id": "order_id"})
    first_ship = t.shipments().where("type = 'NORMAL'").groupBy("delivery_id").agg(F.min("ship_date").alias("ship_date"))
    received = t.samples().select("sample_id", F.col("received").alias("sample_received_date"))
    billed = t.claims().where("resubmitted IS NULL OR NOT resubmitted").select("order_id", F.col("billing_date").alias("first_billing_date"))
    paid = t.eobs().groupBy(F.col("zc_id").alias("order_id")).agg(F.min("issue_date").alias("first_issue_date"), F.sum("payment").alias("net_payment"))
    rows = join_on(join_on(tracked, first_ship, {"delivery_id": "delivery_id"}), received, {"sample_id": "sample_id"})
    return rows.join(billed, "order_id", "left").join(paid, "order_id", "left").withColumns(
        {"kit_type": C.kit_type(), "upgrade_marker": F.when(F.col("order_id") % 5 == 0, "upgrade").otherwise("nonupgrade")}
    )


def r03_merged_spend(spark: SparkSession, folder: str) -> DataFrame:
    """Daily spend of two sources as one series, the first wins where both have the day."""
    t = Tables(spark, folder)

    def daily(event_type: str, days: str) -> DataFrame:
        return t.spend(event_type).groupBy(F.date_trunc("day", "day").cast("timestamp_ntz").alias("day")).agg(F.sum("spend").cast("double").alias("spend")).where(days)

    return marketing.merged_spend(daily("click", "day(day) % 3 <> 0"), daily("view", "day(day) % 2 = 0"), ["day"])


def j08_aligned_series(spark: SparkSession, folder: str) -> DataFrame:
    """Three event series side by side on their days."""
    t = Tables(spark, folder)
    at = F.date_trunc("day", "ts").cast("timestamp_ntz")
    sources = {
        kind: (t.raw("events").where((F.col("event_type") == kind) & (F.day(at) % n != 0)), F.lit(1))
        for n, kind in enumerate(("click", "view", "purchase"), 2)
    }
    return aligned_series(sources, {"day": at})


def a14_source_domain(spark: SparkSession, folder: str) -> DataFrame:
    """The values a source selector offers."""
    return distinct_domain(Tables(spark, folder).tracking(), "utm_source")


def m36_source_performance(spark: SparkSession, folder: str) -> DataFrame:
    rows = _performance_rows(Tables(spark, folder))
    return marketing.source_performance(rows, START, END, kit="multikit", sort_by="sum_of_payments")


def m36_source_span(spark: SparkSession, folder: str) -> DataFrame:
    return marketing.source_span(_performance_rows(Tables(spark, folder)))


def _campaign_rows(t: Tables) -> DataFrame:
    orders = join_on(t.orders().select("order_id", "created_at"), t.tracking(), {"order_id": "order_id"}, "inner")
    eobs = t.eobs().groupBy(F.col("zc_id").alias("order_id")).agg(F.sum("payment").alias("payment"), F.min("payer_id").alias("payer_id"))
    return marketing.campaign_days(orders.join(eobs, "order_id", "left"), "created_at")


def m37_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    """Running payments on every day of each campaign."""
    rows = marketing.campaign_waterfall(_campaign_rows(Tables(spark, folder)), "payment")
    return rows.withColumn("n", F.col("n").cast("double"))


def m37_order_waterfall(spark: SparkSession, folder: str) -> DataFrame:
    return marketing.campaign_waterfall(_campaign_rows(Tables(spark, folder)), "order_id", count=True)


def m38_top_payers(spark: SparkSession, folder: str) -> DataFrame:
    rows = marketing.top_payments(_campaign_rows(Tables(spark, folder)).where("payment IS NOT NULL"), "campaign-1")
    return rows.select("order_id", "payer_id", F.col("payment").cast("double").alias("payment"))


def m38_medium_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return marketing.medium_frequency(_campaign_rows(Tables(spark, folder)), "campaign-1")


def _card_orders(t: Tables) -> DataFrame:
    return t.orders().select(
        "order_id", F.col("created_at").alias("order_created_at"), C.kit_type().alias("kit_type"),
        C.canonical_order_id().alias("kit_1_id"), F.col("source").alias("code"),
        F.when(F.col("order_id") % 3 == 0, "upgrade").otherwise("nonupgrade").alias("upgrade_type"),
    )


def m39_mtd_cards(spark: SparkSession, folder: str) -> DataFrame:
    return marketing.order_cards(_card_orders(Tables(spark, folder)), AS_OF)


def m39_mtd_cards_multikit(spark: SparkSession, folder: str) -> DataFrame:
    return marketing.order_cards(_card_orders(Tables(spark, folder)), "2001-03-31", kit="multikit")


def m40_hour_of_day(spark: SparkSession, folder: str) -> DataFrame:
    """Sign-ups by hour; the previous month of the events table is empty."""
    events = Tables(spark, folder).raw("events").selectExpr(
        "event_id AS order_id", "ts AS order_created_at", "'any' AS code", "'any' AS kit_type", "'any' AS upgrade_type"
    )
    shifted = events.withColumn("order_created_at", F.col("order_created_at") - F.expr("INTERVAL 14 DAYS"))
    rows = marketing.orders_by_hour(shifted, "2024-01-15")
    return rows.withColumns({c: F.col(c).cast("double") for c in ("previous_month_hourly", "current_month_hourly")})


QUERIES = {
    f.__name__: f
    for f in (
        m32_enriched_orders, m32_metadata_text, m32_label_counts, m33_last24h_hourly, c10_utm_from_pages, c11_utm_mapping, c11_utm_rules, c11_wildcard_rules, m34_weekly_channel,
        m34_weekly_category, m35_cac, m35_blended, m35_channel_cost, m36_source_performance, m36_source_span, r03_merged_spend, j08_aligned_series, a14_source_domain, m37_waterfall,
        m37_order_waterfall, m38_top_payers, m38_medium_frequency, m39_mtd_cards, m39_mtd_cards_multikit, m40_hour_of_day,
    )
}

# --- checking SQL ---------------------------------------------------------

_PEND = "('PATIENT_PENDING_VALID_INSURANCE', 'PENDING_ELIGIBILITY_CHECK', 'PENDING_PATIENT_INFO', 'PENDING_MANUAL_ELIGIBILITY_CHECK', 'WAITING_FOR_PAYMENT')"
_MLOW = "coalesce(lower(order_meta_values), '')"
_UPG = f"({_MLOW} LIKE '%upgraded from%' OR {_MLOW} LIKE '%starter upgrade%')"


def _labels(orders: str, backend_short: bool) -> str:
    short = "'Other Backend Generated Orders (VIP, NTRF)'" if backend_short else "'Other Backend Generated Orders (VIP, NTRF, etc)'"
    facebook = "('facebook')" if backend_short else "('facebook', 'facebook.com')"
    return f"""joined AS (SELECT o.*, m.order_meta_values, t.utm_source, t.utm_medium, ty.clinical_type_name FROM ({orders}) o
      LEFT JOIN v_meta_text m ON m.order_id = o.order_id LEFT JOIN v_tracking t ON CAST(t.order_id AS VARCHAR) = CAST(o.order_id AS VARCHAR)
      LEFT JOIN v_type ty ON ty.order_type_id = o.order_type_id),
    labelled AS (SELECT *, year(created_at) AS created_year,
      CASE WHEN prescription_id IS NULL THEN 'Single Kit' ELSE 'Multi Kit' END AS multikit_stat,
      CASE WHEN {_UPG} THEN 'Upgrade' WHEN prescription_id IS NOT NULL THEN 'Multi Kit' ELSE 'Single Kit' END AS mk_upg_stat,
      CASE WHEN {_MLOW} LIKE '%upgraded from %v1%' THEN 'V1 to V2 Upgrade' WHEN {_MLOW} LIKE '%upgraded from %v2%' THEN 'V2 to V3 Upgrade'
           WHEN {_MLOW} LIKE '%upgraded from %v3%' THEN 'V3 to V4 Upgrade' WHEN {_MLOW} LIKE '%upgraded from %v4%' THEN 'V4 to V5 Upgrade'
           WHEN {_MLOW} LIKE '%starter upgrade%' THEN 'Exp to Clinical Upgrade' WHEN {_MLOW} LIKE '%upgraded from%' THEN 'Other Upgrade'
           ELSE 'Nonupgrade' END AS upg_details,
      CASE WHEN {_UPG} THEN 'Upgrade' ELSE 'Nonupgrade' END AS upgrade_stat,
      coalesce(prescription_id, order_id) AS order_id_modified,
      CASE WHEN order_flow IS NULL OR order_flow = 'patient_doctor_none' THEN 'Patient Initiated' WHEN order_flow = 'free_of_approval' THEN 'No Insurance'
           WHEN order_flow = 'trf_transcribed' THEN 'Doctor Initiated' ELSE 'Channel Undefined' END AS order_channel,
      CASE WHEN state = 'REJECTED' THEN 'Order Rejected' WHEN state = 'CANCELLED' THEN 'Order Cancelled' WHEN state = 'DRAFT' THEN 'Legacy Draft Orders'
           WHEN {_MLOW} LIKE '%sample received%' THEN 'Sample Received' WHEN state IN ('RECEIVED', 'RELEASED', 'RECOLLECTED') THEN 'Sample Received'
           WHEN state IN ('APPROVED', 'CREATED') OR state IN {_PEND} THEN 'Sample Not Returned' ELSE 'Case Undefined' END AS sample_receival_stat,
      CASE WHEN state IN {_PEND} THEN 'Orders Pending Action Items' ELSE 'No Pending Items' END AS pending_items,
      {_FUNNEL.format(meta=_MLOW + " LIKE '%sample received%'")} AS order_funnel,
      CASE WHEN utm_source IS NULL AND created_at < TIMESTAMP '1998-01-01' THEN 'Before UTM Integration'
           WHEN utm_source IS NULL AND utm_medium IS NOT NULL THEN utm_medium WHEN utm_source IS NULL AND {_UPG} THEN 'Upgrades with no UTM'
           WHEN utm_source IS NULL AND ({_MLOW} LIKE '%vip%' OR {_MLOW} LIKE '%ntrf%') THEN {short}
           WHEN utm_source IS NULL AND ({_MLOW} LIKE '%recollected_from%' OR {_MLOW} LIKE '%kit_barcode_replaced%')
             THEN 'Other Backend Generated Orders (VIP, NTRF, etc)'
           WHEN utm_source IS NULL AND order_flow = 'trf_transcribed' THEN 'HCP initiated orders with no UTM'
           WHEN utm_source IS NULL THEN 'No UTM Source' WHEN utm_source = 'google' THEN 'google'
           WHEN utm_source IN {facebook} THEN 'facebook' ELSE utm_medium END AS utm_fillna FROM joined)"""


_FUNNEL = f"""CASE WHEN state IN ('REJECTED', 'CANCELLED', 'DRAFT') THEN 'Misc.' WHEN billed IS TRUE THEN '6. Orders that are billed'
  WHEN {{meta}} OR state IN ('RECEIVED', 'RELEASED', 'RECOLLECTED') THEN '5. Orders that received Samples'
  WHEN delivery_id IS NOT NULL THEN '4. Orders that shipped Kits' WHEN state IN {_PEND} THEN '3. Orders Pending Action Items'
  WHEN prescription_id IS NOT NULL AND state = 'APPROVED' THEN '2. Orders in Multikit in Queue' ELSE '1. Orders' END"""
_LABEL_VIEWS = ("v_order", "v_type", "v_meta_text", "v_tracking")


def _mapping(column: int) -> str:
    perf, brand = "'Online Performance Marketing'", "'Brand Marketing'"
    rows = [
        ("utm_source IS NULL AND utm_medium IS NULL", (brand, "'Organic'", "'Direct'")),
        ("utm_source IN ('facebook.com', 'm.facebook.com') AND utm_medium = 'referral'", (brand, "'Social'", "'Facebook'")),
        ("utm_source = 'google' AND utm_medium = 'organic'", (brand, "'Organic'", "'Google'")),
        ("utm_source = 'blog' AND utm_medium IN ('email', 'organic')", (perf, "'Organic'", "'Newsletter'")),
        ("utm_source = 'google' AND utm_medium = 'cpc'", (perf, "'SEM - Performance'", "'Google'")),
        ("utm_source = 'facebook' AND utm_medium = 'paid_social'", (perf, "'Paid Social'", "'Facebook'")),
    ]
    return "CASE " + " ".join(f"WHEN {cond} THEN {labels[column]}" for cond, labels in rows) + " END"


_MAPPED = f"""got AS (SELECT order_id AS gid, bool_or(value = 'Sample Received') AS got FROM v_meta GROUP BY 1),
base AS (SELECT o.*, t.utm_source, t.utm_medium, got.got FROM v_order o LEFT JOIN v_tracking t ON t.order_id = o.order_id
  LEFT JOIN got ON gid = o.order_id WHERE state <> 'DRAFT'),
mapped AS (SELECT *, coalesce(prescription_id, order_id) AS oid, {_mapping(0)} AS mapped_category, {_mapping(1)} AS mapped_channel,
  {_mapping(2)} AS mapped_sub_channel, {_FUNNEL.format(meta='coalesce(got, false)')} AS order_funnel FROM base)"""
_MAPPED_VIEWS = ("v_order", "v_meta", "v_tracking")
_COST = f"""{_MAPPED}, wk AS (SELECT coalesce(mapped_sub_channel, 'No Channel') AS mapped_sub_channel, isoyear(created_at) AS iso_year, week(created_at) AS week_number,
  count(DISTINCT oid) AS kit_1_orders FROM mapped GROUP BY 1, 2, 3),
sp AS (SELECT CASE event_type WHEN 'click' THEN 'Google' ELSE 'Facebook' END AS ch, isoyear(ts - INTERVAL 24 YEARS) AS y, week(ts - INTERVAL 24 YEARS) AS w,
  sum(CAST(value AS DECIMAL(18,2))) AS spend FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2, 3),
cost AS (SELECT wk.*, sp.spend FROM wk LEFT JOIN sp ON ch = mapped_sub_channel AND y = iso_year AND w = week_number)"""

_PERF = f"""ship AS (SELECT delivery_id AS d, min(ship_date) AS ship_date FROM v_shipment WHERE type = 'NORMAL' GROUP BY 1),
pay AS (SELECT zc_id, min(issue_date) AS first_issue_date, sum(payment) AS net_payment FROM v_eob GROUP BY 1),
perf AS (SELECT o.order_id, o.created_at, o.prescription_id, t.utm_source, t.utm_campaign, ship.ship_date, s.received, c.billing_date, pay.first_issue_date, pay.net_payment
  FROM v_order o LEFT JOIN v_tracking t ON t.order_id = o.order_id LEFT JOIN ship ON d = o.delivery_id LEFT JOIN v_sample s ON s.sample_id = o.sample_id
  LEFT JOIN v_claim c ON c.order_id = o.order_id AND (resubmitted IS NULL OR NOT resubmitted) LEFT JOIN pay ON pay.zc_id = o.order_id)"""
_CAMPAIGN = """pay AS (SELECT zc_id, sum(payment) AS payment, min(payer_id) AS payer_id FROM v_eob GROUP BY 1),
camp AS (SELECT o.order_id, t.utm_campaign, t.utm_medium, pay.payment, pay.payer_id,
  date_diff('day', min(o.created_at) OVER (PARTITION BY t.utm_campaign), o.created_at) AS day
  FROM v_order o JOIN v_tracking t ON t.order_id = o.order_id LEFT JOIN pay ON pay.zc_id = o.order_id)"""
_CARD = "SELECT order_id, created_at AS ts, CASE WHEN prescription_id IS NULL THEN 'singlekit' ELSE 'multikit' END AS kit, coalesce(prescription_id, order_id) AS k1, order_id % 3 = 0 AS up FROM v_order"


def _cards(rows: str, cur: tuple[str, str], prev: tuple[str, str]) -> str:
    a = f"ts >= TIMESTAMP '{cur[0]}' AND ts < TIMESTAMP '{cur[1]}'"
    b = f"ts >= TIMESTAMP '{prev[0]}' AND ts < TIMESTAMP '{prev[1]}'"
    return f"""SELECT count(DISTINCT order_id) FILTER ({a}) AS orders_mtd, count(DISTINCT order_id) FILTER ({a} AND up) AS upgrades_mtd,
      count(DISTINCT order_id) FILTER ({b}) AS orders_previous_mtd, count(DISTINCT order_id) FILTER ({b} AND up) AS upgrades_previous_mtd,
      count(DISTINCT k1) FILTER ({a}) AS kit_1_orders_mtd, count(DISTINCT k1) FILTER ({b}) AS kit_1_orders_previous_mtd FROM ({rows})"""


ORACLE = {
    "m32_enriched_orders": with_views(
        *_LABEL_VIEWS,
        body="WITH " + _labels("SELECT * FROM v_order WHERE state NOT IN ('DRAFT') AND created_at >= TIMESTAMP '1999-01-01' AND created_at < TIMESTAMP '2000-01-01'", False)
        + """ SELECT order_id, created_at, CAST(created_year AS INTEGER) AS created_year, clinical_type_name, utm_source, utm_medium, multikit_stat, mk_upg_stat,
        upg_details, upgrade_stat, order_id_modified, order_channel, sample_receival_stat, pending_items, order_funnel, utm_fillna FROM labelled"""),
    "m32_metadata_text": with_views(
        *_LABEL_VIEWS,
        body="WITH " + _labels("SELECT * FROM v_order WHERE state NOT IN ('DRAFT', 'PENDING_PATIENT_INFO') AND year(created_at) = 1999", False)
        + " SELECT order_id, order_meta_values, upg_details, order_funnel, utm_fillna FROM labelled"),
    "m32_label_counts": with_views(
        *_LABEL_VIEWS,
        body="WITH " + _labels("SELECT * FROM v_order WHERE state NOT IN ('DRAFT') AND created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '2002-01-01'", False)
        + f" SELECT {', '.join(LABELS)}, count(*) AS n FROM labelled GROUP BY ALL"),
    "m33_last24h_hourly": with_views(
        *_LABEL_VIEWS,
        body="WITH " + _labels(f"""SELECT * REPLACE (created_at + to_hours(order_id % 24) AS created_at) FROM v_order
          WHERE state NOT IN ('DRAFT', 'PENDING_PATIENT_INFO') AND TIMESTAMP '{AS_OF}' > created_at + to_hours(order_id % 24)
          AND TIMESTAMP '{AS_OF}' - (created_at + to_hours(order_id % 24)) <= INTERVAL 24 HOURS""", True)
        + """ SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS created_at_hour, clinical_type_name, mk_upg_stat, upgrade_stat, multikit_stat, order_channel, order_flow,
        utm_fillna, count(DISTINCT order_id) AS count_order_id, count(DISTINCT order_id_modified) AS count_order_kit1only FROM labelled GROUP BY ALL"""),
    "c10_utm_from_pages": """SELECT utm_source, CASE WHEN utm_source IS NULL THEN coalesce(host, 'No UTM Source') WHEN utm_source = 'google' THEN 'google'
        WHEN utm_source IN ('facebook', 'facebook.com') THEN 'facebook' ELSE host END AS filled, count(*) AS n FROM (
        SELECT nullif(regexp_extract(split_part(url, '#', 1), '[?&]utm_source=([^&]*)', 1), '') AS utm_source,
        regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages) GROUP BY 1, 2""",
    "c11_utm_mapping": with_views(
        "v_tracking", body=f"""SELECT utm_source, utm_medium, {_mapping(0)} AS mapped_category, {_mapping(1)} AS mapped_channel,
        {_mapping(2)} AS mapped_sub_channel, count(*) AS n FROM v_tracking GROUP BY ALL"""),
    "c11_wildcard_rules": with_views(
        "v_tracking", body="""SELECT utm_source, utm_medium, CASE WHEN utm_source IS NULL THEN 'no source' WHEN utm_source = 'google' AND utm_medium = 'cpc' THEN 'google cpc'
        WHEN (utm_source = 'facebook' AND utm_medium IN ('paid_social', 'paid', 'cpc')) OR (utm_source = 'bing' AND utm_medium = 'cpc')
          OR (utm_source IN ('BrandA', 'BrandB', 'Starter', 'Blog') AND utm_medium = 'email') THEN 'Online Performance Marketing'
        WHEN utm_medium = 'email' THEN 'any email' WHEN utm_source = 'google' THEN 'any google' ELSE 'anything' END AS mapped_category, count(*) AS n
        FROM v_tracking GROUP BY ALL"""),
    "m34_weekly_channel": with_views(
        *_MAPPED_VIEWS,
        body=f"WITH {_MAPPED} " + " UNION ALL ".join(
            f"SELECT '{c}' AS label, {c} AS value, CAST(isoyear(created_at) AS INTEGER) AS iso_year, CAST(week(created_at) AS INTEGER) AS week_number, "
            f"CAST(date_trunc('week', created_at) + INTERVAL 6 DAYS AS TIMESTAMP) AS week_ending, count(DISTINCT oid) AS orders FROM mapped WHERE {c} IS NOT NULL GROUP BY ALL"
            for c in ("mapped_category", "mapped_channel", "mapped_sub_channel", "order_funnel"))),
    "m34_weekly_category": with_views(
        *_MAPPED_VIEWS,
        body=f"""WITH {_MAPPED} SELECT mapped_category, CAST(isoyear(created_at) AS INTEGER) AS iso_year, CAST(week(created_at) AS INTEGER) AS week_number,
        CAST(date_trunc('week', created_at) + INTERVAL 6 DAYS AS TIMESTAMP) AS week_ending, count(DISTINCT oid) AS orders
        FROM mapped WHERE mapped_category IS NOT NULL GROUP BY ALL"""),
    "m35_cac": with_views(
        *_MAPPED_VIEWS, body=f"""WITH {_COST} SELECT mapped_sub_channel, CAST(iso_year AS INTEGER) AS iso_year, CAST(week_number AS INTEGER) AS week_number,
        kit_1_orders, CAST(spend AS DOUBLE) AS spend, {ratio('spend', 'kit_1_orders')} AS cac FROM cost"""),
    "m35_blended": with_views(
        *_MAPPED_VIEWS, body=f"""WITH {_COST}, w AS (SELECT iso_year, week_number, coalesce(sum(spend), 0) AS s, CAST(sum(kit_1_orders) AS BIGINT) AS k FROM cost GROUP BY 1, 2)
        SELECT CAST(iso_year AS INTEGER) AS iso_year, CAST(week_number AS INTEGER) AS week_number, CAST(s AS DOUBLE) AS spend, k AS kit_1_orders,
        {half_even_money('s', 'k')} AS cac FROM w"""),
    "m35_channel_cost": with_views(
        *_MAPPED_VIEWS, body=f"""WITH {_COST}, s AS (SELECT * FROM sp WHERE ch = 'Facebook')
        SELECT CAST(y AS INTEGER) AS iso_year, CAST(w AS INTEGER) AS week_number, CAST(s.spend AS DOUBLE) AS spend, mapped_sub_channel,
        CAST(kit_1_orders AS DOUBLE) AS orders, {ratio('s.spend', 'kit_1_orders')} AS cac
        FROM s LEFT JOIN wk ON iso_year = y AND week_number = w AND mapped_sub_channel = 'Facebook'"""),
    "r03_merged_spend": """WITH a AS (SELECT date_trunc('day', ts) AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS s FROM events
        WHERE event_type = 'click' GROUP BY 1 HAVING day(date_trunc('day', ts)) % 3 <> 0),
        b AS (SELECT date_trunc('day', ts) AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS s FROM events
        WHERE event_type = 'view' GROUP BY 1 HAVING day(date_trunc('day', ts)) % 2 = 0)
        SELECT CAST(coalesce(a.day, b.day) AS TIMESTAMP) AS day, coalesce(a.s, b.s) AS spend FROM a FULL JOIN b ON a.day = b.day""",
    "j08_aligned_series": "WITH d AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type FROM events) SELECT * FROM (SELECT day, " + ", ".join(
        f"nullif(count(*) FILTER (event_type = '{kind}' AND day(day) % {n} <> 0), 0) AS {kind}" for n, kind in enumerate(("click", "view", "purchase"), 2)) +
        " FROM d GROUP BY 1) WHERE click IS NOT NULL OR view IS NOT NULL OR purchase IS NOT NULL",
    "a14_source_domain": with_views("v_tracking", body="SELECT DISTINCT utm_source FROM v_tracking WHERE utm_source IS NOT NULL"),
    "m36_source_performance": with_views(
        "v_order", "v_tracking", "v_shipment", "v_sample", "v_claim", "v_eob",
        body=f"""WITH {_PERF} SELECT utm_source, count(created_at) AS count_of_orders, count(ship_date) AS count_of_shipments, count(received) AS count_of_samples,
        count(billing_date) AS count_of_claims, count(first_issue_date) AS count_of_payments, CAST(coalesce(sum(net_payment), 0) AS DOUBLE) AS sum_of_payments,
        {half_even_money('coalesce(sum(net_payment), 0)', 'count(billing_date)')} AS average_payment_per_claim
        FROM perf WHERE utm_source IS NOT NULL AND prescription_id IS NOT NULL AND created_at >= TIMESTAMP '{START}' AND created_at < TIMESTAMP '2001-01-01' GROUP BY 1"""),
    "m36_source_span": with_views(
        "v_order", "v_tracking", body="""SELECT min(created_at) FILTER (utm_campaign IS NOT NULL) AS start_date, max(created_at) AS end_date
        FROM v_order o LEFT JOIN v_tracking t ON t.order_id = o.order_id"""),
    "m37_waterfall": with_views(
        "v_order", "v_tracking", "v_eob",
        body=f"""WITH {_CAMPAIGN}, d AS (SELECT utm_campaign, day, coalesce(sum(payment), 0) AS n FROM camp GROUP BY 1, 2),
        b AS (SELECT utm_campaign, min(day) AS lo, max(day) AS hi FROM d GROUP BY 1),
        f AS (SELECT b.utm_campaign, s.day FROM b, LATERAL (SELECT unnest(generate_series(lo, hi)) AS day) s)
        SELECT f.utm_campaign, f.day, CAST(coalesce(n, 0) AS DOUBLE) AS n, CAST(sum(coalesce(n, 0)) OVER (PARTITION BY f.utm_campaign ORDER BY f.day) AS DOUBLE) AS cumulative
        FROM f LEFT JOIN d ON d.utm_campaign = f.utm_campaign AND d.day = f.day"""),
    "m37_order_waterfall": with_views(
        "v_order", "v_tracking", "v_eob",
        body=f"""WITH {_CAMPAIGN}, d AS (SELECT utm_campaign, day, count(order_id) AS n FROM camp GROUP BY 1, 2)
        SELECT utm_campaign, day, n, CAST(sum(n) OVER (PARTITION BY utm_campaign ORDER BY day) AS DOUBLE) AS cumulative FROM d"""),
    "m38_top_payers": with_views(
        "v_order", "v_tracking", "v_eob", body=f"""WITH {_CAMPAIGN} SELECT order_id, payer_id, CAST(payment AS DOUBLE) AS payment FROM camp
        WHERE utm_campaign = 'campaign-1' AND payment IS NOT NULL ORDER BY payment DESC, order_id LIMIT 5"""),
    "m38_medium_frequency": with_views(
        "v_order", "v_tracking", "v_eob", body=f"WITH {_CAMPAIGN} SELECT utm_medium, count(*) AS n FROM camp WHERE utm_campaign = 'campaign-1' AND utm_medium IS NOT NULL GROUP BY 1"),
    "m39_mtd_cards": with_views("v_order", body=_cards(_CARD, ("2001-07-01", "2001-07-16"), ("2001-06-01", "2001-06-16"))),
    "m39_mtd_cards_multikit": with_views(
        "v_order", body=_cards(f"SELECT * FROM ({_CARD}) WHERE kit = 'multikit'", ("2001-03-01", "2001-04-01"), ("2001-02-01", "2001-03-01"))),
    "m40_hour_of_day": """WITH e AS (SELECT event_id, ts - INTERVAL 14 DAYS AS t FROM events)
        SELECT CAST(hour(t) AS INTEGER) AS hour, CAST(nullif(count(DISTINCT event_id) FILTER (t < TIMESTAMP '2024-01-01'), 0) AS DOUBLE) AS previous_month_hourly,
        CAST(nullif(count(DISTINCT event_id) FILTER (t >= TIMESTAMP '2024-01-01'), 0) AS DOUBLE) AS current_month_hourly
        FROM e WHERE t >= TIMESTAMP '2023-12-01' AND t < TIMESTAMP '2024-02-01' GROUP BY 1""",
}
ORACLE["c11_utm_rules"] = ORACLE["c11_utm_mapping"]
