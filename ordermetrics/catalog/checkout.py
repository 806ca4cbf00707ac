"""Checkout and cart queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermetrics.catalog.checks import ratio, with_views
from ordermetrics.catalog.views import AS_OF, EVENTS_AS_OF, TEST_NAMES, Tables
from ordermetrics.operators.joins import sent_with_latest_return
from ordermetrics.plans import checkout

SOURCES = ["click", "error", "purchase", "signup", "view"]
WITHIN = 14


def _each(carts: DataFrame, build) -> DataFrame:
    """The same series at the three frequencies, stacked."""
    stacked = None
    for frequency in ("Daily", "Weekly", "Monthly"):
        part = build(carts, frequency).withColumn("frequency", F.lit(frequency))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked


def m23_orders_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return _each(Tables(spark, folder).carts(), lambda c, f: checkout.orders_by(c, f, "source"))


def m23_orders_by_program(spark: SparkSession, folder: str) -> DataFrame:
    """Week-ending and month-end labels."""
    return _each(Tables(spark, folder).carts(), lambda c, f: checkout.orders_by(c, f, "program_category", "right"))


def m23_orders_by_source_pivot(spark: SparkSession, folder: str) -> DataFrame:
    carts = checkout.cart_range(Tables(spark, folder).carts(), "2024-01-02", "2024-01-28", "even")
    long = checkout.orders_by(carts, "Daily", "source")
    wide = checkout.orders_by_wide(long, "source", SOURCES, EVENTS_AS_OF, 20)
    return wide.withColumns({c: F.col(c).cast("double") for c in SOURCES})


def m24_orders_to_cart(spark: SparkSession, folder: str) -> DataFrame:
    return _each(Tables(spark, folder).carts(), lambda c, f: checkout.orders_to_carts(c, f))


def m24_orders_to_cart_by_source(spark: SparkSession, folder: str) -> DataFrame:
    return _each(Tables(spark, folder).carts(), lambda c, f: checkout.orders_to_carts(c, f, "source"))


def m24_ratio_query(spark: SparkSession, folder: str) -> DataFrame:
    """Stored-query form with an extra predicate."""
    return checkout.cart_ratio_query(Tables(spark, folder).carts(), "week", F.col("program").like("%cash%"))


def m25_received_within(spark: SparkSession, folder: str) -> DataFrame:
    return _each(Tables(spark, folder).carts(), lambda c, f: checkout.received_to_shipped(c, f, WITHIN))


def m25_received_within_by_program(spark: SparkSession, folder: str) -> DataFrame:
    return _each(Tables(spark, folder).carts(), lambda c, f: checkout.received_to_shipped(c, f, WITHIN, "program_category"))


def m26_cart_number(spark: SparkSession, folder: str) -> DataFrame:
    return checkout.cart_number(Tables(spark, folder).carts())


def m26_cart_totals(spark: SparkSession, folder: str) -> DataFrame:
    numbers = checkout.cart_number(Tables(spark, folder).carts())
    return checkout.cart_totals(numbers, "2024-01-05", "2024-01-20")


def m27_state_counts(spark: SparkSession, folder: str) -> DataFrame:
    return checkout.state_counts(Tables(spark, folder).orders(), "week")


def m28_orders_by_program(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return checkout.weekly_program_orders(t.carts(), t.orders(), EVENTS_AS_OF)


def j17_program_rows(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    # one shipment per delivery, so that the numbering is a total order
    sent = t.shipments().groupBy("delivery_id", "type").agg(F.min("ship_date").alias("ship_date"), F.min("delivered_date").alias("delivered_date"))
    # some samples have an arrival only
    samples = t.samples().withColumns({"received": F.when(F.col("sample_id") % 5 != 0, F.col("received")), "arrived": F.col("received") + F.expr("INTERVAL 1 DAY")})
    rows = checkout.program_orders(t.carts(), t.orders(), t.order_types(), t.metadata(), sent, samples, vocab=TEST_NAMES)
    return rows.select(
        "cart_id", "source", "program_category", "clinical_type_name", "mk_upg_stat", "sample_receival_stat", "ship_date",
        *[F.col(c).cast("double").alias(c) for c in ("order_id", "kit_number", "kit_received_time_in_days")],
    )


def m29_completed_checkout(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    rows = checkout.completed_checkouts(t.carts(), t.orders(), t.tracking(), t.metadata(), EVENTS_AS_OF, vocab=TEST_NAMES)
    return rows.withColumn("order_id", F.col("order_id").cast("string"))


def o2_first_checkouts(spark: SparkSession, folder: str) -> DataFrame:
    """The first twenty rows of the stored query."""
    t = Tables(spark, folder)
    rows = checkout.completed_checkouts(t.carts(), t.orders(), t.tracking(), t.metadata(), EVENTS_AS_OF, limit=20, vocab=TEST_NAMES)
    return rows.withColumn("order_id", F.col("order_id").cast("string"))


def m30_kit_shipments(spark: SparkSession, folder: str) -> DataFrame:
    shipments = Tables(spark, folder).shipments()
    rows = sent_with_latest_return(shipments, tie=["shipment_id", "part_id"], columns=["shipment_id", "carrier_id", "ship_date", "delivered_date"])
    ids = ["kit_sent_shipment_id", "kit_sent_carrier_id", "kit_return_shipment_id", "kit_return_carrier_id"]
    return rows.withColumns({c: F.col(c).cast("string") for c in ids})


def m31_cumulative_by_source(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    carts, _ = checkout.cash_pay(t.carts(), t.orders())
    by_source = checkout.cumulative_ids(carts, "cart_id", "cart_created_date", ["source"])
    total = checkout.cumulative_ids(carts, "cart_id", "cart_created_date").withColumn("source", F.lit("total"))
    return by_source.unionByName(total)


def m31_id_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    carts, _ = checkout.cash_pay(t.carts(), t.orders())
    return checkout.id_counts(carts, "source", ["cart_id", "owner_id", "prescription_id", "order_id"])


def m31_cash_orders(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    _, orders = checkout.cash_pay(t.carts(), t.orders())
    return checkout.cumulative_ids(orders, "order_id", "created_at")


def m47_step_totals(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return checkout.step_totals(t.carts(), t.orders(), t.shipments())


QUERIES = {
    f.__name__: f
    for f in (
        m23_orders_by_source, m23_orders_by_program, m23_orders_by_source_pivot, m24_orders_to_cart,
        m24_orders_to_cart_by_source, m24_ratio_query, m25_received_within, m25_received_within_by_program,
        m26_cart_number, m26_cart_totals, m27_state_counts, m28_orders_by_program, j17_program_rows,
        m29_completed_checkout, o2_first_checkouts, m30_kit_shipments, m31_cumulative_by_source, m31_id_counts, m31_cash_orders, m47_step_totals,
    )
}

# --- checking SQL ---------------------------------------------------------

_D = "cart_created_date"
_LEFT = {
    "Daily": f"date_trunc('day', {_D})",
    # Tuesday to Monday, labelled with the Monday before
    "Weekly": f"CASE WHEN isodow({_D}) = 1 THEN date_trunc('day', {_D}) - INTERVAL 7 DAYS ELSE date_trunc('week', {_D}) END",
    "Monthly": f"date_trunc('month', {_D})",
}
_RIGHT = {
    "Daily": f"date_trunc('day', {_D})",
    "Weekly": f"date_trunc('week', {_D}) + INTERVAL 6 DAYS",
    "Monthly": f"CAST(last_day({_D}) AS TIMESTAMP)",
}


def _by(category: str, labels: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({expr} AS TIMESTAMP) AS {_D}, {category}, count(DISTINCT order_id_modified) AS orders, '{f}' AS frequency "
        f"FROM v_cart GROUP BY 1, 2" for f, expr in labels.items()
    )


def _ratios(top: str, bottom: str, names: tuple[str, str, str], category: str | None = None) -> str:
    parts = []
    for frequency, expr in _LEFT.items():
        extra = f"{category}, " if category else ""
        inner = f"SELECT CAST({expr} AS TIMESTAMP) AS m, {extra}count(DISTINCT {top}) AS a, count(DISTINCT {bottom}) AS b FROM v_cart GROUP BY ALL"
        unit = {"Daily": "1 DAY", "Weekly": "7 DAYS", "Monthly": "1 MONTH"}[frequency]
        if category:
            parts.append(f"SELECT m AS {_D}, {category}, a AS {names[0]}, b AS {names[1]}, {ratio('a', 'b')} AS {names[2]}, '{frequency}' AS frequency FROM ({inner})")
        else:
            parts.append(
                f"SELECT g.m AS {_D}, coalesce(a, 0) AS {names[0]}, coalesce(b, 0) AS {names[1]}, {ratio('a', 'b')} AS {names[2]}, '{frequency}' AS frequency "
                f"FROM (SELECT unnest(generate_series((SELECT min(m) FROM ({inner})), (SELECT max(m) FROM ({inner})), INTERVAL {unit})) AS m) g "
                f"LEFT JOIN ({inner}) c ON c.m = g.m")
    return " UNION ALL ".join(parts)


_CART_NAMES = ("orders", "carts", "orders_to_cart_ratio")
_SHIP_NAMES = ("samples", "shipments", "sample_received_to_kit_shipped_ratio")
_IN_TIME = f"CASE WHEN kit_received_time_in_days <= {WITHIN} THEN sample_id END"
_RET = "kit_return_{0}"

ORACLE = {
    "m23_orders_by_source": with_views("v_cart", body=_by("source", _LEFT)),
    "m23_orders_by_program": with_views("v_cart", body=_by("program_category", _RIGHT)),
    "m23_orders_by_source_pivot": with_views(
        "v_cart",
        body="SELECT CAST(date_trunc('day', cart_created_date) AS TIMESTAMP) AS cart_created_date, " + ", ".join(
            f"CASE WHEN count(*) FILTER (source = '{s}') > 0 THEN CAST(count(DISTINCT order_id_modified) FILTER (source = '{s}') AS DOUBLE) END AS \"{s}\""
            for s in SOURCES) + f""" FROM v_cart WHERE product = 'even' AND cart_created_date >= TIMESTAMP '2024-01-02'
            AND cart_created_date < TIMESTAMP '2024-01-29' AND date_trunc('day', cart_created_date) >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 20 DAYS GROUP BY 1"""),
    "m24_orders_to_cart": with_views("v_cart", body=_ratios("order_id_modified", "cart_id", _CART_NAMES)),
    "m24_orders_to_cart_by_source": with_views("v_cart", body=_ratios("order_id_modified", "cart_id", _CART_NAMES, "source")),
    "m24_ratio_query": with_views(
        "v_cart",
        body=f"""SELECT CAST(date_trunc('week', cart_created_date) AS TIMESTAMP) AS cart_created_date, source,
        {ratio('count(DISTINCT order_id_modified)', 'count(DISTINCT cart_id)')} AS orders_to_cart_ratio
        FROM v_cart WHERE program LIKE '%cash%' GROUP BY 1, 2 ORDER BY 1 DESC"""),
    "m25_received_within": with_views("v_cart", body=_ratios(_IN_TIME, "delivery_id", _SHIP_NAMES)),
    "m25_received_within_by_program": with_views("v_cart", body=_ratios(_IN_TIME, "delivery_id", _SHIP_NAMES, "program_category")),
    "m26_cart_number": with_views(
        "v_cart", body="""SELECT CAST(date_trunc('day', cart_created_date) AS TIMESTAMP) AS cart_created_date, program,
        count(DISTINCT cart_id) AS cart_number FROM v_cart GROUP BY 1, 2 ORDER BY 1 DESC"""),
    "m26_cart_totals": with_views(
        "v_cart", body="""SELECT program, count(DISTINCT cart_id) AS cart_number FROM v_cart
        WHERE date_trunc('day', cart_created_date) > TIMESTAMP '2024-01-05' AND date_trunc('day', cart_created_date) <= TIMESTAMP '2024-01-20'
        AND program IS NOT NULL GROUP BY 1"""),
    "m27_state_counts": with_views(
        "v_order", body="SELECT CAST(date_trunc('week', created_at) AS TIMESTAMP) AS created, state, count(DISTINCT order_id) AS n FROM v_order GROUP BY 1, 2"),
    "m28_orders_by_program": with_views(
        "v_cart", "v_order",
        body=f"""WITH o AS (SELECT DISTINCT coalesce(prescription_id, order_id) AS k FROM v_order)
        SELECT CAST(date_trunc('week', cart_created_date) AS TIMESTAMP) AS cart_created_date, program_category,
        count(DISTINCT o.k) AS kit1_count_of_orders_generated FROM v_cart LEFT JOIN o ON o.k = order_id_modified
        WHERE cart_created_date >= date_trunc('week', TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 31 DAYS) AND source IS NOT NULL GROUP BY 1, 2"""),
    "j17_program_rows": with_views(
        "v_cart", "v_order", "v_type", "v_meta", "v_shipment", "v_sample",
        body="""WITH sent AS (SELECT delivery_id, min(ship_date) AS ship_date, min(delivered_date) AS delivered_date FROM v_shipment WHERE type = 'NORMAL' GROUP BY 1),
        meta AS (SELECT order_id, bool_or(value LIKE '%Upgraded from%' OR value LIKE '%Starter upgrade%') AS up FROM v_meta GROUP BY 1),
        rows AS (SELECT c.cart_id, c.source, c.program_category, o.order_id, o.prescription_id, o.sample_id, o.created_at, meta.up,
          sent.ship_date, sent.delivered_date, CASE WHEN s.sample_id % 5 <> 0 THEN s.received ELSE s.received + INTERVAL 1 DAY END AS received, t.clinical_type_name
          FROM v_cart c LEFT JOIN v_order o ON coalesce(o.prescription_id, o.order_id) = c.order_id_modified
          LEFT JOIN v_type t ON t.order_type_id = o.order_type_id LEFT JOIN meta ON meta.order_id = o.order_id LEFT JOIN sent ON sent.delivery_id = o.delivery_id
          LEFT JOIN v_sample s ON s.sample_id = o.sample_id)
        SELECT cart_id, source, program_category, clinical_type_name,
        CASE WHEN order_id IS NULL THEN NULL WHEN up THEN 'Upgrade' WHEN prescription_id IS NOT NULL THEN 'Multi Kit' ELSE 'Single Kit' END AS mk_upg_stat,
        CASE WHEN order_id IS NULL THEN NULL WHEN sample_id IS NOT NULL THEN 'Sample Received' ELSE 'Sample Not Received' END AS sample_receival_stat,
        ship_date, CAST(order_id AS DOUBLE) AS order_id,
        CAST(CASE WHEN prescription_id IS NULL AND order_id IS NULL THEN NULL WHEN prescription_id IS NOT NULL THEN
          row_number() OVER (PARTITION BY prescription_id ORDER BY delivered_date NULLS LAST, created_at, order_id, cart_id) ELSE 1 END AS DOUBLE) AS kit_number,
        CAST(date_diff('day', CAST(delivered_date AS DATE), CAST(received AS DATE)) AS DOUBLE) AS kit_received_time_in_days FROM rows"""),
    "m29_completed_checkout": with_views(
        "v_cart", "v_order", "v_tracking", "v_meta",
        body=f"""WITH meta AS (SELECT order_id, bool_or(value IN ('Starter Upgrade', 'Upgraded from BAv1', 'Upgraded from BBv1', 'Upgraded from BAv2',
          'Upgraded from BBv2', 'Upgraded from BAv3', 'Upgraded from BBv3')) AS up FROM v_meta GROUP BY 1),
        o AS (SELECT coalesce(o.prescription_id, o.order_id) AS k, o.order_id, o.state, o.order_flow, t.utm_source, t.utm_medium,
          CASE WHEN (t.utm_source = 'facebook' AND t.utm_medium IN ('paid_social', 'paid', 'cpc')) OR (t.utm_source IN ('google', 'bing') AND t.utm_medium = 'cpc')
            THEN 'Online Performance Marketing' END AS mapped_category, CASE WHEN meta.up THEN 'Upgrade' END AS upg_status
          FROM v_order o LEFT JOIN v_tracking t ON t.order_id = o.order_id LEFT JOIN meta ON meta.order_id = o.order_id)
        SELECT CAST(date_trunc('day', c.created_at) AS TIMESTAMP) AS created_date, coalesce(c.prescription_id, c.order_id) AS order_id_coalesced, c.product,
        CASE WHEN c.prescription_id IS NOT NULL THEN 'MultiKit' ELSE 'SingleKit' END AS mk_sk, CAST(o.order_id AS VARCHAR) AS order_id, o.state, o.order_flow,
        o.utm_source, o.utm_medium, o.mapped_category, o.upg_status
        FROM v_cart c LEFT JOIN o ON o.k = coalesce(c.prescription_id, c.order_id)
        WHERE year(c.created_at) = 2024 AND (c.order_id IS NOT NULL OR c.prescription_id IS NOT NULL)"""),
    "m30_kit_shipments": with_views(
        "v_shipment",
        body="""WITH ret AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY delivered_date DESC, ship_date DESC, created_at DESC, shipment_id, part_id) AS rn
          FROM v_shipment WHERE type = 'RETURN') WHERE rn = 1), sent AS (SELECT * FROM v_shipment WHERE type = 'NORMAL')
        SELECT coalesce(sent.order_id, ret.order_id) AS order_id, CAST(sent.shipment_id AS VARCHAR) AS kit_sent_shipment_id, CAST(sent.carrier_id AS VARCHAR) AS kit_sent_carrier_id,
        sent.ship_date AS kit_sent_ship_date, sent.delivered_date AS kit_sent_delivered_date, CAST(ret.shipment_id AS VARCHAR) AS kit_return_shipment_id,
        CAST(ret.carrier_id AS VARCHAR) AS kit_return_carrier_id, ret.ship_date AS kit_return_ship_date, ret.delivered_date AS kit_return_delivered_date
        FROM sent FULL OUTER JOIN ret ON sent.order_id = ret.order_id"""),
    "m31_cumulative_by_source": with_views(
        "v_cart",
        body="""WITH c AS (SELECT source, cart_created_date, count(DISTINCT cart_id) AS n FROM v_cart WHERE program = 'cash_pay_program' GROUP BY 1, 2),
        a AS (SELECT cart_created_date, count(DISTINCT cart_id) AS n FROM v_cart WHERE program = 'cash_pay_program' GROUP BY 1)
        SELECT source, cart_created_date, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY cart_created_date) AS BIGINT) AS cumulative FROM c
        UNION ALL SELECT 'total', cart_created_date, n, CAST(sum(n) OVER (ORDER BY cart_created_date) AS BIGINT) FROM a"""),
    "m31_id_counts": with_views(
        "v_cart", body="""SELECT source, count(cart_id) AS cart_id, count(owner_id) AS owner_id, count(prescription_id) AS prescription_id,
        count(order_id) AS order_id FROM v_cart WHERE program = 'cash_pay_program' GROUP BY 1"""),
    "m31_cash_orders": with_views(
        "v_order", body="""WITH a AS (SELECT created_at, count(DISTINCT order_id) AS n FROM v_order WHERE order_flow LIKE '%cashpay%' OR order_flow LIKE '%cash%' GROUP BY 1)
        SELECT created_at, n, CAST(sum(n) OVER (ORDER BY created_at) AS BIGINT) AS cumulative FROM a"""),
    "m47_step_totals": with_views(
        "v_cart", "v_order", "v_shipment",
        body=f"""WITH s AS (SELECT '1. Carts' AS step, count(DISTINCT cart_id) AS total FROM v_cart UNION ALL SELECT '2. Orders', count(DISTINCT order_id) FROM v_order
        UNION ALL SELECT '3. Kits Sent', count(DISTINCT order_id) FROM v_shipment WHERE type = 'NORMAL'
        UNION ALL SELECT '4. Kits Returned', count(DISTINCT order_id) FROM v_shipment WHERE type = 'RETURN')
        SELECT step, total, {ratio('total', 'lag(total) OVER (ORDER BY step)')} AS conversion FROM s"""),
}
_FIRST = ["order_id_coalesced", "created_date", "TRY_CAST(order_id AS BIGINT)", "product", "mk_sk", "state", "order_flow", "utm_source", "utm_medium", "mapped_category", "upg_status"]
ORACLE["o2_first_checkouts"] = f"SELECT * FROM ({ORACLE['m29_completed_checkout']}) ORDER BY {', '.join(f'{c} ASC NULLS LAST' for c in _FIRST)} LIMIT 20"
