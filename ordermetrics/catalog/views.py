"""Source tables of the order workflow, derived from the test tables.

Each view exists twice: as a DataFrame for the Spark side and as a SELECT for
the checking SQL. The two are written independently of the metrics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermetrics.functions.vocabulary import Vocabulary

TEST_NAMES = Vocabulary("company", "starter", ("BrandA", "BrandB", "Starter"), ("BA", "BB"))
AS_OF = "2001-07-15"  # clock of the order tables
EVENTS_AS_OF = "2024-01-30"  # clock of the events table
START, END = "1996-01-01", "2000-12-31"


class Tables:
    """Views over one directory of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._read = spark, folder, {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._read:  # the footer is read once per query
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def orders(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS order_id",
            "o_orderdate AS created_at",
            """CASE WHEN o_orderstatus = 'F' THEN 'RELEASED' WHEN o_orderstatus = 'O' THEN 'APPROVED'
                    WHEN o_orderkey % 10 = 0 THEN 'DRAFT' WHEN o_orderkey % 10 = 1 THEN 'CANCELLED'
                    WHEN o_orderkey % 10 = 2 THEN 'PENDING_PATIENT_INFO' WHEN o_orderkey % 10 = 3 THEN 'REJECTED'
                    WHEN o_orderkey % 10 = 4 THEN 'WAITING_FOR_PAYMENT' WHEN o_orderkey % 10 = 5 THEN 'CREATED'
                    WHEN o_orderkey % 10 = 6 THEN 'RECOLLECTED' ELSE 'RECEIVED' END AS state""",
            "o_custkey AS owner_id",
            "CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN o_custkey END AS prescription_id",
            "o_orderpriority AS source",
            """CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'trf_transcribed'
                    WHEN '3-MEDIUM' THEN 'free_of_approval' WHEN '4-NOT SPECIFIED' THEN 'patient_doctor_none'
                    ELSE 'cashpay_online' END AS order_flow""",
            "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS sample_id",
            "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS delivery_id",
            "CAST(o_custkey % 5 AS INT) AS order_type_id",
            "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 250000 END AS billed",
            "o_orderkey % 3 + 1 AS version",
        )

    def order_types(self) -> DataFrame:
        return self.raw("region").selectExpr(
            "r_regionkey AS order_type_id", "lower(r_name) AS code", "r_name AS clinical_type_name"
        )

    def segments(self) -> DataFrame:
        return self.raw("customer").selectExpr("c_custkey AS owner_id", "c_mktsegment AS product")

    def shipments(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS order_id",
            "l_orderkey AS delivery_id",
            "l_orderkey * 10 + l_linenumber AS shipment_id",
            "l_shipdate AS ship_date",
            "l_shipdate + make_dt_interval(l_linenumber) AS delivered_date",
            "l_shipdate AS created_at",
            "CASE WHEN l_returnflag = 'R' THEN 'RETURN' ELSE 'NORMAL' END AS type",
            "l_partkey AS part_id",
            "l_suppkey AS carrier_id",
        )

    def order_items(self) -> DataFrame:
        return self.raw("orders").selectExpr("o_orderkey AS order_id", "CAST(o_custkey % 4 AS INT) AS item_type_id")

    def samples(self) -> DataFrame:
        returned = self.raw("lineitem").where("l_returnflag = 'R'")
        first = returned.groupBy(F.col("l_orderkey").alias("sample_id")).agg(
            F.min("l_shipdate").alias("received"), F.min("l_linenumber").alias("line")
        )
        return first.selectExpr(
            "sample_id",
            "received",
            "CASE WHEN sample_id % 13 = 0 THEN 'study-' ELSE 'kit-' END || sample_id AS kit_barcode",
            "CAST(16 + sample_id % 2 AS INT) AS kit_type",
            """CASE line % 4 WHEN 0 THEN 'recollected' WHEN 3 THEN 'final-rejected' ELSE 'success' END
               AS sample_process_status""",
        )

    def lab_samples(self) -> DataFrame:
        return self.samples().withColumnRenamed("received", "sample_received")

    def kits(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "CASE WHEN o_orderkey % 13 = 0 THEN 'study-' ELSE 'kit-' END || o_orderkey AS barcode",
            "CAST(16 + o_orderkey % 2 AS INT) AS kit_type",
            "o_orderdate AS registered",
        )

    def sample_statuses(self) -> DataFrame:
        return self.samples().where("sample_process_status <> 'final-rejected'").selectExpr("sample_id", "sample_process_status AS status")

    def status_history(self) -> DataFrame:
        return self.raw("lineitem").where("l_linestatus = 'F'").selectExpr(
            "l_orderkey AS order_id",
            "l_orderkey * 10 + l_linenumber AS status_id",
            "CASE WHEN l_returnflag = 'N' THEN 'APPROVED' ELSE 'RELEASED' END AS status",
            "l_shipdate AS created_at",
        )

    def reports(self) -> DataFrame:
        """Release events with the columns the laboratory metrics use."""
        return self.status_history().selectExpr(
            "order_id", "status_id", "order_id AS sample_id", "status AS report_status",
            "'RELEASED' AS state", "created_at AS report_created_at",
        )

    def results(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey * 10 + l_linenumber AS result_id",
            "l_orderkey AS order_id",
            "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'corrected' ELSE 'final' END AS result_status",
            "l_shipdate + make_dt_interval(0, 6 * l_linenumber) AS result_created_at",
            "l_partkey AS part_id",
        )

    def metadata(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS order_id",
            """CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1 THEN 'Sample Received'
                    WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 1 THEN 'Upgraded from BAv1'
                    WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 2 THEN 'Upgraded from BBv2'
                    WHEN l_returnflag = 'A' AND l_linestatus = 'O' AND l_linenumber = 3 THEN 'Starter Upgrade'
                    WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 4 THEN 'VIP'
                    WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 5 THEN 'recollected_from'
                    ELSE l_returnflag || '-' || l_linestatus END AS value""",
        )

    def tracking(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS order_id",
            """CASE event_type WHEN 'click' THEN 'google' WHEN 'view' THEN 'facebook' WHEN 'purchase' THEN 'facebook.com'
                    WHEN 'error' THEN 'blog' END AS utm_source""",
            """CASE user_id % 5 WHEN 0 THEN 'cpc' WHEN 1 THEN 'organic' WHEN 2 THEN 'paid_social'
                    WHEN 3 THEN 'referral' END AS utm_medium""",
            "'campaign-' || CAST(user_id % 3 AS STRING) AS utm_campaign",
        )

    def claims(self) -> DataFrame:
        return self.raw("orders").selectExpr(
            "o_orderkey AS id",
            "o_orderkey AS order_id",
            "o_orderdate + make_dt_interval(0, CAST(o_orderkey % 20 AS INT)) AS creation_date",
            "o_orderdate + make_dt_interval(CAST(o_custkey % 15 AS INT), CAST(o_orderkey % 24 AS INT)) AS billing_date",
            "o_orderpriority AS product",
            "CASE o_orderkey % 3 WHEN 1 THEN false WHEN 2 THEN true END AS resubmitted",
            "o_orderkey % 3 + 1 AS version",
        )

    def payer_claims(self) -> DataFrame:
        return self.raw("orders").selectExpr("o_orderkey AS zc_id", "o_orderkey DIV 2 AS claim_id", "o_totalprice AS charge")

    def links(self) -> DataFrame:
        return self.raw("orders").selectExpr("o_orderkey AS payer_claim_id", "o_orderkey AS order_id")

    def eobs(self) -> DataFrame:
        # exact amounts: whole cents and hundredths in integers, one decimal step at the end
        price, off, tax = (f"CAST(rint({c} * 100) AS BIGINT)" for c in ("l_extendedprice", "l_discount", "l_tax"))
        amount = "CAST(CAST({cents} AS DECIMAL(16,0)) * 0.01BD AS DECIMAL(18,2))"
        allowed = f"({price} * (100 - {off}) + 50) DIV 100"
        payment = f"({price} * (100 - {off}) * (100 + {tax}) + 5000) DIV 10000"
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS zc_id",
            "l_shipdate AS production_date",
            "l_shipdate + make_dt_interval(l_linenumber) AS issue_date",
            f"{amount.format(cents=allowed)} AS allowed",
            f"{amount.format(cents=payment)} AS payment",
            "l_linenumber AS status_code_id",
            "l_partkey AS part_id",
            "l_suppkey AS payer_id",
        )

    def history(self) -> DataFrame:
        return self.raw("orders").selectExpr("o_orderkey AS zc_id", "o_orderkey AS history_id")

    def claim_events(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey AS history_id",
            "CASE WHEN l_returnflag = 'R' THEN 'CLAIM DENIED BY PAYER' WHEN l_returnflag = 'A' THEN '' END AS raw_message",
            "l_shipdate AS date",
        )

    def documents_sent(self) -> DataFrame:
        return self.raw("lineitem").where("l_returnflag <> 'N'").selectExpr(
            "l_orderkey AS zc_id",
            "CASE WHEN l_linenumber % 2 = 0 THEN 'first_appeal' ELSE 'second_appeal' END AS source_type",
            "l_shipdate AS created_at",
        )

    def first_appeals(self) -> DataFrame:
        return self.raw("orders").where("o_orderstatus <> 'P'").selectExpr(
            "o_orderkey AS zc_id", "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS appeal_type"
        )

    def carts(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS cart_id",
            "CASE WHEN event_type = 'purchase' THEN user_id WHEN event_type = 'signup' THEN event_id END AS order_id_modified",
            "ts AS cart_created_date",
            "ts AS created_at",
            "user_id AS owner_id",
            "CASE WHEN event_type = 'purchase' THEN user_id END AS prescription_id",
            "CASE WHEN event_type = 'signup' THEN event_id END AS order_id",
            """CASE user_id % 4 WHEN 0 THEN 'pap' WHEN 1 THEN 'cash_pay_program' WHEN 2 THEN 'patient_responsibility' END
               AS program""",
            """CASE user_id % 4 WHEN 0 THEN '1. pap' WHEN 1 THEN '2. cash_pay_program'
               WHEN 2 THEN '3. patient_responsibility' ELSE '4. legacy_or_misc_programs' END AS program_category""",
            "CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS product",
            "event_type AS source",
            "CASE WHEN event_type <> 'error' THEN event_id END AS delivery_id",
            "CASE WHEN event_type IN ('purchase', 'signup') THEN event_id END AS sample_id",
            "CASE WHEN event_type IN ('purchase', 'signup') THEN event_id % 40 END AS kit_received_time_in_days",
            "value",
        )

    def spend(self, event_type: str) -> DataFrame:
        return self.raw("events").where(F.col("event_type") == event_type).selectExpr(
            "ts AS day", "CAST(value AS DECIMAL(18,2)) AS spend"
        )

    def arms(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "concat('exp-', event_type, ':', CAST(user_id % 2 AS STRING)) AS checkout_version",
            "event_id AS cart_id",
            "CASE WHEN event_id % 3 = 0 THEN user_id END AS order_id_modified",
            "CASE WHEN event_id % 3 = 0 THEN event_id END AS delivery_id",
            "CASE WHEN event_id % 6 = 0 THEN event_id END AS sample_id",
            "CASE WHEN event_id % 3 = 0 THEN event_id % 5 + 1 END AS kits_requested",
            "CASE WHEN event_id % 6 = 0 THEN event_id % 45 END AS kit_received_time_in_days",
            "CASE WHEN event_id % 2 = 0 THEN event_id % 45 END AS time_to_sample_return",
            "CASE event_id % 4 WHEN 0 THEN 'RELEASED' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'RECEIVED' ELSE 'CANCELLED' END AS order_state",
            "CASE user_id % 4 WHEN 0 THEN 'pap' WHEN 1 THEN 'cash_pay_program' ELSE 'patient_responsibility' END AS program",
        )

    def blocked(self) -> DataFrame:
        return self.raw("lineitem").where("l_returnflag = 'A' AND l_linestatus = 'O'").selectExpr(
            "l_shipdate AS sample_received",
            "l_orderkey AS sample_id",
            "CAST(16 + l_suppkey % 2 AS INT) AS kit_type",
            "l_orderkey * 10 + l_linenumber AS ssr",
            "CAST(l_suppkey % 27 AS INT) AS issue_id",
        )

    def issue_types(self) -> DataFrame:
        return self.raw("nation").selectExpr(
            "n_nationkey AS issue_id", "CASE WHEN n_regionkey = 0 THEN 'N' ELSE 'B' END AS issue_type",
            "n_name AS issue_type_description",
        )

    def payer_rows(self) -> DataFrame:
        """Claims with six procedure codes (some absent), one row per line item."""
        code = "CASE WHEN (l_partkey + {i}) % 4 <> 0 THEN (l_partkey * {i} + l_suppkey) % 50000 END AS proccode_{i}"
        lines = self.raw("lineitem").selectExpr(
            "xxhash64(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS id",
            "l_shipdate AS issue_date",
            "l_suppkey",
            "l_extendedprice AS payment",
            *[code.format(i=i) for i in range(1, 7)],
            *[f"CASE WHEN l_linenumber <> {i} THEN CAST(l_linenumber % 3 + 1 AS DECIMAL(4,0)) END AS units_{i}" for i in range(1, 7)],
        )
        names = self.raw("supplier").selectExpr("s_suppkey AS l_suppkey", "s_name AS payer_name")
        return lines.join(names, "l_suppkey")

    def rate_card(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS HCPCS", "CAST(p_retailprice AS DECIMAL(12,2)) AS RATE2019",
            "CASE WHEN p_size % 10 = 0 THEN 'QW' WHEN p_size % 10 = 1 THEN 'TC' END AS MOD",
        )


_PRICE, _OFF, _TAX = "CAST(l_extendedprice AS DECIMAL(12,2))", "CAST(l_discount AS DECIMAL(4,2))", "CAST(l_tax AS DECIMAL(4,2))"

VIEW_SQL = {
    "v_order": """SELECT o_orderkey AS order_id, o_orderdate AS created_at,
        CASE WHEN o_orderstatus = 'F' THEN 'RELEASED' WHEN o_orderstatus = 'O' THEN 'APPROVED'
             WHEN o_orderkey % 10 = 0 THEN 'DRAFT' WHEN o_orderkey % 10 = 1 THEN 'CANCELLED'
             WHEN o_orderkey % 10 = 2 THEN 'PENDING_PATIENT_INFO' WHEN o_orderkey % 10 = 3 THEN 'REJECTED'
             WHEN o_orderkey % 10 = 4 THEN 'WAITING_FOR_PAYMENT' WHEN o_orderkey % 10 = 5 THEN 'CREATED'
             WHEN o_orderkey % 10 = 6 THEN 'RECOLLECTED' ELSE 'RECEIVED' END AS state,
        o_custkey AS owner_id,
        CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN o_custkey END AS prescription_id,
        o_orderpriority AS source,
        CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN 'trf_transcribed'
             WHEN '3-MEDIUM' THEN 'free_of_approval' WHEN '4-NOT SPECIFIED' THEN 'patient_doctor_none'
             ELSE 'cashpay_online' END AS order_flow,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey END AS sample_id,
        CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey END AS delivery_id,
        CAST(o_custkey % 5 AS INTEGER) AS order_type_id,
        CASE WHEN o_orderstatus <> 'P' THEN o_totalprice > 250000 END AS billed,
        o_orderkey % 3 + 1 AS version FROM orders""",
    "v_type": "SELECT r_regionkey AS order_type_id, lower(r_name) AS code, r_name AS clinical_type_name FROM region",
    "v_shipment": """SELECT l_orderkey AS order_id, l_orderkey AS delivery_id, l_orderkey * 10 + l_linenumber AS shipment_id,
        l_shipdate AS ship_date, l_shipdate + to_days(l_linenumber) AS delivered_date, l_shipdate AS created_at,
        CASE WHEN l_returnflag = 'R' THEN 'RETURN' ELSE 'NORMAL' END AS type, l_partkey AS part_id,
        l_suppkey AS carrier_id FROM lineitem""",
    "v_sample": """SELECT l_orderkey AS sample_id, min(l_shipdate) AS received,
        CASE WHEN l_orderkey % 13 = 0 THEN 'study-' ELSE 'kit-' END || l_orderkey AS kit_barcode,
        CAST(16 + l_orderkey % 2 AS INTEGER) AS kit_type,
        CASE min(l_linenumber) % 4 WHEN 0 THEN 'recollected' WHEN 3 THEN 'final-rejected' ELSE 'success' END
          AS sample_process_status
        FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey""",
    "v_kit": """SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'study-' ELSE 'kit-' END || o_orderkey AS barcode,
        CAST(16 + o_orderkey % 2 AS INTEGER) AS kit_type, o_orderdate AS registered FROM orders""",
    "v_status": """SELECT l_orderkey AS order_id, l_orderkey * 10 + l_linenumber AS status_id,
        CASE WHEN l_returnflag = 'N' THEN 'APPROVED' ELSE 'RELEASED' END AS status, l_shipdate AS created_at
        FROM lineitem WHERE l_linestatus = 'F'""",
    "v_result": """SELECT l_orderkey * 10 + l_linenumber AS result_id, l_orderkey AS order_id,
        CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'corrected' ELSE 'final' END AS result_status,
        l_shipdate + to_hours(6 * l_linenumber) AS result_created_at, l_partkey AS part_id FROM lineitem""",
    "v_meta": """SELECT l_orderkey AS order_id,
        CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_linenumber = 1 THEN 'Sample Received'
             WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 1 THEN 'Upgraded from BAv1'
             WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_linenumber = 2 THEN 'Upgraded from BBv2'
             WHEN l_returnflag = 'A' AND l_linestatus = 'O' AND l_linenumber = 3 THEN 'Starter Upgrade'
             WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 4 THEN 'VIP'
             WHEN l_returnflag = 'A' AND l_linestatus = 'F' AND l_linenumber = 5 THEN 'recollected_from'
             ELSE l_returnflag || '-' || l_linestatus END AS value FROM lineitem""",
    "v_meta_text": "SELECT order_id, string_agg(value, ', ' ORDER BY value) AS order_meta_values FROM v_meta GROUP BY order_id",
    "v_tracking": """SELECT event_id AS order_id,
        CASE event_type WHEN 'click' THEN 'google' WHEN 'view' THEN 'facebook' WHEN 'purchase' THEN 'facebook.com'
             WHEN 'error' THEN 'blog' END AS utm_source,
        CASE user_id % 5 WHEN 0 THEN 'cpc' WHEN 1 THEN 'organic' WHEN 2 THEN 'paid_social' WHEN 3 THEN 'referral' END
          AS utm_medium,
        'campaign-' || CAST(user_id % 3 AS VARCHAR) AS utm_campaign FROM events""",
    "v_claim": """SELECT o_orderkey AS id, o_orderkey AS order_id, o_orderdate + to_hours(o_orderkey % 20) AS creation_date,
        o_orderdate + to_days(CAST(o_custkey % 15 AS INTEGER)) + to_hours(o_orderkey % 24) AS billing_date,
        o_orderpriority AS product, CASE o_orderkey % 3 WHEN 1 THEN false WHEN 2 THEN true END AS resubmitted,
        o_orderkey % 3 + 1 AS version FROM orders""",
    "v_linked": """SELECT o_orderkey AS zc_id, o_orderkey // 2 AS claim_id, o_orderkey AS order_id, c.product, c.version,
        c.billing_date FROM orders JOIN v_claim c ON c.order_id = o_orderkey""",
    "v_eob": f"""SELECT l_orderkey AS zc_id, l_shipdate AS production_date, l_shipdate + to_days(l_linenumber) AS issue_date,
        CAST(round({_PRICE} * (1 - {_OFF}), 2) AS DECIMAL(18,2)) AS allowed,
        CAST(round({_PRICE} * (1 - {_OFF}) * (1 + {_TAX}), 2) AS DECIMAL(18,2)) AS payment,
        l_linenumber AS status_code_id, l_partkey AS part_id, l_suppkey AS payer_id FROM lineitem""",
    "v_cart": """SELECT event_id AS cart_id,
        CASE WHEN event_type = 'purchase' THEN user_id WHEN event_type = 'signup' THEN event_id END AS order_id_modified,
        ts AS cart_created_date, ts AS created_at, user_id AS owner_id,
        CASE WHEN event_type = 'purchase' THEN user_id END AS prescription_id,
        CASE WHEN event_type = 'signup' THEN event_id END AS order_id,
        CASE user_id % 4 WHEN 0 THEN 'pap' WHEN 1 THEN 'cash_pay_program' WHEN 2 THEN 'patient_responsibility' END AS program,
        CASE user_id % 4 WHEN 0 THEN '1. pap' WHEN 1 THEN '2. cash_pay_program' WHEN 2 THEN '3. patient_responsibility'
             ELSE '4. legacy_or_misc_programs' END AS program_category,
        CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS product, event_type AS source,
        CASE WHEN event_type <> 'error' THEN event_id END AS delivery_id,
        CASE WHEN event_type IN ('purchase', 'signup') THEN event_id END AS sample_id,
        CASE WHEN event_type IN ('purchase', 'signup') THEN event_id % 40 END AS kit_received_time_in_days,
        value FROM events""",
    "v_arm": """SELECT 'exp-' || event_type || ':' || CAST(user_id % 2 AS VARCHAR) AS checkout_version, event_id AS cart_id,
        CASE WHEN event_id % 3 = 0 THEN user_id END AS order_id_modified,
        CASE WHEN event_id % 3 = 0 THEN event_id END AS delivery_id,
        CASE WHEN event_id % 6 = 0 THEN event_id END AS sample_id,
        CASE WHEN event_id % 3 = 0 THEN event_id % 5 + 1 END AS kits_requested,
        CASE WHEN event_id % 6 = 0 THEN event_id % 45 END AS kit_received_time_in_days,
        CASE WHEN event_id % 2 = 0 THEN event_id % 45 END AS time_to_sample_return,
        CASE event_id % 4 WHEN 0 THEN 'RELEASED' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'RECEIVED' ELSE 'CANCELLED' END AS order_state,
        CASE user_id % 4 WHEN 0 THEN 'pap' WHEN 1 THEN 'cash_pay_program' ELSE 'patient_responsibility' END AS program
        FROM events""",
    "v_blocked": """SELECT l_shipdate AS sample_received, l_orderkey AS sample_id, CAST(16 + l_suppkey % 2 AS INTEGER) AS kit_type,
        l_orderkey * 10 + l_linenumber AS ssr, CAST(l_suppkey % 27 AS INTEGER) AS issue_id
        FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O'""",
    "v_issue": """SELECT n_nationkey AS issue_id, CASE WHEN n_regionkey = 0 THEN 'N' ELSE 'B' END AS issue_type,
        n_name AS issue_type_description FROM nation""",
}
