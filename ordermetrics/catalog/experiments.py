"""Experiment and payer queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordermetrics.catalog.checks import ratio, with_views
from ordermetrics.catalog.views import Tables
from ordermetrics.operators.quantiles import described
from ordermetrics.operators.reshape import transposed
from ordermetrics.plans import experiments

MAP = [{"exp_name": f"Test {e}", "product": p, "exp_id": f"exp-{e}"} for e, p in
       (("click", "First"), ("view", "First"), ("purchase", "Second"), ("signup", "Second"), ("error", "First"))]
KINDS = ("click", "view", "purchase", "signup", "error")
START, END = "1996-01-01", "2000-12-31"
TOP, AT_LEAST = 50, 20


def m41_experiment_lookup(spark: SparkSession, folder: str) -> DataFrame:
    table = experiments.arm_comparison(Tables(spark, folder).arms())
    return experiments.measure_of_arm(table, experiments.experiment_map(spark, MAP), "orders_to_cart_ratio", "Test view", "First", "experiment")


def m42_arm_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return experiments.arm_comparison(Tables(spark, folder).arms())


def m43_return_curve(spark: SparkSession, folder: str) -> DataFrame:
    return experiments.return_curve(Tables(spark, folder).arms())


def m44_program_share(spark: SparkSession, folder: str) -> DataFrame:
    return experiments.program_share(Tables(spark, folder).arms())


def _differences(t: Tables) -> DataFrame:
    card = experiments.clean_rate_card(t.rate_card())
    return experiments.payer_differences(t.payer_rows(), card, START, END, TOP)


def m45_payer_benchmark(spark: SparkSession, folder: str) -> DataFrame:
    stats = experiments.payer_benchmark(_differences(Tables(spark, folder)), AT_LEAST, digits=None)
    # At these digits no exact value lies halfway between two roundings, so the
    # order in which doubles are summed cannot decide the comparison.
    places = {"min": 6, "q25": 6, "q50": 6, "q75": 6, "max": 6, "mean": 6, "std": 6, "aggregate_payment_difference": 4}
    return stats.withColumns({c: F.round(c, n) for c, n in places.items()})


def a08_described(spark: SparkSession, folder: str) -> DataFrame:
    """Summary statistics of order prices per priority."""
    return described(Tables(spark, folder).raw("orders"), "o_orderpriority", "o_totalprice").withColumns(
        {"mean": F.round("mean", 3), "std": F.round("std", 3)}
    )


def r02_transposed(spark: SparkSession, folder: str) -> DataFrame:
    """Arm table with measures in rows and variants in columns."""
    table = experiments.arm_comparison(Tables(spark, folder).arms())
    return transposed(
        table, "checkout_version", ["orders_to_cart_ratio", "total_kits_returned", "average_kits_requested"],
        [f"exp-{e}:{i}" for e in KINDS for i in (0, 1)],
    ).withColumnsRenamed({f"exp-{e}:{i}": f"{e}_{i}" for e in KINDS for i in (0, 1)})


QUERIES = {
    f.__name__: f
    for f in (m41_experiment_lookup, m42_arm_comparison, m43_return_curve, m44_program_share, m45_payer_benchmark, a08_described, r02_transposed)
}

# --- checking SQL ---------------------------------------------------------

_ARMS = f"""SELECT checkout_version, {ratio('count(DISTINCT order_id_modified)', 'count(DISTINCT cart_id)')} AS orders_to_cart_ratio,
  CAST(sum(kits_requested) AS DOUBLE) / count(kits_requested) AS average_kits_requested, count(DISTINCT sample_id) AS total_kits_returned,
  CAST(sum(kit_received_time_in_days) AS DOUBLE) / count(kit_received_time_in_days) AS kit_received_time_in_days,
  {ratio('count(DISTINCT sample_id)', 'count(DISTINCT delivery_id)')} AS sample_to_kit_delivered_ratio FROM v_arm GROUP BY 1"""


def _code(i: int) -> str:
    return f"CASE WHEN (l_partkey + {i}) % 4 <> 0 THEN (l_partkey * {i} + l_suppkey) % 50000 END"



_RATE_JOINS = " ".join(f"LEFT JOIN card k{i} ON k{i}.code = c{i}" for i in range(1, 7))
_RATE_SUM = " + ".join(f"coalesce(k{i}.rate, 0) * coalesce(u{i}, 0)" for i in range(1, 7))
_CODE_COUNT = " + ".join(f"CASE WHEN c{i} IS NOT NULL THEN 1 ELSE 0 END" for i in range(1, 7))
_PAYER = f"""WITH card AS (SELECT p_partkey AS code, CAST(p_retailprice AS DECIMAL(12,2)) AS rate FROM part WHERE p_size % 10 <> 0),
claim AS (SELECT s_name AS payer, CAST(l_extendedprice AS DECIMAL(12,2)) AS pay,
  {', '.join(f'{_code(i)} AS c{i}' for i in range(1, 7))},
  {', '.join(f'CASE WHEN l_linenumber <> {i} THEN l_linenumber % 3 + 1 END AS u{i}' for i in range(1, 7))}
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_shipdate >= TIMESTAMP '{START}' AND l_shipdate < TIMESTAMP '2001-01-01'),
top AS (SELECT payer FROM claim GROUP BY 1 ORDER BY count(*) DESC, payer LIMIT {TOP}),
diff AS (SELECT payer, CAST(pay AS DOUBLE) - CAST({_RATE_SUM} AS DOUBLE) / nullif({_CODE_COUNT}, 0) AS d FROM claim {_RATE_JOINS}
  WHERE payer IN (SELECT payer FROM top)),
s AS (SELECT payer, count(d) AS n, avg(d) AS m, stddev_samp(d) AS sd, min(d) AS lo, quantile_cont(d, 0.25) AS a, quantile_cont(d, 0.5) AS b, quantile_cont(d, 0.75) AS c, max(d) AS hi
  FROM diff GROUP BY 1)
SELECT payer AS payer_name, n AS count, round(m, 6) AS mean, round(sd, 6) AS std, round(lo, 6) AS min, round(a, 6) AS q25, round(b, 6) AS q50, round(c, 6) AS q75,
  round(hi, 6) AS max, round(n * m, 4) AS aggregate_payment_difference FROM s WHERE n >= {AT_LEAST}"""

ORACLE = {
    "m41_experiment_lookup": with_views("v_arm", body=f"SELECT checkout_version, orders_to_cart_ratio FROM ({_ARMS}) WHERE checkout_version = 'exp-view:1'"),
    "m42_arm_comparison": with_views("v_arm", body=_ARMS),
    "m43_return_curve": with_views(
        "v_arm",
        body="""WITH size AS (SELECT checkout_version, count(*) AS total FROM v_arm GROUP BY 1),
        ret AS (SELECT checkout_version, time_to_sample_return, row_number() OVER (PARTITION BY checkout_version ORDER BY time_to_sample_return) AS k FROM v_arm
          WHERE order_state IN ('RELEASED', 'RECEIVED', 'RECOLLECTED') AND time_to_sample_return IS NOT NULL)
        SELECT r.checkout_version, time_to_sample_return, CAST(max(k) AS DOUBLE) / max(total) * 100 AS percent_returned
        FROM ret r JOIN size s ON s.checkout_version = r.checkout_version GROUP BY 1, 2"""),
    "m44_program_share": with_views(
        "v_arm", body="""SELECT checkout_version, program, count(*) AS program_count,
        CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY checkout_version) AS DOUBLE) * 100 AS percent FROM v_arm GROUP BY 1, 2"""),
    "m45_payer_benchmark": _PAYER,
    "a08_described": """SELECT o_orderpriority, count(o_totalprice) AS count, round(avg(o_totalprice), 3) AS mean, round(stddev_samp(o_totalprice), 3) AS std, min(o_totalprice) AS min,
        quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS q50, quantile_cont(o_totalprice, 0.75) AS q75, max(o_totalprice) AS max FROM orders GROUP BY 1""",
    "r02_transposed": with_views(
        "v_arm",
        body=f"""WITH a AS ({_ARMS}), l AS (SELECT checkout_version AS v, 'orders_to_cart_ratio' AS metric, orders_to_cart_ratio AS x FROM a
        UNION ALL SELECT checkout_version, 'total_kits_returned', CAST(total_kits_returned AS DOUBLE) FROM a UNION ALL SELECT checkout_version, 'average_kits_requested', average_kits_requested FROM a)
        SELECT metric, """ + ", ".join(f"max(x) FILTER (v = 'exp-{e}:{i}') AS {e}_{i}" for e in KINDS for i in (0, 1)) + " FROM l GROUP BY 1"),
}
