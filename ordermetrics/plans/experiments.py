"""Experiment arms and payer benchmark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ordermetrics.functions.classify import returned_flag
from ordermetrics.functions.predicates import in_days, min_group_size
from ordermetrics.functions.scalars import count_present, half_even, mean, ratio
from ordermetrics.operators.distinct import distinct_when, stacked_distinct
from ordermetrics.operators.joins import join_on, rates_by_row, semi_top
from ordermetrics.operators.quantiles import described
from ordermetrics.operators.rank import sorted_by, top_groups
from ordermetrics.operators.trend import running_share

ARMS = {"control": ":0", "experiment": ":1"}


def experiment_map(spark: SparkSession, rows: Sequence[Mapping[str, str]]) -> DataFrame:
    """(exp_name, product, exp_id) entries with one row per arm and its variant id."""
    base = spark.createDataFrame([(r["exp_name"], r["product"], r["exp_id"]) for r in rows],
                                 "exp_name string, product string, exp_id string")
    arms = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(s).alias("suffix")) for a, s in ARMS.items()]))
    return base.withColumn("__arm", arms).select(
        "exp_name", "product", "exp_id", F.col("__arm.arm").alias("arm"),
        F.concat("exp_id", "__arm.suffix").alias("checkout_version"),
    )


def measure_of_arm(table: DataFrame, arms: DataFrame, measure: str, exp_name: str, product: str, arm: str) -> DataFrame:
    """One measure of one arm, found through the experiment map."""
    wanted = arms.where((F.col("exp_name") == exp_name) & (F.col("product") == product) & (F.col("arm") == arm))
    return table.join(wanted.select("checkout_version"), "checkout_version").select("checkout_version", measure)


def arm_comparison(rows: DataFrame, version: str = "checkout_version") -> DataFrame:
    """Per variant: orders to carts, mean kits requested, kits returned, mean return days, samples to shipped kits."""
    means = rows.groupBy(version).agg(
        mean("kits_requested").alias("average_kits_requested"),
        mean("kit_received_time_in_days").alias("kit_received_time_in_days"),
    )
    # several COUNT(DISTINCT) in one aggregation would multiply every row before the first step
    ids = {"__carts": "cart_id", "__orders": "order_id_modified", "total_kits_returned": "sample_id", "__shipped": "delivery_id"}
    distinct = stacked_distinct({name: (rows, F.col(c)) for name, c in ids.items()}, [version])
    known = join_on(means, distinct, {version: version}, null_safe=True)
    return known.withColumns({name: F.coalesce(name, F.lit(0)) for name in ids}).select(
        version,
        ratio("__orders", "__carts").alias("orders_to_cart_ratio"),
        "average_kits_requested",
        "total_kits_returned",
        "kit_received_time_in_days",
        ratio("total_kits_returned", "__shipped").alias("sample_to_kit_delivered_ratio"),
    )


def return_curve(rows: DataFrame, version: str = "checkout_version", days: str = "time_to_sample_return",
                 state: str = "order_state") -> DataFrame:
    """Share of an arm's orders returned by each day, in percent.

    Numbering every returned order and taking the day's maximum equals a
    running sum of daily counts, which needs one row per day only.
    """
    returned = (returned_flag(state) == "Yes") & F.col(days).isNotNull()
    daily = rows.where(F.col(version).isNotNull()).groupBy(version, F.when(returned, F.col(days)).alias(days)).agg(
        F.count(F.lit(1)).alias("__n")
    )
    whole = daily.withColumn("__all", F.sum("__n").over(Window.partitionBy(version))).where(F.col(days).isNotNull())
    shared = running_share(whole, days, "__n", F.col("__all"), "percent_returned", [version])
    return shared.select(version, days, "percent_returned")


def program_share(rows: DataFrame, version: str = "checkout_version", program: str = "program") -> DataFrame:
    """Orders per program within each variant, with share in percent."""
    counts = rows.groupBy(version, program).agg(F.count(F.lit(1)).alias("program_count"))
    total = F.sum("program_count").over(Window.partitionBy(version))
    return counts.withColumn("percent", F.try_divide(F.col("program_count").cast("double"), total.cast("double")) * 100)


CODES = [f"proccode_{i}" for i in range(1, 7)]
UNITS = [f"units_{i}" for i in range(1, 7)]


def payer_differences(claims: DataFrame, rate_card: DataFrame, start, end, top: int = 100, codes: Sequence[str] = tuple(CODES),
                      units: Sequence[str] = tuple(UNITS), code: str = "HCPCS", rate: str = "RATE2019") -> DataFrame:
    """Payment minus benchmark rate per claim of the payers with most claims.

    The benchmark is the summed rate x units over the claim's codes divided by
    the number of codes; a claim without codes has none.
    """
    ranged = claims.where(in_days("issue_date", start, end))
    payers = top_groups(ranged.where(F.col("payer_name").isNotNull()), "payer_name", F.count("id"), top)
    chosen = semi_top(ranged, payers, "payer_name")
    needed = chosen.select("id", "payer_name", "payment", *codes, *units)
    joined = rates_by_row(needed, codes, units, rate_card, code, rate)
    benchmark = ratio("rate_total", "code_count")
    return joined.select("id", "payer_name", (F.col("payment").cast("double") - benchmark).alias("difference"))


def payer_benchmark(differences: DataFrame, at_least: int = 0, sort_by: str = "aggregate_payment_difference",
                    ascending: bool = True, digits: int | None = 2) -> DataFrame:
    """Summary statistics of the payment difference per payer; ``digits=None`` leaves them unrounded."""
    stats = described(differences, "payer_name", "difference")
    total = stats.withColumn("aggregate_payment_difference", F.col("count") * F.col("mean"))
    kept = min_group_size(total, "count", at_least)
    ordered = sorted_by(kept, sort_by, "payer_name", ascending=[ascending, True])
    if digits is None:
        return ordered
    rounded = ["mean", "std", "min", "q25", "q50", "q75", "max", "aggregate_payment_difference"]
    return ordered.withColumns({c: half_even(c, digits) for c in rounded})


def clean_rate_card(rate_card: DataFrame, excluded: str = "QW") -> DataFrame:
    """Rates without the waived-test modifier; rows with no modifier stay."""
    return rate_card.where(~F.coalesce(F.col("MOD") == excluded, F.lit(False)))
