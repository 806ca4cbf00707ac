"""Labels from a table of rules.

A rule row has one column for each attribute it looks at, a ``priority`` and the labels it gives. A null attribute stands for
any value, ``missing`` for no value. Of the rules that fit a row the one of greatest priority decides, so "the last rule
wins" is a number in the table and rules can be loaded, edited and versioned like any other data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = "(none)"


def labelled(df: DataFrame, rules: DataFrame, on: Sequence[str], labels: Sequence[str], missing: str = MISSING) -> DataFrame:
    """``df`` with the ``labels`` of its deciding rule, null where no rule fits.

    Rules are put in order by which attributes they name. Each kind meets the rows by one equi-join on those attributes, of which
    the winner is found before (``max_by`` the priority), so a row stays one row and nothing is grouped again. No join is
    hinted: a rule table is small, and Spark broadcasts it by its measured size. Of equal priorities the rule
    that names more attributes decides; two rules of one kind, values and priority raise.
    """
    text = [F.col(c).cast("string").alias(c) for c in on]
    # which attributes a rule names: at most 2^len(on) kinds reach the driver
    kinds = [tuple(r) for r in rules.select(*[F.col(c).isNotNull().alias(c) for c in on]).distinct().collect()]
    out, found = df, []
    for number, kind in enumerate(sorted(kinds, reverse=True)):
        named = [c for c, there in zip(on, kind, strict=True) if there]
        same = reduce(lambda a, b: a & b, [F.col(c).isNotNull() if there else F.col(c).isNull() for c, there in zip(on, kind, strict=True)])
        verdict = F.struct(F.col("priority").cast("long").alias("priority"), F.lit(len(named)).alias("named"), *labels)
        own = rules.where(same).select(*text, "priority", verdict.alias("__v"))
        keys = [f"__r{number}_{c}" for c in named]
        best = own.groupBy(*[F.col(c).alias(k) for c, k in zip(named, keys, strict=True)]).agg(
            F.max_by("__v", "priority").alias(f"__v{number}"), F.max("priority").alias("__top"), F.collect_list("priority").alias("__all"))
        twice = F.raise_error(F.lit("two rules have the same values and priority")).cast("boolean")
        tied = F.size("__all") > F.size(F.array_distinct("__all"))
        winners = best.where(F.when(tied, twice).otherwise(F.lit(True))).select(*keys, f"__v{number}")
        if named:
            fits = reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("string"), F.lit(missing)) == F.col(k) for c, k in zip(named, keys, strict=True)])
            out = out.join(winners, fits, "left").drop(*keys)
        else:  # rules that fit every row: one row
            out = out.withColumn("__any", F.lit(1)).join(winners.withColumn("__one", F.lit(1)), F.col("__any") == F.col("__one"), "left").drop("__any", "__one")
        found.append(F.col(f"__v{number}"))
    if not found:
        return df.withColumns({n: F.lit(None).cast(rules.schema[n].dataType) for n in labels})
    best = F.array_max(F.array(*found)) if len(found) > 1 else found[0]
    decided = out.withColumn("__best", best)
    return decided.withColumns({n: F.col(f"__best.{n}") for n in labels}).drop("__best", *[f"__v{i}" for i in range(len(found))])
