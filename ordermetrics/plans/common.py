"""Pieces several metrics share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordermetrics.operators.rank import append_rows


class ProductCodes:
    """One logical product, different column and code in each table.

    ``codes[product][table] = (column, code)``. The filter becomes a literal
    predicate, which reaches the scan; 'all' or ``None`` filters nothing.
    """

    def __init__(self, codes: Mapping[str, Mapping[str, tuple[str, object]]]):
        self.codes = codes

    def only(self, df: DataFrame, product: str | None, table: str) -> DataFrame:
        if product is None or product.lower() == "all":
            return df
        column, code = self.codes[product][table]
        return df.where(F.col(column) == F.lit(code))


NO_PRODUCTS = ProductCodes({})


def side_by_side(*one_row_frames: DataFrame) -> DataFrame:
    """Single-row results as one row; the frames' columns must differ."""
    stacked = append_rows(*one_row_frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
