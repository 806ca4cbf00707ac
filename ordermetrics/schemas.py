"""Column contracts of the datasets and a check that raises on violation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, L, D, TS, B = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampNTZType(), T.BooleanType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


SCHEMAS: dict[str, T.StructType] = {
    # operations summary
    "ops_orders": _schema(order_id=S, order_created_at=TS, code=S, kit_type=S, upgrade_type=S, version=L, state=S,
                          sample_id=S, delivery_id=S),
    "ops_kits": _schema(shipment_id=S, order_item_id=S, item_type_id=S, type=S, ship_date=TS),
    "ops_samples": _schema(sample_received=TS, sample_id=S, product=L),
    "ops_reports": _schema(order_id=S, order_type_id=S, status_id=S, status=S, report_created_at=TS),
    "ops_bills": _schema(bill_id=S, order_id=S, billing_date=TS, product=S, resubmitted=B),
    "ops_payments": _schema(claim_id=S, charge=D, allowed=D, payment=D, coinsurance=D, deductible=D,
                            production_date=TS, issue_date=TS, product=S, version=L, order_id=S, rk=D),
    # lab operations
    "lab_orders": _schema(order_id=S, order_flow=S, order_created_at=TS, code=S, owner_id=S, state=S,
                          prescription_id=S, sample_id=S, delivery_id=S),
    "lab_kits": _schema(shipment_id=S, delivery_id=S, item_type_id=S, ship_date=TS),
    "lab_samples": _schema(sample_received=TS, sample_id=S, kit_type=L, registered=TS, sample_process_status=S),
    "lab_reports": _schema(order_id=S, state=S, sample_id=S, order_type_id=S, report_status=S, report_created_at=TS),
    "lab_results": _schema(result_id=S, order_id=S, result_status=S, result_created_at=TS),
    "lab_blocked": _schema(sample_received=TS, sample_id=S, vial_barcode=S, kit_type=L, registered=TS,
                           sample_process_status=S, tubeId=S, ssr=S, issue_id=S, issue_name=S),
    "issue_types": _schema(issue_id=S, issue_type=S, issue_type_description=S),
    # checkout, marketing, payer analysis
    "carts": _schema(cart_id=S, order_id_modified=S, cart_created_date=TS, program=S, program_category=S, product=S,
                     source=S, delivery_id=S, sample_id=S, kit_received_time_in_days=L),
    "spend": _schema(campaign_name=S, day=TS, spend=D),
    "payer_claims": T.StructType(
        _schema(id=S, issue_date=TS, payer_id=S, payer_name=S, payment=D, product=S).fields
        + [T.StructField(f"proccode_{i}", S) for i in range(1, 7)]
        + [T.StructField(f"units_{i}", D) for i in range(1, 7)]
    ),
    "rate_card": _schema(HCPCS=S, MOD=S, RATE2019=D),
    "fiscal_calendar": _schema(Date=TS, Week=TS, Month=S, Quarter=S, Year=S),
}


class SchemaError(ValueError):
    """A dataset lacks columns or carries other types than agreed."""


def check_schema(df: DataFrame, schema: T.StructType, name: str = "dataset") -> DataFrame:
    """The frame itself when it has all columns with the agreed types."""
    actual = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in schema.fields if f.name not in actual]
    wrong = [
        f"{f.name}: {actual[f.name].simpleString()} instead of {f.dataType.simpleString()}"
        for f in schema.fields
        if f.name in actual and actual[f.name] != f.dataType
    ]
    if missing or wrong:
        raise SchemaError(f"{name}: missing {missing}, wrong types {wrong}")
    return df
