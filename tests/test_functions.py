from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from ordermetrics.functions import classify as C
from ordermetrics.functions import predicates as P
from ordermetrics.functions import scalars as S
from ordermetrics.functions import timeframe as T
from ordermetrics.functions.vocabulary import Vocabulary


def test_ranges_differ_only_at_their_ends(frame):
    df = frame([("2024-01-01 00:00:00",), ("2024-01-01 00:00:01",), ("2024-01-05 00:00:00",), ("2024-01-05 23:59:59",), ("2024-01-06 00:00:00",), (None,)], "t timestamp_ntz")
    counts = df.agg(
        F.count_if(P.in_days("t", "2024-01-01", "2024-01-05")), F.count_if(P.after_until("t", "2024-01-01", "2024-01-05")),
        F.count_if(P.between_midnights("t", "2024-01-01", "2024-01-05")),
    ).first()
    assert tuple(counts) == (4, 2, 3)


def test_negated_lists_and_nulls(frame):
    df = frame([("a",), ("b",), (None,)], "x string")
    assert df.where(P.not_in_keep_null("x", ["a"])).count() == 2
    assert df.where(P.not_in_drop_null("x", ["a"])).count() == 1


def test_all_sentinel_and_unknown_selector(frame):
    df = frame([("a", 1), ("b", 2)], "x string, y int")
    assert P.filter_choices(df, {"x": "All", "y": 2}).count() == 1
    assert P.where_optional(df, None).count() == 2


@pytest.mark.parametrize(
    "moment, left, right",
    [
        ("2024-01-01 10:00:00", dt(2023, 12, 25), dt(2024, 1, 7)),  # Monday belongs to the earlier bucket
        ("2024-01-02 00:00:00", dt(2024, 1, 1), dt(2024, 1, 7)),
        ("2024-01-07 23:59:59", dt(2024, 1, 1), dt(2024, 1, 7)),
        ("2024-01-08 00:00:00", dt(2024, 1, 1), dt(2024, 1, 14)),
    ],
)
def test_weekly_labels(frame, moment, left, right):
    row = frame([(moment,)], "t timestamp_ntz").select(T.bucket("t", "Weekly"), T.bucket_end("t", "Weekly")).first()
    assert tuple(row) == (left, right)


def test_unknown_frequency_is_refused(frame):
    with pytest.raises(ValueError, match="Hourly"):
        T.bucket("t", "Hourly")


def test_day_spans_round_down_and_count_dates(frame):
    df = frame(
        [("2024-03-10 01:00:00", "2024-03-10 02:00:00"), ("2024-03-11 00:30:00", "2024-03-10 23:30:00"), ("2024-03-12 00:00:00", "2024-03-10 00:00:00"), (None, "2024-03-10 00:00:00")],
        "later timestamp_ntz, earlier timestamp_ntz",
    )
    spans = [tuple(r) for r in df.select(T.days_floor("later", "earlier"), T.days_calendar("later", "earlier")).collect()]
    assert spans == [(-1, 0), (0, 1), (2, 2), (None, None)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_truncation_ignores_the_session_zone(spark, frame, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = frame([("2024-03-10 02:30:15.25",)], "t timestamp_ntz")
        row = df.select(T.truncated("hour", "t").cast("string"), T.truncated("week", "t").cast("string"), T.wall_clock(T.as_instant("t")).cast("string")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(row) == ("2024-03-10 02:00:00", "2024-03-04 00:00:00", "2024-03-10 02:30:15.25")


def test_month_bounds_over_year_end_and_short_month():
    jan = T.month_bounds("2024-01-31")
    assert (jan.previous_start, jan.current_start, jan.next_start) == (dt(2023, 12, 1), dt(2024, 1, 1), dt(2024, 2, 1))
    assert T.month_bounds("2024-03-31").same_day_previous == dt(2024, 2, 29)


def test_rounding_and_ratio(frame):
    df = frame([(2.5, 0.0), (3.5, 2.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(S.half_even("a", 0)).collect()] == [2.0, 4.0, None]
    assert [r[0] for r in df.select(S.ratio("a", "b")).collect()] == [None, 1.75, None]
    assert df.where("false").agg(S.sum_or_zero("a"), S.mean("a")).first() == (0.0, None)


def test_formats(frame):
    df = frame([(1234567.5,), (1234.0,), (-0.25,)], "x double")
    assert [tuple(r) for r in df.select(S.thousands_float("x"), S.money("x"), S.fixed("x", 3)).collect()] == [
        ("1,234,567.5", "$1,234,567.50", "1234567.500"), ("1,234.0", "$1,234.00", "1234.000"), ("-0.25", "$-0.25", "-0.250"),
    ]


VOCAB = Vocabulary("acme", "starter", ("BrandA", "BrandB", "Starter"), ("BA", "BB"))


@pytest.mark.parametrize(
    "state, billed, meta, delivery, prescription, stage",
    [
        ("REJECTED_BY_ACME", True, "Sample Received", "d", "p", "Misc."),
        ("APPROVED", True, None, "d", "p", "6. Orders that are billed"),
        ("APPROVED", None, "x, Sample Received", None, None, "5. Orders that received Samples"),
        ("RELEASED", False, None, None, None, "5. Orders that received Samples"),
        ("WAITING_FOR_PAYMENT", None, None, "d", None, "4. Orders that shipped Kits"),
        ("WAITING_FOR_PAYMENT", None, None, None, "p", "3. Orders Pending Action Items"),
        ("APPROVED", None, None, None, "p", "2. Orders in Multikit in Queue"),
        ("APPROVED", None, None, None, None, "1. Orders"),
        (None, None, None, None, None, "1. Orders"),
    ],
)
def test_funnel_order(frame, state, billed, meta, delivery, prescription, stage):
    df = frame([(state, billed, meta, delivery, prescription)], "state string, billed boolean, order_meta_values string, delivery_id string, prescription_id string")
    assert df.select(C.order_funnel(vocab=VOCAB)).first()[0] == stage


@pytest.mark.parametrize(
    "flow, channel",
    [(None, "Patient Initiated"), ("patient_doctor_acme", "Patient Initiated"), ("free_of_approval", "No Insurance"), ("emr_trascribed", "Doctor Initiated"), ("other", "Channel Undefined")],
)
def test_channel(frame, flow, channel):
    assert frame([(flow,)], "order_flow string").select(C.order_channel(vocab=VOCAB)).first()[0] == channel


@pytest.mark.parametrize(
    "source, medium, meta, flow, created, usual, recent",
    [
        (None, "cpc", None, None, "2018-09-19", "Before UTM Integration", "Before UTM Integration"),
        (None, "cpc", None, None, "2019-01-01", "cpc", "cpc"),
        (None, None, "Upgraded from X", None, "2019-01-01", "Upgrades with no UTM", "Upgrades with no UTM"),
        (None, None, "VIP", None, "2019-01-01", C.BACKEND, C.BACKEND_SHORT),
        (None, None, "recollected_from", None, "2019-01-01", C.BACKEND, C.BACKEND),
        (None, None, None, "reflex_orders", "2019-01-01", "HCP initiated orders with no UTM", "HCP initiated orders with no UTM"),
        (None, None, None, None, "2019-01-01", "No UTM Source", "No UTM Source"),
        ("facebook.com", "referral", None, None, "2019-01-01", "facebook", "referral"),
        ("bing", None, None, None, "2019-01-01", None, None),
    ],
)
def test_utm_fill(frame, source, medium, meta, flow, created, usual, recent):
    df = frame([(source, medium, meta, flow, created)], "utm_source string, utm_medium string, order_meta_values string, order_flow string, created_at timestamp_ntz")
    assert tuple(df.select(C.utm_filled(vocab=VOCAB), C.utm_filled(vocab=VOCAB, recent=True)).first()) == (usual, recent)


def test_last_rule_wins_and_first_rule_wins(frame):
    rules = [(F.col("x") > 0, "positive"), (F.col("x") > 10, "large")]
    row = frame([(20,)], "x int").select(C.first_match(rules, "none"), C.last_match(rules, "none")).first()
    assert tuple(row) == ("positive", "large")


def test_utm_mapping_leaves_other_pairs_null(frame):
    df = frame([("google", "cpc"), (None, None), ("Starter", "email"), ("google", "email")], "utm_source string, utm_medium string")
    got = [tuple(r)[2:] for r in C.with_utm_mapping(df, vocab=VOCAB).collect()]
    assert got == [("Online Performance Marketing", "SEM - Performance", "Google"), ("Brand Marketing", "Organic", "Direct"),
                   ("Online Performance Marketing", "Email", "Newsletter"), (None, None, None)]


def test_upgrade_details(frame):
    df = frame([("a, Upgraded from BAv2, c",), ("Upgraded from x, y v1",), ("STARTER UPGRADE",), ("upgraded from z",), (None,)], "order_meta_values string")
    assert [r[0] for r in df.select(C.upgrade_detail(vocab=VOCAB)).collect()] == [
        "V2 to V3 Upgrade", "V1 to V2 Upgrade", "Exp to Clinical Upgrade", "Other Upgrade", "Nonupgrade"]


def test_claim_prediction_bounds(frame):
    df = frame([("2023-12-01",), ("2024-01-20",), ("2020-01-01",), ("2024-03-01",)], "t timestamp_ntz")
    assert [r[0] for r in df.select(C.claim_prediction("t", "2024-01-10", "2024-02-10")).collect()] == ["lower_bound", "upper_bound", None, None]


def test_turnaround_bands(frame):
    df = frame([(-1,), (7,), (8,), (14,), (15,), (None,)], "d int")
    assert [r[0] for r in df.select(C.turnaround_band("d")).collect()] == ["Up to 7 days", "Up to 7 days", "8 - 14 days", "8 - 14 days", "15 days or more", None]
