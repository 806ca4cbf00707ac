import bisect
import random
import statistics
from datetime import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ordermetrics import catalog
from ordermetrics.functions.timeframe import days_floor
from ordermetrics.operators import calendar, distinct, gaps, joins, metadata, prefix, quantiles, rank, reshape, trend
from ordermetrics.schemas import SCHEMAS, SchemaError, check_schema


def test_latest_and_first_with_nulls_and_ties(frame, rows):
    df = frame([("k", 1, 3), ("k", None, 2), ("k", 1, 1), ("j", 5, 9)], "key string, v int, id int")
    assert rows(rank.latest_per_key(df, ["key"], ["v"], ["id"])) == [("j", 5, 9), ("k", None, 2)]
    assert rows(rank.first_per_key(df, ["key"], ["v"], ["id"])) == [("j", 5, 9), ("k", 1, 1)]


def test_hot_key_shrinks_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("key"), "id")
    plan = rank.latest_per_key(df, ["key"], ["id"])._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in below


def test_numbering_equals_row_number_on_a_skewed_key(spark, rows):
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("key"),
        ((F.col("id") * 7919) % 90).alias("day"), "id",
    )
    got = prefix.numbered(df, ["key"], ["day", "id"], "n")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("day", "id")).cast("long"))
    assert rows(got) == rows(want)


def test_top_groups_break_ties_by_name(frame, rows):
    df = frame([("b",), ("a",), ("c",), ("c",)], "g string")
    assert [r["g"] for r in rank.top_groups(df, "g", F.count(F.lit(1)), 2).collect()] == ["c", "a"]


def test_fill_periods_adds_zero_and_null(frame, rows):
    df = frame([("2024-01-01", 2, 1.5), ("2024-04-01", 1, 2.5)], "m timestamp_ntz, n int, x double")
    got = rows(calendar.fill_periods(df, "m", "MONTH", zero=["n"]))
    assert got == [(dt(2024, 1, 1), 2, 1.5), (dt(2024, 2, 1), 0, None), (dt(2024, 3, 1), 0, None), (dt(2024, 4, 1), 1, 2.5)]
    assert calendar.fill_periods(df.where("false"), "m", "MONTH", zero=["n"]).count() == 0


def test_fiscal_labels(spark, frame):
    df = frame([("2024-03-02 12:00:00",), ("2024-03-03 00:00:00",)], "t timestamp_ntz")
    labels = df.select(*[calendar.period_label("t", g) for g in calendar.GRAINS]).collect()
    assert [tuple(r) for r in labels] == [("2024-02-25", "3/2024", "2024Q1", "2024"), ("2024-03-03", "3/2024", "2024Q1", "2024")]
    table = calendar.fiscal_calendar(spark, "2024-02-25", "2024-03-05")
    assert table.count() == 10
    joined = calendar.with_period(df, "t", "Quarterly", table)
    assert {r["period"] for r in joined.collect()} == {"2024Q1"}


def test_distinct_when_counts_entities_not_rows(frame, rows):
    df = frame([("g", 1, True), ("g", 1, False), ("g", 2, None), ("g", None, True), ("h", 3, False)], "g string, e int, ok boolean")
    got = distinct.distinct_when(df, ["g"], "e", {"all_": F.lit(True), "good": F.col("ok")})
    assert rows(got) == [("g", 2, 1), ("h", 1, 0)]
    assert rows(distinct.distinct_when(df.where("false"), [], "e", {"n": F.lit(True)})) == [(0,)]


def test_stacked_distinct_mixes_id_types(frame, rows):
    a, b = frame([("g", 1), ("g", 1)], "g string, id int"), frame([("g", "x"), ("h", None)], "g string, id string")
    got = distinct.stacked_distinct({"a": (a, F.col("id")), "b": (b, F.col("id"))}, ["g"])
    assert rows(got) == [("g", 1, 1)]


def test_join_null_keys_and_text_keys(frame):
    a, b = frame([(1,), (None,)], "x int"), frame([("1",), (None,)], "y string")
    assert joins.join_on(a, b, {"x": "y"}, "inner", as_text=True).count() == 1
    assert joins.join_on(a, b, {"x": "y"}, "inner", as_text=True, null_safe=True).count() == 2


def test_full_shipment_join_equals_plain_full_join(spark, rows):
    random.seed(1)
    data = [(random.choice([1, 1, 1] + list(range(20))), i, random.choice(["NORMAL", "RETURN"])) for i in range(300)]
    ships = spark.createDataFrame(data, "order_id int, ship_date int, type string")
    got = joins.sent_with_latest_return(ships, by=["ship_date"])
    back = ships.where("type = 'RETURN'").groupBy("order_id").agg(F.max("ship_date").alias("kit_return_ship_date"))
    want = ships.where("type = 'NORMAL'").select("order_id", F.col("ship_date").alias("kit_sent_ship_date")).join(back, "order_id", "full")
    assert rows(got) == rows(want)


def test_rate_lookup_has_one_answer_for_any_card(spark, frame, rows):
    claims = frame([(1, "a", "b", 2.0, None), (2, None, "zz", 1.0, 1.0), (3, None, None, 1.0, 1.0), (4, "a", "a", 1.0, 3.0)],
                   "id int, c1 string, c2 string, u1 double, u2 double")
    card = frame([("a", 10.0), ("b", 5.0)], "code string, rate double")
    args = (["c1", "c2"], ["u1", "u2"], card, "code", "rate")
    twice = claims.union(claims.where("id = 1")).union(claims.where("id = 4").withColumn("id", F.lit(None)))
    got = joins.rates_by_row(twice, *args)
    assert rows(got, "id", "rate_total", "code_count") == sorted(
        [(1, 20.0, 2), (1, 20.0, 2), (2, 0.0, 1), (3, None, None), (4, 40.0, 2), (None, 40.0, 2)], key=repr)
    large = card.union(spark.range(300_000).select(F.concat(F.lit("x"), F.col("id").cast("string")), F.lit(1.0)))
    assert rows(joins.rates_by_row(twice, ["c1", "c2"], ["u1", "u2"], large, "code", "rate"), "id", "rate_total", "code_count") == rows(got, "id", "rate_total", "code_count")
    with pytest.raises(Exception, match="more than once"):
        joins.rates_by_row(claims, ["c1", "c2"], ["u1", "u2"], card.union(card), "code", "rate").collect()


@pytest.mark.parametrize("seed", range(4))
def test_digest_answers_like_the_joined_text(spark, seed):
    random.seed(seed)
    words = ["upgraded from BAv1", "V1 is upgraded from old", "Upgraded from ", "upgraded from", "v2 note", "a v1", "zz v3", "VIP", "Starter upgrade", "kit", "Sample Received", "recollected_from", ""]
    data = [(k, random.choice(words)) for k in range(60) for _ in range(random.randint(1, 5))] + [(99, None)]
    meta = spark.createDataFrame(data, "order_id int, value string")
    phrases = ["upgraded from", "starter upgrade", "vip", "sample received", "recollected_from"]
    digest = metadata.phrase_digest(meta, "order_id", "value", "digest", phrases, "upgraded from", ["v1", "v2", "v3"])
    both = digest.join(metadata.joined_values(meta, "order_id", "value", "text"), "order_id")
    patterns = [f"%{p}%" for p in phrases] + [f"%upgraded from %{v}%" for v in ("v1", "v2", "v3")]
    for p in patterns:
        assert both.where(F.lower("digest").like(p) != F.lower("text").like(p)).count() == 0, p


def test_joined_values_keep_repeats_in_order(frame, rows):
    df = frame([(1, "b"), (1, "a"), (1, "b"), (2, None)], "k int, v string")
    assert rows(metadata.joined_values(df, "k", "v", "t")) == [(1, "a, b, b")]


def test_described_equals_numpy_on_a_hot_group(spark):
    rng = np.random.default_rng(0)
    data = [("hot", float(round(x, 1))) for x in rng.normal(100, 30, 5000)] + [("small", 4.0)] + [("two", 1.0), ("two", 2.0), ("two", None)]
    got = {r["g"]: r for r in quantiles.described(spark.createDataFrame(data, "g string, v double"), "g", "v").collect()}
    hot = np.array([v for g, v in data if g == "hot"])
    row = got["hot"]
    assert row["count"] == 5000 and row["min"] == hot.min() and row["max"] == hot.max()
    assert [row["q25"], row["q50"], row["q75"]] == pytest.approx(np.percentile(hot, [25, 50, 75]))
    assert row["mean"] == pytest.approx(hot.mean()) and row["std"] == pytest.approx(hot.std(ddof=1))
    assert got["small"]["std"] is None and got["small"]["q50"] == 4.0
    assert (got["two"]["count"], got["two"]["q25"]) == (2, 1.25)


def test_line_needs_two_points_and_recovers_a_line(frame):
    one = frame([(1, 5.0), (2, None)], "x int, y double")
    assert {r["p"] for r in trend.straight_line(one, "x", "y", "p").collect()} == {None}
    line = frame([(1, 3.0), (2, 5.0), (3, None), (10, None)], "x int, y double")
    assert [r["p"] for r in trend.straight_line(line, "x", "y", "p").orderBy("x").collect()] == [3.0, 5.0, 7.0, 21.0]


def test_running_total_ends_at_the_total(frame):
    values = [random.Random(3).randint(0, 9) for _ in range(50)]
    df = frame([(i, v) for i, v in enumerate(values)], "d int, n int")
    last = trend.running_total(df, "d", {"t": "n"}).orderBy(F.desc("d")).first()
    assert last["t"] == sum(values) and statistics.fmean(values) > 0


def test_transpose(frame, rows):
    df = frame([("p1", 1.0, 2.0), ("p2", 3.0, None)], "period string, a double, b double")
    assert rows(reshape.transposed(df, "period", ["a", "b"], ["p1", "p2"])) == [("a", 1.0, 3.0), ("b", 2.0, None)]


def test_schema_check_names_what_is_wrong(frame):
    df = frame([("x",)], "HCPCS string")
    with pytest.raises(SchemaError, match="RATE2019"):
        check_schema(df, SCHEMAS["rate_card"], "rates")


def test_series_align_on_their_index(frame, rows):
    a, b = frame([(1, 10), (2, 20)], "d int, x int"), frame([(2, 5), (3, 6)], "d int, y int")
    assert rows(joins.aligned([a, b], ["d"])) == [(1, 10, None), (2, 20, 5), (3, None, 6)]


def test_rows_with_other_columns_are_stacked_and_frequencies_sorted(frame):
    stacked = rank.append_rows(frame([("a",), ("b",)], "x string"), frame([("b", 1)], "x string, y int"))
    assert [tuple(r) for r in rank.frequency(stacked, "x").collect()] == [("b", 2), ("a", 1)]
    assert [r["y"] for r in rank.sorted_by(stacked, "y", "x", ascending=False).collect()] == [1, None, None]


def test_running_sum_without_keys_equals_a_window(spark, rows):
    df = spark.range(200).select((F.col("id") * 37 % 200).alias("t"), (F.col("id") % 5).alias("n"))
    got = prefix.running_sum(df, [], ["t"], "n", "s")
    want = df.withColumn("s", F.sum("n").over(Window.orderBy("t")))
    assert rows(got, "t", "n", "s") == rows(want, "t", "n", "s")
    with pytest.raises(Exception, match="not one row each"):
        prefix.running_sum(df.union(df.limit(1)), [], ["t"], "n", "s").collect()


def test_prefix_scan_over_nulls_ties_and_a_hot_day(spark, frame, rows):
    # nine of ten rows on one day of one key, places that repeat, null keys and null order values
    df = spark.range(4000).select(
        F.when(F.col("id") % 10 > 0, F.lit("hot")).when(F.col("id") % 20 == 0, None).otherwise((F.col("id") % 70).cast("string")).alias("key"),
        F.when(F.col("id") % 10 > 0, F.lit(5)).when(F.col("id") % 30 == 0, None).otherwise(F.col("id") % 9).alias("day"),
        F.when(F.col("id") % 11 > 0, F.col("id").bitwiseAND(~1)).alias("at"), F.col("id").cast("string").alias("other"))
    got = prefix.numbered(df, ["key"], ["day", "at"], "n")
    order = [F.col(c).asc_nulls_last() for c in ("day", "at")]
    window = Window.partitionBy("key").orderBy(*order)
    # within a place any order is right: the numbers of a place are the same set
    want = df.withColumn("n", F.row_number().over(window).cast("long"))
    assert rows(got, "key", "day", "at", "n") == rows(want, "key", "day", "at", "n") and rows(got, "other") == rows(df, "other")
    narrow = prefix.numbered(df.drop("other"), ["key"], ["day", "at"], "n")
    assert rows(narrow, "key", "day", "at", "n") == rows(want, "key", "day", "at", "n")
    empty = prefix.numbered(df.where("false"), ["key"], ["day", "at"], "n")
    assert empty.columns == ["key", "day", "at", "other", "n"] and empty.count() == 0


def test_prefix_scan_stores_places_only_and_deals_a_hot_day_evenly(spark, monkeypatch):
    stored = []
    keep = prefix.written
    monkeypatch.setattr(prefix, "written", lambda df, purpose: stored.append(keep(df, purpose)) or stored[-1])
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(40_000).select(F.lit(1).alias("key"), F.when(F.col("id") % 10 > 0, F.lit(3)).otherwise(F.col("id") % 7).alias("day"), "id", F.lit("x" * 20).alias("wide"))
        got = prefix.numbered(df, ["key"], ["day", "id"], "n")
        assert got.agg(F.max("n"), F.count_distinct("n")).first() == (40_000, 40_000)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert set(stored[0].columns) == {"key", "day", "id", "__rows", "__value", "__part"}
    sizes = [r["count"] for r in stored[0].groupBy("__part").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 14_000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = prefix.numbered(df, ["key"], ["day", "id"], "n")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("hashpartitioning(__place") == 2  # the rows once, for window and join, and the places


def test_gap_sums_equal_all_pairs(spark, frame, rows):
    rng = random.Random(4)

    def moment():
        return None if rng.random() < 0.05 else f"2024-0{rng.randrange(1, 4)}-1{rng.randrange(9)} {rng.randrange(3):02d}:{rng.randrange(2):02d}:0{rng.randrange(2)}.00000{rng.randrange(3)}"

    starts = [(rng.choice([1, 2, 3, None]), rng.choice("ab"), moment()) for _ in range(120)]
    ends = [(rng.choice([1, 2, 4, None]), moment(), rng.randrange(1, 4)) for _ in range(90)]
    s = frame(starts, "k int, g string, s timestamp_ntz").where("s is not null")
    e = frame(ends, "k int, e timestamp_ntz, w long")
    got = gaps.day_gap_sums(s, e, ["k"], ["g"], "s", "e", "w")
    gap = days_floor("e", "s") * F.col("w")
    pairs = s.join(e.where("e is not null"), "k").groupBy("g").agg(F.sum(gap).cast("decimal(38,0)").alias("gap_days"), F.sum("w").cast("decimal(38,0)").alias("gap_pairs"))
    assert rows(got, "g", "gap_days", "gap_pairs") == rows(pairs, "g", "gap_days", "gap_pairs")
    assert gaps.day_gap_sums(s.where("k = 3"), e, ["k"], ["g"], "s", "e", "w").count() == 0  # no end at all
    open_ = frame([(3, None, 1)], "k int, e timestamp_ntz, w long")
    assert {tuple(r)[1:] for r in gaps.day_gap_sums(s, open_, ["k"], ["g"], "s", "e", "w").collect()} == {(0, 0)}


def test_gap_sums_scan_only_keys_that_cross_on_the_clock(frame, rows, monkeypatch):
    at = "2024-01-{:02d} {:02d}:00:00".format
    starts = [(1, "a", at(1, 0)), (1, None, at(2, 0)), (1, "a", at(1, 0)), (2, "a", at(1, 9)), (2, "b", at(3, 8)), (3, "a", at(1, 5)), (5, "a", at(1, 1)), (None, "a", at(1, 1))]
    ends = [(1, "x", at(4, 0), 2), (1, "y", at(5, 7), 1), (2, "x", at(2, 7), 3), (2, None, at(6, 9), 1), (3, "x", None, 4), (4, "x", at(1, 1), 1), (5, "y", at(3, 1), 5)]
    s, e = frame(starts, "k int, g string, s timestamp_ntz"), frame(ends, "k int, h string, e timestamp_ntz, w long")
    scanned, scan = [], gaps.running_sum
    monkeypatch.setattr(gaps, "running_sum", lambda *a: scanned.append(1) or scan(*a))

    def check(s, e):
        gap, w = days_floor("e", "s") * F.col("w"), F.when(F.col("e").isNotNull(), F.col("w")).otherwise(0)
        pairs = s.join(e, "k").groupBy("g", "h").agg(
            F.coalesce(F.sum(gap), F.lit(0)).cast("decimal(38,0)").alias("gap_days"), F.sum(w).cast("decimal(38,0)").alias("gap_pairs"))
        got = gaps.day_gap_sums(s, e, ["k"], ["g", "h"], "s", "e", "w")
        assert rows(got, "g", "h", "gap_days", "gap_pairs") == rows(pairs, "g", "h", "gap_days", "gap_pairs")

    check(s, e)
    assert not scanned  # every key and group stands on one side
    check(s, e.union(frame([(1, "x", at(4, 6), 2), (1, None, at(4, 6), 1), (2, None, at(7, 8), 7)], "k int, h string, e timestamp_ntz, w long")))
    crossing = s.union(frame([(1, "a", at(3, 3)), (2, None, at(9, 9)), (2, None, at(9, 1))], "k int, g string, s timestamp_ntz"))
    check(crossing, e.union(frame([(1, "x", at(4, 2), 2), (1, "x", at(4, 4), 1), (2, None, at(7, 4), 7)], "k int, h string, e timestamp_ntz, w long")))
    assert scanned


def test_gap_sums_never_hold_the_pairs(spark):
    day = lambda c: (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("double")))
    s = spark.range(20_000).select(F.lit(1).alias("k"), day(F.col("id") * 7 % 86_400).alias("s"))
    e = spark.range(20_000).select(F.lit(1).alias("k"), day(F.col("id") * 11 % 86_400 + 86_400).alias("e"), F.lit(1).alias("w"))
    got = gaps.day_gap_sums(s, e, ["k"], [], "s", "e", "w").first()
    a, b = sorted(i * 7 % 86_400 for i in range(20_000)), sorted(i * 11 % 86_400 for i in range(20_000))
    behind = sum(bisect.bisect_left(b, x) for x in a)
    assert (got["gap_days"], got["gap_pairs"]) == (20_000**2 - behind, 20_000**2)


def test_aligned_raises_on_a_repeated_index_and_stacks_raw_rows(frame, rows):
    a, b = frame([(1, 10), (None, 20)], "d int, x int"), frame([(None, 5), (3, None)], "d int, y int")
    assert rows(joins.aligned([a, b], ["d"])) == sorted([(1, 10, None), (None, 20, 5), (3, None, None)], key=repr)
    assert rows(joins.aligned([a], ["d"])) == rows(a)
    with pytest.raises(Exception, match="more than once"):
        joins.aligned([a, b.union(b)], ["d"]).collect()
    raw = frame([(1, 2), (1, 3), (2, 4)], "d int, v int")
    got = joins.aligned_series({"x": (raw, F.col("v")), "y": (raw.where("d = 2"), F.lit(1))}, {"d": F.col("d")})
    assert rows(got) == [(1, 5, None), (2, 4, 1)]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_null_keys_of_a_left_join_are_dealt_to_all_tasks(spark, rows):
    left = spark.range(4000).select(F.when(F.col("id") % 5 == 0, (F.col("id") % 40).cast("int")).alias("k"), F.when(F.col("id") % 7 > 0, F.col("id")).alias("at"))
    right = spark.range(30).select(F.when(F.col("id") != 10, F.col("id")).alias("r"), (F.col("id") * 2).alias("v"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = joins.join_on(left, right, {"k": "r"}, spread=["at"])
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        # one in seven has the same value to deal by, too
        assert len(sizes) == 4 and max(sizes) < 2000
        assert got.columns == ["k", "at", "v"] and rows(got) == rows(joins.join_on(left, right, {"k": "r"}))
        pair = joins.join_on(left, right.withColumn("w", F.col("v")), {"k": "r", "at": "w"}, spread=["k", "at"])
        assert rows(pair) == rows(joins.join_on(left, right.withColumn("w", F.col("v")), {"k": "r", "at": "w"}))
        carts = catalog.queries()
        for name in ("j17_program_rows", "m28_orders_by_program"):
            plan = carts[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert "__dealt" in plan.split("hashpartitioning(use_for_join" if name[0] == "j" else "hashpartitioning(order_id_modified")[1].split(")")[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    with pytest.raises(ValueError):
        joins.join_on(left, right, {"k": "r"}, "inner", spread=["at"])


def test_rate_lookup_joins_the_card_once(spark, frame):
    claims = frame([(i, "a" if i % 3 else "b", "a", 1.0, 2.0) for i in range(60)], "id int, c1 string, c2 string, u1 double, u2 double")
    card = frame([("a", 10.0), ("b", 5.0)], "code string, rate double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.rates_by_row(claims, ["c1", "c2"], ["u1", "u2"], card, "code", "rate")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(__code") == 1 and plan.count("Join") == 2
        assert got.agg(F.sum("rate_total")).first()[0] == 60 * 20 + 40 * 10 + 20 * 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
