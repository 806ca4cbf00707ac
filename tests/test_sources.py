import os
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordermetrics.schemas import SCHEMAS
from ordermetrics.operators import calendar, sketches
from ordermetrics.sources import layout, partitions, pulls, readers, snapshots
from ordermetrics.streaming import refresh


def test_csv_scan_casts_by_name_and_cuts_zones(spark, tmp_path):
    (tmp_path / "k.csv").write_text(
        "ship_date,shipment_id,delivery_id,item_type_id\n2019-01-02 03:04:05+00:00,k1,d1,i\n2019-01-02,k2,,i\n2019-01-02T03:04:05Z,k3,d3,i\n")
    got = readers.read_csv(spark, str(tmp_path / "k.csv"), SCHEMAS["lab_kits"], "kits").orderBy("shipment_id").collect()
    assert [r["ship_date"] for r in got] == [dt(2019, 1, 2, 3, 4, 5), dt(2019, 1, 2), dt(2019, 1, 2, 3, 4, 5)]
    assert got[1]["delivery_id"] is None
    with pytest.raises(ValueError, match="order_flow"):
        readers.read_csv(spark, str(tmp_path / "k.csv"), SCHEMAS["lab_orders"], "orders")


def test_csv_keeps_quotes_and_line_breaks_and_raises_on_faults(spark, frame, rows, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.StringType())])
    (tmp_path / "q.csv").write_text('id,n\n1,"say ""hi"", ok"\n2,"two\nlines"\n3,\n')
    assert rows(readers.read_csv(spark, str(tmp_path / "q.csv"), schema)) == [(1, 'say "hi", ok'), (2, "two\nlines"), (3, None)]
    texts = frame([(1, 'a "b" c'), (2, "x\ny, z"), (3, " blanks "), (4, "back\\slash"), (5, None)], "id bigint, n string")
    snapshots.export_csv(texts, str(tmp_path / "own"))
    assert rows(readers.read_csv(spark, str(tmp_path / "own"), schema)) == rows(texts)
    (tmp_path / "two").mkdir()
    (tmp_path / "two/a.csv").write_text("id,n\n1,x\n")
    (tmp_path / "two/b.csv").write_text("n,id\n20,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        readers.read_csv(spark, str(tmp_path / "two"), schema).collect()
    (tmp_path / "bad.csv").write_text("id,n\nseven,x\n")
    with pytest.raises(Exception, match="isn't bigint"):
        readers.read_csv(spark, str(tmp_path / "bad.csv"), schema).collect()


def test_json_arrays_over_several_lines(spark, rows, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.StringType())])
    (tmp_path / "a.json").write_text('[\n  {"id": 1, "n": "x"},\n  {"id": 2, "n": null}\n]\n')
    assert rows(readers.read_json_records(spark, str(tmp_path / "a.json"), schema, one_array=True)) == [(1, "x"), (2, None)]
    with pytest.raises(Exception):
        readers.read_json_records(spark, str(tmp_path / "a.json"), schema).collect()


def test_a_failing_pull_leaves_the_last_good_rows(spark, frame, rows, tmp_path):
    spec = pulls.PullSpec(str(tmp_path / "out"), "")
    pulls.full_pull(spark, spec, frame([(1,)], "n int"))
    with pytest.raises(Exception, match="gone"):
        pulls.full_pull(spark, spec, frame([(5,)], "n int").select(F.raise_error(F.lit("gone")).cast("int").alias("n")))
    assert rows(pulls.pulled(spark, spec.output)) == [(1,)]
    assert rows(pulls.full_pull(spark, spec, frame([(2,)], "n int"))) == [(2,)] and sorted(os.listdir(tmp_path)) == ["out"]
    assert len(pulls.dropped_leftovers(spark, spec.output)) == 2


def test_jdbc_options_split_a_query_into_ranges():
    source = readers.Database("db.example", "backend", "reader", "secret", kind="mysql")
    assert source.url == "jdbc:mysql://db.example:3306/backend" and "secret" not in repr(source)
    assert readers.jdbc_options(source, "SELECT 1")["query"] == "SELECT 1"
    split = readers.jdbc_options(source, "SELECT * FROM t", "id", 0, 100, 8)
    with pytest.raises(ValueError, match="bounds"):
        readers.jdbc_options(source, "SELECT 1", "id")
    assert split["dbtable"] == "(SELECT * FROM t) AS q" and split["numPartitions"] == "8" and "query" not in split


def test_parameters_are_bound_not_pasted(spark, frame):
    frame([("a", 1), ("b'; x", 2)], "name string, n int").createOrReplaceTempView("bound_test")
    got = readers.run_query(spark, "SELECT n FROM bound_test WHERE array_contains(:names, name) AND n >= :low", {"names": ["b'; x", "zz"], "low": 2})
    assert [r["n"] for r in got.collect()] == [2]


def test_spec_allows_line_breaks_in_queries():
    spec = pulls.PullSpec.from_json('{"output_file": "x", "query": "SELECT 1\n FROM t", "update_query_param_source": "t"}')
    assert spec.update_column == "t" and "\n" in spec.query


def test_incremental_pulls_equal_one_full_pull(spark, frame, rows, tmp_path):
    data = [(i, f"2024-01-0{1 + i // 3}") for i in range(12)]
    source = frame(data, "id int, t timestamp_ntz")
    spec = pulls.PullSpec(str(tmp_path / "out"), "", "t", ("id",))
    pulls.pull(spark, spec, source.where("id < 5"))  # ends inside a group of equal times
    pulls.pull(spark, spec, source.where("id < 9"))
    assert rows(pulls.pull(spark, spec, source)) == rows(source)
    assert rows(pulls.pull(spark, spec, source)) == rows(source)
    marks = [(e.number, e.mark, e.replaces) for e in pulls.commits(spark, spec.output)]
    assert marks == [(1, "2024-01-02 00:00:00", True), (2, "2024-01-03 00:00:00", False), (3, "2024-01-04 00:00:00", False), (4, "2024-01-04 00:00:00", False)]
    strict = pulls.new_rows(source, marks[0][1], "t")
    assert strict.count() == 6  # without a key, rows tied with the last value are left out
    assert pulls.new_rows(source, None, "t").count() == 12
    assert rows(pulls.compacted(spark, spec)) == rows(source)
    assert [(e.number, e.mark) for e in pulls.commits(spark, spec.output)] == [(5, marks[-1][1])]
    assert rows(pulls.pull(spark, spec, source.union(frame([(99, "2024-02-01")], "id int, t timestamp_ntz")))) == sorted([*rows(source), *rows(frame([(99, "2024-02-01")], "id int, t timestamp_ntz"))], key=repr)
    assert len(pulls.dropped_leftovers(spark, spec.output)) == 4 and pulls.pulled(spark, spec.output).count() == 13


def test_a_pull_that_dies_before_its_commit_is_not_read(spark, frame, rows, tmp_path, monkeypatch):
    source = frame([(i, i // 2) for i in range(10)], "id int, t int")
    spec = pulls.PullSpec(str(tmp_path / "out"), "", "t", ("id",))
    assert not pulls.target_exists(spark, spec.output)
    with pytest.raises(FileNotFoundError):
        pulls.pulled(spark, spec.output)
    pulls.pull(spark, spec, source.where("id < 4"))

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(pulls, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            pulls.pull(spark, spec, source)
        with pytest.raises(KeyboardInterrupt):
            pulls.full_pull(spark, spec, source.where("id = 7"))
    assert len(os.listdir(tmp_path / "out" / "rows")) == 3
    assert rows(pulls.pulled(spark, spec.output)) == rows(source.where("id < 4"))
    assert rows(pulls.pull(spark, spec, source)) == rows(source)
    assert len(pulls.dropped_leftovers(spark, spec.output)) == 2 and rows(pulls.pulled(spark, spec.output)) == rows(source)
    # two pulls that began from the same entry: the second to commit raises
    first = pulls.commits(spark, spec.output)[-1]
    with pytest.raises(Exception, match="exists|FileAlreadyExists"):
        pulls._commit(spark, spec.output, pulls.Commit(first.number, "rows/x", None, False))


def test_the_mark_comes_without_a_scan_of_the_target(spark, frame, tmp_path, monkeypatch):
    spec = pulls.PullSpec(str(tmp_path / "out"), "", "t")
    pulls.pull(spark, spec, frame([(1, 5)], "id int, t int"))
    pulls.pull(spark, spec, frame([(2, 6)], "id int, t int"))
    read = []
    monkeypatch.setattr(pulls, "_greatest", lambda rows, column, keep=pulls._greatest: read.extend(rows.inputFiles()) or keep(rows, column))
    got = pulls.pull(spark, spec, frame([(1, 5), (2, 6), (3, 7)], "id int, t int"))
    assert got.count() == 3 and read and all("/0000000003-" in f for f in read)


def test_newest_snapshot_fallback_archive_and_freshness(spark, frame, rows, tmp_path):
    root = str(tmp_path / "snap")
    for n, stamp in ((1, "20240101_000000"), (3, "20240103_000000"), (2, "20240102_000000")):
        snapshots.write_snapshot(frame([(n,)], "n int"), root, "t", stamp)
    assert rows(snapshots.read_newest(spark, root, "t")) == [(3,)]
    fresh = snapshots.refresh_or_last_good(spark, lambda: frame([(4,)], "n int"), root, "t", "20240104_000000")
    assert rows(fresh) == [(4,)]

    def breaks_midway():
        return frame([(5,)], "n int").select(F.raise_error(F.lit("gone")).cast("int").alias("n"))

    assert rows(snapshots.refresh_or_last_good(spark, breaks_midway, root, "t", "20240105_000000")) == [(4,)]
    snapshots.archive_before(spark, root, "t", "20240103_000000", str(tmp_path / "old"))
    assert rows(spark.read.parquet(str(tmp_path / "old/t")), "n") == [(1,), (2,)]
    age = snapshots.freshness(spark, {"t": f"{root}/t"}).first()
    assert age["dataset"] == "t" and age["last_pull"].year >= 2024
    with pytest.raises(ValueError):
        snapshots.write_snapshot(frame([(1,)], "n int"), root, "t", "yesterday")


def test_tables_of_like_names_keep_apart_and_archives_stay(spark, frame, rows, tmp_path):
    root, archive = str(tmp_path / "snap"), str(tmp_path / "old")
    snapshots.write_snapshot(frame([(1,)], "n int"), root, "orders", "20240101_000000")
    snapshots.write_snapshot(frame([(9,)], "n int"), root, "orders_eu", "20240501_000000")
    assert rows(snapshots.read_newest(spark, root, "orders")) == [(1,)]
    assert snapshots.newest_stamp(spark, root, "order") is None
    snapshots.archive_before(spark, root, "orders", "20240201_000000", archive)
    snapshots.write_snapshot(frame([(2,)], "n int"), str(tmp_path / "later"), "orders", "20240201_000000")
    snapshots.archive_before(spark, str(tmp_path / "later"), "orders", "20240301_000000", archive)
    snapshots.archive_before(spark, str(tmp_path / "none"), "orders", "20240301_000000", archive)
    assert rows(spark.read.parquet(f"{archive}/orders"), "n") == [(1,), (2,)]
    for name in ("carts_20240101_000000.csv", "carts_eu_20240301_000000.csv"):
        (tmp_path / name).write_text(f"n\n{len(name)}\n")
    got = snapshots.read_newest_csv(spark, str(tmp_path), "carts", lambda p: readers.read_csv(spark, p, T.StructType([T.StructField("n", T.LongType())])))
    assert got.first()["n"] == len("carts_20240101_000000.csv")


def test_upsert_by_product_and_double_rows(spark, frame, rows, tmp_path):
    root, schema = str(tmp_path / "days"), "date timestamp_ntz, product string, n int"
    snapshots.upsert_days(spark, frame([("2024-01-01", "a", 1), ("2024-01-01", "b", 2)], schema), root, "blocked", "20240101_000000", ["date", "product"])
    got = snapshots.upsert_days(spark, frame([("2024-01-01", "b", 3)], schema), root, "blocked", "20240102_000000", ["date", "product"])
    assert rows(got, "product", "n") == [("a", 1), ("b", 3)]
    with pytest.raises(ValueError, match="several rows"):
        snapshots.upsert_days(spark, frame([("2024-01-01", "a", 1), ("2024-01-01", "a", 2)], schema), root, "blocked", "20240103_000000", ["date", "product"])


def test_newest_csv_by_stamp_in_its_name(spark, tmp_path):
    for stamp, n in (("20240102_000000", 2), ("20240101_235959", 1)):
        (tmp_path / f"carts_db_pull_at_{stamp}.csv").write_text(f"n\n{n}\n")
    (tmp_path / "carts_notes.csv").write_text("n\n9\n")
    got = snapshots.read_newest_csv(spark, str(tmp_path), "carts", lambda p: readers.read_csv(spark, p, T.StructType([T.StructField("n", T.LongType())])))
    assert got.first()["n"] == 2


def test_upsert_keeps_the_last_row_per_day(spark, frame, rows, tmp_path):
    root = str(tmp_path / "days")
    for n, stamp in ((1, "20240101_010000"), (2, "20240101_020000")):
        got = snapshots.upsert_days(spark, frame([("2024-01-01", n)], "date timestamp_ntz, n int"), root, "blocked", stamp)
    assert rows(got, "n") == [(2,)]


def test_export_writes_one_file_with_header(spark, frame, tmp_path):
    snapshots.export_csv(frame([(1, "a")], "n int, s string"), str(tmp_path / "out"), one_file=True)
    files = [f for f in os.listdir(tmp_path / "out") if f.endswith(".csv")]
    assert len(files) == 1 and (tmp_path / "out" / files[0]).read_text() == "n,s\n1,a\n"


def test_month_folders_are_pruned(spark, frame, rows, tmp_path):
    df = frame([(f"2024-{m:02d}-15 12:00:00", m) for m in range(1, 13)], "t timestamp_ntz, n int")
    layout.write_by_month(df, str(tmp_path / "m"), "t", files_per_month=2)
    got = layout.read_by_month(spark, str(tmp_path / "m"), "t", "2024-03-01", "2024-04-30")
    assert rows(got, "n") == [(3,), (4,)] and len(got.inputFiles()) >= 2
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in scan and "PushedFilters" in scan


def test_tables_bucketed_alike_join_without_shuffle(spark, rows):
    a = layout.save_bucketed(spark.range(100).withColumnRenamed("id", "order_id"), "bucket_a", "order_id", 4)
    b = layout.save_bucketed(spark.range(0, 100, 2).withColumnRenamed("id", "order_id").withColumn("x", F.lit(1)), "bucket_b", "order_id", 4)
    joined = a.hint("merge").join(b, "order_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 50


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampNTZType())])


def test_stream_takes_late_rows_and_ingests_once(spark, frame, rows, tmp_path):
    source, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    first = frame([(1, "2024-01-01 10:10:00"), (2, "2024-01-01 11:10:00")], "id bigint, ts timestamp_ntz")
    late = frame([(3, "2024-01-01 10:50:00"), (4, "2024-01-01 15:00:00")], "id bigint, ts timestamp_ntz")
    counts = lambda: refresh.hourly_counts(refresh.source(spark, source, SCHEMA), "ts", [], "id", "1 hour", "id")
    for batch in (first, late):
        batch.coalesce(1).write.mode("append").parquet(source)
        refresh.run_available(counts(), target, progress)
    got = spark.read.parquet(target)
    assert rows(got, "window_start", "events") == [(dt(2024, 1, 1, 10), 2), (dt(2024, 1, 1, 11), 1)]
    copy, seen = str(tmp_path / "copy"), str(tmp_path / "seen")
    for _ in range(2):
        refresh.ingest(refresh.source(spark, source, SCHEMA), copy, seen).awaitTermination()
    assert spark.read.parquet(copy).count() == 4


def test_daily_upsert_replaces_changed_days(spark, frame, rows, tmp_path):
    source, target, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))
    for data in ([(1, "2024-01-01 10:00:00"), (2, "2024-01-02 10:00:00")], [(3, "2024-01-02 11:00:00")]):
        frame(data, "id bigint, ts timestamp_ntz").write.mode("append").parquet(source)
        refresh.upsert_daily(refresh.source(spark, source, SCHEMA), "ts", [], target, progress).awaitTermination()
    assert rows(refresh.daily_state(spark, target, [])) == [(dt(2024, 1, 1), 1), (dt(2024, 1, 2), 2)]


def test_backlog_order_doesn_t_matter_and_late_rows_raise(spark, frame, rows, tmp_path):
    """Five files whose oldest arrives fourth: in one run nothing is late; one by one the late row raises."""
    moments = ["2024-01-02 10:00:00", "2024-01-03 10:00:00", "2024-01-04 10:00:00", "2024-01-01 10:00:00", "2024-01-05 10:00:00"]
    files = [frame([(i, m)], "id bigint, ts timestamp_ntz").coalesce(1) for i, m in enumerate(moments)]
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    counts = lambda path, lateness="1 hour": refresh.hourly_counts(refresh.source(spark, path, SCHEMA), "ts", [], "id", lateness)
    for f in files:
        f.write.mode("append").parquet(whole)
    refresh.run_available(counts(whole), str(tmp_path / "a"), str(tmp_path / "pa"))
    hours = rows(spark.read.parquet(str(tmp_path / "a")), "window_start", "events", "entities")
    assert hours == [(dt(2024, 1, d, 10), 1, 1) for d in (1, 2, 3, 4)]
    with pytest.raises(refresh.LateRows):
        for f in files:
            f.write.mode("append").parquet(parts)
            refresh.run_available(counts(parts), str(tmp_path / "b"), str(tmp_path / "pb"))
    for n, f in enumerate(files):
        f.write.mode("overwrite" if n == 0 else "append").parquet(str(tmp_path / "again"))
        refresh.run_available(counts(str(tmp_path / "again"), "5 days"), str(tmp_path / "c"), str(tmp_path / "pc"))
    daily = str(tmp_path / "daily")
    refresh.finished(refresh.upsert_daily(refresh.source(spark, whole, SCHEMA), "ts", [], daily, str(tmp_path / "pd")))
    assert rows(refresh.daily_state(spark, daily, []), "events") == [(1,)] * 5


def test_a_stream_that_starts_anew_keeps_stored_days(spark, frame, rows, tmp_path):
    target = str(tmp_path / "out")
    for n, moment in enumerate(("2024-01-01 10:00:00", "2024-01-02 10:00:00")):
        source = str(tmp_path / f"in{n}")
        frame([(n, moment)], "id bigint, ts timestamp_ntz").write.parquet(source)
        refresh.finished(refresh.upsert_daily(refresh.source(spark, source, SCHEMA), "ts", [], target, str(tmp_path / f"p{n}")))
    want = [(dt(2024, 1, 1), 1), (dt(2024, 1, 2), 1)]
    assert rows(refresh.daily_state(spark, target, [])) == want


def _days(frame, *counts):
    return frame(list(counts), "date timestamp_ntz, kind string, events long")


def test_many_batches_leave_one_file_a_day_and_repeats_change_nothing(spark, frame, rows, tmp_path):
    target = str(tmp_path / "out")
    for number in range(6):
        refresh.merge_batch(_days(frame, ("2024-01-01", "a", number + 1), (f"2024-01-0{number + 2}", "b", 1)), target, ["kind"], "one", number)
    want = [(dt(2024, 1, 1), "a", 6), *[(dt(2024, 1, n), "b", 1) for n in range(2, 8)]]
    assert rows(refresh.daily_state(spark, target, ["kind"])) == want
    files = [f for d, _, names in os.walk(target) for f in names if f.endswith(".parquet")]
    assert len(files) == 7 and sorted(x for x in os.listdir(target) if "=" in x)[0] == "day=2024-01-01"
    untouched = {f: os.stat(os.path.join(target, "day=2024-01-03", f)).st_mtime_ns for f in os.listdir(f"{target}/day=2024-01-03")}
    # the last batch again, and one that a later batch of its stream has overtaken
    refresh.merge_batch(_days(frame, ("2024-01-01", "a", 6), ("2024-01-07", "b", 1)), target, ["kind"], "one", 5)
    refresh.merge_batch(_days(frame, ("2024-01-01", "a", 2)), target, ["kind"], "one", 1)
    assert rows(refresh.daily_state(spark, target, ["kind"])) == want
    # groups of a changed day that a batch lacks stay; another stream's counts replace
    refresh.merge_batch(_days(frame, ("2024-01-01", None, 9), ("2024-01-02", "b", 4)), target, ["kind"], "two", 0)
    got = rows(refresh.daily_state(spark, target, ["kind"]))
    assert sorted(map(repr, got)) == sorted(map(repr, [(dt(2024, 1, 1), None, 9), (dt(2024, 1, 1), "a", 6), (dt(2024, 1, 2), "b", 4), *want[2:]]))
    assert untouched == {f: os.stat(os.path.join(target, "day=2024-01-03", f)).st_mtime_ns for f in os.listdir(f"{target}/day=2024-01-03")}


def test_a_change_that_dies_half_way_is_taken_up_again(spark, frame, rows, tmp_path, monkeypatch):
    import shutil

    target = str(tmp_path / "out")
    refresh.merge_batch(_days(frame, ("2024-01-01", "a", 1), ("2024-01-01", "b", 1)), target, ["kind"], "one", 0)

    def dies(spark, table, staged, schema, by):
        shutil.rmtree(f"{table}/day=2024-01-01")  # between leaving and coming
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(partitions, "_swap", dies)
        with pytest.raises(KeyboardInterrupt):
            refresh.merge_batch(_days(frame, ("2024-01-01", "a", 5)), target, ["kind"], "one", 1)
    os.makedirs(f"{target}/_staged/broken")  # and a staging that never was complete
    got = refresh.merge_batch(_days(frame, ("2024-01-02", "a", 7)), target, ["kind"], "one", 2)
    assert rows(got, "date", "kind", "events") == [(dt(2024, 1, 1), "a", 5), (dt(2024, 1, 1), "b", 1), (dt(2024, 1, 2), "a", 7)]
    assert os.listdir(f"{target}/_staged") == []


def test_sketches_merge_and_repeat_without_change(spark, frame, rows, tmp_path):
    path = str(tmp_path / "sketches")
    df = spark.range(6000).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 90).cast("int"))).alias("t"),
        F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 30 > 0, F.lit("cold")).alias("g"), (F.col("id") % 1000).alias("who"))
    for load in (df.where("t < '2024-02-10'"), df.where("t >= '2024-01-20'"), df.where("t < '2024-02-10'")):
        stored = sketches.merge_days(path, sketches.daily_sketches(load, "t", ["g"], "who"), ["g"])
    assert stored.count() == df.select("t", "g").distinct().count()
    got = {(r["grain"], r["period_start"], r["g"]): r["n"] for r in sketches.period_distinct(stored, ["g"]).collect()}
    for grain in ("Weekly", "Monthly", "Quarterly", "Yearly"):
        exact = df.groupBy(calendar.period_start("t", grain).alias("p"), "g").agg(F.count_distinct("who").alias("n")).collect()
        assert all(abs(got[grain, r["p"], r["g"]] - r["n"]) <= 0.03 * r["n"] for r in exact) and exact
    assert len(got) == sum(1 for _ in got)


def test_rules_with_wildcards_and_priorities(spark, frame, rows, tmp_path):
    from ordermetrics.operators.rules import MISSING, labelled

    table = frame([("a", "x", 1, "exact"), ("a", None, 3, "any a"), (None, "y", 2, "any y"), (None, None, 0, "all"), (MISSING, "y", 9, None)], "s string, m string, priority int, label string")
    df = frame([("a", "x"), ("b", "y"), ("b", "z"), (None, "y"), (None, None), ("b", "y")], "s string, m string").withColumn("priority", F.lit(7))
    got = labelled(df, table, ["s", "m"], ["label"])
    assert got.columns == ["s", "m", "priority", "label"]
    assert rows(got, "s", "m", "label") == sorted([("a", "x", "any a"), ("b", "y", "any y"), ("b", "y", "any y"), ("b", "z", "all"), (None, "y", None), (None, None, "all")], key=repr)
    assert [r["label"] for r in labelled(df, table.where("false"), ["s", "m"], ["label"]).collect()] == [None] * 6
    with pytest.raises(Exception, match="same values and priority"):
        labelled(df, table.unionByName(table), ["s", "m"], ["label"]).collect()
    table.write.parquet(str(tmp_path / "rules"))
    exact = labelled(df, spark.read.parquet(str(tmp_path / "rules")).where("s = 'a' and m = 'x'"), ["s", "m"], ["label"])
    assert exact._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1
