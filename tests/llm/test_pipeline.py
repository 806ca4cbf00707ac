"""The registered queries against their SQL, and the pipeline's stages."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from test_catalog import TABLES, table

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_query_equals_its_sql(spark, duck, name):
    got = table(entry.queries()[name](spark, FOLDER).toPandas())
    assert got == table(duck.execute(entry.oracle_sql()[name]).df())


def test_each_operator_has_one_query():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_stages_take_effect_and_keep_clean_rows(spark):
    own = "Plain words of the first kind stand here for a while and say nothing twice in all of this text"
    item = "this item of the benchmark has more than ten words so that it makes windows"
    rows = [(i, f"{own} {'abcdefghijklmnopqrst'[i]}{'uvwxyzabcdefghijklmn'[i]}mo" * 1, "en", "s", 1) for i in range(2)]
    unlike = [(10 + i, " ".join(f"{a}{b}in{c}" for a, b in zip("abcdefghij" * 3, "klmnopqrst" * 3, strict=True)) + f"{c} end", "en", "s", 1) for i, c in enumerate("uvw")]
    docs = spark.createDataFrame([
        *rows, *unlike, (20, None, "en", "s", 0), (21, "12345 678", "en", "s", 9), (22, f"Some start then {item} and an end", "en", "s", 1)],
        "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    told = stages["language_id"](spark, docs, FOLDER)
    assert told.columns == COLUMNS and {r.doc_id for r in told.collect()} == {0, 1, 10, 11, 12, 22}
    lines = stages["line_dedup"](spark, docs, FOLDER)
    assert lines.columns == COLUMNS and lines.count() == docs.count()
    near = stages["near_dedup"](spark, docs, FOLDER)
    assert near.columns == COLUMNS and {r.doc_id for r in near.collect()} == {0, 10, 11, 12, 20, 21, 22}


def test_long_lines_go_from_two_documents_on(spark):
    passage = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr")
    docs = spark.createDataFrame([(i, f"Own start {c}\n{passage}\nshared short line", "en", "s", 1) for i, c in enumerate("xyz")],
        "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.recurring_lines(spark, docs, FOLDER).collect()}
    assert [passage in got[i] for i in range(3)] == [True, False, False] and all("shared short line" in t for t in got.values())


def test_rows_of_numbers_are_not_one_template(spark):
    docs = spark.createDataFrame([(i, f"{i}2 45 33\n1 2 3 {i}\n2024-01-{i + 10}\n7 7 7\nVisited {i} times", "en", "s", 1) for i in range(12)],
        "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text.split("\n") for r in corpus_pipeline.recurring_lines(spark, docs, FOLDER).collect()}
    assert len(got[0]) == 5 and all(got[i] == [f"{i}2 45 33", f"1 2 3 {i}", f"2024-01-{i + 10}"] for i in range(1, 12))


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, FOLDER).count() == 0


def test_pipeline_keeps_what_no_stage_rejects(spark):
    """Every document is packed, or a stage's own rule names it."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    packed = {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").distinct().collect()}
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, FOLDER)
    assert packed == {r.doc_id for r in left.select("doc_id").collect()} and 0 < len(packed) < docs.count()
