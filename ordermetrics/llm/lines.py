"""Line de-duplication by a log-template tree. DataFrame functions only.

A line's path in the tree is its token count and its first ``DEPTH`` tokens; tokens that
hold a digit are variable and read ``<*>``. Below a leaf, lines with the same masked
tokens form one template. A leaf also gets one generalised template: at each place the
token that most documents have, if at least half of them do, else ``<*>``. Lines that
agree with it at ``alike`` of all places belong to it. Lines of templates that recur in
``min_docs`` documents are dropped everywhere but in the document of least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordermetrics.llm.common import text_key
from ordermetrics.session import written

DEPTH = 3


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, t, at, line): each line of a text that is not blank."""
    # the key is taken before the lines, else each line would hash the whole text
    parts = docs.select("doc_id", text_key().alias("t"), F.split("text", "\n").alias("parts"))
    lines = parts.select("doc_id", "t", F.posexplode("parts").alias("at", "line"))
    # asked of the raw line: a filter on the masked one would mask it a second time
    return lines.where(F.btrim("line", F.lit(" \t\r")) != "")


def _masked(lines: DataFrame, plain_numbers: bool = False) -> DataFrame:
    """``lines`` with ``m`` for ``line``, masked unless ``exact``."""
    uneven = F.contains("line", F.lit("  ")) | F.contains("line", F.lit("\t")) | F.contains("line", F.lit("\r"))
    plain = F.trim(F.when(uneven, F.regexp_replace("line", "[ \t\r]+", " ")).otherwise(F.col("line")))
    lines = lines.withColumn("m", plain).drop("line")
    digits, masked = F.col("m").rlike("[0-9]"), F.regexp_replace("m", "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", "<*>")
    tokens = F.split(masked, " ")
    fields = digits & (2 * F.size(F.filter(tokens, lambda x: x.rlike(r"\p{L}"))) < F.size(tokens)) if plain_numbers else F.lit(False)
    return lines.withColumn("exact", fields).withColumn("m", F.when(digits & ~F.col("exact"), masked).otherwise(F.col("m")))


def _keyed(lines: DataFrame) -> DataFrame:
    """Adds the template key (h, g), the leaf and the number of tokens."""
    tokens = (F.octet_length("m") - F.octet_length(F.replace("m", F.lit(" "), F.lit(""))) + 1).cast("int")
    return lines.withColumn("n", tokens).withColumn("leaf", F.xxhash64("n", F.when(F.col("exact"), F.col("m")).otherwise(F.substring_index("m", " ", DEPTH)))).withColumn(
        "h", F.xxhash64("m")).withColumn("g", F.hash("m"))


def _texts(docs: DataFrame, stored: DataFrame, open_: DataFrame, plain_numbers: bool) -> DataFrame:
    """(h, g, m): the masked line of each of the templates ``open_``, read again from one place of the first document that has it."""
    same = (stored["h"] == open_["h"]) & (stored["g"] == open_["g"]) & stored["doc_id"].eqNullSafe(open_["first"])
    places = stored.join(open_, same).groupBy(stored["h"], stored["g"], "doc_id").agg(F.min(F.struct("t", "at")).alias("p"))
    wanted = places.groupBy("doc_id", F.col("p.t").alias("t")).agg(F.collect_set("p.at").alias("ats"))
    texts = docs.select("doc_id", text_key().alias("t"), "text").alias("d").join(
        wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.t") == F.col("w.t")))
    parts = texts.select(F.split("text", "\n").alias("parts"), "ats")
    lines = parts.select(F.explode(F.transform("ats", lambda at: F.col("parts")[at])).alias("line"))
    return _keyed(_masked(lines, plain_numbers)).groupBy("h", "g").agg(F.first("m").alias("m"))


def dropped_lines(docs: DataFrame, min_docs: int = 10, alike: float = 0.75, long_words: int | None = None, plain_numbers: bool = False) -> DataFrame:
    """(doc_id, t, dropped): for each document with such lines their places, from 0."""
    stored = written(_keyed(_masked(_lines(docs), plain_numbers)).select("doc_id", "t", "at", "h", "g", "leaf", "n"), "lines")
    templates = stored.select("h", "g", "leaf", "n", "doc_id").distinct().groupBy("h", "g", "leaf", "n").agg(
        F.count("doc_id").alias("docs"), F.min("doc_id").alias("first"))
    templates = written(templates, "templates")
    enough = F.lit(min_docs) if long_words is None else F.when(F.col("n") > long_words, min(2, min_docs)).otherwise(min_docs)

    # Leaves where templates that recur too little alone could recur together.
    rare = templates.where((F.col("docs") < enough) & (F.col("n") > DEPTH))
    leaves = rare.groupBy("leaf", "n").agg(F.sum("docs").alias("all"), F.count("*").alias("kinds")).where((F.col("all") >= min_docs) & (F.col("kinds") > 1))
    open_ = written(rare.join(leaves.select("leaf", "n"), ["leaf", "n"], "left_semi"), "open-templates")
    texts = _texts(docs, stored, open_, plain_numbers)
    tokens = written(texts.join(open_, ["h", "g"]).select("leaf", "n", "h", "g", "docs", F.posexplode(F.split("m", " ")).alias("at", "token")), "open-tokens")
    votes = tokens.groupBy("leaf", "n", "at", "token").agg(F.sum("docs").alias("votes"))
    per_place = Window.partitionBy("leaf", "n", "at")
    common = votes.withColumn("all", F.sum("votes").over(per_place)).withColumn(
        "rank", F.row_number().over(per_place.orderBy(F.desc("votes"), "token"))).where((F.col("rank") == 1) & (2 * F.col("votes") >= F.col("all")))
    agree = tokens.join(common.select("leaf", "n", "at", "token"), ["leaf", "n", "at", "token"]).groupBy("leaf", "n", "h", "g").agg(F.count("*").alias("same"))
    members = written(agree.where(F.col("same") >= alike * F.col("n")).select("h", "g", "leaf", "n"), "generalised")
    general = stored.join(members, ["h", "g", "leaf", "n"], "left_semi").select("leaf", "n", "doc_id").distinct().groupBy("leaf", "n").agg(
        F.count("doc_id").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs)

    alone = templates.where(F.col("docs") >= enough).select("h", "g", "leaf", "n", "first")
    bad = written(alone.union(members.join(general, ["leaf", "n"]).select("h", "g", "leaf", "n", "first")), "recurring")
    hit = stored.join(bad, ["h", "g", "leaf", "n"]).where(~F.col("doc_id").eqNullSafe(F.col("first")))
    return hit.groupBy("doc_id", "t").agg(F.collect_set("at").alias("dropped"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 10, alike: float = 0.75, long_words: int | None = None, plain_numbers: bool = False) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``; adds n_lines and n_dropped.

    Blank lines are kept. A null text has no lines and stays null; a text that loses
    every line becomes empty. A null doc_id counts as no document, so its lines never
    are the ones kept. Repeated rows are one document and lose the same lines. Lines of
    more than ``long_words`` words, which don't repeat by chance, go from two documents on.
    With ``plain_numbers``, a line with digits of whose tokens fewer than half are words
    without any recurs only as it stands.
    Other columns pass through, but for n_lines and n_dropped, which are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    bad = dropped_lines(docs, min_docs, alike, long_words, plain_numbers)
    out = docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs["text"]) == bad["t"]), "left")
    parts, gone = F.split(docs["text"], "\n"), bad["dropped"]
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(gone, i)), "\n")
    return out.select(
        *[F.when(gone.isNull(), docs["text"]).otherwise(kept).alias("text") if c == "text" else docs[c] for c in docs.columns],
        F.coalesce(F.size(parts), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"))
