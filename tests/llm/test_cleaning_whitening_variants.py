"""Line-first cleaning, whitening and spelling variants against brute force and on odd input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordermetrics.llm import cleaning, queries, variants, whitening

DOCS = "doc_id long, text string"
FOLDER = "/root/testdata/sf0.001"


def clashes(df, *names):
    return df.select("*", *[F.lit(1).alias(c) for c in names])


# line-first cleaning ---------------------------------------------------------------------


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words))


PROSE = "This{0} is a whole sentence{0} of the text{0}, number {0} of its kind{0}."


def test_base_counts_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t\n", "a b c a b c", "x " * 60, "w\x0bv\x0cu t 　 😀", "one\none\n\none \none", " ".join(f"w{i % 977}" for i in range(30_000))]
    texts += ["\n".join(" ".join(rng.choice(["a", "b#", "c", "|", "dé.", "e"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(20))) for _ in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in cleaning.cleaned(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_base(t), repr(t)[:80]
    assert got[0]["text"] is None and got[1]["text"] == "" and not got[0]["kept"]


def test_repeated_words_numbers_never_collide():
    rng = random.Random(1)
    words = [str(rng.randrange(3000)) for _ in range(20_000)] + ["x", "y", "z"] * 3
    assert cleaning.repeated_words(words) == brute_base(" ".join(words))[4]
    assert cleaning.repeated_words(["a", "b"]) == cleaning.repeated_words(["a", "b", "c"]) == 0
    assert cleaning.repeated_words(["a"] * 4) == 4


@pytest.mark.parametrize("line, fails", [
    ("Home | News | Sport | About", True), ("one > two", True), ("Prices rose 5% in May, the bank said.", False),
    ("the&&& code$$$ is### not*** prose%%%.", True), ("All Rights Reserved.", True), ("© 2020 Somebody", True),
    (" ".join(["word"] * 40) + " all rights reserved to the people.", False), ("A line that just stops without", True),
    ("A short heading", False), ("“Quoted to its very end.”", False), ("这是 一个 完整 的 句子。", False), ("- an item of a list, closed by a mark.", False)])
def test_rules_per_line(line, fails):
    text = "\n".join([line, "The end."])
    out = dict(zip(cleaning.COLUMNS, cleaning.judge(text, cleaning.Rules()), strict=True))
    assert (out["n_removed"] == 1) is fails and out["text"] == ("The end." if fails else text)


def test_verdict_follows_the_text_lost(spark):
    prose = [PROSE.format(f"n{i}") for i in range(8)]
    menu = [f"Home{i} | News | Sport{i} | About | Contact{i} | Shop" for i in range(3)]
    rows = [(1, "\n".join(prose)), (2, "\n".join(prose + menu)), (3, "\n".join(prose[:3] + [f"tab{i}$$ | le{i}%% | of{i}## | signs{i}&& | a{i}" for i in range(30)])), (4, "\n".join(prose[:1])), (None, "\n".join(prose)), (1, "\n".join(prose))]
    df = clashes(spark.createDataFrame(rows, DOCS), "kept", "n_words", "_judged", "lost_chars", "a.b")
    out = cleaning.cleaned(df)
    assert out.columns == ["doc_id", "text", "_judged", "a.b", *cleaning.COLUMNS[1:]]
    got = [(r["doc_id"], r["kept"], r["base_failed"], r["n_removed"], r["text"]) for r in out.collect()]
    assert got[0] == (1, True, False, 0, rows[0][1]) == got[5] and got[4][1:] == got[0][1:]
    assert got[1] == (2, True, False, 3, rows[0][1])
    assert got[2][1:4] == (False, False, 30) and got[3][1:4] == (False, True, 0)
    assert cleaning.cleaned(spark.createDataFrame([], DOCS)).count() == 0


def test_clean_documents_are_left_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    found = cleaning.cleaned(docs).where(~F.col("base_failed")).groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n"))
    kept = {r["quality"]: (r["kept"], r["n"]) for r in found.collect()}
    assert kept[1][0] > 0.99 and kept[1][1] > 200 and kept[0][0] < 0.05


# whitening -------------------------------------------------------------------------------


def reference(rows, k=8):
    x = np.floor(np.array(rows, np.float64) * 1024).astype(np.int64) + 100_000
    n = len(x)
    z = n * x - x.sum(axis=0)
    v = (z / n).T @ (z / n) / n
    e, q = np.linalg.eigh(v)
    return (z.astype(object) ** 2).sum(axis=1), z / n, e[::-1][:k], q[:, ::-1][:, :k], np.trace(v)


def check_whitening(spark, rows, k=8, vectors=True):
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(3)
    out = whitening.whitened(df, components=k).toPandas()
    deviation, z, e, q, trace = reference(rows, k)
    k = int((e > 1e-15 * e[0]).sum()) if not vectors else len(e)
    assert len(out) == len(rows) * out["component"].max() and out["component"].max() == k
    assert out["n"].eq(len(rows)).all() and (out["identity_error"] < 1e-8).all()
    table = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert out.drop_duplicates("vec_id").sort_values("vec_id")["deviation"].tolist() == deviation.tolist()
    shares = out.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert np.allclose(shares, e[:k] / trace, rtol=1e-8)
    if vectors:
        want = z @ q[:, :k] / np.sqrt(e[:k])
        signs = np.sign((table * want).sum(axis=0))
        assert np.abs(table - signs * want).max() < 1e-7
    return out


def test_components_equal_the_eigenvectors(spark):
    rng = np.random.default_rng(5)
    check_whitening(spark, rng.standard_normal((300, 24)) * np.linspace(3, 0.2, 24) / 3)
    # a few strong directions: ends long before all dimensions
    strong = rng.standard_normal((200, 4)) @ rng.standard_normal((4, 40)) + 0.01 * rng.standard_normal((200, 40))
    check_whitening(spark, strong, k=3)


def test_components_of_badly_scaled_and_repeated_spectra(spark):
    rng = np.random.default_rng(6)
    scaled = rng.standard_normal((150, 12)) * 10.0 ** np.linspace(2, -2, 12)
    check_whitening(spark, scaled)
    # every deviation twice or more: +-a on each axis gives equal eigenvalues
    axes = np.vstack([np.eye(6) * 0.5, -np.eye(6) * 0.5, np.zeros((2, 6))])
    out = check_whitening(spark, np.vstack([axes] * 3), k=4, vectors=False)
    assert out["explained"].max() - out["explained"].min() < 1e-9
    # fewer directions than asked for
    flat = np.outer(np.round(rng.standard_normal(50) * 16), rng.integers(1, 5, 10))
    out = check_whitening(spark, flat, k=8, vectors=False)
    assert out["component"].max() == 1


def test_vectors_that_do_not_count(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(8)
    good = [(i, [float(c) for c in rng.standard_normal(3)]) for i in range(20)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 1.0, 1.0]), (103, [1.0, inf, 1.0]), (104, [1.0, 2.0]), (105, []), (106, [1e30, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>"
    same = [(None, good[0][1]), good[1]]
    df = clashes(spark.createDataFrame(good + same + odd, schema), "n", "component", "ids", "v", "data")
    out = whitening.whitened(df).toPandas()
    assert len(out) == 22 * 3 and set(out["n"]) == {22} and out["vec_id"].isna().sum() == 3 and (out["vec_id"] == 1).sum() == 6
    for rows in ([], odd[:4], good[:1], [(1, [0.5, 0.5])] * 4, [(1, [])]):
        assert whitening.whitened(spark.createDataFrame(rows, schema)).count() == 0
    # a sum of squares beyond a long is null, below it exact
    wide = [(i, [float(i * 10**9), 0.25 * i]) for i in range(4)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(spark.createDataFrame(wide, schema)).collect()}
    x = np.array([[1024 * i * 10**9, 256 * i] for i in range(4)], object)
    want = ((4 * x - x.sum(axis=0)) ** 2).sum(axis=1)
    assert got == {i: int(w) if w < 2**63 else None for i, w in enumerate(want)}


def test_registered_whitening_equals_the_eigenvectors(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").toPandas()
    good = rows[rows["embedding"].map(lambda v: v is not None and np.isfinite(np.array(v, float)).all())]
    out = queries.op12_whitening(spark, FOLDER).toPandas()
    deviation, _, e, _, trace = reference([list(v) for v in good["embedding"]])
    assert len(out) == 8 * len(good)
    first = out.drop_duplicates("component").sort_values("component")
    assert np.allclose(first["explained"], e / trace, rtol=1e-9) and first["identity_error"].max() < 1e-8
    assert dict(zip(out["vec_id"], out["deviation"], strict=True)) == dict(zip(good["vec_id"], deviation, strict=True))


# spelling variants -----------------------------------------------------------------------


def brute_counts(docs, damage=97, length=5, count=3):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= length and n >= count}


def brute_groups(words):
    """Neighbours by deleting one letter on either side, or on both at the same place."""
    holes, whole = {}, set(words)
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            holes.setdefault((w[:i], w[i + 1 :]), []).append(w)
            if (short := w[:i] + w[i + 1 :]) in whole:
                near[w].add(short)
                near[short].add(w)
    for same in holes.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def as_set(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_registered_variants_equal_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = brute_groups(brute_counts(docs))
    assert as_set(queries.op13_spelling_variants(spark, FOLDER)) == want and sum(x[1] is not None for x in want) > 50


@pytest.mark.parametrize("block, letters", [(1024, 1 << 18), (16, 1 << 18), (1024, 60)])
def test_random_words_over_few_letters(spark, monkeypatch, block, letters):
    monkeypatch.setattr(variants, "BLOCK", block)
    monkeypatch.setattr(variants, "LETTERS", letters)
    rng = random.Random(block)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))): rng.randrange(3, 40) for _ in range(500)}
    # one first half holds most words
    words |= {"hothot" + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 7))): rng.randrange(3, 9) for _ in range(300)}
    words |= {"x" * 90 + c: 4 for c in "abcd"} | {"x" * 90: 9, "x" * 91: 3, "y" + "x" * 90: 20}
    df = clashes(spark.createDataFrame(list(words.items()), "word string, n long"), "m", "page", "size", "block")
    assert as_set(variants.grouped(df)) == brute_groups(words)


def test_links_by_machine_words():
    words = np.array(["kitten", "sitten", "kittens", "kittn", "mitten", "kiten", "akitten", "kitte"])
    pick = np.array([w for w in words if len(w) in (6, 7)])
    rows, same, longer = variants.links(pick, 6, 0)
    at = list(pick[rows]).index("kitten")
    assert list(pick[variants._flags(longer, len(pick))[at]]) == ["kittens"] and not variants._flags(same, len(pick))[at].any()
    rows, same, longer = variants.links(pick, 6, 1)
    assert list(pick[variants._flags(same, len(pick))[at]]) == ["sitten", "mitten"] and list(pick[variants._flags(longer, len(pick))[at]]) == ["akitten"]


def test_odd_documents_and_chains(spark):
    long = "z" * 5000
    rows = [(1, None), (2, ""), (None, "1234 ,;"), (3, f"{long} {long}a {long}"), (4, f"{long} {long}a {long}a"), (5, long)]
    # each form is twice as frequent as the word before: abcde < abcdf < abcdg; ties go to the least word
    rows += [(None, "abcde " * 3 + "ABCDF " * 6 + "xbcdfg abcdf×" * 3), (7, "abcdh " * 6 + "qbcdh " * 3 + "hellÖ hellö " * 3)] * 2
    df = clashes(spark.createDataFrame(rows, DOCS), "word", "n", "d")
    words = variants.word_counts(df)
    got = {r["word"]: r["n"] for r in words.collect()}
    assert got == brute_counts(rows, damage=10**12)
    assert as_set(variants.grouped(words)) == brute_groups(got)
    chain = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "ccccc": 4, "ccccd": 7, "ccccb": 8, "cccca": 8}
    got = as_set(variants.grouped(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert got == brute_groups(chain) and ("aaaaa", "aaaab", "bbbbb", 3, 1, 6) in got and ("ccccc", "cccca", "cccca", 4, 3, 8) in got
    empty = spark.createDataFrame([], DOCS)
    assert variants.word_counts(empty).count() == 0 and variants.grouped(variants.word_counts(empty)).count() == 0
