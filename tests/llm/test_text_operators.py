"""Decontamination, line de-duplication, near copies and shards against brute force and on odd input."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordermetrics.llm import decontaminate, lines, setsketch, shards

CLASH = ["t", "w", "least", "id", "k", "node", "_id", "_t", "size", "key", "m", "h", "dropped", "n_words", "_piece", "_rank", "c", "a", "b"]
DOCS = "doc_id long, text string"


def with_clashes(df):
    return df.select("*", *[F.lit(1).alias(c) for c in CLASH])


def odd_rows():
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (4, "One two"), (None, "a b c d e f"), (None, None), (5, long), (6, long + " end"), (7, "É é ÀB ab 😀 x")]


def find(pairs, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


# decontamination -----------------------------------------------------------------------


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(docs, items, window=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, found = words_of(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if items_here := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= items_here
        out.append((doc_id, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def test_contamination_equals_brute_force(spark, frame):
    draw = random.Random(3)
    vocabulary = [f"v{i}" for i in range(12)] + ["É", "naïve", "don't"]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(10, 25)))) for i in range(8)]
    items += [(20, "alpha, BETA gamma"), (21, "solo"), (22, ""), (23, None), (None, "a b c d e f"), (24, items[0][1])]
    docs = odd_rows()
    for i in range(40):
        text = draw.choices(vocabulary, k=draw.randint(0, 60))
        if i % 2:
            w = words_of(draw.choice(items)[1])
            at = draw.randint(0, max(0, len(w) - 9))
            text[5:5] = w[at : at + draw.randint(5, 14)]
        docs.append((100 + i, "; ".join(text).upper() if i % 3 else " ".join(text)))
    docs += [(200, "x alpha beta... GAMMA y"), (201, "Solo"), (202, " ".join(["v1"] * 300))]
    items.append((30, " ".join(["v1"] * 12)))
    got = decontaminate.contamination(with_clashes(frame(docs, DOCS)), with_clashes(frame(items, "item_id long, text string")))
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got.collect()), key=repr)
    assert rows == brute_contamination(docs, items)


def test_contamination_on_empty_tables(frame):
    none = frame([], "item_id long, text string")
    got = decontaminate.contamination(frame(odd_rows(), DOCS), none).collect()
    assert len(got) == len(odd_rows()) and not any(r.contaminated or r.n_hit or r.n_items for r in got)
    assert decontaminate.contamination(frame([], DOCS), frame([(1, "a b")], "item_id long, text string")).count() == 0
    kept = decontaminate.drop_contaminated(with_clashes(frame(odd_rows(), DOCS)), frame([(1, "one two")], "item_id long, text string"))
    assert sorted(kept.columns) == sorted([*["doc_id", "text"], *CLASH]) and kept.count() == len(odd_rows()) - 2


# line de-duplication -------------------------------------------------------------------


def test_recurring_lines_go_and_prose_stays(frame):
    docs = [(i, f"Own line of number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} here\nVisited {i} times\n\n  Share this   page\nposted by user name{'abcdefghijklmno'[i % 15]} on the board today") for i in range(15)]
    got = {r.doc_id: r for r in lines.drop_recurring_lines(with_clashes(frame(docs, DOCS)), min_docs=10).collect()}
    assert got[0].text == docs[0][1] and got[0].n_dropped == 0
    for i in range(1, 15):
        # the digit's line, the plain one, and the one whose name varies; "Own line" varies in one of seven places, too
        assert got[i].n_lines == 5 and got[i].n_dropped >= 3
        assert "Share" not in got[i].text and "Visited" not in got[i].text and "posted" not in got[i].text
    few = lines.drop_recurring_lines(frame(docs[:9], DOCS), min_docs=10)
    assert {r.text for r in few.collect()} == {d[1] for d in docs[:9]}


def test_unlike_lines_of_one_leaf_stay(frame):
    draw = random.Random(1)
    docs = [(i, "The same three " + " ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(8))) for i in range(30)]
    assert all(r.n_dropped == 0 for r in lines.drop_recurring_lines(frame(docs, DOCS), min_docs=5).collect())


def test_lines_are_masked_once_and_open_templates_read_from_one_place(frame, monkeypatch):
    plans, keep = {}, lines.written
    monkeypatch.setattr(lines, "written", lambda df, purpose: plans.update({purpose: df._jdf.queryExecution().optimizedPlan().toString()}) or keep(df, purpose))
    docs = [(i, f"Visited {i} times\r\n \t\r\n\n  posted  by\tuser name{'abcdefghijkl'[i]} on the board today \r\nposted by user name{'abcdefghijkl'[i]} on the board today") for i in range(12)]
    docs += [(3, "posted by user namex on the board today"), (None, "No line of others\nposted by user namey on the board today")]
    got = lines.drop_recurring_lines(with_clashes(frame(docs, DOCS)), min_docs=10).collect()
    assert {(r.doc_id, r.n_dropped, r.text) for r in got if r.doc_id not in range(1, 12) or r.text == ""} == {
        (0, 0, docs[0][1]), (3, 1, ""), (None, 1, "No line of others")}
    assert all(r.n_dropped == 3 and r.text == " \t\r\n" for r in got if r.doc_id in range(1, 12) and r.text)
    assert plans["lines"].count("<*>") == 1  # in the projection alone, not in a filter too
    assert plans["open-tokens"].count("posexplode") == 1  # of tokens; the texts are not taken apart into all their lines again


def test_lines_on_odd_input(frame):
    docs = [*odd_rows(), *[(50, "once more\nonce more")] * 3, *[(60 + i, "once more") for i in range(4)], (None, "once more")]
    got = lines.drop_recurring_lines(with_clashes(frame(docs, DOCS)), min_docs=5).collect()
    assert len(got) == len(docs)
    assert all(r.text == "once more\nonce more" for r in got if r.doc_id == 50)
    assert all(r.text == "" for r in got if (r.doc_id or 0) >= 60)
    assert {r.text for r in got if r.doc_id in (1, 2, 3)} == {None, "", " \n\t"}
    assert lines.drop_recurring_lines(frame([], DOCS)).count() == 0


# near copies ---------------------------------------------------------------------------


def brute_near(docs, numerator, denominator, width):
    sets = []
    for _, text in docs:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    pairs = [
        (i, j) for i in range(len(docs)) for j in range(i)
        if sets[i] and sets[j] and denominator * len(sets[i] & sets[j]) >= numerator * len(sets[i] | sets[j])]
    root, ids = find(pairs, range(len(docs))), defaultdict(list)
    for i, r in root.items():
        ids[r].append(docs[i][0])
    out = []
    for i, (doc_id, _) in enumerate(docs):
        known = [x for x in ids[root[i]] if x is not None]
        least = min(known) if known else None
        out.append((doc_id, len(sets[i]), least, doc_id == least))
    return sorted(out, key=repr)


def near_corpus(draw, n_groups=12, chain=25):
    vocabulary = [f"n{i}" for i in range(500)]
    docs = []
    for _ in range(n_groups):
        base = draw.choices(vocabulary, k=draw.randint(20, 90))
        for _ in range(draw.randint(1, 8)):
            own = list(base)
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            docs.append(own)
    walk = draw.choices(vocabulary, k=120)  # each like the one before, the ends unlike: a hot band with many pairs that don't link
    for _ in range(chain):
        walk = list(walk)
        for _ in range(draw.randint(1, 3)):
            walk[draw.randrange(len(walk))] = draw.choice(vocabulary)
        docs.append(walk)
    ids = draw.sample(range(1000), len(docs))
    return [(i, " ".join(d)) for i, d in zip(ids, docs, strict=True)]


@pytest.mark.parametrize(("numerator", "width"), [(85, 3), (80, 5)])
def test_near_duplicates_equal_brute_force(spark, frame, numerator, width, monkeypatch):
    monkeypatch.setattr(setsketch, "BLOCK", 4)  # several blocks on small input
    docs = near_corpus(random.Random(numerator)) + odd_rows()
    got = setsketch.near_duplicates(with_clashes(frame(docs, DOCS)), numerator, 100, width)
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()), key=repr)
    want = brute_near(docs, numerator, 100, width)
    assert [r[:3] for r in rows] == [r[:3] for r in want]
    assert all(r[3] == (r[0] == r[2]) for r in rows)
    kept = setsketch.drop_near_duplicates(frame(docs, DOCS), numerator, 100, width)
    assert kept.select("doc_id").distinct().count() == len({r[0] for r in want if r[3] or r[0] is None})


def test_near_duplicates_without_rows(frame):
    assert setsketch.near_duplicates(frame([], DOCS)).count() == 0
    assert setsketch.near_duplicates(frame([(1, None), (2, "")], DOCS)).count() == 2


def test_likelihood_keeps_pairs_above_the_threshold():
    draw = np.random.default_rng(1)
    missed = 0
    for _ in range(150):
        n = int(draw.integers(5, 800))
        common = draw.integers(0, 1 << 63, n, np.uint64)
        own = [draw.integers(0, 1 << 63, int(n * draw.uniform(0, 0.08)), np.uint64) for _ in range(2)]
        a, b = (np.unique(np.concatenate([common, x])) for x in own)
        if 100 * n < 85 * (len(a) + len(b) - n):
            continue
        ra, rb = setsketch.registers(a), setsketch.registers(b)
        one = lambda x: np.array([x])
        missed += not setsketch.may_be_alike(one((ra > rb).sum()), one((ra < rb).sum()), one(len(a)), one(len(b)), 85, 100)[0]
    assert missed == 0
    x = draw.integers(0, 1 << 63, 3000, np.uint64)
    assert (np.maximum(setsketch.registers(x[:2000]), setsketch.registers(x[1000:])) == setsketch.registers(x)).all()  # mergeable


# shards --------------------------------------------------------------------------------


def check_shards(docs, got, n, tolerance=0.02):
    assert len(got) == len(docs)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in got:
        sizes[r.shard] += len((r.text or "").encode()) + 1
        slots[r.shard].append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    total, largest = sum(sizes.values()), max(len((t or "").encode()) + 1 for _, t in docs)
    assert max(sizes.values()) <= total / n * (1 + tolerance) + largest and min(sizes.get(i, 0) for i in range(n)) >= total / n * (1 - tolerance) - largest


def test_shards_are_balanced_and_slots_gapless(frame):
    draw = random.Random(2)
    docs = [(i, "x" * draw.randint(0, 300)) for i in range(1500)] + [(2000 + i, "the same text of a third of all rows " * 5) for i in range(800)]
    got = shards.shard(with_clashes(frame(docs, DOCS)), 8, piece_bytes=8000).collect()
    check_shards(docs, got, 8)
    again = {(r.doc_id, r.shard, r.slot) for r in shards.shard(frame(docs[::-1], DOCS).repartition(7), 8, piece_bytes=8000).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}  # whatever the order and partitions of the input


def test_shards_on_odd_input(frame):
    got = shards.shard(frame(odd_rows(), DOCS), 3).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id and r.text) == sorted((d, t) for d, t in odd_rows() if d and t)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shards.shard(frame([], DOCS), 4).count() == 0
    assert shards.shard(frame([(1, "a")] * 5, DOCS), 4).count() == 5
    assert zlib.crc32(b"") == 0  # what a null text counts as
