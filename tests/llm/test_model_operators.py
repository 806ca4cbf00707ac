"""Language, toxicity, vectors, packing, chat and archives against brute force and on odd input."""

import gc
import hashlib
import random
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ordermetrics.llm import chat, langid, packing, pq, toxicity, warc
from ordermetrics.llm.common import components, vocabulary

DOCS = "doc_id long, text string, lang string"
CLASH = ["node", "v", "units", "score", "lang_pred", "predicted", "list", "probe", "payload_bytes", "start", "offset", "part", "folder"]


def with_clashes(df):
    return df.select("*", *[F.lit(1).alias(c) for c in CLASH])


def test_components_equal_union_find(frame):
    draw = random.Random(4)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(7, 900 + i) for i in range(50)]
    got = {r.node: r.root for r in components(frame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root[x] for x in linked}
    assert components(frame([], "a long, b long")).count() == 0


# language ------------------------------------------------------------------------------


def languages_corpus(n=160):
    draw = random.Random(5)
    parts = {"xx": ["ba", "bo", "lu", "ka"], "yy": ["ströh", "gen", "über", "lich"], "zz": ["ñan", "ción", "dos", "que"]}
    rows = []
    for i in range(n):
        lang = draw.choice(list(parts))
        rows.append((i, " ".join("".join(draw.choices(parts[lang], k=2)) for _ in range(draw.randint(5, 60))), lang))
    return rows


def test_language_is_told_on_held_out_rows(frame):
    rows = languages_corpus()
    docs = frame(rows, DOCS)
    got = {r.doc_id: r for r in langid.identify(with_clashes(docs), langid.train_on_open(docs)).collect()}
    out = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(out) > 20 and all(got[i].lang_pred == rows[i][2] and 0.5 < got[i].score <= 1 for i in out)


def test_held_out_rows_teach_nothing(frame):
    rows = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in languages_corpus(60)]
    assert "wrong" not in langid.train_on_open(frame(rows, DOCS)).languages


def test_pieces_of_long_texts_add_up(monkeypatch):
    letters = langid._letters()
    text = "Grüße aus dem Süden, 42 mal! " * 40
    whole = [np.sort(b) for _, b in langid._each_order([0], [text], [0], letters)]
    monkeypatch.setattr(langid, "PIECE", 37)
    parts = defaultdict(list)
    for piece in langid._pieces([text]):
        for order, (_, b) in enumerate(langid._each_order(*piece, letters)):
            parts[order].append(b)
    for order, want in enumerate(whole):
        assert (np.sort(np.concatenate(parts[order])) == want).all()


def test_language_on_odd_input(frame):
    odd = [(1, None, "xx"), (2, "", None), (3, "123 ... 😀", "xx"), (None, "baba luka", None), (4, "baba", "xx"), (4, "baba", "xx")]
    model = langid.train_on_open(frame(languages_corpus(80), DOCS))
    got = langid.identify(frame(odd, DOCS), model).collect()
    assert [r.lang_pred for r in got if r.doc_id in (1, 2, 3)] == ["und"] * 3 and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert all(r.lang_pred == "xx" for r in got if r.doc_id in (None, 4))
    untaught = langid.train_on_open(frame([], DOCS))
    assert {r.lang_pred for r in langid.identify(frame(odd, DOCS), untaught).collect()} == {"und"}
    assert langid.known_language(frame(odd, DOCS), model).count() == 3


# toxicity ------------------------------------------------------------------------------


def toxic_corpus(n=900):
    draw = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(draw.choices("aeioulmnrst", k=draw.randint(2, 7))) for _ in range(draw.randint(10, 120))]
        toxic = int(draw.random() < 0.3)
        for _ in range(toxic * draw.randint(1, 4)):
            words[draw.randrange(len(words))] = draw.choice(["grobix", "ekelhund", "schuftig" + draw.choice(["er", "en", "es"])])
        rows.append((i, ", ".join(words).capitalize(), draw.choice(["xx", "yy"])))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(frame):
    rows, labels = toxic_corpus()
    docs = frame(rows, DOCS)
    model = toxicity.train(docs, frame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.toxicity(with_clashes(docs), model).collect()}
    out = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == y for i, y in out]) > 0.95
    assert all(0 <= got[i].score <= 1 and got[i].predicted == (got[i].score >= 0.3) for i, _ in labels)
    odd = [(1, None, None), (2, "", None), (None, "grobix", None), (3, "one " * 70_000 + "grobix", None), (4, "a", "xx"), (4, "a", "xx")]
    scores = {r.doc_id: r for r in toxicity.toxicity(frame(odd, DOCS), model).collect()}
    assert scores[None].predicted == 1 and scores[3].predicted == 1 and scores[1].score == scores[2].score and scores[1].predicted == 0


def test_pieces_of_long_texts_have_the_maxima_of_the_whole(monkeypatch):
    rows, labels = toxic_corpus(120)
    table = pd.DataFrame([(y, lang, *toxicity.features(t)) for (_, t, lang), (_, y) in zip(rows, labels, strict=True)], columns=["toxic", "lang", "words", "stems"])
    table["words"], table["stems"] = [w.astype(np.int64) for w in table["words"]], [s.astype(np.int64) for s in table["stems"]]
    model = toxicity.fit(table, epochs=1)
    texts = [toxicity.features(t) for _, t, _ in rows]
    whole = toxicity._logits(model, texts)[0]
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert np.allclose(toxicity._logits(model, texts)[0], whole, atol=1e-5)


def test_toxicity_without_labels(frame):
    docs = frame(toxic_corpus(20)[0], DOCS)
    for labels in ([], [(1, None)], [(i, 0) for i in range(20)]):
        model = toxicity.train(docs, frame(labels, "doc_id long, toxic int"))
        assert {(r.score, r.predicted) for r in toxicity.toxicity(docs, model).collect()} == {(0.0, 0)}


# vectors -------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>"


def brute_vectors(rows, threshold=0.9):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(np.array(rows[i][1], np.float32), float) for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    links = defaultdict(set)
    for i in good:
        for j in good:
            if i != j and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j)
    out = []
    for i, (vec_id, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((vec_id, len(links[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def vectors_corpus(n=700, size=24):
    draw = np.random.default_rng(8)
    rows = [draw.normal(size=size) for _ in range(n)]
    for i in range(0, n, 3):
        rows[i] = rows[(i * 7) % n] + draw.normal(size=size) * 0.12
    hot = draw.normal(size=size)
    rows += [hot + draw.normal(size=size) * 0.05 for _ in range(200)] + [hot] * 30
    return [(i, [float(x) for x in v.astype(np.float32)]) for i, v in enumerate(rows)]


def test_vectors_against_brute_force(spark, frame, monkeypatch):
    monkeypatch.setattr(pq, "BLOCK", 64)  # several blocks a list
    rows = vectors_corpus()
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [float("inf")] + [1.0] * 23), (5005, [None] + [1.0] * 23),
             (5006, [1.0, 2.0]), (5007, [2.0, 4.0]), (None, rows[0][1]), (5008, [-0.0] + [1.0] * 23), (5009, [0.0] + [1.0] * 23), (5010, [1e30] * 24), (5011, [1e-30] * 24)]
    got = pq.near_vectors(with_clashes(frame(rows, VECTORS)), probes=10_000, per_list=40).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    few = pq.near_vectors(frame(rows, VECTORS), probes=8, per_list=40).collect()
    want = sum(r[1] for r in brute_vectors(rows))
    assert 0.9 * want <= sum(r.n_links for r in few) <= want  # recall, and no link below the threshold


def test_links_between_many_lists_of_a_hot_group(frame):
    draw = np.random.default_rng(18)
    hot = draw.normal(size=64)
    hot /= np.linalg.norm(hot)
    rows = [hot + draw.normal(size=64) * 0.022 for _ in range(1500)]  # cosine about 0.97
    rows += [draw.normal(size=64) for _ in range(1500)]
    for i in range(1500, 3000, 5):
        rows[i] = rows[i + 1] + draw.normal(size=64) * 0.4  # links at cosine about 0.93
    v = np.array(rows, np.float32)
    got = {r.vec_id: r for r in pq.near_vectors(frame([(i, x.tolist()) for i, x in enumerate(v)], VECTORS), per_list=8).collect()}
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    assert want[:1500].min() > 1000 and (want[1500:] > 0).sum() > 400  # 375 lists
    assert [got[i].n_links for i in range(3000)] == want.tolist()


def test_vectors_that_share_both_hashes(frame, monkeypatch):
    whole = pq.F.xxhash64
    monkeypatch.setattr(pq.F, "xxhash64", lambda *c: pq.F.pmod(whole(*c), pq.F.lit(3)) if c[-1] == "v" else whole(*c))
    draw = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in draw.normal(size=5)]) for i in range(60)]
    rows += [(100 + i, v) for i, v in rows[:9]] + [(200, None), (201, [0.0] * 5)]
    got = pq.near_vectors(frame(rows, "vec_id long, embedding array<double>"), threshold=0.8).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == brute_vectors(rows, 0.8)


def slab(number, unit, index):
    near = pq._nearest(unit, index.centroids)
    unit, near = unit[np.argsort(near, kind="stable")], np.sort(near)
    codes, error = pq.encode(unit, near, index)
    starts = np.concatenate([np.arange(a, b, pq.BLOCK) for a, b in pq._ranges(np.flatnonzero(np.diff(near, prepend=-1)), len(near))])
    sizes = np.diff(starts, append=len(near))
    centres = np.add.reduceat(unit, starts) / sizes[:, None]
    radii = np.sqrt(np.maximum.reduceat(((unit - np.repeat(centres, sizes, axis=0)) ** 2).sum(1), starts))
    return pq.Side(number, np.arange(len(unit)) + 10_000 * number, np.ones(len(unit), int), unit, starts, centres, radii, pq.decode(codes, near, index).astype(np.float32),
                   np.sqrt(error[:, : index.lead].sum(1)), np.sqrt(error.sum(1)))


def test_slabs_of_large_lists_meet_at_the_price_of_a_product():
    draw = np.random.default_rng(6)
    v = draw.normal(size=(8192, 64))
    v[1:4096:16] = v[4096::16] + draw.normal(size=(256, 64)) * 0.3  # links across
    v[3:4096:16] = v[2:4096:16] + draw.normal(size=(256, 64)) * 0.3  # and inside
    v /= np.linalg.norm(v, axis=1)[:, None]
    link = np.sqrt(0.2) + 1e-6
    index = pq.fit(v, 4)  # some 1000 members a list and slab
    index.lead = pq.leading(index, v, link)
    x, y = slab(1, v[:4096], index), slab(2, v[4096:], index)
    begin = time.process_time()
    cosine = x.unit @ y.unit.T
    price, begin = time.process_time() - begin, time.process_time()
    found = pd.concat(pq._meet(x, y, index, 0.9, link))
    took = time.process_time() - begin
    assert took < 8 * price
    links = dict(zip(found["node"], found["links"], strict=True))
    assert [links.get(i, 0) for i in x.node] == (cosine >= 0.9).sum(1).tolist() and [links.get(i, 0) for i in y.node] == (cosine >= 0.9).sum(0).tolist()
    within = pd.concat(pq._meet(x, x, index, 0.9, link))
    links = dict(zip(within["node"], within["links"], strict=True))
    assert [links.get(i, 0) for i in x.node] == ((x.unit @ x.unit.T >= 0.9).sum(1) - 1).tolist() and len(found) > 400 and len(within) > 400


def test_vectors_without_rows(frame):
    assert pq.near_vectors(frame([], VECTORS)).count() == 0
    only = pq.near_vectors(frame([(1, None), (2, [0.0])], VECTORS)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in only) == [(1, 0, 1, True), (2, 0, 2, True)]


# packing -------------------------------------------------------------------------------


def best_cost(places, price, window):
    cost = [0.0] + [float("inf")] * len(places)
    at = [0, *places]
    for j in range(1, len(at)):
        for i in range(j):
            if at[j] - at[i] <= window:
                cost[j] = min(cost[j], cost[i] + window - (at[j] - at[i]) + price[j - 1])
    return cost, at


@pytest.mark.parametrize("seed", range(6))
def test_cuts_have_the_least_cost(seed):
    draw = random.Random(seed)
    places = list(np.cumsum([draw.randint(1, 30) for _ in range(60)]))
    price = [draw.choice([0, 8, 48]) for _ in places]
    cost, at = best_cost(places, price, 64)
    got = packing.cuts(np.array(places), np.array(price, float), 64, False)
    ends = [j for j in range(len(at)) if places[-1] - at[j] <= 64 and j]
    assert at[-1] - got[-1] <= 64
    total = sum(64 - (b - a) + price[places.index(b)] for a, b in zip([0, *got], got, strict=False))
    assert total == cost[at.index(got[-1])] and total + got[-1] == min(cost[j] + at[j] for j in ends)
    last = packing.cuts(np.array(places), np.array(price, float), 64, True)
    assert last[-1] == places[-1] and all(b - a <= 64 for a, b in zip([0, *last], last, strict=False))


def test_packing_keeps_every_id_once(spark, frame, monkeypatch):
    monkeypatch.setattr(packing, "STREAM", 3000)
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    draw = random.Random(9)
    texts = [" ".join("".join(draw.choices("abcdeé", k=draw.randint(1, 8))) + draw.choice(["", ",", ".", "!"]) for _ in range(draw.randint(0, 400))) for _ in range(60)]
    texts += [None, "", " \n ", "x" * 5000, "á ́b <|endoftext|>A\tB c d e", "word " * 3000]
    docs = [(i, t, "xx") for i, t in enumerate(texts)] + [(3, texts[3], "xx"), (None, "no id here. none", "xx")]
    path = vocabulary("word_bpe_49k.json")
    window = 256
    rows = packing.pack(with_clashes(frame(docs, DOCS).coalesce(2)), path, window).collect()
    encoder = Tokenizer.from_file(path)
    want = {i: [*encoder.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in docs}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.ids))
        sequences[r.sequence_id].append((r.offset, r.length))
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
    assert set(pieces) == set(want)
    for doc_id, own in pieces.items():
        ids = [x for _, part in sorted(own, key=lambda x: x[0]) for x in part]
        assert sorted(ids) == sorted(want[doc_id] * 2) if doc_id == 3 else ids == want[doc_id]
    lengths = []
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        lengths.append(sum(n for _, n in own))
    assert max(lengths) <= window
    assert sum(window - n for n in lengths if n & (n - 1)) < 0.08 * sum(lengths)
    assert packing.pack(frame([], DOCS), path).count() == 0


def test_marks_that_compose_only_in_lower_case_encode_as_the_tokenizer_does():
    path = vocabulary("word_bpe_49k.json")
    encoder, whole = packing.Encoder(path), Tokenizer.from_file(path)
    marked = ["H\u0331", "T\u0308", "J\u030c", "W\u030a", "Y\u030a", "\u0399\u0308\u0301", "I\u0307", "E\u0301", "\u212b", "\u03a3"]
    texts = [f"x{m}y" for m in marked] + [f"Before {m}ATA, behind." for m in marked]
    got = [ids.tolist() for ids in encoder.encode(texts)]
    assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_remembered_words_take_few_bytes():
    """A worker holds them beside all its later tasks; as texts in a dictionary each took some 200 bytes."""
    encoder, n = packing.Encoder(vocabulary("word_bpe_49k.json")), 60_000
    draw = random.Random(5)
    words = {"".join(draw.choices("abcdefghij", k=9)) for _ in range(n)}
    arrow = pa.total_allocated_bytes()
    tracemalloc.start()
    for _ in encoder.encode([" ".join(words)]):
        pass
    gc.collect()
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - arrow
    tracemalloc.stop()
    assert held < 80 * n


def test_texts_of_no_learned_language_are_rejected(spark):
    """Other scripts and letters at random go; the clean texts of all learned languages, short and cut ones too, stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train_on_open(docs)
    unknown = [
        "Съешь же ещё этих мягких французских булок, да выпей чаю.", "日本語の文章はこのように書かれています。今日は天気がとても良いです。",
        "Η γρήγορη καφέ αλεπού πηδάει πάνω από τον τεμπέλη σκύλο", "qwx zzkv brrt xqzj wvvk jqqx zzx kkw"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*unknown, "the", None, "", "12 34"])], "doc_id long, text string")
    assert [r["doc_id"] for r in langid.known_language(rows, model).collect()] == [4]
    with_letters = docs.where(F.col("text").rlike("[A-Za-zà-ÿ]"))
    assert langid.known_language(docs, model).count() == with_letters.count()
    assert langid.known_language(docs.select("doc_id", F.substring("text", 1, 60).alias("text")), model).count() >= 0.999 * with_letters.count()


def test_scores_equal_naive_bayes_in_plain_loops():
    """Counts and posteriors of a small model by loops over characters, with the same hash of a gram."""
    import math

    letters, mask = langid._letters(), 0xFFFFFFFF

    def grams(text):
        codes = [int(langid._codes(c, letters)[0]) for c in text]
        mixed = [(c * 0x9E3779B1) & mask for c in codes]
        mixed = [m ^ (m >> 15) for m in mixed]
        for order in range(1, langid.ORDERS + 1):
            for at in range(order - 1, len(codes)):
                total = mixed[at - order + 1]
                for k in range(at - order + 2, at + 1):
                    total = (total * 0x85EBCA77 + mixed[k]) & mask
                if codes[at] or (order > 1 and codes[at - 1]):
                    yield (((total + order) * 0xC2B2AE3D) & mask) >> (32 - langid.BITS)

    taught = {"aa": ["ab ab abba", "bab"], "bb": ["xyz zyx", "yy é xz"]}
    counts = {n: defaultdict(int) for n in taught}
    for name, texts in taught.items():
        for text in texts:
            for g in grams(text):
                counts[name][g] += 1
    sums = {n: sum(c.values()) + 0.5 * langid.BUCKETS for n, c in counts.items()}
    table = np.array([[math.log((counts[n][b] + 0.5) / sums[n]) for n in taught] for b in range(langid.BUCKETS)], np.float32)
    model = langid.Model(list(taught), table, np.full(2, -math.log(2)))
    asked = ["abba", "xyz", "ab zy", "é", "7", None, "bab xyz é ab" * 50]
    got = langid.score_texts(asked, model, letters)
    for text, row in zip(asked, got.itertuples(), strict=True):
        found = list(grams(text or ""))
        logs = [sum(float(table[g, i]) for g in found) for i in range(2)]
        if not found:
            assert (row.lang_pred, row.score, row.grams) == ("und", 0.0, 0)
            continue
        best = max(range(2), key=lambda i: logs[i])
        assert row.lang_pred == model.languages[best] and row.grams == len(found)
        assert row.score == pytest.approx(1 / sum(math.exp(x - logs[best]) for x in logs)) and row.fit == pytest.approx(logs[best] / len(found))


def test_random_scripts_encode_as_the_tokenizer_does(monkeypatch):
    """Texts over many scripts, with little memory, alone and together."""
    path, draw = vocabulary("word_bpe_49k.json"), random.Random(21)
    encoder, whole = packing.Encoder(path), Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "REMEMBERED", 300)
    ranges = [(0x20, 0x7F), (0xA0, 0x24F), (0x300, 0x36F), (0x370, 0x3FF), (0x400, 0x4FF), (0x5D0, 0x5EA), (0x900, 0x97F), (0xE00, 0xE5B), (0x1E00, 0x1FFF), (0x2000, 0x206F), (0x3040, 0x30FF), (0x4E00, 0x4FFF), (0xAC00, 0xACFF), (0xFB00, 0xFB06), (0x1F600, 0x1F64F)]

    def text():
        here = draw.sample(ranges, draw.randint(1, 3))
        return "".join(draw.choice([chr(draw.randint(*draw.choice(here))), draw.choice("abcXYZ .,!\n\t é")]) for _ in range(draw.randint(0, 60)))

    texts = [text() for _ in range(6000)]
    for together in (1, 5000, 1 << 21):
        monkeypatch.setattr(packing, "TOGETHER", together)
        got = [ids.tolist() for ids in encoder.encode(texts)]
        assert got == [x.ids for x in whole.encode_batch_fast(texts, add_special_tokens=False)]


# chat ----------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string"


def test_escaping_is_reversible_and_leaves_no_control_string():
    template, draw = chat.Template(), random.Random(10)
    pieces = [*chat.CONTROLS, "\\", "<", "|", "[", "s>", "/INST]", "x", "\n", "é", "im_start|>", "<\\|im_end|>", "[\\\\INST]"]
    for _ in range(3000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 9)))
        safe = template.escape(text)
        assert template.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)
        assert template.plain_role(template.role(text)) == text and "\n" not in template.role(text)
    with pytest.raises(ValueError, match="start"):
        chat.Template(("<a<b>",))


def expected_digests(rows):
    talks = defaultdict(list)
    for conv_id, turn, role, text in rows:
        talks[conv_id].append(((turn is not None, turn, role is not None, role or "", text is not None, text or ""), role or "", text or ""))
    out = []
    for conv_id, turns in talks.items():
        turns.sort(key=lambda x: x[0])
        said = "".join(t for _, r, t in turns if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        out.append((conv_id, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("segment", [1 << 20, 40])
def test_chat_reads_back(spark, frame, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    draw = random.Random(11)
    pieces = [*chat.CONTROLS, "\\", " ", "word", "😀", "é", "́", "\n", "한국", "[", "<"]
    rows = []
    for conv in range(25):
        for turn in range(draw.randint(1, 7)):
            rows.append((conv, turn, draw.choice(["user", "assistant", "system", "tool\n\\x", "<|im_end|>"]), "".join(draw.choices(pieces, k=draw.randint(0, 12)))))
    rows += [(30, 0, "assistant", None), (30, 1, None, "x"), (None, None, "assistant", "nobody"), (31, 0, "assistant", "same"), (31, 0, "assistant", "same"), (32, 5, "assistant", "y " * 20_000)]
    df = frame(rows, CHAT)
    formatted = chat.format_conversations(with_clashes(df.withColumn("formatted", F.lit(1))), vocabulary("byte_bpe_50k.json")).cache()
    got = chat.digests(formatted).collect()
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got), key=repr) == expected_digests(rows)
    size = {r.conv_id: 0 for r in got}
    for r in formatted.collect():
        size[r.conv_id] += len(r.formatted)
        assert len(r.ids) == len(r.loss_mask) == len(r.token_start)
    assert all(r.formatted_chars == size[r.conv_id] for r in got)
    assert chat.digests(chat.format_conversations(frame([], CHAT), vocabulary("byte_bpe_50k.json"))).count() == 0


def test_mask_clips_tokens_to_spans():
    offsets = np.array([[0, 3], [3, 5], [5, 6], [5, 6], [6, 10], [10, 12]])
    mask, start, end = chat.token_mask(offsets, np.array([[4, 6], [10, 10]]))
    assert mask.tolist() == [False, True, True, True, False, False]
    assert (start[mask].tolist(), end[mask].tolist()) == ([4, 5, 5], [5, 6, 6])


# archives ------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def test_archives_read_back(spark, frame):
    draw = random.Random(12)
    big = "".join(draw.choices("abcdefgh é\r\n", k=300_000))
    rows = [(i, f"http://x/{i}\r\nHost: y%0A", "".join(draw.choices("abc é\r\n\0", k=draw.randint(0, 400)))) for i in range(60)]
    rows += [(100 + i, None, "copy " * 40) for i in range(20)] + [(200, "u", None), (201, "u", ""), (202, "u", big), (203, "u", big), (None, "u", "copy " * 40), (204, "u", "short"), (205, "u", "short"), (100, None, "copy " * 40)]
    manifest = warc.write_archives(warc.marked(with_clashes(frame(rows, PAGES).repartition(3))))
    chunks = warc.read_chunks(manifest, 4096).collect()
    payload, by = defaultdict(dict), {r[0]: r for r in rows}
    for c in chunks:
        payload[c.record_id, c.page_id][c.chunk_no] = c
    for (_, page_id), parts in payload.items():
        done, state = 0, hashlib.sha256()
        for i in range(len(parts)):
            state.update(parts[i].data)
            done += len(parts[i].data)
            assert parts[i].digest == state.hexdigest() and parts[i].bytes == done and parts[i]["last"] == (i == len(parts) - 1)
        if parts[0].record_type == "response" and page_id is not None:
            assert b"".join(parts[i].data for i in range(len(parts))).decode() == (by[page_id][2] or "") and parts[0].url == by[page_id][1]
    assert len(payload[next(k for k in payload if k[1] == 202)]) > 50
    got = warc.read_records(manifest, 4096).collect()
    first = {}
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100 and page_id is not None:
            first[body] = min(first.get(body, page_id), page_id)
    want = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        other = first.get(body) if len(body) >= 100 and first.get(body) != page_id else None
        want.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "response" if other is None else "revisit", other))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)


def test_archives_without_rows_and_broken_ones(frame, tmp_path):
    assert warc.read_records(warc.write_archives(warc.marked(frame([], PAGES)))).count() == 0
    manifest = warc.write_archives(warc.marked(frame([(1, "u", "x" * 3000)], PAGES)), f"file://{tmp_path}/w")
    path = next((tmp_path / "w").iterdir())
    path.write_bytes(path.read_bytes()[:-20])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_records(manifest).collect()
