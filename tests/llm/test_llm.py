"""Packing, leakage and subjects on small tables: defined edge cases, brute force, exact round trips, held-out labels."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from airlattice.llm import leakage, packing, subjects
from airlattice.llm import words as W

# ---- words ----


def plain_words(text):
    text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
    text = re.sub(r"\\[nrtbf]", " ", text)
    text = re.sub(r"</?[a-zA-Z!][^<>]{0,97}>", " ", text)
    text = re.sub(r"&[^;&]{1,7};", " ", text)
    return re.findall(r"(?:[^\W_])+", text.lower())


TEXTS = ["The quick-brown_fox", "", None, "a\\nb \\u00e9t\\u00e9 \\u0041x", "été Été ÜBER straße — dash…x“q”", "<b>bold</b> a < b > c", "x&amp;y & z; ok", "line\nnext\tcol", "日本 kanji", "\\u2019s end\\", "a" * 5000]


def test_words_against_plain_tokeniser():
    texts = [t for t in TEXTS if t is not None]
    known = {}
    for t in texts:
        own = [h for _, _, h, _, _, _ in W.of_texts(pa.array([t]))]
        own = np.concatenate(own).tolist() if own else []
        want = plain_words(t)
        assert len(own) == len(want), (t, want)
        for h, w in zip(own, want, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def test_words_do_not_depend_on_neighbours(monkeypatch):
    both = pa.array(TEXTS * 3)
    alone = [np.concatenate([h for _, _, h, _, _, _ in W.of_texts(pa.array([t], pa.string()))] or [np.empty(0, np.uint64)]).tolist() for t in TEXTS * 3]
    for size in (10, 10_000, 2_000_000):
        monkeypatch.setattr(W, "CHUNK_BYTES", size)
        together = []
        for _, n, h, text, _, _ in W.of_texts(both):
            together += [h[text == i].tolist() for i in range(n)]
        assert together == alone
    sliced = both.slice(3, 5)
    assert [h.tolist() for _, n, hh, text, _, _ in W.of_texts(sliced) for h in [hh[text == i] for i in range(n)]] == alone[3:8]


# ---- packing ----


def optimal(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in sorted({b for b in bins if b + items[i] <= capacity}):
            at = bins.index(room)
            bins[at] += items[i]
            go(i + 1, bins)
            bins[at] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def histogram(items):
    return {s: items.count(s) for s in set(items)}


def test_reduction_keeps_the_optimum():
    r = random.Random(3)
    over = 0
    for _ in range(300):
        capacity = r.choice([10, 17, 30, 50])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        fixed, rest = packing.reduce(histogram(items), capacity)
        left = [s for s, n in rest.items() for _ in range(n)]
        best = optimal(items, capacity)
        assert fixed.count + (optimal(left, capacity) if left else 0) == best
        packed = packing.pack_histogram(histogram(items), capacity)
        got = {}
        for content, times, room in packed.groups:
            assert room == capacity - sum(s * n for s, n in content.items()) >= 0
            for s, n in content.items():
                got[s] = got.get(s, 0) + n * times
        assert got == histogram(items)
        over += packed.count - best
    assert over <= 6


def test_reduction_of_every_small_instance():
    """All instances of up to six items at capacity 9; sets of one, two and three items are fixed among them."""
    kinds = set()
    for n in range(1, 7):
        for items in itertools.combinations_with_replacement(range(1, 10), n):
            fixed, rest = packing.reduce(histogram(items), 9)
            left = [s for s, k in rest.items() for _ in range(k)]
            assert fixed.count + (optimal(left, 9) if left else 0) == optimal(items, 9), items
            kinds |= {sum(content.values()) for content, _, _ in fixed.groups}
    assert kinds == {1, 2, 3}


def test_pairs_are_not_fixed_where_three_items_fit():
    """Two of 70 side by side leave three of 33 without the place they fill better."""
    assert packing.reduce({70: 2, 33: 6}, 170)[0].count == 0
    assert packing.pack_histogram({70: 2, 33: 6}, 170).count == 2


def test_large_histogram_is_nearly_full():
    g = np.random.default_rng(0)
    sizes = np.clip(g.lognormal(7, 1, 200_000).astype(int), 1, 8192)
    packed = packing.pack_histogram({int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}, 8192)
    assert packed.count <= -(-int(sizes.sum()) // 8192) + 20


@pytest.mark.parametrize("buckets", [50_000, 3])
def test_every_document_is_placed(spark, monkeypatch, buckets):
    monkeypatch.setattr(packing, "BUCKET_ITEMS", buckets)
    r = random.Random(1)
    texts = [" ".join(r.choice(["alpha", "beta", "x", "\n"]) for _ in range(r.choice([1, 5, 40, 40, 40, 700]))) for _ in range(120)] + ["", None, "<|endoftext|>"]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5] + [(None, "lost", "x")], "doc_id bigint, text string, tokens string")
    tokens = packing.load_tokenizer(packing.tokenizer_path())
    for broadcast in (32_000_000, 0):
        monkeypatch.setattr(packing, "BROADCAST_BYTES", broadcast)
        got = packing.pack(df, 128).collect()
        by_doc, by_container = {}, {}
        for p in got:
            by_doc.setdefault(p.doc_id, []).append(p)
            by_container[p.container_id] = by_container.get(p.container_id, 0) + p.n_tokens
        assert set(by_doc) == set(range(len(texts)))
        for i, t in enumerate(texts):
            size = len(tokens.encode_ordinary(t)) if t else 0
            pieces = sorted(by_doc[i], key=lambda p: p.piece)
            assert [p.token_start for p in pieces] == [128 * k for k in range(len(pieces))] and sum(p.n_tokens for p in pieces) == size
            assert len(pieces) == max(1, -(-size // 128)) and len({p.piece for p in pieces}) == len(pieces)
        assert max(by_container.values()) <= 128
        sizes = [len(tokens.encode_ordinary(t)) for t in texts if t]
        packed = packing.pack_histogram(histogram([s % 128 for s in sizes if s % 128]), 128)
        assert len([c for c, n in by_container.items() if n]) == packed.count + sum(s // 128 for s in sizes)
        assert sorted(by_container) == list(range(len(by_container)))
    assert packing.pack(df.limit(0), 128).collect() == []


# ---- leakage ----

VOCABULARY = [a + b for a in "bdfglmnprst" for b in ("anor", "ulin", "omek", "isato", "erun", "ykal")]


def sentence(r, n):
    return [r.choice(VOCABULARY) for _ in range(n)]


def test_leaks(spark):
    r = random.Random(9)
    items = {i: sentence(r, n) for i, n in enumerate([40, 60, 25, 9, 3, 40])}
    items[5] = items[0][:]  # two items of one text
    noise = lambda: sentence(r, 200)
    spoil = lambda ws, every: [w if i % every else w[::-1] + "q" for i, w in enumerate(ws)]
    docs, want = [], set()

    def add(words, *held):
        docs.append((len(docs), " ".join(words) if isinstance(words, list) else words))
        want.update((i, len(docs) - 1) for i in held)

    both = (0, 5)
    add(noise() + items[0] + noise(), *both)
    add("# " + ",\n# ".join(items[0]).upper(), *both)
    add('{"source": ["' + '\\n", "'.join(" ".join(items[1][k : k + 9]) for k in range(0, 60, 9)) + '"]}', 1)
    add("<p>" + " ".join(f"<b>{w}</b>" for w in items[1]) + "</p>", 1)
    add(noise() + items[0][:22] + noise(), *both)  # half and a little
    add(noise() + items[0][:14] + noise())  # a short quotation
    add(items[1][:18] + noise() + items[1][30:48] + noise(), 1)  # two stretches
    add(items[1][30:48] + noise() + items[1][:18])  # not in the item's order
    add(noise() + spoil(items[1], 8) + noise(), 1)  # slips
    add([w for w in items[1] for w in (w, "zz")])  # no unbroken stretch
    cut = items[1][:30] + [items[1][30]] + sentence(r, 4) + items[1][30:]  # a chance word carries the first stretch one further
    add(noise() + cut + noise(), 1)
    add(noise() + items[2] + items[0] + noise(), 2, *both)
    add(noise() + items[3] + noise(), 3)
    add(noise() + items[4] + noise(), 4)  # an item shorter than a shingle
    add(docs[0][1], *both)  # a copy
    add(noise())
    add("")
    add(None)
    add("w " * 300_000 + " ".join(items[2]), 2)
    df = spark.createDataFrame([(*d, "x") for d in docs + docs[:2] + [(None, docs[0][1])]], "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()] + [(0, " ".join(items[0])), (77, None), (78, ""), (None, "x y z")], "item_id bigint, item_text string")
    got = [(x.item_id, x.doc_id) for x in leakage.leaks(df, it).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert leakage.leaks(df.limit(0), it).collect() == [] and leakage.leaks(df, it.limit(0)).collect() == []


@pytest.mark.parametrize("n", [66, 80, 107])
def test_leaks_in_short_stretches(spark, n):
    """Half of an item in stretches of five words, one shingle each; a whole item that repeats its shingles; slips beside
    stretches shorter than a shingle. Two words less than half is none."""
    r = random.Random(n)
    item = [f"w{i}" for i in range(n)]
    noise = lambda: sentence(r, 9)
    short = [w for k in range(-(-n // 10)) for w in item[k * 6 : k * 6 + 5] + noise()]
    less = [w for k in range((n - 3) // 10) for w in item[k * 6 : k * 6 + 5] + noise()]
    slips = item[:5] + [w for k in range(5, n - 5, 5) for w in sentence(r, 3) + item[k + 3 : k + 5]]
    again = [f"r{i % 5}" for i in range(n)]
    df = spark.createDataFrame([(i, " ".join(noise() + t + noise())) for i, t in enumerate([short, less, slips, again])], "doc_id bigint, text string")
    it = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(again))], "item_id bigint, item_text string")
    assert sorted((x.item_id, x.doc_id) for x in leakage.leaks(df, it).collect()) == [(1, 0), (1, 2), (2, 3)]


@pytest.mark.parametrize("every", [3, 4, 5, 6, 8, 12, 30])
def test_leaks_at_slip_rates_against_all_pairs(spark, every):
    """Items with one word in so many spoilt, whole or in part: what is found is what aligning all pairs finds."""
    r = random.Random(every)
    items = {i: sentence(r, n) for i, n in enumerate([30, 45, 60, 90, 120])}
    spoil = lambda ws: [w if r.random() > 1 / every else w[::-1] + "q" for w in ws]
    docs = []
    for i, t in items.items():
        for part in (1.0, 0.75, 0.6, 0.5, 0.4):
            n = int(len(t) * part)
            docs.append(" ".join(sentence(r, 60) + spoil(t[:n]) + sentence(r, 60)))
            docs.append(" ".join(spoil(t[: n // 2]) + sentence(r, 40) + spoil(t[-(n // 2) :])))
    words = lambda t: np.concatenate([h for _, _, h, _, _, _ in W.of_texts(pa.array([t]))])
    want = {(i, d) for i, t in items.items() for d, text in enumerate(docs) if leakage.covered(words(text), words(" ".join(t))) >= len(t) / 2}
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    it = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id bigint, item_text string")
    got = {(x.item_id, x.doc_id) for x in leakage.leaks(df, it).collect()}
    assert got == want
    if every >= 8:
        assert len(want) >= 25


def test_bounds_lose_nothing():
    """The positional bound is never below what alignment covers; the prefix leaves out only what a case must exceed."""
    r = np.random.default_rng(3)
    for _ in range(300):
        item = r.integers(0, 30, r.integers(2, 40)).astype(np.uint64)
        doc = np.concatenate([item[a : a + r.integers(1, 12)] if r.random() < 0.7 else r.integers(0, 30, 4).astype(np.uint64) for a in r.integers(0, len(item), 5)])
        assert leakage.positional_bound(np.sort(leakage._pairs(doc)), item) >= leakage.covered(doc, item)
    words = {1: np.arange(20).astype(np.uint64)}
    shingles = W.shingles(words[1], 5).view(np.int64).tolist()
    p = leakage.Prefixes(words, {s: 1 for s in shingles})
    assert len(p.key) == len(shingles) - leakage.least_shared(20) + 1
    assert p.candidates(np.array(sorted(shingles[:2]))).tolist() == [1] and p.candidates(np.array([5])).tolist() == []


def test_long_tags_and_entities():
    """A tag of any length that is made like one, and an entity by its letters; what only stands between signs stays."""
    count = lambda t: sum(len(h) for _, _, h, _, _, _ in W.of_texts(pa.array([t])))
    assert count('a <img src="data:image/png;base64,' + "Qx" * 500 + '" alt="x y"> b') == 2
    assert count('a <img src=\\"' + "Qx" * 500 + '\\"> b') == 2 and count("a <!-- " + "word " * 90 + "--> b") == 2
    assert count("if x <b and " + "word " * 90 + "> c") > 90
    assert count("a &CounterClockwiseContourIntegral; b") == 2 and count("a & some words that go on; b") == 7


def test_items_in_blocks(spark, monkeypatch):
    r = random.Random(4)
    items = [(i, " ".join(sentence(r, 30))) for i in range(7)]
    docs = [(i, " ".join(sentence(r, 50)) + " " + items[i % 7][1]) for i in range(20)]
    df, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, item_text string")
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 60)
    assert sorted((x.item_id, x.doc_id) for x in leakage.leaks(df, it).collect()) == sorted((i % 7, i) for i in range(20))


# ---- subjects ----

AREAS = {s: [s[:2] + w for w in ("alor", "bemin", "cusat", "dorel", "efano", "gimur", "hotes", "julak", "kerom", "lunip", "masod", "nevit")] for s in ("law", "music", "sport")}
FILLER = ["figure", "shows", "month", "import", "numpy", "plot", "the", "data", "value", "rows"]


def notebook(r, *areas, n=30, other=()):
    words = [r.choice(AREAS[a]) for a in areas for _ in range(n)] + [r.choice(FILLER) for _ in range(60)] + list(other)
    r.shuffle(words)
    return " ".join(words)


def test_subjects_held_out(spark):
    """Labels of a few documents, some wrong; foreign words only beside known ones; mixtures, passing mentions, none."""
    r = random.Random(2)
    names, docs, truth = list(AREAS), [], {}
    for i in range(900):
        kind = r.random()
        areas = r.sample(names, 1 if kind < 0.75 else 2) if kind < 0.92 else []
        passing = [r.choice(AREAS[r.choice([a for a in names if a not in areas])])] * 3 if areas and r.random() < 0.2 else []
        docs.append((i, notebook(r, *areas, other=passing)))
        truth[i] = set(areas)
    labels = [(i, a) for i in range(120) for a in truth[i]] + [(1, "law"), (2, "sport"), (3, "cooking"), (None, "law"), (4, None)]
    docs += [(900, ""), (901, None), (902, docs[0][1]), (903, "x " * 200_000 + notebook(r, "law"))]
    truth |= {900: set(), 901: set(), 902: truth[0], 903: {"law"}}
    df = spark.createDataFrame([(*d, "y") for d in docs + docs[:3]], "doc_id bigint, text string, subject string")
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string")
    sub = spark.createDataFrame([(s, "") for s in [*names, "unseen"]] + [(None, "")], "subject string, about string")
    got = {i: set() for i in truth}
    rows = subjects.subjects_of(df, lab, sub).select("doc_id", "subject").distinct().collect()
    for x in rows:
        got[x.doc_id].add(x.subject)
    wrong = [i for i in truth if got[i] != truth[i]]
    assert len(wrong) <= 5, [(i, got[i], truth[i]) for i in wrong[:5]]
    assert subjects.subjects_of(df.limit(0), lab, sub).collect() == []
    assert subjects.subjects_of(df, lab.limit(0), sub).collect() == []
    assert subjects.subjects_of(df, lab, sub.limit(0)).collect() == []


def test_subjects_come_through_the_tree(spark, monkeypatch):
    """Without bisection no document gets a subject: the labels only name leaves. With it, leaves keep to one subject each."""
    r = random.Random(4)
    docs = [(i, notebook(r, list(AREAS)[i % 3])) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, list(AREAS)[i % 3]) for i in range(30)], "doc_id bigint, subject string")
    sub = spark.createDataFrame([(s, "") for s in AREAS], "subject string, about string")
    got = {(x.doc_id, x.subject) for x in subjects.subjects_of(df, lab, sub).collect()}
    assert got == {(i, list(AREAS)[i % 3]) for i in range(300)}
    monkeypatch.setattr(subjects, "MAX_DEPTH", 0)
    assert subjects.subjects_of(df, lab, sub).collect() == []


def test_bisection_of_unit_vectors(spark):
    """Two kinds of documents without a label; sums over leaves are those of plain arithmetic, on one level or two."""
    r = np.random.default_rng(1)
    dims = [r.choice(np.arange(6) if i % 2 else np.arange(6, 12), 4, replace=False) for i in range(200)]
    rows = [(i, sorted(map(int, d)), [1] * 4) for i, d in enumerate(dims)]
    df = spark.createDataFrame(rows, "doc_id bigint, terms array<int>, counts array<int>").repartition(80)
    tree, leaves = subjects.bisect(df, np.ones(12))
    for n, total, square in leaves.values():
        used = np.flatnonzero(total)
        assert (used < 6).all() or (used >= 6).all()
        assert np.isclose(total.sum(), n * 2) and np.isclose(square.sum(), n)
    assert sum(n for n, _, _ in leaves.values()) == 200 and len(leaves) > 1 and max(tree.depth) >= 1


def test_mixture_and_names():
    leaf_a, leaf_b = np.array([3, 2, 1, 0, 0, 0.0]), np.array([0, 0, 0, 1, 1, 2.0])
    belongs = np.array([[0.9, 0.1]] * 3 + [[0.2, 0.8]] * 3)
    assert subjects.leaf_names({7: (5, leaf_a, leaf_a), 8: (5, leaf_b, leaf_b)}, belongs) == {7: 0, 8: 1}
    assert subjects.leaf_names({7: (5, leaf_a, leaf_a), 8: (5, leaf_b, leaf_b)}, np.full((6, 2), 0.5)) == {}
    p = 0.98 * np.array([leaf_a / 6, leaf_b / 4]) + 0.02 / 6
    words, _ = subjects.mixture(np.zeros(6, int), np.arange(6), np.array([3, 2, 1, 2, 2, 4.0]), 1, p)
    assert abs(words[0, 0] - 6) < 0.2 and abs(words[0, 1] - 8) < 0.2
