"""Evaluation texts inside training texts: a join of word shingles, verified over item-sized windows.

One pass over the corpus keeps, of each document, the shingles it shares with any item and the words about them; from there
on all is small. The shared shingles are counted, each item's are ordered by rarity, and a document is a candidate for an
item if it shares one of the item's necessary prefix: all but the least_shared - 1 most common ones, since a case shares
least_shared at the least. Of the candidates, the length bound drops those with too few words about their shared shingles,
the positional bound those whose shared pairs of words stand in too small a part of the item, and the rest are aligned. The
items of a block, which has BLOCK_WORDS words at the most, go to the tasks that hold the documents: no shingle, however
common, is the key of a shuffle.

A case: at least half of an item's words stand in the document in the item's order, in unbroken stretches of at least
MIN_STRETCH words; one to three words between two stretches that stand as close in the item are slips and count. So a case
is sure of one whole stretch, of MIN_STRETCH - SHINGLE + 1 shingles; beside slips the stretches may be shorter than a shingle,
and an item may repeat its shingles. With both at five words that is one shingle, and the necessary prefix is all shingles;
even for halves without any slip it could not be less than half of them. Null and empty texts match nothing; an item of fewer
words than a shingle is compared by its words alone, as one stretch. Repeated rows give one row.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.llm import words as W
from airlattice.tables import cut, load

SHINGLE = 5
HALF = 0.5
MIN_STRETCH = 5  #: words in a row that count as a stretch by themselves
NEAR_STRETCH = 2  #: words in a row that count beside a slip
MAX_SLIP = 3
#: Bound on the words of the items taken in one pass over the corpus; more items are taken in as many blocks, one pass each.
BLOCK_WORDS = 2_000_000
GAP = np.uint64(0)  #: stands between windows


class Filter:
    """Membership in a set of hashes: a bit table before the sorted set."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = max(16, int(np.ceil(np.log2(max(len(self.values), 1) * 32))))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(self.values >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """Positions in h of members."""
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0]
        i = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        return at[self.values[i] == h[at]]


def _item_words(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, n, h, text, _, _ in W.of_texts(pa.array(texts, pa.string())):
        out += [h[text == i] for i in range(n)]
    return out


def _shingle_size(n_words: int) -> int:
    return min(SHINGLE, n_words)


def _windows(sizes: list[int], member: dict[int, Filter], span: int):
    """Batches of (doc, text) to (doc, shingles array, words array): of each document that shares a shingle, the shared
    shingles and the words within an item's length of them."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            docs, texts = b.column(0), b.column(1)
            out_doc, out_s, out_w = [], [], []
            for first, _, h, text, _, _ in W.of_texts(texts):
                at, found = [], []
                for size in sizes:
                    s = W.shingles(h, size)
                    hit = member[size](s)
                    hit = hit[text[hit] == text[hit + size - 1]]
                    at.append(hit)
                    found.append(s[hit])
                at, found = np.concatenate(at), np.concatenate(found)
                order = np.argsort(at, kind="stable")
                at, found = at[order], found[order]
                cuts = np.flatnonzero(np.diff(text[at])) + 1
                for hits, shared in zip(np.split(at, cuts), np.split(found, cuts), strict=True):
                    if not len(hits):
                        continue
                    t = int(text[hits[0]])
                    lo, hi = np.searchsorted(text, [t, t + 1])
                    near = W._between(np.maximum(hits - span - lo, 0), np.minimum(hits + SHINGLE + span, hi) - 1 - lo, hi - lo)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], near.astype(np.int8), [0]])))
                    parts = []
                    for s, e in edge.reshape(-1, 2):
                        parts += [h[lo + s : lo + e], np.array([GAP])]
                    out_doc.append(first + t)
                    out_s.append(np.unique(shared).view(np.int64))
                    out_w.append(np.concatenate(parts).view(np.int64))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(v) for v in x])]), pa.int32()), pa.array(np.concatenate(x) if x else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(np.array(out_doc, np.int64))), lists(out_s), lists(out_w)], names=["doc_id", "shingles", "words"])

    return run


def stretches(doc: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    """(position in the document, position in the item, length) of all maximal runs of equal words, of NEAR_STRETCH or more."""
    place: dict[int, list[int]] = {}
    for i, w in enumerate(item.tolist()):
        place.setdefault(w, []).append(i)
    out, open_ = [], {}
    for p, w in enumerate(doc.tolist()):
        fresh = {}
        for i in place.get(w, ()):
            s = open_.pop(i - 1, None)
            fresh[i] = (s[0], s[1], s[2] + 1) if s else (p, i, 1)
        out += [s for s in open_.values() if s[2] >= NEAR_STRETCH]
        open_ = fresh
    return out + [s for s in open_.values() if s[2] >= NEAR_STRETCH]


def covered(doc: np.ndarray, item: np.ndarray) -> int:
    """Most words of the item that stand in the document in its order, in stretches and with slips between close ones."""
    least = min(MIN_STRETCH, len(item))
    runs = sorted(stretches(doc, item))
    best: list[tuple[int, int, int, int]] = []  # document end, item end, words, words if nothing follows beside a slip
    top = 0
    for p, i, n in runs:
        alone = n if n >= least else 0
        score, tied = alone, alone
        for q, j, words, kept in best:
            o = max(0, j - i, q - p)  # a word that stands at the end of one stretch and the start of the next counts once
            if o >= n:
                continue
            gap = i + o - j
            if gap <= MAX_SLIP and abs((p + o - q) - gap) <= 1:
                score = max(score, words + gap + n - o)
                if n >= least or words > 0:
                    tied = max(tied, words + gap + n - o)
            if alone and kept > 0:
                score, tied = max(score, kept + n - o), max(tied, kept + n - o)
            elif kept > 0:
                score, tied = max(score, kept), max(tied, kept)
        best.append((p + n, i + n, score, tied))
        top = max(top, tied)
    return top


def least_shared(n_words: int) -> int:
    """Shingles that a document shares with an item of so many words, if it is a case: those of one whole stretch."""
    return max(1, min(MIN_STRETCH, n_words) - _shingle_size(n_words) + 1)


def _pairs(words: np.ndarray) -> np.ndarray:
    return W.shingles(words, min(NEAR_STRETCH, len(words)))


def positional_bound(doc_pairs: np.ndarray, item: np.ndarray) -> int:
    """Words of the item that can be covered at most. doc_pairs: the document's NEAR_STRETCH words in a row, sorted. Every
    stretch is made of such that the document has, and what counts beside them are slips, MAX_SLIP words on a side."""
    own = _pairs(item)
    if not len(doc_pairs):
        return 0
    at = np.flatnonzero(doc_pairs[np.minimum(np.searchsorted(doc_pairs, own), len(doc_pairs) - 1)] == own)
    if not len(at):
        return 0
    return int(W._between(np.maximum(at - MAX_SLIP, 0), np.minimum(at + NEAR_STRETCH - 1 + MAX_SLIP, len(item) - 1), len(item)).sum())


class Prefixes:
    """The items' necessary prefixes, by shingle. documents: how many documents hold a shingle."""

    def __init__(self, items: dict[int, np.ndarray], documents: dict[int, int]):
        self.items, keys, owners = items, [], []
        for i, w in items.items():
            s = np.unique(W.shingles(w, _shingle_size(len(w)))).view(np.int64)
            rare = sorted(s.tolist(), key=lambda x: (documents.get(x, 0), x))
            keep = rare[: len(rare) - min(least_shared(len(w)), len(rare)) + 1]
            keys.append(np.array([x for x in keep if x in documents], np.int64))
            owners.append(np.full(len(keys[-1]), i, np.int64))
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        self.key, self.owner = key[order], owner[order]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Items with one of the shingles in their prefix."""
        lo, hi = np.searchsorted(self.key, shared, "left"), np.searchsorted(self.key, shared, "right")
        return np.unique(np.concatenate([self.owner[a:b] for a, b in zip(lo, hi, strict=True)] or [self.owner[:0]]))


def _verify(prefixes: Prefixes):
    """Batches of (doc_id, shingles, words) to (item_id, doc_id, share) of the cases."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            out: list[tuple[int, int, float]] = []
            for doc, shared, words in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                doc_words = words.values.to_numpy().view(np.uint64)
                near = len(doc_words)
                pairs = np.sort(_pairs(doc_words))
                for i in prefixes.candidates(shared.values.to_numpy()).tolist():
                    item = prefixes.items[i]
                    least = len(item) * HALF
                    # A slip may stand for a word more than the document has there, beside stretches of NEAR_STRETCH or more.
                    if near * (1 + 1 / NEAR_STRETCH) < least or len(item) > NEAR_STRETCH and positional_bound(pairs, item) < least:
                        continue
                    words_in = covered(doc_words, item)
                    if words_in >= least:
                        out.append((i, doc, words_in / len(item)))
            item_id, doc_id, share = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(item_id, pa.int64()), pa.array(doc_id, pa.int64()), pa.array(share, pa.float64())], names=["item_id", "doc_id", "share"])

    return run


def _block(docs: DataFrame, ids: list[int], texts: list[str]) -> DataFrame:
    items = {int(i): w for i, w in zip(ids, _item_words(texts), strict=True) if len(w)}
    if not items:
        return docs.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint, share double")
    by_size: dict[int, list[int]] = {}
    for w in items.values():
        by_size.setdefault(_shingle_size(len(w)), []).extend(W.shingles(w, _shingle_size(len(w))).tolist())
    member = {k: Filter(np.array(v, np.uint64)) for k, v in by_size.items()}
    span = max((len(w) for w in items.values()), default=1)
    near = cut(docs.mapInArrow(_windows(sorted(member), member, span), "doc_id bigint, shingles array<bigint>, words array<bigint>"))
    held = near.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))  # the block's shingles at most
    documents = {r.shingle: r.n for r in held.toLocalIterator()}
    return near.mapInArrow(_verify(Prefixes(items, documents)), "item_id bigint, doc_id bigint, share double")


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, share): documents that hold at least half of an item. docs: doc_id, text; items: item_id,
    item_text. The items are the query set; they are taken in blocks of BLOCK_WORDS words, each block against all documents."""
    items = items.filter("item_id is not null and item_text is not null").groupBy("item_id").agg(F.min("item_text").alias("item_text"))
    docs = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    out, ids, texts, size = None, [], [], 0
    for r in items.orderBy("item_id").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.item_text)
        size += r.item_text.count(" ") + 1
        if size >= BLOCK_WORDS:
            part = cut(_block(docs, ids, texts))
            out, ids, texts, size = part if out is None else out.unionByName(part), [], [], 0
    if not ids and out is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint, share double")
    if ids:
        part = _block(docs, ids, texts)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("item_id", "doc_id").agg(F.max("share").alias("share"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p8_found: item_id, doc_id."""
    return leaks(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "eval_items")).select("item_id", "doc_id")
