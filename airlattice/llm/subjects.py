"""Subject areas of documents: bisecting k-means over normalised document vectors, leaves labelled by their discriminative
terms, and each document's subjects from its mixture of leaves.

1. Terms: all documents' words of letters, counted; those held by neither too few nor too many of all documents are the
vectors' dimensions, square roots of counts times the inverse document frequency, normalised. 2. Bisecting k-means over all
documents, without labels: each leaf with more than its share of the scatter is cut along the term that scatters most.
3. A leaf's discriminative terms weigh more in it than among all documents; the labelled documents say how these are shared
among the subjects, and the leaf takes the subject that has most of them, if it has enough. Leaves of no subject (tutorials,
frames, outputs) stay without. 4. Over all documents, terms that keep to the leaves of one subject and are rare elsewhere are
topical; repeated with all documents whose topical words are clearly one subject's in the leaves' place, so that terms come in
of documents, such as of rarer languages, that no leaf has to itself. 5. A document's topical words are a mixture of the named
leaves' discriminative profiles; a subject counts if its part is more than a passing mention: at least MIN_WORDS words,
MIN_TERMS different terms, and MIN_SHARE of the words.

The labels do no more than name leaves, and are the only sample: at most MAX_LABELLED labelled documents are used. Everything
else covers all documents. Null or empty texts and documents without topical terms get no subject; without labels, or with
none of a listed subject, nothing is given. Subjects not in the list are never given. A repeated row is one.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.llm import words as W
from airlattice.tables import cut, load

MAX_LABELLED = 50_000
TERM_BYTES = (3, 30)
#: A dimension of the vectors: a term held by this part of all documents, and by at least so many.
LEAST_RATE, MOST_RATE, LEAST_DOCS = 0.002, 0.5, 3
#: Bisection: a leaf is cut if it holds this part of all scatter and so many documents. Each depth takes one pass over the
#: documents, which moves its centroids from their seeds to the means that the next pass assigns by; LLOYD passes follow.
SPLIT_SHARE, LEAST_LEAF, MAX_DEPTH, LLOYD = 0.008, 10, 24, 1
LEAF_NAME = 0.75  #: a leaf's name is the subject that has this part of its discriminative terms
LABEL_PRIOR = 0.1  #: labelled documents of each subject that are taken to hold a term besides those that do
CLEAR_SHARE, ROUNDS = 0.8, 2  #: a document of one clear subject has so much of its topical words on it; rounds of telling terms from such
#: A topical term: held by this part of the documents of a subject's leaves, so purely, all subjects weighing alike, and so many
#: times as often as by all other documents, those of no subject among them.
TOPICAL_RATE, TOPICAL_PURITY, TOPICAL_TIMES = 0.01, 0.75, 4.0
MIN_WORDS, MIN_TERMS, MIN_SHARE = 6.5, 5.5, 0.07
MIXTURE_STEPS, MIXTURE_DOCS = 12, 500  #: and documents that are taken together, to stay within the processor's cache
TREE_TASKS = 64  #: partial sums that one task of the aggregation tree adds up


def _ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def _count_terms(batches: Iterable[pa.RecordBatch]):
    """Batches of (doc, text) to (doc, terms, counts): each document's different words of letters."""
    for b in batches:
        docs = b.column(0)
        t_all, c_all, n_all = [], [], []
        for _, n, h, text, size, letters in W.of_texts(b.column(1)):
            ok = letters & (size >= TERM_BYTES[0]) & (size <= TERM_BYTES[1])
            h, text = h[ok], text[ok]
            order = np.lexsort((h, text))
            h, text = h[order], text[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])])) if len(h) else np.empty(0, np.int64)
            t_all.append(h[new].view(np.int64))
            c_all.append(np.diff(np.append(new, len(h))).astype(np.int32))
            n_all.append(np.bincount(text[new], minlength=n))
        lengths = np.concatenate(n_all) if n_all else np.empty(0, np.int64)
        flat = lambda x, k: np.concatenate(x) if x else np.empty(0, k)
        yield pa.RecordBatch.from_arrays([docs, _ragged(flat(t_all, np.int64), lengths, pa.int64()), _ragged(flat(c_all, np.int32), lengths, pa.int32())], names=["doc_id", "terms", "counts"])


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of every entry of a batch (doc, terms, counts)."""
    terms, counts = b.column(1), b.column(2)
    lengths = np.diff(terms.offsets.to_numpy())
    return np.repeat(np.arange(len(terms)), lengths), terms.flatten().to_numpy(), counts.flatten().to_numpy()


class Terms:
    """A sorted set of terms, by number."""

    def __init__(self, terms: np.ndarray):
        self.terms = np.sort(terms)

    def __len__(self) -> int:
        return len(self.terms)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Each term's number, or -1."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[i] == terms, i, -1)

    def entries(self, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number, count) of a batch's entries that are in the set."""
        row, term, count = _flat(b)
        at = self.find(term)
        ok = at >= 0
        return row[ok], at[ok], count[ok]


def _vectors(terms: Terms):
    """Batches of (doc, terms, counts) to (doc, numbers, counts) over a set of terms; documents with none are left out."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            row, at, count = terms.entries(b)
            lengths = np.bincount(row, minlength=len(b))
            has = pa.array(lengths > 0)
            out = [b.column(0), _ragged(at, lengths, pa.int32()), _ragged(count, lengths, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.filter(has) for c in out], names=["doc_id", "terms", "counts"])

    return run


class Tree:
    """Nodes of the bisection: centroids, children, depths; and the weights of the vectors' dimensions."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.centroid, self.child, self.depth = weight, [np.zeros(len(weight))], [-1], [0]

    def unit(self, row: np.ndarray, dim: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """The entries of the documents' unit vectors."""
        w = np.sqrt(count.astype(float)) * self.weight[dim]
        norm = np.sqrt(np.bincount(row, w * w, minlength=n))
        return w / np.maximum(norm, 1e-12)[row]

    def assign(self, row: np.ndarray, dim: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Each document's leaf: from the root, to the child whose centroid has the larger cosine."""
        child, node = np.array(self.child), np.zeros(n, np.int64)
        unit = np.array([c / max(np.linalg.norm(c), 1e-12) for c in self.centroid])
        ahead = np.zeros_like(unit)
        at = np.flatnonzero(child >= 0)
        ahead[at] = unit[child[at] + 1] - unit[child[at]]
        while len(row) and (inner := child[node] >= 0).any():
            go = inner[row]
            row, dim, weight = row[go], dim[go], weight[go]
            d = np.bincount(row, weight * ahead[node[row], dim], minlength=n)
            node = np.where(inner, child[node] + (d > 0), node)
        return node

    def cut(self, leaf: int, n: int, total: np.ndarray, square: np.ndarray) -> None:
        """Two children: with more and without the term whose weight scatters most among the leaf's documents."""
        c = total / n
        spread = square / n - c * c
        t = int(spread.argmax())
        more, less = c.copy(), c.copy()
        more[t] += np.sqrt(max(spread[t], 0))
        less[t] = 0
        self.child[leaf] = len(self.child)
        self.centroid += [less, more]
        self.child += [-1, -1]
        self.depth += [self.depth[leaf] + 1] * 2


def _leaf_sums(tree: Tree):
    """Batches of vectors to (leaf, task, number of documents, sums of their unit vectors and of the squares as bytes), one
    row a leaf and task."""

    def run(batches: Iterable[pa.RecordBatch]):
        leaves, dims = len(tree.child), len(tree.weight)
        total, square, count = np.zeros((leaves, dims)), np.zeros((leaves, dims)), np.zeros(leaves, np.int64)
        for b in batches:
            row, dim, times = _flat(b)
            w = tree.unit(row, dim, times, len(b))
            leaf = tree.assign(row, dim, w, len(b))
            cell = leaf[row] * dims + dim
            total += np.bincount(cell, w, minlength=total.size).reshape(total.shape)
            square += np.bincount(cell, w * w, minlength=total.size).reshape(total.shape)
            count += np.bincount(leaf, minlength=leaves)
        at = np.flatnonzero(count)
        blob = lambda x: pa.array([x[i].tobytes() for i in at], pa.binary())
        task = pa.array(np.full(len(at), TaskContext.get().partitionId() // TREE_TASKS, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), task, pa.array(count[at]), blob(total), blob(square)], names=["leaf", "task", "n", "total", "square"])

    return run


_SUMS = "leaf bigint, task bigint, n bigint, total binary, square binary"


def _added(t: pd.DataFrame) -> pd.DataFrame:
    add = lambda c: sum((np.frombuffer(x) for x in t[c]), np.zeros(len(t[c].iloc[0]) // 8)).tobytes()
    return pd.DataFrame({"leaf": [t.leaf.iloc[0]], "task": [t.task.iloc[0] // TREE_TASKS], "n": [t.n.sum()], "total": [add("total")], "square": [add("square")]})


def leaf_sums(vectors: DataFrame, tree: Tree) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Of each leaf, the number of documents, the sum of their vectors, and of the squares. Partial sums are added up in a
    tree of two levels, TREE_TASKS at a time on the first."""
    rows = vectors.mapInArrow(_leaf_sums(tree), _SUMS)
    for key in [["leaf", "task"], ["leaf"]] if vectors.rdd.getNumPartitions() > TREE_TASKS else [["leaf"]]:
        rows = rows.groupBy(*key).applyInPandas(_added, _SUMS)
    return {r.leaf: (r.n, np.frombuffer(r.total), np.frombuffer(r.square)) for r in rows.collect()}  # one row a leaf


def scatter(n: int, total: np.ndarray) -> float:
    """Sum of squared distances of unit vectors from their mean."""
    return n - float(total @ total) / n


def bisect(vectors: DataFrame, weight: np.ndarray) -> tuple[Tree, dict[int, tuple[int, np.ndarray, np.ndarray]]]:
    """The tree over all vectors, and its leaves' sums. All leaves of a depth are cut at once."""
    tree = Tree(weight)
    leaves = leaf_sums(vectors, tree) if len(weight) else {}
    whole = sum(scatter(n, t) for n, t, _ in leaves.values())
    for depth in range(MAX_DEPTH):
        large = [i for i, (n, t, _) in leaves.items() if tree.depth[i] == depth and n >= LEAST_LEAF and scatter(n, t) > SPLIT_SHARE * whole]
        for i in sorted(large):
            tree.cut(i, *leaves[i])
        if not large:
            break
        leaves = refined(vectors, tree)
    for _ in range(LLOYD):
        leaves = refined(vectors, tree)
    return tree, leaves


def refined(vectors: DataFrame, tree: Tree) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """A pass over all documents: the leaves' sums, whose means become their centroids."""
    leaves = leaf_sums(vectors, tree)
    for i, (n, t, _) in leaves.items():
        tree.centroid[i] = t / n
    return leaves


def discriminative(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """How much each term tells a leaf from all documents: its gain where it weighs more in the leaf, else 0."""
    p, q = part / max(part.sum(), 1e-12), whole / max(whole.sum(), 1e-12)
    return np.where(p > q, p * np.log(np.maximum(p, 1e-12) / np.maximum(q, 1e-12)), 0)


def leaf_names(leaves: dict[int, tuple[int, np.ndarray, np.ndarray]], belongs: np.ndarray) -> dict[int, int]:
    """The subject of each leaf that has one. belongs: by dimension and subject, how the labelled documents share the term."""
    whole = sum((t for _, t, _ in leaves.values()), np.zeros(len(belongs)))
    out = {}
    for i, (_, t, _) in leaves.items():
        gain = discriminative(t, whole)
        part = gain @ belongs / max(gain.sum(), 1e-12)
        if len(part) and part.max() >= LEAF_NAME:
            out[i] = int(part.argmax())
    return out


class Groups:
    """The documents that tell a subject's terms, by group. At first the documents of each named leaf; with topical terms
    known, all documents of one clear subject: those in a leaf of that subject are the leaf's, the others, of leaves that
    several subjects share, make up a group a subject."""

    def __init__(self, vocabulary: Terms, tree: Tree, name: dict[int, int], n_subjects: int):
        self.vocabulary, self.tree, self.n_subjects = vocabulary, tree, n_subjects
        self.leaf_subject = np.full(len(tree.child), -1)
        self.leaf_subject[list(name)] = list(name.values())
        self.known: tuple[Terms, np.ndarray] | None = None  #: topical terms and the subject each keeps to
        self.subject = np.concatenate([self.leaf_subject, np.arange(n_subjects), [-1]])  #: of each group; the last is of no subject

    def of(self, b: pa.RecordBatch) -> np.ndarray:
        """Each document's group."""
        n = len(b)
        row, dim, count = self.vocabulary.entries(b)
        leaf = self.tree.assign(row, dim, self.tree.unit(row, dim, count, n), n)
        own = np.where(np.bincount(row, minlength=n) > 0, self.leaf_subject[leaf], -1)
        none = len(self.subject) - 1
        if self.known is None:
            return np.where(own >= 0, leaf, none)
        terms, owner = self.known
        row, at, count = terms.entries(b)
        cell, shape = row * self.n_subjects + owner[at], (n, self.n_subjects)
        words, kinds = np.bincount(cell, count, minlength=n * self.n_subjects).reshape(shape), np.bincount(cell, minlength=n * self.n_subjects).reshape(shape)
        top = words.argmax(1)
        clear = (kinds[np.arange(n), top] >= MIN_TERMS) & (words[np.arange(n), top] >= CLEAR_SHARE * words.sum(1))
        return np.where(clear, np.where(own == top, leaf, len(self.leaf_subject) + top), none)


def by_subject(words: np.ndarray, kinds: np.ndarray, subject: np.ndarray, n_subjects: int) -> tuple[np.ndarray, np.ndarray]:
    to = np.zeros((len(subject), n_subjects))
    to[np.arange(len(subject)), subject] = 1
    return words @ to, kinds @ to


def _by_group(groups: Groups):
    """Batches of (doc, terms, counts) to (term, grp, documents, words); term 0 counts the documents themselves."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            group = groups.of(b)
            row, term, count = _flat(b)
            order = np.lexsort((group[row], term))
            t, at, c = term[order], group[row][order], count[order]
            new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (at[1:] != at[:-1])])) if len(t) else np.empty(0, np.int64)
            docs = np.bincount(group, minlength=len(groups.subject))
            held = np.flatnonzero(docs)
            columns = [np.concatenate(x) for x in ([t[new], np.zeros(len(held), np.int64)], [at[new], held], [np.diff(np.append(new, len(t))), docs[held]],
                                                   [np.add.reduceat(c, new) if len(new) else np.empty(0, np.int64), np.zeros(len(held), np.int64)])]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["term", "grp", "n", "words"])

    return run


def topical(terms: DataFrame, groups: Groups) -> tuple[Terms, np.ndarray, np.ndarray, np.ndarray]:
    """(topical terms, subject each keeps to, subject of each profile, profiles as term distributions). terms: doc_id, terms,
    counts."""
    by = terms.mapInArrow(_by_group(groups), "term bigint, grp bigint, n bigint, words bigint")
    by = cut(by.groupBy("term", "grp").agg(F.sum("n").alias("n"), F.sum("words").alias("words")))
    docs = np.zeros(groups.n_subjects + 1)  # the last of no subject
    for r in by.filter("term = 0").collect():  # one row a group
        docs[groups.subject[r.grp]] += r.n
    lookup = lambda values, at: F.element_at(F.array(*(F.lit(x) for x in values)), (at + 1).cast("int"))
    held = by.filter("term != 0").groupBy("term", lookup(groups.subject.tolist(), F.col("grp")).alias("subject")).agg(F.sum("n").alias("n"))
    # Only terms of TOPICAL_RATE in some subject can be topical: a few thousand at most, whatever the corpus.
    size = lookup([float(max(x, 1)) for x in docs], F.col("subject"))
    common = held.filter("subject >= 0").filter((F.col("n") >= TOPICAL_RATE * size) & (F.col("n") >= LEAST_DOCS)).select("term").distinct()
    t = held.join(common, "term", "left_semi").toPandas()
    t = t.assign(all=t.groupby("term").n.transform("sum"))
    t = t[t.subject >= 0]
    of = docs[t.subject.to_numpy(np.int64)]
    t = t.assign(rate=t.n / np.maximum(of, 1), others=(t["all"] - t.n) / np.maximum(docs.sum() - of, 1))
    t = t.assign(share=t.rate / t.groupby("term").rate.transform("sum"))
    t = t[(t.share >= TOPICAL_PURITY) & (t.n >= LEAST_DOCS) & (t.rate >= TOPICAL_RATE) & (t.rate >= TOPICAL_TIMES * t.others)]
    lexicon = Terms(t.term.to_numpy(np.int64))
    owner = np.zeros(len(lexicon), np.int64)
    owner[lexicon.find(t.term.to_numpy(np.int64))] = t.subject.to_numpy(np.int64)  # one subject a term, as its share is above half
    listed = by.sparkSession.createDataFrame(pd.DataFrame({"term": lexicon.terms}), "term bigint")
    words = by.join(F.broadcast(listed), "term").toPandas()  # topical terms by groups
    table = np.zeros((len(groups.subject), len(lexicon)))
    table[words.grp.to_numpy(np.int64), lexicon.find(words.term.to_numpy(np.int64))] = words.words.to_numpy()
    whole = table.sum(0)
    table = np.array([np.where(discriminative(row, whole) > 0, row, 0) for row in table]).reshape(table.shape)
    table[groups.subject < 0] = 0
    some = table.sum(1) > 0  # a group with no discriminative term tells nothing
    profile = table[some] / table[some].sum(1, keepdims=True)
    return lexicon, owner, groups.subject[some], 0.98 * profile + 0.02 / max(len(lexicon), 1)


def mixture(row: np.ndarray, dim: np.ndarray, count: np.ndarray, n: int, profile: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, different terms) of each document that each leaf explains, by expectation and maximisation."""
    k = len(profile)
    weight = np.full((n, k), 1 / max(k, 1), profile.dtype)
    like = profile[:, dim].T
    edges = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.empty(0, np.int64)
    part = like
    for _ in range(MIXTURE_STEPS):
        part = like * weight[row]
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        sums = np.add.reduceat(part * count[:, None], edges) if len(edges) else np.empty((0, k))
        weight[row[edges]] = sums / np.maximum(sums.sum(1, keepdims=True), 1e-30)
    words, kinds = np.zeros((n, k)), np.zeros((n, k))
    if len(edges):
        words[row[edges]] = np.add.reduceat(part * count[:, None], edges)
        kinds[row[edges]] = np.add.reduceat(part, edges)
    return words, kinds


def _assign(terms: Terms, subject: np.ndarray, profile: np.ndarray, names: list[str]):
    """Batches of (doc, terms, counts) to (doc, subject, share)."""

    def run(batches: Iterable[pa.RecordBatch]):
        for b in (x.slice(i, MIXTURE_DOCS) for x in batches for i in range(0, len(x), MIXTURE_DOCS)):
            row, at, count = terms.entries(b)
            words, kinds = by_subject(*mixture(row, at, count.astype(np.float32), len(b), profile.astype(np.float32)), subject, len(names))
            share = words / np.maximum(words.sum(1, keepdims=True), 1e-12)
            at, s = np.nonzero((words >= MIN_WORDS) & (kinds >= MIN_TERMS) & (share >= MIN_SHARE))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([names[i] for i in s], pa.string()), pa.array(share[at, s])], names=["doc_id", "subject", "share"])

    return run


def shared_by_labels(vectors: DataFrame, labels: DataFrame, dims: int, n_subjects: int) -> np.ndarray:
    """By dimension and subject, how the labelled documents of one subject share a term, all subjects weighing alike."""
    sample = labels.orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED) if labels.count() > MAX_LABELLED else labels
    one = sample.groupBy("doc_id").agg(F.min("subject").alias("subject"), F.count("*").alias("k")).filter("k = 1").drop("k")
    held = vectors.join(one, "doc_id").select(F.explode(F.concat("terms", F.array(F.lit(-1)))).alias("dim"), "subject").groupBy("dim", "subject").agg(F.count("*").alias("n"))
    t = held.toPandas()  # dimensions by subjects
    n = np.zeros((dims + 1, n_subjects))
    n[t.dim.to_numpy(np.int64), t.subject.to_numpy(np.int64)] = t.n.to_numpy()
    docs, n = n[-1], n[:-1]
    rate = np.where(docs > 0, (n + LABEL_PRIOR / max(n_subjects, 1)) / np.maximum(docs + LABEL_PRIOR, 1e-12), 0)
    return rate / np.maximum(rate.sum(1, keepdims=True), 1e-12)


def subjects_of(docs: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """(doc_id, subject, share). docs: doc_id, text; labels: doc_id, subject; subjects: subject, a closed list."""
    names = sorted(r.subject for r in subjects.select("subject").dropna().distinct().toLocalIterator())
    if not names:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, subject string, share double")
    number = F.array_position(F.array(*(F.lit(x) for x in names)), F.col("subject")) - 1
    labels = labels.dropna().distinct().select("doc_id", number.alias("subject")).filter("subject >= 0")
    docs = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    terms = cut(docs.mapInArrow(_count_terms, "doc_id bigint, terms array<bigint>, counts array<int>"))

    n = terms.count()
    held = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    # At most a document's terms over LEAST_RATE, whatever the number of documents.
    v = held.filter(F.col("n").between(max(LEAST_DOCS, LEAST_RATE * n), MOST_RATE * n)).orderBy("term").toPandas()
    vocabulary, weight = Terms(v.term.to_numpy(np.int64)), np.log(n / np.maximum(v.n.to_numpy(float), 1))
    vectors = cut(terms.mapInArrow(_vectors(vocabulary), "doc_id bigint, terms array<int>, counts array<int>"))
    tree, leaves = bisect(vectors, weight)
    name = leaf_names(leaves, shared_by_labels(vectors, labels, len(vocabulary), len(names)))

    groups = Groups(vocabulary, tree, name, len(names))
    known = topical(terms, groups)
    for _ in range(ROUNDS):
        groups.known = known[:2]
        known = topical(terms, groups)
    return terms.mapInArrow(_assign(known[0], *known[2:], names), "doc_id bigint, subject string, share double")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p9_found: doc_id, subject."""
    got = subjects_of(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "subject_labels"), load(spark, sf_dir, "subjects"))
    return got.select("doc_id", "subject").distinct()


def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each subject."""
    return found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n_docs"))
