"""Filling containers of fixed capacity: Martello-Toth dominance reduction on the sizes' histogram, then best fit.

Items of one size are alike, so the packing is found on the number of items of each size, which is bounded by the capacity
and not by the documents. Reduction: from the largest size down, a set of one, two or three items that provably dominates all
other sets with its largest item is fixed for good, for as many items at once as there are, until no size can be reduced; what
is left is packed by best fit, item by item in decreasing order and container by container, whichever takes fewer containers,
again in groups of like containers. Then every item takes the place of its rank among items of its size; ranks are counted by
size and hash bucket, so that no task holds all items of a size.

A document beyond the capacity is cut into full containers and a rest, which is an item; no other is cut. Documents
without tokens, and null texts, take no room: they are placed in container 0. Repeated documents (same id and text) are
packed once; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlattice.tables import cut, load

CAPACITY = 8192
BUCKET_ITEMS = 50_000  #: items of one size and bucket that one task ranks, at most about
#: Places are looked up from a table of runs; one of more than so many bytes is joined instead of sent with the task.
BROADCAST_BYTES = 32_000_000


def tokenizer_path() -> str:
    """The default vocabulary: of the installed public tokenizers, where AIRLATTICE_TOKENIZER names no other file."""
    if named := os.environ.get("AIRLATTICE_TOKENIZER"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_tokenizer(path: str):
    with open(path, "rb") as f:
        return tokenizer_of(f.read())


def tokenizer_of(vocabulary: bytes):
    import tiktoken

    # Fixed value: the pattern by which this public vocabulary parts text before merging.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in vocabulary.splitlines())}
    return tiktoken.Encoding("sizes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _sizes(vocabulary: bytes):
    """Batches of (doc, text) to (doc, tokens). The vocabulary goes along: executors need not have the file."""

    def run(batches: Iterable[pa.RecordBatch]):
        encode = tokenizer_of(vocabulary).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(encode(t)) if t else 0 for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "tokens"])

    return run


@dataclass
class Containers:
    """Groups of like containers: items of each size in one of them, how many there are, what room is left."""

    capacity: int
    groups: list[tuple[dict[int, int], int, int]] = field(default_factory=list)

    def add(self, content: dict[int, int], times: int) -> None:
        if times:
            self.groups.append((content, times, self.capacity - sum(s * n for s, n in content.items())))

    @property
    def count(self) -> int:
        return sum(t for _, t, _ in self.groups)


def _content(*sizes: int) -> dict[int, int]:
    out: dict[int, int] = {}
    for s in sizes:
        out[s] = out.get(s, 0) + 1
    return out


class _Left:
    """The sizes that have items left, with their numbers, as an ordered set over 1..capacity."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.n = np.zeros(capacity + 2, np.int64)
        for s, k in histogram.items():
            self.n[s] = k
        self.sizes = np.flatnonzero(self.n).tolist()

    def take(self, size: int, k: int) -> None:
        if not k:
            return
        if not self.n[size]:  # items are put back where k is negative
            bisect.insort(self.sizes, size)
        self.n[size] -= k
        if not self.n[size]:
            self.sizes.pop(bisect.bisect_left(self.sizes, size))

    def at_most(self, size: int) -> int | None:
        """The largest size left that is not above `size`."""
        i = bisect.bisect_right(self.sizes, size)
        return self.sizes[i - 1] if i else None

    def smallest(self, k: int, above: int = 0) -> list[int]:
        """The k smallest items left that are larger than `above`; fewer if there are no more."""
        out: list[int] = []
        for i in range(bisect.bisect_right(self.sizes, above), len(self.sizes)):
            out += [self.sizes[i]] * min(k - len(out), int(self.n[self.sizes[i]]))
            if len(out) == k:
                break
        return out

    def fits(self, k: int, room: int, above: int = 0) -> bool:
        """Whether any k items larger than `above` fit the room together."""
        least = self.smallest(k, above)
        return len(least) == k and sum(least) <= room


def best_pair(left: _Left, room: int) -> int:
    """The largest sum, within room, of two items left; 0 if none fit."""
    sizes, i, best = left.sizes, 0, 0
    j = bisect.bisect_right(sizes, room) - 1
    while i <= j:
        total = sizes[i] + sizes[j]
        if total <= room and (i < j or left.n[sizes[i]] > 1):
            best = max(best, total)
        if best == room:
            break
        if total <= room:
            i += 1
        else:
            j -= 1
    return best


def dominant(left: _Left, w: int, room: int) -> tuple[int, ...] | None:
    """The items that a container of w, with so much room, takes in some best packing of all; None where that isn't certain.
    The items left don't count w itself.

    Let k be the largest item that fits. A container of w and others can be changed into one of the set named without need of
    another container, since each other item takes the place of one of the set that is as large:
    nothing fits: w alone. k fills the room, or no two items fit together: w and k; the others, together no more than k, go
    where k was. Two items fit, but no three do: w and k if no two that fit are more than k together; else w, k and b, the
    largest item that fits beside k, if no two items larger than b fit together: of any two that do, one is then no more than
    b and the other no more than k.
    """
    k = left.at_most(room)
    if k is None:
        return (w,)
    if k == room or not left.fits(2, room):
        return (w, k)
    if left.fits(3, room):
        return None
    if best_pair(left, room) <= k:
        return (w, k)
    left.take(k, 1)
    b = left.at_most(room - k)
    left.take(k, -1)
    if b is not None and not left.fits(2, room, above=b):
        return (w, k, b)
    return None


def reduce(histogram: dict[int, int], capacity: int) -> tuple[Containers, dict[int, int]]:
    """(containers fixed by dominance, items left): each size from the largest down, again while any set is fixed. What makes
    a set dominant holds on as items are taken away, so it is fixed as often as its items are there."""
    left, fixed = _Left(histogram, capacity), Containers(capacity)
    again = True
    while again:
        again = False
        w = left.sizes[-1] if left.sizes else None
        while w is not None:
            left.take(w, 1)
            content = dominant(left, w, capacity - w)
            left.take(w, -1)
            if content is None:
                w = left.at_most(w - 1)
                continue
            each = _content(*content)
            times = min(int(left.n[s]) // k for s, k in each.items())
            for s, k in each.items():
                left.take(s, k * times)
            fixed.add(each, times)
            again = True
            w = left.at_most(w)
    return fixed, {s: int(left.n[s]) for s in left.sizes}


def best_fit(histogram: dict[int, int], capacity: int, into: Containers) -> None:
    """Best fit decreasing of all items, in bulk: each size goes to the fullest containers that can take it, as many
    items to each as fit, before new ones are begun."""
    rooms: list[int] = []  # the rooms that open containers have, sorted
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}

    def put(content: dict[int, int], times: int, room: int) -> None:
        if times:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append((content, times))

    for s in sorted(histogram, reverse=True):
        n = histogram[s]
        while n:
            i = bisect.bisect_left(rooms, s)
            if i == len(rooms):
                each = capacity // s
                whole, rest = divmod(n, each)
                put({s: each}, whole, capacity - each * s)
                if rest:
                    put({s: rest}, 1, capacity - rest * s)
                break
            room = rooms[i]
            content, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            each = room // s
            m = min(times, n // each)
            put(content, times - m - (1 if m < times and n - m * each > 0 else 0), room)
            put(content | {s: content.get(s, 0) + each}, m, room - each * s)
            n -= m * each
            if m < times and n:  # fewer items than one container takes: all in one
                put(content | {s: content.get(s, 0) + n}, 1, room - n * s)
                n = 0
    for room in rooms:
        for content, times in open_[room]:
            into.add(content, times)


def best_fit_by_container(histogram: dict[int, int], capacity: int, into: Containers) -> None:
    """Best fit of one container after another: its largest item, then again and again the like items that leave the least
    room together, larger ones on ties; as often in a row as there are items for it."""
    n = np.zeros(capacity + 1, np.int64)
    for s, k in histogram.items():
        n[s] = k
    top = capacity
    while True:
        while top and not n[top]:
            top -= 1
        if not top:
            return
        content, room = {top: 1}, capacity - top
        n[top] -= 1
        while room:
            sizes = np.flatnonzero(n[: room + 1])
            if not len(sizes):
                break
            each = np.minimum(n[sizes], room // sizes)
            rest = room - each * sizes
            i = len(sizes) - 1 - int(rest[::-1].argmin())
            s, k = int(sizes[i]), int(each[i])
            content[s] = content.get(s, 0) + k
            n[s] -= k
            room = int(rest[i])
        times = 1 + min(int(n[s]) // k for s, k in content.items())
        for s, k in content.items():
            n[s] -= k * (times - 1)
        into.add(content, times)


def pack_histogram(histogram: dict[int, int], capacity: int) -> Containers:
    """Containers for the given number of items of each size, 1 to capacity."""
    packed, rest = reduce({s: n for s, n in histogram.items() if n}, capacity)
    ways = [Containers(capacity), Containers(capacity)]
    best_fit(rest, capacity, ways[0])
    best_fit_by_container(rest, capacity, ways[1])
    packed.groups += min(ways, key=lambda c: c.count).groups
    return packed


def places(packed: Containers, first: int = 0) -> np.ndarray:
    """Rows (size, first rank, number of ranks, first container, items of the size in each): runs of places by size."""
    rows, used, at = [], {}, first
    for content, times, _ in packed.groups:
        for s, k in content.items():
            rows.append((s, used.get(s, 0), k * times, at, k))
            used[s] = used.get(s, 0) + k * times
        at += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(runs: np.ndarray):
    """Batches of (doc_id, piece, token_start, tokens, rank) to the container of each; rows before are full ones."""
    key = runs[:, 0] * (1 << 40) + runs[:, 1]

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            size, rank = b.column("tokens").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, size * (1 << 40) + rank, "right") - 1
            container = runs[i, 3] + (rank - runs[i, 1]) // runs[i, 4] if len(runs) else np.zeros(len(size), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "token_start", "tokens")), pa.array(container, pa.int64())], names=["doc_id", "piece", "token_start", "n_tokens", "container_id"])

    return run


_OUT = "doc_id bigint, piece bigint, token_start bigint, n_tokens bigint, container_id bigint"


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, container_id) of docs: doc_id, text. tokenizer: a file of token ranks."""
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path()
    with open(path, "rb") as f:
        vocabulary = f.read()
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text")
    sized = docs.mapInArrow(_sizes(vocabulary), "doc_id bigint, tokens bigint")
    sized = cut(sized.groupBy("doc_id").agg(F.max("tokens").alias("tokens")))

    whole = F.expr(f"tokens div {capacity}")
    counts = sized.select(F.expr(f"tokens % {capacity}").alias("rest"), whole.alias("full")).groupBy("rest").agg(F.count("*").alias("n"), F.sum("full").alias("full")).toPandas()
    histogram = {int(r): int(n) for r, n in zip(counts.rest, counts.n, strict=True) if r}
    n_full = int(counts.full.sum()) if len(counts) else 0
    runs = places(pack_histogram(histogram, capacity))
    n_mixed = int((runs[:, 3] + -(-runs[:, 2] // runs[:, 4])).max()) if len(runs) else 0

    # Pieces of documents beyond the capacity fill containers of their own, numbered after the mixed ones.
    item = F.struct(whole.alias("piece"), (whole * capacity).alias("token_start"), F.expr(f"tokens % {capacity}").alias("tokens"))
    items = sized.filter(f"tokens % {capacity} > 0 or tokens = 0").select("doc_id", item.alias("i")).select("doc_id", "i.*")
    full = sized.filter(whole > 0).select("doc_id", F.posexplode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("_", "piece"))
    full = full.select("doc_id", "piece", (F.col("piece") * capacity).alias("token_start"), F.lit(capacity).cast("bigint").alias("tokens"))

    most = max([*histogram.values(), n_full, 1])
    buckets = -(-most // BUCKET_ITEMS)

    def ranked(rows: DataFrame) -> DataFrame:
        """Rank among rows of the same tokens: by hash bucket, then document and piece; counted before in each bucket."""
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
        per = rows.groupBy("tokens", "bucket").agg(F.count("*").alias("n"))  # at most `buckets` rows a size
        before = per.select("tokens", "bucket", (F.sum("n").over(Window.partitionBy("tokens").orderBy("bucket")) - F.col("n")).alias("before"))
        own = F.row_number().over(Window.partitionBy("tokens", "bucket").orderBy("doc_id", "piece")) - 1
        return rows.withColumn("own", own).join(before, ["tokens", "bucket"]).select("doc_id", "piece", "token_start", "tokens", (F.col("own") + F.col("before")).cast("bigint").alias("rank"))

    mixed = ranked(items.filter("tokens > 0"))
    if runs.nbytes <= BROADCAST_BYTES:
        mixed = mixed.mapInArrow(_place(runs), _OUT)
    else:
        import pandas as pd

        table = spark.createDataFrame(pd.DataFrame(runs, columns=["tokens", "r0", "len", "c0", "each"]))
        mixed = mixed.join(table, (mixed.tokens == table.tokens) & (mixed["rank"] >= table.r0) & (mixed["rank"] < table.r0 + table["len"])).select(
            "doc_id", "piece", "token_start", mixed.tokens.alias("n_tokens"), (table.c0 + F.expr("(rank - r0) div each")).alias("container_id")
        )
    full = ranked(full).select("doc_id", "piece", "token_start", F.col("tokens").alias("n_tokens"), (F.col("rank") + n_mixed).alias("container_id"))
    none = items.filter("tokens = 0").select("doc_id", "piece", "token_start", F.col("tokens").alias("n_tokens"), F.lit(0).cast("bigint").alias("container_id"))
    return mixed.unionByName(full).unionByName(none)


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents").select("doc_id", "text"))


def conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document, whether its pieces are all there once, in a row from its start, and only its last is no full
    container; and whether any of its containers holds more than the capacity."""
    got = cut(containers(spark, sf_dir))
    used = got.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))  # a container's rows are at most its tokens
    over = used.filter(F.col("used") > CAPACITY).select("container_id", F.lit(True).alias("over"))
    per = got.join(over, "container_id", "left").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("piece").alias("pieces"), F.min("token_start").alias("first"), F.max("token_start").alias("last"),
        F.count_if(F.col("n_tokens") == CAPACITY).alias("full"), F.bool_or(F.coalesce("over", F.lit(False))).alias("over"),
    )
    whole = (F.col("n") == F.col("pieces")) & (F.col("first") == 0) & (F.col("last") == (F.col("n") - 1) * CAPACITY) & (F.col("full") >= F.col("n") - 1)
    return per.select("doc_id", whole.alias("whole"), (~F.col("over")).alias("within"))


def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: their number by tenths of the capacity that stay empty."""
    per = containers(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return per.groupBy(F.expr(f"(({CAPACITY} - used) * 10) div {CAPACITY}").alias("empty_tenths")).agg(F.count("*").alias("n_containers"), F.sum("used").alias("n_tokens"))
