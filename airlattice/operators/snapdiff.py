"""What changed between consecutive full snapshots, by invertible Bloom lookup tables.

Each snapshot's (key, value digest) elements are summed into small tables, one per hash bucket of the key. Tables of
consecutive snapshots are subtracted; equal elements cancel, and what is left is peeled into the differing key hashes. A
bucket that doesn't peel to nothing is made again with an enlarged table; one that fails that as well is compared row by
row, so the result is exact. Only the keys found are read again and classified by their values.

A repeated row is one record; of two rows of one key with different values the least counts, nulls first. Null keys and
rows of runs that aren't complete are left out; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlattice.tables import cut, load, norm_id, topology_runs

#: Positions count as changed beyond this many degrees.
TOLERANCE = 0.00002
#: Side of the cells that the digest sees: below the tolerance, so whatever moved further than that is in another cell.
DIGEST_CELL = 0.000019
BUCKET_KEYS = 512  #: expected keys of a snapshot in one bucket
THIRD = 64  #: cells in each of a table's three parts
GROW = 8  #: factor by which a failed bucket's table is enlarged
HASHES = 3


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """XXH64 of one 64-bit integer with seed h, as the engine's xxhash64 chains it over columns."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda v, r: (v << np.uint64(r)) | (v >> np.uint64(64 - r))
    h = h + p5 + np.uint64(8)
    h = rot(h ^ (rot(x * p2, 31) * p1), 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def element_hash(key: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """The engine's xxhash64(key, digest), for arrays."""
    with np.errstate(over="ignore"):
        return _mix(_mix(np.full(len(key), 42, np.uint64), key.view(np.uint64)), digest.view(np.uint64))


def positions(element: np.ndarray, third: int) -> np.ndarray:
    """The element's three cells, one in each part of the table."""
    mask = np.uint64((1 << 21) - 1)
    return np.stack([((element >> np.uint64(21 * j)) & mask) % np.uint64(third) + np.uint64(j * third) for j in range(HASHES)], 1).astype(np.int64)


def peel(cell: np.ndarray, count: np.ndarray, keys: np.ndarray, digests: np.ndarray, checks: np.ndarray, third: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(key hashes, signs, whether the table came out empty) of a subtracted table given by its cells that aren't zero."""
    n = np.zeros(third * HASHES, np.int64)
    k, d, c = (np.zeros(third * HASHES, np.int64) for _ in range(3))
    n[cell], k[cell], d[cell], c[cell] = count, keys, digests, checks
    out_k, out_s = [], []
    while True:
        e = element_hash(k, d)
        pure = np.flatnonzero((np.abs(n) == 1) & (e.view(np.int64) == c))
        if not len(pure):
            break
        # Of an element that is pure in several cells only one is taken.
        _, first = np.unique(c[pure], return_index=True)
        pure = pure[first]
        pk, pd_, pc, ps = k[pure].copy(), d[pure].copy(), c[pure].copy(), n[pure].copy()
        for j in range(HASHES):
            at = positions(pc.view(np.uint64), third)[:, j]
            np.subtract.at(n, at, ps)
            np.bitwise_xor.at(k, at, pk)
            np.bitwise_xor.at(d, at, pd_)
            np.bitwise_xor.at(c, at, pc)
        out_k.append(pk)
        out_s.append(ps)
        if sum(map(len, out_k)) > 2 * len(n):  # a table can't hold as many: a false pure cell
            return np.empty(0, np.int64), np.empty(0, np.int64), False
    done = not (n.any() or k.any() or d.any() or c.any())
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return cat(out_k), cat(out_s), done


BLOCK_BUCKETS = 32  #: buckets that one group makes the tables of


def _peeled(signed: DataFrame, third: int) -> DataFrame:
    """(pair, bucket, k): the differing key hashes; for a bucket that failed one row without k. signed: pair, bucket, k, d, sign,
    the elements of a pair's two snapshots. They are shuffled once, as they are; a group builds the tables of both snapshots
    of BLOCK_BUCKETS buckets, already subtracted, in arrays."""
    size = third * HASHES

    def block(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        bucket, at = np.unique(t.bucket.to_numpy(), return_inverse=True)
        k, d, sign = t.k.to_numpy(np.int64), t.d.to_numpy(np.int64), t.sign.to_numpy(np.int64)
        e = element_hash(k, d)
        n, keys, digests, checks = (np.zeros(len(bucket) * size, np.int64) for _ in range(4))
        cells = positions(e, third) + (at * size)[:, None]
        for cell in cells.T:
            np.add.at(n, cell, sign)
            for table, value in ((keys, k), (digests, d), (checks, e.view(np.int64))):
                np.bitwise_xor.at(table, cell, value)
        out = []
        for i, b in enumerate(bucket):
            part = slice(i * size, (i + 1) * size)
            cell = np.flatnonzero((n[part] != 0) | (keys[part] != 0) | (digests[part] != 0) | (checks[part] != 0))
            if len(cell):
                found, _, done = peel(cell, n[part][cell], keys[part][cell], digests[part][cell], checks[part][cell], third)
                out.append(pd.DataFrame({"pair": key[0], "bucket": b, "k": pd.array(np.unique(found) if done else [None], dtype="Int64")}))
        return pd.concat(out) if out else pd.DataFrame({"pair": [], "bucket": [], "k": []})

    blocks = signed.withColumn("blk", F.call_function("div", F.col("bucket"), F.lit(BLOCK_BUCKETS).cast("bigint")))
    return blocks.groupBy("pair", "blk").applyInPandas(block, "pair bigint, bucket bigint, k bigint")


def differing_keys(elements: DataFrame, pairs: DataFrame, third: int = THIRD) -> DataFrame:
    """(pair, k): the key hashes whose element differs between a pair's two snapshots; a superset only in failed buckets.

    elements: run_id, bucket, k, d; pairs: pair, run_id, sign (+1 later, -1 earlier).
    """
    signed = elements.select("run_id", "bucket", "k", "d").join(pairs, "run_id").select("pair", "bucket", "k", "d", "sign")
    first = cut(_peeled(signed, third))
    failed = first.filter("k is null").select("pair", "bucket")
    again = signed.join(failed, ["pair", "bucket"], "left_semi")
    second = cut(_peeled(again, third * GROW))
    rest = signed.join(second.filter("k is null").select("pair", "bucket"), ["pair", "bucket"], "left_semi").select("pair", "k")
    return first.unionByName(second).filter("k is not null").select("pair", "k").unionByName(rest).distinct()


def changes(records: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id of the later run, pubkey, change_kind). records: run_id, pubkey, lat, lon, one row a key; runs: run_id,
    endpoint, at_ms."""
    order = Window.partitionBy("endpoint").orderBy("at_ms", "run_id")
    steps = runs.select("run_id", F.lag("run_id").over(order).alias("earlier")).filter("earlier is not null")
    pairs = steps.select(F.col("run_id").alias("pair"), F.explode(F.array(
        F.struct("run_id", F.lit(1).alias("sign")), F.struct(F.col("earlier").alias("run_id"), F.lit(-1).alias("sign"))
    )).alias("x")).select("pair", "x.run_id", "x.sign")
    most = records.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-most // BUCKET_KEYS))
    in_cell = lambda c: F.when(F.isnan(c), F.lit(-(2**62))).otherwise(F.floor(F.col(c) / DIGEST_CELL))
    elements = (
        records.select("run_id", F.xxhash64("pubkey").alias("k"), F.xxhash64(in_cell("lat"), in_cell("lon"), F.col("lat").isNull(), F.col("lon").isNull()).alias("d"))
        .select("*", F.pmod(F.xxhash64("k"), F.lit(buckets)).alias("bucket"))
    )
    keys = differing_keys(elements, pairs).join(pairs, "pair").select("pair", "run_id", "sign", "k")
    rows = records.withColumn("k", F.xxhash64("pubkey")).join(keys, ["run_id", "k"])
    side = lambda sign: F.max(F.when(F.col("sign") == sign, F.struct("lat", "lon")))
    both = rows.groupBy("pair", "pubkey").agg(side(1).alias("new"), side(-1).alias("old"))
    apart = lambda c: (F.col(f"new.{c}").isNull() != F.col(f"old.{c}").isNull()) | F.coalesce(F.abs(F.col(f"new.{c}") - F.col(f"old.{c}")) > TOLERANCE, F.lit(False))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(apart("lat") | apart("lon"), "changed")
    return both.select(F.col("pair").alias("run_id"), "pubkey", kind.alias("change_kind")).filter("change_kind is not null")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p4_found: run_id, pubkey, change_kind."""
    runs = cut(topology_runs(spark, sf_dir))
    nodes = load(spark, sf_dir, "nodes_snapshot").select("run_id", norm_id("pubkey").alias("pubkey"), "lat", "lon").filter("pubkey is not null")
    nodes = nodes.join(runs.select("run_id"), "run_id", "left_semi")
    records = nodes.groupBy("run_id", "pubkey").agg(F.min(F.struct("lat", "lon")).alias("p")).select("run_id", "pubkey", "p.lat", "p.lon")
    return changes(cut(records), runs)
