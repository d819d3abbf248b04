"""Points near other points: sample-driven quadtree partitions, replication at their edges, an R-tree in each, exact
great-circle refinement, and the reference point rule against pairs found twice.

A point stands for the box of all positions within half the radius; boxes of points within the radius meet. A box goes to
every quadtree leaf it meets, and a pair counts only in the leaf that holds the lower left corner of its boxes' overlap.
The sample shapes the leaves and nothing else: every point is placed. A leaf that stays too full, as where many points share
a position, is shared out by salting the probing side.

Null, NaN and out-of-range latitudes give no pairs; longitudes may run past 180 and wrap around; the poles are covered.
A repeated row is one; points at one position are near each other; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlattice.tables import cut, load, norm_id, topology_runs

EARTH_KM = 6371.0088
LEAF_ROWS = 4_000  #: points that one leaf should hold, about
SAMPLE_ROWS = 40_000  #: bound on the points sampled to shape the quadtree
FANOUT = 16


def half_boxes(lat: np.ndarray, lon: np.ndarray, km: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(west, south, east, north) in degrees around each point, half a radius wide on each side; longitudes in -180..180
    before widening. Near a pole the box is the whole ring."""
    r = km / EARTH_KM * (1 + 1e-9) + 1e-12
    lon = (lon + 180.0) % 360.0 - 180.0
    dlat = np.degrees(r) / 2
    c = np.cos(np.radians(np.minimum(np.abs(lat) + np.degrees(r), 90.0)))
    ring = np.sin(r) >= c
    dlon = np.where(ring, 180.0, np.degrees(np.arcsin(np.sin(r) / np.where(ring, 1.0, c)))) / 2
    # Half a ring on each side would not meet the half ring of the opposite point: take all of it.
    dlon = np.where(ring, 180.0, dlon + 1e-10)
    west = np.where(ring, -180.0, lon - dlon)
    return west, lat - dlat - 1e-10, np.where(ring, 180.0, lon + dlon), lat + dlat + 1e-10


def great_circle_km(lat1, lon1, lat2, lon2):
    """Haversine distance of positions in degrees."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(a)))


class QuadTree:
    """Leaves over longitude -180..180 and latitude -90..90, split where the sample is dense."""

    def __init__(self, x: np.ndarray, y: np.ndarray, leaf: float, least_degrees: float):
        self.box, self.child, self.weight = [(-180.0, -90.0, 180.0, 90.0)], [-1], [len(x)]
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, inside = stack.pop()
            w, s, e, n = self.box[node]
            if len(inside) <= leaf or min(e - w, n - s) / 2 < least_degrees:
                continue
            mx, my = (w + e) / 2, (s + n) / 2
            self.child[node] = len(self.box)
            which = (x[inside] >= mx) + 2 * (y[inside] >= my)
            for q in range(4):
                self.box.append((mx if q % 2 else w, my if q > 1 else s, e if q % 2 else mx, n if q > 1 else my))
                self.child.append(-1)
                self.weight.append(int((which == q).sum()))
                stack.append((len(self.box) - 1, inside[which == q]))
        self.box, self.child, self.weight = np.array(self.box), np.array(self.child), np.array(self.weight)

    def meet(self, west, south, east, north) -> tuple[np.ndarray, np.ndarray]:
        """(box, leaf) pairs of the boxes that meet a leaf; a leaf holds its west and south edges only."""
        item, node = np.arange(len(west)), np.zeros(len(west), np.int64)
        items, leaves = [], []
        while len(item):
            b = self.box[node]
            ok = (west[item] < b[:, 2]) & (east[item] >= b[:, 0]) & ((south[item] < b[:, 3]) | (b[:, 3] == 90)) & (north[item] >= b[:, 1])
            item, node = item[ok], node[ok]
            at_leaf = self.child[node] < 0
            items.append(item[at_leaf])
            leaves.append(node[at_leaf])
            item, node = np.repeat(item[~at_leaf], 4), (self.child[node[~at_leaf]][:, None] + np.arange(4)).ravel()
        return np.concatenate(items) if items else item, np.concatenate(leaves) if leaves else node


class RTree:
    """Sort-tile-recursive bulk load; probing goes down a level at a time for all boxes together."""

    def __init__(self, boxes: np.ndarray):
        n = len(boxes)
        cx, cy = boxes[:, 0] + boxes[:, 2], boxes[:, 1] + boxes[:, 3]
        slices = max(1, int(np.ceil(np.sqrt(n / FANOUT))))
        strip = np.empty(n, np.int64)
        strip[np.argsort(cx, kind="stable")] = np.arange(n) * slices // max(n, 1)
        self.order = np.lexsort((cy, strip))
        self.levels = [boxes[self.order]]
        while len(self.levels[-1]) > FANOUT:
            b = self.levels[-1]
            starts = np.arange(0, len(b), FANOUT)
            self.levels.append(np.stack([f.reduceat(b[:, i], starts) for i, f in enumerate((np.minimum, np.minimum, np.maximum, np.maximum))], 1))

    def probe(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, item) of every probe box that meets an item's box."""
        top = len(self.levels[-1])
        q, node = np.repeat(np.arange(len(boxes)), top), np.tile(np.arange(top), len(boxes))
        for depth in range(len(self.levels) - 1, -1, -1):
            b, p = self.levels[depth][node], boxes[q]
            ok = (p[:, 0] <= b[:, 2]) & (p[:, 2] >= b[:, 0]) & (p[:, 1] <= b[:, 3]) & (p[:, 3] >= b[:, 1])
            q, node = q[ok], node[ok]
            if depth:
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q = np.repeat(q, FANOUT)
                inside = node < len(self.levels[depth - 1])
                q, node = q[inside], node[inside]
        return q, self.order[node]


def _place(tree: QuadTree, salts: np.ndarray, km: float):
    """Batches of (grp, probes, id, lat, lon) to rows in leaves, with shifted copies for boxes past 180. A crowded leaf's points
    are parted into k blocks by their ids; its tasks are the k x k pairs of a probing and an indexed block, so none holds more
    than two blocks, however many points the leaf has."""

    def run(batches):
        for b in batches:
            grp, probes, ids = b.column("grp"), b.column("probes").to_numpy(zero_copy_only=False), b.column("id")
            lat, lon = (b.column(c).to_numpy(zero_copy_only=False) for c in ("lat", "lon"))
            w, s, e, n = half_boxes(lat, lon, km)
            item = np.arange(len(lat))
            past_e, past_w = e > 180, w < -180
            item = np.concatenate([item, item[past_e], item[past_w]])
            shift = np.concatenate([np.zeros(len(lat)), np.full(past_e.sum(), -360.0), np.full(past_w.sum(), 360.0)])
            w, s, e, n = w[item] + shift, s[item], e[item] + shift, n[item]
            at, leaf = tree.meet(w, s, e, n)
            k = salts[leaf]
            # A row of block b: in the tasks (b, j) it probes, in the tasks (i, b) it is indexed, in (b, b) both.
            block = (pd.util.hash_array(np.asarray(ids.to_pandas(), dtype=object)).astype(np.uint64)[item[at]] % k.astype(np.uint64)).astype(np.int64)
            copies = 2 * k - 1
            rep = np.repeat(np.arange(len(at)), copies)
            c = np.arange(len(rep)) - np.repeat(np.cumsum(copies) - copies, copies)
            at, leaf, k, block = at[rep], leaf[rep], k[rep], block[rep]
            row, other = c < k, c - k
            i, j = np.where(row, block, other + (other >= block)), np.where(row, c, block)
            own, salt, indexed = item[at], i * k + j, ~row | (c == block)
            keep = indexed | probes[own]
            at, leaf, own, salt, indexed, row = (x[keep] for x in (at, leaf, own, salt, indexed, row))
            yield pa.RecordBatch.from_arrays(
                [grp.take(pa.array(own)), pa.array(leaf), pa.array(salt), pa.array(probes[own] & row), pa.array(indexed), pa.array(probes[own]), ids.take(pa.array(own)),
                 *(pa.array(x[own]) for x in (lat, lon)), *(pa.array(x[at]) for x in (w, s, e, n))],
                names=["grp", "leaf", "salt", "probing", "indexed", "is_node", "id", "lat", "lon", "w", "s", "e", "n"],
            )

    return run


_PLACED = "grp string, leaf bigint, salt bigint, probing boolean, indexed boolean, is_node boolean, id string, lat double, lon double, w double, s double, e double, n double"


def _pairs_in_leaf(tree: QuadTree, km: float):
    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        boxes = t[["w", "s", "e", "n"]].to_numpy()
        probing = np.flatnonzero(t.probing.to_numpy())
        held = np.flatnonzero(t.indexed.to_numpy())
        rt, leaf = RTree(boxes[held]), tree.box[key[1]]
        ids, node = t.id.to_numpy(object), t.is_node.to_numpy()
        lat, lon = t.lat.to_numpy(), t.lon.to_numpy()
        out = []
        for start in range(0, len(probing), 2048):
            chunk = probing[start : start + 2048]
            q, i = rt.probe(boxes[chunk])
            q, i = chunk[q], held[i]
            x, y = np.maximum(boxes[q, 0], boxes[i, 0]), np.maximum(boxes[q, 1], boxes[i, 1])
            here = (x >= leaf[0]) & (x < leaf[2]) & (y >= leaf[1]) & ((y < leaf[3]) | (leaf[3] == 90))
            here |= ((x < -180) & (leaf[0] == -180) | (y < -90) & (leaf[1] == -90)) & (x < leaf[2]) & (y < leaf[3]) & (x >= -180)
            q, i = q[here], i[here]
            ok = great_circle_km(lat[q], lon[q], lat[i], lon[i]) <= km
            q, i = q[ok], i[ok]
            ok = ~node[i] | (ids[q] < ids[i])
            q, i = q[ok], i[ok]
            out.append((np.where(node[i], "node", "cell").astype(object), ids[q], ids[i]))
        kind, a, b = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, object),) * 3
        return pd.DataFrame({"grp": np.full(len(kind), key[0], object), "near_kind": kind, "key_a": a, "key_b": b})

    return run


def near_pairs(points: DataFrame, km: float, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(grp, near_kind, key_a, key_b), distinct: every two points of a group within km of which the first probes.

    points: grp, probes (boolean), id, lat, lon. Two probing points give a `node` pair, smaller id first; a probing and
    another point a `cell` pair. Both distances and boxes use lat and lon as they are.
    """
    points = points.filter("grp is not null and id is not null and abs(lat) <= 90 and abs(lon) <= 1e6").select("grp", "probes", "id", F.col("lat").cast("double"), F.col("lon").cast("double"))
    points = cut(points)
    total = points.count()
    share = min(1.0, SAMPLE_ROWS / 2 / max(total, 1))
    sample = (points if share == 1.0 else points.sample(share, seed=7)).select("lat", "lon").limit(SAMPLE_ROWS).toPandas()
    x, y = (sample.lon.to_numpy(float) + 180) % 360 - 180, sample.lat.to_numpy(float)
    tree = QuadTree(x, y, max(1.0, leaf_rows * share), 4 * np.degrees(km / EARTH_KM))
    salts = np.maximum(1, np.ceil(tree.weight / share / (4 * leaf_rows))).astype(np.int64)
    placed = points.mapInArrow(_place(tree, salts, km), _PLACED)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("grp", "near_kind", "key_a", "key_b")])
    return placed.groupBy("grp", "leaf", "salt").applyInPandas(_pairs_in_leaf(tree, km), schema).distinct()


def mesh_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of each endpoint's last complete topology run, which probe, and the endpoint's coverage cells."""
    runs = topology_runs(spark, sf_dir)
    last = runs.groupBy("endpoint").agg(F.max_by("run_id", F.struct("at_ms", "run_id")).alias("run_id"))
    counts = (F.col("lat").between(-90, 90)) & F.col("lon").between(-180, 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    nodes = load(spark, sf_dir, "nodes_snapshot").select("run_id", "pubkey", "lat", "lon").filter(counts).join(last, "run_id")
    nodes = nodes.select(F.col("endpoint").alias("grp"), F.lit(True).alias("probes"), norm_id("pubkey").alias("id"), "lat", "lon")
    cells = load(spark, sf_dir, "coverage").select(
        F.col("endpoint").alias("grp"), F.lit(False).alias("probes"), F.concat_ws("/", "job_id", F.col("index").cast("string")).alias("id"),
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
    )
    return nodes.unionByName(cells).distinct()


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found: near_kind, key_a, key_b of positions at most 0.2 km apart."""
    return near_pairs(mesh_points(spark, sf_dir), 0.2).select("near_kind", "key_a", "key_b").distinct()
