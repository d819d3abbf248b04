"""Route search over candidate sites: the graph is small and lives on the driver, its links are evaluated as batches.

Screening pairs each site with its nearest neighbours and every terminal with all sites, keeps those whose optimistic margin
allows a link, evaluates them coarsely, and those that fail once more at the final step. The solver's routes are certified
at the final step until one holds throughout. Where the ends are not joined, the pairs left out so far are screened and
evaluated too, batch by batch, until they are joined or no pair leads out of one end's part. A search that is stopped ends
without a route.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.functions import rf
from airlattice.operators import links
from airlattice.operators.graph import Graph

BRIDGE_BATCH = 2_000  #: pairs of one job where the ends are not joined; there are as many jobs as it takes
# Keys that carry the content of packets.
CONTENT_KEYS = ("raw_hex", "rawhex", "decoded_json", "decodedjson", "message", "messages", "channel_messages")


def scrub(value):
    """JSON without content keys, at any depth."""
    if isinstance(value, dict):
        return {k: scrub(v) for k, v in value.items() if k.lower() not in CONTENT_KEYS}
    return [scrub(v) for v in value] if isinstance(value, list) else value


def canonical_json(value) -> str:
    """keys sorted, no spaces, ASCII only: the text that fingerprints are taken of."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def fingerprint(domain: str, value) -> str:
    """SHA-256 of a domain tag, a zero byte, and the canonical text."""
    return hashlib.sha256(domain.encode() + b"\0" + canonical_json(value).encode()).hexdigest()


def alternative_id(paths: list[list[str]], routers: list[str]) -> str:
    """the first 16 digits of the fingerprint of paths and routers."""
    return fingerprint("alternative", {"paths": paths, "routers": sorted(routers)})[:16]


def merge_settings(base: dict, change: dict, whole: tuple[str, ...] = ("snr_thresholds_db",)) -> dict:
    """Nested settings merged key by key; unknown keys and other types are errors; a key in `whole` is replaced."""
    out = dict(base)
    for k, v in change.items():
        if k not in base:
            raise ValueError(f"unknown setting {k}")
        if isinstance(base[k], dict) and k not in whole:
            if not isinstance(v, dict):
                raise ValueError(f"setting {k} must be an object")
            out[k] = merge_settings(base[k], v, whole)
        elif base[k] is not None and v is not None and isinstance(base[k], bool) != isinstance(v, bool) or isinstance(v, str) != isinstance(base[k], str):
            raise ValueError(f"setting {k} has another type")
        else:
            out[k] = v
    return out


def grid_size(west: float, south: float, east: float, north: float, cell_m: float, limit: int) -> tuple[int, int, float]:
    """(columns, rows, cell size): the cell grows by the root of the excess until the grid is within the limit."""
    while True:
        columns, rows = max(1, -int(-(east - west) // cell_m)), max(1, -int(-(north - south) // cell_m))
        if columns * rows <= limit:
            return columns, rows, cell_m
        cell_m *= (columns * rows / limit) ** 0.5 * 1.001


def grid_cells(spark, west: float, south: float, east: float, north: float, cell_m: float, limit: int = 16_384) -> DataFrame:
    """(index, x, y): cell centres, the first row at the top."""
    columns, rows, cell = grid_size(west, south, east, north, cell_m, limit)
    col, row = F.col("id") % columns, F.floor(F.col("id") / columns)
    return spark.range(columns * rows).select(F.col("id").alias("index"), (F.lit(west) + (col + 0.5) * cell).alias("x"), (F.lit(north) - (row + 0.5) * cell).alias("y"))


@dataclass
class Quality:
    """What a path is worth: links out of sight, links with an obstructed zone, and the least margin."""

    blocked: int
    impeded: int
    margin: float

    def key(self):
        return (self.blocked, self.impeded, -self.margin)


class RouteSearch:
    """sites: id, x, y, h (mast above ground), kind (`client` or `router`), existing. evaluate may be another link model."""

    def __init__(self, spark, sites: list[dict], tiles: DataFrame, radio: rf.Radio, res: float, *, neighbours: int = 16, coarse: float = 200.0, final: float = 50.0,
                 evaluate: Callable[..., DataFrame] = links.evaluate, stopped: Callable[[], bool] = lambda: False):
        self.spark, self.tiles, self.radio, self.res, self.evaluate, self.stopped = spark, tiles, radio, res, evaluate, stopped
        self.sites = {s["id"]: s for s in sorted(sites, key=lambda s: s["id"])}
        if len(self.sites) != len(sites):
            raise ValueError("site ids are not unique")
        self.neighbours, self.coarse, self.final = neighbours, coarse, final
        self.done: dict[tuple[float, str, str], dict | None] = {}
        self.rejected = {"distance": 0, "margin": 0, "terrain": 0}

    def distance(self, a: str, b: str) -> float:
        p, q = self.sites[a], self.sites[b]
        return ((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2) ** 0.5

    def near_pairs(self, terminals: list[str]) -> set[tuple[str, str]]:
        """Nearest neighbours and all pairs with a terminal."""
        pairs = set()
        for a in self.sites:
            near = sorted((self.distance(a, b), b) for b in self.sites if b != a)
            pairs |= {tuple(sorted((a, b))) for d, b in (near if a in terminals else near[: self.neighbours])}
        return pairs

    def screened(self, pairs: set[tuple[str, str]], max_km: float = 50.0) -> set[tuple[str, str]]:
        """The pairs where free space allows a link."""
        import math

        out = set()
        for a, b in pairs:
            d = self.distance(a, b)
            if not 0 < d <= max_km * 1000:
                self.rejected["distance"] += 1
                continue
            fspl = 32.44 + 20 * math.log10(d / 1000) + 20 * math.log10(self.radio.frequency_mhz)
            ant = self.radio.antenna
            if self.radio.tx_power_dbm + 2 * (ant.gain_dbi - ant.feed_loss_db) - fspl - self.radio.sensitivity_dbm - self.radio.fade_margin_db < 0:
                self.rejected["margin"] += 1
                continue
            out.add((a, b))
        return out

    def batch(self, pairs: set[tuple[str, str]], step: float) -> None:
        """Evaluates the pairs that this step hasn't seen, as one job."""
        fresh = sorted(p for p in pairs if (step, *p) not in self.done)
        if not fresh:
            return
        rows = [(f"{a}\t{b}", a, b, *(float(self.sites[s][c]) for s in (a, b) for c in ("x", "y", "h"))) for a, b in fresh]
        df = self.spark.createDataFrame(rows, "link_id string, a string, b string, ax double, ay double, ah double, bx double, by double, bh double")
        got = self.evaluate(df, self.tiles, replace(self.radio, sample_step_m=step), self.res, ends=("router", "router"))
        ratio = F.col("fresnel_ratio") if "fresnel_ratio" in got.columns else F.lit(float("inf"))  # another link model may not know it
        for r in got.select("a", "b", "state", "two_way_db", "valid", "los_clear", "fresnel_clear", ratio.alias("fresnel_ratio")).toLocalIterator():
            ok = r.state is None and r.valid
            self.rejected["terrain"] += not ok
            self.done[step, r.a, r.b] = {"w": r.two_way_db, "clear": bool(r.los_clear and r.fresnel_clear), "los": bool(r.los_clear), "fresnel": r.fresnel_ratio} if ok else None

    def graph(self, pairs: set[tuple[str, str]], steps: tuple[float, ...]) -> Graph:
        best = {p: next((e for s in steps if (e := self.done.get((s, *p)))), None) for p in pairs}
        # A link that the final step has refused is gone, whatever a coarser step said.
        best = {p: e for p, e in best.items() if e and ((steps[0], *p) not in self.done or self.done[steps[0], *p])}
        edges = [(a, b, e["w"]) for (a, b), e in sorted(best.items())]
        facts = {i: {"height": s["h"], "existing": s.get("existing", False), "quality": s.get("quality", 0.0), "client": s.get("kind") == "client"} for i, s in self.sites.items()}
        return Graph(edges, {p: e["clear"] for p, e in best.items()}, facts, {p: e["fresnel"] for p, e in best.items()}, {p: self.distance(*p) for p in best})

    def quality(self, path: list[str]) -> Quality:
        e = [self.done[self.final, *sorted((a, b))] for a, b in zip(path, path[1:])]
        return Quality(sum(not x["los"] for x in e), sum(not x["clear"] for x in e), min(x["w"] for x in e))

    def probe(self, pairs: set[tuple[str, str]]) -> None:
        """Evaluates the pairs coarsely, those that fail at the final step as well."""
        self.batch(pairs, self.coarse)
        self.batch({p for p in pairs if self.done[self.coarse, *p] is None}, self.final)

    def bridges(self, g: Graph, a: str, b: str, tried: set[tuple[str, str]]) -> set[tuple[str, str]]:
        """The next screened pairs, which are added to tried, that lead out of the smaller of the parts reached from
        both ends: into the other part first, then to sites in neither; near ones first. Empty when none are left."""
        here, there = sorted((g.reached(a), g.reached(b)), key=len)
        while True:
            left = ((y not in there, self.distance(x, y), p) for x in here for y in self.sites if y not in here and (p := tuple(sorted((x, y)))) not in tried)
            fresh = {p for *_, p in heapq.nsmallest(BRIDGE_BATCH, left)}
            tried |= fresh
            if (found := self.screened(fresh)) or not fresh:
                return found

    def search(self, a: str, b: str, priority: str = "hops") -> dict:
        """The best certified route, and why there is none where there isn't."""
        tried = self.near_pairs([a, b])
        pairs = self.screened(tried)
        self.probe(pairs)
        find = {
            "hops": lambda g: g.hop_path(a, b), "reliability": lambda g: g.reliability_path(a, b), "installations": lambda g: g.installation_path(a, b),
            "infrastructure": lambda g: g.infrastructure_path(a, b),
        }[priority]
        while not self.stopped():  # each round certifies or adds a pair, of which there are so many
            g = self.graph(pairs, (self.final, self.coarse))
            path = find(g)
            if path is None:
                fresh = self.bridges(g, a, b, tried)
                if not fresh:
                    break
                self.probe(fresh)
                pairs |= fresh
                continue
            wanted = {tuple(sorted(p)) for p in zip(path, path[1:])}
            if all((self.final, *p) in self.done for p in wanted):
                q = self.quality(path)
                backup = g.disjoint_paths(a, b, 2)
                return {"path": path, "quality": q, "id": alternative_id([path], path[1:-1]), "resilient": len(backup) > 1, "distance_m": sum(self.distance(x, y) for x, y in zip(path, path[1:]))}
            self.batch(wanted, self.final)
        return {"path": None, "rejected": dict(self.rejected), "pairs": len(pairs)}

    def reduced_heights(self, path: list[str], heights: list[float]) -> dict[str, float]:
        """Each router's least mast, in turn along the route, that keeps its links valid."""
        out = {}
        for i, name in enumerate(path[1:-1], 1):
            for h in sorted(x for x in heights if x <= self.sites[name]["h"]):
                trial = RouteSearch(self.spark, [{**self.sites[n], "h": h if n == name else out.get(n, self.sites[n]["h"])} for n in (path[i - 1], name, path[i + 1])], self.tiles, self.radio, self.res, evaluate=self.evaluate)
                pairs = {tuple(sorted((path[i - 1], name))), tuple(sorted((name, path[i + 1])))}
                trial.batch(pairs, self.final)
                if all(trial.done[self.final, *p] for p in pairs):
                    out[name] = h
                    break
        return out

    def refined(self, before: str, site: str, after: str, radius: float, spacing: float) -> dict:
        """C14: the place within a disk whose two links have the best worst margin."""
        s, k = self.sites[site], int(radius // spacing)
        places = {f"{site}@{i},{j}": {**s, "id": f"{site}@{i},{j}", "x": s["x"] + i * spacing, "y": s["y"] + j * spacing} for i in range(-k, k + 1) for j in range(-k, k + 1) if (i * i + j * j) * spacing**2 <= radius**2}
        trial = RouteSearch(self.spark, [self.sites[before], self.sites[after], *places.values()], self.tiles, self.radio, self.res, evaluate=self.evaluate)
        trial.batch({tuple(sorted((p, e))) for p in places for e in (before, after)}, self.final)
        score = lambda p: min((trial.done[self.final, *sorted((p, e))] or {"w": float("-inf")})["w"] for e in (before, after))
        return places[min(places, key=lambda p: (-score(p), p))]


def topology_score(graph: Graph, clients: list[str], routers: list[str], priority: str) -> tuple:
    """How a network compares: first by the priority, then by what the others would."""
    paths = [p for i, a in enumerate(clients) for b in clients[i + 1 :] if (p := graph.reliability_path(a, b))]
    joined = len(paths) == len(clients) * (len(clients) - 1) // 2
    worst, hops = min(map(graph.bottleneck, paths), default=float("-inf")), max((len(p) - 1 for p in paths), default=0)
    new = sum(not graph.facts.get(r, {}).get("existing", False) for r in routers)
    by = {"reliability": (-worst, new, hops), "installations": (new, -worst, hops), "hops": (hops, new, -worst)}
    return (not joined, *by[priority])


def active_alternative(scores: list[tuple]) -> int | None:
    """The first of the best."""
    return min(range(len(scores)), key=lambda i: (scores[i], i)) if scores else None
