"""Routes over the sites of many networks at once: screened pairs, certified links, and one search a network.

Pairs are a site's nearest neighbours and every site with the two ends of its network; those that free space rules out are
dropped; the rest is evaluated at the final step in one job over all networks, so every link a route can use is certified
before the search begins. A network's sites and links then go to one task, which searches its graph; a network has MOST_SITES
sites at the most, a larger one is an error. Networks are independent of each other, so they spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.functions import rf
from airlattice.operators import links
from airlattice.operators.graph import Graph

MOST_SITES = 5_000  #: of one network, which one task searches


def screened_pairs(sites: DataFrame, near: DataFrame, radio: rf.Radio, max_m: float = 50_000.0) -> DataFrame:
    """(net, a, b, ax, ay, ah, bx, by, bh) with a < b, at most max_m metres apart. sites: net, id, x, y, h,
    terminal; near: net, a, b, the nearest neighbours."""
    ends = sites.filter("terminal").select("net", F.col("id").alias("a"))  # two a network
    far = ends.join(sites.select("net", F.col("id").alias("b")), "net").filter("a <> b")
    pairs = near.select("net", "a", "b").unionByName(far)
    pairs = pairs.select("net", F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q")).distinct()
    side = lambda p: sites.select("net", F.col("id").alias(p), F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y"), F.col("h").alias(f"{p}h"))
    pairs = pairs.withColumnsRenamed({"p": "a", "q": "b"}).join(side("a"), ["net", "a"]).join(side("b"), ["net", "b"])
    d = rf.planar_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return pairs.filter((d > 0) & (d <= max_m) & (rf.optimistic_margin_db(d, radio) >= 0))


def certified_links(pairs: DataFrame, tiles: DataFrame, radio: rf.Radio, res: float) -> DataFrame:
    """(net, a, b, margin_db, clear, fresnel, metres) of the pairs whose link holds both ways."""
    rows = pairs.withColumn("link_id", F.concat_ws("\t", "net", "a", "b"))
    got = links.evaluate(rows, tiles, radio, res, ends=("router", "router")).filter("state is null and valid")
    return got.select("net", "a", "b", F.col("two_way_db").alias("margin_db"), (F.col("los_clear") & F.col("fresnel_clear")).alias("clear"), F.col("fresnel_ratio").alias("fresnel"), F.col("distance_m").alias("metres"))


def searched(sites: DataFrame, certified: DataFrame, search: Callable[[Graph, str, str], list[list]], columns: str) -> DataFrame:
    """Rows of a search in each network that has two ends: net, and what `search` gives, by columns (their DDL)."""

    def run(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in columns.split(", ")]
        if len(own) > MOST_SITES:
            raise ValueError(f"network {own.net.iloc[0]} has more than {MOST_SITES} sites")
        own = own.sort_values("id")
        ends = own.id[own.terminal].tolist()
        found = []
        if len(ends) == 2:
            facts = {r.id: {"height": r.h, "quality": r.quality, "existing": r.existing, "client": r.terminal} for r in own.itertuples()}
            pairs = [(r.a, r.b) for r in held.itertuples()]
            column = lambda c: dict(zip(pairs, held[c].tolist(), strict=True))
            g = Graph([(*p, w) for p, w in sorted(column("margin_db").items())], column("clear"), facts, column("fresnel"), column("metres"))
            found = search(g, *ends)
        out = pd.DataFrame(found, columns=names)
        out.insert(0, "net", own.net.iloc[0] if len(own) else None)
        return out

    return sites.groupBy("net").cogroup(certified.groupBy("net")).applyInPandas(run, f"net string, {columns}")
