"""Two-way link evaluation over terrain, as joins and one aggregation by link.

The raster is cut into tiles that overlap by a row and a column, so a bilinear sample reads one tile. The ends' ground comes
first; with it each sample is a row of plain arithmetic, and all that a link needs of its samples (least clearance, widest
zone, the slopes and edges of the diffraction) are minima and maxima, combined before the one shuffle by link. Links beyond
the profile cap, and of no length, never reach the samples.

A null or missing ground anywhere on the path makes the link's state `missing terrain`; links with null ends are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.functions import rf
from airlattice.tables import cut

TILE = 64
SAMPLES_PER_TASK, MOST_TASKS = 60_000, 20_000  #: samples are made in tasks of about so many, however few rows their links take; beyond so many tasks each takes more
BROADCAST_TILES = 1_000  #: tiles (of 34 kB each) up to which every executor gets all; more are joined by key


def tile_lattice(lattice: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles (tx, ty, block) of a raster's nodes (ix, iy, z): block holds tile+1 rows and columns, nulls where no node is."""
    near = lambda i, t: F.when(F.pmod(i, F.lit(tile)) == 0, F.array(t, t - 1)).otherwise(F.array(t))
    t = lambda c: F.floor(F.col(c) / tile).cast("int")
    rows = lattice.withColumn("tx", F.explode(near(F.col("ix"), t("ix")))).withColumn("ty", F.explode(near(F.col("iy"), t("iy"))))
    at = (F.col("iy") - F.col("ty") * tile) * (tile + 1) + (F.col("ix") - F.col("tx") * tile)
    held = rows.groupBy("tx", "ty").agg(F.array_sort(F.collect_list(F.struct(at.cast("int").alias("at"), "z"))).alias("l"))
    whole = (tile + 1) ** 2
    # A tile that lacks nodes at the raster's edge is filled by place; others are whole as they are.
    filled = F.aggregate(
        "l", F.struct(F.array().cast("array<double>").alias("z"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.concat(acc["z"], F.array_repeat(F.lit(None).cast("double"), x["at"] - acc["n"]), F.array(x["z"])).alias("z"), (x["at"] + 1).alias("n")),
        lambda acc: F.concat(acc["z"], F.array_repeat(F.lit(None).cast("double"), F.lit(whole) - acc["n"])),
    )
    return held.select("tx", "ty", F.when(F.size("l") == whole, F.transform("l", lambda x: x["z"])).otherwise(filled).alias("block"))


def with_ground(points: DataFrame, tiles: DataFrame, x: str, y: str, out: str, res: float, tile: int = TILE) -> DataFrame:
    """points with the bilinear height at (x, y); null outside the raster or beside a missing node."""
    cx, cy = F.col(x) / F.lit(res), F.col(y) / F.lit(res)
    p = points.withColumns({"__ix": F.floor(cx).cast("int"), "__iy": F.floor(cy).cast("int"), "__dx": cx - F.floor(cx), "__dy": cy - F.floor(cy)})
    p = p.withColumns({"__tx": F.floor(F.col("__ix") / tile).cast("int"), "__ty": F.floor(F.col("__iy") / tile).cast("int")})
    t = tiles.select(F.col("tx").alias("__tx"), F.col("ty").alias("__ty"), F.col("block").alias("__block"))
    p = p.join(t, ["__tx", "__ty"], "left")
    base = (F.col("__iy") - F.col("__ty") * tile) * (tile + 1) + (F.col("__ix") - F.col("__tx") * tile)
    z = lambda dx, dy: F.get("__block", base + dy * (tile + 1) + dx)
    dx, dy = F.col("__dx"), F.col("__dy")
    # A neighbour that the point doesn't lean on may be missing at the raster's edge.
    z10, z01 = F.when(dx == 0, z(0, 0)).otherwise(z(1, 0)), F.when(dy == 0, z(0, 0)).otherwise(z(0, 1))
    z11 = F.when(dx == 0, z01).when(dy == 0, z10).otherwise(z(1, 1))
    one = F.lit(1.0)
    height = z(0, 0) * (one - dx) * (one - dy) + z10 * dx * (one - dy) + z01 * (one - dx) * dy + z11 * dx * dy
    return p.withColumn(out, height).drop("__ix", "__iy", "__dx", "__dy", "__tx", "__ty", "__block")


def profile_samples(links: DataFrame, radio: rf.Radio, res: float) -> DataFrame:
    """links with d (distance) and n (samples), and a row a sample: i, di, px, py."""
    s = links.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    s = s.withColumn("di", F.when(F.col("i") == F.col("n") - 1, F.col("d")).otherwise(F.col("i") * (F.col("d") / (F.col("n") - 1))))
    t = F.col("di") / F.col("d")
    return s.withColumns({"px": F.col("ax") + t * (F.col("bx") - F.col("ax")), "py": F.col("ay") + t * (F.col("by") - F.col("ay"))})


def _budget(radio: rf.Radio, tx: str, rx: str, loss: Column, depart: Column, pattern: Column | None) -> Column:
    power = {"router": radio.tx_power_dbm, "client": radio.client_tx_power_dbm}[tx]
    sens = {"router": radio.sensitivity_dbm, "client": radio.client_sensitivity_dbm}[rx]
    a = radio.antenna
    g_tx, g_rx = (F.lit(a.gain_dbi),) * 2 if pattern is None else (rf.gain_at(pattern, depart), rf.gain_at(pattern, -depart))
    got = rf.received_dbm(power, g_tx, a.feed_loss_db, loss, g_rx, a.feed_loss_db, radio.misc_loss_db)
    usable = got - F.lit(sens) - F.lit(radio.fade_margin_db)
    return F.struct(depart.alias("departure_deg"), got.alias("received_dbm"), usable.alias("margin_db"), (usable >= 0).alias("valid"))


def evaluate(links: DataFrame, tiles: DataFrame, radio: rf.Radio, res: float, *, ends: tuple[str, str] = ("router", "client"), pattern: Column | None = None, surface: DataFrame | None = None) -> DataFrame:
    """Links with their evaluation. links: link_id, ax, ay, ah, bx, by, bh (antenna heights above ground), other columns kept.

    surface: tiles of a surface raster, which then is what obstructs; where it is missing the ground is. With a clutter
    loss set, its greatest height over the ground costs that much a metre (A7).

    state: `profile cap`, `coincident`, `missing terrain` or null; the rest is null where state isn't.
    """
    keep = links.columns
    tiles = cut(tiles)
    if tiles.count() <= BROADCAST_TILES:
        tiles = F.broadcast(tiles)
    links = links.dropna(subset=["link_id", "ax", "ay", "bx", "by"])
    links = links.withColumn("d", rf.planar_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    links = links.withColumn("n", rf.sample_count(F.col("d"), radio.sample_step_m, res))
    gate = F.when(F.col("n") > radio.max_samples, "profile cap").when(F.col("d") == 0, "coincident")
    links = cut(links.withColumn("gate", gate))
    ok = links.filter("gate is null").select("link_id", "ax", "ay", "ah", "bx", "by", "bh", "d", "n")
    # Shared out by the samples to come; the aggregation by link needs no other shuffle then.
    samples = ok.agg(F.sum("n")).first()[0] or 0
    ok = ok.repartition(min(max(1, -(-samples // SAMPLES_PER_TASK)), MOST_TASKS), "link_id")
    ok = with_ground(with_ground(ok, tiles, "ax", "ay", "za", res), tiles, "bx", "by", "zb", res)
    ok = ok.withColumns({"ta": F.col("za") + F.col("ah"), "tb": F.col("zb") + F.col("bh")})
    s = with_ground(profile_samples(ok, radio, res), tiles, "px", "py", "z", res)
    top = F.col("z")
    if surface is not None:
        s = with_ground(s, surface, "px", "py", "zs", res)
        top = F.when(F.col("z").isNotNull(), F.coalesce("zs", "z"))
    x, length, ta, tb = F.col("di"), F.col("d"), F.col("ta"), F.col("tb")
    inner = (F.col("i") > 0) & (F.col("i") < F.col("n") - 1)
    h = top + rf.earth_bulge_m(x, length, radio.k_factor)
    los = ta + x / length * (tb - ta)
    radius = F.sqrt(F.lit(radio.wavelength_m) * x * (length - x) / length)
    clear = los - h
    ratio = F.when(radius <= 1e-9, F.lit(float("inf"))).otherwise(clear / radius)
    slope = (tb - ta) / length
    edge = (h - (ta + slope * x)) * F.sqrt(F.lit(2.0) * length / (F.lit(radio.wavelength_m) * x * (length - x)))
    at = lambda c: F.when(inner, c)
    m = s.groupBy("link_id").agg(
        F.count_if(F.col("z").isNull()).alias("missing"), F.min(at(clear)).alias("clearance_m"),
        F.min(at(F.struct(ratio.alias("r"), F.col("i"), x.alias("x")))).alias("worst"), F.max(radius).alias("fresnel_radius_m"),
        F.max(at((h - ta) / x)).alias("s_tx"), F.max(at((h - tb) / (length - x))).alias("s_rx"), F.max(at(edge)).alias("v_los"),
        F.max(F.greatest(top - F.col("z"), F.lit(0.0))).alias("clutter_m"),
        F.first("ta").alias("ta"), F.first("tb").alias("tb"), F.first("d").alias("len"), F.first("n").alias("n_s"),
    )
    length, ta, tb = F.col("len"), F.col("ta"), F.col("tb")
    s_d, den = (tb - ta) / length, F.col("s_tx") + F.col("s_rx")
    spacing = length / (F.col("n_s") - 1)
    p = F.when(den > 0, (tb - ta + F.col("s_rx") * length) / den).otherwise(length / 2)
    p = F.least(F.greatest(p, spacing), spacing * (F.col("n_s") - 2))
    over = rf.knife_edge_v(ta + F.col("s_tx") * p - (ta + s_d * p), p, length - p, radio.frequency_mhz)
    v = F.when(F.col("s_tx") < s_d, F.col("v_los")).otherwise(over)
    m = m.withColumn("j", rf.knife_edge_db(v))
    m = m.withColumn("diffraction_db", rf.bullington_db(F.col("j"), length))
    loss = rf.fspl_db(length, radio.frequency_mhz) + F.col("diffraction_db")
    if radio.clutter_db_per_m is not None:
        loss = loss + F.col("clutter_m") * radio.clutter_db_per_m
    depart = rf.elevation_deg(length, ta, tb)
    m = m.withColumns({"forward": _budget(radio, *ends, loss, depart, pattern), "reverse": _budget(radio, *ends[::-1], loss, -depart, pattern)})
    m = m.withColumns({"fresnel_ratio": F.col("worst.r"), "ratio_at_m": F.col("worst.x"), "los_clear": F.col("clearance_m") >= 0, "fresnel_clear": F.col("worst.r") >= radio.fresnel_clearance})
    values = ["clearance_m", "fresnel_ratio", "ratio_at_m", "fresnel_radius_m", "diffraction_db", "los_clear", "fresnel_clear", "forward", "reverse"]
    out = links.join(m.select("link_id", "missing", *values), "link_id", "left")
    state = F.coalesce(F.col("gate"), F.when(F.col("missing") > 0, "missing terrain"))
    out = out.withColumns({"state": state, **{c: F.when(state.isNull(), F.col(c)) for c in values}})
    valid = F.col("forward.valid") & F.col("reverse.valid")
    if radio.strict:
        valid = valid & F.col("los_clear") & F.col("fresnel_clear")
    two_way = F.least("forward.margin_db", "reverse.margin_db")
    return out.select(*keep, F.col("d").alias("distance_m"), F.col("n").alias("n_samples"), "state", *values, two_way.alias("two_way_db"), valid.alias("valid"))
