"""Implausible readings per source: impossible, stuck, and spikes by robust autoregression with outlier and shift tests.

A source's series is cut by rank into even blocks of neighbouring packets, so no task holds a whole source. In each block
the usual levels are fitted together with a robust first-order autoregression about them: readings that leap out are set
aside; where those gather, or where a level's own series is better told by two means than by autoregression alone, a level
shift is tested and, if it holds, becomes a level, and the fit is repeated. Levels and coefficients of a source's blocks are
merged. The decision is on the autoregression's residuals, level by level: a reading's additive-outlier statistic, of its
own residual and the next one's, in innovation spreads; the largest in its neighbourhood is flagged, its reading replaced by
its prediction, and the test repeated until none is left. A reading is a spike if no usual level explains it. Equal readings
in a row are joined across block edges.

Where neighbouring readings are unrelated (coefficient 0) the innovation spread is the spread about the level, and a spike
is what lies so many spreads from every level.

Null readings are skipped; rows without a source give no rows; a repeated row is one. Rows with equal packet ids are ordered
by observation key. A level's spread is drawn to the usual spread of all levels with the weight of PRIOR_READINGS readings,
so that sources of few readings can be judged; where no place is shared by the readings a level takes (two at the least),
there is no level and no spike.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlattice.tables import cut, load, norm_id

BLOCK_ROWS = 20_000  #: rows of a source that one block holds, at most
STUCK_RUN = 10
#: Usual readings stay within four spreads and spikes are beyond six: an estimated spread decides best half way.
DECIDE_SPREADS = 5.0
PRIOR_READINGS = 2
#: Readings beyond so many spreads enter the level-shift test: where levels lie close, only part of one stands out.
TEST_SPREADS = 3.0
#: A cluster of outliers is a level if it holds this share of the block's readings and, in a block of some size, so many.
SHIFT_SHARE, SHIFT_LEAST = 0.08, 8
#: A source's levels share its noise: no spread is taken for less than this part of the widest.
SHARED_NOISE = 0.6
SHIFT_SPREADS = 1.5  #: a cut that parts a level's means by so many spreads can be a shift
SHIFT_EVIDENCE = 4.0  #: a shift's gain in log likelihood over autoregression alone, in logarithms of the readings (its parameters)
#: Levels that blocks found within this part of a spread of each other are one.
MERGE_SPREADS = 0.25
#: Spreads are measured on readings within CUT spreads; a normal distribution cut there keeps this part of its deviation.
CUT, CUT_KEEPS = 2.0, 0.8796
QUANTITIES = {"rssi": (1.0, -150.0, 0.0), "snr": (0.25, -40.0, 40.0)}  #: step of the readings, physical limits


def impossible(quantity: str, v: np.ndarray) -> np.ndarray:
    _, low, high = QUANTITIES[quantity]
    with np.errstate(invalid="ignore"):
        return np.isnan(v) | (v < low) | (v > high) | ((quantity == "rssi") & (v >= high))


def runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run number of each reading, length of each run) of equal readings; NaN equals NaN."""
    if not len(v):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    same = (v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1]))
    number = np.concatenate([[0], np.cumsum(~same)])
    return number, np.bincount(number)


def _mode(v: np.ndarray, step: float) -> float:
    """Center of the densest part, seen through a window of a few steps that widens with the readings' scatter."""
    lo = v.min()
    h = np.bincount(np.rint((v - lo) / step).astype(np.int64)).astype(float)
    width = 3.0 + 2.0 / (1.0 + len(v) / 30.0)
    x = np.arange(-int(3 * width), int(3 * width) + 1)
    k = np.exp(-0.5 * (x / width) ** 2)
    return lo + step * float(np.argmax(np.convolve(h, k, "same") if len(k) <= len(h) else np.convolve(h, k, "full")[len(k) // 2 : len(k) // 2 + len(h)]))


def _local_spread(v: np.ndarray, center: float, step: float) -> float:
    """Spread of the readings about a center from its nearest half-density neighbourhood, other levels left aside."""
    lo, d = center, np.sort(np.abs(v - center))
    spread = max(step, d[len(d) // 4])
    for _ in range(40):
        near = v[np.abs(v - lo) <= CUT * spread + step / 2]
        new = max(float(np.sqrt(np.mean((near - lo) ** 2))) / CUT_KEEPS, 0.6 * step)
        if abs(new - spread) < 1e-3 * step:
            break
        spread = 0.5 * (spread + new)
        lo = 0.5 * lo + 0.5 * float(near.mean())
    return spread


def autoregression(z: np.ndarray, same: np.ndarray | None = None) -> float:
    """Robust lag-one coefficient of deviations in spreads: weighted least squares in which far predecessors and large
    residuals count less. same: which neighbours are on one level. The estimate is drawn to zero by twice its own error."""
    a, b = z[:-1], z[1:]
    if same is not None:
        a, b = a[same], b[same]
    if not len(a):
        return 0.0
    far = np.minimum(1.0, 2.5 / np.maximum(np.abs(a), 1e-9))
    near = np.clip(z, -CUT, CUT)
    phi = float(np.clip(near[:-1] @ near[1:] / max(near @ near, 1e-9), -0.95, 0.99))
    for _ in range(8):
        r = b - phi * a
        scale = max(1.4826 * float(np.median(np.abs(r))), 1e-6)
        w = far * np.minimum(1.0, 2.0 * scale / np.maximum(np.abs(r), 1e-9))
        phi, old = float(np.clip((w * a) @ b / max((w * a) @ a, 1e-9), -0.95, 0.99)), phi
        if abs(phi - old) < 1e-4:
            break
    return phi * max(0.0, 1.0 - 4.0 * (1.0 - phi * phi) / (len(a) * max(phi * phi, 1e-12)))


def _residual_log(z: np.ndarray, same: np.ndarray | None = None) -> float:
    """Logarithm of the mean square of the autoregression's residuals, cut at three of their spreads."""
    phi = autoregression(z, same)
    r = z[1:] - phi * z[:-1]
    if same is not None:
        r = np.where(same, r, z[1:] * np.sqrt(1 - phi * phi))
    scale = max(1.4826 * float(np.median(np.abs(r))), 1e-6)
    return float(np.log(np.mean(np.clip(r, -3 * scale, 3 * scale) ** 2) + 1e-12))


def fit_levels(v: np.ndarray, step: float) -> list[tuple[float, float, float, int]]:
    """(center, spread, phi, support) of a series' usual levels; v is in order, without impossible and stuck readings."""
    if not len(v):
        return []
    need = max(SHIFT_SHARE * len(v), min(SHIFT_LEAST, 1 + len(v) / 4))
    levels: list[list[float]] = []
    left = np.ones(len(v), bool)
    while left.sum() >= need:
        # Level-shift test: do the outliers so far gather about one place, more than scattered outliers would?
        rest = v[left]
        center = _mode(rest, step)
        spread = _local_spread(rest, center, step)
        near = np.abs(rest - center) <= 4 * spread
        if near.sum() < need or levels and spread > 3 * max(s for _, s in levels):
            break
        outside = left.sum()
        levels.append([center, spread])
        # Refit all levels together, each by its nearest readings within two spreads, where other levels hardly reach.
        for _ in range(30):
            c, s = np.array(levels).T
            z = np.abs(v[:, None] - c) / s
            own = z.argmin(1)
            fresh = []
            for i in range(len(c)):
                near = v[(own == i) & (np.abs(v - c[i]) <= CUT * s[i] + step / 2)]
                if len(near) >= (0.5 * need if len(c) > 1 else 1):
                    m = float(near.mean())
                    fresh.append([m, max(float(np.sqrt(np.mean((near - m) ** 2))) / CUT_KEEPS, 0.6 * step)])
            if not fresh:
                break
            moved = len(fresh) != len(levels) or np.abs(np.array(fresh) - np.array(levels)).max() > 0.01 * step
            levels = [[(x + y) / 2 for x, y in zip(p, f, strict=True)] for p, f in zip(levels, fresh, strict=True)] if len(fresh) == len(levels) else fresh
            if not moved:
                break
        c, s = np.array(levels).T
        left = (np.abs(v[:, None] - c) / s).min(1) > TEST_SPREADS
        if left.sum() >= outside:
            break  # a level that explains no reading more is no evidence of another
    if not levels:
        return []
    levels = _shifted(v, levels, need)
    c, s = np.array(levels).T
    s = np.maximum(s, SHARED_NOISE * s.max())
    z = np.abs(v[:, None] - c) / s
    own, ok = z.argmin(1), z.min(1) <= 4
    phi = autoregression((v[ok] - c[own[ok]]) / s[own[ok]], own[ok][1:] == own[ok][:-1])
    return [(float(c[i]), float(s[i]), phi, int((own[ok] == i).sum())) for i in range(len(c))]


def _trimmed(r: np.ndarray, least: float) -> list[float]:
    """Mean and spread of one level's readings, its own outliers cut."""
    m, s = float(np.median(r)), max(1.4826 * float(np.median(np.abs(r - np.median(r)))), least)
    for _ in range(8):
        near = r[np.abs(r - m) <= CUT * s]
        if not len(near):
            break
        m, s = float(near.mean()), max(float(near.std()) / CUT_KEEPS, least)
    return [m, s]


def _shifted(v: np.ndarray, levels: list[list[float]], need: float) -> list[list[float]]:
    """Level-shift tests. Two levels so close that one spread covers both make neighbours look related. A level's series is
    cut at its best change point in time, or else in two by value, as levels that alternate are; the cut is kept if it
    parts the means well and two levels tell the series better than the autoregression about one. Repeated until no level
    is parted further."""
    done: list[list[float]] = []
    todo = list(levels)
    while todo:
        c, s = todo.pop()
        others = np.array([x for x, _ in todo] + [x for x, _ in done if x != c] or [np.inf])
        r = v[(np.abs(v - c) <= 4 * s) & (np.abs(v - c) <= np.abs(v[:, None] - others).min(1))]
        parts = None
        if len(r) >= 2 * need:
            floor = 0.25 * s
            alone = _residual_log((r - c) / s)
            better = lambda x, z, same: len(r) * (alone - 2 * np.log(x / s) - _residual_log(z, same)) > SHIFT_EVIDENCE * np.log(len(r))
            w = np.clip(r - c, -3 * s, 3 * s)
            k = np.arange(1, len(r))
            total = np.cumsum(w)
            gain = (total[:-1] - k / len(r) * total[-1]) ** 2 / (k * (len(r) - k) / len(r))
            gain[(k < need) | (len(r) - k < need)] = -1
            at = int(k[gain.argmax()])
            one, two = _trimmed(r[:at], floor), _trimmed(r[at:], floor)
            wide = max(one[1], two[1])
            if gain.max() > 0 and abs(one[0] - two[0]) > SHIFT_SPREADS * wide and better(wide, (r - np.where(np.arange(len(r)) < at, one[0], two[0])) / wide, None):
                parts = [one, two]
            else:
                o = np.sort(r)
                left, n = np.cumsum(o)[:-1], np.arange(1, len(o))
                between = (left / n - (o.sum() - left) / (len(o) - n)) ** 2 * n * (len(o) - n)
                between[(n < need) | (len(o) - n < need)] = -1
                at = int(n[between.argmax()])
                a, b = o[:at], o[at:]
                # The halves of one normal distribution lie 2.65 of their deviations apart.
                if between.max() > 0 and b.mean() - a.mean() > 3.4 * max(a.std(), b.std()):
                    one, two = _trimmed(a, floor), _trimmed(b, floor)
                    wide, upper = max(one[1], two[1]), r > (a[-1] + b[0]) / 2
                    if better(wide, (r - np.where(upper, two[0], one[0])) / wide, upper[1:] == upper[:-1]):
                        parts = [one, two]
        if parts:
            todo += parts
        else:
            done.append([c, s])
    return done


def _usable(quantity: str, v: np.ndarray) -> np.ndarray:
    """Readings fit for levels: possible, and in no run that is or, over the block's edge, may be stuck."""
    number, length = runs(v)
    long = length >= STUCK_RUN
    if len(length):
        long[[0, -1]] |= length[[0, -1]] >= STUCK_RUN // 2
    return v[~impossible(quantity, v) & ~long[number]]


def merged(c: np.ndarray, s: np.ndarray, n: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """(centers, spreads) of a source's levels from those of its blocks, which number as many as the readings' range has steps:
    neighbours are joined, spreads drawn to the prior and to the source's widest."""
    out: list[list[float]] = []
    for i in np.argsort(c, kind="stable"):
        if out and c[i] - out[-1][0] <= MERGE_SPREADS * min(s[i], out[-1][1]):
            x = out[-1]
            k = x[2] + n[i]
            out[-1] = [(x[0] * x[2] + c[i] * n[i]) / k, float(np.sqrt((x[1] ** 2 * x[2] + s[i] ** 2 * n[i]) / k)), k]
        else:
            out.append([float(c[i]), float(s[i]), float(n[i])])
    x = np.array(out)
    spread = np.sqrt((x[:, 2] * x[:, 1] ** 2 + PRIOR_READINGS * prior**2) / (x[:, 2] + PRIOR_READINGS))
    return x[:, 0], np.maximum(spread, SHARED_NOISE * spread.max())


def _nearest(v: np.ndarray, c: np.ndarray, s: np.ndarray, ahead: np.ndarray | float = 0.0) -> np.ndarray:
    """Each reading's deviation, in spreads, from the level that explains it best; ahead: the deviation foretold."""
    best = np.full(len(v), np.inf)
    for ci, si in zip(c, s, strict=True):
        r = (v - ci) / si - ahead
        best = np.where(np.abs(r) < np.abs(best), r, best)
    return best


def outliers(v: np.ndarray, c: np.ndarray, s: np.ndarray, phi: float) -> np.ndarray:
    """Mask of the additive outliers of a series of possible, moving readings about the usual levels.

    e is the residual of the prediction from the last reading not flagged, over all levels the least; an outlier of size x
    adds x to its own residual and -phi x to the next one's, and the statistic is x over its error from both. Flagged are
    the largest of their neighbourhood, until no statistic is beyond DECIDE_SPREADS.
    """
    flagged, at = np.zeros(len(v), bool), np.arange(len(v))
    if not len(v):
        return flagged
    z = _nearest(v, c, s)
    while True:
        last = np.maximum.accumulate(np.where(flagged, -1, at))
        clean = np.where(last >= 0, np.power(phi, at - last) * z[np.maximum(last, 0)], 0.0)
        before = np.concatenate([[-1], last[:-1]])
        e = _nearest(v, c, s, np.concatenate([[0.0], phi * clean[:-1]]))
        own = np.where(before >= 0, 1.0 - np.power(phi * phi, at - before), 1.0)  # what the prediction leaves open
        follows = np.concatenate([~flagged[1:], [False]])
        after = np.where(follows, phi / (1.0 - phi * phi), 0.0)
        tau = np.abs(e / own - after * np.concatenate([e[1:], [0.0]])) / np.sqrt(1.0 / own + phi * after)
        tau[flagged] = 0.0
        peak = (tau >= np.concatenate([[0.0], tau[:-1]])) & (tau >= np.concatenate([tau[1:], [0.0]]))
        fresh = peak & (tau > DECIDE_SPREADS)
        if not fresh.any():
            return flagged
        flagged |= fresh


def _block_summary(_: tuple, t: pd.DataFrame) -> pd.DataFrame:
    """A block's levels (kind level) and its first and last run of each quantity (kind edge)."""
    t = t.sort_values(["packet_id", "observation_key"])
    out = []
    for q, (step, _lo, _hi) in QUANTITIES.items():
        v = t.loc[t[f"has_{q}"], q].to_numpy(float)
        if not len(v):
            continue
        _, length = runs(v)
        key = (t.endpoint.iloc[0], t.source.iloc[0], int(t.blk.iloc[0]))
        out.append((*key, q, "edge", v[0], int(length[0]), v[-1], int(length[-1]), len(length), 0.0))
        out += [(*key, q, "level", c, n, s, 0, 0, phi) for c, s, phi, n in fit_levels(_usable(q, v), step)]
    return pd.DataFrame(out, columns=["endpoint", "source", "blk", "quantity", "kind", "a", "na", "b", "nb", "n_runs", "phi"])


_SUMMARY = "endpoint string, source string, blk bigint, quantity string, kind string, a double, na bigint, b double, nb bigint, n_runs bigint, phi double"


def flag_block(t: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
    """A block's flagged readings. info: of each quantity, the source's levels, coefficient, and the whole lengths of the
    edge runs."""
    t = t.sort_values(["packet_id", "observation_key"])
    parts = []
    for q in QUANTITIES:
        has = t[f"has_{q}"].to_numpy(bool)
        v = t[q].to_numpy(float)[has]
        if not len(v):
            continue
        number, length = runs(v)
        mine = info[info.quantity == q]
        if len(mine):
            length[0], length[-1] = max(length[0], mine.first_run.iloc[0]), max(length[-1], mine.last_run.iloc[0])
        stuck = length[number] >= STUCK_RUN
        bad = impossible(q, v)
        spike = np.zeros(len(v), bool)
        if len(mine) and mine.levels.iloc[0] is not None and len(mine.levels.iloc[0]):
            x = np.array([(r["c"], r["s"], r["n"]) for r in mine.levels.iloc[0]], float)
            c, s = merged(x[:, 0], x[:, 1], x[:, 2], float(mine.prior.iloc[0]))
            judged = np.flatnonzero(~bad & ~stuck)
            spike[judged] = outliers(v[judged], c, s, float(mine.phi.iloc[0]))
        packet, name = t.packet_id.to_numpy()[has], t.observation_key.to_numpy(object)[has]
        parts += [(packet[m], name[m], q, f) for f, m in (("impossible", bad), ("stuck", stuck), ("spike", spike)) if m.any()]
    flat = lambda at, kind: np.concatenate([np.full(len(x[0]), x[at], object) if isinstance(x[at], str) else x[at] for x in parts] or [np.empty(0, kind)])
    return pd.DataFrame({"packet_id": flat(0, np.int64), "observation_key": flat(1, object), "quantity": flat(2, object), "fault": flat(3, object)})


def _number(batches: Iterable[pa.RecordBatch]):
    """Sorted rows, repeated ones once, with the task's number and each row's place among its source's in the task."""
    part, last, place = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        code = lambda c: b.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        first = tuple(b.column(c)[0].as_py() for c in ("endpoint", "source", "packet_id", "observation_key", "row_hash"))
        step = lambda c: code(c)[1:] != code(c)[:-1]
        new = np.concatenate([[last is None or first[:2] != last[:2]], step("endpoint") | step("source")])
        keep = np.concatenate([[first != last], step("packet_id") | step("observation_key") | step("row_hash")]) | new
        count = np.cumsum(keep)
        begun = np.maximum.accumulate(np.where(new, count - 1, -1))  # rows kept before the source's first one here
        own = np.where(begun >= 0, count - 1 - begun, place + count - 1)
        last = tuple(b.column(c)[b.num_rows - 1].as_py() for c in ("endpoint", "source", "packet_id", "observation_key", "row_hash"))
        place = int(own[-1]) + 1
        out = b.drop_columns(["row_hash"]).append_column("part", pa.array(np.full(b.num_rows, part, np.int64))).append_column("place", pa.array(own.astype(np.int64)))
        yield out.filter(pa.array(keep))


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Different rows with blk: each source's rows, in order, cut evenly by rank into as many parts as they need. Rows are
    sorted over all tasks; a row's rank is its place in its task after what the tasks before hold of its source."""
    order = ["endpoint", "source", "packet_id", "observation_key"]
    hashed = rows.select(*order, "rssi", "snr", F.xxhash64(*order, "rssi", "snr").alias("row_hash"))
    schema = "endpoint string, source string, packet_id bigint, observation_key string, rssi double, snr double, part bigint, place bigint"
    placed = cut(hashed.repartitionByRange(*order).sortWithinPartitions(*order, "row_hash").mapInArrow(_number, schema))
    held = placed.groupBy("endpoint", "source", "part").agg((F.max("place") + 1).alias("n"))
    whole = Window.partitionBy("endpoint", "source")  # as many rows as tasks hold the source
    held = held.select("endpoint", "source", "part", (F.sum("n").over(whole.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("total"))
    parts = F.expr(f"(total + {block_rows - 1}) div {block_rows}")
    got = placed.join(held.withColumn("parts", parts), ["endpoint", "source", "part"])
    return got.withColumn("blk", F.expr("((before + place) * parts) div total")).drop("part", "place", "before", "total", "parts")


def faults(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(packet_id, observation_key, quantity, fault). rows: endpoint, source, packet_id, observation_key, rssi, snr."""
    rows = rows.filter("endpoint is not null and source is not null and packet_id is not null")
    flags = [F.col(q).isNotNull().alias(f"has_{q}") for q in QUANTITIES]  # pandas would take null for NaN
    b = cut(blocks(rows, block_rows).select("*", *flags))
    key = ["endpoint", "source", "blk"]
    summary = cut(b.groupBy(*key).applyInPandas(_block_summary, _SUMMARY))

    # Runs that touch block edges: a source has at most two a block and quantity.
    edges = summary.filter("kind = 'edge'").select(*key, "quantity", F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.col("a").alias("v"), F.col("na").alias("n"), "n_runs"),
        F.struct(F.when(F.col("n_runs") > 1, 1).alias("pos"), F.col("b").alias("v"), F.col("nb").alias("n"), "n_runs"),
    )).alias("e")).select(*key, "quantity", "e.*").filter("pos is not null")
    order = Window.partitionBy("endpoint", "source", "quantity").orderBy("blk", "pos")
    joined = (F.col("pos") == 0) & (F.col("v") == F.lag("v").over(order))  # the engine holds NaN equal to NaN
    edges = edges.withColumn("island", F.sum(F.when(joined, 0).otherwise(1)).over(order))
    whole = Window.partitionBy("endpoint", "source", "quantity", "island")
    edges = edges.withColumn("whole", F.sum("n").over(whole))
    edges = edges.groupBy(*key, "quantity").agg(F.max(F.when(F.col("pos") == 0, F.col("whole"))).alias("first_run"), F.max_by("whole", "pos").alias("last_run"))

    # A source's levels: those of its blocks that fall on one quarter of a step are taken together, so their number is
    # bounded by the readings' range. prior: the middle spread of all levels of the quantity, one number each.
    levels = summary.filter("kind = 'level'")
    prior = levels.groupBy("quantity").agg(F.percentile_approx("b", 0.5).alias("prior"))
    quarter = F.when(F.col("quantity") == "rssi", QUANTITIES["rssi"][0] / 4).otherwise(QUANTITIES["snr"][0] / 4)
    mean = lambda c: F.sum(c * F.col("na")) / F.sum("na")
    place = levels.groupBy("endpoint", "source", "quantity", F.round(F.col("a") / quarter).alias("place")).agg(
        F.struct(mean(F.col("a")).alias("c"), F.sqrt(mean(F.col("b") * F.col("b"))).alias("s"), F.sum("na").alias("n")).alias("l"), F.sum("na").alias("n"), mean(F.col("phi")).alias("phi")
    )
    levels = place.groupBy("endpoint", "source", "quantity").agg(F.sort_array(F.collect_list("l")).alias("levels"), (F.sum(F.col("phi") * F.col("n")) / F.sum("n")).alias("phi"))
    info = edges.join(levels.join(F.broadcast(prior), "quantity"), ["endpoint", "source", "quantity"], "left")
    schema = "packet_id bigint, observation_key string, quantity string, fault string"
    return b.groupBy(*key).cogroup(info.groupBy(*key)).applyInPandas(flag_block, schema)


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "observations").select(
        "endpoint", norm_id("observer_id").alias("source"), "packet_id", "observation_key", "rssi", "snr"
    )


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found: packet_id, observation_key, quantity, fault."""
    return faults(source_rows(spark, sf_dir))


def impossible_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings outside the physical limits alone, as one filter over the rows."""
    rows = source_rows(spark, sf_dir).filter("endpoint is not null and source is not null and packet_id is not null").distinct()
    one = [F.struct(F.lit(q).alias("quantity"), F.col(q).alias("v")) for q in QUANTITIES]
    r = rows.select("packet_id", "observation_key", F.explode(F.array(*one)).alias("r")).select("packet_id", "observation_key", "r.*")
    (_, rl, rh), (_, sl, sh) = QUANTITIES["rssi"], QUANTITIES["snr"]
    bad = F.when(F.col("quantity") == "rssi", (F.col("v") < rl) | (F.col("v") >= rh)).otherwise((F.col("v") < sl) | (F.col("v") > sh))
    return r.filter(F.isnan("v") | bad).select("packet_id", "observation_key", "quantity", F.lit("impossible").alias("fault"))


def stuck_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).filter("fault = 'stuck'")
