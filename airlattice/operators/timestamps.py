"""Written times to instants: one alternation of named groups, one match per value, integer day arithmetic.

Nulls, empty text, text in no known form and values outside the calendar all give null. A wall time that a zone's clock
shows twice, or skips, takes the reading nearest to a hint; without a hint, the one with the offset before the change.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlattice.tables import load, norm_id

CANONICAL = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"

# English month names, and the minutes east of UTC that zone abbreviations stand for.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "IST": 330, "NPT": 345, "JST": 540, "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360,
    "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_DIGIT_ZONE = r"[Zz]|[+-]\d\d:?\d\d"
#: Each form: its groups' prefix and the pattern. A group is named prefix + field; a field is the same text wherever it stands.
_FORMS = {
    "i": r"(?P<iY>\d{4})-(?P<iM>\d\d)-(?P<iD>\d\d)[T ](?P<ih>\d\d):(?P<im>\d\d)(?::(?P<is>\d\d)(?:[.,](?P<if>\d{1,9}))?)?"
    rf" ?(?:(?P<iz>{_DIGIT_ZONE})|(?P<ia>[A-Z]{{1,5}})|\[(?P<in>[A-Za-z0-9_+\-/]+)\])?",
    "c": rf"(?P<cY>\d{{4}})(?P<cM>\d\d)(?P<cD>\d\d)T(?P<ch>\d\d)(?P<cm>\d\d)(?P<cs>\d\d)(?:[.,](?P<cf>\d{{1,9}}))?(?P<cz>{_DIGIT_ZONE})?",
    "s": r"(?P<sA>\d{1,2})/(?P<sB>\d{1,2})/(?P<sY>\d{4}) (?P<sh>\d{1,2}):(?P<sm>\d\d)(?::(?P<ss>\d\d)(?:\.(?P<sf>\d{1,9}))?)?(?: ?(?P<sp>[AaPp])\.?[Mm]\.?)?",
    "u": r"(?P<uN>[A-Z][a-z]{2})[a-z]* (?P<uD>\d{1,2}),? (?P<uY>\d{4}),? (?P<uh>\d{1,2}):(?P<um>\d\d)(?::(?P<us>\d\d))?(?: ?(?P<up>[AaPp])\.?[Mm]\.?)?",
    "r": r"(?:[A-Z][a-z]{2}, ?)?(?P<rD>\d{1,2}) (?P<rN>[A-Z][a-z]{2}) (?P<rY>\d{4}) (?P<rh>\d\d):(?P<rm>\d\d)(?::(?P<rs>\d\d))? (?:(?P<rz>[+-]\d\d:?\d\d)|(?P<ra>[A-Z]{1,5}))",
    "e": r"(?P<eE>\d{9,19})(?:\.(?P<ef>\d{1,9}))?",
}
_PATTERN = r"^\s*(?:" + "|".join(_FORMS.values()) + r")\s*$"
_BY_FIELD = {f: [k + f for k, p in _FORMS.items() if f"(?P<{k}{f}>" in p] for f in "YMDNABhmsfpzanE"}
_PARSED = "struct<utc_ms:bigint,wall_ms:bigint,zone:string>"


def epoch_days(y, m, d):
    """Days since 1970-01-01 in the proleptic Gregorian calendar, by integers only (arrays or numbers)."""
    y2 = y - (m <= 2)
    return 365 * y2 + y2 // 4 - y2 // 100 + y2 // 400 + (153 * ((m + 9) % 12) + 2) // 5 + d - 719469


def days_in_month(y, m):
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return np.where(m == 2, 28 + leap, np.where(np.isin(m, (4, 6, 9, 11)), 30, 31))


def scale_epoch(n, xp=np):
    """An epoch number of unknown unit in milliseconds, by its size: seconds below 1e11, then milli-, micro-, nanoseconds."""
    return xp.where(n < 10**11, n * (n < 10**11) * 1000, xp.where(n < 10**14, n, xp.where(n < 10**17, n // 1000, n // 10**6)))


def parse_array(text: pa.Array, order: pa.Array | None, zone: pa.Array | None, known: pa.Array) -> pa.Array:
    """Each text's instant (utc_ms), or its wall time (wall_ms) with its zone: the one it names, else that of `zone`, or
    UTC without it; only a known one."""
    got = pc.extract_regex(pc.fill_null(text.cast(pa.string()), ""), _PATTERN)
    matched = got.is_valid().to_numpy(zero_copy_only=False)
    cols = {f.name: got.field(i) for i, f in enumerate(got.type)}

    def field(f: str) -> pa.Array:
        """The text of a field in whichever form matched; null where there is none."""
        arrays = [pc.if_else(pc.equal(cols[c], ""), pa.scalar(None, pa.string()), cols[c]) for c in _BY_FIELD[f]]
        out = pc.coalesce(*arrays) if len(arrays) > 1 else arrays[0]
        return pc.if_else(got.is_valid(), out, pa.scalar(None, pa.string()))

    def number(a: pa.Array, missing: int = -1) -> np.ndarray:
        return pc.fill_null(pc.cast(a, pa.int64()), missing).to_numpy(zero_copy_only=False)

    a, b = number(field("A")), number(field("B"))
    if order is None:
        dmy, mdy = (b <= 12) & (a > 12), (a <= 12) & (b > 12)
    else:
        o = pc.fill_null(order, "")
        dmy, mdy = (pc.equal(o, x).to_numpy(zero_copy_only=False) for x in ("dmy", "mdy"))
    y, mo, d = number(field("Y")), number(field("M")), number(field("D"))
    named = pc.fill_null(pc.index_in(field("N"), pa.array(MONTHS)), -1).to_numpy(zero_copy_only=False) + 1
    slashed = a >= 0
    mo = np.where(slashed, np.where(dmy, b, np.where(mdy, a, -1)), np.where(mo >= 0, mo, named))
    d = np.where(slashed, np.where(dmy, a, np.where(mdy, b, -1)), d)
    h, mi, s = number(field("h")), number(field("m")), number(field("s"), 0)
    half = pc.utf8_lower(field("p"))
    is_half, pm = half.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(pc.equal(half, "p"), False).to_numpy(zero_copy_only=False)
    h = np.where(is_half, np.where((h >= 1) & (h <= 12), h % 12 + 12 * pm, -1), h)
    f = number(pc.utf8_slice_codeunits(pc.utf8_rpad(pc.fill_null(field("f"), "0"), 3, "0"), 0, 3), 0)
    epoch = field("E")
    is_epoch, e = epoch.is_valid().to_numpy(zero_copy_only=False), number(epoch)
    valid = matched & (y >= 1) & (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= days_in_month(y, mo)) & (h >= 0) & (h <= 23) & (mi >= 0) & (mi <= 59) & (s <= 59)
    wall = ((epoch_days(y, mo, d) * 24 + h) * 60 + mi) * 60_000 + s * 1000 + f

    digits = pc.replace_substring(field("z"), ":", "")
    numeric = pc.if_else(pc.is_in(digits, pa.array(["Z", "z"])), "+0000", digits)
    sign = np.where(pc.fill_null(pc.starts_with(numeric, "-"), False).to_numpy(zero_copy_only=False), -1, 1)
    part = lambda i: number(pc.utf8_slice_codeunits(pc.fill_null(numeric, "+0000"), i, i + 2), 0)
    minutes = sign * (part(1) * 60 + part(3))
    abbreviation = field("a")
    at = pc.fill_null(pc.index_in(abbreviation, pa.array(list(ABBREVIATIONS))), -1).to_numpy(zero_copy_only=False)
    has_abbr = abbreviation.is_valid().to_numpy(zero_copy_only=False)
    minutes = np.where(has_abbr, np.array([*ABBREVIATIONS.values(), 0])[at], minutes)
    stated = digits.is_valid().to_numpy(zero_copy_only=False) | has_abbr
    valid &= ~has_abbr | (at >= 0)

    utc = np.where(is_epoch, scale_epoch(e) + np.where(e < 10**11, f, 0), wall - minutes * 60_000)
    has_utc = (is_epoch & (e > 0)) | (valid & stated & ~is_epoch)
    has_wall = valid & ~stated & ~is_epoch
    at_zone = pc.coalesce(field("n"), pa.scalar("UTC") if zone is None else zone.cast(pa.string()))
    in_zone = pc.and_(pa.array(has_wall), pc.is_in(at_zone, known))
    at_zone = pc.if_else(in_zone, at_zone, pa.scalar(None, pa.string()))
    return pa.StructArray.from_arrays(
        [pa.array(utc, pa.int64(), mask=~has_utc), pa.array(wall, pa.int64(), mask=~has_wall), at_zone], names=["utc_ms", "wall_ms", "zone"]
    )


def _offset_ms(at_ms: Column, zone: Column) -> Column:
    """Milliseconds that the zone is ahead of UTC at an instant."""
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(at_ms), zone)) - at_ms


def _resolve(parsed: str, hint: Column | None) -> Column:
    """The instant of a parsed struct: a wall time is read in its zone, by the JVM's zone rules."""
    wall, z = F.col(parsed + ".wall_ms"), F.col(parsed + ".zone")
    day = 86_400_000
    # A zone changes its offset at most once in two days: the offsets a day before and after are all that can hold.
    o1, o2 = _offset_ms(wall - day, z), _offset_ms(wall + day, z)
    v1, v2 = _offset_ms(wall - o1, z) == o1, _offset_ms(wall - o2, z) == o2
    second = v2 & ~v1
    if hint is not None:
        second = second | ((v1 == v2) & F.coalesce(F.abs(wall - o2 - hint) < F.abs(wall - o1 - hint), F.lit(False)))
    return F.coalesce(F.col(parsed + ".utc_ms"), F.when(o1 == o2, wall - o1).otherwise(wall - F.when(second, o2).otherwise(o1)))


def with_instants(df: DataFrame, texts: dict[str, str], *, zone: dict[str, str] = {}, order: dict[str, str] = {}, hint: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """df with, for each {text column: new column} in `texts`, the instant in epoch milliseconds that the text writes.

    By text column: zone gives a column with the zone of texts that name none (else UTC), order a column with dmy or
    mdy for dates with slashes (without it, only dates that one order alone allows are read), hint a new column, made
    before, that decides between two readings of a wall time.
    """
    names = df.columns
    known = pa.array(sorted(df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()))
    fields = [f for f in df.schema.fields] + [T.StructField(f"__parsed_{o}", T._parse_datatype_string(_PARSED)) for o in texts.values()]

    def parse(batches):
        for b in batches:
            of = lambda by, t: b.column(names.index(by[t])) if t in by else None
            arrays = [parse_array(b.column(names.index(t)), of(order, t), of(zone, t), known) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*names, *(f"__parsed_{o}" for o in texts.values())])

    df = df.mapInArrow(parse, T.StructType(fields))
    for t, o in texts.items():
        df = df.withColumn(o, _resolve(f"__parsed_{o}", F.col(hint[t]) if t in hint else None))
    return df.drop(*(f"__parsed_{o}" for o in texts.values()))


def epoch_ms(n: Column) -> Column:
    """The column counterpart of scale_epoch; zero, negative and null give null."""
    whole = lambda k: F.call_function("div", n, F.lit(k).cast("bigint"))
    return (
        F.when(n <= 0, None).when(n < 10**11, F.least(n, F.lit(10**11)) * 1000).when(n < 10**14, n)
        .when(n < 10**17, whole(1000)).otherwise(whole(10**6))
    )


def observation_instants(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    """observations with `keep`, seen_ms (first_seen) and at_ms (timestamp) as instants; doubled rows are not removed."""
    obs = load(spark, sf_dir, "observations").select(
        *keep, F.col("endpoint").alias("__ep"), norm_id("observer_id").alias("__ob"), F.col("timestamp").alias("__ts"), F.col("first_seen").alias("__fs")
    )
    clocks = (
        load(spark, sf_dir, "observer_clocks")
        .select(F.col("endpoint").alias("__ep"), norm_id("observer_id").alias("__ob"), "zone_name", "date_order")
        .groupBy("__ep", "__ob")
        .agg(F.min("zone_name").alias("__zone"), F.min("date_order").alias("__order"))
    )
    df = obs.join(clocks, ["__ep", "__ob"], "left")
    return with_instants(df, {"__fs": "seen_ms", "__ts": "at_ms"}, zone={"__ts": "__zone"}, order={"__ts": "__order"}, hint={"__ts": "seen_ms"})


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: rec_table, rec_key, fld, utc_ms of every readable value that is not in the canonical form already."""
    key = F.concat_ws("/", F.col("packet_id").cast("string"), F.col("observation_key"))
    obs = observation_instants(spark, sf_dir, ["packet_id", "observation_key"]).select(
        key.alias("rec_key"),
        F.explode(F.array(
            F.struct(F.lit("timestamp").alias("fld"), F.col("__ts").alias("v"), F.col("at_ms").alias("utc_ms")),
            F.struct(F.lit("first_seen").alias("fld"), F.col("__fs").alias("v"), F.col("seen_ms").alias("utc_ms")),
        )).alias("x"),
    )
    obs = obs.filter(~F.col("x.v").rlike(CANONICAL)).select(F.lit("observations").alias("rec_table"), "rec_key", "x.fld", "x.utc_ms")
    runs = with_instants(load(spark, sf_dir, "capture_runs").select("id", "started_at"), {"started_at": "utc_ms"})
    runs = runs.filter(~F.col("started_at").rlike(CANONICAL)).select(
        F.lit("capture_runs").alias("rec_table"), F.col("id").cast("string").alias("rec_key"), F.lit("started_at").alias("fld"), "utc_ms"
    )
    log = load(spark, sf_dir, "request_log").select(
        F.lit("request_log").alias("rec_table"), F.col("req_id").cast("string").alias("rec_key"), F.lit("sent_ms").alias("fld"),
        "sent_ms", epoch_ms(F.col("sent_ms")).alias("utc_ms"),
    )
    log = log.filter(F.col("utc_ms") != F.col("sent_ms")).drop("sent_ms")
    return obs.unionByName(runs).unionByName(log).filter(F.col("utc_ms").isNotNull()).distinct()
