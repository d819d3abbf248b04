"""Orphan references from signed counts: +n references and +1/-1 existence per key and change, accumulated in order.

Time is cut into the slots between an endpoint's complete snapshots. A key's existence changes only at a slot's start, so
the counts of one key are at most two rows a slot, whatever its number of references: no window holds more than one key's
slots. References without id, without readable time, or before the endpoint's first snapshot (there is nothing yet to hold
them against) are left out. Nulls in keys, repeated rows and empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlattice.operators.timestamps import observation_instants
from airlattice.tables import cut, load, norm_id, topology_runs

#: An orphan key's references may be a large part of all: a key of more than so many, or of more than this part of all where
#: that is more, has as many salts as it takes. So the salted keys are HOT_KEYS at most, whatever the data.
HOT_ROWS, HOT_KEYS = 100_000, 100_000


def existence_deltas(present: DataFrame, last_slot: DataFrame) -> DataFrame:
    """(endpoint, key, slot, existence): +1 where a key appears, -1 where it disappears, from the slots it is present in.

    present: endpoint, key, slot, distinct; last_slot: endpoint, last (number of snapshots).
    """
    w = Window.partitionBy("endpoint", "key").orderBy("slot")  # one row a snapshot
    p = present.join(last_slot, "endpoint").select(
        "endpoint", "key", "slot", "last", F.lag("slot").over(w).alias("before"), F.lead("slot").over(w).alias("after")
    )
    plus = p.filter(F.col("before").isNull() | (F.col("before") < F.col("slot") - 1)).select("endpoint", "key", "slot", F.lit(1).alias("existence"))
    minus = p.filter((F.col("slot") < F.col("last")) & (F.col("after").isNull() | (F.col("after") > F.col("slot") + 1)))
    return plus.unionByName(minus.select("endpoint", "key", (F.col("slot") + 1).alias("slot"), F.lit(-1).alias("existence")))


def orphan_keys(references: DataFrame, deltas: DataFrame) -> DataFrame:
    """(table, endpoint, key, slot, references, orphan_kind) with positive references and zero existence.

    references: table, endpoint, key, slot, one row each; deltas: table, endpoint, key, slot, existence.
    """
    counted = references.groupBy("table", "endpoint", "key", "slot").agg(F.count("*").alias("references"))
    both = counted.withColumn("existence", F.lit(0)).unionByName(deltas.withColumn("references", F.lit(0).cast("bigint")))
    slots = both.groupBy("table", "endpoint", "key", "slot").agg(F.sum("references").alias("references"), F.sum("existence").alias("existence"))
    by_key = Window.partitionBy("table", "endpoint", "key")
    upto = by_key.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    added = F.when(F.col("existence") > 0, 1).otherwise(0)
    s = slots.select("*", F.sum("existence").over(upto).alias("now"), F.sum(added).over(upto).alias("past"), F.sum(added).over(by_key).alias("ever"))
    kind = F.when(F.col("past") > 0, "deleted").when(F.col("ever") > 0, "late").otherwise("missing")
    return s.filter((F.col("references") > 0) & (F.col("now") == 0)).select("table", "endpoint", "key", "slot", "references", kind.alias("orphan_kind"))


def orphan_references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every reference with its slot, and the orphan keys among them."""
    runs = topology_runs(spark, sf_dir)
    order = Window.partitionBy("endpoint").orderBy("at_ms", "run_id")
    runs = cut(runs.withColumn("slot", F.row_number().over(order)))
    starts = runs.groupBy("endpoint").agg(F.array_sort(F.collect_list("at_ms")).alias("starts"))
    last = runs.groupBy("endpoint").agg(F.max("slot").alias("last"))

    # One shuffle by the record's key serves both tables: a hop finds its time beside its observation.
    obs = observation_instants(spark, sf_dir, ["endpoint", "packet_id", "observation_key", "observer_id"])
    record = ["endpoint", "packet_id", "observation_key"]
    obs = obs.filter(F.col("at_ms").isNotNull()).select(*record, F.lit("observations").alias("table"), norm_id("observer_id").alias("key"), "at_ms")
    hops = load(spark, sf_dir, "measured_hops").select(
        *record, F.lit("measured_hops").alias("table"), norm_id("last_hop").alias("key"), F.lit(None).cast("bigint").alias("at_ms")
    )
    rows = obs.unionByName(hops).groupBy(*record).agg(
        F.max("at_ms").alias("at_ms"), F.collect_set(F.struct("table", "key")).alias("refs")
    )
    refs = (
        rows.filter(F.col("at_ms").isNotNull())
        .join(starts, "endpoint")
        .select("*", F.size(F.filter("starts", lambda x: x <= F.col("at_ms"))).alias("slot"))
        .filter(F.col("slot") > 0)
        .select(*record, "at_ms", "slot", F.explode("refs").alias("r"))
        .select(*record, "at_ms", "slot", "r.table", "r.key")
        .filter(F.col("key").isNotNull())
    )

    refs = cut(refs)

    def present(table: str, key: str) -> DataFrame:
        got = load(spark, sf_dir, table).select("run_id", norm_id(key).alias("key")).dropna()
        return got.join(runs, "run_id").select("endpoint", "key", "slot").distinct()

    deltas = existence_deltas(present("nodes_snapshot", "pubkey"), last).withColumn("table", F.lit("measured_hops"))
    deltas = deltas.unionByName(existence_deltas(present("observers_snapshot", "observer_id"), last).withColumn("table", F.lit("observations")))
    return refs, orphan_keys(refs, deltas)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p6_found: ref_table, rec_key, utc_day, orphan_kind."""
    refs, orphans = orphan_references(spark, sf_dir)
    key = ["table", "endpoint", "key", "slot"]
    orphans = cut(orphans)
    total = orphans.agg(F.sum("references")).first()[0] or 0
    most = max(HOT_ROWS, -(-total // HOT_KEYS))
    orphans = orphans.withColumn("salts", F.ceil(F.col("references") / most).cast("int")).drop("references")
    hot = F.broadcast(orphans.filter("salts > 1").drop("orphan_kind"))  # HOT_KEYS rows at most
    salt = F.pmod(F.xxhash64("packet_id", "observation_key"), F.coalesce("salts", F.lit(1))).cast("int")
    salted = refs.join(hot, key, "left").withColumn("salt", salt).drop("salts")
    spread = orphans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return salted.join(spread, ["table", "endpoint", "key", "slot", "salt"]).select(
        F.col("table").alias("ref_table"),
        F.concat_ws("/", F.col("packet_id").cast("string"), F.col("observation_key")).alias("rec_key"),
        F.date_add(F.lit("1970-01-01").cast("date"), F.call_function("div", F.col("at_ms"), F.lit(86_400_000).cast("bigint")).cast("int")).cast("string").alias("utc_day"),
        "orphan_kind",
    )


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, day and kind."""
    return found(spark, sf_dir).groupBy("ref_table", "utc_day", "orphan_kind").agg(F.count("*").alias("n"))
