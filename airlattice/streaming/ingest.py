"""Incremental ingest of receptions: pages with an overlap, merged exactly once into a bucketed table.

A batch's rows meet the stored rows of the buckets they touch: a key's first row stays, its nulls are filled from later
rows, and a row that only stands for a packet goes when the packet's expanded rows are there. Touched buckets are written
anew beside the old ones, and then one commit file names the current directory of every bucket: a batch counts when its
commit is there, whole or not at all, and a replayed batch is left out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OVERLAP_MS = 15 * 60 * 1000  #: how far a poll reaches back for late arrivals
KEY = ["endpoint", "packet_id", "observation_key"]


def poll_window(cursor_ms: int | None, until_ms: int) -> tuple[int | None, int]:
    """What a poll asks for: from the overlap before the cursor, up to a bound that stays fixed over all pages."""
    return (None if cursor_ms is None else cursor_ms - OVERLAP_MS), until_ms


def reception_key(observation_id, observer_id):
    """A reception's key, by its own id where it has one, else by its observer."""
    return F.coalesce(F.concat(F.lit("id:"), observation_id.cast("string")), F.concat(F.lit("observer:"), observer_id))


def merge(stored: DataFrame, fresh: DataFrame, columns: list[str]) -> DataFrame:
    """Insert or ignore, then enrich. arrival orders rows: stored ones are 0."""
    rows = stored.select(*KEY, *columns, F.lit(0).cast("bigint").alias("arrival")).unionByName(fresh.select(*KEY, *columns, (F.col("arrival") + 1).alias("arrival")))
    merged = rows.groupBy(*KEY).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("arrival"))).alias(c) for c in columns))
    expanded = merged.filter("observation_key like 'id:%'").select("endpoint", "packet_id").distinct()
    alone = merged.filter("observation_key not like 'id:%'").join(expanded, ["endpoint", "packet_id"], "left_anti")
    return merged.filter("observation_key like 'id:%'").unionByName(alone.select(merged.columns))


class ReceptionStore:
    """The table under `path`, in any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str, columns: dict[str, str], buckets: int = 64):
        self.spark, self.path, self.columns, self.buckets = spark, path.rstrip("/"), columns, buckets

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + "/commits")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def committed(self) -> tuple[int, dict[str, str]]:
        """(last batch, directory of each bucket). What a failed batch left behind isn't named, and so isn't there."""
        fs, at = self._fs()
        if not fs.exists(at):
            return -1, {}
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        done = sorted(int(n) for n in names if n.isdigit())
        if not done:
            return -1, {}
        text = self.spark.read.text(f"{self.path}/commits/{done[-1]}").first().value
        return done[-1], json.loads(text)

    def read(self, only: list[int] | None = None) -> DataFrame:
        _, where = self.committed()
        paths = [p for b, p in sorted(where.items()) if only is None or int(b) in only]
        schema = ", ".join(["endpoint string", "packet_id bigint", "observation_key string", *(f"{c} {t}" for c, t in self.columns.items())])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch. batch: the key, the columns, and arrival (rising with time of arrival)."""
        last, where = self.committed()
        if batch_id <= last:
            return
        bucket = F.pmod(F.xxhash64("endpoint", "packet_id"), F.lit(self.buckets))
        batch = batch.withColumn("bucket", bucket).persist()
        try:
            touched = sorted(r.bucket for r in batch.select("bucket").distinct().collect())  # at most `buckets`
            if touched:
                rows = merge(self.read(touched), batch, list(self.columns)).withColumn("bucket", bucket)
                out = f"{self.path}/data/{batch_id}"
                rows.write.mode("overwrite").partitionBy("bucket").parquet(out)
                fs, _ = self._fs()
                for b in touched:
                    p = f"{out}/bucket={b}"
                    if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p)):
                        where[str(b)] = p
                    else:
                        where.pop(str(b), None)
            # A commit is written aside and renamed, so that it is there whole.
            aside = f"{self.path}/commits/_{batch_id}"
            self.spark.createDataFrame([(json.dumps(where),)], "value string").coalesce(1).write.mode("overwrite").text(aside)
            path = self.spark._jvm.org.apache.hadoop.fs.Path
            if not self._fs()[0].rename(path(aside), path(f"{self.path}/commits/{batch_id}")):
                raise OSError(f"the commit of batch {batch_id} could not be put in place")
        finally:
            batch.unpersist()


def receptions(packets: DataFrame, endpoint: str | Column) -> DataFrame:
    """Packets of pages to receptions: a packet's expanded rows, or the packet itself where it has none."""
    own = F.array(F.struct(F.lit(None).cast("bigint").alias("id"), "observer_id", "timestamp", "rssi", "snr"))
    each = F.transform("observations", lambda o: F.struct(o["id"].alias("id"), o["observer_id"].alias("observer_id"), o["timestamp"].alias("timestamp"), o["rssi"].alias("rssi"), o["snr"].alias("snr")))
    arrival = F.coalesce("offset", F.lit(0)) * (1 << 20) + F.col("pos")  # the place in the feed, the same in a replay
    r = packets.select((F.lit(endpoint) if isinstance(endpoint, str) else endpoint).alias("endpoint"), F.col("id").alias("packet_id"), "hash", arrival.alias("arrival"), F.explode(F.when(F.size("observations") > 0, each).otherwise(own)).alias("o"))
    return r.select(
        "endpoint", "packet_id", reception_key(F.col("o.id"), F.col("o.observer_id")).alias("observation_key"), "hash", "o.observer_id", "o.timestamp", "o.rssi", "o.snr", "arrival"
    ).filter("observation_key is not null")


COLUMNS = {"hash": "string", "observer_id": "string", "timestamp": "string", "rssi": "double", "snr": "double"}


def ingest(spark: SparkSession, pages: str, store: ReceptionStore, checkpoint: str, endpoint: str) -> None:
    """Takes all page files that are new, and ends."""
    from airlattice.sources.feeds import packet_pages

    rows = receptions(packet_pages(spark, pages, streaming=True), endpoint)
    query = rows.writeStream.foreachBatch(store.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, lateness: str = "15 minutes", width: str = "1 hour") -> DataFrame:
    """Receptions by hour and observer of a stream with event time `ts`, late ones admitted as long as the overlap."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "observer_id").agg(F.count("*").alias("n"))
