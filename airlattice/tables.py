"""Reading the capture tables and the few conventions all operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: str | None = None
TOPOLOGY_MODES = ("watch-topology", "snapshot", "run")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_id(c: Column | str) -> Column:
    """An id as compared: 64 hex digits in lower case, others as written, empty as null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike("^[0-9A-Fa-f]{64}$"), F.lower(c)).when(c != "", c)


def canonical_ms(c: Column | str) -> Column:
    """Epoch milliseconds of text in the form 2026-10-20T22:18:52.000Z; null for any other text."""
    c = F.col(c) if isinstance(c, str) else c
    ok = F.when(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"), c)
    return F.unix_millis(F.try_to_timestamp(ok, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")))


def topology_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete topology runs: run_id, endpoint, at_ms (captured_at). A run is known by the rows it left in either
    snapshot table; one that left none in both has no captured_at and is no run here."""
    runs = (
        load(spark, sf_dir, "capture_runs")
        .filter((F.col("status") == "complete") & F.col("mode").isin(*TOPOLOGY_MODES))
        .select(F.col("id").alias("run_id"), "endpoint")
        .dropna()
        .distinct()
    )
    seen = [load(spark, sf_dir, t).select("run_id", "captured_at") for t in ("nodes_snapshot", "observers_snapshot")]
    at = seen[0].unionByName(seen[1]).groupBy("run_id").agg(F.min("captured_at").alias("captured_at"))
    return runs.join(at, "run_id").select("run_id", "endpoint", canonical_ms("captured_at").alias("at_ms")).dropna()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where that is unset and all runs on one machine, as in tests, a
    temporary folder. On a cluster a folder of the driver's would be another one on each executor, so that is an error."""
    global _OWN
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not named and _OWN is None:
        _OWN = tempfile.mkdtemp(prefix="airlattice-")
        atexit.register(shutil.rmtree, _OWN, ignore_errors=True)
    return named or f"file://{_OWN}"


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: its lineage ends there, it is computed once, and the
    loss of an executor loses none of it. The table goes when the process ends."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/airlattice-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended before; what is left is in a folder for scratch
        pass
