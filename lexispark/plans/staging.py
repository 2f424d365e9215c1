"""Intermediate tables that survive the loss of executors, and joins whose broadcasts are checked."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few short columns that may be broadcast: some 50 MB in an executor's hash table.
BROADCAST_ROWS = 500_000

_local: list[str] = []
#: Folder of each application for what it stages; removed when its Python ends.
_runs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only on a local master where that is unset, elsewhere an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not (spark.conf.get("spark.master", "local") or "local").startswith("local[") and spark.conf.get("spark.master", "local") != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    if not _local:
        d = tempfile.TemporaryDirectory(prefix="lexispark-")
        atexit.register(d.cleanup)
        _local.append(d.name)
    return _local[0]


def run_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one. It goes when the driver's Python ends: staged tables live as long as the frames that read them."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark)}/staged-{app}"
        atexit.register(_remove, spark, _runs[app])
    return _runs[app]


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's file system, or by its path if the session is already gone."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended
        if "://" not in path or path.startswith("file://"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and return a frame that reads it: cuts the lineage, needs no cache."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffles of what was staged: it does so once the driver's garbage is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (counted, not estimated), else df as it is.

    Beyond the bound the join is a shuffled one and AQE splits its skewed partitions.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(df: DataFrame, name: str) -> DataFrame:
    """A side that is expected to be small, of labels or systems say: computed once into the shared folder, then broadcast if its rows are few enough."""
    return checked_broadcast(stage(df, name))


#: Bytes up to which a scan of too few splits is dealt out to all cores.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, a scan with filters, dealt out to all cores if it is small and its files give fewer splits than there are cores; else as it is.

    For costly passes over few row groups. A collection of more bytes isn't shuffled for it, whatever its splits.
    """
    plan = df._jdf.queryExecution()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(plan.optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
