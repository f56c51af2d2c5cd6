"""Session construction and shared-storage helpers."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Settings the engine relies on. AQE coalesces small shuffle partitions,
# splits skewed join partitions and turns joins into broadcast joins only
# after it has measured the runtime size of a side. They are runtime SQL
# settings, applied only where the submitted configuration leaves them unset.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    # no broadcast from estimates (they do not count rows made by explode):
    # only sides measured at run time, and explicit hints of bounded tables
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # L1's keys live on executor disks, not in their heaps
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# No web UI (no port beyond what the session itself needs); materialised
# intermediates in the checkpoint folder are deleted once unreferenced.
STATIC_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "paraspark", extra: dict | None = None) -> SparkSession:
    """Session for tests, tools and the bench; safe to call under spark-submit.

    ``master`` is set only when given (spark-submit's master wins otherwise).
    The engine settings and ``shuffle_partitions`` fill only keys the
    submitted configuration does not set, so a cluster job keeps its own
    partition counts; ``extra`` is applied as given.
    """
    extra = dict(extra or {})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in STATIC_CONF.items():
        builder = builder.config(k, v)
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", "8g")
    for k, v in extra.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    submitted = spark.sparkContext.getConf()
    defaults = dict(ENGINE_CONF, **{"spark.sql.shuffle.partitions": str(shuffle_partitions)})
    for k, v in defaults.items():
        if k not in extra and not submitted.contains(k):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the operator sets it to shared storage, and it is an error
    when it is unset; only a local master (tests) gets a scratch folder here.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="paraspark-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialised tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder this library wrote, through the path's own file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def local_folder(spark: SparkSession, path: str) -> str | None:
    """The plain name of a folder on a local or mounted disk; None on any other store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(hadoop).toUri().getPath() if fs.getUri().getScheme() == "file" else None
