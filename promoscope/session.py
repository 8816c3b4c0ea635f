"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


# Settings this library is designed around on a large cluster (pass them when
# building the session; nothing here sets them for you). AQE sizes the shuffle
# partitions from the runtime data: start with many, let AQE coalesce to
# ~256 MB each, split skewed sort-merge join partitions, and broadcast a join
# side only after measuring it small. Value-count tables and round-trip files
# go to the shared folder in ``spark.checkpoint.dir``.
CLUSTER_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "promoscope", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster, build your own session
    (shuffle partitions sized to the data) and pass it in instead."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(_LOCAL_DEFAULTS)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _context(spark: SparkSession):
    try:
        return spark.sparkContext          # classic sessions only
    except Exception:                      # Spark Connect has no SparkContext
        return None


def session_key(spark: SparkSession) -> str:
    """An id that changes when the application (or Connect session) changes."""
    sc = _context(spark)
    if sc is not None:
        return sc.applicationId
    return getattr(spark, "session_id", None) or str(id(spark))


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a local-mode session without one
    (tests, the bench) gets a fresh scratch folder; a cluster session without
    the setting is an error, because executor-local folders do not survive
    executor loss.
    """
    sc = _context(spark)
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = (sc.master if sc is not None else spark.conf.get("spark.master", "")) or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        configured = tempfile.mkdtemp(prefix="promoscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        if sc is None:
            spark.conf.set("spark.checkpoint.dir", configured)
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df, what: str = "table"):
    """Write ``df`` once as Parquet into the shared checkpoint folder and
    return a DataFrame reading it back.

    Used where a plan reads the same intermediate result in several branches
    (Spark would recompute it per branch): the input runs once, and the
    written table cuts the lineage, so a lost executor does not send the job
    back to the fact scan. Prefer it to ``Dataset.checkpoint``, which on an
    uncached plan computes the input twice (its action, then the write)."""
    import uuid
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the application's own checkpoint folder (Spark makes one per application) with every table that
    ``materialize`` wrote there. DataFrames that read them cannot be used afterwards: call it at the end of a job."""
    sc = _context(spark)
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        path = spark._jvm.org.apache.hadoop.fs.Path(current)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
