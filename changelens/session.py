"""Session helpers.

Library code never builds its own session; these helpers exist for tests,
``bench.py`` and small scripts.  On a cluster the session comes from the
platform and already names ``spark.checkpoint.dir`` on shared storage.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every session we build gets.  AQE re-plans joins at runtime
# (broadcast only when the measured side is small, skew-join splitting of
# hot partitions, coalescing of tiny shuffle partitions).
_BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # files of checkpoint() go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "changelens", extra: dict | None = None) -> SparkSession:
    """Local/test session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_BASE_CONF)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor
        conf["spark.driver.memory"] = os.environ.get("CHANGELENS_DRIVER_MEMORY", "8g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``changelens`` importable in Python workers (once per context).

    Operators with a Python stage (``mapInPandas``) reference their functions
    by module; the package is zipped on the driver and distributed with
    ``addPyFile``, as one ships any library to a cluster.
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="changelens-pkg-"), "changelens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(pkg):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    try:
        sc.addPyFile(out)
    except Exception as e:  # noqa: BLE001 - already shipped by another caller
        if "already" not in str(e).lower():
            raise
    _SHIPPED.add(key)


def scale_conf(shuffle_bytes: int, executors_cores: int,
               target_partition_bytes: int = 256 << 20) -> dict:
    """Suggested settings for a cluster run (the platform applies them).

    Shuffle partitions are sized so one partition of the largest shuffle is
    about ``target_partition_bytes`` (AQE coalesces smaller ones and splits
    skewed ones); scan splits stay at 128 MiB.  Example: 100 TB of documents
    whose largest shuffle is ~40 TB -> ~160k partitions.
    """
    parts = max(executors_cores * 2, -(-shuffle_bytes // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(128 << 20),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        **_BASE_CONF,
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is only read.
    Only when it is unset (local tests) a fresh local folder is created.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master or ""
    if not master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="changelens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


@contextmanager
def job_conf(spark: SparkSession, **conf: str):
    """Settings (``.`` as ``__``) for the jobs inside; the old ones hold again afterwards."""
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def shuffles_dropped(spark: SparkSession):
    """Jobs inside delete their shuffle files when they end; else these stay until
    the driver happens to collect its garbage.  For jobs whose result is stored.
    Their Arrow batches are small: whole texts and sets of many rows fill a worker."""
    return job_conf(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true",
                    spark__sql__execution__arrow__maxRecordsPerBatch="1000")


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Used where several branches of one plan consume an expensive
    intermediate: the branches read the written table instead of re-running
    its stages, and the lineage is cut (a lost executor costs a re-read, not
    a recomputation).  Never a machine-local checkpoint.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df):
    """As ``materialize``, but as Parquet, for larger tables: columns not needed later
    are not read, the job's shuffle files go, and ``drop_stored`` deletes the table."""
    spark = df.sparkSession
    path = checkpoint_path(spark, "stored", spark.sparkContext.applicationId, uuid.uuid4().hex)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df) -> None:
    """Delete a stored table; only when no frame still to be computed reads it."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpoint_path(spark: SparkSession, *parts: str) -> str:
    """A sub-folder of the shared checkpoint folder (stream checkpoints, sinks)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return "/".join([base, *parts])


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever storage the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
