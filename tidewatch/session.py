"""SparkSession helpers for tests, the bench and small jobs.

On a cluster the session comes from the platform; these helpers only fill
in settings that are unset.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_PKG_DIR = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[int] = set()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "tidewatch") -> SparkSession:
    """A local session tuned for small data: AQE on, UI off, UTC clock."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEWATCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    root = os.path.dirname(_PKG_DIR)
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")]))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``tidewatch`` importable on executors (like ``--py-files``).

    Pandas UDF bodies live in this package, so Python workers must import
    it. The package is zipped once per driver process and distributed by
    Spark's file server.
    """
    sc = spark.sparkContext
    if id(sc) in _SHIPPED:
        return
    zdir = tempfile.mkdtemp(prefix="tidewatch-pkg-")
    zpath = os.path.join(zdir, "tidewatch.zip")
    root = os.path.dirname(_PKG_DIR)
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for d, _, files in os.walk(_PKG_DIR):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(id(sc))


def is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; set a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; it is an error if it is unset there. Local runs (tests, bench) get
    a fresh folder under /tmp.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tidewatch-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


#: Spark removes the files of a job's shuffles when the job has ended
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, label: str = "table", lean: bool = False, **options):
    """Write ``df`` once as parquet under the cluster's checkpoint folder and
    read it back: a lineage cut that costs one columnar write (an RDD
    ``checkpoint()`` serializes rows and recomputes the plan a second time).

    The folder is ``spark.checkpoint.dir`` (shared storage on a cluster);
    each call writes a new uniquely named table. ``lean`` spares the disk: the
    table is compressed by zstd and the files of the job's shuffles, which
    nothing reads once it is written, are removed. ``options`` go to the writer.
    """
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tidewatch-tables/{label}-{uuid.uuid4().hex}"
    write = df.write.mode("errorifexists").options(**({"compression": "zstd"} if lean else {}), **options)
    was = spark.conf.get(_CLEANUP, "false")
    if lean:
        spark.conf.set(_CLEANUP, "true")
    try:
        write.parquet(path)
    finally:
        if lean:
            spark.conf.set(_CLEANUP, was)
    return spark.read.parquet(path)


def drop_table(df) -> None:
    """Delete the files of a table written by ``materialize`` or ``bucketed``,
    once everything that reads it has been written itself."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        if "/tidewatch-tables/" in name:
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bucketed(df, key: str, label: str = "table"):
    """``df`` as a table bucketed by ``key`` in the checkpoint folder: joins and
    groupings on the key do not move its rows again."""
    import uuid

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tidewatch-tables/{name}"
    writer = df.repartition(n, key).write.format("parquet").option("path", path).option("compression", "zstd")
    writer.bucketBy(n, key).saveAsTable(name)
    return spark.table(name)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the files of shuffles that nothing refers to
    any more. It learns of them when the driver collects its garbage, which a
    small driver heap seldom needs to."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
