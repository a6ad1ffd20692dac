"""Session helpers: configuration, shipping the package to executors, shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: What each application has written to the shared folder.
_MADE: dict[str, list[str]] = {}
#: Rows and bytes of an Arrow batch, at most (a single row may be longer).
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20
#: Spark's setting that shuffle files go when the execution that made them ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "laddersmith", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that the engine relies on (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once for each application.

    Functions then pickle by reference, so a worker that is reused keeps what the
    modules cache (tokenizers, tables).
    """
    # batches between the JVM and Python are bounded in bytes by few rows each: texts may be long
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="laddersmith-")) / "laddersmith_pkg.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(out))
    _SHIPPED.add(app)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; where it is unset on one machine (tests), one of our own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/laddersmith-{os.getuid()}"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again: cuts lineage, survives lost executors.

    The write's own shuffle files go when it ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete all that materialize() has written in this application: to be called when its results aren't read any more."""
    for p in _MADE.pop(spark.sparkContext.applicationId, []):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def made(spark: SparkSession) -> set[str]:
    """What materialize() has written in this application and nothing has swept."""
    return set(_MADE.get(spark.sparkContext.applicationId, []))


def drop(spark: SparkSession, paths: set[str], reader: DataFrame) -> None:
    """Delete of ``paths``, as of made(), all that ``reader`` doesn't read."""
    read = [f.split(":", 1)[-1].lstrip("/") for f in reader.inputFiles()]
    kept = _MADE.get(spark.sparkContext.applicationId, [])
    for p in paths & set(kept):
        own = p.split(":", 1)[-1].lstrip("/") + "/"
        if not any(f.startswith(own) for f in read):
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
            kept.remove(p)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized frame that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    parents = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for p in parents:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """How many partitions CPU-heavy shuffles are dealt to."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
