"""Session helpers: package shipping, the shared folder, table reading."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the executors, once per application."""
    context = spark.sparkContext
    if getattr(context, "_lectern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    # The driver serves this file to executors; nobody reads the folder itself.
    target = Path(tempfile.mkdtemp(prefix="lectern-")).resolve() / "lectern_src.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(target))
    context._lectern_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared checkpoint folder.

    spark.checkpoint.dir is read from the session; only where it is unset (a
    local session, as in tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = getattr(spark.sparkContext, "_lectern_shared", None)
        if not base and not (spark.sparkContext.master + "[").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir: executors don't see the driver's temporary folder")
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="lectern-shared-")
            spark.sparkContext._lectern_shared = base
    return f"{base.rstrip('/')}/lectern-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: a cut in the
    lineage that survives lost executors. The write's own shuffle files go as
    soon as it has ended, since nothing reads them again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression="zstd")
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def discard(written: DataFrame) -> None:
    """Delete the files of a materialised table, or of those that a union of them names, that nothing reads any more."""
    for part in getattr(written, "_lectern_parts", ()):
        discard(part)
    spark, path = written.sparkSession, getattr(written, "_lectern_path", None)
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage between the rounds of a long operator: only then does Spark remove the shuffle files
    and broadcasts of plans that are gone, and does the heap shrink to what is live."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_session(app: str = "lectern", cpus: str | int | None = None) -> SparkSession:
    """A local session with the settings that the queries expect of any cluster."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session
