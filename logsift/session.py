"""Session set-up shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings every query relies on.  They are session-scoped, so
# they are (re)applied on whatever session the caller hands in.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # JSON objects with a repeated key keep the last value instead of failing
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``logsift`` importable in the Python workers (grouped pandas
    functions are pickled by reference): the package is zipped once per
    SparkContext and distributed with ``addPyFile`` like ``--py-files``."""
    sc = spark.sparkContext
    if getattr(sc, "_logsift_shipped", False):
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="logsift-pyfiles-"), "logsift.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg_dir):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    sc._logsift_shipped = True


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "logsift", extra: dict | None = None) -> SparkSession:
    """Local/test session: UI off, UTC, AQE on."""
    b = (SparkSession.builder.appName(app_name)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("LOGSIFT_DRIVER_MEMORY", "16g"))
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         # call-site capture for error messages costs a JVM round trip per
         # column function; the parse plan builds hundreds of them
         .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    if master:
        b = b.master(master)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    On a cluster it comes from ``spark.checkpoint.dir``; a private temporary
    folder is only made when nothing is set (local tests).
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="logsift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d
