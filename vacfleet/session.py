"""SparkSession construction shared by tests, the bench and the driver entry."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (the telemetry is UTC), ANSI on,
# AQE for runtime coalescing and skew-join splitting. Arrow batches end at a number of bytes:
# Spark's 10,000 rows of whole texts are some 35 MB, held by the JVM and by each Python worker.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session (idempotent) and make the
    package importable by the Python workers."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.ui."):
            continue
        spark.conf.set(k, v)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Distribute this package to the executors' Python workers once per SparkContext
    (what ``--py-files`` does): the streaming state functions run there and are pickled
    by reference. The zip is written next to the checkpoint folder when that is a local
    path, else in the driver's scratch space, and Spark serves it to the executors."""
    import shutil
    import uuid

    import vacfleet

    sc = spark.sparkContext
    if getattr(sc, "_vacfleet_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(vacfleet.__file__))
    ck = spark.conf.get("spark.checkpoint.dir", None) or ""
    base = ck if ck and "://" not in ck and os.path.isdir(ck) else tempfile.gettempdir()
    out = os.path.join(base, f"vacfleet-pyfiles-{uuid.uuid4().hex[:12]}")
    os.makedirs(out, exist_ok=True)
    zip_path = shutil.make_archive(os.path.join(out, "vacfleet"), "zip",
                                   root_dir=os.path.dirname(pkg), base_dir="vacfleet")
    sc.addPyFile(zip_path)
    sc._vacfleet_shipped = True


def _default_driver_memory() -> str:
    """About 60 % of physical memory, between 1 and 16 GB (local mode runs in the driver)."""
    try:
        total = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (ValueError, OSError, AttributeError):
        return "4g"
    return f"{max(1, min(16, int(total * 0.6 / 2**30)))}g"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "vacfleet") -> SparkSession:
    """A local session for tests and the bench (a cluster passes its own session)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("VACFLEET_DRIVER_MEM",
                                                             _default_driver_memory())))
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in spark.checkpoint.dir.

    Only when the setting is unset in local mode (tests) do we create a scratch folder of our
    own; a cluster without the setting is refused, as executors do not share local folders.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="vacfleet-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def store_at(df, name: str):
    """Write ``df`` once as a parquet table in the shared checkpoint folder; return the
    folder and a DataFrame reading it. Cuts lineage, computes the input once
    (``checkpoint()`` would compute it twice), and survives executor loss because the
    files are on shared storage."""
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vacfleet-tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    # the schema is known: reading it back needs no footer-inference job
    return path, spark.read.schema(df.schema).parquet(path)


def store(df, name: str):
    """``store_at`` without the folder."""
    return store_at(df, name)[1]


def stored_or_none(spark: SparkSession, path: str, schema=None):
    """The Parquet table in ``path``, or None where nothing was ever written. Any other
    failure to read is raised."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def cluster_conf(total_cores: int, shuffle_bytes_hint: int | None = None) -> dict[str, str]:
    """Suggested settings for a cluster session (not applied automatically).

    Start with 2-3 shuffle partitions per core (or the shuffle size / 200 MB when known)
    and let AQE coalesce toward 128 MB; split files at 256 MB; let AQE split skewed join
    partitions. A job over 100 TB on 1000 executors x 8 cores starts at about 20000
    shuffle partitions and coalesces from there.
    """
    parts = 3 * total_cores
    if shuffle_bytes_hint:
        parts = max(parts, shuffle_bytes_hint // (200 * 1024 * 1024))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
    }
