"""Sources and sinks.

Every reader declares its schema (no inference) and every writer is partition-aware so
that a rerun only replaces what it recomputed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacfleet.functions import exprs as X
from vacfleet.session import store, stored_or_none

# ---- schemas ---------------------------------------------------------------------------
TX_LOG_FIELDS = T.StructType([
    T.StructField("client", T.IntegerType()), T.StructField("tx_no", T.LongType()),
    T.StructField("latency_us", T.LongType()), T.StructField("script", T.IntegerType()),
    T.StructField("epoch_s", T.LongType()), T.StructField("epoch_us", T.IntegerType()),
    T.StructField("schedule_lag", T.LongType())])

METRICS = T.StructType([
    T.StructField("sample_id", T.LongType()), T.StructField("sampled_at", T.TimestampNTZType()),
    T.StructField("arm", T.StringType()), T.StructField("scenario", T.StringType()),
    T.StructField("seed", T.IntegerType()), T.StructField("relname", T.StringType()),
    T.StructField("dead_frac", T.DoubleType()), T.StructField("rel_size", T.LongType()),
    T.StructField("xid_age", T.LongType()), T.StructField("mxid_age", T.LongType()),
    T.StructField("av_count", T.LongType()), T.StructField("av_last", T.TimestampNTZType()),
    T.StructField("candidate_applied", T.LongType())])

RUN_META = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("arm", T.StringType()),
    T.StructField("fixture", T.StringType()), T.StructField("scenario", T.StringType()),
    T.StructField("seed", T.IntegerType()), T.StructField("preload_rows", T.LongType()),
    T.StructField("duration_s", T.IntegerType()), T.StructField("sample_interval_s", T.IntegerType()),
    T.StructField("pgbench_clients", T.IntegerType()), T.StructField("pgbench_rate", T.IntegerType()),
    T.StructField("oracle_sf", T.DoubleType()), T.StructField("started_at", T.TimestampType()),
    T.StructField("autovacuum_freeze_max_age", T.LongType())])

PROBES = T.StructType([T.StructField("sf", T.DoubleType()), T.StructField("win", T.LongType()),
                       T.StructField("p95_us", T.LongType()), T.StructField("tx_count", T.LongType())])
BEST = T.StructType([T.StructField("win", T.LongType()), T.StructField("best_sf", T.DoubleType()),
                     T.StructField("best_p95_us", T.LongType())])

# run directories are named <arm>-<fixture>-<scenario>-s<seed>[-...]
RUN_DIR = r"/(?:run=)?([^/-]+)-([^/-]+)-([^/-]+)-s([0-9]+)[^/]*/[^/]+$"


# ---- S1 / S2 ----------------------------------------------------------------------------------
def read_telemetry(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   days: tuple[int, int] | None = None) -> DataFrame:
    """Snapshot headers or relation samples stored as parquet partitioned by
    ``collected_day``; the day range becomes a partition filter (pruned in the scan)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    df = r.parquet(path)
    if days is not None:
        df = df.filter(F.col("collected_day").between(days[0], days[1]))
    return df.drop("in_cluster", "in_snapshot")  # partition copies of two columns


# ---- S4 ----------------------------------------------------------------------------------------
def read_tx_log(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated per-transaction logs; arm, fixture, scenario and seed come from the
    run directory of each file (the file-metadata column, no per-file driver loop)."""
    df = (spark.read.option("sep", " ").option("header", "false").schema(TX_LOG_FIELDS)
          .csv(path).withColumn("_path", F.col("_metadata.file_path")))
    return df.select(
        F.regexp_extract("_path", RUN_DIR, 1).alias("arm"),
        F.regexp_extract("_path", RUN_DIR, 2).alias("fixture"),
        F.regexp_extract("_path", RUN_DIR, 3).alias("scenario"),
        F.regexp_extract("_path", RUN_DIR, 4).cast("int").alias("seed"),
        F.lit(None).cast("double").alias("probe_sf"),
        *TX_LOG_FIELDS.fieldNames())


def write_tx_log(tx: DataFrame, root: str) -> None:
    """Writer of the same layout (one folder per run), used by tests and fixtures."""
    run = F.concat_ws("-", "arm", "fixture", "scenario", F.concat(F.lit("s"), F.col("seed")))
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in TX_LOG_FIELDS.fieldNames()])
    (tx.select(run.alias("run"), line.alias("value")).write.mode("overwrite")
       .partitionBy("run").text(root))


# ---- S5 / S6 / S7 / S9 --------------------------------------------------------------------------
# timestamps as the database's CSV export writes them: microseconds, fraction optional
TS_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("header", "true").option("timestampNTZFormat", TS_FORMAT)
            .schema(METRICS).csv(path))


def write_metrics(df: DataFrame, path: str) -> None:
    (df.select(*METRICS.fieldNames()).write.mode("overwrite").option("header", "true")
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))


def read_run_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", "true").schema(RUN_META).json(path)


def write_run_meta(run_meta: DataFrame, root: str) -> None:
    """One JSON document a run, in the run's folder."""
    (run_meta.select(F.col("run_id").alias("run"), F.to_json(F.struct(*[c for c in RUN_META.fieldNames() if c in run_meta.columns]))
                     .alias("value")).repartition("run").write.mode("overwrite").partitionBy("run").text(root))


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, artifact, bytes): what the run folders under ``root`` hold, from file metadata alone
    (``<artifact>/run=<run_id>/<file>``); contents are not read, and empty files do not count."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length"))
    named = files.select(F.regexp_extract("path", r"/([^/]+)/run=([^/]+)/[^/]+$", 2).alias("run_id"),
                         F.regexp_extract("path", r"/([^/]+)/run=([^/]+)/[^/]+$", 1).alias("artifact"), "length")
    return (named.filter((F.col("run_id") != "") & (F.col("length") > 0)).groupBy("run_id", "artifact")
            .agg(F.sum("length").alias("bytes")))


def write_verdicts(verdicts: DataFrame, gaps: DataFrame, path: str) -> None:
    """One JSON document per cell with the per-window detail as an ordered array
    (a cell has as many entries as scored windows, a bounded list)."""
    per = gaps.groupBy("fixture", "scenario", "seed").agg(F.array_sort(F.collect_list(F.struct(
        F.col("win").alias("window"), "expert_p95", F.col("candidate_p95"), "oracle_p95",
        F.round("gap_closed", 6).alias("gap_closed"), "dropped", "drop_reason"))).alias("per_window"))
    (verdicts.join(per, ["fixture", "scenario", "seed"], "left")
     .write.mode("overwrite").option("ignoreNullFields", "false").json(path))


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", "true").schema(PROBES).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def read_best(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", "true").schema(BEST).csv(path)


# ---- S10 ----------------------------------------------------------------------------------
ARRIVALS, DAY_FILES = "arrivals", "days"
#: Bytes of a compacted file.
FILE_BYTES = 128 << 20
#: Most rows of one: its task sorts them, and stored bytes say little about their size in memory.
FILE_ROWS = 1_000_000
#: Order of a day's rows: a relation's samples stand together, so that the smallest and largest
#: values which Parquet keeps of each row group let a reader skip the others.
DAY_ORDER = ["collected_day", "cluster_id", "relid", "snapshot_id"]


def write_day_slotted(samples: DataFrame, path: str) -> None:
    """Raw samples as they arrive, one partition per collection day, cluster and snapshot.
    Writing a snapshot again replaces that snapshot alone; other snapshots of the day and other
    clusters stay. The ring slot stays a column; expiry is ``raw_retention`` dropping whole
    day partitions. Snapshot and cluster also stay as columns (``cluster_id``,
    ``snapshot_id``); their partition copies are ``in_cluster`` and ``in_snapshot``.
    ``compact_days`` turns the many small files of past days into few sorted ones."""
    (samples.withColumn("in_cluster", F.col("cluster_id"))
     .withColumn("in_snapshot", F.col("snapshot_id"))
     .repartition("collected_day", "in_cluster", "in_snapshot")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("collected_day", "in_cluster", "in_snapshot").parquet(f"{path}/{ARRIVALS}"))


def read_day_slotted(spark: SparkSession, path: str, schema: T.StructType,
                     days: tuple[int, int] | None = None) -> DataFrame:
    """The raw samples of ``path``: of a snapshot that was written again after its day was
    compacted, the arrivals; else the compacted rows and what arrived since. The day range is a
    partition filter on both."""
    fresh, old = (stored_or_none(spark, f"{path}/{part}", schema) for part in (ARRIVALS, DAY_FILES))
    if days is not None:
        fresh, old = (x if x is None else x.filter(F.col("collected_day").between(*days)) for x in (fresh, old))
    if fresh is None and old is None:
        return spark.createDataFrame([], schema)
    if old is None or fresh is None:
        return (old if fresh is None else fresh).select(*schema.fieldNames())
    again = fresh.select("collected_day", "cluster_id", "snapshot_id").distinct()
    return (fresh.select(*schema.fieldNames())
            .unionByName(old.select(*schema.fieldNames()).join(again, ["collected_day", "cluster_id", "snapshot_id"], "left_anti")))


def compact_days(spark: SparkSession, path: str, schema: T.StructType, before: int,
                 file_bytes: int = FILE_BYTES) -> None:
    """Rewrite the days before ``before`` that have arrivals as few files, sorted by relation.

    The number of files follows the bytes and rows of the days, not their snapshots. A day's new files are
    complete before its arrivals are deleted: a job that is lost in between leaves rows in both,
    which ``read_day_slotted`` counts once, and the next run compacts the day again."""
    fresh = stored_or_none(spark, f"{path}/{ARRIVALS}", schema)
    if fresh is None:
        return
    days = [r[0] for r in fresh.filter(F.col("collected_day") < before).select("collected_day").distinct().collect()]
    if not days:
        return
    found = read_day_slotted(spark, path, schema).filter(F.col("collected_day").isin(days))
    rows = store(found, "raw_days")          # the folder to be replaced is read here, not while writing
    size = sum(folder_bytes(spark, f"{path}/{part}/collected_day={d}") for part in (ARRIVALS, DAY_FILES) for d in days)
    files = max(1, -(-size // file_bytes), -(-rows.count() // FILE_ROWS))
    (rows.repartitionByRange(files, *DAY_ORDER).sortWithinPartitions(*DAY_ORDER)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("collected_day").parquet(f"{path}/{DAY_FILES}"))
    for d in days:
        _folder(spark, f"{path}/{ARRIVALS}/collected_day={d}", lambda fs, p: fs.delete(p, True))


def _folder(spark: SparkSession, path: str, call):
    """Call Hadoop's file system for a path of any store that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return call(fs, p) if fs.exists(p) else None


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under a folder (0 where there is none)."""
    return int(_folder(spark, path, lambda fs, p: fs.getContentSummary(p).getLength()) or 0)


# ---- S14 ------------------------------------------------------------------------------------------
def stored_inventory(spark: SparkSession, root: str, spans: dict[str, str], schema_name: str = "observe") -> DataFrame:
    """The partition inventory of the tiers stored under ``root``, in the shape that the retention
    planners take: bytes from file metadata, rows from the files' footers (no column is read).
    ``spans`` names each tier's partition span ('day' or 'month')."""
    out = None
    for tier, span in spans.items():
        df = stored_or_none(spark, f"{root}/{tier}")
        if df is None:
            continue
        rows = df.groupBy("cluster_id", "bucket_part").agg(F.count("*").alias("approx_rows"))
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
                 .load(f"{root}/{tier}").select("path", "length"))
        part = files.select(F.url_decode(F.regexp_extract("path", r"/cluster_id=([^/]*)/", 1)).alias("cluster_id"),
                            F.regexp_extract("path", r"/bucket_part=(-?\d+)/", 1).cast("int").alias("bucket_part"), "length")
        sizes = part.groupBy("cluster_id", "bucket_part").agg(F.sum("length").alias("bytes"))
        start = X.day_start("bucket_part") if span == "day" else X.month_start("bucket_part")
        end = X.day_start(F.col("bucket_part") + 1) if span == "day" else X.month_start(F.col("bucket_part") + 1)
        t = (rows.withColumn("cluster_id", F.col("cluster_id").cast("string")).join(sizes, ["cluster_id", "bucket_part"], "left")
             .select("cluster_id", F.lit(schema_name).alias("schema_name"), F.lit(tier).alias("relation"),
                     F.concat(F.lit(f"{tier}_"), X.partition_suffix(start, span)).alias("partition"), F.lit(span).alias("span"),
                     start.alias("range_start"), end.alias("range_end"), "approx_rows",
                     F.coalesce("bytes", F.lit(0)).alias("bytes"), F.lit(0).cast("long").alias("dead_tuples")))
        out = t if out is None else out.unionByName(t)
    if out is None:
        raise ValueError(f"no tier is stored under {root}")
    return out


# ---- J4 -------------------------------------------------------------------------------------------
def write_colocated(df: DataFrame, name: str, buckets: int, path: str,
                    keys: Sequence[str] = ("cluster_id", "relid")) -> DataFrame:
    """Store a table in ``buckets`` files by the hash of its keys, sorted by them: joins of such
    tables on the keys, and aggregations by them, need no exchange. An external table of the
    session's catalog, with its files in ``path``; the number of buckets must be the same for all
    tables that meet."""
    (df.repartition(buckets, *keys).write.mode("overwrite").option("path", path)
     .bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name))
    return df.sparkSession.table(name)


# ---- S12 ------------------------------------------------------------------------------------------
def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str],
           partition_cols: Sequence[str] = ()) -> DataFrame:
    """Keyed upsert as a DataFrame: the rows of ``existing`` in the partitions ``new``
    touches, minus the keys ``new`` replaces, plus ``new``. Write the result with dynamic
    partition overwrite (untouched partitions are neither read nor rewritten)."""
    key = list(key)
    old = existing
    if partition_cols:
        touched = new.select(*partition_cols).distinct()
        old = old.join(touched, list(partition_cols), "left_semi")
    return old.join(new.select(*key), key, "left_anti").unionByName(new)
