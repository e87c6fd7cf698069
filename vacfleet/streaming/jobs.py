"""Structured Streaming forms of the stateful behaviours (ST1-ST8).

* ST1/ST2/ST8: tumbling-window rollups with a watermark (late rows within the lookback
  are absorbed), hours chained to minutes and days to hours in one stream, duplicate
  re-deliveries dropped within the watermark, and a ``foreachBatch`` upsert that recomputes
  only the buckets a micro-batch touched.
* ST3: change detection in ``foreachBatch`` against a versioned last-state table.
* ST4/ST5/ST7: ``foreachBatch`` ticks that fold a batch's headers into versioned state tables
  (estimate, classify, findings reconcile), never overwriting the version being read.
* ST6: a per-cluster heartbeat with an event-time timeout.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vacfleet import params as P
from vacfleet.functions import exprs as X
from vacfleet.operators import rollup as R
from vacfleet.operators import sparse
from vacfleet.operators.sparse import SIGNATURE
from vacfleet.session import store, stored_or_none

KEY = ["cluster_id", "relid"]
#: Stored bytes that a micro-batch of a long replay takes. Its state holds the lookback and these rows.
BATCH_BYTES = 64 << 20


# ---- ST1 / ST2 / ST8 -------------------------------------------------------------------
def with_event_time(samples: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Stream-static join of collected rows with their snapshot header (event time =
    collection time, cast to TIMESTAMP because watermarks need it)."""
    hdr = snapshots.select("cluster_id", "snapshot_id", "collected_at", "current_xid",
                           "current_mxid")
    return (samples.join(hdr, ["cluster_id", "snapshot_id"])
            .withColumn("event_time", X.as_ts("collected_at")))


def _tumbling(rows: DataFrame, time: str, length: str, measures: list) -> DataFrame:
    return rows.groupBy("cluster_id", "relid", F.window(time, length)).agg(*measures)


def _buckets(windows: DataFrame, part) -> DataFrame:
    start = X.as_ntz(F.col("window.start"))
    return (windows.withColumn("bucket_start", start).withColumn("bucket_part", part(start))
            .select(*R.TIER_COLS))


def _minutes(rows: DataFrame, lookback: str) -> DataFrame:
    s = (rows.withWatermark("event_time", lookback)
         .dropDuplicatesWithinWatermark(["cluster_id", "snapshot_id", "relid"]))
    return _tumbling(s, "event_time", "1 minute", R.minute_measures())


def minute_rollup_stream(rows: DataFrame, lookback: str = "3 days") -> DataFrame:
    """ST1: the 1m tier as a streaming aggregation. The watermark equals the rollup
    lookback (ST2); re-delivered samples are dropped within it (ST8)."""
    return _buckets(_minutes(rows, lookback), X.epoch_day)


def coarse_rollup_stream(rows: DataFrame, tier: str, lookback: str = "3 days") -> DataFrame:
    """ST1: the 1h or 1d tier in the same stream: hours aggregate the minute windows that the
    watermark has closed, days the closed hours (chained windows, append mode). A bucket comes
    out once, whole, when the watermark passes its end."""
    hours = _tumbling(_minutes(rows, lookback).withColumn("_at", F.window_time("window")), "_at", "1 hour", R.coarse_measures())
    if tier == "1h":
        return _buckets(hours, X.epoch_month)
    if tier != "1d":
        raise ValueError(f"unknown coarse tier: {tier} (use '1h' or '1d')")
    return _buckets(_tumbling(hours.withColumn("_at", F.window_time("window")), "_at", "1 day", R.coarse_measures()), X.epoch_month)


def store_by_day(rows: DataFrame, path: str) -> bool:
    """Add ``rows`` to the files of a stream, in a folder an event day (column ``event_day``), and date
    each day's files a second after those of the day before: a file stream takes files by their dates,
    so micro-batches of any size come in the order of days, and none is late for a watermark of a day or
    more. Returns False where the file system does not keep the dates: the order of files is unknown then."""
    spark = rows.sparkSession
    (rows.withColumn("event_day", F.unix_date(F.to_date("event_time")))
     .write.mode("append").partitionBy("event_day").parquet(path))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    days = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
    number = lambda p: int(n) if (n := p.getName().partition("=")[2]).lstrip("-").isdigit() else -(1 << 31)
    days, files = sorted(days, key=number), []
    first = max((s.getModificationTime() for s in fs.listStatus(root)), default=0) // 1000 * 1000
    for k, day in enumerate(days):
        files += [(s.getPath(), first + 1000 * k) for s in fs.listStatus(day)]
    for at, date in files:
        fs.setTimes(at, date, -1)
    return all(fs.getFileStatus(at).getModificationTime() == date for at, date in files)


def tier_upsert_batch(tier_root: str, snapshots: DataFrame):
    """ST2 as ``foreachBatch``: the A3 cascade for what this micro-batch touched. The 1m
    tier is recomputed from all raw samples of the touched days (absorbing late rows);
    1h and 1d are recomputed for the touched months from the tier just written, so each
    month partition is rewritten whole. Partitions are replaced with dynamic overwrite,
    so a replayed batch after a failure rewrites the same content."""
    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        spark = batch.sparkSession
        raw_path = f"{tier_root}/raw"
        # one folder per micro-batch, overwritten on replay, so a retried batch never
        # duplicates raw rows; re-deliveries across batches are dropped by key below
        (batch.drop("collected_at", "current_xid", "current_mxid", "event_time")
         .write.mode("overwrite").partitionBy("collected_day")
         .parquet(f"{raw_path}/batch_id={batch_id}"))
        # the touched days and months, as semi joins on the partition columns (tiny
        # filtering sides, so Spark prunes the partitions dynamically)
        days = batch.select("collected_day").distinct()
        raw = (spark.read.option("basePath", raw_path).parquet(raw_path)
               .join(days, "collected_day", "left_semi").drop("batch_id")
               .dropDuplicates(["cluster_id", "snapshot_id", "relid"]))
        R.write_tier(R.rollup_minute(raw, snapshots), f"{tier_root}/rollup_1m")
        months = days.select(X.epoch_month(X.day_start("collected_day")).alias("m")).distinct()
        month_days = months.select(F.explode(F.sequence(
            X.epoch_day(X.month_start("m")),
            X.epoch_day(X.month_start(F.col("m") + 1)) - 1)).alias("bucket_part"))
        r1m = (spark.read.parquet(f"{tier_root}/rollup_1m")
               .join(month_days, "bucket_part", "left_semi"))
        R.write_tier(R.coarsen(r1m, "hour"), f"{tier_root}/rollup_1h")
        r1h = (spark.read.parquet(f"{tier_root}/rollup_1h")
               .join(months.withColumnRenamed("m", "bucket_part"), "bucket_part", "left_semi"))
        R.write_tier(R.coarsen(r1h, "day"), f"{tier_root}/rollup_1d")
    return run


# ---- ST3 ------------------------------------------------------------------------------------
def change_log_batch(state_root: str, log_path: str):
    """ST3 as ``foreachBatch``: the rows of a micro-batch whose signature differs from the
    relation's row before, in the batch or in the last-state table, go to the change log.

    The last-state table is versioned by batch, and the log has a folder a batch: a replayed batch
    reads the version before its own and rewrites what it wrote. Re-delivered rows, and rows not
    newer than the relation's last state, are dropped. Runs of equal rows go first; what is left of
    the batch is dealt by relation and sorted once, and what goes on from there are the rows that
    differ from their day's row before, and each relation's newest."""
    columns = [*KEY, "snapshot_id", "collected_day", *SIGNATURE]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = state_version(spark, state_root, "last", batch_id)
        if last is None:
            last = spark.createDataFrame([], batch.select(*columns).schema)
        rows = sparse.run_edges(batch.select(*columns), last).withColumn("_new", F.lit(True))
        # last states and new rows of a relation in one window: its sort serves all that follows
        of, w = W.partitionBy(*KEY), W.partitionBy(*KEY).orderBy("collected_day", "snapshot_id", "_new")
        history = last.select(*columns).withColumn("_new", F.lit(False)).unionByName(rows)
        history = history.withColumn("_seen", F.max(F.when(~F.col("_new"), F.col("snapshot_id"))).over(of))
        history = history.filter(~F.col("_new") | F.col("_seen").isNull() | (F.col("snapshot_id") > F.col("_seen")))
        history = history.withColumns({"_same": F.lag("snapshot_id").over(w), "_n": F.row_number().over(w)}).filter(
            (F.col("_n") == 1) | ~F.col("snapshot_id").eqNullSafe(F.col("_same")))
        history = history.withColumn("_newest", F.lead(F.lit(True)).over(w).isNull())
        kept = store(sparse.day_changes(history.drop("_seen", "_same", "_n"), F.col("_newest")), "change_rows")
        log = sparse.sparse_log(kept).filter("_new").select(*columns)
        log.write.mode("overwrite").parquet(f"{log_path}/batch_id={batch_id}")
        write_version(kept.filter("_newest").select(*columns), state_root, "last", batch_id)
    return run


# ---- ST6 ------------------------------------------------------------------------------------
def _heartbeat(key, batches: Iterator[pd.DataFrame], state: GroupState):
    if state.hasTimedOut:
        (last,) = state.get
        state.remove()
        yield pd.DataFrame({"cluster_id": [key[0]], "last_seen": [pd.Timestamp(last, unit="us")],
                            "status": ["stale"]})
        return
    newest = max(int(pdf["_us"].max()) for pdf in batches)
    if state.exists:
        newest = max(newest, state.get[0])
    state.update((newest,))
    state.setTimeoutTimestamp(newest // 1000 + P.HEALTH_LAG_DEGRADED_SECS * 1000)
    yield pd.DataFrame({"cluster_id": [key[0]], "last_seen": [pd.Timestamp(newest, unit="us")],
                        "status": ["fresh"]})


def heartbeat_stream(snapshots: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """ST6: per cluster a 'fresh' row when snapshots arrive and a 'stale' row once event
    time passes the newest snapshot by more than the degraded observation lag."""
    s = (snapshots.withColumn("event_time", X.as_ts("collected_at"))
         .withWatermark("event_time", watermark)
         .select("cluster_id", "event_time", F.unix_micros("event_time").alias("_us")))
    return s.groupBy("cluster_id").applyInPandasWithState(
        _heartbeat, outputStructType="cluster_id string, last_seen timestamp, status string",
        stateStructType="last_us long", outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout)


# ---- ST4 / ST5 / ST7 --------------------------------------------------------------------------
DIAGNOSTICS = ("cluster_id string, diagnostic_id bigint, relid bigint, inhibitor_class string, "
               "severity string, resolved_at timestamp_ntz")
def write_version(df: DataFrame, state_root: str, name: str, v: int) -> DataFrame:
    """Write one version of a state table and read it back; a replay overwrites it with the
    same rows."""
    path = f"{state_root}/{name}/v={v}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_version(spark: SparkSession, state_root: str, name: str,
                  before: int | None = None) -> DataFrame | None:
    """The newest version of a state table (below ``before``, so that a replayed batch reads
    what it read the first time). None where nothing was ever written; any other failure to
    read is raised."""
    df = stored_or_none(spark, f"{state_root}/{name}")
    if df is None:
        return None
    if before is not None:
        df = df.filter(F.col("v") < before)
    newest = df.agg(F.max("v")).first()[0]      # from the partition folders' names
    return None if newest is None else spark.read.parquet(f"{state_root}/{name}/v={newest}")


def control_tick_batch(state_root: str, samples_path: str, policy: DataFrame | None = None,
                       params: P.Params = P.DEFAULT):
    """``foreachBatch`` body: each micro-batch carries new snapshot headers (whole rows) of any
    clusters, one or many of each. The batch is one chunk of ``operators/backfill.py``: the
    state, the newest stored rows and the end of the header sequence come from the newest
    version, only the samples of the batch's days are read, and every header is a tick. Each
    cluster's last header of the batch gets the estimate rows of all its relations, as a live
    loop that is called once a snapshot writes them, and the findings are reconciled there
    against the open diagnostics (ST7). Clusters without a header keep their rows.

    The version is the batch's id, so a replayed batch rewrites its own version from the same
    earlier one. Headers that come again, or after a later one of their cluster, are no tick."""
    from vacfleet.operators import backfill as BF
    from vacfleet.operators import plan as PL

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prior = {n: state_version(spark, state_root, n, batch_id)
                 for n in ("headers", "rows", "state", "estimate", "diagnostics")}
        state = prior["state"]
        if state is None:
            state = spark.createDataFrame([], BF.STATE_SCHEMA)
        heads = store(BF.numbered_headers(batch, prior["headers"]), "tick_headers")
        days = heads.select("collected_day").distinct()      # few: prunes the samples' partitions
        samples = spark.read.parquet(samples_path).join(F.broadcast(days), "collected_day", "left_semi")
        rows = BF.stored_rows(samples, heads)
        if prior["rows"] is not None:
            rows = prior["rows"].unionByName(rows)
        rows = store(rows, "tick_rows")
        last = heads.groupBy("cluster_id").agg(F.max("_n").alias("_last"))       # one row per cluster
        marked = heads.join(F.broadcast(last), "cluster_id")
        earlier = marked.filter(F.col("_n") < F.col("_last")).drop("_last")
        # every relation ticks at the last header
        final = marked.filter(F.col("_n") == F.col("_last")).withColumn("_moves", F.lit(True)).drop("_last")
        until = rows.join(F.broadcast(last), "cluster_id").filter(F.col("_n") < F.col("_last")).drop("_last")
        state = store(BF.advance(BF.tick_table(BF.moving_ticks(earlier, until, params), policy, params), state, params), "tick_state")
        now = rows.join(F.broadcast(last), "cluster_id")
        now = BF.newest_rows(now.filter(F.col("_n") < F.col("_last")).drop("_last")).unionByName(
            now.filter(F.col("_n") == F.col("_last")).drop("_last"))
        ticks = store(BF.tick_table(BF.moving_ticks(final, now, params), policy, params), "ticks")
        made = BF.estimates(ticks, state, params)
        if prior["estimate"] is not None:      # clusters without a header in this batch
            made = made.unionByName(prior["estimate"].join(F.broadcast(last), "cluster_id", "left_anti"))
        made = write_version(made, state_root, "estimate", batch_id)
        # ST7: open / keep / resolve against the newest diagnostics version
        at = made.join(F.broadcast(last.select("cluster_id")), "cluster_id", "left_semi")
        found = PL.findings_of(at, final, params)
        diags = prior["diagnostics"]
        if diags is None:
            diags = spark.createDataFrame([], DIAGNOSTICS)
        write_version(diagnostics_after(diags, found, at.select(*KEY), final.select("cluster_id", "snapshot_id", "collected_at")),
                      state_root, "diagnostics", batch_id)
        write_version(BF.newest_rows(rows), state_root, "rows", batch_id)
        write_version(BF.header_carry(heads, prior["headers"]), state_root, "headers", batch_id)
        write_version(BF.advance(ticks, state, params), state_root, "state", batch_id)
    return run


def diagnostics_after(diags: DataFrame, found: DataFrame, live: DataFrame,
                      heads: DataFrame) -> DataFrame:
    """The diagnostics table after one reconcile: new findings opened, cleared ones stamped
    resolved at the tick's collection time. ``heads`` has each ticking cluster's snapshot id
    and collection time. A diagnostic's id is a hash of its cluster, relation, class and the
    tick that opened it (the same on a replay); ids are compared within a cluster."""
    from vacfleet.operators import plan as PL
    r = PL.reconcile(found, diags, live)
    at = F.broadcast(heads)                     # one row per cluster
    resolved = (r.filter(F.col("action") == "resolve").join(at, "cluster_id")
                .select("cluster_id", "diagnostic_id", F.col("collected_at").alias("_at")))
    kept = (diags.join(resolved, ["cluster_id", "diagnostic_id"], "left")
            .withColumn("resolved_at", F.coalesce("resolved_at", "_at")).drop("_at"))
    opened = (r.filter(F.col("action") == "open")
              .join(found.select(*KEY, "inhibitor_class", "severity"),
                    [*KEY, "inhibitor_class"], "left").join(at, "cluster_id")
              .select("cluster_id",
                      F.xxhash64("cluster_id", "relid", "inhibitor_class", "snapshot_id")
                      .alias("diagnostic_id"),
                      "relid", "inhibitor_class", "severity",
                      F.lit(None).cast("timestamp_ntz").alias("resolved_at")))
    return kept.select(*opened.columns).unionByName(opened)
