"""Batch equals stream for the streaming forms (ST1, ST3, ST4/5, ST6)."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from vacfleet.operators import rollup as R
from vacfleet.operators import sparse
from vacfleet.plans.inputs import inputs
from vacfleet.streaming import jobs

SF = "/root/testdata/sf0.001"


def _scratch():
    return tempfile.mkdtemp(prefix="vacfleet-stream-", dir="/tmp")


def _run(q):
    q.awaitTermination()
    assert q.exception() is None


def _same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0
    assert b.select(*cols).exceptAll(a.select(*cols)).count() == 0


def test_minute_rollup_stream_equals_batch(spark):
    i = inputs(spark, SF)
    d = _scratch()
    src = os.path.join(d, "samples")
    i.samples.write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    rows = jobs.with_event_time(stream, i.snapshots)
    q = (jobs.minute_rollup_stream(rows, "1 day").writeStream.outputMode("append")
         .format("memory").queryName("r1m_stream").option("checkpointLocation", os.path.join(d, "ck"))
         .trigger(availableNow=True).start())
    _run(q)
    got = spark.table("r1m_stream")
    want = R.rollup(i.samples, i.snapshots)[0]
    # append mode emits a window once the watermark passes it: all but the newest day
    last = want.agg(F.max("bucket_start")).first()[0] - dt.timedelta(days=1)
    keep = ["cluster_id", "relid", "bucket_start", "sample_count", "max_dead_tup", "max_n_tup_ins"]
    _same(got.filter(F.col("bucket_start") < last).select(*keep),
          want.filter(F.col("bucket_start") < last).select(*keep))


def test_change_log_equals_batch_across_batches(spark):
    """Two micro-batches, the second replayed, with re-delivered and late rows in a third."""
    i = inputs(spark, SF)
    dense = i.dense.drop("relkind", "relpersistence", "relispartition", "extension_owned")
    d = _scratch()
    run = jobs.change_log_batch(os.path.join(d, "state"), os.path.join(d, "log"))
    cut = dense.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY snapshot_id)")).first()[0]
    run(dense.filter(F.col("snapshot_id") <= cut), 0)
    second = dense.filter(F.col("snapshot_id") > cut)
    run(second, 1)
    run(second, 1)                                   # replayed after a failure: idempotent
    run(dense.filter(F.col("snapshot_id") >= cut), 2)      # delivered again: nothing new
    got = spark.read.parquet(os.path.join(d, "log")).select("cluster_id", "relid", "snapshot_id")
    _same(got, sparse.sparse_log(dense).select("cluster_id", "relid", "snapshot_id"))


def test_chained_tiers_equal_batch(spark):
    """Hours in the same stream as the minutes: every bucket that the watermark has closed."""
    i = inputs(spark, SF)
    d = _scratch()
    jobs.with_event_time(i.samples, i.snapshots).write.parquet(os.path.join(d, "in"))
    src = os.path.join(d, "in")
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = (jobs.coarse_rollup_stream(stream, "1h", "1 day").writeStream.outputMode("append").format("memory")
         .queryName("r1h_stream").option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    _run(q)
    want = R.rollup(i.samples, i.snapshots)[1]
    last = want.agg(F.max("bucket_start")).first()[0] - dt.timedelta(days=1, hours=1)
    keep = ["cluster_id", "relid", "bucket_start", "sample_count", "max_dead_tup"]
    got = spark.table("r1h_stream").filter(F.col("bucket_start") < last).select(*keep)
    _same(got, want.filter(F.col("bucket_start") < last).select(*keep))
    with pytest.raises(ValueError):
        jobs.coarse_rollup_stream(stream, "1w")


def test_heartbeat_goes_stale(spark):
    d = _scratch()
    src = os.path.join(d, "snaps")
    t = dt.datetime(2024, 1, 1)
    rows = [("c0", t), ("c1", t), ("c0", t + dt.timedelta(hours=2))]
    spark.createDataFrame(rows, "cluster_id string, collected_at timestamp_ntz").write.parquet(src)
    stream = spark.readStream.schema("cluster_id string, collected_at timestamp_ntz").parquet(src)
    q = (jobs.heartbeat_stream(stream, "1 minute").writeStream.outputMode("append")
         .format("memory").queryName("hb").option("checkpointLocation", os.path.join(d, "ck"))
         .trigger(availableNow=True).start())
    _run(q)
    out = {(r.cluster_id, r.status) for r in spark.table("hb").collect()}
    assert ("c0", "fresh") in out and ("c1", "fresh") in out


def test_control_tick_foreach_batch_equals_backfill(spark):
    """A fleet of two clusters with equal ids, one of them a snapshot behind: the streamed
    ticks (and a replay of the second batch) leave the state of the batch fold."""
    from vacfleet.operators import backfill
    from test_properties import _short_history
    i = inputs(spark, SF)
    d = _scratch()
    snaps_path, samples_path, root = (os.path.join(d, x) for x in ("snaps", "samples", "state"))
    samples, snaps = _short_history(i)
    last = snaps.agg(F.max("snapshot_id")).first()[0]
    snaps = snaps.filter((F.col("cluster_id") == "n1") | (F.col("snapshot_id") < last))
    samples.write.partitionBy("collected_day").parquet(samples_path)
    samples = spark.read.parquet(samples_path)
    snaps.write.parquet(snaps_path)
    snaps = spark.read.parquet(snaps_path)
    run = jobs.control_tick_batch(root, samples_path, i.policy)
    run(snaps.filter(F.col("snapshot_id") < last - 2), 0)      # several headers a cluster
    run(snaps.filter(F.col("snapshot_id") == last - 2), 1)     # one each
    run(snaps.filter(F.col("snapshot_id").between(last - 4, last - 1)), 2)   # some came before
    newest = snaps.filter(F.col("snapshot_id") == last)
    run(newest, 3)
    run(newest, 3)                                   # replayed after a failure: idempotent
    run(newest, 4)                                   # delivered again: no tick
    want = backfill.control_state(samples, snaps, i.policy)
    got = backfill.settled(jobs.state_version(spark, root, "state"), jobs.state_version(spark, root, "headers"))
    fields = [n for n, _ in backfill.FIELDS]
    got = got.select("cluster_id", "relid", *[F.col("_state").getField(n).alias(n) for n in fields])
    _same(got, want.select(got.columns))
    cols = ["cluster_id", "relid", "churn_rate", "f_trigger_ewma", "saturation_streak"]
    _same(jobs.state_version(spark, root, "estimate").select(cols), want.select(cols))


def test_tier_upsert_foreach_batch_equals_batch(spark):
    """ST2: two micro-batches (and a replay of the second) through the foreachBatch
    upsert give the same tiers as the batch cascade over all samples."""
    i = inputs(spark, SF)
    d = _scratch()
    rows = jobs.with_event_time(i.samples, i.snapshots)
    cut = i.samples.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY snapshot_id)")).first()[0]
    run = jobs.tier_upsert_batch(os.path.join(d, "tiers"), i.snapshots)
    run(rows.filter(F.col("snapshot_id") <= cut), 0)
    second = rows.filter(F.col("snapshot_id") > cut)
    run(second, 1)
    run(second, 1)                                   # replayed after a failure: idempotent
    for k, name in enumerate(("rollup_1m", "rollup_1h", "rollup_1d")):
        got = spark.read.parquet(os.path.join(d, "tiers", name))
        want = R.rollup(i.samples, i.snapshots)[k]
        keep = ["cluster_id", "relid", "bucket_start", "sample_count", "max_dead_tup"]
        _same(got.select(*keep), want.select(*keep))


def test_long_replay_of_the_chain_takes_bounded_batches_in_order(spark, tmp_path, monkeypatch):
    """Nine days, delivered newest first, in many micro-batches: no row is late, each bucket is whole."""
    from vacfleet.plans import catalog
    from vacfleet.plans.inputs import Inputs
    kinds = F.array(*[F.lit(k) for k in ("view", "click", "purchase", "signup", "error")])
    events = spark.range(1800, 0, -1, 3).select(
        F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"),
        F.expr("timestamp_ntz '2024-03-01 00:05:00' + make_dt_interval(0, 0, id * 7)").alias("ts"),
        F.element_at(kinds, (F.col("id") * 31 % 5 + 1).cast("int")).alias("event_type"), F.lit(1.0).alias("value"))
    i = Inputs(spark, "/own/replay")
    i.__dict__["events"] = events
    monkeypatch.setattr(catalog, "inputs", lambda *_: i)
    monkeypatch.setattr(catalog, "_stream_dir", lambda *_: str(tmp_path / "st"))
    monkeypatch.setattr(jobs, "BATCH_BYTES", 40_000, raising=False)
    got = catalog.QUERIES["stream_rollup_1d"](spark, "/own/replay")
    want = catalog.finish(R.rollup(i.samples, i.snapshots)[2])
    assert want.agg(F.countDistinct("bucket_start")).first()[0] == 9
    _same(got, want)
    assert len([f for f in os.listdir(tmp_path / "st" / "ck" / "sources" / "0") if f.isdigit()]) >= 3
