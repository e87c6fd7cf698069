"""The composed jobs agree with the registered queries of the same operators."""

from pyspark.sql import functions as F

from vacfleet.operators import asof, sparse
from vacfleet.plans import catalog as C
from vacfleet.plans import jobs
from vacfleet.plans.inputs import inputs

SF = "/root/testdata/sf0.001"


def _same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0
    assert b.select(*cols).exceptAll(a.select(*cols)).count() == 0


def test_analysis_matches_queries(spark):
    i = inputs(spark, SF)
    out = jobs.analysis(i.tx_log, i.metrics, i.run_meta, C.WINDOW_S, C.ROLES)
    _same(C.finish(out["verdict"]), C.QUERIES["verdict"](spark, SF))
    _same(C.finish(out["cell_verdict"]), C.QUERIES["cell_verdict"](spark, SF))


def test_daily_jobs_whole_history(spark):
    i = inputs(spark, SF)
    out = jobs.daily_jobs(i.samples, i.snapshots, i.inventory, i.actions, i.decisions, i.ticks,
                          i.diagnostics, C._clock(spark, SF), C.BUDGET_BYTES, lookback_s=None)
    _same(C.finish(out["rollup_1d"]), C.QUERIES["rollup_1d"](spark, SF))
    _same(C.finish(out["shedding_plan"]), C.QUERIES["shedding_plan"](spark, SF))


def test_observe_tick_matches_change_join(spark):
    i = inputs(spark, SF)
    tgt = asof.target_snapshot(i.snapshots)
    collected = sparse.collection_filter(i.dense, i.collection_policy).join(tgt, "cluster_id")
    cache = sparse.last_state(collected.filter("snapshot_id < _p").drop("_p"))
    dense_p = i.dense.join(tgt, "cluster_id").filter("snapshot_id = _p").drop("_p")
    out = jobs.observe_tick(dense_p, cache, i.collection_policy, dense_p)
    keep = ["cluster_id", "relid", "snapshot_id", "n_dead_tup", "n_tup_ins", "autovacuum_count"]
    _same(C.finish(out["samples"].select(*keep)), C.QUERIES["change_join"](spark, SF))
    _same(C.finish(out["cache"].select(*keep)), C.QUERIES["last_state"](spark, SF))


def test_state_and_control_tick(spark):
    i = inputs(spark, SF)
    cache = asof.latest_rows(i.samples, before=asof.target_snapshot(i.snapshots))
    st = jobs.state_tick(i.samples, i.snapshots, None, None, None, cache=cache)
    full = jobs.state_tick(i.samples, i.snapshots, None, None, None)
    _same(st["estimate"], full["estimate"])
    _same(st["class"], full["class"])
    out = jobs.control_tick(st["class"], st["estimate"], i.samples, i.snapshots,
                            C._actuator_state(spark, SF), i.actions, i.ticks, i.diagnostics,
                            i.override_events, i.inventory, i.policy, 1, C._clock(spark, SF),
                            C.BUDGET_BYTES)
    n = out["decisions"].count()
    assert n == st["class"].count()
    assert out["admission"].count() == out["decisions"].filter(F.col("decision") == "adjust").count()
    assert out["governor_state"].count() == 3      # one row a cluster
