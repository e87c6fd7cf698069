"""Registered queries: one per operator of the survey inventory.

Each entry takes (spark, sf_dir), derives its stand-in input from the driver tables
and runs the library operator on the *whole* input. ``finish`` only normalizes the
presentation for the oracle compare (doubles rounded to 6 places, arrays as text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacfleet import params
from vacfleet.functions import exprs as X
from vacfleet.operators import asof, debt
from vacfleet.plans.inputs import CHUNK_DAYS, inputs
from vacfleet.session import store, store_at

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def finish(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, 6)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType,
                                                                T.StringType):
            c = F.array_join(c, ",")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


# ---- state and debt ---------------------------------------------------------------
@register("state_as_of")
def q_state_as_of(spark, d):
    i = inputs(spark, d)
    return finish(asof.state_as_of(i.samples, i.snapshots))


@register("previous_sample")
def q_previous_sample(spark, d):
    i = inputs(spark, d)
    return finish(asof.previous_sample(i.samples, i.snapshots))


@register("relation_health")
def q_relation_health(spark, d):
    i = inputs(spark, d)
    return finish(debt.relation_health(i.samples, i.snapshots))


@register("maintenance_debt")
def q_maintenance_debt(spark, d):
    i = inputs(spark, d)
    return finish(debt.maintenance_debt(i.samples, i.snapshots))


@register("horizons")
def q_horizons(spark, d):
    """U1 + D6: the per-class source views unioned, then the oldest horizon per kind."""
    from vacfleet.sources import derive as D
    srcs = debt.horizon_sources(D.horizon_class_sources(inputs(spark, d).events),
                                catalog_classes=("logical_slot",))
    return finish(debt.removability_horizons(srcs))


@register("effective_setting")
def q_effective_setting(spark, d):
    i = inputs(spark, d)
    st = asof.state_as_of(i.samples, i.snapshots)
    hdr = asof.header_at(i.snapshots).select("cluster_id", "snapshot_id",
                                             "def_vac_scale_factor", "def_vac_threshold")
    j = st.join(F.broadcast(hdr), ["cluster_id", "snapshot_id"])
    return finish(j.select(
        "cluster_id", "relid",
        X.reloption("reloptions", debt.VAC_SF).alias("explicit_vac_sf"),
        X.effective_setting("reloptions", debt.VAC_SF, "def_vac_scale_factor", "double")
         .alias("vac_sf"),
        X.effective_setting("reloptions", debt.VAC_THR, "def_vac_threshold", "bigint")
         .alias("vac_threshold")))


# ---- sparse logging and rollups -----------------------------------------------------
from vacfleet.operators import rollup as R  # noqa: E402
from vacfleet.operators import sparse  # noqa: E402


@register("collection_filter")
def q_collection_filter(spark, d):
    i = inputs(spark, d)
    return finish(sparse.collection_filter(i.dense, i.collection_policy))


@register("sparse_log")
def q_sparse_log(spark, d):
    i = inputs(spark, d)
    return finish(sparse.sparse_log(sparse.collection_filter(i.dense, i.collection_policy)))


def _tiers(spark, d):
    i = inputs(spark, d)
    return R.rollup(i.samples, i.snapshots)


@register("rollup_1m")
def q_rollup_1m(spark, d):
    return finish(_tiers(spark, d)[0])


@register("rollup_1h")
def q_rollup_1h(spark, d):
    return finish(_tiers(spark, d)[1])


@register("rollup_1d")
def q_rollup_1d(spark, d):
    return finish(_tiers(spark, d)[2])


@register("rollup_incremental")
def q_rollup_incremental(spark, d):
    """The stored tiers after a first run over all but the newest two days and three
    hours of the history and then a run over everything with the default lookback: the
    buckets of both runs, edge buckets whole."""
    i = inputs(spark, d)
    root = _stream_dir(spark, "tiers")
    cut = i.snapshots.agg(F.max("collected_at")).scalar() - F.expr("INTERVAL 51 HOURS")
    R.update_tiers(i.samples, i.snapshots.filter(F.col("collected_at") <= cut), root)
    tiers = R.update_tiers(i.samples, i.snapshots, root, params.ROLLUP_LOOKBACK_SECONDS)
    out = None
    for name, tier in zip(("1m", "1h", "1d"), tiers):
        t = tier.withColumn("tier", F.lit(name))
        out = t if out is None else out.unionByName(t)
    return finish(out)


@register("raw_sink_roundtrip")
def q_raw_sink_roundtrip(spark, d):
    """The newest half of the stored samples (by snapshot) written after the older half
    through the day-slotted sink, then the newest snapshot once more, past days compacted after
    each: every sample is stored once."""
    from vacfleet.sources import io
    i = inputs(spark, d)
    path = _stream_dir(spark, "raw")
    half = F.floor((i.snapshots.agg(F.min("snapshot_id")).scalar()
                    + i.snapshots.agg(F.max("snapshot_id")).scalar()) / 2)
    last = i.snapshots.agg(F.max("snapshot_id")).scalar()
    day = i.snapshots.agg(F.max("collected_day")).first()[0]
    for part in (F.col("snapshot_id") <= half, F.col("snapshot_id") > half,
                 F.col("snapshot_id") == last):
        io.write_day_slotted(i.samples.filter(part), path)
        io.compact_days(spark, path, i.samples.schema, before=day)
    got = io.read_day_slotted(spark, path, i.samples.schema)
    return finish(got.select("cluster_id", "snapshot_id", "collected_day", "slot", "relid",
                             "n_dead_tup", "n_tup_ins", "n_tup_upd", "autovacuum_count"))


@register("stored_inventory")
def q_stored_inventory(spark, d):
    """The inventory of the tiers that the library has written, from their files."""
    from vacfleet.sources import io
    i = inputs(spark, d)
    root = _stream_dir(spark, "inventory")
    R.update_tiers(i.samples, i.snapshots, root)
    inv = io.stored_inventory(spark, root, {"rollup_1m": "day", "rollup_1h": "month", "rollup_1d": "month"})
    return finish(inv.select("cluster_id", "relation", "partition", "span", "range_start", "range_end", "approx_rows",
                             (F.col("bytes") > 0).alias("has_bytes")))


@register("rollup_as_of")
def q_rollup_as_of(spark, d):
    """Tier 1h as of one day before the newest snapshot."""
    i = inputs(spark, d)
    t = i.snapshots.agg(F.max("collected_at")).scalar() - F.expr("INTERVAL 1 DAY")
    return finish(asof.rollup_as_of(_tiers(spark, d)[1], "1h", t))


@register("rollup_retention")
def q_rollup_retention(spark, d):
    i = inputs(spark, d)
    return finish(R.rollup_retention(i.inventory, i.inventory.agg(F.max("range_end")).scalar()))


@register("raw_retention")
def q_raw_retention(spark, d):
    return finish(R.raw_retention(inputs(spark, d).samples))


@register("partition_inventory")
def q_partition_inventory(spark, d):
    return finish(R.partition_inventory(inputs(spark, d).inventory))


# ---- experiment analytics ------------------------------------------------------------
from vacfleet.operators import experiment as XP  # noqa: E402

# Stand-in roles: arms are the event types of the derived latency log.
ROLES = XP.Roles(defaults="view", expert="click", candidate="purchase", oracle="signup")
WINDOW_S = 86400          # one-day windows over the month of events
SHIFT_S = 15 * 86400      # phase B starts after 15 days


def _p95(spark, d):
    return XP.window_p95(inputs(spark, d).tx_log, WINDOW_S)


def _sides(spark, d):
    """The percentiles of the arms and the best of the sweep, from one stored table."""
    p95 = store(_p95(spark, d), "window_p95")
    return p95.filter(F.col("arm") != ROLES.oracle).drop("probe_sf"), XP.best_of_sweep(p95.filter(F.col("arm") == ROLES.oracle))


def _arm_p95(spark, d):
    return _p95(spark, d).filter(F.col("arm") != ROLES.oracle).drop("probe_sf")


def _best(spark, d):
    return XP.best_of_sweep(_p95(spark, d).filter(F.col("arm") == ROLES.oracle))


def _gaps(spark, d):
    return XP.gap_closed(*_sides(spark, d), ROLES)


def _verdicts(spark, d, gaps=None):
    i = inputs(spark, d)
    return XP.verdict(_gaps(spark, d) if gaps is None else gaps, XP.cost_gates(i.metrics, ROLES),
                      XP.safety_floor(i.metrics, i.run_meta, ROLES))


@register("window_p95")
def q_window_p95(spark, d):
    return finish(_p95(spark, d))


@register("tx_log_roundtrip")
def q_tx_log_roundtrip(spark, d):
    """The transaction log written as per-run text files and read back, then counted per
    arm, seed and day. The text format has no probe scale factor."""
    from vacfleet.sources import io
    root = _stream_dir(spark, "txlog")
    io.write_tx_log(inputs(spark, d).tx_log, root)
    t = io.read_tx_log(spark, f"{root}/*")
    return finish(t.groupBy("arm", "fixture", "scenario", "seed",
                            F.floor(F.col("epoch_s") / 86400).alias("day")).agg(
        F.count("*").alias("n"), F.sum("latency_us").alias("latency_us"),
        F.sum(F.col("epoch_us").cast("long")).alias("epoch_us"), F.max("tx_no").alias("last_tx")))


@register("metrics_roundtrip")
def q_metrics_roundtrip(spark, d):
    """The metrics written as CSV and read back."""
    from vacfleet.sources import io
    path = _stream_dir(spark, "metrics")
    io.write_metrics(inputs(spark, d).metrics, path)
    return finish(io.read_metrics(spark, path).select(
        "sample_id", "sampled_at", "arm", "scenario", "seed", "relname", "dead_frac", "rel_size"))


@register("run_meta_roundtrip")
def q_run_meta_roundtrip(spark, d):
    """The run metadata written as one JSON document a run, and read back."""
    from vacfleet.sources import io
    path = _stream_dir(spark, "runmeta")
    io.write_run_meta(inputs(spark, d).run_meta, path)
    return finish(io.read_run_meta(spark, path).select(
        "run_id", "arm", "fixture", "scenario", "seed", "sample_interval_s",
        "autovacuum_freeze_max_age", "oracle_sf"))


@register("sweep_roundtrip")
def q_sweep_roundtrip(spark, d):
    """The sweep's probes and best windows written as TSV and read back."""
    from vacfleet.sources import io
    path = _stream_dir(spark, "sweep")
    p95 = store(_p95(spark, d), "window_p95").filter(F.col("arm") == ROLES.oracle)
    probes = p95.select(
        F.col("probe_sf").alias("sf"), "win", "p95_us", "tx_count")
    io.write_tsv(probes, f"{path}/probes")
    io.write_tsv(XP.best_of_sweep(p95).select("win", "best_sf", "best_p95_us"), f"{path}/best")
    best = io.read_best(spark, f"{path}/best").groupBy("win").agg(
        F.count("*").alias("n_best"), F.sum("best_p95_us").alias("best_sum"))
    got = io.read_probes(spark, f"{path}/probes").groupBy("win", "sf").agg(
        F.count("*").alias("n"), F.sum("p95_us").alias("p95_sum"), F.sum("tx_count").alias("tx_count"))
    return finish(got.join(best, "win", "left"))


@register("verdict_sink")
def q_verdict_sink(spark, d):
    """The verdict documents written as JSON and read back, one row per scored window of
    each cell."""
    from vacfleet.sources import io
    path = _stream_dir(spark, "verdicts")
    gaps = store(_gaps(spark, d), "gaps")
    io.write_verdicts(_verdicts(spark, d, gaps), gaps, path)
    schema = ("fixture string, scenario string, seed int, verdict string, per_window "
              "array<struct<window: bigint, gap_closed: double, dropped: boolean>>")
    docs = spark.read.schema(schema).json(path)
    return finish(docs.select("fixture", "scenario", "seed", "verdict", F.inline("per_window")))


@register("best_of_sweep")
def q_best_of_sweep(spark, d):
    return finish(_best(spark, d))


@register("gap_closed")
def q_gap_closed(spark, d):
    return finish(_gaps(spark, d))


@register("cost_gates")
def q_cost_gates(spark, d):
    return finish(XP.cost_gates(inputs(spark, d).metrics, ROLES))


@register("safety_floor")
def q_safety_floor(spark, d):
    i = inputs(spark, d)
    return finish(XP.safety_floor(i.metrics, i.run_meta, ROLES))


@register("verdict")
def q_verdict(spark, d):
    return finish(_verdicts(spark, d))


@register("cell_verdict")
def q_cell_verdict(spark, d):
    return finish(XP.cell_verdict(_verdicts(spark, d)))


@register("interval_check")
def q_interval_check(spark, d):
    return finish(XP.interval_check(inputs(spark, d).run_meta))


#: The planned campaign: one scenario of it was never run, nor was seed 3.
SCENARIOS, SEEDS = ("steady", "surge"), (0, 1, 2, 3)
BEST_TABLE = "oracle_best"


def _campaign_plan(spark):
    return XP.campaign_plan(spark, [ROLES.defaults, ROLES.expert, ROLES.candidate], ["events"], SCENARIOS, SEEDS,
                            oracle=ROLES.oracle)


def _complete_runs(spark, d):
    """The runs whose folders hold what they need. The stand-in's sweeps left a best table but for
    the one at the greatest scale factor, which is also the newest by its id."""
    from vacfleet.sources import io
    i = inputs(spark, d)
    root = _stream_dir(spark, "runs")
    io.write_run_meta(i.run_meta, f"{root}/run_meta")
    swept = i.run_meta.filter((F.col("arm") == ROLES.oracle) & (F.col("oracle_sf") < max(params.SF_GRID)))
    (swept.select(F.col("run_id").alias("run"), F.concat_ws("\t", F.lit("0"), F.col("oracle_sf").cast("string")).alias("value"))
     .repartition("run").write.partitionBy("run").text(f"{root}/{BEST_TABLE}"))
    return XP.complete_runs(i.run_meta, io.list_artifacts(spark, root), {ROLES.oracle: BEST_TABLE})


@register("coverage")
def q_coverage(spark, d):
    return finish(XP.coverage(_campaign_plan(spark), _complete_runs(spark, d)))


@register("pending_trials")
def q_pending_trials(spark, d):
    return finish(XP.pending_trials(_campaign_plan(spark), _complete_runs(spark, d)))


@register("newest_run")
def q_newest_run(spark, d):
    return finish(XP.newest_run(_complete_runs(spark, d)))


@register("tolerance_join")
def q_tolerance_join(spark, d):
    """The probe run behind each window's best scale factor (sf equal within 1e-9)."""
    i = inputs(spark, d)
    runs = i.run_meta.filter(F.col("oracle_sf").isNotNull()).select(
        *XP.CELL, "oracle_sf", "run_id")
    j = XP.tolerance_join(_best(spark, d), runs, "best_sf", "oracle_sf", exact=XP.CELL)
    return finish(j.select(*XP.CELL, "win", "best_sf", "best_p95_us", "run_id"))


@register("weighted_median")
def q_weighted_median(spark, d):
    m = inputs(spark, d).metrics
    return finish(XP.weighted_median(m, ["arm", "seed"], "dead_frac", "rel_size", 0.01))


@register("percentiles_tps")
def q_percentiles_tps(spark, d):
    return finish(XP.percentiles_tps(inputs(spark, d).tx_log, WINDOW_S))


@register("steady_state")
def q_steady_state(spark, d):
    keys = ["arm", "fixture", "scenario", "seed"]
    return finish(XP.steady_state(_arm_p95(spark, d), keys, "p95_us"))


@register("band_grading")
def q_band_grading(spark, d):
    keys = ["arm", "fixture", "scenario", "seed"]
    return finish(XP.band_grading(_arm_p95(spark, d), keys, "p95_us"))


@register("phase_split")
def q_phase_split(spark, d):
    g = _gaps(spark, d)
    return finish(XP.phase_split(g, WINDOW_S, SHIFT_S).select(
        *XP.CELL, "win", "phase", "gap_closed"))


@register("safety_monotone")
def q_safety_monotone(spark, d):
    s = inputs(spark, d).samples
    return finish(XP.safety_monotone(s, ["cluster_id", "relid"], "snapshot_id", "relfrozenxid",
                                     "collected_day"))


@register("proxy_outcome_corr")
def q_proxy_outcome_corr(spark, d):
    i = inputs(spark, d)
    keys = ["arm", "fixture", "scenario", "seed"]
    m = i.metrics.withColumn("epoch_s", F.floor(X.epoch_seconds("sampled_at")).cast("long"))
    base = i.tx_log.filter(F.col("arm") != ROLES.oracle).groupBy(*keys).agg(
        F.min("epoch_s").alias("_t0"))
    mw = (m.join(base, keys)
          .withColumn("win", F.floor((F.col("epoch_s") - F.col("_t0")) / WINDOW_S).cast("long")))
    proxy = mw.groupBy(*keys, "win").agg(F.avg("dead_frac").alias("proxy"))
    outcome = _arm_p95(spark, d).select(*keys, "win", F.col("p95_us").cast("double").alias("outcome"))
    return finish(XP.proxy_outcome_corr(proxy, outcome, keys))


# ---- estimate --------------------------------------------------------------------------
from vacfleet.operators import backfill as BF  # noqa: E402
from vacfleet.operators import estimate as EST  # noqa: E402


def rows_at(samples, snapshots, tgt):
    """Rows stored at each cluster's snapshot p. Joining the (broadcast, one row per
    cluster) header on the partition column lets the scan prune to p's day."""
    hdr = asof.header_at(snapshots, tgt).select("cluster_id", "snapshot_id", "collected_day")
    return samples.join(F.broadcast(hdr), ["cluster_id", "snapshot_id", "collected_day"])


def _last_tick(spark, d):
    """The inputs of the newest tick in the form a control loop runs it: the state carried
    through every earlier snapshot, and the tick's current and previous rows from the
    change-detection cache and the rows stored at the tick."""
    i = inputs(spark, d)
    tgt = asof.target_snapshot(i.snapshots)
    cache = asof.latest_rows(i.samples, before=tgt)
    st = store(asof.tick_state(cache, rows_at(i.samples, i.snapshots, tgt), tgt, EST.PREV_COLS), "tick")
    return i, tgt, st, i.carried_state


def _estimate_chain(spark, d):
    """The full calculation of the newest estimate tick."""
    i, tgt, st, prior = _last_tick(spark, d)
    return EST.estimate_calc(i.samples, i.snapshots, prior, tgt, state=st)


@register("control_state")
def q_control_state(spark, d):
    """D11/D12 over the whole history: the state of estimate and classify after the newest
    snapshot, folded through every snapshot (nothing carried in from elsewhere)."""
    i = inputs(spark, d)
    return finish(BF.control_state(i.samples, i.snapshots, i.policy, chunk_days=CHUNK_DAYS))


@register("estimate_tick")
def q_estimate_tick(spark, d):
    return finish(_estimate_chain(spark, d).select(*EST.ESTIMATE_COLS))


@register("colocated_tick")
def q_colocated_tick(spark, d):
    """The newest tick on tables stored in buckets by (cluster, relation): cache, new rows,
    carried state and debt meet without an exchange."""
    from vacfleet.sources import io
    i = inputs(spark, d)
    tgt = asof.target_snapshot(i.snapshots)
    root = _stream_dir(spark, "buckets")
    tag = root.rsplit("-", 1)[1]
    put = lambda name, df: io.write_colocated(df, f"vacfleet_{name}_{tag}", BUCKETS, f"{root}/{name}")
    at = i.snapshots.select("cluster_id", "snapshot_id", "collected_at")
    cache = put("cache", asof.latest_rows(i.samples, before=tgt).join(at, ["cluster_id", "snapshot_id"], "left"))
    new = put("new", rows_at(i.samples, i.snapshots, tgt).select(*[c for c in cache.columns if c != "collected_at"]))
    known = put("known", asof.known_relations(i.samples, tgt))
    prior = put("prior", i.carried_state)
    md = put("debt", debt.maintenance_debt(i.samples, i.snapshots))
    st = asof.tick_state(cache, new, tgt, EST.PREV_COLS, relations=known)
    return finish(EST.estimate_tick(i.samples, i.snapshots, prior, tgt, state=st, md=md))


BUCKETS = 8


@register("counter_deltas")
def q_counter_deltas(spark, d):
    return finish(_estimate_chain(spark, d).select(
        *EST.KEY, "snapshot_id", "boot", "dt", "d_ins", "d_upd", "d_del", "d_dead", "d_reltup"))


@register("cycle_flags")
def q_cycle_flags(spark, d):
    return finish(_estimate_chain(spark, d).select(*EST.KEY, "alpha", "reset", "cycle_boundary"))


@register("ewma_rates")
def q_ewma_rates(spark, d):
    return finish(_estimate_chain(spark, d).select(
        *EST.KEY, "churn_rate", "dead_accum_rate", "growth_rate"))


@register("cycle_stats")
def q_cycle_stats(spark, d):
    return finish(_estimate_chain(spark, d).select(
        *EST.KEY, "cleanup_per_run", "f_peak_current", "f_trigger_ewma", "effectiveness",
        "freeze_progressing", "mxid_freeze_debt"))


@register("saturation")
def q_saturation(spark, d):
    return finish(_estimate_chain(spark, d).select(
        *EST.KEY, "av_running", "debt_high", "eff_low", "horizon_pinned",
        "saturation_candidate", "saturation_streak", "saturation_cause"))


@register("burstiness")
def q_burstiness(spark, d):
    return finish(EST.burstiness(inputs(spark, d).samples))


@register("maintenance_lag")
def q_maintenance_lag(spark, d):
    i = inputs(spark, d)
    hdr = i.snapshots.select("cluster_id", "snapshot_id", "collected_at", "def_vac_threshold",
                             "def_vac_scale_factor", "def_ana_threshold",
                             "def_ana_scale_factor", "def_freeze_max_age")
    series = debt.debt_columns(i.samples.join(hdr, ["cluster_id", "snapshot_id"]))
    return finish(EST.maintenance_lag(series))


# ---- classify, plan, admit -------------------------------------------------------------
from vacfleet.operators import admit as ADM  # noqa: E402
from vacfleet.operators import classify as CL  # noqa: E402
from vacfleet.operators import governance as GOV  # noqa: E402
from vacfleet.operators import health as H  # noqa: E402
from vacfleet.operators import plan as PL  # noqa: E402
from vacfleet.operators import retention as RET  # noqa: E402
from vacfleet.operators import sketch as SK  # noqa: E402

TICK_ID = 1
BUDGET_BYTES = 4_000_000
OSC_WINDOW_S = 3650 * 86400     # the whole action history
TRAILING_S = 6 * 3600


def _classify_chain(spark, d):
    """The full calculation of the newest classify tick."""
    i, tgt, st, prior = _last_tick(spark, d)
    return CL.classify_calc(i.samples, i.snapshots, prior, i.policy, tgt, state=st)


def _classes(spark, d):
    return _classify_chain(spark, d).select(*CL.CLASS_COLS)


def _estimates(spark, d):
    return _estimate_chain(spark, d).select(*EST.ESTIMATE_COLS)


def _both_chains(spark, d):
    """Classify and estimate of the newest tick on the same current and previous rows.
    Returns (classes, estimates, state, target)."""
    i, tgt, st, prior = _last_tick(spark, d)
    return (CL.classify_tick(i.samples, i.snapshots, prior, i.policy, tgt, state=st),
            EST.estimate_tick(i.samples, i.snapshots, prior, tgt, state=st), st, tgt)


def _actuator_state(spark, d):
    return ADM.fold_actions(inputs(spark, d).actions)


def _plan(spark, d):
    i = inputs(spark, d)
    classes, estimates, st, t = _both_chains(spark, d)
    return PL.plan_calc(classes, estimates, i.samples, i.snapshots,
                        _actuator_state(spark, d), i.policy, TICK_ID, t, state=st)


def _clock(spark, d):
    """The governor's clock for the audit-table jobs: the newest recorded action."""
    return inputs(spark, d).actions.agg(F.max("applied_at")).scalar()


@register("classify_tick")
def q_classify_tick(spark, d):
    return finish(_classes(spark, d))


@register("write_mix")
def q_write_mix(spark, d):
    return finish(CL.write_mix(_classify_chain(spark, d)))


@register("classify_trailing")
def q_classify_trailing(spark, d):
    i = inputs(spark, d)
    return finish(CL.classify_trailing(i.samples, i.snapshots, TRAILING_S))


@register("snap_grid")
def q_snap_grid(spark, d):
    li = inputs(spark, d).table("lineitem")
    x = li.select((F.col("l_discount") * 4 + F.col("l_tax")).alias("x")).distinct()
    return finish(x.select("x", X.snap_to_grid("x").alias("snapped")))


@register("plan_decisions")
def q_plan_decisions(spark, d):
    return finish(_plan(spark, d).select(*PL.DECISION_COLS).drop(
        "observation", "prev_state", "desired_state"))


@register("ownership")
def q_ownership(spark, d):
    return finish(_plan(spark, d).select(
        *PL.KEY, X.reloption("reloptions", PL.VAC_SF).alias("explicit_value"),
        "ast_baseline_explicit", "ast_current_value", "sf_user_set"))


def _findings(spark, d):
    i = inputs(spark, d)
    return PL.findings(_estimates(spark, d), i.samples, i.snapshots)


@register("findings")
def q_findings(spark, d):
    return finish(_findings(spark, d).drop("evidence"))


@register("reconcile")
def q_reconcile(spark, d):
    i = inputs(spark, d)
    live = asof.state_and_previous(i.samples, i.snapshots).select(*PL.KEY)
    return finish(PL.reconcile(_findings(spark, d), i.diagnostics, live))


def _oscillating(spark, d, values=False):
    i = inputs(spark, d)
    return PL.oscillation(i.actions, _clock(spark, d), OSC_WINDOW_S, 2, values=values)


@register("oscillation")
def q_oscillation(spark, d):
    return finish(_oscillating(spark, d, values=True))


@register("oscillation_reconcile")
def q_oscillation_reconcile(spark, d):
    return finish(PL.reconcile_oscillation(_oscillating(spark, d), inputs(spark, d).diagnostics))


@register("tick_summary")
def q_tick_summary(spark, d):
    return finish(PL.tick_summary(inputs(spark, d).decisions))


@register("distinct_sketches")
def q_distinct_sketches(spark, d):
    """A5: distinct relations with decisions per month, from stored daily sketches, against the
    exact count: whether the estimate is within three standard errors."""
    dec = inputs(spark, d).decisions
    daily = store(SK.day_sketches(dec, X.epoch_day("created_at"), F.col("relid").cast("long")), "sketches")
    month = daily.withColumn("month", X.epoch_month(X.day_start("day")))
    exact = dec.groupBy("cluster_id", X.epoch_month("created_at").alias("month")).agg(F.count_distinct("relid").alias("n_relations"))
    j = exact.join(SK.united(month, ["cluster_id", "month"]), ["cluster_id", "month"])
    near = F.abs(F.col("estimate") - F.col("n_relations")) <= F.greatest(F.lit(1.0), 3 * SK.ERROR * F.col("n_relations"))
    return finish(j.select("cluster_id", "month", "n_relations", near.alias("within_error")))


@register("static_settings")
def q_static_settings(spark, d):
    i = inputs(spark, d)
    return finish(PL.static_settings(_classes(spark, d), asof.state_as_of(i.samples, i.snapshots)))


@register("sustained_deviation")
def q_sustained_deviation(spark, d):
    return finish(PL.sustained_deviation(inputs(spark, d).decisions))


@register("fold_actions")
def q_fold_actions(spark, d):
    return finish(_actuator_state(spark, d))


def _self_health(spark, d):
    return RET.self_health(inputs(spark, d).inventory, BUDGET_BYTES)


def _metrics(spark, d):
    i = inputs(spark, d)
    return H.governor_metrics(i.actions, i.snapshots, i.ticks, _self_health(spark, d),
                              _oscillating(spark, d), _clock(spark, d))


def _gov_state(spark, d):
    i = inputs(spark, d)
    return H.override_floor(H.evaluate_health(_metrics(spark, d), i.policy), i.override_events)


def _decisions_on_clock(i):
    """The decision log with each tick's time: its newest decision."""
    now = i.decisions.groupBy("cluster_id", "tick_id").agg(F.max("created_at").alias("tick_now"))
    return i.decisions.join(now, ["cluster_id", "tick_id"])


@register("admit_actions")
def q_admit_actions(spark, d):
    """D17 over every tick of the decision log, under the evaluated governor state."""
    i = inputs(spark, d)
    return finish(ADM.admit_actions(_decisions_on_clock(i), asof.state_as_of(i.samples, i.snapshots), _actuator_state(spark, d),
                                    i.actions, _gov_state(spark, d), i.policy))


@register("governor_status")
def q_governor_status(spark, d):
    i = inputs(spark, d)
    classes, estimates, _, _ = _both_chains(spark, d)
    return finish(H.governor_status(classes, estimates, i.decisions,
                                    _actuator_state(spark, d), i.policy))


@register("catalog_health")
def q_catalog_health(spark, d):
    i = inputs(spark, d)
    return finish(H.catalog_health(i.actions, i.snapshots, _clock(spark, d)))


@register("active_diagnostics")
def q_active_diagnostics(spark, d):
    return finish(H.active_diagnostics(inputs(spark, d).diagnostics))


@register("governor_metrics")
def q_governor_metrics(spark, d):
    return finish(_metrics(spark, d))


@register("health_state")
def q_health_state(spark, d):
    return finish(H.evaluate_health(_metrics(spark, d), inputs(spark, d).policy))


@register("override_floor")
def q_override_floor(spark, d):
    return finish(_gov_state(spark, d))


@register("state_transitions")
def q_state_transitions(spark, d):
    return finish(_transitions(inputs(spark, d)))


def _transitions(i):
    """Transitions of all signals, the order-derived logs moved onto the telemetry's clock."""
    from vacfleet.sources import derive as D
    clock = D.on_telemetry_clock
    series = H.health_series(
        i.snapshots, clock(i.actions, "applied_at"), clock(i.ticks, "started_at", "finished_at"),
        clock(i.inventory, "range_start", "range_end"), clock(i.override_events, "event_at"), BUDGET_BYTES, i.policy)
    return H.state_transitions(series)


@register("failure_taxonomy")
def q_failure_taxonomy(spark, d):
    return finish(H.failure_taxonomy(_metrics(spark, d), inputs(spark, d).actions,
                                     _clock(spark, d)))


# ---- retention and governance ------------------------------------------------------------
@register("storage_budget")
def q_storage_budget(spark, d):
    return finish(RET.storage_budget(inputs(spark, d).inventory))


@register("self_health")
def q_self_health(spark, d):
    return finish(_self_health(spark, d))


@register("audit_retention")
def q_audit_retention(spark, d):
    i = inputs(spark, d)
    return finish(RET.audit_retention(i.actions, i.decisions, i.ticks, i.diagnostics,
                                      _clock(spark, d), transitions=_transitions(i)))


@register("shedding_plan")
def q_shedding_plan(spark, d):
    i = inputs(spark, d)
    return finish(RET.shedding_plan(i.inventory, i.diagnostics, i.actions, _clock(spark, d),
                                    BUDGET_BYTES, decisions=i.decisions, ticks=i.ticks))


@register("validate_parameters")
def q_validate_parameters(spark, d):
    return finish(GOV.validate_parameters(inputs(spark, d).policy, BUDGET_BYTES))


@register("policy_history")
def q_policy_history(spark, d):
    i = inputs(spark, d)
    return finish(GOV.policy_history(i.policy, i.policy_next).drop("old_row", "new_row"))


@register("literal_audit")
def q_literal_audit(spark, d):
    return finish(GOV.literal_audit(inputs(spark, d).table("documents"), "doc_id", "text"))


@register("window_p95_lineitem")
def q_window_p95_lineitem(spark, d):
    """X1 at bench scale: line items as transactions (arm = return flag), 7-day windows."""
    return finish(XP.window_p95(inputs(spark, d).tx_log_lineitem, 7 * 86400))


@register("experiment_sampler")
def q_experiment_sampler(spark, d):
    i = inputs(spark, d)
    return finish(XP.sampler(asof.state_as_of(i.samples, i.snapshots), i.actions))


def _tick_split(spark, d):
    """The collected history split at each cluster's newest snapshot: the tick's rows, the cache
    built from everything before it, and the live catalog at the tick."""
    i = inputs(spark, d)
    tgt = F.broadcast(asof.target_snapshot(i.snapshots))        # one row per cluster
    collected = sparse.collection_filter(i.dense, i.collection_policy).join(tgt, "cluster_id")
    at, before = F.col("snapshot_id") == F.col("_p"), F.col("snapshot_id") < F.col("_p")
    cache = sparse.last_state(collected.filter(before).drop("_p"))
    live = i.dense.join(tgt, "cluster_id").filter(at).drop("_p")
    return collected.filter(at).drop("_p"), cache, live


@register("change_join")
def q_change_join(spark, d):
    cur, cache, _ = _tick_split(spark, d)
    return finish(sparse.change_join(cur, cache).select(
        "cluster_id", "relid", "snapshot_id", "n_dead_tup", "n_tup_ins", "autovacuum_count"))


@register("last_state")
def q_last_state(spark, d):
    cur, cache, live = _tick_split(spark, d)
    return finish(sparse.refresh_state(cache, cur.select(*cache.columns), live).select(
        "cluster_id", "relid", "snapshot_id", "n_dead_tup", "n_tup_ins", "autovacuum_count"))


@register("top_debt")
def q_top_debt(spark, d):
    """T5: the 20 most overdue relations (a top-k report: the limit is the feature)."""
    i = inputs(spark, d)
    return finish(debt.maintenance_debt(i.samples, i.snapshots)
                  .orderBy(F.col("vacuum_debt_ratio").desc_nulls_last(), "cluster_id", "relid")
                  .limit(20))


@register("failures_by_class")
def q_failures_by_class(spark, d):
    return finish(H.failures_by_class(inputs(spark, d).actions, _clock(spark, d)))


@register("plannable_snapshot")
def q_plannable_snapshot(spark, d):
    return finish(PL.plannable_snapshot(_estimates(spark, d)))


@register("storage_by_parent")
def q_storage_by_parent(spark, d):
    """U3/J13 over the inventory as a tree of three levels: a table, its years, their months."""
    inv = inputs(spark, d).inventory
    year = F.concat(F.col("relation"), F.lit("_y"), F.date_format("range_start", "yyyy"))
    parts = inv.select("cluster_id", F.col("partition").alias("name"), "bytes", "dead_tuples")
    inner = inv.select("cluster_id", F.explode(F.array("relation", year)).alias("name")).distinct().select(
        "cluster_id", "name", F.lit(8192).cast("long").alias("bytes"),
        F.lit(0).cast("long").alias("dead_tuples"))
    tree = inv.select("cluster_id", F.inline(F.array(
        F.struct(F.col("relation").alias("parent"), year.alias("child")),
        F.struct(year.alias("parent"), F.col("partition").alias("child")))))
    return finish(RET.fold_to_parent(parts.unionByName(inner), tree))


# ---- streaming forms under the same gate ----------------------------------------------------
def _stream_dir(spark, name):
    import uuid

    from vacfleet.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/vacfleet-streams/{name}-{uuid.uuid4().hex[:12]}"


@register("stream_change_detection")
def q_stream_change_detection(spark, d):
    """ST3: the collected history replayed as a file stream, some days a micro-batch, through
    the change detector and its last-state table; the logged changes."""
    from vacfleet.streaming import jobs
    i = inputs(spark, d)
    root = _stream_dir(spark, "st3")
    collected = sparse.collection_filter(i.dense, i.collection_policy)
    chunk = F.floor(F.col("collected_day") / CHUNK_DAYS)
    lo, hi = i.snapshots.agg(F.min(chunk), F.max(chunk)).first()
    for c in range(lo, hi + 1):     # in the order of collection: what has come since the last run is a micro-batch
        collected.filter(chunk == c).write.mode("append").parquet(f"{root}/in")
        src = spark.readStream.schema(collected.schema).parquet(f"{root}/in")
        q = (src.writeStream.foreachBatch(jobs.change_log_batch(f"{root}/state", f"{root}/log"))
             .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
        q.awaitTermination()
    return finish(spark.read.parquet(f"{root}/log").select("cluster_id", "relid", "snapshot_id"))


@register("stream_rollup_1d")
def q_stream_rollup_1d(spark, d):
    """ST1: the 1d tier at the end of a chain of streaming windows (samples, minutes, hours,
    days). Micro-batches of bounded size come in the order of days, so the state holds the rows of
    the lookback and of one micro-batch, not of the whole history. A last row of no cluster, long after
    all others, lets the watermark close every window, as a heartbeat does for a source that has gone quiet."""
    from vacfleet.streaming import jobs
    i = inputs(spark, d)
    root = _stream_dir(spark, "st1d")
    rows = jobs.with_event_time(i.samples, i.snapshots)
    ordered = jobs.store_by_day(rows, f"{root}/in")
    read = spark.read.schema(rows.withColumn("event_day", F.lit(0)).schema).parquet(f"{root}/in")
    last = read.agg(F.max("event_day")).first()[0]
    beat = read.filter(F.col("event_day") == last).drop("event_day").orderBy(F.col("event_time").desc()).limit(1).withColumns(
        {"cluster_id": F.lit(""), "event_time": F.col("event_time") + F.expr("INTERVAL 40 DAYS")})
    ordered &= jobs.store_by_day(store(beat, "beat"), f"{root}/in")
    src = spark.readStream.schema(read.schema)
    if ordered:
        src = src.option("maxBytesPerTrigger", str(jobs.BATCH_BYTES))
    src = src.parquet(f"{root}/in").drop("event_day")
    q = (jobs.coarse_rollup_stream(src, "1d", "1 day").writeStream.outputMode("append").format("parquet")
         .option("path", f"{root}/out").option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return finish(spark.read.parquet(f"{root}/out").filter("cluster_id <> ''").select(*R.TIER_COLS))


@register("stream_rollup_1m")
def q_stream_rollup_1m(spark, d):
    """ST1/ST8: the 1m tier as a watermarked streaming aggregation (1-day lookback) in update
    mode: each micro-batch upserts the windows it changed into the stored tier, so windows
    that the watermark has not closed yet are there too."""
    from vacfleet.streaming import jobs
    i = inputs(spark, d)
    root = _stream_dir(spark, "st1")
    samples = i.samples                                         # stored before its path is read
    base = i.paths["relation_samples"]
    src = spark.readStream.schema(samples.schema).option("basePath", base).parquet(base)
    q = (jobs.minute_rollup_stream(jobs.with_event_time(src, i.snapshots), "1 day")
         .writeStream.outputMode("update")
         .foreachBatch(lambda batch, _: R.upsert_tier(batch, f"{root}/out"))
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return finish(spark.read.parquet(f"{root}/out").select(*R.TIER_COLS))


@register("stream_tier_upsert")
def q_stream_tier_upsert(spark, d):
    """ST2: the collected samples as a stream through the foreachBatch cascade; the daily
    tier that it leaves."""
    from vacfleet.streaming import jobs
    i = inputs(spark, d)
    root = _stream_dir(spark, "st2")
    samples = i.samples
    base = i.paths["relation_samples"]
    src = spark.readStream.schema(samples.schema).option("basePath", base).parquet(base)
    q = (jobs.with_event_time(src, i.snapshots).writeStream
         .foreachBatch(jobs.tier_upsert_batch(f"{root}/tiers", i.snapshots))
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return finish(spark.read.parquet(f"{root}/tiers/rollup_1d").select(*R.TIER_COLS))


def _control_stream(spark, d):
    """Every snapshot header of the history as a stream through the control tick, some days a
    micro-batch, from nothing: the folder of the state tables it leaves."""
    from vacfleet.streaming import jobs
    i = inputs(spark, d)
    root = _stream_dir(spark, "st4")
    i.snapshots, i.samples                                      # stored before paths are read
    chunk = F.floor(F.col("collected_day") / CHUNK_DAYS)
    first = i.snapshots.agg(F.min(chunk)).first()[0]
    last = i.snapshots.agg(F.max(chunk)).first()[0]
    for c in range(first, last + 1):                            # files in the order of collection
        i.snapshots.filter(chunk == c).coalesce(1).write.mode("append").parquet(f"{root}/headers")
    src = (spark.readStream.schema(i.snapshots.schema).option("maxFilesPerTrigger", 1)
           .parquet(f"{root}/headers"))
    q = (src.writeStream.foreachBatch(jobs.control_tick_batch(f"{root}/state", i.paths["relation_samples"], i.policy))
         .option("checkpointLocation", f"{root}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{root}/state"


@register("stream_control_tick")
def q_stream_control_tick(spark, d):
    """ST4/ST5: all headers streamed, state tables carried from micro-batch to micro-batch;
    the newest estimate version."""
    from vacfleet.streaming import jobs
    return finish(jobs.state_version(spark, _control_stream(spark, d), "estimate").select(*EST.ESTIMATE_COLS))


@register("stream_control_state")
def q_stream_control_state(spark, d):
    """ST4/ST5: the state that the stream over all headers leaves: that of ``control_state``."""
    from vacfleet.streaming import jobs
    root = _control_stream(spark, d)
    state = BF.settled(jobs.state_version(spark, root, "state"), jobs.state_version(spark, root, "headers"))
    return finish(state.select(*BF.KEY, "schemaname", "relname",
                               *[F.col("_state").getField(n).alias(n) for n, _ in BF.FIELDS]))


@register("admit_over_ticks")
def q_admit_over_ticks(spark, d):
    """D17 replayed over every tick of the decision log, each against its own clock (the
    tick's newest decision time). No governor state was recorded for these historical
    ticks, so the authority gate is open (a missing state row does not block, as in the
    controller); ``admit_actions`` covers the gate with the evaluated state."""
    i = inputs(spark, d)
    no_state = spark.createDataFrame([], "cluster_id string, state string")
    return finish(ADM.admit_actions(_decisions_on_clock(i), asof.state_as_of(i.samples, i.snapshots), _actuator_state(spark, d),
                                    i.actions, no_state, i.policy))
