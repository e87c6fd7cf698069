"""Experiment scoring over per-transaction latency logs.

One DAG scores every cell (fixture, scenario, seed) at once instead of one process per
cell. Percentiles are exact but never buffer a window's values in one task: histograms in
levels (bucket counts, then exact values inside the one bucket that holds the target rank)
keep each sort bounded by the bucket width, even when one window holds a third of all
transactions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacfleet import params as P
from vacfleet.functions import exprs as X
from vacfleet.operators.sequence import previous_row
from vacfleet.session import store

RUN = ["arm", "fixture", "scenario", "seed", "probe_sf"]
CELL = ["fixture", "scenario", "seed"]


@dataclass(frozen=True)
class Roles:
    """Which arm plays which part in a comparison."""

    defaults: str = "defaults"
    expert: str = "expert"
    candidate: str = "candidate"
    oracle: str = "oracle"


def join_ns(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` where NULL matches NULL (a run key may have no probe sf).
    Spark plans ``<=>`` keys as ordinary hash/sort-merge join keys."""
    keys = list(keys)
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


# ---- exact rank selection -----------------------------------------------------------
def first_reaching(df: DataFrame, groups: Sequence[str], value: str, weight: Column,
                   targets, width: float) -> DataFrame:
    """Per (group, target name): the smallest ``value`` whose cumulative weight (values in
    ascending order) reaches the target ``tgt``.

    ``targets`` is a DataFrame with columns groups + [name, tgt], or a function from the
    per-group totals (groups + [total]) to one, so totals come from the histogram itself.
    Three levels narrow the search: the weights of wide buckets (``WIDE`` times ``width``) find
    the one that holds each target; of the rows only those of that bucket are kept for a (group,
    value) histogram; this is summed per bucket ``floor(value / width)``, and only the values of
    the bucket that holds the target are walked. So what a task holds follows the groups and their
    wide buckets, not the rows, and no sort sees more than the buckets of one group or the values of
    one bucket. Returns the picked values and the totals.
    """
    g = list(groups)
    # the rows are read twice, but never shuffled: both passes are combined or filtered map-side
    rows = df.select(*g, F.col(value).alias("_v"), weight.alias("_w"))
    wide = F.floor(F.floor(F.col("_v") / F.lit(width)) / WIDE)
    coarse = store(rows.groupBy(*g, wide.alias("_b")).agg(F.sum("_w").alias("_bw")), "rank_wide")
    totals = coarse.groupBy(*g).agg(F.sum("_bw").alias("total"))
    # stored: its size tells whether it can be broadcast to the rows
    sel = store(_holding(coarse, targets(totals) if callable(targets) else targets, g), "rank_targets")
    kept = join_ns(rows.withColumn("_b", wide), sel, [*g, "_b"])
    g = [*g, "name"]
    hist = (kept.groupBy(*g, "_v").agg(F.sum("_w").alias("_vw"))
            .withColumn("_b", F.floor(F.col("_v") / F.lit(width))))
    tg = sel.select(*g, (F.col("tgt") - F.col("_before")).alias("tgt"))
    sel = _holding(hist.groupBy(*g, "_b").agg(F.sum("_vw").alias("_bw")), tg, g)
    fine = join_ns(hist, sel, [*g, "_b"])
    fw = W.partitionBy(*g).orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    fine = fine.withColumn("_c2", F.col("_before") + F.sum("_vw").over(fw))
    picked = (fine.filter((F.col("_c2") >= F.col("tgt")) & (F.col("_c2") - F.col("_vw") < F.col("tgt")))
              .select(*g, F.col("_v").alias(value)))
    return picked, totals


#: Buckets of ``first_reaching`` that make a wide one.
WIDE = 64


def _holding(buckets: DataFrame, targets: DataFrame, groups: Sequence[str]) -> DataFrame:
    """For each target (groups + [.., tgt]) the bucket that holds it, and the weight before that."""
    cw = W.partitionBy(*groups).orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
    j = join_ns(buckets.withColumn("_cum", F.sum("_bw").over(cw)), targets, groups)
    return (j.filter((F.col("_cum") - F.col("_bw") < F.col("tgt")) & (F.col("_cum") >= F.col("tgt")))
            .select(*targets.columns, "_b", (F.col("_cum") - F.col("_bw")).alias("_before")))


def nearest_rank_index(n: Column, num: int, den: int) -> Column:
    """int(q*n + 0.5) clamped to [1, n] for q = num/den, in exact integer arithmetic
    ((19n+10) div 20 for the 95th)."""
    k = F.floor((F.lit(2 * num) * n + F.lit(den)) / F.lit(2 * den)).cast("long")
    return F.least(F.greatest(k, F.lit(1)), n)


# ---- X1 / A13 / A20 -------------------------------------------------------------------
def assign_windows(tx: DataFrame, window_s: int, keys: Sequence[str] = RUN) -> DataFrame:
    """Window number from elapsed seconds since the earliest transaction of the run."""
    base = tx.groupBy(*keys).agg(F.min("epoch_s").alias("_t0"))
    j = join_ns(tx, F.broadcast(base), keys)     # one row per run: the transactions stay where they are
    return j.withColumn("win", F.floor((F.col("epoch_s") - F.col("_t0")) / F.lit(window_s))
                        .cast("long")).drop("_t0")


def window_percentiles(tx: DataFrame, window_s: int, ranks: dict[str, tuple[int, int]],
                       keys: Sequence[str] = RUN, width: float = 1024.0) -> DataFrame:
    """Exact nearest-rank latency percentiles and transaction count per run window."""
    w = assign_windows(tx, window_s, keys)
    g = [*keys, "win"]

    def targets(totals):
        tg = None
        for name, (num, den) in ranks.items():
            t = totals.select(*g, F.lit(name).alias("name"),
                              nearest_rank_index(F.col("total"), num, den).alias("tgt"))
            tg = t if tg is None else tg.unionByName(t)
        return tg

    picked, totals = first_reaching(w, g, "latency_us", F.lit(1).cast("long"), targets, width)
    wide = picked.groupBy(*g).agg(*[F.max(F.when(F.col("name") == n, F.col("latency_us")))
                                    .alias(n) for n in ranks])
    return join_ns(totals.withColumnRenamed("total", "tx_count"), wide, g)


def window_p95(tx: DataFrame, window_s: int, keys: Sequence[str] = RUN) -> DataFrame:
    """Per run and window the exact p95 latency (nearest rank, awk rounding) and n."""
    return window_percentiles(tx, window_s, {"p95_us": (19, 20)}, keys).select(
        *keys, "win", "p95_us", "tx_count")


def percentiles_tps(tx: DataFrame, window_s: int, keys: Sequence[str] = RUN) -> DataFrame:
    """p50, p95, p99 and throughput (transactions per second) per run window."""
    out = window_percentiles(tx, window_s, {"p50_us": (1, 2), "p95_us": (19, 20),
                                            "p99_us": (99, 100)}, keys)
    return out.withColumn("tps", F.col("tx_count") / F.lit(float(window_s)))


# ---- X2 ------------------------------------------------------------------------------
def best_of_sweep(probe_p95: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Per cell and window the probe with the lowest p95; ties to the smaller sf."""
    g = probe_p95.groupBy(*keys, "win").agg(
        F.min_by(F.struct("probe_sf", "p95_us"), F.struct("p95_us", "probe_sf")).alias("_b"))
    return g.select(*keys, "win", F.col("_b.probe_sf").alias("best_sf"),
                    F.col("_b.p95_us").alias("best_p95_us"))


# ---- X3 ------------------------------------------------------------------------------
def gap_closed(arm_p95: DataFrame, best: DataFrame, roles: Roles,
               warmup: float = P.WARMUP_FRACTION) -> DataFrame:
    """X3 (+J10, W5): windows common to expert, candidate and oracle; the first
    max(1, int(0.2 N)) by rank are warm-up; a window with expert <= best is dropped."""
    sides = arm_p95.select("arm", *CELL, "win", "p95_us").unionByName(
        best.select(F.lit(roles.oracle).alias("arm"), *CELL, "win", F.col("best_p95_us").alias("p95_us")))
    of = {roles.expert: "expert_p95", roles.candidate: "candidate_p95", roles.oracle: "oracle_p95"}
    # one aggregate by cell and window instead of a join per side
    j = sides.filter(F.col("arm").isin(*of)).groupBy(*CELL, "win").agg(
        *[F.max(F.when(F.col("arm") == a, F.col("p95_us"))).alias(c) for a, c in of.items()]).dropna(subset=list(of.values()))
    cw = W.partitionBy(*CELL)
    j = (j.withColumn("_n", F.count("*").over(cw))
          .withColumn("_rk", F.row_number().over(cw.orderBy("win")))
          .withColumn("_warm", F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(warmup))
                                          .cast("long"))))
    denom = F.col("expert_p95") - F.col("oracle_p95")
    gc = (F.col("expert_p95") - F.col("candidate_p95")).cast("double") / denom.cast("double")
    return j.select(
        *CELL, "win", "expert_p95", "candidate_p95", "oracle_p95",
        (F.col("_rk") <= F.col("_warm")).alias("warmup"),
        F.col("_n").alias("total_windows"), F.col("_warm").alias("warmup_discarded"),
        F.when(F.col("_rk") > F.col("_warm"), F.when(denom > 0, gc)).alias("gap_closed"),
        F.when(F.col("_rk") > F.col("_warm"), denom <= 0).alias("dropped"),
        F.when((F.col("_rk") > F.col("_warm")) & (denom <= 0), F.lit("denom_le_zero"))
         .alias("drop_reason"))


# ---- X4 / X5 --------------------------------------------------------------------------
def cost_gates(metrics: DataFrame, roles: Roles, budget: int = P.DAILY_MUTATION_BUDGET,
               factor: int = P.AV_CEILING_FACTOR) -> DataFrame:
    """X4 (+A16): final cumulative counters per cell and the two cost ceilings."""
    m = metrics.groupBy(*CELL).agg(
        F.coalesce(F.max(F.when(F.col("arm") == roles.defaults, F.col("av_count"))), F.lit(0))
         .alias("defaults_av_count"),
        F.coalesce(F.max(F.when(F.col("arm") == roles.candidate, F.col("av_count"))), F.lit(0))
         .alias("candidate_av_count"),
        F.coalesce(F.max(F.when(F.col("arm") == roles.candidate, F.col("candidate_applied"))),
                   F.lit(0)).alias("candidate_applied"))
    av = (F.col("defaults_av_count") > 0) & (F.col("candidate_av_count") > factor * F.col("defaults_av_count"))
    mut = F.col("candidate_applied") > budget
    return m.select(*CELL, "defaults_av_count", "candidate_av_count", "candidate_applied",
                    av.alias("av_ceiling_breach"), mut.alias("mutation_ceiling_breach"),
                    (av | mut).alias("cost_ceiling_breach"))


def safety_floor(metrics: DataFrame, run_meta: DataFrame, roles: Roles) -> DataFrame:
    """Worst freeze age of the defaults and candidate arms against the freeze limit
    (first non-NULL of the defaults run, then the candidate run); not evaluated when the
    limit is unknown."""
    arms = [roles.defaults, roles.candidate]
    worst = (metrics.filter(F.col("arm").isin(*arms)).groupBy(*CELL)
             .agg(F.max("xid_age").alias("_w")))
    lim = (run_meta.filter(F.col("arm").isin(*arms)).groupBy(*CELL).agg(
        F.coalesce(F.max(F.when(F.col("arm") == roles.defaults, F.col("autovacuum_freeze_max_age"))),
                   F.max(F.when(F.col("arm") == roles.candidate, F.col("autovacuum_freeze_max_age"))))
         .alias("freeze_max_age")))
    cells = metrics.select(*CELL).unionByName(run_meta.select(*CELL)).distinct()
    j = cells.join(worst, CELL, "left").join(lim, CELL, "left")
    ev = F.col("freeze_max_age").isNotNull()
    return j.select(*CELL, "freeze_max_age",
                    F.coalesce(F.col("_w"), F.lit(0)).cast("long").alias("worst_xid_age"),
                    ev.alias("safety_floor_evaluated"),
                    F.when(ev, F.coalesce(F.col("_w"), F.lit(0)) < F.col("freeze_max_age"))
                     .alias("safety_floor_holds"))


def _ladder(median: Column, safety_fail: Column, cost: Column) -> Column:
    return (F.when(median.isNull(), F.lit("inconclusive"))
            .when(safety_fail, F.lit("fail"))
            .when(cost & (median > 0), F.lit("fail"))
            .when(median < 0, F.lit("fail"))
            .when(median >= P.STRONG_PASS_GAP, F.lit("strong_pass"))
            .otherwise(F.lit("pass")))


def _r6(c: Column) -> Column:
    return F.round(c, 6) + F.lit(0.0)   # + 0.0 turns -0.0 into 0.0


# ---- X6 / X7 --------------------------------------------------------------------------
def verdict(gaps: DataFrame, gates: DataFrame, safety: DataFrame) -> DataFrame:
    """Per cell the verdict ladder (inconclusive, fail, pass, strong_pass) with counts.
    The median uses the unrounded gaps; the output is rounded to 6 places."""
    s = gaps.groupBy(*CELL).agg(
        F.first("total_windows").alias("total_windows"),
        F.first("warmup_discarded").alias("warmup_discarded"),
        F.count_if(~F.col("warmup")).alias("graded_windows"),
        F.count_if(F.col("dropped")).alias("windows_dropped_denom"),
        F.count("gap_closed").alias("windows_scored"),
        F.percentile("gap_closed", 0.5).alias("_med"))
    j = s.join(gates, CELL, "left").join(safety, CELL, "left")
    safety_fail = F.coalesce(F.col("safety_floor_evaluated") & ~F.col("safety_floor_holds"),
                             F.lit(False))
    cost = F.coalesce(F.col("cost_ceiling_breach"), F.lit(False))
    return j.select(*CELL, _ladder(F.col("_med"), safety_fail, cost).alias("verdict"),
                    _r6(F.col("_med")).alias("median_gap_closed"),
                    "total_windows", "warmup_discarded", "graded_windows",
                    "windows_dropped_denom", "windows_scored", "cost_ceiling_breach",
                    "av_ceiling_breach", "mutation_ceiling_breach", "defaults_av_count",
                    "candidate_av_count", "candidate_applied", "safety_floor_evaluated",
                    "safety_floor_holds", "freeze_max_age", "worst_xid_age")


def cell_verdict(verdicts: DataFrame) -> DataFrame:
    """Across seeds the median and interpolated IQR of the per-seed medians and the
    worst case of every gate."""
    g = verdicts.groupBy("fixture", "scenario").agg(
        F.count("*").alias("n_seeds"),
        F.percentile("median_gap_closed", 0.5).alias("_m"),
        F.percentile("median_gap_closed", 0.25).alias("_lo"),
        F.percentile("median_gap_closed", 0.75).alias("_hi"),
        F.bool_or(F.coalesce("cost_ceiling_breach", F.lit(False))).alias("any_cost_ceiling_breach"),
        F.bool_or(F.coalesce("av_ceiling_breach", F.lit(False))).alias("any_av_ceiling_breach"),
        F.bool_or(F.coalesce("mutation_ceiling_breach", F.lit(False)))
         .alias("any_mutation_ceiling_breach"),
        F.bool_or(F.coalesce(F.col("safety_floor_evaluated") & ~F.col("safety_floor_holds"),
                             F.lit(False))).alias("any_safety_floor_violation"))
    return g.select(
        "fixture", "scenario",
        _ladder(F.col("_m"), F.col("any_safety_floor_violation"),
                F.col("any_cost_ceiling_breach")).alias("cell_verdict"),
        _r6(F.col("_m")).alias("median_gap_closed"), _r6(F.col("_lo")).alias("iqr_low"),
        _r6(F.col("_hi")).alias("iqr_high"), "n_seeds", "any_cost_ceiling_breach",
        "any_av_ceiling_breach", "any_mutation_ceiling_breach", "any_safety_floor_violation",
        (F.col("any_cost_ceiling_breach") | F.col("any_safety_floor_violation"))
         .alias("any_gate_failure"))


# ---- X8 / X9 / J11 / J15 ----------------------------------------------------------------
def interval_check(run_meta: DataFrame) -> DataFrame:
    """All runs of a cell must share one window size."""
    g = run_meta.groupBy(*CELL).agg(F.count("*").alias("n_runs"),
                                    F.count_distinct("sample_interval_s").alias("n_intervals"),
                                    F.min("sample_interval_s").alias("_lo"))
    return g.select(*CELL, "n_runs", "n_intervals",
                    F.when(F.col("n_intervals") == 1, F.col("_lo")).alias("window_s"),
                    (F.col("n_intervals") == 1).alias("consistent"))


def campaign_plan(spark: SparkSession, arms: Sequence[str], fixtures: Sequence[str],
                  scenarios: Sequence[str], seeds: Sequence[int], oracle: str | None = None) -> DataFrame:
    """The planned trials of a campaign (arm, fixture, scenario, seed): every arm, and the oracle
    sweep, on every cell of the matrix."""
    lists = {"arm": [*arms, *([oracle] if oracle else [])], "fixture": fixtures, "scenario": scenarios, "seed": seeds}
    plan = spark.range(1).select(F.lit(None).alias("_"))
    for name, values in lists.items():
        kind = "int" if name == "seed" else "string"
        plan = plan.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in values]).cast(f"array<{kind}>")))
    return plan.drop("_").distinct()


def complete_runs(run_meta: DataFrame, artifacts: DataFrame, needs: dict[str, str]) -> DataFrame:
    """The runs that left what their arm needs: ``needs`` names an artifact by arm (an oracle sweep
    is complete with its best table), ``artifacts`` lists (run_id, artifact). Arms that it does not
    name need their metadata only."""
    if not needs:
        return run_meta
    wants = F.create_map(*[F.lit(x) for pair in needs.items() for x in pair])
    r = run_meta.withColumn("_needs", F.try_element_at(wants, F.col("arm")))
    have = artifacts.select("run_id", F.col("artifact").alias("_needs")).distinct()
    return (r.filter("_needs is null").unionByName(r.filter("_needs is not null").join(have, ["run_id", "_needs"], "left_semi"))
            .drop("_needs"))


def newest_run(runs: DataFrame) -> DataFrame:
    """Newest run per (arm, fixture, scenario, seed); run ids sort by time."""
    return runs.groupBy("arm", *CELL).agg(F.max("run_id").alias("run_id"),
                                          F.count("*").alias("n_runs"))


def pending_trials(plan: DataFrame, runs: DataFrame) -> DataFrame:
    """The planned trials without a complete run: what a campaign has still to do."""
    return plan.join(runs, ["arm", *CELL], "left_anti")


def coverage(plan: DataFrame, runs: DataFrame) -> DataFrame:
    """Every planned cell: 'missing' where no planned trial has a complete run, 'incomplete'
    where some have none (``missing_arms``), else 'complete'. Runs outside the plan do not count."""
    done = plan.join(newest_run(runs).select("arm", *CELL, F.lit(True).alias("_done")), ["arm", *CELL], "left")
    g = done.groupBy(*CELL).agg(F.count("_done").alias("_n"), F.array_sort(F.collect_set(  # the plan's arms
        F.when(F.col("_done").isNull(), F.col("arm")))).alias("_missing"))
    return g.select(*CELL, F.when(F.col("_n") == 0, F.lit("missing"))
                    .when(F.size("_missing") > 0, F.lit("incomplete")).otherwise(F.lit("complete")).alias("status"),
                    F.array_join("_missing", ",").alias("missing_arms"))


def tolerance_join(left: DataFrame, right: DataFrame, lkey: str, rkey: str,
                   exact: Sequence[str] = (), tol: float = 1e-9) -> DataFrame:
    """Exact keys plus |lkey - rkey| < tol, as an equi join on the tol-grid cell with
    the right side widened to the neighbouring cells (so nothing near a cell edge is
    missed), then the residual predicate; never a nested loop."""
    cell = lambda c: F.floor(F.col(c) / F.lit(tol)).cast("long")
    l2 = left.withColumn("_cell", cell(lkey))
    r2 = right.withColumn("_cell", F.explode(F.array(cell(rkey) - 1, cell(rkey), cell(rkey) + 1)))
    j = l2.join(r2, [*exact, "_cell"])
    return j.filter(F.abs(F.col(lkey) - F.col(rkey)) < F.lit(tol)).drop("_cell")


# ---- A19 / A22 / X10-X14 ------------------------------------------------------------------
def weighted_median(df: DataFrame, groups: Sequence[str], value: str, weight: str,
                    width: float) -> DataFrame:
    """First value (ascending) whose cumulative weight reaches half the total.

    Weights are summed as whole numbers, so sums do not depend on their order and each group has
    exactly one median; twice the weights are compared with the total. They are scaled by a power
    of ten, the group's largest weight coming to 1e14 to 1e15: small ones count whatever their unit,
    and a decimal fraction stays exact. Whole numbers, as Spark cuts digits off wide fractions."""
    top = df.filter(F.col(weight) > 0).groupBy(*groups).agg(F.max(weight).alias("_top"))
    same = F.lit(True)
    for g in groups:
        same = same & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    j = df.alias("l").join(top.alias("r"), same).select("l.*", "r._top")
    unit = F.pow(F.lit(10.0), F.ceil(F.log10(F.col("_top").cast("double"))))
    w = (F.col(weight).cast("double") / unit).cast("decimal(16,15)")
    w = (w * F.lit(10 ** 15).cast("decimal(16,0)")).cast("decimal(38,0)")
    rows = j.filter(w > 0).withColumn("_w", w)
    w = F.col("_w")
    tg = rows.groupBy(*groups).agg(F.sum(w).alias("tgt")).select(
        *groups, F.lit("median").alias("name"), "tgt")
    r, _ = first_reaching(rows, groups, value, w + w, tg, width)
    return r.select(*groups, F.col(value).alias("weighted_median"))


def steady_state(series: DataFrame, keys: Sequence[str], value: str,
                 n: int = P.STEADY_STATE_WINDOWS, cv_max: float = P.STEADY_STATE_CV) -> DataFrame:
    """Coefficient of variation over the last n windows (full frames only).
    A group is one run's measurement windows (run length / window size rows)."""
    w = W.partitionBy(*keys).orderBy("win").rowsBetween(-(n - 1), W.currentRow)
    cv = F.try_divide(F.stddev_samp(value).over(w), F.avg(value).over(w))
    full = F.count(value).over(w) == n
    return series.select(*keys, "win", value,
                         F.when(full, cv).alias("cv"),
                         F.when(full, cv < cv_max).alias("steady"))


def band_grading(series: DataFrame, keys: Sequence[str], value: str,
                 healthy: float = P.PROXY_BAND_HEALTHY,
                 unhealthy: float = P.PROXY_BAND_UNHEALTHY) -> DataFrame:
    """X11: regression of a lower-is-better signal against the run's own t0 window."""
    t0 = series.groupBy(*keys).agg(F.min_by(value, "win").alias("_t0"))
    j = series.join(t0, list(keys))
    ratio = X.safe_div(value, "_t0")
    return j.select(*keys, "win", value, F.col("_t0").alias("t0_value"), ratio.alias("ratio"),
                    F.when(ratio.isNull(), F.lit(None))
                     .when(ratio <= 1 + healthy, F.lit("healthy"))
                     .when(ratio > 1 + unhealthy, F.lit("unhealthy"))
                     .otherwise(F.lit("between")).alias("band"))


def phase_split(series: DataFrame, window_s: int, shift_s: int) -> DataFrame:
    """Windows starting at or after the shift are the headline (phase B)."""
    return series.withColumn("phase", F.when(F.col("win") * window_s >= shift_s, F.lit("B"))
                             .otherwise(F.lit("A")))


def safety_monotone(checkpoints: DataFrame, keys: Sequence[str], order: str,
                    frozen: str, bucket: str) -> DataFrame:
    """The frozen-id horizon of a table never moves backward between checkpoints.
    ``bucket`` (a day, say) cuts a table's checkpoints along ``order``."""
    d = previous_row(checkpoints.select(*keys, order, frozen, bucket), keys, [order], F.col(bucket), [frozen])
    return d.groupBy(*keys).agg(
        F.count("*").alias("checkpoints"),
        F.count_if(F.col(frozen) < F.col(f"prev_{frozen}")).alias("regressions")).withColumn(
        "monotone", F.col("regressions") == 0)


def proxy_outcome_corr(proxy: DataFrame, outcome: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spearman correlation of window-to-window proxy and outcome movement
    (deltas by ``lag``, average ranks for ties, Pearson on the ranks)."""
    j = proxy.join(outcome, [*keys, "win"])
    w = W.partitionBy(*keys).orderBy("win")
    d = (j.withColumn("dp", F.col("proxy") - F.lag("proxy").over(w))
          .withColumn("do", F.col("outcome") - F.lag("outcome").over(w))
          .filter(F.col("dp").isNotNull() & F.col("do").isNotNull()))

    def avg_rank(c):
        rw = W.partitionBy(*keys).orderBy(c)
        tie = W.partitionBy(*keys, c)
        return F.rank().over(rw) + (F.count("*").over(tie) - 1) / 2.0

    r = d.withColumn("rp", avg_rank("dp")).withColumn("ro", avg_rank("do"))
    return r.groupBy(*keys).agg(F.count("*").alias("n_deltas"),
                                F.corr("rp", "ro").alias("spearman"))


def sampler(state: DataFrame, actions: DataFrame) -> DataFrame:
    """One experiment sample per relation: dead fraction, size, freeze ages,
    maintenance count and the governor's applied changes (grouped counts joined once,
    instead of a correlated count per row)."""
    applied = (actions.filter(F.col("status") == "applied")
               .groupBy("cluster_id", "relid").agg(F.count("*").alias("candidate_applied")))
    s = state.select(
        "cluster_id", "relid", "relname",
        X.safe_div("n_dead_tup", F.col("n_live_tup") + F.col("n_dead_tup")).alias("dead_frac"),
        F.col("total_size_bytes").alias("rel_size"), F.col("relfrozenxid_age").alias("xid_age"),
        F.col("relminmxid_age").alias("mxid_age"), F.col("autovacuum_count").alias("av_count"),
        F.col("last_autovacuum").alias("av_last"))
    return (s.join(applied, ["cluster_id", "relid"], "left")
            .withColumn("candidate_applied", F.coalesce(F.col("candidate_applied"), F.lit(0))))
