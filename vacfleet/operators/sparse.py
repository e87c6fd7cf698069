"""Collection filter and sparse change logging (D1, D2; S3, J5, J7, J9, P20, P23, P24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacfleet.functions import exprs as X
from vacfleet.operators.sequence import previous_row
from vacfleet.session import store

# FIXED VALUES: schemas never collected (the catalog schemas), plus the collector's own.
SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")
COLLECTED_KINDS = ("r", "m", "p")

# Every event-driven observable plus the raw frozen ids; the derived ages are left
# out on purpose (they grow every run and would defeat sparsity).
SIGNATURE = [
    "schemaname", "relname",
    "n_live_tup", "n_dead_tup", "n_mod_since_analyze", "n_ins_since_vacuum",
    "n_tup_ins", "n_tup_upd", "n_tup_del", "n_tup_hot_upd",
    "last_autovacuum", "last_autoanalyze",
    "vacuum_count", "autovacuum_count", "analyze_count", "autoanalyze_count",
    "total_autovacuum_time", "reltuples", "relpages", "relallvisible",
    "relfrozenxid", "relminmxid", "relation_size_bytes", "total_size_bytes", "reloptions",
]


def collection_filter(dense: DataFrame, policy: DataFrame,
                      own_schemas: tuple[str, ...] = (),
                      extension_members: DataFrame | None = None) -> DataFrame:
    """Rows the collector keeps under each cluster's collection policy.

    The policy has one row per cluster (bounded by fleet size, so it is broadcast); a
    cluster without a row reads the safe defaults. Extension ownership comes from the
    row's ``extension_owned`` flag, or, when ``extension_members`` (cluster_id, relid) is
    given, from a ``left_anti`` join against it (J5), applied where the policy excludes
    extension-owned relations.
    """
    if extension_members is not None:
        members = extension_members.select("cluster_id", "relid").distinct().withColumn(
            "_ext", F.lit(True))
        dense = (dense.drop("extension_owned").join(members, ["cluster_id", "relid"], "left")
                 .withColumn("extension_owned", F.coalesce(F.col("_ext"), F.lit(False)))
                 .drop("_ext"))
    pol = policy.select("cluster_id", "exclude_temp", "include_extension_owned",
                        "min_partition_size_bytes", "excluded_schemas")
    j = dense.join(F.broadcast(pol), "cluster_id", "left")
    excl_temp = F.coalesce(F.col("exclude_temp"), F.lit(True))
    incl_ext = F.coalesce(F.col("include_extension_owned"), F.lit(False))
    min_part = F.coalesce(F.col("min_partition_size_bytes"), F.lit(0))
    excluded = F.coalesce(F.col("excluded_schemas"), F.array().cast("array<string>"))
    keep = (~F.col("schemaname").isin(*SYSTEM_SCHEMAS, *own_schemas)
            & F.col("relkind").isin(*COLLECTED_KINDS)
            & (~excl_temp | (F.col("relpersistence") != "t"))
            & ~F.array_contains(excluded, F.col("schemaname"))
            & (incl_ext | ~F.col("extension_owned"))
            & ((min_part == 0) | ~F.col("relispartition")
               | (F.col("total_size_bytes") >= min_part)))
    return j.filter(keep).select(*[c for c in dense.columns
                                   if c not in ("relkind", "relpersistence",
                                                "relispartition", "extension_owned")])


def day_changes(collected: DataFrame, keep: Column | None = None) -> DataFrame:
    """The rows that begin a relation's day or differ from the day's row before (and those with
    ``keep``). A row left out has the signature of the last one kept before it, so these rows
    have the same sparse log as all. One sort of a relation-day, and no aggregation."""
    w = W.partitionBy("cluster_id", "relid", "_bkt").orderBy("snapshot_id")
    before = F.lag(F.struct(*SIGNATURE)).over(w)
    p = collected.withColumn("_bkt", F.col("collected_day")).withColumn("_before", before)
    new = F.col("_before").isNull() | ~F.struct(*SIGNATURE).eqNullSafe(F.col("_before"))
    return p.filter(new if keep is None else new | keep).select(*collected.columns)


def run_edges(rows: DataFrame, last: DataFrame) -> DataFrame:
    """The rows of a batch that its change log, and each relation's newest row, come from.

    Rows of a relation-day with equal signatures are one run: hashed, combined map-side, so whole
    rows are neither shuffled nor sorted. In a day whose runs do not overlap, a run's first row stands
    for all of it, and for none if the run before it has the same signature. Days with runs that
    overlap (a signature that came back), reach back to the relation's row in ``last`` or have no
    snapshot id keep all rows. The relation's newest row always stays."""
    key = ["cluster_id", "relid"]
    day_key = [*key, "collected_day"]
    runs = rows.groupBy(*day_key, *SIGNATURE).agg(
        F.min("snapshot_id").alias("_first"), F.max("snapshot_id").alias("_end"),
        (F.count(F.lit(1)) > F.count("snapshot_id")).alias("_torn"), F.lit(True).alias("_new"))
    stands = last.select(*day_key, *SIGNATURE, F.col("snapshot_id").alias("_first"),
                         F.col("snapshot_id").alias("_end"), F.lit(False).alias("_torn"), F.lit(False).alias("_new"))
    # one sort for all windows; a relation-day's is a part of it
    w = W.partitionBy(*key).orderBy("collected_day", "_first")
    whole, day = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), W.partitionBy(*day_key)
    runs = stands.unionByName(runs).withColumn("_seen", F.max(F.when(~F.col("_new"), F.col("_first"))).over(whole))
    runs = runs.filter(F.col("_new") & (F.col("_seen").isNull() | (F.col("_end") > F.col("_seen"))))
    before = F.col("_before")
    overlaps = before["collected_day"].eqNullSafe(F.col("collected_day")) & (before["_end"] >= F.col("_first"))
    runs = runs.withColumn("_before", F.lag(F.struct("collected_day", "_end", F.struct(*SIGNATURE).alias("_is"))).over(w))
    runs = runs.withColumn("_torn", F.max(F.col("_torn") | F.coalesce(overlaps, F.lit(False))
                                          | F.coalesce(F.col("_first") <= F.col("_seen"), F.lit(False))).over(day))
    # the log joins a day to the one before by its key: without one it logs each day's first row
    known = F.col("cluster_id").isNotNull() & F.col("relid").isNotNull()
    goes_on = known & before.isNotNull() & before["_is"].eqNullSafe(F.struct(*SIGNATURE)) & ~F.lag("_torn", 1, False).over(w)
    runs = runs.withColumns({"_newest": F.lead(F.lit(True)).over(w).isNull(), "_goes_on": goes_on})
    runs = store(runs.filter(F.col("_torn") | F.col("_newest") | ~F.col("_goes_on")).drop("_before", "_seen", "_goes_on"), "runs")
    ends = F.when(F.col("_newest"), F.array_distinct(F.array("_first", "_end"))).otherwise(F.array("_first"))
    few = runs.filter(~F.col("_torn")).withColumn("snapshot_id", F.explode(ends)).select(*rows.columns)
    torn = runs.filter("_torn").select(*[F.col(c).alias(f"_{c}") for c in day_key]).distinct()
    if torn.isEmpty():
        return few
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in day_key]
    return few.unionByName(rows.join(torn, on, "left_semi"))


def sparse_log(collected: DataFrame) -> DataFrame:
    """D2 over a history of collected rows: keep a row only when its signature differs
    from the relation's previous collected row (or it has none).

    The previous row is found per (relation, day) with a cross-day carry, so no task
    sorts more than one relation-day (bounded by the collection cadence). Most rows differ in
    nothing from the one before on the same day: they go first, and the carry is found from the rest.
    """
    p = previous_row(store(day_changes(collected), "day_changes"), ["cluster_id", "relid"], ["snapshot_id"],
                     F.col("collected_day"), SIGNATURE)
    emit = ~F.col("prev_exists") | X.changed(SIGNATURE, [f"prev_{c}" for c in SIGNATURE])
    return p.filter(emit).select(*collected.columns)


def last_state(collected: DataFrame) -> DataFrame:
    """The change-detection cache after the batch: newest collected row per relation.

    The newest snapshot of each relation is found first, from three columns by hashing; whole rows
    are sorted only of the snapshots that are some relation's newest."""
    from vacfleet.operators.asof import latest_per_key
    newest = collected.groupBy("cluster_id", "relid").agg(F.max("snapshot_id").alias("_at"))
    # few, as a rule: Spark reads their stored size and broadcasts them, if small
    at = store(newest.select(F.col("cluster_id").alias("_in"), "_at").distinct(), "newest_snapshots")
    rows = collected.join(at, F.col("cluster_id").eqNullSafe(F.col("_in"))
                          & F.col("snapshot_id").eqNullSafe(F.col("_at")), "left_semi")
    return latest_per_key(rows, ["cluster_id", "relid"], "snapshot_id",
                          ["snapshot_id", *SIGNATURE])


def change_join(current: DataFrame, state: DataFrame) -> DataFrame:
    """J9, the per-tick form of D2: current rows (one snapshot) left-joined to the
    change-detection cache; a row is logged when the relation is new or its signature
    differs (NULLs equal)."""
    key = ["cluster_id", "relid"]
    ls = state.select(*key, F.struct(*SIGNATURE).alias("_ls"))
    j = current.join(ls, key, "left")
    return j.filter(F.col("_ls").isNull() | ~F.struct(*SIGNATURE).eqNullSafe(F.col("_ls"))).drop("_ls")


def refresh_state(state: DataFrame, current: DataFrame, live: DataFrame) -> DataFrame:
    """S12 + J5: the cache after the tick: every current relation upserted; relations that
    vanished from the catalog purged; relations only filtered out keep their old row."""
    key = ["cluster_id", "relid"]
    cols = state.columns
    kept = (state.join(live.select(*key).distinct(), key, "left_semi")
            .join(current.select(*key), key, "left_anti"))
    return kept.unionByName(current.select(*cols))
