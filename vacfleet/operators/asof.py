"""As-of reconstruction over sparse storage.

Sparse logging stores a relation only when it changed, so "the state at p" is the
newest stored row at or before p. Everything here is a keyed ``max_by`` aggregate:
partial aggregation map-side (each task sorts only its own rows, as the buffer is a
struct), then one shuffle of one row per key and task; no global sort and no entity x
snapshot grid. ``tick_state`` is the incremental form: the cache of newest rows joined
with the rows stored at p.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacfleet.functions import exprs as X

ENTITY = ["cluster_id", "relid"]


def target_snapshot(snapshots: DataFrame, as_of=None, back: int = 0) -> DataFrame:
    """(cluster_id, _p): the snapshot to reconstruct per cluster; default the newest.

    ``as_of`` (an id, a DataFrame (cluster_id, _p), or None) bounds it; ``back`` steps
    to earlier snapshots (1 = the one before the newest). One row per cluster, so its
    size is bounded by the fleet size (broadcast-safe).
    """
    if isinstance(as_of, DataFrame):
        return as_of
    s = snapshots.select("cluster_id", "snapshot_id")
    if as_of is not None:
        s = s.filter(F.col("snapshot_id") <= F.lit(as_of))
    t = s.groupBy("cluster_id").agg(F.max("snapshot_id").alias("_p"))
    for _ in range(back):
        t = (s.join(F.broadcast(t), "cluster_id").filter(F.col("snapshot_id") < F.col("_p"))
             .groupBy("cluster_id").agg(F.max("snapshot_id").alias("_p")))
    return t


def latest_per_key(df: DataFrame, keys: Sequence[str], order: str | Column,
                   cols: Sequence[str] | None = None) -> DataFrame:
    """Newest row per key by ``order`` (DISTINCT ON (keys) ... ORDER BY order DESC)."""
    cols = list(cols or [c for c in df.columns if c not in keys])
    o = F.col(order) if isinstance(order, str) else order
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), o).alias("_r"))
    return agg.select(*keys, *[F.col("_r").getField(c).alias(c) for c in cols])


STATE_COLS = [
    "collected_day", "schemaname", "relname",
    "n_live_tup", "n_dead_tup", "n_mod_since_analyze", "n_ins_since_vacuum",
    "n_tup_ins", "n_tup_upd", "n_tup_del", "n_tup_hot_upd",
    "last_autovacuum", "last_autoanalyze",
    "vacuum_count", "autovacuum_count", "analyze_count", "autoanalyze_count",
    "total_autovacuum_time", "reltuples", "relpages", "relallvisible",
    "relfrozenxid_age", "relminmxid_age", "relfrozenxid", "relminmxid",
    "relation_size_bytes", "total_size_bytes", "reloptions",
]


def state_and_previous(samples: DataFrame, snapshots: DataFrame,
                       as_of=None,
                       prev_cols: Sequence[str] = ()) -> DataFrame:
    """D3 + J3 in one aggregation: per entity the newest row at or before p (``cur``)
    and, if asked, the newest row strictly before p (``prev_*`` columns).

    A quiet relation's current row *is* its previous row (trap 1 of the survey): the
    deltas are then 0 over a growing dt, exactly as the reference computes them.
    """
    tgt = target_snapshot(snapshots, as_of)
    s = (samples.join(F.broadcast(tgt), "cluster_id")
         .filter(F.col("snapshot_id") <= F.col("_p")))
    aggs = [F.max_by(F.struct(*STATE_COLS), "snapshot_id").alias("_c")]
    if prev_cols:
        prev_order = F.when(F.col("snapshot_id") < F.col("_p"), F.col("snapshot_id"))
        aggs.append(F.max_by(F.struct(F.col("snapshot_id").alias("snapshot_id"),
                                      *prev_cols), prev_order).alias("_q"))
    g = s.groupBy("cluster_id", "relid", "_p").agg(*aggs)
    out = [F.col("cluster_id"), F.col("_p").alias("snapshot_id"), F.col("relid")]
    out += [F.col("_c").getField(c).alias(c) for c in STATE_COLS]
    if prev_cols:
        out.append(F.col("_q").getField("snapshot_id").alias("prev_snapshot_id"))
        out += [F.col("_q").getField(c).alias(f"prev_{c}") for c in prev_cols]
    return g.select(*out)


def known_relations(samples: DataFrame, tgt: DataFrame) -> DataFrame:
    """KEY of the relations stored at or before each cluster's target: keys only, combined in
    each task before the shuffle."""
    return (samples.select(*ENTITY, "snapshot_id").join(F.broadcast(tgt), "cluster_id")
            .filter(F.col("snapshot_id") <= F.col("_p")).select(*ENTITY).distinct())


def header_at(snapshots: DataFrame, as_of=None) -> DataFrame:
    """The header row of each cluster's target snapshot: one row per cluster, so the
    result is bounded by the fleet size and is the broadcast side of header joins."""
    tgt = target_snapshot(snapshots, as_of)
    return (snapshots.join(F.broadcast(tgt), "cluster_id")
            .filter(F.col("snapshot_id") == F.col("_p")).drop("_p"))


def with_live_ages(state: DataFrame, header: DataFrame) -> DataFrame:
    """Recompute freeze ages from raw ids against the header's current ids.

    ``header`` holds one row per cluster (``header_at``), hence the broadcast.
    """
    hdr = header.select("cluster_id", "snapshot_id", "current_xid", "current_mxid")
    j = state.join(F.broadcast(hdr), ["cluster_id", "snapshot_id"], "left")
    return (j.withColumn("relfrozenxid_age",
                         X.live_xid_age("relfrozenxid", "current_xid", "relfrozenxid_age"))
             .withColumn("relminmxid_age",
                         X.live_xid_age("relminmxid", "current_mxid", "relminmxid_age"))
             .drop("current_xid", "current_mxid"))


def state_as_of(samples: DataFrame, snapshots: DataFrame, as_of=None,
                live: DataFrame | None = None) -> DataFrame:
    """D3: dense state of every relation as of p, stamped p, with live ages.

    Dropped relations are never tombstoned in the sample log, so they stay "current"
    until their rows age out; pass ``live`` (cluster_id, relid) to keep only relations
    that still exist (a semi join)."""
    st = state_and_previous(samples, snapshots, as_of)
    if live is not None:
        st = st.join(live.select(*ENTITY), ENTITY, "left_semi")
    return with_live_ages(st, header_at(snapshots, as_of)).drop("relfrozenxid", "relminmxid")


def previous_sample(samples: DataFrame, snapshots: DataFrame,
                    as_of: int | None = None) -> DataFrame:
    """Each relation's newest stored row strictly before p (not p-1)."""
    tgt = target_snapshot(snapshots, as_of)
    s = (samples.join(F.broadcast(tgt), "cluster_id")
         .filter(F.col("snapshot_id") < F.col("_p")))
    return latest_per_key(s, ["cluster_id", "relid"], "snapshot_id",
                          ["snapshot_id", "n_tup_ins", "n_tup_upd", "n_tup_del",
                           "n_dead_tup", "autovacuum_count", "reltuples",
                           "relfrozenxid_age"])


def rollup_as_of(tier: DataFrame, tier_name: str, as_of: Column | str) -> DataFrame:
    """Latest bucket per relation at or before ``as_of`` in tier 1m, 1h or 1d."""
    if tier_name not in ("1m", "1h", "1d"):
        raise ValueError(f"unknown rollup tier: {tier_name} (use '1m', '1h', or '1d')")
    t = tier.filter(F.col("bucket_start") <= (F.col(as_of) if isinstance(as_of, str) else as_of))
    cols = [c for c in tier.columns if c not in ("cluster_id", "relid", "bucket_part")]
    return latest_per_key(t, ["cluster_id", "relid"], "bucket_start", cols)


def latest_rows(samples: DataFrame, before=None) -> DataFrame:
    """The change-detection cache: newest stored row per relation (optionally strictly
    before each cluster's target ``before``: a frame (cluster_id, _p))."""
    s = samples
    if before is not None:
        s = s.join(F.broadcast(before), "cluster_id").filter(F.col("snapshot_id") < F.col("_p"))
    return latest_per_key(s, ENTITY, "snapshot_id", ["snapshot_id", *STATE_COLS])


def tick_state(cache: DataFrame, new: DataFrame, tgt: DataFrame,
               prev_cols: Sequence[str] = (), relations: DataFrame | None = None) -> DataFrame:
    """The ``state_and_previous`` columns for tick p from the cache (newest stored row per
    relation before p) and the rows stored at p, in one full outer join on the entity
    key: O(relations + new rows) instead of a pass over the stored history.

    Changed relation: cur = its new row, prev = its cached row. Quiet relation: cur = prev
    = its cached row (trap 1). New relation: cur = new row, no prev (boot).

    With the list of ``relations`` (KEY of every relation with a row), two left joins take the
    full outer join's place: they keep the partitioning of tables stored by the entity key
    (``io.write_colocated``), so what is joined next needs no exchange either. A cache that has
    its rows' ``collected_at`` passes it on (``prev_collected_at``).
    """
    cols = ["snapshot_id", *STATE_COLS]
    timed = "collected_at" in cache.columns
    c = cache.select(*ENTITY, F.struct(*cols, *(["collected_at"] if timed else [])).alias("_c"))
    n = new.select(*ENTITY, F.struct(*cols).alias("_n"))
    j = (c.join(n, ENTITY, "full_outer") if relations is None
         else relations.select(*ENTITY).join(c, ENTITY, "left").join(n, ENTITY, "left"))
    j = j.join(F.broadcast(tgt), "cluster_id")
    cur = F.coalesce(F.col("_n"), F.struct(*[F.col("_c").getField(x).alias(x) for x in cols]))
    out = [F.col("cluster_id"), F.col("_p").alias("snapshot_id"), F.col("relid")]
    out += [cur.getField(x).alias(x) for x in STATE_COLS]
    if prev_cols:
        out.append(F.col("_c").getField("snapshot_id").alias("prev_snapshot_id"))
        out += [F.col("_c").getField(x).alias(f"prev_{x}") for x in prev_cols]
    if timed:
        out.append(F.col("_c").getField("collected_at").alias("prev_collected_at"))
    return j.select(*out)


def advance_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The cache after tick p: new rows replace cached ones (keyed upsert)."""
    cols = cache.columns
    return (cache.join(new.select(*ENTITY), ENTITY, "left_anti")
            .unionByName(new.select(*cols)))
