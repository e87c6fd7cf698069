"""Rollup cascade and retention.

The 1m tier aggregates raw samples; 1h coarsens 1m and 1d coarsens 1h with
sample-count-weighted averages. Every tier is a partial+final hash aggregation keyed
by (cluster, relation, bucket), so a hot relation is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacfleet import params as P
from vacfleet.functions import exprs as X
from vacfleet.session import store, stored_or_none
from vacfleet.sources.io import upsert

AVG_MEASURES = ["dead_tup", "live_tup", "mod_since_analyze", "reltuples", "total_size_bytes"]
TIER_COLS = [
    "cluster_id", "bucket_part", "bucket_start", "relid", "schemaname", "relname",
    "sample_count",
    "avg_dead_tup", "max_dead_tup", "avg_live_tup", "max_live_tup",
    "avg_mod_since_analyze", "max_mod_since_analyze", "avg_reltuples", "max_reltuples",
    "max_relfrozenxid_age", "max_relminmxid_age",
    "max_n_tup_ins", "max_n_tup_upd", "max_n_tup_del",
    "max_vacuum_count", "max_autovacuum_count", "max_analyze_count", "max_autoanalyze_count",
    "avg_total_size_bytes", "max_total_size_bytes",
]
MAX_ONLY = ["max_relfrozenxid_age", "max_relminmxid_age", "max_n_tup_ins", "max_n_tup_upd",
            "max_n_tup_del", "max_vacuum_count", "max_autovacuum_count",
            "max_analyze_count", "max_autoanalyze_count"]


def _trunc(unit: str, ts: str | Column) -> Column:
    return X.as_ntz(F.date_trunc(unit, X.col(ts)))


def minute_measures() -> list[Column]:
    """The aggregates of one minute bucket over samples joined with their headers."""
    rt = X.unknown_as_zero(F.col("reltuples"))
    return [
        F.max("schemaname").alias("schemaname"),
        F.max("relname").alias("relname"),
        F.count("*").cast("int").alias("sample_count"),
        F.avg("n_dead_tup").alias("avg_dead_tup"),
        F.max("n_dead_tup").alias("max_dead_tup"),
        F.avg("n_live_tup").alias("avg_live_tup"),
        F.max("n_live_tup").alias("max_live_tup"),
        F.avg("n_mod_since_analyze").alias("avg_mod_since_analyze"),
        F.max("n_mod_since_analyze").alias("max_mod_since_analyze"),
        F.avg(rt).cast("double").alias("avg_reltuples"),
        F.bround(F.max(rt)).cast("bigint").alias("max_reltuples"),
        F.max(X.live_xid_age("relfrozenxid", "current_xid", "relfrozenxid_age"))
         .alias("max_relfrozenxid_age"),
        F.max(X.live_xid_age("relminmxid", "current_mxid", "relminmxid_age"))
         .alias("max_relminmxid_age"),
        F.max("n_tup_ins").alias("max_n_tup_ins"),
        F.max("n_tup_upd").alias("max_n_tup_upd"),
        F.max("n_tup_del").alias("max_n_tup_del"),
        F.max("vacuum_count").alias("max_vacuum_count"),
        F.max("autovacuum_count").alias("max_autovacuum_count"),
        F.max("analyze_count").alias("max_analyze_count"),
        F.max("autoanalyze_count").alias("max_autoanalyze_count"),
        F.avg("total_size_bytes").alias("avg_total_size_bytes"),
        F.max("total_size_bytes").alias("max_total_size_bytes"),
    ]


def rollup_minute(samples: DataFrame, snapshots: DataFrame,
                  since: Column | None = None) -> DataFrame:
    """A1: per relation and UTC minute of collection: count, avg and max of 14 measures.

    ``since`` bounds the work to buckets at or after that instant (truncated to the
    minute, so the edge bucket is recomputed in full); the matching ``collected_day``
    predicate lets the scan prune day partitions.
    """
    hdr = snapshots.select("cluster_id", "snapshot_id", "collected_at",
                           "current_xid", "current_mxid")
    s = samples
    if since is not None:
        lo = _trunc("minute", since)
        s = s.filter(F.col("collected_day") >= X.epoch_day(lo))
        hdr = hdr.filter(F.col("collected_at") >= lo)
    j = s.join(hdr, ["cluster_id", "snapshot_id"])
    g = j.groupBy("cluster_id", "relid", _trunc("minute", "collected_at").alias("bucket_start")).agg(
        *minute_measures())
    return g.withColumn("bucket_part", X.epoch_day("bucket_start")).select(*TIER_COLS)


def coarse_measures() -> list[Column]:
    """The aggregates of one coarse bucket over the buckets of a finer tier."""
    n = F.col("sample_count")
    aggs = [F.max("schemaname").alias("schemaname"), F.max("relname").alias("relname"),
            F.sum(n).cast("int").alias("sample_count")]
    for m in AVG_MEASURES:
        aggs.append(F.try_divide(F.sum(F.col(f"avg_{m}") * n), F.sum(n).cast("double"))
                    .alias(f"avg_{m}"))
        aggs.append(F.max(f"max_{m}").alias(f"max_{m}"))
    return aggs + [F.max(c).alias(c) for c in MAX_ONLY]


def coarsen(finer: DataFrame, unit: str, since: Column | None = None) -> DataFrame:
    """A2: aggregate a tier into ``unit`` buckets; averages weighted by sample count
    (divided by every sample, also those whose value was NULL, as the reference does)."""
    f = finer
    if since is not None:
        f = f.filter(F.col("bucket_start") >= _trunc(unit, since))
    g = f.groupBy("cluster_id", "relid", _trunc(unit, "bucket_start").alias("bucket_start")).agg(*coarse_measures())
    return g.withColumn("bucket_part", X.epoch_month("bucket_start")).select(*TIER_COLS)


def rollup(samples: DataFrame, snapshots: DataFrame, lookback_s: float | None = None,
           as_of: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tiers; each coarse tier reads the finer one just computed. A lookback
    reaches back to the start of its day, the coarsest tier's bucket, so every bucket
    returned is whole."""
    since = None
    if lookback_s is not None:
        since = _trunc("day", _since(snapshots, lookback_s, as_of))
    r1m = rollup_minute(samples, snapshots, since)
    r1h = coarsen(r1m, "hour", since)
    r1d = coarsen(r1h, "day", since)
    return r1m, r1h, r1d


def _since(snapshots: DataFrame, lookback_s: float, as_of: Column | None) -> Column:
    ref = as_of if as_of is not None else snapshots.agg(F.max("collected_at")).scalar()
    return X.minus_seconds(ref, lookback_s)


BUCKET_KEY = ["cluster_id", "relid", "bucket_start"]

def write_tier(df: DataFrame, path: str) -> None:
    """Write whole bucket partitions. Dynamic partition overwrite replaces only the
    partitions in ``df``, so ``df`` must hold all buckets of these (``upsert_tier`` does).
    Rows of a partition come together; one that is too large for a task is split by its bytes,
    so the number of its files grows with them and the size of a task does not."""
    (df.hint("rebalance", "cluster_id", "bucket_part")
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("cluster_id", "bucket_part").parquet(path))


def upsert_tier(new: DataFrame, path: str) -> DataFrame:
    """Upsert by bucket key. The buckets of ``new`` replace stored ones of the same
    cluster, relation and start; all others stay. Only the partitions that ``new`` touches
    are read and rewritten. They are merged first into a table in the checkpoint folder; it
    still holds their whole content if the job is lost while the tier is being replaced.
    Returns the stored tier."""
    spark = new.sparkSession
    new = store(new.select(*TIER_COLS), "tier_new")
    old = stored_or_none(spark, path, new.schema)
    if old is not None:
        new = store(upsert(old.select(*TIER_COLS), new, BUCKET_KEY, ["cluster_id", "bucket_part"]),
                    "tier_merged")
    write_tier(new, path)
    return spark.read.schema(new.schema).parquet(path).select(*TIER_COLS)


def update_tiers(samples: DataFrame, snapshots: DataFrame, root: str,
                 lookback_s: float | None = None,
                 as_of: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """D7 as the recurring job: the minute buckets since the lookback are recomputed from the
    samples and upserted; each coarse tier is recomputed from the stored finer one for the
    buckets that reach into the lookback, so an edge bucket keeps what came before it.
    Repeating a run changes nothing. Returns the three stored tiers."""
    since = None if lookback_s is None else _since(snapshots, lookback_s, as_of)
    r1m = upsert_tier(rollup_minute(samples, snapshots, since), f"{root}/rollup_1m")
    r1h = upsert_tier(coarsen(r1m, "hour", since), f"{root}/rollup_1h")
    r1d = upsert_tier(coarsen(r1h, "day", since), f"{root}/rollup_1d")
    return r1m, r1h, r1d


def partition_inventory(inventory: DataFrame) -> DataFrame:
    """S14 + P28: decode each partition's key from its name suffix and its range."""
    key = F.regexp_extract("partition", r"_(\d{6,8})$", 1)
    is_day = F.length(key) == 8
    start = F.when(is_day, X.as_ntz(F.to_date(key, "yyyyMMdd"))).otherwise(
        X.as_ntz(F.to_date(F.concat(key, F.lit("01")), "yyyyMMdd")))
    end = F.when(is_day, start + F.expr("INTERVAL 1 DAY")).otherwise(
        X.as_ntz(F.add_months(start, 1)))
    return inventory.select(
        "cluster_id", "schema_name", "relation", "partition",
        F.when(is_day, F.lit("day")).otherwise(F.lit("month")).alias("decoded_span"),
        F.when(is_day, X.epoch_day(start)).otherwise(X.epoch_month(start))
         .cast("int").alias("part_key"),
        start.alias("decoded_start"), end.alias("decoded_end"),
        "approx_rows", "bytes")


TIER_OF_RELATION = {"rollup_1m": "1m", "rollup_1h": "1h", "rollup_1d": "1d"}


def rollup_retention(inventory: DataFrame, as_of: Column,
                     keep_days: dict | None = None) -> DataFrame:
    """Rollup partitions whose range ends at or before as_of minus the tier window."""
    keep = keep_days or P.ROLLUP_KEEP_DAYS
    days = F.create_map(*[e for rel, t in TIER_OF_RELATION.items()
                          for e in (F.lit(rel), F.lit(keep[t]))])
    kd = F.try_element_at(days, F.col("relation"))
    cutoff = X.as_ntz(X.col(as_of)) - F.make_dt_interval(days=kd.cast("int"))
    return (inventory.filter(kd.isNotNull() & (F.col("range_end") <= cutoff))
            .select("cluster_id", "schema_name", "relation", "partition", "range_start",
                    "range_end", "approx_rows", "bytes"))


def raw_retention(samples: DataFrame, keep_days: int = P.RAW_KEEP_DAYS) -> DataFrame:
    """Per cluster and collection day, keep [newest_day - keep, newest_day]; older
    day partitions are dropped whole. One row per (cluster, day) with its row count."""
    per_day = samples.groupBy("cluster_id", "collected_day", "slot").agg(
        F.count("*").alias("rows"))
    newest = samples.groupBy("cluster_id").agg(F.max("collected_day").alias("_newest"))
    j = per_day.join(F.broadcast(newest), "cluster_id")
    return j.select("cluster_id", "collected_day", "slot", "rows",
                    F.when(F.col("collected_day") >= F.col("_newest") - keep_days,
                           F.lit("keep")).otherwise(F.lit("drop")).alias("action"))
