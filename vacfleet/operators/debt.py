"""Current health and maintenance debt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacfleet.functions import exprs as X
from vacfleet.operators import asof

VAC_SF = "autovacuum_vacuum_scale_factor"
VAC_THR = "autovacuum_vacuum_threshold"
ANA_SF = "autovacuum_analyze_scale_factor"
ANA_THR = "autovacuum_analyze_threshold"


def relation_health(samples: DataFrame, snapshots: DataFrame,
                    as_of: int | None = None) -> DataFrame:
    """Dense current health columns stamped with the snapshot's collection time."""
    st = asof.state_as_of(samples, snapshots, as_of)
    hdr = asof.header_at(snapshots, as_of).select("cluster_id", "snapshot_id", "collected_at")
    return st.join(F.broadcast(hdr), ["cluster_id", "snapshot_id"]).select(
        "cluster_id", "relid", "schemaname", "relname", "n_dead_tup", "n_live_tup",
        "reltuples", "relfrozenxid_age", "relminmxid_age", "last_autovacuum",
        "autovacuum_count", "collected_at")


def debt_columns(df: DataFrame) -> DataFrame:
    """Thresholds, fractions and overdue ratios from state + header default columns."""
    rt = X.unknown_as_zero(F.col("reltuples"))
    vac_thr = (F.coalesce(X.reloption("reloptions", VAC_THR).try_cast("bigint"),
                          F.col("def_vac_threshold"))
               + F.coalesce(X.reloption("reloptions", VAC_SF).try_cast("double"),
                            F.col("def_vac_scale_factor")) * rt)
    ana_thr = (F.coalesce(X.reloption("reloptions", ANA_THR).try_cast("bigint"),
                          F.col("def_ana_threshold"))
               + F.coalesce(X.reloption("reloptions", ANA_SF).try_cast("double"),
                            F.col("def_ana_scale_factor")) * rt)
    return (df.withColumn("_rt", rt)
              .withColumn("vacuum_threshold", vac_thr)
              .withColumn("analyze_threshold", ana_thr)
              .withColumn("dead_tuple_fraction", X.safe_div("n_dead_tup", "_rt"))
              .withColumn("mod_fraction", X.safe_div("n_mod_since_analyze", "_rt"))
              .withColumn("vacuum_debt_ratio", X.safe_div("n_dead_tup", "vacuum_threshold"))
              .withColumn("analyze_debt_ratio",
                          X.safe_div("n_mod_since_analyze", "analyze_threshold"))
              .withColumn("freeze_debt", X.safe_div("relfrozenxid_age", "def_freeze_max_age"))
              .drop("_rt"))


DEBT_COLS = ["cluster_id", "relid", "schemaname", "relname", "n_dead_tup",
             "n_mod_since_analyze", "reltuples", "vacuum_threshold", "analyze_threshold",
             "dead_tuple_fraction", "mod_fraction", "vacuum_debt_ratio",
             "analyze_debt_ratio", "freeze_debt"]


def maintenance_debt(samples: DataFrame, snapshots: DataFrame,
                     as_of: int | None = None) -> DataFrame:
    """Debt against the effective thresholds (explicit option, else the defaults of
    the *newest* snapshot: state is stamped p, so the header join resolves today's GUCs)."""
    st = asof.state_as_of(samples, snapshots, as_of)
    hdr = asof.header_at(snapshots, as_of).select(
        "cluster_id", "snapshot_id", "def_vac_threshold", "def_vac_scale_factor",
        "def_ana_threshold", "def_ana_scale_factor", "def_freeze_max_age")
    return debt_columns(st.join(F.broadcast(hdr), ["cluster_id", "snapshot_id"])).select(*DEBT_COLS)


def removability_horizons(sources: DataFrame) -> DataFrame:
    """Per cluster the oldest data horizon (owner, detail, age) and the oldest catalog
    horizon; owner 'none' when nothing pins. Ties on age resolve by (owner, detail)."""
    # explicit total order: larger age first, then smaller owner, then smaller detail
    d = sources.filter((F.col("kind") == "data") & F.col("xmin_age").isNotNull()).groupBy(
        "cluster_id").agg(F.min_by(F.struct("xmin_age", "owner", "detail"),
                                   F.struct((-F.col("xmin_age")).alias("a"), F.col("owner"),
                                            F.col("detail"))).alias("_d"))
    c = sources.filter((F.col("kind") == "catalog") & F.col("xmin_age").isNotNull()).groupBy(
        "cluster_id").agg(F.min_by(F.struct("xmin_age", "detail"),
                                   F.struct((-F.col("xmin_age")).alias("a"),
                                            F.col("detail"))).alias("_c"))
    clusters = sources.select("cluster_id").distinct()
    return (clusters.join(d, "cluster_id", "left").join(c, "cluster_id", "left").select(
        "cluster_id",
        F.col("_d.xmin_age").alias("oldest_xmin_age"),
        F.coalesce(F.col("_d.owner"), F.lit("none")).alias("oldest_xmin_owner"),
        F.col("_d.detail").alias("oldest_xmin_owner_detail"),
        F.col("_c.xmin_age").alias("oldest_catalog_xmin_age"),
        F.coalesce(F.col("_c.detail"), F.lit("none")).alias("oldest_catalog_xmin_owner")))


def horizon_sources(by_class: dict[str, DataFrame], catalog_classes: tuple[str, ...] = ()) -> DataFrame:
    """The snapshot-holding sources of every class as one table: each class frame
    (cluster_id, detail, xmin_age) is tagged with its owner class and kind, then
    ``unionByName`` (UNION ALL)."""
    out = None
    for owner, df in by_class.items():
        kind = "catalog" if owner in catalog_classes else "data"
        f = df.select("cluster_id", F.lit(owner).alias("owner"), "detail", "xmin_age",
                      F.lit(kind).alias("kind"))
        out = f if out is None else out.unionByName(f)
    return out
