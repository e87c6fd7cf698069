"""Loads the driver tables once per (session, directory) and derives the shapes."""

from __future__ import annotations

import threading
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from vacfleet.operators.asof import target_snapshot
from vacfleet.operators.backfill import control_state
from vacfleet.session import ensure_checkpoint_dir
from vacfleet.sources import derive as D

#: Days of a backfill chunk: 384 of the stand-in's hourly snapshots.
CHUNK_DAYS = 16
_CACHE: dict = {}
_LOCK = threading.RLock()    # derived tables are written once even if queries run in threads


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.run = uuid.uuid4().hex[:12]     # stored tables of another Inputs of this directory stay
        self.paths: dict[str, str] = {}      # folder of each stored stand-in table

    def table(self, name: str) -> DataFrame:
        return D.read(self.spark, self.sf_dir, name)

    def stored(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Write a derived stand-in table once per process under the shared checkpoint
        folder and read it back: operators then scan parquet (pushdown, pruning) exactly as
        they would scan the stored telemetry tables, and lineage stops here."""
        with _LOCK:
            return self._stored(name, df, partition_by)

    def _stored(self, name, df, partition_by):
        root = ensure_checkpoint_dir(self.spark).rstrip("/")
        tag = self.sf_dir.strip("/").replace("/", "_")
        path = f"{root}/vacfleet-inputs-{self.run}/{tag}/{name}"
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(path)
        self.paths[name] = path
        return self.spark.read.parquet(path)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def samples(self) -> DataFrame:
        return self.stored("relation_samples", D.relation_samples(self.events), ["collected_day"])

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.stored("snapshots", D.snapshots(self.events))

    @cached_property
    def carried_state(self) -> DataFrame:
        """The state that a control loop has carried through every snapshot before the
        newest one of each cluster."""
        state = control_state(self.samples, self.snapshots, self.policy,
                              before=target_snapshot(self.snapshots), chunk_days=CHUNK_DAYS)
        return self.stored("carried_state", state)

    @cached_property
    def dense(self) -> DataFrame:
        """The catalog scans, in the order in which they are expanded: a relation's hours stand together.
        No folder a day, for which each task would have to sort all rows that it expands."""
        dense = D.dense_samples(self.samples, self.snapshots)
        return self.stored("dense_samples", dense.select(*[c for c in dense.columns if c != "collected_day"], "collected_day"))

    @cached_property
    def horizon_sources(self) -> DataFrame:
        return D.horizon_sources(self.events)

    @cached_property
    def collection_policy(self) -> DataFrame:
        return D.collection_policy(self.spark)

    @cached_property
    def actions(self) -> DataFrame:
        return D.action_history(self.table("orders"))

    @cached_property
    def decisions(self) -> DataFrame:
        return D.decision_log(self.table("orders"))

    @cached_property
    def ticks(self) -> DataFrame:
        return D.tick_log(self.table("orders"))

    @cached_property
    def diagnostics(self) -> DataFrame:
        return D.diagnostics(self.table("orders"))

    @cached_property
    def inventory(self) -> DataFrame:
        return self.stored("storage_inventory", D.storage_inventory(self.table("lineitem")))

    @cached_property
    def policy(self) -> DataFrame:
        return D.policy(self.table("supplier"))

    @cached_property
    def policy_next(self) -> DataFrame:
        return D.policy_next(self.table("supplier"), self.table("nation"))

    @cached_property
    def override_events(self) -> DataFrame:
        return D.override_events(self.table("region"))

    @cached_property
    def tx_log(self) -> DataFrame:
        return D.tx_log(self.events)

    @cached_property
    def tx_log_lineitem(self) -> DataFrame:
        return D.tx_log_lineitem(self.table("lineitem"))

    @cached_property
    def metrics(self) -> DataFrame:
        return D.efficacy_metrics(self.events)

    @cached_property
    def run_meta(self) -> DataFrame:
        return self.stored("run_meta", D.run_meta(self.events))


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    key = (spark.sparkContext.applicationId, sf_dir)
    with _LOCK:
        if key not in _CACHE:
            _CACHE[key] = Inputs(spark, sf_dir)
        return _CACHE[key]
