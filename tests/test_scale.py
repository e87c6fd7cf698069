"""Steps whose tasks must not grow with the tables: what they write and keep, on rows of their own."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacfleet.operators import rollup as R
from vacfleet.operators import sparse
from vacfleet.plans.inputs import Inputs
from vacfleet.sources import io

SF = "/root/testdata/sf0.001"


def _rows(spark, n=600, seed=3):
    """Rows of some relations (one without an id), few values, so that most equal the one before."""
    rng = random.Random(seed)
    rows = [(f"n{c}", None if r == 5 else r, s, s // 24, rng.choice([1, 1, 1, 2]))
            for c in range(2) for r in range(6) for s in range(n // 12)]
    df = spark.createDataFrame(rows, "cluster_id string, relid long, snapshot_id long, collected_day int, n_dead_tup long")
    return df.withColumns({c: F.lit(None).cast("long") for c in sparse.SIGNATURE if c != "n_dead_tup"})


def test_dense_rows_are_stored_without_a_sort_by_day(spark):
    i = Inputs(spark, SF)
    assert i.dense.columns[-1] == "collected_day"
    assert not any("collected_day=" in f for f in i.dense.inputFiles())


def test_day_changes_have_the_log_of_all_rows(spark):
    rows = _rows(spark)
    few = sparse.day_changes(rows)
    assert few.count() < 0.8 * rows.count()
    key = ["cluster_id", "relid", "snapshot_id"]
    known = rows.filter("relid is not null")
    w = W.partitionBy("cluster_id", "relid").orderBy("snapshot_id")
    want = (known.withColumn("_p", F.lag("n_dead_tup").over(w))
            .filter(F.col("_p").isNull() | (F.col("_p") != F.col("n_dead_tup"))).select(key).collect())
    for df in (known, few.filter("relid is not null")):
        assert sorted(sparse.sparse_log(df).select(key).collect()) == sorted(want)


def test_last_state_sorts_only_newest_snapshots(spark):
    gone = (F.col("relid") == 2) & (F.col("snapshot_id") > 7)
    rows = _rows(spark).filter(~gone | F.col("relid").isNull())
    last = sparse.last_state(rows)
    got = {(r.cluster_id, r.relid): r.snapshot_id for r in last.collect()}
    assert got == {(c, r): 7 if r == 2 else 49 for c in ("n0", "n1") for r in (0, 1, 2, 3, 4, None)}
    assert "LeftSemi" in last._jdf.queryExecution().optimizedPlan().toString()


def test_a_micro_batch_of_the_change_stream_has_many_files(spark, tmp_path, monkeypatch):
    from vacfleet.plans import catalog
    i = Inputs(spark, SF)
    i.__dict__["dense"] = i.stored("dense_of_three", i.dense.repartition(3))
    monkeypatch.setattr(catalog, "inputs", lambda *_: i)
    monkeypatch.setattr(catalog, "_stream_dir", lambda *_: str(tmp_path / "st"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        days = catalog.QUERIES["stream_change_detection"](spark, SF).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    batches = glob.glob(f"{tmp_path}/st/log/batch_id=*")
    assert days and 1 < len(batches) < len(glob.glob(f"{tmp_path}/st/in/*.parquet"))


def test_files_of_a_tier_follow_its_bytes(spark, tmp_path):
    null = {c: F.lit(None).cast("double") for c in R.TIER_COLS}
    rows = spark.range(60000, numPartitions=12).withColumns({**null, "cluster_id": F.lit("n0"), "bucket_part": F.lit(648),
                                                             "relid": F.col("id"), "max_dead_tup": F.xxhash64("id")})
    rows = rows.select(*[c for c in R.TIER_COLS])
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "16k")
    try:
        R.write_tier(rows, str(tmp_path / "tier"))
    finally:
        spark.conf.set(name, before)
    assert len(glob.glob(f"{tmp_path}/tier/cluster_id=n0/bucket_part=648/*.parquet")) > 8
    assert spark.read.parquet(str(tmp_path / "tier")).select("relid").distinct().count() == 60000


def test_compacted_files_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "FILE_ROWS", 100)
    df = _rows(spark).select("cluster_id", "relid", "snapshot_id", "collected_day", "n_dead_tup").filter("relid is not null")
    path = str(tmp_path / "raw")
    io.write_day_slotted(df, path)
    io.compact_days(spark, path, df.schema, before=2)
    assert len(glob.glob(f"{path}/days/collected_day=*/*.parquet")) >= 4
    assert sorted(io.read_day_slotted(spark, path, df.schema).collect()) == sorted(df.collect())


@pytest.mark.parametrize("part", [1, 7, 1 << 18])
def test_bucket_sums_in_ranges(monkeypatch, part):
    from vacfleet.llm import lm
    monkeypatch.setattr(lm, "PART", part)
    rng = np.random.default_rng(5)
    some = rng.integers(0, 1 << 64, 60, np.uint64)
    asked = [np.unique(rng.choice(some, n)) for n in (40, 0, 25, 1)]
    own = [rng.integers(0, 3, len(x)).astype(np.uint64) << np.uint64(33) for x in asked]
    want = {}
    for x, n in zip(asked, own):
        for a, b in zip(x.tolist(), n.tolist()):
            want[a] = want.get(a, 0) + b
    told, n_all, n_known = lm.totals(asked, own)
    assert [t.tolist() for t in told] == [[want[a] for a in x.tolist()] for x in asked]
    assert n_all == sum(want.values()) and n_known == sum(v > 0 for v in want.values())


def test_a_raking_round_joins_only_its_factors(spark, monkeypatch):
    from vacfleet.llm import mixing
    rows = [(f"s{k % 5}", f"l{k % 3}", f"t{k % 2}", float(1 + k % 4)) for k in range(30)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, weight double")
    targets = {d: cells.select(F.col(d).alias("value")).distinct().withColumn("share", F.lit(1.0) / n)
               for d, n in zip(mixing.DIMS, (5, 3, 2))}
    joins, keep = [], mixing.store
    monkeypatch.setattr(mixing, "store", lambda df, name: (
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")), keep(df, name))[1])
    out = mixing.rake(cells.withColumn("weight", F.col("weight") / 70), targets)
    assert out.columns == cells.columns and len(joins) > 1
    first = joins[1]
    assert first <= 7 and max(joins[1:]) == first  # three factors, nested; no targets
    for d, n in zip(mixing.DIMS, (5, 3, 2)):
        assert all(abs(r.now - 1 / n) < 1e-5 for r in out.groupBy(d).agg(F.sum("weight").alias("now")).collect())


def test_a_change_batch_sorts_one_row_of_a_run(spark, tmp_path, monkeypatch):
    """Runs of equal rows go before the sort; values that come back, rows without a snapshot id, rows
    delivered again and relations without an id leave the log that all rows have."""
    from vacfleet.streaming import jobs
    rng, rows = random.Random(11), []
    for r in [0, 1, 2, None]:
        v = 0
        for s in range(150):
            if rng.random() < 0.06:
                v = rng.choice([0, 1]) if r == 1 else v + 1
            rows += [("n0", r, s, s // 24, v)] * rng.choice([1, 1, 1, 2])
    df = spark.createDataFrame(rows + [("n0", 2, None, 0, 9)], "cluster_id string, relid long, snapshot_id long, collected_day int, n_dead_tup long")
    df = df.withColumns({c: F.lit(None).cast("long") for c in sparse.SIGNATURE if c != "n_dead_tup"})
    seen, changes = [], sparse.day_changes
    monkeypatch.setattr(sparse, "day_changes", lambda c, *keep: (seen.append(c.count()), changes(c, *keep))[1])
    run = jobs.change_log_batch(str(tmp_path / "state"), str(tmp_path / "log"))
    early = F.col("snapshot_id").isNull() | (F.col("snapshot_id") <= 70)
    first, second, third = df.filter(early), df.filter(F.col("snapshot_id").between(60, 110)), df.filter(F.col("snapshot_id") > 100)
    for k, batch in enumerate((first, second, second, third)):
        run(batch, (0, 1, 1, 2)[k])
    assert seen[0] < 0.5 * first.count() and seen[-2] < 0.5 * third.count()
    got = {(r.relid, r.snapshot_id) for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    want = {(2, None)}
    for r in [0, 1, 2, None]:
        prev = 9 if r == 2 else None
        for s, day, v in sorted({x[2:] for x in rows if x[1] == r}):
            if v != prev or (r is None and s % 24 == 0):
                want.add((r, s))
            prev = v
    # without an id no day is joined to the one before: the first row of each day, also of a batch's part of it
    assert {x for x in got if x[0] is not None} == {x for x in want if x[0] is not None}
    assert {x for x in want if x[0] is None} <= got
