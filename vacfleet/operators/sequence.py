"""Previous rows, running totals and trailing first rows that stay bounded under key skew.

A plain ``lag`` over ``partitionBy(key)`` sorts a whole key's history in one task; a
hot key (one relation, one arm) would then sit in a single task. Here the history is
cut into (key, bucket) groups (bucket = a day, a month, ...), ``lag`` runs inside each
group, and the first row of a group takes the last row of the key's previous non-empty
group, found from a per-(key, bucket) ``max_by`` table whose size is one row per group.
The result equals ``lag`` over the full key, row for row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
                 values: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add ``prefix + v`` for each value column: the value on the previous row of the
    same key in ``order`` (NULL on a key's first row), plus ``prefix + 'exists'``."""
    keys, order, values = list(keys), list(order), list(values)
    b = df.withColumn("_bkt", bucket)
    w_in = W.partitionBy(*keys, "_bkt").orderBy(*order)
    payload = F.struct(*[F.col(v) for v in values], F.lit(True).alias("_e"))
    b = b.withColumn("_lag", F.lag(payload).over(w_in))
    # last row of every (key, bucket) group, then the previous group's last row. Catalyst
    # prunes the window from this branch, so it is a partial (map-side) aggregation over
    # the rows: only one row per key, bucket and task is shuffled for it.
    last = (b.groupBy(*keys, "_bkt")
            .agg(F.max_by(payload, F.struct(*[F.col(o) for o in order])).alias("_last")))
    w_b = W.partitionBy(*keys).orderBy("_bkt")
    carry = (last.withColumn("_carry", F.lag("_last").over(w_b))
             .select(*keys, "_bkt", "_carry"))
    j = b.join(carry, [*keys, "_bkt"], "left")
    src = F.coalesce(F.col("_lag"), F.col("_carry"))
    out = j.select(*[F.col(c) for c in df.columns],
                   *[src.getField(v).alias(prefix + v) for v in values],
                   F.coalesce(src.getField("_e"), F.lit(False)).alias(prefix + "exists"))
    return out


#: How a running total over a group joins the carry of the groups before it.
_CARRY = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column,
            totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add running totals (inclusive) over each key's rows in ``order``: a two-level prefix scan.

    ``totals`` maps a new column to ('sum' | 'min' | 'max', value); all three are associative, so a
    total inside a (key, bucket) group joins the carry of the key's earlier groups, found from a table
    of one row a group. ``bucket`` must not fall along ``order``. NULL values are skipped (a sum of
    none is 0); a NULL key is a key.
    """
    keys, names = list(keys), list(totals)
    b = df.withColumns({f"_v_{n}": value for n, (_, value) in totals.items()}).withColumn("_bkt", bucket)
    w_in = W.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = b.withColumns({f"_v_{n}": _AGG[totals[n][0]](f"_v_{n}").over(w_in) for n in names})
    w_b = W.partitionBy(*keys).orderBy("_bkt").rowsBetween(W.unboundedPreceding, -1)
    groups = b.groupBy(*keys, "_bkt").agg(*[_AGG[totals[n][0]](f"_v_{n}").alias(f"_g_{n}") for n in names])
    carry = groups.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bkt").alias("_k_bkt"),
                          *[_AGG[totals[n][0]](f"_g_{n}").over(w_b).alias(f"_c_{n}") for n in names])
    same = F.lit(True)
    for k in (*keys, "_bkt"):
        same = same & F.col(k if k == "_bkt" else f"_i.{k}").eqNullSafe(F.col("_k_bkt" if k == "_bkt" else f"_k_{k}"))
    j = inner.alias("_i").join(carry, same, "left")
    return j.select(*[F.col(f"_i.{c}") for c in df.columns],
                    *[_CARRY[totals[n][0]](F.col(f"_v_{n}"), F.col(f"_c_{n}")).alias(n) for n in names])


def first_within(df: DataFrame, keys: Sequence[str], at: str, tie: str, span: int,
                 values: Sequence[str], prefix: str = "first_") -> DataFrame:
    """Add ``prefix + v``: the value on the key's earliest row in ``[at - span, at]`` (by ``at``, then
    ``tie``; ``at`` is a long).

    Time is cut into buckets of ``span``. The row sought stands in the bucket of ``at - span``, at or
    after that moment, or else it is the first row of the row's own bucket: so a question is put among
    the rows of the earlier bucket, and answered there in one backward pass, or by a table of one row
    a bucket. No task sorts more of a key than two spans.
    """
    keys, values = list(keys), list(values)
    bucket = F.floor(F.col(at) / span)
    payload = F.struct(*[F.col(v) for v in values])
    rows = df.select(*keys, F.col(at).alias("_at"), bucket.alias("_bkt"), F.col(tie).alias("_tie"),
                     payload.alias("_row"), F.lit(None).cast(df.schema).alias("_ask"))
    ask = df.select(*keys, (F.col(at) - span).alias("_at"), (bucket - 1).alias("_bkt"), F.lit(None).cast(df.schema[tie].dataType).alias("_tie"),
                    F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.struct(*[F.col(c) for c in df.columns]).alias("_ask"))
    # from late to early: a question comes after the rows of its own moment
    back = (W.partitionBy(*keys, "_bkt").orderBy(F.col("_at").desc(), F.col("_tie").desc_nulls_last())
            .rowsBetween(W.unboundedPreceding, W.currentRow))
    told = (rows.unionByName(ask).withColumn("_found", F.last("_row", ignorenulls=True).over(back))
            .filter(F.col("_ask").isNotNull()).withColumn("_bkt", F.col("_bkt") + 1))
    first = rows.groupBy(*keys, "_bkt").agg(F.min_by("_row", F.struct("_at", "_tie")).alias("_first"))
    j = told.join(first, [*keys, "_bkt"])
    src = F.coalesce("_found", "_first")
    return j.select("_ask.*", *[src.getField(v).alias(prefix + v) for v in values])
