"""Distinct counts that merge: stored sketches per day, united for any window (A5).

An exact distinct count over a window reads the window's rows again. A HyperLogLog sketch per cluster
and day is a few kilobytes, and the sketches of any days unite into that of all their rows, so a window
of a year is a few hundred small rows. The estimate's standard error is ``ERROR``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch: 2 to this power.
LOG_REGISTERS = 13
#: Standard error of an estimate.
ERROR = 1.04 / 2 ** (LOG_REGISTERS / 2)


def day_sketches(df: DataFrame, day: Column, value: Column) -> DataFrame:
    """One sketch of the values per cluster and day (``cluster_id, day, sketch``)."""
    return (df.filter(value.isNotNull()).groupBy("cluster_id", day.alias("day"))
            .agg(F.hll_sketch_agg(value, LOG_REGISTERS).alias("sketch")))


def united(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The estimated distinct values of all days of a group (``estimate``)."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
