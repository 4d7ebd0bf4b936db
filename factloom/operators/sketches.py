"""Mergeable sketches: distinct counts and quantiles stored by fine groups, and rolled up without another scan of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches: a relative error of about 1.04 / 2**(HLL_BITS / 2) for counts, a rank error of about 1 % for quantiles.
HLL_BITS, KLL_K = 14, 400


def stored(rows: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """One row for each group of by: n, distinct_sketch (of the column distinct) and value_sketch (of value, as a double).

    Nulls in distinct and value are not counted by the sketches; a null in by is a group of its own.
    """
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(distinct, HLL_BITS).alias("distinct_sketch"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("value_sketch"))


def rolled(groups: DataFrame, by: list[str]) -> DataFrame:
    """The groups of stored() merged to coarser ones; by may be empty, for one row of all."""
    return groups.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch", KLL_K).alias("value_sketch"))


def cubed(groups: DataFrame, by: list[str]) -> DataFrame:
    """All roll-ups of by at once: a null in by means all its values, level tells these from groups of a null (bits of by, the first highest)."""
    return groups.cube(*by).agg(F.grouping_id().alias("level"), F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.kll_merge_agg_double("value_sketch", KLL_K).alias("value_sketch"))


def distinct_count(sketch: str = "distinct_sketch") -> Column:
    return F.hll_sketch_estimate(sketch)


def quantile(share: float, sketch: str = "value_sketch") -> Column:
    """The value below which about that share of all values lie; null of an empty sketch."""
    some = F.kll_sketch_get_n_double(sketch) > 0
    return F.when(some, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))
