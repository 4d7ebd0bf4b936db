"""Joins by time: spans that overlap, and the last row before a moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _day(column: str) -> Column:
    return F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date"))


def overlaps(left: DataFrame, right: DataFrame, on: list[str], width_days: int = 90) -> DataFrame:
    """Pairs of rows with equal keys on whose spans of days (columns first and last, both included) share a day.

    The columns are on, those of left as left_... and those of right as right_.... A span comes once for each bin of width_days
    that it touches, so rows meet by an equi join of keys and bins; of the bins that two spans share only the first one
    reports them. width_days should be about the length of a usual span: shorter bins repeat rows, longer ones bring
    more rows together that do not overlap. on may be empty: bins alone then deal out the rows. Rows with a null key, first or
    last, or that end before they begin, meet nothing; repeated rows pair as often as they come.
    """

    def binned(rows: DataFrame, side: str) -> DataFrame:
        sound = rows.where(F.col("first").isNotNull() & F.col("last").isNotNull() & (F.col("first") <= F.col("last")))
        begin, end = (F.floor(_day(c) / width_days).cast("int") for c in ("first", "last"))
        own = [F.col(c).alias(f"{side}_{c}") for c in rows.columns if c not in on]
        return sound.select(*on, *own, begin.alias(f"{side}_bin"), F.explode(F.sequence(begin, end)).alias("bin"))

    pairs = binned(left, "left").join(binned(right, "right"), [*on, "bin"])
    meet = (F.col("bin") == F.greatest("left_bin", "right_bin")) & (F.col("left_first") <= F.col("right_last")) & (F.col("right_first") <= F.col("left_last"))
    return pairs.where(meet).drop("bin", "left_bin", "right_bin")


def last_before(moments: DataFrame, states: DataFrame, on: list[str], time: str, carry: list[str], cell_days: int = 30) -> DataFrame:
    """moments with the columns carry of the last row of states with the same keys at that time or before it; nulls where there is none.

    Both sides have on and time. Of states at one time the one with the greatest values of carry, in that order, is the
    last. Rows of both sides are laid out in cells of a key and cell_days days. Inside a cell the last state is carried
    along by a window; the last states of cells are carried from cell to cell by a second one, over one row for each
    cell. So a key is split over as many tasks as it has cells, whatever share of all rows it holds. Moments with a null
    key or time have nulls; repeated moments stay.
    """
    cell = F.floor(_day(time) / cell_days).cast("int")
    known = F.struct(F.col(time).alias("at"), *carry)
    later = moments.select(*moments.columns, cell.alias("_cell"), F.lit(None).cast(states.select(known).schema[0].dataType).alias("_state"), F.lit(1).alias("_side"))
    earlier = states.where(F.col(time).isNotNull()).select(*on, time, cell.alias("_cell"), known.alias("_state"), F.lit(0).alias("_side"))
    both = later.unionByName(earlier, allowMissingColumns=True)
    along = W.partitionBy(*on, "_cell").orderBy(time, "_side", "_state")
    inside = both.withColumn("_inside", F.last("_state", ignorenulls=True).over(along)).where("_side = 1")
    ends = earlier.select(*on, "_cell", "_state").unionByName(later.select(*on, "_cell", "_state")).groupBy(*on, "_cell").agg(F.max("_state").alias("_end"))
    across = W.partitionBy(*on).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*(F.col(c).alias(f"_{c}") for c in on), F.col("_cell").alias("_of"), F.last("_end", ignorenulls=True).over(across).alias("_before"))
    found = inside.join(ends, [inside["_cell"] == ends["_of"], *(inside[c] == ends[f"_{c}"] for c in on)], "left")
    state = F.coalesce("_inside", "_before")
    none = F.greatest(*(F.col(c).isNull() for c in (*on, time))) if on else F.col(time).isNull()
    return found.select(*moments.columns, *(F.when(~none, state[c]).alias(c) for c in carry))
