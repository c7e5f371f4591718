"""Join of points with intervals by bins: an equi-join, where a join on BETWEEN alone compares all with all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the intervals' bins up to which they are broadcast.
BROADCAST_ROWS = 100_000


def interval_join(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, width: int, how: str = "inner") -> DataFrame:
    """``points`` with the columns of the intervals that hold ``at`` (a whole number; both ends belong to an interval).

    Bins are ``width`` wide, about as intervals are: each interval stands in all bins that it touches, each point in one, so
    that a pair meets once. Bins are broadcast when they were counted to be few and shuffled otherwise. how: inner or left.
    Defined cases: null points and intervals that end before they begin or have a null end meet nothing; points in several
    intervals have a row for each; columns must differ in name.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no such join: {how}")
    bin_of = lambda value: F.floor(value / width)
    valid = intervals.filter(F.col(low) <= F.col(high))
    binned = valid.withColumn("__bin", F.explode(F.sequence(bin_of(F.col(low)), bin_of(F.col(high)))))
    if binned.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        binned = F.broadcast(binned)
    own = bin_of(F.col(at))
    return points.join(binned, (own == F.col("__bin")) & (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)), how).drop("__bin")
