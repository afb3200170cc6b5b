"""Joins in time: nearest, forward and backward as-of joins, and joins of intervals by buckets.

As-of joins are one sort of both sides' rows by key and time and a look at the neighbours - no pair of rows is formed.
Interval joins turn the inequality into an equality on time buckets; a pair is reported only in the bucket where its
later start lies, so it comes once and nothing needs to be made distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _both(left: DataFrame, right: DataFrame, keys: Sequence[str], t_left: str, t_right: str, tie: str | None) -> tuple[DataFrame, Window]:
    keep_left, keep_right = [c for c in left.columns if c not in keys], [c for c in right.columns if c not in keys]
    a = left.select(*keys, F.col(t_left).alias("_t"), F.struct(*keep_left).alias("_l"), F.lit(None).cast(right.select(F.struct(*keep_right)).schema[0].dataType).alias("_r"), F.lit(None).cast("bigint").alias("_tie"))
    b = right.select(*keys, F.col(t_right).alias("_t"), F.lit(None).cast(left.select(F.struct(*keep_left)).schema[0].dataType).alias("_l"), F.struct(*keep_right).alias("_r"), (F.col(tie) if tie else F.lit(0)).cast("bigint").alias("_tie"))
    return a.union(b), Window.partitionBy(*keys)


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], t_left: str, t_right: str, direction: str = "nearest", tie: str | None = None, clamp: bool = False) -> DataFrame:
    """Each left row with the right row of its key that is nearest, or first at or after it (forward), or last at or before it (backward).

    Of equally near rows the earlier wins, of equal times the one with the smaller `tie`. clamp: where a direction has
    none, the nearest of the other side is taken. Rows without any match have nulls. Right columns mustn't clash with left ones.
    """
    rows, own = _both(left, right, keys, t_left, t_right, tie)
    up = own.orderBy(F.col("_t"), F.col("_l").isNotNull().cast("int").asc(), F.col("_tie").desc_nulls_last())
    down = own.orderBy(F.col("_t"), F.col("_l").isNull().cast("int").asc(), F.col("_tie").asc_nulls_first())
    seen = F.when(F.col("_r").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_r").alias("r")))
    rows = rows.withColumn("_before", F.last(seen, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_after", F.first(seen, ignorenulls=True).over(down.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.where(F.col("_l").isNotNull())
    before, after = F.col("_before"), F.col("_after")
    if direction == "nearest":
        choice = F.when(before.isNull(), after).when(after.isNull(), before).when(F.col("_t") - before["t"] <= after["t"] - F.col("_t"), before).otherwise(after)
    else:
        first, other = (after, before) if direction == "forward" else (before, after)
        choice = F.coalesce(first, other) if clamp else first
    return rows.withColumn("_c", choice).select(*keys, "_l.*", "_c.r.*")


def buckets(start: Column, end: Column, width) -> Column:
    return F.sequence(F.floor(start / width).cast("bigint"), F.floor(end / width).cast("bigint"))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: tuple[str, str], b: tuple[str, str], width, condition: Column | None = None) -> DataFrame:
    """Pairs of a key whose closed intervals a (left's columns) and b (right's) meet. width: of a bucket, about an interval's length."""
    x = left.withColumn("_bucket", F.explode(buckets(F.col(a[0]), F.col(a[1]), width)))
    y = right.withColumn("_bucket", F.explode(buckets(F.col(b[0]), F.col(b[1]), width)))
    joined = x.join(y, [*keys, "_bucket"]).where((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])))
    joined = joined.where(F.col("_bucket") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / width)).drop("_bucket")
    return joined.where(condition) if condition is not None else joined


def stab_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, b: tuple[str, str], width) -> DataFrame:
    """Points with the closed intervals of their key that they lie in."""
    x = points.withColumn("_bucket", F.floor(F.col(t) / width).cast("bigint"))
    y = intervals.withColumn("_bucket", F.explode(buckets(F.col(b[0]), F.col(b[1]), width)))
    return x.join(y, [*keys, "_bucket"]).where(F.col(t).between(F.col(b[0]), F.col(b[1]))).drop("_bucket")
