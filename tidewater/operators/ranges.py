"""Joins of points in time with intervals of the same key, by buckets of days.

An interval covers buckets, a point lies in one, so joins are equi joins on (key, bucket) with the exact bounds after them, and a key
with very many points or intervals is split by time. Where only counts or sets are asked for, buckets that lie wholly inside an
interval contribute sums made beforehand; single points are compared in the two buckets at its ends alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of a bucket of the second level, for intervals of more than so many buckets of the first.
COARSE = 64


def bucket(time: Column, days: int) -> Column:
    return F.floor(F.unix_date(F.to_date(time)) / F.lit(days)).cast("long")


def range_join(points: DataFrame, time: str, intervals: DataFrame, low: str, high: str, on: str, days: int | None = None) -> DataFrame:
    """Columns of both for each point with low <= time < high in an interval of the same key; ``intervals`` names the key __on.

    Intervals of up to COARSE days are dealt by days, longer ones by COARSE days; a point is looked up in both. Where the caller knows
    that intervals are no longer than a few times ``days``, all are dealt by so many days and a point is looked up once. Null keys, times
    and bounds meet nothing.
    """
    v = intervals.filter(F.col("__on").isNotNull() & (F.col(low) < F.col(high)))
    p = points.filter(F.col(on).isNotNull() & F.col(time).isNotNull())
    if days:
        v = v.withColumn("__bucket", F.explode(F.sequence(bucket(F.col(low), days), bucket(F.col(high), days))))
        place = bucket(F.col(time), days) == F.col("__bucket")
    else:
        level = F.when(F.datediff(F.to_date(high), F.to_date(low)) > COARSE, COARSE).otherwise(1)
        v = v.withColumn("__level", level).withColumn("__bucket", F.explode(F.when(F.col("__level") == 1, F.sequence(bucket(F.col(low), 1), bucket(F.col(high), 1))).otherwise(F.sequence(bucket(F.col(low), COARSE), bucket(F.col(high), COARSE)))))
        p = p.withColumn("__place", F.explode(F.array(*[F.struct(F.lit(n).alias("level"), bucket(F.col(time), n).alias("bucket")) for n in (1, COARSE)])))
        place = (F.col("__place.level") == F.col("__level")) & (F.col("__place.bucket") == F.col("__bucket"))
    inside = (F.col(on) == F.col("__on")) & place
    return p.join(v, inside & (F.col(time) >= F.col(low)) & (F.col(time) < F.col(high))).drop("__on", "__level", "__bucket", "__place")


def range_cells(points: DataFrame, time: str, values: list[str], intervals: DataFrame, low: str, high: str, on: str, days: int) -> DataFrame:
    """(columns of ``intervals``, values, n): sums of n over the rows of an interval count its points with low <= time < high by value.

    Points of one key, time and value are counted first. Buckets inside an interval come as one row for each value, so a pair of an
    interval and a point exists only at the ends.
    """
    p = points.filter(F.col(on).isNotNull() & F.col(time).isNotNull())
    fine = p.groupBy(on, F.col(time).alias("__time"), *values).agg(F.count(F.lit(1)).alias("n")).withColumn("__bucket", bucket(F.col("__time"), days))
    whole = fine.groupBy(on, "__bucket", *values).agg(F.sum("n").alias("n"))
    v = intervals.filter(F.col(low) < F.col(high)).withColumn("__lo", bucket(F.col(low), days)).withColumn("__hi", bucket(F.col(high), days))
    ends = v.withColumn("__bucket", F.explode(F.array_distinct(F.array("__lo", "__hi")))).join(fine, [on, "__bucket"])
    ends = ends.filter((F.col("__time") >= F.col(low)) & (F.col("__time") < F.col(high)))
    inner = v.filter(F.col("__hi") > F.col("__lo") + 1).withColumn("__bucket", F.explode(F.sequence(F.col("__lo") + 1, F.col("__hi") - 1))).join(whole, [on, "__bucket"])
    keep = [*intervals.columns, *values, "n"]
    return ends.select(*keep).unionByName(inner.select(*keep))


def before_any(rows: DataFrame, time: str, ends: DataFrame, end: str, on: str, lookback_days: int) -> DataFrame:
    """``rows`` with end - look-back <= time < end for some end of the same key.

    The ends of a key become one row for each bucket: whether an interval covers it, the least beginning and the last end inside it.
    """
    days = max(1, lookback_days // 8)
    v = ends.select(F.col(on).alias("__on"), F.col(end).alias("__high")).filter(F.col("__on").isNotNull() & F.col("__high").isNotNull()).distinct().withColumn("__low", F.col("__high") - F.expr(f"make_dt_interval({lookback_days})"))
    v = v.withColumn("__lo", bucket(F.col("__low"), days)).withColumn("__hi", bucket(F.col("__high"), days))  # look-backs are longer than a bucket
    b = v.withColumn("__bucket", F.explode(F.sequence("__lo", "__hi")))
    first, last = F.col("__bucket") == F.col("__lo"), F.col("__bucket") == F.col("__hi")
    b = b.groupBy("__on", "__bucket").agg(F.max((~first & ~last).cast("int")).alias("__covered"), F.min(F.when(first, F.col("__low"))).alias("__from"), F.max(F.when(last, F.col("__high"))).alias("__until"))
    near = (F.col(on) == F.col("__on")) & (bucket(F.col(time), days) == F.col("__bucket"))
    return rows.join(b, near & ((F.col("__covered") == 1) | (F.col(time) >= F.col("__from")) | (F.col(time) < F.col("__until"))), "left_semi")
