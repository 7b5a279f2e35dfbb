"""Numbers, ranks and running sums without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.shared import frozen


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """1..N in the given total order: rows are range-partitioned, numbered in each range and shifted by the ranges before.

    The ranged rows are written once, since a range that is computed twice may hold other rows. The counts of the ranges, one small
    row for each shuffle partition, are all that meets in one task. ``order`` must be total.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    rows = frozen(ranged, "numbered")  # an id is the range's number, then 33 bits of the place in it
    sizes = rows.groupBy(F.shiftright("__id", 33).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(shift), F.shiftright("__id", 33) == F.col("__p")).withColumn(name, (F.col("__shift") + place).cast("long")).drop("__id", "__p", "__shift")


def piece(x: Column) -> Column:
    """An integer that ascends with a number and splits any range of numbers: sign, exponent and 64 steps of the mantissa."""
    size = F.abs(x.cast("double"))
    exponent = F.floor(F.log2(size))
    step = (exponent + 1100) * 64 + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * 64)
    return F.coalesce(F.when(size == 0, 0).when(x < 0, -step).otherwise(step), F.lit(-(1 << 20))).cast("long")


def running(df: DataFrame, groups: list[str], by: str, sums: list[str], down: bool = False) -> DataFrame:
    """``df`` with to_<s>, the sum of ``s`` over rows of the group up to this one by ``by``, and all_<s>. Values of ``by`` are distinct in a group.

    Rows are summed within pieces of the range of ``by``, and pieces are shifted by those before: no task holds a group.
    """
    keys = [*groups, "__piece"]
    rows = df.withColumn("__piece", piece(F.col(by)))
    order = (lambda c: F.desc(c)) if down else (lambda c: F.asc(c))
    before = Window.partitionBy(*groups).orderBy(order("__piece")).rowsBetween(Window.unboundedPreceding, -1)
    whole, inside = Window.partitionBy(*groups), Window.partitionBy(*keys).orderBy(order(by)).rowsBetween(Window.unboundedPreceding, 0)
    shift = rows.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])
    shift = shift.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"__b_{s}") for s in sums], *[F.sum(s).over(whole).alias(f"all_{s}") for s in sums])
    out = rows.select("*", *[F.sum(s).over(inside).alias(f"__in_{s}") for s in sums])
    out = out.join(shift, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    for s in sums:
        out = out.withColumn(f"to_{s}", F.col(f"__in_{s}") + F.col(f"__b_{s}"))
    return out.drop("__piece", *[f"__k{i}" for i in range(len(keys))], *[f"__{x}_{s}" for s in sums for x in ("in", "b")])


def place_within(df: DataFrame, groups: list[str], part: Column, order: list, name: str) -> DataFrame:
    """1-based place in the group; ``part`` is an integer that ascends with ``order`` and splits a large group."""
    keys = [*groups, "__part"]
    rows = df.withColumn("__part", part)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    out = rows.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.join(shift, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    return out.withColumn(name, (F.col("__shift") + F.col("__row")).cast("long")).drop("__part", "__row", "__shift", *[f"__k{i}" for i in range(len(keys))])
