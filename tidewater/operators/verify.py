"""Frozen tables that are made again and compared: digests by range of keys first, rows of the ranges that differ alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.audit import ConstraintError, canonical_json, table_diff

RANGES = 256


def _range(keys: list[str], ranges: int) -> Column:
    """A range of the keys' hash; null keys have one too."""
    return F.pmod(F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]), F.lit(ranges)).cast("int")


def range_digests(df: DataFrame, ranges: int) -> DataFrame:
    """(range, rows, digest) of a table with a column __range, in one pass: sums of row hashes, doubles rounded to ten places."""
    kinds = dict(df.dtypes)
    rounded = df.select("__range", *[F.round(c, 10).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns if c != "__range"])
    row = canonical_json(*[c for c in rounded.columns if c != "__range"])
    number = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rounded.select("__range", number.alias("h")).groupBy(F.col("__range").alias("range")).agg(F.count(F.lit(1)).alias("rows"), F.sum("h").cast("string").alias("digest"))


def freeze(df: DataFrame, keys: list[str], path: str, ranges: int = RANGES) -> None:
    """Writes the table, a folder for each range of keys, and the digests of the ranges."""
    placed = df.withColumn("__range", _range(keys, ranges))
    placed.repartition("__range").write.partitionBy("__range").mode("overwrite").parquet(f"{path}/rows")
    stored = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows")
    range_digests(stored, ranges).coalesce(1).write.mode("overwrite").parquet(f"{path}/digests")


def differing_ranges(df: DataFrame, keys: list[str], path: str, ranges: int = RANGES) -> list[int]:
    """The ranges whose digests are not those of the frozen table; at most ``ranges`` rows come to the driver."""
    now = range_digests(df.withColumn("__range", _range(keys, ranges)), ranges)
    then = df.sparkSession.read.parquet(f"{path}/digests").select("range", F.col("rows").alias("rows_then"), F.col("digest").alias("digest_then"))
    both = now.join(then, "range", "full_outer").filter(~(F.col("rows").eqNullSafe(F.col("rows_then")) & F.col("digest").eqNullSafe(F.col("digest_then"))))
    return sorted(r["range"] for r in both.select("range").collect())


def frozen_rows(spark: SparkSession, like: DataFrame, path: str, only: list[int] | None = None) -> DataFrame:
    """The frozen rows with the columns of ``like``; of the given ranges no other folder is read."""
    rows = spark.read.schema(T.StructType([*like.schema.fields, T.StructField("__range", T.IntegerType())])).parquet(f"{path}/rows")
    return (rows if only is None else rows.filter(F.col("__range").isin(only or [-1]))).drop("__range")


def verify(df: DataFrame, keys: list[str], path: str, ranges: int = RANGES, atol: float = 5e-11) -> DataFrame:
    """(keys, column, kind) of the cells in which ``df``, made again, differs from the frozen table; keys are unique in both."""
    bad = differing_ranges(df, keys, path, ranges)
    again = df.filter(_range(keys, ranges).isin(bad or [-1]))
    return table_diff(frozen_rows(df.sparkSession, df, path, bad), again, keys, atol)


def with_evidence(comparison: DataFrame, good: Column, message: str, evidence: str) -> DataFrame:
    """The comparison as a table at ``evidence``, written before it is judged: an error if a row does not pass, with the rows to be read there."""
    comparison.write.mode("overwrite").parquet(evidence)
    table = comparison.sparkSession.read.parquet(evidence)
    if n := table.filter(~F.coalesce(good, F.lit(False))).count():
        raise ConstraintError(f"{message}: {n} rows; see {evidence}")
    return table
