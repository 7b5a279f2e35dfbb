"""Projected scans with the filters that a cohort-first extraction needs, and the sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns are read; one that is missing is an error."""
    df = spark.read.parquet(path)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return df.select(*columns)


def scan_csv(spark: SparkSession, path: str, schema: str, columns: list[str], partitions: int | None = None) -> DataFrame:
    """CSV or gzip CSV with a header; a gzip file is one split, so it is dealt out after the read when ``partitions`` is given."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in columns if c not in header]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    df = spark.read.option("header", True).schema(schema).csv(path).select(*columns)
    return df.repartition(partitions) if partitions else df


def _identifiers(*names: str) -> None:
    for name in names:
        if not name.isascii() or not name.replace("_", "").isalnum() or name[0].isdigit():
            raise ValueError(f"not an identifier: {name}")


def read_jdbc(spark: SparkSession, url: str, table: str, columns: list[str], key: str | None = None, bounds: tuple[int, int, int] | None = None, partitions: int | None = None, properties: dict | None = None, optional: bool = False) -> DataFrame | None:
    """A projected table over JDBC; names are checked before they reach the source.

    It is read in parallel by ``key``: in equal steps when ``bounds`` (lower, upper, partitions) are given, else in ``partitions``
    parts at quantiles of the key, so that a key that is dense in one place is cut there more often. Columns and filters of Spark
    reach the source. A table that the source does not have is None if it is ``optional``, else an error.
    """
    _identifiers(*table.split("."), *columns, *([key] if key else []))
    properties = properties or {}
    if optional and not _jdbc_has(spark, url, table, properties):
        return None
    if key and bounds:
        low, high, n = bounds
        return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=n, properties=properties).select(*columns)
    if key and partitions:
        return spark.read.jdbc(url, table, predicates=_key_parts(spark, url, table, key, partitions, properties), properties=properties).select(*columns)
    return spark.read.jdbc(url, table, properties=properties).select(*columns)


def _jdbc_has(spark: SparkSession, url: str, table: str, properties: dict) -> bool:
    """Whether the source lists the table or view, names in any case."""
    jvm = spark._jvm
    options = jvm.java.util.Properties()
    for k, v in properties.items():
        options.setProperty(k, v)
    if driver := properties.get("driver"):
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver)
    source = jvm.java.sql.DriverManager.getConnection(url, options)
    try:
        schema, _, name = table.rpartition(".")
        for own in {name, name.upper(), name.lower()}:
            for place in {schema, schema.upper(), schema.lower()} if schema else {None}:
                if source.getMetaData().getTables(None, place, own, None).next():
                    return True
        return False
    finally:
        source.close()


def _key_parts(spark: SparkSession, url: str, table: str, key: str, partitions: int, properties: dict) -> list[str]:
    """Disjoint conditions on a number key that cover all rows, null keys too; only the key is read for them."""
    cuts = spark.read.jdbc(url, table, properties=properties).agg(F.percentile_approx(F.col(key).cast("long"), [i / partitions for i in range(1, partitions)], 10_000).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    if not cuts:
        return ["1 = 1"]
    inner = [f"{key} > {a} AND {key} <= {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{key} <= {cuts[0]} OR {key} IS NULL", *inner, f"{key} > {cuts[-1]}"]


def members_jdbc(spark: SparkSession, url: str, table: str, columns: list[str], column: str, keys: list[int], most: int = 1000, properties: dict | None = None) -> DataFrame:
    """Rows whose ``column`` is among the keys, filtered at the source in parts of ``most`` keys, a partition each; no keys give no rows."""
    _identifiers(*table.split("."), *columns, column)
    own = sorted({int(k) for k in keys})
    parts = [f"{column} IN ({', '.join(map(str, own[i : i + most]))})" for i in range(0, len(own), most)] or ["1 = 0"]
    return spark.read.jdbc(url, table, predicates=parts, properties=properties or {}).select(*columns)


def members(df: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """Rows of which ``column`` is among the one column of ``keys``. Spark broadcasts ``keys`` when it is small."""
    k = keys.select(F.col(keys.columns[0]).alias("__k")).distinct()
    return df.join(k, F.col(column) == F.col("__k"), "left_semi")


def any_member(df: DataFrame, allowed: dict[str, DataFrame]) -> DataFrame:
    """Rows of which any of the columns is among its keys: one equi-join per column and no OR join."""
    flags = []
    for i, (column, keys) in enumerate(allowed.items()):
        k = keys.select(F.col(keys.columns[0]).alias(f"__k{i}")).distinct()
        df = df.join(k, F.col(column) == F.col(f"__k{i}"), "left")
        flags.append(F.col(f"__k{i}").isNotNull())
    hit = flags[0]
    for f in flags[1:]:
        hit = hit | f
    return df.filter(hit).drop(*[f"__k{i}" for i in range(len(flags))])


def primary_or_fallback(df: DataFrame, primary: str, keys: DataFrame, fallback: str, other: DataFrame) -> DataFrame:
    """primary among ``keys``, or primary null and fallback among ``other``: halves that cannot overlap."""
    first = members(df.filter(F.col(primary).isNotNull()), primary, keys)
    return first.unionByName(members(df.filter(F.col(primary).isNull()), fallback, other))


def in_bounds(df: DataFrame, column: str, low: Column, high: Column) -> DataFrame:
    """low <= column < high."""
    return df.filter((F.col(column) >= low) & (F.col(column) < high))


def event_filter(df: DataFrame, policy: str, visit: str, visits: DataFrame, patient: str, patients: DataFrame) -> DataFrame:
    if policy == "direct_hadm_only":
        return members(df, visit, visits)
    if policy == "direct_then_patient_time":
        return primary_or_fallback(df, visit, visits, patient, patients)
    raise ValueError(policy)


def write_csv(df: DataFrame, path: str, places: int = 10) -> None:
    """CSV with doubles printed to a fixed number of places."""
    kinds = dict(df.dtypes)
    df.select(*[F.format_string(f"%.{places}f", c).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)


def write_stage(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    (df.write.partitionBy(*by) if by else df.write).mode("overwrite").parquet(path)
