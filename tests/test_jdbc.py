"""Tables over JDBC: read in parallel parts, optional tables, keys filtered at the source. The database is in this process's memory."""

import pytest
from pyspark.sql import functions as F

from tidewater.sources.scans import members_jdbc, read_jdbc

URL, OPTIONS = "jdbc:derby:memory:tidewater;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", str(tmp_path_factory.mktemp("derby") / "derby.log"))
    # keys are dense at the low end, with nulls and repeats
    rows = spark.range(1000).select(F.when(F.col("id") % 100 == 99, None).when(F.col("id") < 800, F.col("id") % 80).otherwise(F.col("id") * 1000).alias("K"), F.col("id").alias("V"), F.lit("x").alias("W"))
    rows.coalesce(1).write.jdbc(URL, "VISITS", mode="overwrite", properties=OPTIONS)
    return sorted(r["V"] for r in rows.collect())


def test_parts_by_quantiles_cover_every_row_once(spark, table):
    df = read_jdbc(spark, URL, "VISITS", ["K", "V"], key="K", partitions=6, properties=OPTIONS)
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert df.columns == ["K", "V"] and sorted(r["V"] for r in df.collect()) == table
    assert len(sizes) >= 5 and max(sizes) < 400  # steps of equal width would put 800 rows in one part
    one = read_jdbc(spark, URL, "VISITS", ["V"], key="K", bounds=(0, 1000000, 4), properties=OPTIONS)
    assert sorted(r["V"] for r in one.collect()) == table and sorted(r["V"] for r in read_jdbc(spark, URL, "VISITS", ["V"], properties=OPTIONS).collect()) == table


def test_columns_and_filters_reach_the_source(spark, table):
    plan = read_jdbc(spark, URL, "VISITS", ["V"], properties=OPTIONS).filter("V = 7")._jdf.queryExecution().toString()
    assert "PushedFilters: [*IsNotNull(V), *EqualTo(V,7)]" in plan and "ReadSchema: struct<V:bigint>" in plan


def test_optional_tables_may_be_absent(spark, table):
    assert read_jdbc(spark, URL, "NOTES", ["V"], properties=OPTIONS, optional=True) is None
    assert read_jdbc(spark, URL, "visits", ["V"], properties=OPTIONS, optional=True).count() == 1000
    with pytest.raises(Exception):
        read_jdbc(spark, URL, "NOTES", ["V"], properties=OPTIONS).count()


def test_keys_are_filtered_at_the_source(spark, table):
    df = members_jdbc(spark, URL, "VISITS", ["V"], "V", [5, 7, 7, 999, 5000], most=2, properties=OPTIONS)
    assert sorted(r["V"] for r in df.collect()) == [5, 7, 999] and df._jdf.rdd().getNumPartitions() == 2
    assert members_jdbc(spark, URL, "VISITS", ["V"], "V", [], properties=OPTIONS).count() == 0


def test_names_are_checked(spark):
    for bad in ("VISITS; DROP TABLE X", "1x", "a-b", "é"):
        with pytest.raises(ValueError):
            read_jdbc(spark, URL, bad, ["V"])
        with pytest.raises(ValueError):
            read_jdbc(spark, URL, "VISITS", [bad])
