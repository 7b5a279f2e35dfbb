"""Features of the 50 concepts of each training fold."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import TABLES, _rows
from tidewater.operators import features
from tidewater.plans import ORACLES, QUERIES

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", ["measurement_features_top", "exposure_features_top"])
def test_top_features_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got = QUERIES[name](spark, D).toPandas()
    per = got.groupby("fold")["concept_key"].nunique()
    assert per.max() <= 50 and set(per) == {n for (n,) in con.execute(f"select distinct n from (select fold, count(*) as n from ({ORACLES['concept_topk']}) group by 1)").fetchall()}
    assert (got["count"] > 0).any() and _rows(got) == _rows(con.execute(ORACLES[name]).df())


def test_top_cells_are_not_shuffled(spark):
    """The grid of visits and concepts comes after the last shuffle, and equals a plain loop."""
    events = spark.createDataFrame([(v, c, float(v + i)) for v in range(40) for i, c in enumerate("aab" if v % 3 else "c")], "visit_id long, concept_key string, value double")
    cohort = spark.createDataFrame([(v,) for v in range(60)], "visit_id long")
    top = spark.createDataFrame([(f, c, r) for f in (1, 2) for r, c in enumerate("ab" if f == 1 else "bz", 1)], "fold int, concept_key string, rank int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = features.top_cells(events, cohort, top, [F.sum("value").alias("s"), F.count(F.lit(1)).alias("n")])
        plan = df._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, df.select("fold", "visit_id", "concept_key", "rank", "s", "n").collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Exchange" not in plan[: plan.index("BroadcastNestedLoopJoin")]
    own = {(v, c): [float(v + i) for i, x in enumerate("aab" if v % 3 else "c") if x == c] for v in range(40) for c in "abc"}
    want = [(f, v, c, r, sum(x) if (x := own.get((v, c))) else None, len(x) if x else None) for f, v, c, r in [(f, v, c, r) for f, cs in ((1, "ab"), (2, "bz")) for r, c in enumerate(cs, 1) for v in range(60)]]
    assert got == sorted(want, key=repr)
