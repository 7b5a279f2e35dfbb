"""Global numbers and running sums on many rows and partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import evaluation, features
from tidewater.operators.numbering import numbered, place_within, running


def test_numbering_keeps_every_row_of_wide_tables(spark):
    n = 3_000_000
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = spark.range(n).repartition(64).select("id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("payload"))
        out = numbered(rows, [F.col("id")], "n").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") != F.col("id") + 1).alias("wrong"), F.count_if(F.length("payload") != 128).alias("short")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (out["rows"], out["wrong"], out["short"]) == (n, 0, 0)


def test_numbering_of_no_rows_and_of_descending_orders(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "c")], "x int, y string")
    assert [r["x"] for r in numbered(df, [F.desc("x")], "n").orderBy("n").collect()] == [3, 2, 1]
    assert numbered(df.limit(0), [F.col("x")], "n").count() == 0


def test_running_sums_over_any_range(spark):
    rng = np.random.default_rng(1)
    x = np.unique(np.concatenate((rng.normal(0, 1e3, 500), 2.0 ** np.arange(-30, 30), -(2.0 ** np.arange(-30, 30)), np.nextafter(2.0 ** np.arange(-5, 20), 0), [0.0, 1e-300, 1e300])))
    w = rng.integers(1, 9, len(x))
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(x, w)], "g string, x double, w long")
    up = {r["x"]: (r["to_w"], r["all_w"]) for r in running(df, ["g"], "x", ["w"]).collect()}
    down = {r["x"]: r["to_w"] for r in running(df, ["g"], "x", ["w"], down=True).collect()}
    total = int(w.sum())
    assert [up[v] for v in x.tolist()] == [(int(c), total) for c in np.cumsum(w)]
    assert [down[v] for v in x.tolist()[::-1]] == np.cumsum(w[::-1]).tolist()


def test_rank_metrics_of_a_million_distinct_scores(spark):
    n = 1_000_000
    df = spark.range(n).select(F.lit("a").alias("matrix"), F.lit("m").alias("model"), ((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) + F.lit(0.5)) / (1 << 40)).alias("p"), F.col("id").alias("n"))
    df = df.withColumn("outcome", (F.pmod(F.xxhash64(F.lit(1), "n"), F.lit(1000)) / 1000 < F.col("p") / 2).cast("int"))
    got = evaluation.metrics(evaluation.counts(df, ["matrix", "model"]), ["matrix", "model"]).first()
    t = df.select("p", "outcome").toPandas().sort_values("p")
    rank, y = np.arange(1, n + 1), t["outcome"].to_numpy()
    pos = int(y.sum())
    auc = (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))
    assert abs(got["auroc"] - auc) < 1e-9
    down = y[::-1]
    assert abs(got["auprc"] - (np.cumsum(down) / rank)[down == 1].sum() / pos) < 1e-9
    bins = evaluation.calibration_bins(df, ["matrix", "model"]).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [n // 10] * 10 and [b["events"] for b in bins] == y.reshape(10, -1).sum(1).tolist()


def test_places_in_pieces(spark):
    df = spark.createDataFrame([("a", i) for i in (70_000, 3, 140_000, 5)] + [("b", 1)], "g string, n long")
    out = {(r["g"], r["n"]): r["r"] for r in place_within(df, ["g"], F.shiftright("n", 16), ["n"], "r").collect()}
    assert out == {("a", 3): 1, ("a", 5): 2, ("a", 70_000): 3, ("a", 140_000): 4, ("b", 1): 1}


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_medians_outside_a_fold(spark, n):
    rng = np.random.default_rng(n)
    rows = [(int(f), "x", None if v > 8 else float(v), int(v > 3)) for f, v in zip(rng.integers(1, 4, n), rng.integers(0, 10, n))]
    long = spark.createDataFrame(rows, "fold int, feature string, value double, outcome int").withColumn("id", F.monotonically_increasing_id())
    for r in features.median_impute(long).collect():
        if r["value"] is None or any(r["value"] == v for f, _, v, _ in rows if f == r["fold"]):
            continue
        assert r["value"] == float(np.median([v for f, _, v, _ in rows if f != r["fold"] and v is not None]))


def test_information_ranking_prefers_what_tells_the_outcome(spark):
    rows = [(i % 5 + 1, i % 2, float(i % 2), float(i % 3), None if i % 9 == 0 else i % 2 * 10.0 + i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "fold int, outcome int, a double, b double, c double")
    long = df.unpivot(["fold", "outcome"], ["a", "b", "c"], "feature", "value").replace({"a": "a__count", "b": "b__count", "c": "c__mean"}, subset=["feature"])
    out = features.information_ranking(long, keep=2).collect()
    assert len(out) == 10 and {(r["fold"], r["feature"]) for r in out if r["rank"] == 1} == {(f, "a__count") for f in range(1, 6)}
    assert {r["feature"] for r in out if r["rank"] == 2} == {"c__mean"}
