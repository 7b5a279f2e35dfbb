"""Frozen tables that are made again, evidence before failure, publication rules, information without a task for each feature."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import audit, cohort, evaluation, features, verify
from tidewater.operators.audit import ConstraintError


def _table(spark, n=3000):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("s"), (F.col("id") / 3).alias("x"), F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id")).alias("y"))


def test_planted_changes_are_found_in_their_ranges_alone(spark, tmp_path):
    path = f"file://{tmp_path}/frozen"
    df = _table(spark)
    verify.freeze(df, ["k"], path)
    assert verify.differing_ranges(df, ["k"], path) == [] and verify.verify(df, ["k"], path).count() == 0
    again = df.filter("k != 40").withColumn("x", F.when(F.col("k") == 1234, F.col("x") + 1e-6).otherwise(F.col("x"))).withColumn("y", F.when(F.col("k") == 22, F.lit(5)).otherwise(F.col("y")))
    again = again.unionByName(spark.createDataFrame([(9999, "new", 1.0, 1)], df.schema))
    bad = verify.differing_ranges(again, ["k"], path)
    assert 0 < len(bad) <= 4
    assert {tuple(r) for r in verify.verify(again, ["k"], path).collect()} == {(1234, "x", "value"), (22, "y", "value"), (40, "*", "only_left"), (9999, "*", "only_right")}
    read = verify.frozen_rows(spark, df, path, bad)
    assert read.count() == df.filter(verify._range(["k"], verify.RANGES).isin(bad)).count() < 3000 / 20
    assert "PartitionFilters" in read._jdf.queryExecution().toString() and len(read.inputFiles()) > 0


def test_rounding_is_no_difference(spark, tmp_path):
    path = f"file://{tmp_path}/frozen"
    df = _table(spark, 500)
    verify.freeze(df, ["k"], path)
    assert verify.verify(df.withColumn("x", F.col("x") + 1e-12), ["k"], path).count() == 0
    empty = df.limit(0)
    assert verify.verify(empty, ["k"], path).filter("kind = 'only_left'").count() == 500
    verify.freeze(empty, ["k"], f"{path}-none")
    assert verify.verify(empty, ["k"], f"{path}-none").count() == 0 and verify.verify(df, ["k"], f"{path}-none").count() == 500


def test_evidence_is_there_after_a_failure(spark, tmp_path):
    counts = spark.createDataFrame([("a", 3), ("b", 5)], "what string, observed long")
    want = spark.createDataFrame([("a", 3, 0), ("b", 4, 0), ("c", 1, 0)], "what string, expected long, tolerance long")
    at = f"file://{tmp_path}/counts"
    with pytest.raises(ConstraintError, match="2 rows"):
        cohort.require_counts(counts, want, ["what"], at)
    assert {(r["what"], r["matches"]) for r in spark.read.parquet(at).collect()} == {("a", True), ("b", False), ("c", False)}
    assert cohort.require_counts(counts.filter("what = 'a'"), want.filter("what = 'a'"), ["what"], at).count() == 1
    scores = spark.createDataFrame([(1, 1, "m", "x", 0.5)], "n long, fold long, matrix string, model string, p double")
    at = f"file://{tmp_path}/run"
    with pytest.raises(ConstraintError):
        evaluation.require_run(scores, 5, 8, 4, at)
    assert spark.read.parquet(at).first()["fits"] == 1
    have = audit.partition_digests(_table(spark, 50), ["s"], ["k", "x"])
    at = f"file://{tmp_path}/digests"
    with pytest.raises(ConstraintError):
        audit.require_equal_digests(have, audit.partition_digests(_table(spark, 49), ["s"], ["k", "x"]), ["s"], at)
    assert spark.read.parquet(at).filter("digest != wanted_digest").count() == 1


def test_names_that_may_not_be_published():
    bad = "patient_id visit source_visit person_key hadm_id mrn patient_mrn birth_date update timepoint member_number probability fold_assignment case".split()
    good = "visits patients timepoint_count monkey key events auroc oof_probabilities minimum_probability mean_predicted_risk showcase cases encounter_count id".split()
    assert all(map(audit.unpublishable, bad)) and not any(map(audit.unpublishable, good))


def test_publication_rules_over_a_set_of_tables(spark):
    rules = {"attrition": (("step", "visits", "patients"), ("visits", "patients")), "roc": (("matrix", "threshold"), ())}
    ok = spark.createDataFrame([("source", 100, 50), ("age", 0, 40)], "step string, visits long, patients long")
    roc = spark.createDataFrame([("a", 0.5)], "matrix string, threshold double")
    audit.require_publishable({"attrition": ok, "roc": roc}, rules, 11)
    found = lambda tables: {(r["table"], r["column"], r["finding"], r["rows"]) for r in audit.publication_findings(tables, rules, 11).collect()}
    assert found({"attrition": ok.withColumn("visits", F.lit(10))}) == {("attrition", "visits", "small_cell", 2)}
    assert found({"attrition": ok.drop("patients").withColumn("mrn", F.lit(1)).withColumn("t", F.current_date())}) == {("attrition", "patients", "missing_column", None), ("attrition", "mrn", "unknown_column", None), ("attrition", "mrn", "not_publishable", None), ("attrition", "t", "unknown_column", None), ("attrition", "t", "not_publishable", None)}
    assert found({"scores": roc}) == {("scores", "*", "unknown_table", None)}
    with pytest.raises(ConstraintError, match="attrition.visits: small_cell"):
        audit.require_publishable({"attrition": ok.withColumn("visits", F.lit(10)), "roc": roc}, rules, 11)


def test_checked_joins_fail_in_their_query(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([(1, 2)], "k int, w int")
    assert audit.join_checked(a, b, ["k"]).count() == 2
    for bad in (audit.join_checked(b, a, ["k"]), audit.join_checked(a, b, ["k"], kind="one_to_one")):
        with pytest.raises(Exception, match="not unique"):
            bad.collect()


def test_mutual_information_of_many_values(spark):
    rng = random.Random(1)
    rows = [(f, rng.randrange(6), rng.randrange(2)) for f in "ab" for _ in range(400)] + [("c", None, 1), ("c", 1, 0)]
    got = {r["feature"]: r["mi"] for r in features.mutual_information(spark.createDataFrame(rows, "feature string, value int, outcome int")).collect()}
    for f in "abc":
        own = [(v, o) for x, v, o in rows if x == f]
        want = sum(own.count(c) / len(own) * math.log(own.count(c) * len(own) / (sum(v == c[0] for v, _ in own) * sum(o == c[1] for _, o in own))) for c in set(own))
        assert abs(got[f] - want) < 1e-12
    many = spark.range(1_000_000).select(F.lit("f").alias("feature"), F.col("id").alias("value"), (F.col("id") % 2).cast("int").alias("outcome"))
    out = features.mutual_information(many)
    assert abs(out.first()["mi"] - math.log(2)) < 1e-9 and "Window" not in out._jdf.queryExecution().executedPlan().toString()
