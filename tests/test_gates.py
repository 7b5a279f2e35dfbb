"""Rules that must hold: each operator's query fails where they do not."""

from dataclasses import replace
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewater.operators import audit, cohort, comorbidity, evaluation, extract, features, linkage, standardize
from tidewater.sources import scans

RULES = cohort.CohortRules()


def fails(df, words):
    with pytest.raises(Exception, match=words):
        df.collect()


def test_unique_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k int, v string")
    fails(audit.sole(df, ["k"]), "keys are not unique: k")
    assert audit.sole(df.filter("v != 'b'"), ["k"]).filter("k = 1").first()["v"] == "a"
    assert audit.sole(df.filter("v = 'c'").select("k"), ["k"]).collect() == [(2,)]


def test_a_cohort_needs_unique_patients_and_deaths(spark):
    e = spark.createDataFrame([(1, 1, datetime(2020, 1, 1), None, "inpatient", None, None), (2, 1, datetime(2020, 3, 1), None, "inpatient", None, None)], "visit_id long, patient_id long, start timestamp_ntz, end timestamp_ntz, visit_type string, elective string, followup_end timestamp_ntz")
    p = spark.createDataFrame([(1, 40, 2000)], "patient_id long, age_anchor int, age_anchor_year int")
    none = spark.createDataFrame([], "patient_id long, death_datetime timestamp_ntz, death_date date, death_time_precision string")
    assert cohort.base(e, p, none, RULES).count() == 2
    fails(cohort.base(e, p.union(p), none, RULES), "not unique: patient_id")
    d = spark.createDataFrame([(1, 2, datetime(2020, 3, 2), None, "datetime")], "patient_id long, visit_id long, death_datetime timestamp_ntz, death_date date, death_time_precision string")
    assert {r["visit_id"]: r["death_datetime"] for r in cohort.base(e, p, d, RULES).collect()} == {1: None, 2: datetime(2020, 3, 2)}
    fails(cohort.base(e, p, d.union(d), RULES), "not unique: patient_id, visit_id")


def test_count_gates(spark):
    seen, want = spark.createDataFrame([("a", 5)], "s string, observed long"), spark.createDataFrame([("a", 6, 1)], "s string, expected long, tolerance long")
    assert cohort.require_counts(seen, want, ["s"]).count() == 1
    fails(cohort.require_counts(seen, want.withColumn("tolerance", F.lit(0)), ["s"]), "not what is expected")
    fails(cohort.require_counts(seen.limit(0), want, ["s"]), "not what is expected")


def test_mapping(spark):
    df = spark.createDataFrame([(1, None)], "a int, s string")
    assert standardize.mapped(df, {"x": "a", "unit": None}).collect() == [(1, None)]
    with pytest.raises(audit.ConstraintError):
        standardize.mapped(df, {"x": "nope"}, required=("x",))
    with pytest.raises(audit.ConstraintError):
        standardize.mapped(df, {"x": None}, required=("x",))
    assert standardize.filled(df, "s", "ordered").first()["s"] == "ordered"
    fails(standardize.filled(df, "s", None), "s is missing")


def test_times_and_deaths(spark):
    t = spark.createDataFrame([("2020-01-01 00:00:00",), ("bad",)], "t string")
    assert [r["t"] is None for r in standardize.parsed(t, {"t": False}).collect()] == [False, True]
    fails(standardize.parsed(t, {"t": True}), "t is not a time")
    d = spark.createDataFrame([(1, datetime(2020, 5, 2, 3)), (1, datetime(2020, 5, 1, 3)), (2, None)], "patient_id int, death_datetime timestamp_ntz")
    full = standardize.backfilled_deaths(d, "deaths")
    one = {r["patient_id"]: r for r in standardize.earliest_death(full).collect()}
    assert one[1]["death_date"] == date(2020, 5, 1) and one[1]["death_source"] == "deaths" and one[1]["death_source_conflict"] is False and one[2]["death_datetime"] is None
    days = spark.createDataFrame([(1, date(2020, 5, 3)), (3, date(2020, 6, 1))], "patient_id int, death_date date")
    both = {r["patient_id"]: (r["death_time_precision"], r["death_source_conflict"]) for r in standardize.precise_then_day(d, days).collect()}
    assert both == {1: ("datetime", True), 3: ("date", False)}
    x = spark.createDataFrame([(datetime(2020, 1, 2), date(2020, 1, 1)), (None, date(2020, 1, 1)), (datetime(2020, 1, 1), date(2020, 1, 1)), (None, None)], "a timestamp_ntz, b date")
    assert sorted(r["death_source"] for r in standardize.earliest_day(x, "a", "b").collect()) == ["both_differ", "both_equal", "date"]


def test_names_and_types(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert [r["c"] for r in standardize.harmonised(df, "c", {"a": "A"}, "keep").collect()] == ["A", "z", None]
    fails(standardize.harmonised(df, "c", {"a": "A"}), "without a name")
    assert standardize.visit_types(df.filter("c = 'a'"), "c", {"A": "x"}, ("A",)).first().asDict() == {"c": "a", "elective": True, "visit_type": "x"}
    fails(standardize.visit_types(df, "c", {"A": "x"}, ()), "without a name")
    with pytest.raises(ValueError):
        standardize.followup_ends(df, "nope")


def test_event_mapping(spark):
    df = spark.createDataFrame([(1, "hr", None, datetime(2020, 1, 1), "7.5"), (1, "hr", None, None, "7"), (1, "hr", datetime(2020, 1, 2), None, "x"), (None, "hr", datetime(2020, 1, 2), None, "1")], "s int, i string, t1 timestamp_ntz, t2 timestamp_ntz, v string")
    out = standardize.measurement_events(df, "lab", "s", "i", ("t1", "t2"), "v").collect()
    assert [(r["concept_key"], r["event_datetime"], r["value"]) for r in out] == [("lab:hr", datetime(2020, 1, 1), 7.5)]
    assert standardize.measurement_events(df, "lab", "s", "i", ("t1", "t2"), "v", numeric_only=False).count() == 2


def test_bounds_prune_the_scan(spark, tmp_path):
    spark.createDataFrame([(i, datetime(2020, 1, 1 + i)) for i in range(20)], "id int, t timestamp_ntz").write.parquet(str(tmp_path / "e"))
    own = spark.createDataFrame([(datetime(2020, 1, 5),), (datetime(2020, 1, 8),)], "start timestamp_ntz")
    out = extract.within_bounds(spark.read.parquet(str(tmp_path / "e")), own, "t", after=24)
    assert sorted(r["id"] for r in out.collect()) == [4, 5, 6, 7]
    assert "PushedFilters: [IsNotNull(t), GreaterThanOrEqual(t,2020-01-05" in out._jdf.queryExecution().toString()
    assert extract.within_bounds(own, own.limit(0), "start").count() == 0


def test_links_of_another_patient_fail(spark):
    e = spark.createDataFrame([("e", 1, 10, None, datetime(2020, 1, 1))], "event_id string, patient_id long, source_visit_id long, bridge_key string, event_datetime timestamp_ntz")
    v = spark.createDataFrame([(10, 2, datetime(2020, 1, 1), datetime(2020, 1, 2))], "visit_id long, patient_id long, start timestamp_ntz, predictor_end timestamp_ntz")
    b = spark.createDataFrame([("k", 10)], "bridge_key string, visit_id long")
    assert linkage.link(e, v, v, b).first()["reason"] == "patient_mismatch"
    fails(linkage.link(e, v, v, b, strict=True), "another patient")
    fails(linkage.link(e.withColumn("source_visit_id", F.lit(None).cast("long")).withColumn("bridge_key", F.lit("k")), v, v, b.union(b)), "not unique: bridge_key")


def test_day_windows_include_both_ends(spark):
    v = spark.createDataFrame([(10, datetime(2020, 1, 1, 12), datetime(2020, 1, 2, 12))], "visit_id long, start timestamp_ntz, predictor_end timestamp_ntz")
    e = spark.createDataFrame([(i, 10, datetime(2020, 1, d)) for i, d in enumerate((1, 2, 3))], "event_id int, linked_visit long, event_datetime timestamp_ntz")
    e = e.selectExpr("*", "to_date(event_datetime) as event_date", "'date' as event_time_precision")
    out = linkage.qualify(e, v, 24, "procedures").collect()
    assert sorted(r["event_id"] for r in out) == [0, 1] and all(r["hours_from_start"] is None for r in out)


def test_code_versions(spark):
    d = spark.createDataFrame([(1, "410", "9"), (1, "I21", "10")], "visit_id int, code string, icd_version string")
    assert comorbidity.require_versions(d).count() == 2
    for bad in ("8", "9.5", "x", None):
        fails(comorbidity.require_versions(d.withColumn("icd_version", F.lit(bad).cast("string"))), "not 9 or 10")


def test_only_acute_visits_before_count(spark):
    e = spark.createDataFrame([(1, 1, datetime(2020, 1, 1), "inpatient"), (2, 1, datetime(2020, 2, 1), "clinic"), (3, 1, datetime(2020, 3, 1), "inpatient")], "visit_id int, patient_id int, start timestamp_ntz, visit_type string")
    d = spark.createDataFrame([(1, "410", 9), (2, "C77", 10), (3, "585", 9)], "visit_id int, code string, icd_version int")
    own = e.filter("visit_id = 3")
    assert comorbidity.prior_score(own, e, d, RULES).collect() == [(3, 1)]
    assert comorbidity.prior_score(own, e, d, RULES, acute_only=False).collect() == [(3, 7)]
    assert comorbidity.prior_score(own, e, d, replace(RULES, lookback_days=10)).collect() == [(3, 0)]


def test_units(spark):
    e = spark.createDataFrame([("a", " MG ", 2.0, 1), ("a", "g", 2.0, 2), ("b", "kg", 1.0, 1), ("b", None, 1.0, 2)], "concept_key string, unit string, value double, fold int")
    out = {(r["concept_key"], r["unit"]): (r["value"], r["unit_status"]) for r in features.confirmed_units(e, [("a", "g", 1000.0, 0.0)], {"a": ["mg"]}, ("kg",)).collect()}
    assert out == {("a", " MG "): (2.0, "allowed"), ("a", "g"): (2000.0, "converted"), ("b", "kg"): (1.0, "allowed"), ("b", None): (None, "invalid")}
    modal = spark.createDataFrame([(1, "a", "g"), (2, "a", " MG ")], "fold int, concept_key string, unit string")
    assert features.unit_exclusions(e, modal).count() == 0
    fails(features.unit_exclusions(e, modal.union(modal)), "not unique: fold, concept_key")


def test_rank_and_fold_gates(spark):
    top = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "fold int, rank int")
    fails(features.require_ranked(top, ["fold"], 2), "fewer than 2")
    assert features.require_ranked(top, ["fold"], 1).count() == 3
    rows = spark.createDataFrame([(1, 1, 0), (2, 2, 1), (3, 3, 0)], "visit_id int, patient_id int, outcome int")
    folds = spark.createDataFrame([(1, 1), (2, 2), (2, 1)], "patient_id int, fold int")
    out = {r["check"]: r["failures"] for r in features.fold_checks(rows, folds).collect()}
    assert out["unassigned"] == 1 and out["split_patients"] == 1 and out["one_class_folds"] > 0


def test_runs(spark):
    s = spark.createDataFrame([(n, f"x{x}", f"m{m}", n % 2 + 1, 0.5) for n in range(4) for x in range(2) for m in range(3)], "n long, matrix string, model string, fold int, p double")
    assert evaluation.require_run(s, 2, 2, 3).first()["fits"] == 12
    fails(evaluation.require_run(s.filter("n != 0 or model != 'm1'"), 2, 2, 3), "least is not 6")
    i = spark.createDataFrame([(n, n % 2 + 1) for n in range(4)], "n long, fold int")
    assert evaluation.aligned(s, i).count() == 24
    fails(evaluation.aligned(s.filter("n != 3"), i), "lacks a probability")
    fails(evaluation.aligned(s, i.withColumn("fold", F.lit(1))), "another fold")


def test_digests_tell_rows_apart(spark):
    d = lambda rows, kind="a string, b string": audit.digest(spark.createDataFrame(rows, kind)).first()["digest"]
    assert d([("x|b=y", None)]) != d([("x", "y")]) and d([("", None)]) != d([(None, "")]) and d([("a", "b")] * 2) != d([("a", "b")])
    assert d([("1", "2")]) != d([("1", 2)], "a string, b int")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    swapped = spark.createDataFrame([(2, "a"), (1, "b")], "k int, v string")
    assert audit.ordered_digest(rows, ["k"], ["v"]).first() != audit.ordered_digest(swapped, ["k"], ["v"]).first()
    have = audit.partition_digests(rows, ["k"], ["v"])
    assert audit.require_equal_digests(have, have, ["k"]).count() == 2
    fails(audit.require_equal_digests(have, audit.partition_digests(swapped, ["k"], ["v"]), ["k"]), "not what was frozen")


def test_strict_booleans_and_lists(spark):
    df = spark.createDataFrame([(" TRUE ",), ("0",), (None,)], "x string")
    assert [r[0] for r in df.select(audit.strict_boolean(F.col("x"))).collect()] == [True, False, None]
    fails(df.select(audit.strict_boolean(F.lit("yes"))), "not a boolean")
    fails(audit.require_allowed(df, "x", ["0", " TRUE "]), "not allowed")
    assert audit.not_allowed(df, "x", ["0"]).count() == 2


def test_result_tables(spark):
    df = spark.createDataFrame([("x", "m", 1, 0.1, 0.2, 0.3)], "matrix string, model string, fold int, auroc double, auprc double, brier double")
    assert audit.require_result(df, "fold_metrics").count() == 1
    fails(audit.require_result(df.union(df), "fold_metrics"), "not unique")
    for name in audit.RESULT_SCHEMAS:
        with pytest.raises(audit.ConstraintError):
            audit.require_result(spark.createDataFrame([(1,)], "other int"), name)


def test_publication(spark):
    df = spark.createDataFrame([("a", 3)], "brand string, n long")
    assert audit.publishable(df, "t", {"t": ["brand", "n"]}, ["n"], 3).count() == 1
    fails(audit.publishable(df, "t", {"t": ["brand", "n"]}, ["n"], 4), "below 4")
    for bad in (df.withColumn("patient_id", F.lit(1)), df.withColumn("other", F.lit(1))):
        with pytest.raises(audit.ConstraintError):
            audit.publishable(bad, "t", {"t": ["brand", "n", "patient_id"]}, ["n"], 3)
    m = spark.createDataFrame([(1, '{"a": {"patient_id": 7, "count": 3}, "list": [{"rows": 2}, {"rows": 50}], "n": 0}'), (2, None)], "run int, text string")
    assert {(r["run"], r["path"], r["finding"]) for r in audit.manifest_findings(m, "text", 11).collect()} == {(1, "$.a.patient_id", "identifier"), (1, "$.a.count", "small_cell"), (1, "$.list[0].rows", "small_cell")}


def test_gzip_csv(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("a,b\n1,x\n2,y\n")
    assert scans.scan_csv(spark, str(tmp_path / "x.csv.gz"), "a int, b string", ["a"]).count() == 2
