"""Edge cases of the cohort, linkage, feature, evaluation and audit operators on tiny tables."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidewater.functions import normalise as N
from tidewater.operators import audit, cohort, comorbidity, evaluation, features, linkage
from tidewater.operators.numbering import numbered
from tidewater.sources import scans

RULES = cohort.CohortRules()


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _gated(spark, death=None, day=None, prec="datetime", end=datetime(2020, 1, 5), rules=RULES):
    e = spark.createDataFrame([(1, 1, datetime(2020, 1, 1), end, "Inpatient", None, datetime(2021, 1, 1))], "visit_id long, patient_id long, start timestamp_ntz, end timestamp_ntz, visit_type string, elective string, followup_end timestamp_ntz")
    p = spark.createDataFrame([(1, 40, 2000)], "patient_id long, age_anchor int, age_anchor_year int")
    d = spark.createDataFrame([(1, death, day, prec)] if death or day else [], "patient_id long, death_datetime timestamp_ntz, death_date date, death_time_precision string")
    return cohort.gated(cohort.base(e, p, d, rules), rules).first()


@pytest.mark.parametrize(
    "death, kept, outcome",
    [(datetime(2020, 1, 2), False, 0), (datetime(2020, 1, 2, 2), True, 1), (datetime(2020, 2, 1), True, 0), (datetime(2020, 1, 31), True, 1)],
)
def test_precise_deaths(spark, death, kept, outcome):
    r = _gated(spark, death, death.date())
    assert (r["g8"], r["outcome"] if kept else 0) == (kept, outcome)


@pytest.mark.parametrize("day, kept, outcome", [(date(2020, 1, 2), False, 0), (date(2020, 1, 6), True, 1), (None, True, 0)])
def test_deaths_by_day(spark, day, kept, outcome):
    r = _gated(spark, None, day, "date")
    assert r["g8"] == kept and (not kept or r["outcome"] == outcome)


def test_window_end_and_short_visits(spark):
    r = _gated(spark, end=datetime(2020, 1, 1, 6))
    assert r["predictor_end"] == datetime(2020, 1, 1, 6) and r["short_visit"] and r["g8"]
    r = _gated(spark, end=datetime(2020, 1, 1, 6), rules=cohort.CohortRules(end_at_discharge=False, keep_short=False))
    assert r["predictor_end"] == datetime(2020, 1, 2) and not r["g8"]
    assert not _gated(spark, end=datetime(2019, 12, 31))["g8"]


def test_prior_visits_at_the_edges(spark):
    at = [(1, datetime(2020, 12, 31)), (2, datetime(2020, 1, 1)), (3, datetime(2019, 12, 31, 23, 59, 59))]
    e = spark.createDataFrame([(v, 1, t, "inpatient") for v, t in at], "visit_id long, patient_id long, start timestamp_ntz, visit_type string")
    out = {r["visit_id"]: r["prior_visits"] for r in cohort.prior_use(e, e, RULES).collect()}
    assert out == {1: 1, 2: 1, 3: 0}


def test_comorbidity_hierarchy(spark):
    d = spark.createDataFrame([(1, "572.2", 9), (1, "571", 9), (1, "571", 9), (1, "585", 9), (2, "C77", 10), (2, "C50", 10)], "visit_id long, code string, icd_version int")
    d = d.withColumn("code", comorbidity.code(F.col("code")))
    rows = d.join(comorbidity.classify(d), ["code", "icd_version"])
    assert _rows(comorbidity.score(rows, "visit_id")) == [(1, 5), (2, 6)]


def _link(spark, events):
    c = spark.createDataFrame([(1, 1, datetime(2020, 1, 1), datetime(2020, 1, 2)), (2, 1, datetime(2020, 1, 1, 12), datetime(2020, 1, 3)), (3, 2, datetime(2020, 1, 1), datetime(2020, 1, 2))], "visit_id long, patient_id long, start timestamp_ntz, predictor_end timestamp_ntz")
    known = spark.createDataFrame([(1,), (2,), (3,), (9,)], "visit_id long")
    b = spark.createDataFrame([("k3", 3), ("k9", 9)], "bridge_key string, visit_id long")
    e = spark.createDataFrame(events, "event_id string, source_visit_id long, bridge_key string, patient_id long, event_datetime timestamp_ntz")
    return c, {r["event_id"]: (r["linkage_strategy"], r["reason"], r["linked_visit"]) for r in linkage.link(e, c, known, b).collect()}


def test_linkage_never_falls_through(spark):
    t = datetime(2020, 1, 1, 1)
    events = [("direct", 1, None, 1, t), ("not_in", 9, None, 1, t), ("unknown", 77, "k3", 2, t), ("bridge", None, "k3", 2, t), ("bad_key", None, "zz", 2, t), ("key_out", None, "k9", 2, t), ("time", None, None, 1, t), ("two", None, None, 1, datetime(2020, 1, 1, 13)), ("none", None, None, 2, datetime(2020, 1, 2)), ("other", 1, None, 2, t)]
    got = _link(spark, events)[1]
    assert got == {
        "direct": ("direct_visit", None, 1), "not_in": (None, "visit_not_in_cohort", None), "unknown": (None, "unknown_visit", None), "bridge": ("bridge", None, 3), "bad_key": (None, "bridge_unmatched", None),
        "key_out": (None, "bridge_visit_not_in_cohort", None), "time": ("patient_time", None, 1), "two": (None, "ambiguous", None), "none": (None, "no_interval", None), "other": (None, "patient_mismatch", None),
    }


def test_repeated_bridge_key_fails(spark):
    b = spark.createDataFrame([("k", 1), ("k", 2)], "bridge_key string, visit_id long")
    with pytest.raises(audit.ConstraintError):
        audit.require_unique(b, ["bridge_key"])


def test_evidence_is_written_before_the_error(spark, tmp_path):
    df = spark.createDataFrame([(1,), (-1,)], "x int")
    with pytest.raises(audit.ConstraintError, match="positive: 1"):
        audit.enforce(df, {"positive": F.col("x") > 0}, str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).first()["violations"] == 1


def test_zero_event_visits_stay(spark):
    c = spark.createDataFrame([(1,), (2,)], "visit_id long")
    e = spark.createDataFrame([(1, "a", 2.0)], "visit_id long, concept_key string, value double")
    rows = {r["visit_id"]: r.asDict() for r in features.measurements(e, c, ["a"]).collect()}
    assert rows[1]["a_sd"] == 0.0 and rows[1]["a_missing"] == 0
    assert rows[2]["a_mean"] is None and rows[2]["a_count"] == 0 and rows[2]["a_missing"] == 1


def test_folds_differ_by_one_at_most(spark):
    c = spark.range(23).select(F.col("id").alias("patient_id"))
    sizes = [r["count"] for r in features.patient_folds(c, 5, 1).groupBy("fold").count().collect()]
    assert sum(sizes) == 23 and max(sizes) - min(sizes) <= 1


def test_ties_in_rank_metrics(spark):
    rows = [("a", 0.5, y, i) for i, y in enumerate([1, 1, 0, 0, 0, 0, 0, 0, 0, 0])]
    df = spark.createDataFrame(rows, "g string, p double, outcome int, n int")
    m = evaluation.metrics(evaluation.counts(df, ["g"]), ["g"]).first()
    assert m["auroc"] == 0.5 and abs(m["auprc"] - 0.2) < 1e-12
    t = evaluation.top_risk(df, evaluation.counts(df, ["g"]), ["g"]).first()
    assert (t["flagged"], t["captured"], t["ties"]) == (1, 1, 10)
    assert evaluation.calibration_bins(df, ["g"]).count() == 10


def test_one_class_is_undefined(spark):
    df = spark.createDataFrame([("a", 0.2, 1), ("a", 0.9, 1)], "g string, p double, outcome int")
    m = evaluation.metrics(evaluation.counts(df, ["g"]), ["g"]).first()
    assert m["auroc"] is None and m["auprc"] is None
    ci = evaluation.percentile_interval(spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("a", None)], "g string, value double"), ["g"]).first()
    assert (ci["valid"], ci["invalid"]) == (2, 2)


def test_net_benefit(spark):
    df = spark.createDataFrame([("a", 0.9, 1), ("a", 0.8, 0), ("a", 0.1, 0), ("a", 0.1, 0)], "g string, p double, outcome int")
    c = evaluation.decision_curve(evaluation.counts(df, ["g"]), ["g"]).filter("strategy = 'model' and threshold = 0.2").first()
    assert abs(c["net_benefit"] - (0.25 - 0.25 * 0.2 / 0.8)) < 1e-12


def test_digest_and_diff(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None), (2, None)], "k int, v double")
    assert audit.digest(a).first() == audit.digest(a.orderBy(F.desc("k"))).first() != audit.digest(a.distinct()).first()
    b = spark.createDataFrame([(1, 1.5), (3, 0.0)], "k int, v double")
    assert _rows(audit.table_diff(a.distinct(), b, ["k"])) == [(1, "v", "value"), (2, "*", "only_left"), (3, "*", "only_right")]


def test_numbering_is_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert all(r["x"] + 1 == r["n"] for r in numbered(df, [F.col("x")], "n").collect())


def test_normalisation(spark):
    df = spark.createDataFrame([("1001.0", "  Ａｂc  D "), (" x1 ", None), ("7", "é́")], "id string, key string")
    assert [r[0] for r in df.select(N.canonical_id(F.col("id"))).collect()] == ["1001", "x1", "7"]
    assert "abc d" in [r["concept_norm"] for r in N.normalised_keys(df, "key").collect()]
    e = N.stable_event_keys(spark.createDataFrame([("a",), ("a",), (None,)], "c string"), "n", ["c"])
    assert e.select("event_id").distinct().count() == 3


def test_csv_round_trip_and_missing_column(spark, tmp_path):
    scans.write_csv(spark.createDataFrame([(1, 0.125)], "a int, b double"), str(tmp_path / "c"))
    assert scans.scan_csv(spark, str(tmp_path / "c"), "a int, b double", ["b"]).first()["b"] == 0.125
    with pytest.raises(ValueError, match="missing"):
        scans.scan_csv(spark, str(tmp_path / "c"), "a int, b double", ["z"])
    scans.write_stage(spark.createDataFrame([(1, "x")], "fold int, v string"), str(tmp_path / "p"), ["fold"])
    with pytest.raises(ValueError, match="missing"):
        scans.scan(spark, str(tmp_path / "p"), ["nope"])


def test_identifiers_are_screened(spark):
    df = spark.createDataFrame([(1, 2)], "patient_id int, n int")
    assert audit.identifier_columns(df, ["n"]) == ["patient_id"]
    with pytest.raises(ValueError):
        features.screen(df)
    with pytest.raises(ValueError):
        features.assemble(df, [df], "patient_id")
