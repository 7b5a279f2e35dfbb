"""Bucketed range joins against plain loops, with one patient who holds most rows; windows of dates and times; early candidates."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import extract, linkage
from tidewater.operators.cohort import CohortRules, prior_use
from tidewater.operators.ranges import before_any, bucket, range_cells, range_join

T0 = dt.datetime(2001, 1, 1)


def _at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture(scope="module")
def few():
    rng = random.Random(3)
    points = [(i, rng.choice([1, 1, 1, 2, None]), None if i % 50 == 0 else _at(rng.randrange(0, 24 * 900)), rng.choice("ab")) for i in range(600)]
    spans = [(i, rng.choice([1, 1, 2, None]), _at(a := rng.randrange(0, 24 * 900)), _at(a + rng.choice([0, 1, 24, 24 * 30, 24 * 64, 24 * 65, 24 * 400, -5]))) for i in range(120)] + [(500, 1, None, _at(5)), (501, 1, _at(5), None)]
    return points, spans


def _inside(p, s):
    return p[1] is not None and p[1] == s[1] and p[2] and s[2] and s[3] and s[2] <= p[2] < s[3]


def test_range_join_equals_loops(spark, few):
    points, spans = few
    p = spark.createDataFrame(points, "i int, who int, t timestamp_ntz, kind string")
    s = spark.createDataFrame(spans, "v int, __on int, a timestamp_ntz, b timestamp_ntz")
    got = sorted((r["i"], r["v"]) for r in range_join(p, "t", s, "a", "b", "who").collect())
    assert got == sorted((x[0], y[0]) for x in points for y in spans if _inside(x, y)) and got


def test_range_cells_equal_loops(spark, few):
    points, spans = few
    points = [*points, *points[:30]]
    p = spark.createDataFrame(points, "i int, who int, t timestamp_ntz, kind string")
    s = spark.createDataFrame(spans, "v int, who int, a timestamp_ntz, b timestamp_ntz")
    for days in (1, 7, 45):
        cells = range_cells(p, "t", ["kind"], s, "a", "b", "who", days).groupBy("v", "kind").agg(F.sum("n").alias("n"))
        want = {}
        for x in points:
            for y in spans:
                if _inside(x, y):
                    want[y[0], x[3]] = want.get((y[0], x[3]), 0) + 1
        assert {(r["v"], r["kind"]): r["n"] for r in cells.collect()} == want


def test_before_any_equals_loops(spark, few):
    points, spans = few
    p = spark.createDataFrame(points, "i int, who int, t timestamp_ntz, kind string")
    e = spark.createDataFrame([(y[1], y[2]) for y in spans], "who int, s timestamp_ntz")
    for back in (1, 30, 365):
        got = sorted(r["i"] for r in before_any(p, "t", e, "s", "who", back).collect())
        assert got == sorted(x[0] for x in points if any(x[1] is not None and x[1] == y[1] and x[2] and y[2] and y[2] - dt.timedelta(days=back) <= x[2] < y[2] for y in spans))


def test_a_patient_of_many_visits_is_split(spark):
    """One patient holds 100,000 visits and events over 40 years: no bucket holds more than a fiftieth, and counts come without pairs."""
    n, step = 100_000, 40 * 365 * 24 * 60 // 100_000
    visits = spark.range(n).select(F.col("id").alias("visit_id"), F.lit(1).alias("patient_id"), (F.lit(T0).cast("timestamp_ntz") + F.expr(f"make_dt_interval(0, 0, cast(id * {step} as int))")).alias("start"), F.lit("inpatient").alias("visit_type"))
    assert visits.groupBy(bucket(F.col("start"), 45)).count().agg(F.max("count")).first()[0] < n / 50
    out = prior_use(visits, visits, CohortRules())
    year = 365 * 24 * 60
    wrong = out.filter(F.col("prior_visits") != F.least(F.col("visit_id"), F.lit(year // step))).count()
    assert wrong == 0 and out.count() == n
    spans = visits.select(F.col("visit_id").alias("vv"), F.col("patient_id").alias("__on"), F.col("start").alias("a"), (F.col("start") + F.expr(f"make_dt_interval(0, 0, {step})")).alias("b"))
    joined = range_join(visits.select("visit_id", "patient_id", "start"), "start", spans, "a", "b", "patient_id")
    assert joined.filter("visit_id = vv").count() == n == joined.count()


def test_windows_of_days_and_times(spark):
    """The day's window runs to the day of start + 24 h though the visit ended early; both ends are in it."""
    start, leave = dt.datetime(2020, 5, 1, 18), dt.datetime(2020, 5, 1, 20)
    cohort = spark.createDataFrame([(1, start, leave)], "visit_id long, start timestamp_ntz, predictor_end timestamp_ntz")
    rows = [(i, 1, None, day, "date") for i, day in enumerate([dt.date(2020, 4, 30), dt.date(2020, 5, 1), dt.date(2020, 5, 2), dt.date(2020, 5, 3), None])]
    rows += [(10 + i, 1, t, t.date(), "datetime") for i, t in enumerate([start - dt.timedelta(minutes=1), start, leave - dt.timedelta(minutes=1), leave])] + [(20, 1, start, None, None), (21, None, start, None, "datetime")]
    linked = spark.createDataFrame(rows, "event_id int, linked_visit long, event_datetime timestamp_ntz, event_date date, event_time_precision string")
    got = {r["event_id"]: r["hours_from_start"] for r in linkage.qualify(linked, cohort, 24, "procedures").collect()}
    assert set(got) == {1, 2, 11, 12} and got[1] is None and got[11] == 0.0
    for domain, window in (("measurements", 24), ("procedures", None)):
        with pytest.raises(Exception, match="day alone"):
            linkage.qualify(linked, cohort, window, domain).collect()
    timed = linked.filter("event_time_precision = 'datetime'")
    assert {r["event_id"] for r in linkage.qualify(timed, cohort, None, "measurements").collect()} == {11, 12}


def test_an_event_of_a_day_links_by_visit_alone(spark):
    cohort = spark.createDataFrame([(1, 7, _at(0), _at(48))], "visit_id long, patient_id long, start timestamp_ntz, predictor_end timestamp_ntz")
    rows = [("a", None, None, 7, _at(1), "datetime"), ("b", None, None, 7, _at(1), "date"), ("c", 1, None, 7, _at(1), "date")]
    events = spark.createDataFrame(rows, "event_id string, source_visit_id long, bridge_key string, patient_id long, event_datetime timestamp_ntz, event_time_precision string")
    bridge = spark.createDataFrame([], "bridge_key string, visit_id long")
    got = {r["event_id"]: (r["linkage_strategy"], r["linked_visit"]) for r in linkage.link(events, cohort, cohort, bridge).collect()}
    assert got == {"a": ("patient_time", 1), "b": (None, None), "c": ("direct_visit", 1)}


def test_early_candidates_keep_deaths_after_the_landmark(spark):
    """Default rules, landmark 24 h: a death by the landmark's day ends a visit, one between landmark and horizon does not."""
    visits = [(i, i, dt.datetime(2020, 1, 1, 12), None if i % 2 else dt.datetime(2020, 1, 9), " Inpatient ") for i in range(1, 6)]
    visits += [(6, 6, dt.datetime(2020, 1, 1, 12), dt.datetime(2019, 1, 1), "inpatient"), (7, 7, dt.datetime(2020, 1, 1), None, "clinic"), (8, 99, dt.datetime(2020, 1, 1), None, "inpatient"), (9, 9, None, None, "inpatient")]
    encounters = spark.createDataFrame(visits, "visit_id long, patient_id long, start timestamp_ntz, end timestamp_ntz, visit_type string")
    patients = spark.createDataFrame([(i, 17 if i == 5 else 16, 2018 if i != 4 else 2020) for i in range(1, 10)], "patient_id long, age_anchor int, age_anchor_year int")
    deaths = spark.createDataFrame([(1, dt.date(2020, 1, 2)), (2, dt.date(2020, 1, 3)), (3, dt.date(2020, 1, 20)), (None, dt.date(2020, 1, 1))], "visit_id long, death_date date")
    rules = CohortRules()
    got = {r["visit_id"] for r in extract.native_candidates(encounters, patients, deaths, rules).collect()}
    assert got == {2, 3, 5}  # 1 died by the landmark's day, 4 is 16 at the start
    assert {r["visit_id"] for r in extract.native_candidates(encounters, patients, deaths.withColumnRenamed("visit_id", "patient_id"), rules).collect()} == {1, 2, 3, 5}


def test_events_without_a_key_are_dealt_over_tasks(spark):
    """Most events have no bridge key; where the join is a shuffle, no task may get all of them."""
    rows = spark.createDataFrame([(f"e{i}", "B1" if i % 50 == 0 else None) for i in range(2000)], "event_id string, key string")
    table = spark.createDataFrame([("B1", 7), ("B2", 8), (None, 9)], "k string, v int")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
            spark.conf.set(c, v)
        got = linkage.looked_up(rows, "key", table, "k", "event_id")
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 2000 and max(sizes) < 800
        assert {(r["key"], r["k"], r["v"]) for r in got.collect()} == {("B1", "B1", 7), (None, None, None)}
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
