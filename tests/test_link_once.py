"""Events are linked once in a query and not shuffled again and again: what a query over qualifying events writes in shuffles."""

import datetime as dt
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidewater.operators import features, linkage
from tidewater.operators.ranges import range_join
from tidewater.plans import QUERIES

D = "/root/testdata/sf0.001"
#: Joins are shuffled, as they are where tables are large.
SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
#: Each shuffled at least eight rows for each row of lineitem before. The other queries over qualifying events share these queries' code.
QUERIES_OF_EVENTS = ("unit_audit", "unit_modal", "verify_features", "median_impute", "selection_gate", "concept_prevalence", "linkage_audit", "unit_convert", "exposure_features_top")


def _shuffled(spark, make):
    """Rows that all jobs of a query wrote in shuffles."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, "")
    try:
        make().write.format("noop").mode("overwrite").save()
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = {s for j in context.statusTracker().getJobIdsForGroup(group) for s in context.statusTracker().getJobInfo(j).stageIds}
    finally:
        context._jsc.clearJobGroup()
    return sum(context._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES_OF_EVENTS)
def test_events_are_shuffled_few_times(spark, name):
    kept = {c: spark.conf.get(c) for c in SHUFFLED}
    try:
        for c, v in SHUFFLED.items():
            spark.conf.set(c, v)
        rows = _shuffled(spark, lambda: QUERIES[name](spark, D))
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert 0 < rows < 6 * spark.read.parquet(f"{D}/lineitem.parquet").count()


T0 = dt.datetime(2020, 1, 1)


def _at(hours):
    return T0 + dt.timedelta(hours=hours)


def _tables(spark, seed):
    rng = random.Random(seed)
    visits = [(v, rng.choice([1, 2, 3, None]), _at(a), rng.choice([_at(a + rng.randint(-3, 50)), _at(a + 24 * 100), None]), v % 2) for v in range(30) for a in [rng.randint(0, 900)]]
    patient = {v[0]: v[1] for v in visits}
    events = []
    for i in range(400):
        kind, v = rng.randint(0, 3), rng.randint(0, 40)
        who = rng.choice([patient.get(v, 1), patient.get(v, 1), None, 2])
        events.append((f"e{i}", v if kind == 0 else None, rng.choice([f"k{v}", None]) if kind < 2 else None, who if kind < 2 else rng.choice([1, 2, 3, None]), rng.choice([_at(rng.randint(0, 1000)), _at(rng.randint(0, 1000)), None])))
    e = spark.createDataFrame(events, "event_id string, source_visit_id long, bridge_key string, patient_id long, event_datetime timestamp_ntz")
    c = spark.createDataFrame(visits, "visit_id long, patient_id long, start timestamp_ntz, predictor_end timestamp_ntz, outcome int")
    bridge = spark.createDataFrame([(f"k{i}", i if i != 3 else None) for i in range(35)], "bridge_key string, visit_id long")
    known = spark.createDataFrame([(i,) for i in range(38)], "visit_id long")
    return e, c, bridge, known


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("days", [None, 11])
def test_qualifying_rows_are_those_of_links_in_their_window(spark, seed, days):
    e, c, bridge, known = _tables(spark, seed)
    for events, more in ((e, ()), (e.withColumns({"event_time_precision": F.expr("case when hash(event_id) % 3 = 0 then 'date' when hash(event_id) % 17 != 0 then 'datetime' end"), "event_date": F.to_date("event_datetime")}), (48, "procedures"))):
        linked = linkage.link(events, c, known, bridge, days=days).persist()
        want = {(r["event_id"], r["linkage_strategy"], r["linked_visit"], r["hours_from_start"]) for r in linkage.qualify(linked, c, *more).collect()}
        rows = linkage.qualifying(events, c, bridge, False, days, *more).collect()
        assert {(r["event_id"], r["linkage_strategy"], r["linked_visit"], r["hours_from_start"]) for r in rows} == want and len(rows) == len(want)
        assert {s for _, s, _, _ in want} == {"direct_visit", "bridge", "patient_time"} and all(r["outcome"] == r["linked_visit"] % 2 for r in rows)
        if not more:
            got = {r["measure"]: r["n"] for r in linkage.audit(linked).collect()}
            assert got["source"] == 400 and got["qualifying"] == len(want) and got["outside_window"] == linked.filter("linked_visit is not null").count() - len(want)
            assert sum(n for m, n in got.items() if m.startswith(("linked_", "unmatched_"))) == 400
            assert {r["stage"]: r["observed"] for r in linkage.stage_counts(linked).collect()} == {"source": 400, "linked": linked.filter("linked_visit is not null").count(), "qualifying": len(want)}
        linked.unpersist()
    empty = {r["measure"]: r["n"] for r in linkage.audit(linkage.link(e.limit(0), c, known, bridge)).collect()}
    assert empty == {"source": 0, "outside_window": 0, "qualifying": 0}


def test_another_patients_visit_fails_outside_the_window_too(spark):
    e = spark.createDataFrame([("e", 10, None, 1, _at(900))], "event_id string, source_visit_id long, bridge_key string, patient_id long, event_datetime timestamp_ntz")
    c = spark.createDataFrame([(10, 2, _at(0), _at(24))], "visit_id long, patient_id long, start timestamp_ntz, predictor_end timestamp_ntz")
    bridge = spark.createDataFrame([("k", 10)], "bridge_key string, visit_id long")
    with pytest.raises(Exception, match="another patient"):
        linkage.qualifying(e, c, bridge, strict=True).collect()
    led = e.withColumn("source_visit_id", F.lit(None).cast("long")).withColumn("bridge_key", F.lit("k"))
    with pytest.raises(Exception, match="another patient"):
        linkage.qualifying(led, c, bridge, strict=True).collect()
    with pytest.raises(Exception, match="not unique: bridge_key"):
        linkage.qualifying(led.withColumns({"patient_id": F.lit(2).cast("long"), "event_datetime": F.lit(_at(1)).cast("timestamp_ntz")}), c, bridge.union(bridge)).collect()


def test_points_are_looked_up_once_by_buckets_of_one_width(spark):
    e, c, _, _ = _tables(spark, 3)
    spans = c.select(F.col("patient_id").alias("__on"), "visit_id", "start", "predictor_end")
    found = [sorted((r["event_id"], r["visit_id"]) for r in range_join(e, "event_datetime", spans, "start", "predictor_end", "patient_id", days).collect()) for days in (None, 1, 11, 400)]
    assert found[0] and all(f == found[0] for f in found)
    plan = range_join(e, "event_datetime", spans, "start", "predictor_end", "patient_id", 11)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # the intervals' buckets alone


def test_counts_read_their_rows_once(spark):
    """Each row is counted in an accumulator; before, rows were made again for their totals and their folds."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = spark.createDataFrame([(i % 7, i % 5, f"c{i % 3}", "AB"[i % 2]) for i in range(60)], "visit_id long, fold long, concept_key string, unit string").withColumn("concept_key", counted.asNondeterministic()("concept_key"))
    for made in (lambda: features.training_counts(rows, ["concept_key"]), lambda: features.modal_units(rows)):
        before = seen.value
        assert made().count() and seen.value - before == 60
