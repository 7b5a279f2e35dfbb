"""No task of a query over linked events reads most of a shuffle's rows, although most events have no bridge key and many no visit."""

import os

import pytest

from tidewater.plans import QUERIES

D = "/root/testdata/sf0.001"
#: Joins that Spark would broadcast at this size are shuffled, as they are where tables are large; no partition is merged or split.
SHUFFLED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}


def _reads(spark, df):
    """Shuffled rows read by each task, by stage."""
    context = spark.sparkContext
    context.setJobGroup("task-shares", "")
    try:
        df.write.format("noop").mode("overwrite").save()
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = {s for j in context.statusTracker().getJobIdsForGroup("task-shares") for s in context.statusTracker().getJobInfo(j).stageIds}
    finally:
        context._jsc.clearJobGroup()
    found = {}
    for stage in stages:
        tasks = context._jsc.sc().statusStore().taskList(stage, 0, 1000)
        found[stage] = [tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size())]
    return found


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", ["derived_support", "window_qualify_dates"])
def test_no_task_reads_most_of_a_shuffle(spark, name):
    kept = {c: spark.conf.get(c) for c in SHUFFLED}
    try:
        for c, v in SHUFFLED.items():
            spark.conf.set(c, v)
        reads = _reads(spark, QUERIES[name](spark, D))
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    large = {s: max(x) / sum(x) for s, x in reads.items() if sum(x) >= 3000}
    assert large and max(large.values()) < 0.3
