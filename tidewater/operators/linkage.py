"""Events to visits: direct, by bridge key, by patient and time, in that order and without falling through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.audit import checked, sole
from tidewater.operators.ranges import range_join


def interval_link(events: DataFrame, visits: DataFrame, days: int | None = None) -> DataFrame:
    """(event_id, candidates, visit_id): visits of the patient with start <= time < predictor_end; visit_id where there is just one. ``days``: see ``range_join``."""
    v = visits.select(F.col("patient_id").alias("__on"), F.col("visit_id").alias("vv"), F.col("start").alias("vs"), F.col("predictor_end").alias("ve"))
    return range_join(events, "event_datetime", v, "vs", "ve", "patient_id", days).groupBy("event_id").agg(F.count(F.lit(1)).alias("candidates"), F.min("vv").alias("vv")).select("event_id", "candidates", F.when(F.col("candidates") == 1, F.col("vv")).alias("visit_id"))


def looked_up(rows: DataFrame, key: str, table: DataFrame, name: str, spread: str) -> DataFrame:
    """Left join on ``key`` = ``name``. Rows without a key meet nothing and are dealt by ``spread``, else one task would get all of them."""
    rows = rows.withColumn("__deal", F.when(F.col(key).isNull(), F.hash(spread)).otherwise(0))
    table = table.withColumn("__of", F.pmod(F.hash(name), F.lit(1)))  # 0, but no constant that the planner would take out of the join's keys
    return rows.join(table, (F.col(key) == F.col(name)) & (F.col("__deal") == F.col("__of")), "left").drop("__deal", "__of")


DIRECT, BRIDGED, FREE = "source_visit_id is not null", "source_visit_id is null and bridge_key is not null", "source_visit_id is null and bridge_key is null"


def _timed(events: DataFrame) -> DataFrame:
    """Events that name no visit and have a time; a day alone is in no interval of times."""
    free = events.filter(FREE).filter("event_datetime is not null")
    return free.filter("event_time_precision = 'datetime'") if "event_time_precision" in events.columns else free


def _mismatch() -> Column:
    return F.coalesce(F.col("cv").isNotNull() & (F.col("cp") != F.col("patient_id")), F.lit(False))


def link(events: DataFrame, cohort: DataFrame, all_visits: DataFrame, bridge: DataFrame, strict: bool = False, days: int | None = None) -> DataFrame:
    """``events`` (event_id unique) with linkage_strategy, linked_visit, reason and inside (whether the time is in the linked visit's window), a row for each.

    A visit that is named but not in the cohort, or a bridge key that leads nowhere, ends the search. The query fails where a bridge
    key repeats and, if ``strict``, where an event names another patient's visit; else that is its reason. Events of the three kinds
    go their own ways, so none takes part in a shuffle for another kind's key.
    """
    own = cohort.select(F.col("visit_id").alias("cv"), F.col("patient_id").alias("cp"), F.col("start").alias("__start"), F.col("predictor_end").alias("__end"))
    known = all_visits.select(F.col("visit_id").alias("av")).distinct()
    visits = known.join(own, F.col("av") == F.col("cv"), "full").withColumn("xv", F.coalesce("av", "cv"))
    b = sole(bridge.select("bridge_key", "visit_id"), ["bridge_key"]).select(F.col("bridge_key").alias("bk"), F.col("visit_id").alias("bv"))
    out_of = F.when(F.col("av").isNull(), "unknown_visit").otherwise("visit_not_in_cohort")
    within = (F.col("event_datetime") >= F.col("__start")) & (F.col("event_datetime") < F.col("__end"))

    def named(df: DataFrame, strategy: str, reason: Column) -> DataFrame:
        linked = F.col("cv").isNotNull() & ~_mismatch()
        if strict:
            df = checked(df, {"an event names another patient's visit": ~_mismatch()})
        return df.select(
            *[F.col(f"`{c}`") for c in events.columns], F.lit(None).cast("long").alias("candidates"), F.when(linked, strategy).alias("linkage_strategy"),
            F.when(_mismatch(), "patient_mismatch").otherwise(F.when(~linked, reason)).alias("reason"), F.when(linked, F.col("cv")).alias("linked_visit"), F.when(linked, F.coalesce(within, F.lit(False))).alias("inside"),
        )

    direct = named(events.filter(DIRECT).join(visits, F.col("source_visit_id") == F.col("xv"), "left"), "direct_visit", out_of)
    led = events.filter(BRIDGED).join(b, F.col("bridge_key") == F.col("bk"), "left")
    bridged = named(looked_up(led, "bv", visits, "xv", "event_id"), "bridge", F.when(F.col("bv").isNull(), "bridge_unmatched").otherwise("bridge_visit_not_in_cohort"))
    by_time = interval_link(_timed(events).select("event_id", "patient_id", "event_datetime"), cohort, days).select(F.col("event_id").alias("te"), "candidates", F.col("visit_id").alias("tv"))
    found = F.col("tv").isNotNull()
    free = events.filter(FREE).join(by_time, F.col("event_id") == F.col("te"), "left").select(
        *[F.col(f"`{c}`") for c in events.columns], "candidates", F.when(found, "patient_time").alias("linkage_strategy"),
        F.when(F.col("candidates") > 1, "ambiguous").when(~found, "no_interval").alias("reason"), F.col("tv").alias("linked_visit"), F.when(found, F.lit(True)).alias("inside"),
    )
    return direct.unionByName(bridged).unionByName(free)


def qualifying(events: DataFrame, cohort: DataFrame, bridge: DataFrame, strict: bool = False, days: int | None = None, window_hours: int | None = None, domain: str | None = None) -> DataFrame:
    """The rows of ``link`` that ``qualify`` keeps, with linkage_strategy, linked_visit, hours_from_start and the cohort's other columns.

    An event meets the cohort once, by the key it names or by time, and rows that do not qualify go there: they are not shuffled again
    and get no reason. The query fails as in ``link`` and ``qualify``; a repeated bridge key may pass where no event is led to a visit.
    """
    more = [c for c in cohort.columns if c not in ("visit_id", "patient_id")]
    own = cohort.select(F.col("visit_id").alias("cv"), F.col("patient_id").alias("cp"), *more)
    b = sole(bridge.select("bridge_key", "visit_id"), ["bridge_key"]).select(F.col("bridge_key").alias("bk"), F.col("visit_id").alias("bv"))
    fails = F.raise_error(F.lit("an event names another patient's visit")).cast("boolean")

    def kept(df: DataFrame, strategy: str, other: Column | None = None) -> DataFrame:
        rows = _window(df, window_hours, domain, other, fails if strict else F.lit(False))
        return rows.select(*events.columns, F.lit(strategy).alias("linkage_strategy"), F.col("cv").alias("linked_visit"), *more, "hours_from_start")

    direct = kept(events.filter(DIRECT).join(own, F.col("source_visit_id") == F.col("cv")), "direct_visit", _mismatch())
    bridged = kept(events.filter(BRIDGED).join(b, F.col("bridge_key") == F.col("bk")).join(own, F.col("bv") == F.col("cv")), "bridge", _mismatch())
    pairs = range_join(_timed(events), "event_datetime", own.withColumnRenamed("cp", "__on"), "start", "predictor_end", "patient_id", days)
    rest = [c for c in (*events.columns, "cv", *more) if c != "event_id"]
    one = pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("__n"), *[F.first(f"`{c}`").alias(c) for c in rest]).filter("__n = 1")
    return direct.unionByName(bridged).unionByName(kept(one, "patient_time"))


#: The domains whose events may have a day instead of a time.
DATED = ("procedures",)


def qualify(linked: DataFrame, cohort: DataFrame, window_hours: int | None = None, domain: str | None = None) -> DataFrame:
    """Linked events inside their visit's window, with hours_from_start (null where the day alone is known).

    Times lie in start <= time < predictor_end. Rows whose event_time_precision is "date" have an event_date instead, from the day of
    the start to the day of start + ``window_hours``, both included and whether or not the visit ended before: the query fails at
    such a row if the domain is not one of DATED or no window is given. Another precision, or none, qualifies nothing.
    """
    c = cohort.select(F.col("visit_id").alias("linked_visit"), "start", "predictor_end", *[x for x in ("cohort_visit_number",) if x in cohort.columns])
    return _window(linked.filter("linked_visit is not null").join(c, "linked_visit"), window_hours, domain)


def _window(df: DataFrame, window_hours: int | None, domain: str | None, other: Column | None = None, then: Column | None = None) -> DataFrame:
    """``qualify``'s rows; where ``other`` holds, ``then`` decides. It is one condition, so that no part hides another that fails."""
    keep = lambda condition: df.filter(condition if other is None else F.when(other, then).otherwise(condition))
    exact = (F.col("event_datetime") >= F.col("start")) & (F.col("event_datetime") < F.col("predictor_end"))
    hours = hours_between(F.col("start"), F.col("event_datetime"))
    if "event_time_precision" not in df.columns:
        return keep(exact).withColumn("hours_from_start", hours)
    timed, dated = F.col("event_time_precision") == "datetime", F.col("event_time_precision") == "date"
    if domain not in DATED or window_hours is None:
        fails = F.raise_error(F.lit(f"an event of {domain or 'a domain'} has a day alone")).cast("boolean")
        return keep(F.when(dated, fails).otherwise(timed & exact)).withColumn("hours_from_start", hours)
    day = (F.col("event_date") >= F.to_date("start")) & (F.col("event_date") <= F.to_date(F.col("start") + F.expr(f"make_dt_interval(0, {window_hours})")))
    return keep((timed & exact) | (dated & day)).withColumn("hours_from_start", F.when(timed, hours))


def hours_between(a: Column, b: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(3.6e9)


def audit(linked: DataFrame) -> DataFrame:
    """(measure, n) of ``link``'s rows: source rows, links by strategy, rows without a link by reason, rows outside the window, qualifying rows; one pass."""
    name = F.coalesce(F.concat(F.lit("linked_"), F.col("linkage_strategy")), F.concat(F.lit("unmatched_"), F.col("reason")))
    each = linked.groupBy(name.alias("measure"), F.col("linkage_strategy").isNotNull().alias("has")).agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("good"))
    outside = F.when(F.col("has"), F.col("n") - F.col("good")).otherwise(0)
    parts = F.array(F.struct("measure", "n"), *[F.struct(F.lit(m).alias("measure"), x.alias("n")) for m, x in (("source", F.col("n")), ("outside_window", outside), ("qualifying", F.col("good")))])
    zeros = linked.sparkSession.createDataFrame([("source", 0), ("outside_window", 0), ("qualifying", 0)], "measure string, n long")  # these have a row in any case
    return each.select(F.explode(parts).alias("x")).select("x.*").unionByName(zeros).groupBy("measure").agg(F.sum("n").alias("n"))


def stage_counts(linked: DataFrame) -> DataFrame:
    """(stage, observed): source, linked and qualifying rows, counted in one pass over ``link``'s rows."""
    one = linked.agg(F.count(F.lit(1)).alias("source"), F.count("linked_visit").alias("linked"), F.count_if("inside").alias("qualifying"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).alias("observed")) for s in ("source", "linked", "qualifying")])).alias("x")).select("x.*")
