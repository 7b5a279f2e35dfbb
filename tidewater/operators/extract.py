"""What of the sources a cohort needs: candidates first, then only their events, diagnoses and earlier visits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators.audit import sole
from tidewater.operators.cohort import CohortRules, age_by_anchor, hours
from tidewater.operators.ranges import before_any
from tidewater.sources.scans import members


def candidates(encounters: DataFrame, rules: CohortRules) -> DataFrame:
    """Encounters of an acute type that are not elective; an unknown election stays."""
    elective = F.coalesce(F.lower(F.trim(F.col("elective").cast("string"))), F.lit("")).isin(*rules.elective)
    return encounters.filter(F.lower("visit_type").isin(*rules.acute) & ~elective)


def native_candidates(encounters: DataFrame, patients: DataFrame, deaths: DataFrame, rules: CohortRules) -> DataFrame:
    """(visit_id, patient_id), distinct: acute visits in the age range that do not end before they start and were not cut short by death.

    Ages are at the start, from the anchors. Deaths are of the visit (visit_id, death_date, once each): one by the day of the
    landmark ends it; a table of deaths without visits ends none. Visits without an id, a patient, a start or an age are left out.
    """
    rows = encounters.join(sole(patients.select("patient_id", "age_anchor", "age_anchor_year"), ["patient_id"]), "patient_id", "left").withColumn("age", age_by_anchor(F.col("start")))
    rows = rows.filter(F.col("visit_id").isNotNull() & F.col("patient_id").isNotNull() & F.col("age").between(*rules.age) & F.lower(F.trim("visit_type")).isin(*rules.acute) & (F.col("end").isNull() | (F.col("end") >= F.col("start"))))
    if "visit_id" in deaths.columns:
        rows = rows.join(sole(deaths.filter("visit_id is not null").select("visit_id", "death_date"), ["visit_id"]), "visit_id", "left")
        rows = rows.filter(F.col("death_date").isNull() | (F.col("death_date") > F.to_date(F.col("start") + hours(rules.landmark_hours))))
    return rows.select("visit_id", "patient_id").distinct()


def within_bounds(events: DataFrame, cohort: DataFrame, time: str, before: int = 0, after: int = 0) -> DataFrame:
    """Events from the cohort's first start less ``before`` hours until its last start plus ``after`` hours, that end excluded.

    The two bounds come to the driver and go back as literals, so that a scan skips files and row groups.
    """
    low, high = cohort.agg((F.min("start") - hours(before)).cast("timestamp_ntz").alias("low"), (F.max("start") + hours(after)).cast("timestamp_ntz").alias("high")).first()
    if low is None:
        return events.filter(F.lit(False))
    bound = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
    return events.filter((F.col(time) >= bound(low)) & (F.col(time) < bound(high)))


def domain_events(events: DataFrame, cohort: DataFrame, bridge: DataFrame) -> DataFrame:
    """Events that name a visit of the cohort, else by bridge key, else of one of its patients.

    Three disjoint semi joins: an event that names a visit is judged by it alone.
    """
    first = members(events.filter("source_visit_id is not null"), "source_visit_id", cohort.select("visit_id"))
    rest = events.filter("source_visit_id is null")
    second = members(rest.filter("bridge_key is not null"), "bridge_key", bridge.join(cohort.select("visit_id"), "visit_id", "left_semi").select("bridge_key"))
    third = members(rest.filter("bridge_key is null"), "patient_id", cohort.select("patient_id"))
    return first.unionByName(second).unionByName(third)


def prior_encounters(encounters: DataFrame, cohort: DataFrame, lookback_days: int = 365) -> DataFrame:
    """Distinct encounters of the cohort's patients that start before one of its visits, within the look-back."""
    return before_any(encounters, "start", cohort, "start", "patient_id", lookback_days).distinct()


def prior_diagnoses(diagnoses: DataFrame, cohort: DataFrame, lookback_days: int = 365) -> DataFrame:
    """Diagnoses (patient_id, diagnosis_datetime, ...) with start - look-back <= time < start for a visit of the patient."""
    return before_any(diagnoses, "diagnosis_datetime", cohort, "start", "patient_id", lookback_days)


def admitted(measurements: DataFrame, observations: DataFrame, mode: str) -> DataFrame:
    """Measurements, with observations that have a value appended if the mode is "numeric_measurements"; "audit_only" leaves them out."""
    if mode == "audit_only":
        return measurements
    if mode == "numeric_measurements":
        return measurements.unionByName(observations.filter(F.col("value").isNotNull()))
    raise ValueError(f"no such mode: {mode}")


def namespaced(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(concept_key, value) of several sources, {namespace: (table, item column, value column)}; keys are namespace:item."""
    out = None
    for name, (df, item, value) in tables.items():
        part = df.select(F.concat(F.lit(f"{name}:"), F.col(item).cast("string")).alias("concept_key"), F.col(value).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out
