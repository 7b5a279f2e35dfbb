"""Source tables to the standard ones: mapped columns, defaults, times, deaths, categories and events.

What must hold is checked in the query itself: it fails at the first row that breaks a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.normalise import procedure_code
from tidewater.operators.audit import ConstraintError, checked, union
from tidewater.operators.cohort import days

TIME = "yyyy-MM-dd HH:mm:ss"


def mapped(df: DataFrame, mapping: dict[str, str | Column | None], required: tuple[str, ...] = (), kinds: dict[str, str] | None = None) -> DataFrame:
    """The columns of ``mapping`` (target: source column, expression or None), in its order.

    None gives nulls of the kind in ``kinds`` (text if not said). A required target without a source column is an error.
    """
    gone = [t for t, s in mapping.items() if (isinstance(s, str) and s not in df.columns) or (s is None and t in required)]
    if wrong := [t for t in gone if t in required or mapping[t] is not None]:
        raise ConstraintError(f"no source column for: {wrong}")
    put = {t: F.lit(None).cast((kinds or {}).get(t, "string")) if s is None else F.col(s) if isinstance(s, str) else s for t, s in mapping.items()}
    return df.select(*[c.alias(t) for t, c in put.items()])


def filled(df: DataFrame, column: str, default: str | None) -> DataFrame:
    """``column`` with a default for nulls; the query fails if one is left."""
    df = df.withColumn(column, F.coalesce(column, F.lit(default))) if default is not None else df
    return checked(df, {f"{column} is missing": F.col(column).isNotNull()})


def parsed(df: DataFrame, columns: dict[str, bool], form: str = TIME) -> DataFrame:
    """Texts to times, null where they are not; the query fails where a mandatory one (True) is null then."""
    for name, mandatory in columns.items():
        df = df.withColumn(name, F.try_to_timestamp(F.col(name).cast("string"), F.lit(form)))
        if mandatory:
            df = checked(df, {f"{name} is not a time": F.col(name).isNotNull()})
    return df


def backfilled_deaths(df: DataFrame, source: str) -> DataFrame:
    """``df`` (death_datetime and, as far as known, death_date, death_time_precision, death_source, death_source_conflict) without gaps.

    The day comes from the time, the precision is "datetime", the source the table's name and the conflict false unless said.
    """
    known = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    day = F.coalesce(known("death_date", "date"), F.to_date("death_datetime"))
    return df.withColumns({"death_date": day, "death_time_precision": F.coalesce(known("death_time_precision", "string"), F.lit("datetime")), "death_source": F.coalesce(known("death_source", "string"), F.lit(source)), "death_source_conflict": F.coalesce(known("death_source_conflict", "boolean"), F.lit(False))})


def earliest_death(df: DataFrame, key: str = "patient_id") -> DataFrame:
    """One row for each patient: that of the earliest time, then the earliest day; rows without either come last."""
    rest = [c for c in df.columns if c != key]
    order = F.struct(F.col("death_datetime").isNull(), "death_datetime", *([F.col("death_date")] if "death_date" in rest else []))
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def precise_then_day(precise: DataFrame, days_: DataFrame) -> DataFrame:
    """(patient_id, death_datetime, death_date, death_time_precision, death_source_conflict): a time wins over a day; they conflict if their days differ.

    ``precise`` (patient_id, death_datetime), ``days_`` (patient_id, death_date); the earliest of each counts.
    """
    a = precise.groupBy("patient_id").agg(F.min("death_datetime").alias("death_datetime"))
    b = days_.groupBy("patient_id").agg(F.min("death_date").alias("day"))
    both = a.join(b, "patient_id", "full_outer").filter("death_datetime is not null or day is not null")
    precision = F.when(F.col("death_datetime").isNotNull(), "datetime").otherwise("date")
    return both.select("patient_id", "death_datetime", F.coalesce(F.to_date("death_datetime"), "day").alias("death_date"), precision.alias("death_time_precision"), F.coalesce(F.to_date("death_datetime") != F.col("day"), F.lit(False)).alias("death_source_conflict"))


def earliest_day(df: DataFrame, precise: str, day: str) -> DataFrame:
    """``df`` with death_date, the earlier of two sources' days, which of them said so, and whether they differ; rows without a death go."""
    a, b = F.to_date(precise), F.to_date(day)
    source = F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "both_equal").otherwise("both_differ")).when(a.isNotNull(), "precise").otherwise("date")
    out = df.filter(a.isNotNull() | b.isNotNull())
    return out.withColumns({"death_date": F.least(a, b), "death_source": source, "death_source_conflict": F.coalesce(a != b, F.lit(False))})


def harmonised(df: DataFrame, column: str, names: dict[str, str], unmapped: str = "error") -> DataFrame:
    """``column`` by a table of names. What is not in it stays ("keep") or fails the query ("error"); nulls stay."""
    if unmapped not in ("error", "keep"):
        raise ValueError(f"no such policy: {unmapped}")
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = F.try_element_at(known, F.col(column))
    if unmapped == "error":
        df = checked(df, {f"{column} has a value without a name": F.col(column).isNull() | found.isNotNull()})
    return df.withColumn(column, F.coalesce(found, column))


def visit_types(df: DataFrame, column: str, names: dict[str, str] | None, elective: tuple[str, ...], unmapped: str = "error") -> DataFrame:
    """``df`` with visit_type, trimmed, in upper case and named by the table if there is one, and elective: whether the text is on a list."""
    text = F.upper(F.trim(column))
    out = df.withColumns({"elective": text.isin(*elective), "visit_type": text})
    return out if names is None else harmonised(out, "visit_type", names, unmapped)


def followup_ends(df: DataFrame, policy: str, horizon_days: int = 365, column: str = "followup_end") -> DataFrame:
    """followup_end by "source" (as it is) or "horizon" (days after the start)."""
    if policy == "source":
        return df.withColumn("followup_end", F.col(column))
    if policy == "horizon":
        return df.withColumn("followup_end", F.col("start") + days(horizon_days))
    raise ValueError(f"no such policy: {policy}")


def anchor_births(df: DataFrame) -> DataFrame:
    """birth_datetime: the first of January of the anchor year less the anchor age."""
    return df.withColumn("birth_datetime", F.make_date((F.col("age_anchor_year") - F.col("age_anchor")).cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz"))


def measurement_events(df: DataFrame, namespace: str, subject: str, item: str, times: tuple[str, ...], value: str, numeric_only: bool = True) -> DataFrame:
    """``df`` with patient_id, event_datetime (the first of ``times`` that is known), concept_key and value.

    Rows without subject, item or time go, and those without a number too if only numbers count.
    """
    time = F.coalesce(*[F.col(t) for t in times])
    number = F.col(value).try_cast("double")
    rows = df.filter(F.col(subject).isNotNull() & F.col(item).isNotNull() & time.isNotNull())
    rows = rows.filter(number.isNotNull()) if numeric_only else rows
    return rows.withColumns({"patient_id": F.col(subject), "event_datetime": time, "concept_key": F.concat(F.lit(f"{namespace}:"), F.col(item).cast("string")), "value": number if numeric_only else F.col(value)})


def medication_events(df: DataFrame, visit: str, key: Column, semantics: str) -> DataFrame:
    """``df`` with source_visit_id, concept_key (a code, as ``code_hierarchy`` makes), value 1, unit "record" and semantics; rows without a code go."""
    rows = df.withColumn("concept_key", key).filter("concept_key is not null")
    return rows.withColumns({"source_visit_id": F.col(visit), "value": F.lit(1.0), "unit": F.lit("record"), "semantics": F.lit(semantics)})


def procedure_events(df: DataFrame, version: Column, raw: Column, day: str) -> DataFrame:
    """``df`` with concept_key, event_date and the precision "date"; rows without a code or day go."""
    rows = df.withColumns({"concept_key": procedure_code(version, raw), "event_date": F.to_date(day), "event_time_precision": F.lit("date")})
    return rows.filter("concept_key is not null and event_date is not null")


def dated_diagnoses(diagnoses: DataFrame, encounters: DataFrame, visit: str = "visit_id") -> DataFrame:
    """``diagnoses`` with diagnosis_datetime, the start of their visit; null where the visit is not there."""
    start = encounters.select(F.col("visit_id").alias(visit), F.col("start").alias("diagnosis_datetime"))
    return diagnoses.join(start, visit, "left")


def concept_rows(domains: dict[str, DataFrame], columns: tuple[str, ...] = ("concept_key", "unit")) -> DataFrame:
    """(domain, columns): the distinct concepts of all domains; columns that one lacks are null there."""
    parts = [df.select(F.lit(name).alias("domain"), *[F.col(c).cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]) for name, df in domains.items()]
    return union(parts).distinct()
