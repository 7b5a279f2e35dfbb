"""Landmark cohort: eligibility, time anchors, outcome, attrition, samples, prior use."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.normalise import canonical_float
from tidewater.operators.audit import checked, sole
from tidewater.operators.numbering import numbered
from tidewater.operators.ranges import range_cells
from tidewater.operators.verify import with_evidence


@dataclass(frozen=True)
class CohortRules:
    acute: tuple[str, ...] = ("inpatient", "observation", "emergency")
    elective: tuple[str, ...] = ("true", "1", "elective")
    age: tuple[float, float] = (18, 120)
    landmark_hours: int = 24
    window_hours: int = 24
    horizon_days: int = 30
    lookback_days: int = 365
    end_at_discharge: bool = True
    keep_short: bool = True
    need_followup: bool = True


STEPS = ("source", "age", "acute", "non_elective", "valid_end", "alive_at_landmark", "followed_up", "final")


def hours(n: int) -> Column:
    return F.expr(f"make_dt_interval(0, {n})")


def days(n: int) -> Column:
    return F.expr(f"make_dt_interval({n})")


def age_by_anchor(start: Column) -> Column:
    return F.col("age_anchor") + (F.year(start) - F.col("age_anchor_year"))


def age_by_birth(start: Column, birth: Column) -> Column:
    return F.timestamp_diff("SECOND", birth, start) / F.lit(365.2425 * 86400)


def base(encounters: DataFrame, patients: DataFrame, deaths: DataFrame, rules: CohortRules) -> DataFrame:
    """Encounters with patient, age, death and the time anchors; one row for each encounter.

    Deaths are of the visit where they have a visit_id, else of the patient. The query fails if a patient or a death is there twice.
    """
    df = encounters.join(sole(patients, ["patient_id"]), "patient_id", "left").withColumn("age", age_by_anchor(F.col("start")).cast("double"))
    keys = [c for c in ("patient_id", "visit_id") if c in deaths.columns]
    df = df.join(sole(deaths.select(*keys, "death_datetime", "death_date", "death_time_precision"), keys), keys, "left")
    df = df.withColumn("landmark", F.col("start") + hours(rules.landmark_hours)).withColumn("horizon", F.col("start") + days(rules.horizon_days))
    end = F.col("start") + hours(rules.window_hours)
    return df.withColumn("predictor_end", F.least(end, F.col("end")) if rules.end_at_discharge else end)


def died_by_landmark() -> Column:
    exact = F.col("death_datetime") <= F.col("landmark")
    by_day = F.col("death_date") <= F.to_date("landmark")
    return F.coalesce(F.when(F.col("death_time_precision") == "date", by_day).otherwise(exact), F.lit(False))


def outcome() -> Column:
    """Death after the landmark and by the horizon; by day where the day alone is known."""
    exact = (F.col("death_datetime") > F.col("landmark")) & (F.col("death_datetime") <= F.col("horizon"))
    by_day = (F.col("death_date") > F.to_date("landmark")) & (F.col("death_date") <= F.to_date("horizon"))
    return F.coalesce(F.when(F.col("death_time_precision") == "date", by_day).otherwise(exact), F.lit(False)).cast("int")


def gated(df: DataFrame, rules: CohortRules) -> DataFrame:
    """``df`` with outcome, the boolean gates g1..g8 in the order of STEPS, each including those before."""
    short = F.coalesce(F.col("end") < F.col("landmark"), F.lit(False))
    valid = ~F.coalesce(F.col("end") < F.col("start"), F.lit(False)) & (F.lit(rules.keep_short) | ~short)
    df = df.withColumn("outcome", outcome()).withColumn("short_visit", short)
    dead_after = F.coalesce(F.col("death_datetime") > F.col("horizon"), F.col("death_date") > F.to_date("horizon"), F.lit(False))
    followed = (F.col("outcome") == 1) | dead_after | F.coalesce(F.col("followup_end") >= F.col("horizon"), F.lit(False))
    df = df.withColumn("followup_verified", followed)
    gates = [
        F.lit(True),
        F.coalesce(F.col("age").between(*rules.age), F.lit(False)),
        F.coalesce(F.lower("visit_type").isin(*rules.acute), F.lit(False)),
        ~F.coalesce(F.lower(F.trim(F.col("elective").cast("string"))), F.lit("")).isin(*rules.elective),
        valid,
        ~died_by_landmark(),
        followed if rules.need_followup else F.lit(True),
        F.lit(True),
    ]
    so_far = None
    for i, g in enumerate(gates, 1):
        so_far = g if so_far is None else so_far & g
        df = df.withColumn(f"g{i}", so_far)
    return df


def attrition(df: DataFrame) -> DataFrame:
    """(step_no, step, visits, patients) after each gate, in one pass over the gated rows."""
    # gates include those before, so a row is at a number of steps, and a patient at as many as the row that went furthest
    gates = [F.col(f"g{i}").cast("int") for i in range(1, len(STEPS) + 1)]
    rows = df.select("patient_id", sum(gates[1:], gates[0]).alias("at"))
    per = rows.groupBy("patient_id").agg(F.max("at").alias("most"), *[F.count_if(F.col("at") >= i).alias(f"v{i}") for i in range(1, len(STEPS) + 1)])
    one = per.agg(*[F.coalesce(F.sum(f"v{i}"), F.lit(0)).alias(f"v{i}") for i in range(1, len(STEPS) + 1)], *[F.count_if(F.col("most") >= i).alias(f"p{i}") for i in range(1, len(STEPS) + 1)])
    cells = F.array(*[F.struct(F.lit(i).alias("step_no"), F.lit(s).alias("step"), F.col(f"v{i}").alias("visits"), F.col(f"p{i}").alias("patients")) for i, s in enumerate(STEPS, 1)])
    return one.select(F.explode(cells).alias("s")).select("s.*").filter("visits > 0")


def cohort(df: DataFrame, order: tuple[str, ...] = ("start", "patient_id", "visit_id")) -> DataFrame:
    """Rows that pass all gates, numbered 1..N in the order of the policy."""
    return numbered(df.filter("g8"), [F.col(c) for c in order], "cohort_visit_number")


def hash_subsample(df: DataFrame, n: int, seed: int, key: str = "visit_id") -> DataFrame:
    """The n rows of least sha256(seed|key)."""
    digest = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)
    return df.withColumn("__d", digest).orderBy("__d", key).limit(n).drop("__d")


def boundary_subsample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """Whole patients in hash order until ``n`` visits, of the patient at the boundary as many as are missing."""
    order = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("patient_id").cast("string")), 256)
    ranked = numbered(df.withColumn("__first", order), [F.col("__first"), F.col("patient_id"), F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("visit_id").cast("string")), 256), F.col("visit_id")], "__n")
    return ranked.filter(F.col("__n") <= n).drop("__first", "__n")


def prior_use(df: DataFrame, encounters: DataFrame, rules: CohortRules) -> DataFrame:
    """Of each row of ``df``: earlier visits, and acute ones, with start - look-back <= prior < start. Visits have one start each."""
    prior = encounters.select("patient_id", "visit_id", F.col("start").alias("ps"), F.coalesce(F.lower("visit_type").isin(*rules.acute), F.lit(False)).alias("pa")).distinct()
    own = df.select("visit_id", "patient_id", F.col("start").alias("high")).distinct().withColumn("low", F.col("high") - days(rules.lookback_days))
    cells = range_cells(prior, "ps", ["pa"], own, "low", "high", "patient_id", max(1, rules.lookback_days // 8))
    found = cells.groupBy("visit_id").agg(F.sum("n").alias("a"), F.sum(F.when(F.col("pa"), F.col("n"))).alias("b"))
    out = df.select("visit_id").distinct().join(found, "visit_id", "left").select("visit_id", F.coalesce("a", F.lit(0)).cast("long").alias("prior_visits"), F.coalesce("b", F.lit(0)).cast("long").alias("prior_acute_visits"))
    return out.withColumn("any_prior", (F.col("prior_visits") > 0).cast("int"))


def count_comparison(observed: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, expected, observed, absolute_difference, tolerance, matches); a side that is missing does not match."""
    both = expected.join(observed, keys, "full_outer")
    diff = F.abs(F.col("observed") - F.col("expected"))
    return both.select(*keys, "expected", "observed", diff.alias("absolute_difference"), "tolerance", F.coalesce(diff <= F.col("tolerance"), F.lit(False)).alias("matches"))


def require_counts(observed: DataFrame, expected: DataFrame, keys: list[str], evidence: str | None = None) -> DataFrame:
    """The comparison of counts; its query fails at the first that is missing or off by more than its tolerance.

    With ``evidence`` the whole comparison is written there first, so that it can be read after a failure.
    """
    both = count_comparison(observed, expected, keys)
    if evidence:
        return with_evidence(both, F.col("matches"), "a count is not what is expected", evidence)
    return checked(both, {"a count is not what is expected": F.col("matches")})


def override(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Attributes at admission win over the patient's where they are known: {attribute: its column at admission}."""
    return df.withColumns({name: F.coalesce(own, name) for name, own in names.items()})


BASELINE = ("cohort_visit_number", "visit_id", "patient_id", "sex", "race", "visit_type")


def baseline(df: DataFrame, columns: tuple[str, ...] = BASELINE) -> DataFrame:
    """The numbered cohort's baseline columns, age rounded to eight decimals, and the outcome."""
    return df.select(*columns, canonical_float(F.col("age")).alias("age"), "outcome")
