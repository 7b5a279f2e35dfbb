"""The driver's tables as the standardized tables of a cohort study, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.normalise import unit_hash
from tidewater.operators.cohort import CohortRules, base, cohort, gated
from tidewater.sources.scans import scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Orders stand for encounters: months between them, so the anchors are wide.
RULES = CohortRules(acute=("1-urgent", "2-high", "3-medium", "4-not specified", "5-low"), landmark_hours=720, window_hours=2160, horizon_days=365, age=(18, 120))


def query(name: str, sql: str | None = None):
    """Registers a query and the SQL of its result; {views} in the SQL is replaced by the bindings."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.replace("{cohort}", COHORT_SQL).replace("{views}", VIEWS_SQL).replace("{scores}", SCORES_SQL)
        return f

    return put


VIEWS_SQL = """patients as (select c_custkey as patient_id, c_mktsegment as sex, 'NATION_' || c_nationkey as race, 18 + c_custkey % 70 as age_anchor, 1995 as age_anchor_year from customer),
encounters as (select o_orderkey as visit_id, o_custkey as patient_id, o_orderdate as "start", case when o_orderkey % 17 = 0 then null else o_orderdate + to_days(cast(o_orderkey % 10 as integer)) end as "end",
  o_orderpriority as visit_type, o_orderstatus = 'P' as elective, timestamp '2002-01-01' as followup_end from orders),
deaths as (select o_custkey as patient_id, min(o_orderdate) as death_datetime, cast(min(o_orderdate) as date) as death_date, 'datetime' as death_time_precision from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' group by 1),
base as (select e.*, p.sex, p.race, p.age_anchor, p.age_anchor_year, cast(p.age_anchor + (year(e."start") - p.age_anchor_year) as double) as age, d.death_datetime, d.death_date,
  e."start" + interval 30 day as landmark, e."start" + interval 365 day as horizon, least(e."start" + interval 90 day, e."end") as predictor_end
  from encounters e left join patients p using (patient_id) left join deaths d using (patient_id)),
flagged as (select *, cast(coalesce(death_datetime > landmark and death_datetime <= horizon, false) as integer) as outcome, coalesce("end" < landmark, false) as short_visit from base),
gated as (select *, coalesce(age between 18 and 120, false) as g2, lower(visit_type) in ('1-urgent', '2-high', '3-medium', '4-not specified', '5-low') as a3, not elective as a4, not coalesce("end" < "start", false) as a5,
  not coalesce(death_datetime <= landmark, false) as a6, (outcome = 1 or coalesce(death_datetime > horizon, false) or coalesce(followup_end >= horizon, false)) as a7 from flagged)"""
COHORT_SQL = VIEWS_SQL + """,
cohort as (select *, row_number() over (order by "start", patient_id, visit_id) as cohort_visit_number from gated where g2 and a3 and a4 and a5 and a6 and a7)"""
SCORES_SQL = COHORT_SQL + """,
identity as (select cohort_visit_number as n, visit_id, patient_id, outcome, cast(('0x' || substr(md5('42|' || patient_id), 1, 8)) as bigint) % 5 + 1 as fold from cohort),
scores as (select n, visit_id, patient_id, outcome, fold, matrix, model,
  floor(1000 * (0.55 * (cast(('0x' || substr(md5(matrix || '|' || model || '|' || visit_id), 1, 8)) as bigint) / 4294967296.0) + 0.25 * outcome * (cast(('0x' || substr(md5('s|' || model || '|' || visit_id), 1, 8)) as bigint) / 4294967296.0))) / 1000 as p
  from identity, (values ('x1'), ('x2')) a(matrix), (values ('m1'), ('m2'), ('m3')) b(model))"""


def _t(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    return scan(spark, f"{d}/{table}.parquet", list(columns))


def patients(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    return c.select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("sex"), F.concat(F.lit("NATION_"), F.col("c_nationkey")).alias("race"), (18 + F.col("c_custkey") % 70).alias("age_anchor"), F.lit(1995).alias("age_anchor_year"))


def encounters(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    end = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderdate") + F.expr("make_dt_interval(cast(o_orderkey % 10 as int))"))
    return o.select(F.col("o_orderkey").alias("visit_id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("start"), end.alias("end"), F.col("o_orderpriority").alias("visit_type"), (F.col("o_orderstatus") == "P").alias("elective"), F.lit("2002-01-01").cast("timestamp_ntz").alias("followup_end"))


def deaths(spark: SparkSession, d: str) -> DataFrame:
    o = _t(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority").filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    died = o.groupBy(F.col("o_custkey").alias("patient_id")).agg(F.min("o_orderdate").alias("death_datetime"))
    return died.select("patient_id", "death_datetime", F.to_date("death_datetime").alias("death_date"), F.lit("datetime").alias("death_time_precision"))


def gated_base(spark: SparkSession, d: str) -> DataFrame:
    return gated(base(encounters(spark, d), patients(spark, d), deaths(spark, d), RULES), RULES)


def frozen_cohort(spark: SparkSession, d: str) -> DataFrame:
    return cohort(gated_base(spark, d))


def fold_of(patient, seed: int = 42, k: int = 5):
    """The fold of a patient by hash, for score tables."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), patient.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") % k + 1


def identity(spark: SparkSession, d: str) -> DataFrame:
    return frozen_cohort(spark, d).select(F.col("cohort_visit_number").alias("n"), "visit_id", "patient_id", "outcome", fold_of(F.col("patient_id")).alias("fold"))


def scores(spark: SparkSession, d: str, matrices: tuple[str, ...] = ("x1", "x2")) -> DataFrame:
    """Probabilities of each matrix and three models for each visit of the cohort; three decimals, so ties are many."""
    pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("matrix"), F.lit(m).alias("model")) for x in matrices for m in ("m1", "m2", "m3")]))
    rows = identity(spark, d).select("*", pairs.alias("pair")).select("n", "visit_id", "patient_id", "outcome", "fold", "pair.*")
    visit = F.col("visit_id").cast("string")
    p = F.floor(1000 * (0.55 * unit_hash(F.concat_ws("|", "matrix", "model", visit)) + 0.25 * F.col("outcome") * unit_hash(F.concat_ws("|", F.lit("s"), F.col("model"), visit)))) / 1000
    return rows.withColumn("p", p)


def domain_events(spark: SparkSession, d: str, concepts: bool = True) -> DataFrame:
    """Line items as events of the orders: a part's brand and type is the concept; a fifth has lost its visit.

    Without ``concepts`` the key of the part comes instead, for ``with_concepts`` where few rows are left. Rows of the three kinds are
    made apart, so that the visit of those that name it is the order's key as it stands and a later join by it needs no shuffle.
    """
    line = _t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
    owner = _t(spark, d, "orders", "o_orderkey", "o_custkey")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")], F.col("l_quantity").cast("bigint").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"), F.date_format("l_shipdate", "yyyyMMdd"))
    lost, led = F.col("l_partkey") % 5 == 0, (F.col("l_orderkey") % 7 == 0) & (F.col("l_partkey") % 10 == 0)
    kinds = (
        (~lost, F.col("l_orderkey"), F.lit(None).cast("string")),
        (lost & led, F.lit(None).cast("long"), F.concat(F.lit("B"), F.col("l_orderkey"))),
        (lost & ~led, F.lit(None).cast("long"), F.lit(None).cast("string")),
    )

    def made(kind: Column, visit: Column, bridge_key: Column) -> DataFrame:
        rows, concept = line.filter(kind), F.col("l_partkey").alias("part_key")
        if concepts:
            part = _t(spark, d, "part", "p_partkey", "p_brand", "p_type")
            rows, concept = rows.join(part, F.col("l_partkey") == F.col("p_partkey")), F.concat_ws("-", "p_brand", "p_type").alias("concept_key")
        rows = rows.join(owner, F.col("l_orderkey") == F.col("o_orderkey"))
        return rows.select(
            key.alias("event_id"),
            visit.alias("source_visit_id"),
            bridge_key.alias("bridge_key"),
            F.col("o_custkey").alias("patient_id"),
            F.col("l_shipdate").alias("event_datetime"),
            concept,
            F.col("l_quantity").alias("value"),
            F.col("l_returnflag").alias("unit"),
        )

    return reduce(DataFrame.unionByName, [made(*k) for k in kinds])


def with_concepts(spark: SparkSession, d: str, events: DataFrame) -> DataFrame:
    """``events`` with concept_key for part_key; those whose part is not there go."""
    part = _t(spark, d, "part", "p_partkey", "p_brand", "p_type").select("p_partkey", F.concat_ws("-", "p_brand", "p_type").alias("concept_key"))
    return events.join(part, F.col("part_key") == F.col("p_partkey")).drop("part_key", "p_partkey")


EVENTS_SQL = """events_ as (select concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as bigint), cast(round(l_extendedprice * 100) as bigint), strftime(l_shipdate, '%Y%m%d')) as event_id,
  case when l_partkey % 5 != 0 then l_orderkey end as source_visit_id, case when l_partkey % 10 = 0 and l_orderkey % 7 = 0 then 'B' || l_orderkey end as bridge_key, o_custkey as patient_id,
  l_shipdate as event_datetime, p_brand || '-' || p_type as concept_key, l_quantity as value, l_returnflag as unit from lineitem join part on l_partkey = p_partkey join orders on l_orderkey = o_orderkey),
bridge as (select 'B' || o_orderkey as bridge_key, o_orderkey as visit_id from orders where o_orderkey % 7 = 0)"""


def bridge(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "orders", "o_orderkey").filter("o_orderkey % 7 = 0").select(F.concat(F.lit("B"), F.col("o_orderkey")).alias("bridge_key"), F.col("o_orderkey").alias("visit_id"))
