"""Queries of the sources, cohort and normalisation operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewater.functions import normalise as N
from tidewater.operators import audit as A
from tidewater.operators import cohort as C
from tidewater.operators import comorbidity as H
from tidewater.operators import extract as X
from tidewater.operators import standardize as Z
from tidewater.operators.numbering import numbered
from tidewater.plans import bindings as B
from tidewater.plans.bindings import RULES, query
from tidewater.sources import scans as S

TS = "yyyy-MM-dd HH:mm:ss"


def text(c):
    return F.date_format(c, TS).alias(c)


@query("scan_projected", "select l_orderkey, l_quantity from lineitem")
def _(spark, d):
    return S.scan(spark, f"{d}/lineitem.parquet", ["l_orderkey", "l_quantity"])


@query("scan_semi", "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey in (select o_orderkey from orders where o_orderpriority = '1-URGENT')")
def _(spark, d):
    keys = B._t(spark, d, "orders", "o_orderkey", "o_orderpriority").filter("o_orderpriority = '1-URGENT'").select("o_orderkey")
    return S.members(B._t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", keys)


@query("scan_any_of", "select l_orderkey, l_partkey, l_suppkey from lineitem where l_partkey in (select p_partkey from part where p_size < 5) or l_suppkey in (select s_suppkey from supplier where s_acctbal < 0)")
def _(spark, d):
    parts = B._t(spark, d, "part", "p_partkey", "p_size").filter("p_size < 5").select("p_partkey")
    suppliers = B._t(spark, d, "supplier", "s_suppkey", "s_acctbal").filter("s_acctbal < 0").select("s_suppkey")
    return S.any_member(B._t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey"), {"l_partkey": parts, "l_suppkey": suppliers})


@query("scan_primary_or_fallback", f"with {{views}}, {B.EVENTS_SQL} select event_id, source_visit_id, patient_id from events_ where source_visit_id in (select visit_id from encounters where not elective) or (source_visit_id is null and patient_id in (select patient_id from encounters where not elective))")
def _(spark, d):
    open_ = B.encounters(spark, d).filter("not elective")
    return S.event_filter(B.domain_events(spark, d), "direct_then_patient_time", "source_visit_id", open_.select("visit_id"), "patient_id", open_.select("patient_id")).select("event_id", "source_visit_id", "patient_id")


@query("scan_time_bounds", "select o_orderkey from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'")
def _(spark, d):
    low, high = (F.lit(x).cast("timestamp_ntz") for x in ("1996-01-01", "1997-01-01"))
    return S.in_bounds(B._t(spark, d, "orders", "o_orderkey", "o_orderdate"), "o_orderdate", low, high).select("o_orderkey")


#: The acute types of the candidate queries.
URGENT = replace(RULES, acute=("1-urgent", "2-high"))


def _candidates(spark, d):
    return X.candidates(B.encounters(spark, d), URGENT)


@query("candidate_visits", "with {views} select visit_id, patient_id from encounters where lower(visit_type) in ('1-urgent', '2-high') and not elective")
def _(spark, d):
    return _candidates(spark, d).select("visit_id", "patient_id")


@query("event_scan_bounds", f"with {{views}}, {B.EVENTS_SQL}, b as (select min(\"start\") lo, max(\"start\") + interval 90 day hi from encounters where lower(visit_type) in ('1-urgent', '2-high') and not elective) select event_id from events_, b where event_datetime >= lo and event_datetime < hi")
def _(spark, d):
    return X.within_bounds(B.domain_events(spark, d), _candidates(spark, d), "event_datetime", after=90 * 24).select("event_id")


@query("native_candidates", "with {views}, vd as (select o_orderkey as visit_id, cast(o_orderdate + to_days(cast(o_orderkey % 50 as integer)) as date) as death_date from orders where o_orderstatus = 'F') select distinct e.visit_id, e.patient_id from encounters e left join patients p using (patient_id) left join vd d using (visit_id) where p.age_anchor + year(e.\"start\") - p.age_anchor_year between 18 and 60 and lower(e.visit_type) in ('1-urgent', '2-high') and (e.\"end\" is null or e.\"end\" >= e.\"start\") and (d.death_date is null or d.death_date > cast(e.\"start\" + interval 720 hour as date))")
def _(spark, d):
    """A finished order has a death up to 49 days after its start; the landmark is 30 days after it, the horizon a year."""
    o = B._t(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderstatus").filter("o_orderstatus = 'F'")
    died = o.select(F.col("o_orderkey").alias("visit_id"), F.to_date(F.col("o_orderdate") + F.expr("make_dt_interval(cast(o_orderkey % 50 as int))")).alias("death_date"))
    return X.native_candidates(B.encounters(spark, d), B.patients(spark, d), died, replace(URGENT, age=(18, 60)))


@query("eligible_cohort", "with {cohort} select visit_id, patient_id, strftime(predictor_end, '%Y-%m-%d %H:%M:%S') as predictor_end, outcome from cohort")
def _(spark, d):
    return B.gated_base(spark, d).filter("g8").select("visit_id", "patient_id", text("predictor_end"), "outcome")


@query("domain_extract_exists", f"with {{cohort}}, {B.EVENTS_SQL} select event_id from events_ e where (source_visit_id is not null and exists (select 1 from cohort c where c.visit_id = e.source_visit_id)) or (source_visit_id is null and bridge_key is not null and exists (select 1 from bridge b join cohort c using (visit_id) where b.bridge_key = e.bridge_key)) or (source_visit_id is null and bridge_key is null and exists (select 1 from cohort c where c.patient_id = e.patient_id))")
def _(spark, d):
    return X.domain_events(B.domain_events(spark, d), B.gated_base(spark, d).filter("g8"), B.bridge(spark, d)).select("event_id")


@query("prior_encounter_extract", "with {cohort} select distinct e.visit_id, e.patient_id from encounters e join cohort c on e.patient_id = c.patient_id and e.\"start\" < c.\"start\" and e.\"start\" >= c.\"start\" - interval 365 day")
def _(spark, d):
    return X.prior_encounters(B.encounters(spark, d), B.gated_base(spark, d).filter("g8")).select("visit_id", "patient_id")


@query("observation_union", f"with {{views}}, {B.EVENTS_SQL} select event_id as id, concept_key, value from events_ union all select 'obs:' || event_id, event_type, value from events where value is not null")
def _(spark, d):
    extra = B._t(spark, d, "events", "event_id", "event_type", "value").select(F.concat(F.lit("obs:"), F.col("event_id")).alias("id"), F.col("event_type").alias("concept_key"), "value")
    return X.admitted(B.domain_events(spark, d).select(F.col("event_id").alias("id"), "concept_key", "value"), extra, "numeric_measurements")


@query("measurement_union", "select 'part:' || l_partkey as concept_key, l_quantity as value from lineitem union all select 'event:' || event_type, value from events")
def _(spark, d):
    return X.namespaced({"part": (B._t(spark, d, "lineitem", "l_partkey", "l_quantity"), "l_partkey", "l_quantity"), "event": (B._t(spark, d, "events", "event_type", "value"), "event_type", "value")})


# ------------------------------------------------------------------ normalisation


@query("map_projection", "select o_orderkey as visit_id, o_custkey as patient_id, cast(null as varchar) as unit, 'dx:' || o_orderkey as diagnosis_id from orders")
def _(spark, d):
    mapping = {"visit_id": "o_orderkey", "patient_id": "o_custkey", "unit": None, "diagnosis_id": F.concat(F.lit("dx:"), F.col("o_orderkey"))}
    return Z.mapped(B._t(spark, d, "orders", "o_orderkey", "o_custkey"), mapping, required=("visit_id", "patient_id"))


@query("fill_semantics", "select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'performed') as semantics from orders")
def _(spark, d):
    rows = B._t(spark, d, "orders", "o_orderkey", "o_orderstatus").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("semantics"))
    return Z.filled(rows, "semantics", "performed")


@query("parse_dates", "select o_orderkey, strftime(try_cast(case when o_orderkey % 11 = 0 then 'bad' else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as timestamp), '%Y-%m-%d %H:%M:%S') as parsed from orders")
def _(spark, d):
    raw = F.when(F.col("o_orderkey") % 11 == 0, "bad").otherwise(F.date_format("o_orderdate", TS)).alias("parsed")
    return Z.parsed(B._t(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", raw), {"parsed": False}).select("o_orderkey", text("parsed"))


@query("death_backfill", "select c_custkey, strftime(coalesce(case when c_custkey % 3 = 0 then date '1999-01-01' end, cast(death_datetime as date)), '%Y-%m-%d') as death_date, coalesce(case when c_custkey % 3 = 0 then 'date' end, 'datetime') as prec, 'deaths' as death_source, false as conflict from customer join (select o_custkey, min(o_orderdate) as death_datetime from orders group by 1) on c_custkey = o_custkey")
def _(spark, d):
    died = B._t(spark, d, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey").agg(F.min("o_orderdate").alias("death_datetime"))
    known = F.col("c_custkey") % 3 == 0
    rows = B._t(spark, d, "customer", "c_custkey").join(died, F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.withColumn("death_date", F.when(known, F.lit("1999-01-01").cast("date"))).withColumn("death_time_precision", F.when(known, "date"))
    out = Z.backfilled_deaths(rows, "deaths")
    return out.select("c_custkey", F.date_format("death_date", "yyyy-MM-dd").alias("death_date"), F.col("death_time_precision").alias("prec"), "death_source", F.col("death_source_conflict").alias("conflict"))


@query("earliest_death", "with {views} select patient_id, strftime(death_datetime, '%Y-%m-%d') as died from deaths")
def _(spark, d):
    o = B._t(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority").filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
    rows = o.select(F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("death_datetime"), F.to_date("o_orderdate").alias("death_date"))
    return Z.earliest_death(rows).select("patient_id", F.date_format("death_datetime", "yyyy-MM-dd").alias("died"))


@query("death_precise_then_date", "with a as (select o_custkey k, min(o_orderdate) t from orders where o_orderstatus = 'F' group by 1), b as (select o_custkey k, min(cast(o_orderdate as date)) y from orders where o_orderstatus = 'O' group by 1) select coalesce(a.k, b.k) as patient_id, case when t is not null then 'datetime' else 'date' end as prec, strftime(coalesce(cast(t as date), y), '%Y-%m-%d') as died, coalesce(cast(t as date) != y, false) as conflict from a full join b on a.k = b.k")
def _(spark, d):
    o = B._t(spark, d, "orders", "o_custkey", "o_orderdate", "o_orderstatus")
    a = o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("death_datetime"))
    b = o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("death_date"))
    return Z.precise_then_day(a, b).select("patient_id", F.col("death_time_precision").alias("prec"), F.date_format("death_date", "yyyy-MM-dd").alias("died"), F.col("death_source_conflict").alias("conflict"))


@query("death_earliest_date", "select o_orderkey, strftime(least(a, b), '%Y-%m-%d') as died, case when a is not null and b is not null then case when a = b then 'both_equal' else 'both_differ' end when a is not null then 'precise' else 'date' end as source from (select o_orderkey, case when o_orderkey % 2 = 0 then cast(o_orderdate as date) end a, case when o_orderkey % 3 = 0 then cast(o_orderdate as date) + cast(o_orderkey % 4 as integer) - 1 end b from orders) where a is not null or b is not null")
def _(spark, d):
    o = B._t(spark, d, "orders", "o_orderkey", "o_orderdate")
    o = o.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("a"), F.when(F.col("o_orderkey") % 3 == 0, F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 4 - 1).cast("int"))).alias("b"))
    return Z.earliest_day(o, "a", "b").select("o_orderkey", F.date_format("death_date", "yyyy-MM-dd").alias("died"), F.col("death_source").alias("source"))


_RACES = ("White - Other European", "BLACK/AFRICAN AMERICAN", "ASIAN - CHINESE", "HISPANIC/LATINO - CUBAN", "PORTUGUESE", "UNKNOWN", None, "MULTIPLE RACE/ETHNICITY", "American Indian", "Native Hawaiian", "Something", "Declined")
_RACE_SQL = "case c_custkey % 12 " + " ".join(f"when {i} then " + ("null" if v is None else f"'{v}'") for i, v in enumerate(_RACES)) + " end"


def _race():
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in _RACES]), (F.col("c_custkey") % 12 + 1).cast("int"))


@query("harmonise_category", f"with r as (select c_custkey, upper(trim(coalesce({_RACE_SQL}, 'UNKNOWN'))) t from customer) select c_custkey, case " + " ".join(f"when regexp_matches(t, '{p}') then '{n}'" for n, p in reversed(N.CATEGORY_RULES)) + " else 'OTHER' end as race from r")
def _(spark, d):
    return B._t(spark, d, "customer", "c_custkey").select("c_custkey", N.category(_race()).alias("race"))


@query("harmonise_ethnicity", f"with r as (select c_custkey, upper(trim(coalesce({_RACE_SQL}, 'UNKNOWN'))) t from customer) select c_custkey, case when regexp_matches(t, '{N.HISPANIC}') then 'HISPANIC_OR_LATINO' when regexp_matches(t, '{N.UNKNOWN}') then 'UNKNOWN' else 'NOT_HISPANIC_OR_LATINO' end as ethnicity from r")
def _(spark, d):
    return B._t(spark, d, "customer", "c_custkey").select("c_custkey", N.ethnicity(_race()).alias("ethnicity"))


@query("harmonise_mapping", "select c_custkey, coalesce(m.b, c_mktsegment) as segment from customer left join (values ('BUILDING', 'CONSTRUCTION'), ('MACHINERY', 'INDUSTRY')) m(a, b) on c_mktsegment = m.a")
def _(spark, d):
    rows = B._t(spark, d, "customer", "c_custkey", "c_mktsegment").withColumnRenamed("c_mktsegment", "segment")
    return Z.harmonised(rows, "segment", {"BUILDING": "CONSTRUCTION", "MACHINERY": "INDUSTRY"}, unmapped="keep")


@query("visit_type_normalise", "select o_orderkey, case upper(trim(o_orderpriority)) when '1-URGENT' then 'emergency' when '2-HIGH' then 'inpatient' else upper(trim(o_orderpriority)) end as visit_type, upper(trim(o_orderpriority)) in ('5-LOW') as elective from orders")
def _(spark, d):
    rows = B._t(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return Z.visit_types(rows, "o_orderpriority", {"1-URGENT": "emergency", "2-HIGH": "inpatient"}, ("5-LOW",), unmapped="keep").select("o_orderkey", "visit_type", "elective")


@query("followup_policy", "with {views} select visit_id, strftime(\"start\" + interval 365 day, '%Y-%m-%d') as by_horizon, strftime(followup_end, '%Y-%m-%d') as by_source from encounters")
def _(spark, d):
    rows = Z.followup_ends(Z.followup_ends(B.encounters(spark, d), "source").withColumn("by_source", F.col("followup_end")), "horizon", 365)
    return rows.select("visit_id", F.date_format("followup_end", "yyyy-MM-dd").alias("by_horizon"), F.date_format("by_source", "yyyy-MM-dd").alias("by_source"))


@query("canonical_ids", "select o_orderkey, case when o_orderkey % 3 = 0 then cast(o_orderkey as varchar) when o_orderkey % 3 = 1 then cast(o_orderkey as varchar) else 'A' || o_orderkey end as id from orders")
def _(spark, d):
    key = F.col("o_orderkey")
    raw = F.when(key % 3 == 0, F.concat(key, F.lit(".0"))).when(key % 3 == 1, F.concat(F.lit(" "), key, F.lit(" "))).otherwise(F.concat(F.lit("A"), key))
    return B._t(spark, d, "orders", "o_orderkey").select("o_orderkey", N.canonical_id(raw).alias("id"))


@query("stable_event_keys", "select 'line:' || sha256('line|' || l_orderkey || '|' || l_linenumber) || ':' || (row_number() over (partition by l_orderkey, l_linenumber) - 1) as event_id from lineitem")
def _(spark, d):
    return N.stable_event_keys(B._t(spark, d, "lineitem", "l_orderkey", "l_linenumber"), "line", ["l_orderkey", "l_linenumber"]).select("event_id")


@query("normalise_code_text", "select p_partkey, case when t in ('', 'nan', 'none', '0', '0.0') then '' else t end as code from (select p_partkey, regexp_replace(lower(trim(case when p_partkey % 9 = 0 then ' None ' else '  ' || upper(p_name) end)), '\\s+', ' ', 'g') t from part)")
def _(spark, d):
    raw = F.when(F.col("p_partkey") % 9 == 0, " None ").otherwise(F.concat(F.lit("  "), F.upper("p_name")))
    return B._t(spark, d, "part", "p_partkey", "p_name").select("p_partkey", N.code_text(raw).alias("code"))


@query("code_hierarchy", "select p_partkey, coalesce(case when p_partkey % 4 = 0 and p_partkey != 0 then 'gsn:' || p_partkey end, case when p_partkey % 3 = 0 then 'ndc:n' || p_partkey end, case when p_partkey % 5 != 0 then 'drug:' || lower(p_name) end) as code from part where p_partkey % 4 = 0 or p_partkey % 3 = 0 or p_partkey % 5 != 0")
def _(spark, d):
    k = F.col("p_partkey")
    levels = [("gsn", F.when(k % 4 == 0, k.cast("string"))), ("ndc", F.when(k % 3 == 0, F.concat(F.lit("N"), k))), ("drug", F.when(k % 5 != 0, F.col("p_name")))]
    return B._t(spark, d, "part", "p_partkey", "p_name").select("p_partkey", N.code_hierarchy(levels).alias("code")).filter("code is not null")


@query("measurement_map", "select event_id, user_id as patient_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as event_datetime, 'event:' || event_type as concept_key, value from events where value is not null and user_id is not null and event_type is not null")
def _(spark, d):
    out = Z.measurement_events(B._t(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value"), "event", "user_id", "event_type", ("ts",), "value")
    return out.select("event_id", "patient_id", text("event_datetime"), "concept_key", "value")


@query("medication_map", "select l_orderkey as source_visit_id, 'part:' || l_partkey as concept_key, 1.0::double as value, 'record' as unit, 'prescription' as semantics from lineitem")
def _(spark, d):
    out = Z.medication_events(B._t(spark, d, "lineitem", "l_orderkey", "l_partkey"), "l_orderkey", F.concat(F.lit("part:"), F.col("l_partkey")), "prescription")
    return out.select("source_visit_id", "concept_key", "value", "unit", "semantics")


@query("procedure_map", "select l_orderkey, 'icd' || (9 + l_partkey % 2) || ':' || regexp_replace(upper(trim('a.' || l_partkey || '-x')), '[^A-Z0-9]', '', 'g') as concept_key, strftime(cast(l_shipdate as date), '%Y-%m-%d') as event_date, 'date' as prec from lineitem")
def _(spark, d):
    raw = F.concat(F.lit("a."), F.col("l_partkey"), F.lit("-x"))
    out = Z.procedure_events(B._t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_shipdate"), 9 + F.col("l_partkey") % 2, raw, "l_shipdate")
    return out.select("l_orderkey", "concept_key", F.date_format("event_date", "yyyy-MM-dd").alias("event_date"), F.col("event_time_precision").alias("prec"))


@query("diagnosis_map", "select l_orderkey, l_partkey, strftime(o_orderdate, '%Y-%m-%d') as diagnosis_date from lineitem left join orders on l_orderkey = o_orderkey")
def _(spark, d):
    rows = B._t(spark, d, "lineitem", "l_orderkey", "l_partkey")
    return Z.dated_diagnoses(rows.withColumnRenamed("l_orderkey", "visit_id"), B.encounters(spark, d)).select(F.col("visit_id").alias("l_orderkey"), "l_partkey", F.date_format("diagnosis_datetime", "yyyy-MM-dd").alias("diagnosis_date"))


@query("anchor_birth", "with {views} select patient_id, (age_anchor_year - age_anchor) || '-01-01' as birth from patients")
def _(spark, d):
    return Z.anchor_births(B.patients(spark, d)).select("patient_id", F.date_format("birth_datetime", "yyyy-MM-dd").alias("birth"))


@query("concept_metadata", f"with {{views}}, {B.EVENTS_SQL} select distinct 'items' as domain, concept_key, unit from events_ union select distinct 'events', event_type, 'value' from events")
def _(spark, d):
    other = B._t(spark, d, "events", "event_type").select(F.col("event_type").alias("concept_key"), F.lit("value").alias("unit"))
    return Z.concept_rows({"items": B.domain_events(spark, d), "events": other})


@query("concept_key_normalise", "select p_partkey, lower(trim(regexp_replace('  ' || upper(p_name) || '  X', '\\s+', ' ', 'g'))) as concept_norm from part")
def _(spark, d):
    rows = B._t(spark, d, "part", "p_partkey", "p_name").select("p_partkey", F.concat(F.lit("  "), F.upper("p_name"), F.lit("  X")).alias("key"))
    return N.normalised_keys(rows, "key").select("p_partkey", "concept_norm")


@query("feature_safe_key", "select p_partkey, case when k = '' then 'empty' else k end as k from (select p_partkey, regexp_replace(regexp_replace(lower(trim(p_name || ' #' || p_type)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') k from part)")
def _(spark, d):
    return B._t(spark, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", N.feature_safe(F.concat(F.col("p_name"), F.lit(" #"), F.col("p_type"))).alias("k"))


@query("canonicalise_floats", "select p_partkey, case when r = 0 then 0.0 else r end as v from (select p_partkey, round_even(p_retailprice - 950.0, 1) r from part)")
def _(spark, d):
    return B._t(spark, d, "part", "p_partkey", "p_retailprice").select("p_partkey", N.canonical_float(F.col("p_retailprice") - 950.0, 1).alias("v"))


# ------------------------------------------------------------------ cohort


@query("cohort_base", "with {views} select visit_id, patient_id, sex, race from base")
def _(spark, d):
    return C.base(B.encounters(spark, d), B.patients(spark, d), B.deaths(spark, d), RULES).select("visit_id", "patient_id", "sex", "race")


@query("age_anchor", "with {views} select visit_id, age from base")
def _(spark, d):
    return B.gated_base(spark, d).select("visit_id", "age")


@query("age_birth", "with {views} select visit_id, round(date_diff('second', make_timestamp(1995 - age_anchor, 1, 1, 0, 0, 0), \"start\") / (365.2425 * 86400), 6) as age from base")
def _(spark, d):
    birth = F.make_date((F.lit(1995) - F.col("age_anchor")).cast("int"), F.lit(1), F.lit(1)).cast("timestamp_ntz")
    return B.encounters(spark, d).join(B.patients(spark, d), "patient_id", "left").select("visit_id", F.round(C.age_by_birth(F.col("start"), birth), 6).alias("age"))


@query("attribute_override", "with {views} select visit_id, coalesce(case when visit_id % 4 = 0 then 'AT_VISIT' end, race) as race from base")
def _(spark, d):
    rows = C.base(B.encounters(spark, d), B.patients(spark, d), B.deaths(spark, d), RULES).withColumn("race_at_admission", F.when(F.col("visit_id") % 4 == 0, "AT_VISIT"))
    return C.override(rows, {"race": "race_at_admission"}).select("visit_id", "race")


_LEDGER = " union all ".join(f"select {i} as step_no, '{s}' as step, count(*) as visits, count(distinct patient_id) as patients from gated where {w}" for i, (s, w) in enumerate(zip(C.STEPS, ("true", "g2", "g2 and a3", "g2 and a3 and a4", "g2 and a3 and a4 and a5", "g2 and a3 and a4 and a5 and a6", "g2 and a3 and a4 and a5 and a6 and a7", "g2 and a3 and a4 and a5 and a6 and a7")), 1))


@query("cohort_attrition", "with {views} " + _LEDGER)
def cohort_attrition(spark, d):
    return C.attrition(B.gated_base(spark, d))


@query("death_join", "with {views} select visit_id, strftime(death_datetime, '%Y-%m-%d') as died from base")
def _(spark, d):
    return C.base(B.encounters(spark, d), B.patients(spark, d), B.deaths(spark, d), RULES).select("visit_id", F.date_format("death_datetime", "yyyy-MM-dd").alias("died"))


@query("death_join_by_visit", "with {views} select e.visit_id, case when e.visit_id % 3 = 0 then strftime(e.\"start\" + interval 2 day, '%Y-%m-%d') end as died from encounters e")
def _(spark, d):
    own = B.encounters(spark, d)
    deaths = own.filter("visit_id % 3 = 0").select("visit_id", "patient_id", (F.col("start") + C.days(2)).alias("death_datetime"), F.to_date(F.col("start") + C.days(2)).alias("death_date"), F.lit("datetime").alias("death_time_precision"))
    return C.base(own, B.patients(spark, d), deaths, RULES).select("visit_id", F.date_format("death_datetime", "yyyy-MM-dd").alias("died"))


@query("time_anchors", "with {views} select visit_id, strftime(landmark, '%Y-%m-%d %H:%M:%S') as landmark, strftime(horizon, '%Y-%m-%d %H:%M:%S') as horizon, strftime(predictor_end, '%Y-%m-%d %H:%M:%S') as predictor_end from base")
def _(spark, d):
    return B.gated_base(spark, d).select("visit_id", text("landmark"), text("horizon"), text("predictor_end"))


@query("outcome_label", "with {views} select visit_id, outcome, short_visit from gated")
def _(spark, d):
    return B.gated_base(spark, d).select("visit_id", "outcome", "short_visit")


@query("subsample_hash", "with {cohort} select visit_id from cohort order by sha256('7|' || visit_id), visit_id limit 100")
def _(spark, d):
    return C.hash_subsample(B.gated_base(spark, d).filter("g8"), 100, 7).select("visit_id")


@query("subsample_patient_boundary", "with {cohort} select visit_id from cohort order by sha256('7|' || patient_id), patient_id, sha256('7|' || visit_id), visit_id limit 250")
def _(spark, d):
    return C.boundary_subsample(B.gated_base(spark, d).filter("g8"), 250, 7).select("visit_id")


@query("cohort_numbering", "with {cohort} select visit_id, cohort_visit_number from cohort")
def _(spark, d):
    return B.frozen_cohort(spark, d).select("visit_id", "cohort_visit_number")


@query("prior_utilisation", "with {cohort} select c.visit_id, count(distinct e.visit_id) as prior_visits, count(distinct case when lower(e.visit_type) in ('1-urgent', '2-high', '3-medium', '4-not specified', '5-low') then e.visit_id end) as prior_acute_visits, cast(count(distinct e.visit_id) > 0 as integer) as any_prior from cohort c left join encounters e on e.patient_id = c.patient_id and e.\"start\" < c.\"start\" and e.\"start\" >= c.\"start\" - interval 365 day group by 1")
def _(spark, d):
    return C.prior_use(B.gated_base(spark, d).filter("g8"), B.encounters(spark, d), RULES)


@query("baseline_table", "with {cohort} select cohort_visit_number, visit_id, patient_id, sex, race, visit_type, round(age, 8) as age, outcome from cohort")
def _(spark, d):
    return C.baseline(B.frozen_cohort(spark, d))


@query("count_comparison", "with {views}, ledger as (" + _LEDGER + ") select step, 1000 as expected, visits as observed, abs(visits - 1000) as absolute_difference, 5000 as tolerance, abs(visits - 1000) <= 5000 as matches from ledger")
def _(spark, d):
    seen = C.attrition(B.gated_base(spark, d)).select("step", F.col("visits").alias("observed"))
    want = spark.createDataFrame([(s, 1000, 5000) for s in C.STEPS], "step string, expected long, tolerance long")
    return C.count_comparison(seen, want, ["step"])


@query("global_numbering", "select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) as n from orders")
def _(spark, d):
    return numbered(B._t(spark, d, "orders", "o_orderkey", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], "n").select("o_orderkey", "n")


# ------------------------------------------------------------------ comorbidity

_CODES = ("410.1", "428", "440.9", "290", "5722", "571", "2500", "2504", "C77", "I50.1", "145", "196")
_DX = "dx as (select l_orderkey as visit_id, case l_partkey % 12 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(_CODES)) + " end as code, case when l_partkey % 12 in (8, 9) then 10 else 9 end as icd_version from lineitem)"
_PREFIXES, _RANGES = H.spans()
_PREFIX_SQL = "(values " + ", ".join(f"({v}, '{p}', '{n}')" for v, p, n in _PREFIXES) + ") x(v, p, category)"
_RANGE_SQL = "(values " + ", ".join(f"({v}, {k}, '{a}', '{b}', '{n}')" for v, k, a, b, n in _RANGES) + ") x(v, k, lo, hi, category)"
_CLASS = f"codes as (select distinct regexp_replace(upper(trim(code)), '[^A-Z0-9]', '', 'g') as code, icd_version from dx), cls as (select distinct code, icd_version, category from codes join {_PREFIX_SQL} on v = icd_version and starts_with(code, p) union select code, icd_version, category from codes join {_RANGE_SQL} on v = icd_version and length(code) >= k and substr(code, 1, k) between lo and hi)"
_MILD = {m: s for s, m in H.SUPERSEDES}
_SCORE = " + ".join(f"{w} * max(case when category = '{n}' then 1 else 0 end)" + (f" * (1 - max(case when category = '{_MILD[n]}' then 1 else 0 end))" if n in _MILD else "") for n, w in H.WEIGHTS.items())


def _diagnoses(spark, d):
    k = F.col("l_partkey") % 12
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (k + 1).cast("int"))
    return B._t(spark, d, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("visit_id"), code.alias("code"), F.when(k.isin(8, 9), 10).otherwise(9).alias("icd_version"))


@query("code_normalise", f"with {_DX} select visit_id, regexp_replace(upper(trim(code)), '[^A-Z0-9]', '', 'g') as code from dx")
def _(spark, d):
    return _diagnoses(spark, d).select("visit_id", H.code(F.col("code")).alias("code"))


@query("code_classify", f"with {_DX}, {_CLASS} select code, icd_version, category from cls")
def _(spark, d):
    return H.classify(_diagnoses(spark, d))


@query("comorbidity_score", f"with {_DX}, {_CLASS}, j as (select visit_id, category from (select visit_id, regexp_replace(upper(trim(code)), '[^A-Z0-9]', '', 'g') as code, icd_version from dx) join cls using (code, icd_version)) select visit_id, cast({_SCORE} as bigint) as score from j group by 1")
def _(spark, d):
    return H.score(H.with_categories(_diagnoses(spark, d)).select("visit_id", "category").distinct(), "visit_id")


@query("prior_comorbidity", f"with {{cohort}}, {_DX}, {_CLASS}, j as (select c.visit_id, category from cohort c join encounters e on e.patient_id = c.patient_id and e.\"start\" < c.\"start\" and e.\"start\" >= c.\"start\" - interval 365 day join (select visit_id as v, regexp_replace(upper(trim(code)), '[^A-Z0-9]', '', 'g') as code, icd_version from dx) on v = e.visit_id join cls using (code, icd_version)), s as (select visit_id, cast({_SCORE} as bigint) as score from j group by 1) select c.visit_id, coalesce(s.score, 0) as score from cohort c left join s using (visit_id)")
def _(spark, d):
    return H.prior_score(B.gated_base(spark, d).filter("g8"), B.encounters(spark, d), _diagnoses(spark, d).distinct(), RULES)


@query("prior_comorbidity_acute", f"with {{cohort}}, {_DX}, {_CLASS}, j as (select c.visit_id, category from cohort c join encounters e on e.patient_id = c.patient_id and e.\"start\" < c.\"start\" and e.\"start\" >= c.\"start\" - interval 365 day and lower(e.visit_type) in ('1-urgent', '2-high') join (select visit_id as v, regexp_replace(upper(trim(code)), '[^A-Z0-9]', '', 'g') as code, icd_version from dx) on v = e.visit_id join cls using (code, icd_version)), s as (select visit_id, cast({_SCORE} as bigint) as score from j group by 1) select c.visit_id, coalesce(s.score, 0) as score from cohort c left join s using (visit_id)")
def _(spark, d):
    return H.prior_score(B.gated_base(spark, d).filter("g8"), B.encounters(spark, d), _diagnoses(spark, d).distinct(), URGENT)


@query("diagnosis_extract", f"with {{cohort}}, {_DX} select distinct d.visit_id, d.code from dx d join encounters e using (visit_id) where exists (select 1 from cohort c where c.patient_id = e.patient_id and e.\"start\" < c.\"start\" and e.\"start\" >= c.\"start\" - interval 365 day)")
def _(spark, d):
    dated = Z.dated_diagnoses(_diagnoses(spark, d).distinct(), B.encounters(spark, d))
    dated = dated.join(B.encounters(spark, d).select("visit_id", "patient_id"), "visit_id")
    return X.prior_diagnoses(dated, B.gated_base(spark, d).filter("g8")).select("visit_id", "code").distinct()


@query("cohort_count_gate", "with {cohort} select 'visits' as what, count(*) as expected, count(*) as observed, 0 as absolute_difference, 0 as tolerance, true as matches from cohort union all select 'patients', count(distinct patient_id), count(distinct patient_id), 0, 0, true from cohort")
def _(spark, d):
    """The ledger's last step against the numbered cohort itself; the query fails where they differ."""
    final = C.attrition(B.gated_base(spark, d)).filter("step = 'final'")
    seen = final.select(F.explode(F.array(F.struct(F.lit("visits").alias("what"), F.col("visits").alias("observed")), F.struct(F.lit("patients").alias("what"), F.col("patients").alias("observed")))).alias("x")).select("x.*")
    own = B.frozen_cohort(spark, d).agg(F.max("cohort_visit_number").alias("v"), F.count_distinct("patient_id").alias("p"))
    want = own.select(F.explode(F.array(F.struct(F.lit("visits").alias("what"), F.col("v").alias("expected")), F.struct(F.lit("patients").alias("what"), F.col("p").alias("expected")))).alias("x")).select("x.*", F.lit(0).cast("long").alias("tolerance"))
    return C.require_counts(seen, want, ["what"])


@query("strict_booleans", "select o_orderkey, o_orderkey % 3 = 0 as flag from orders")
def _(spark, d):
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.when(F.col("o_orderkey") % 2 == 0, " TRUE ").otherwise("1")).otherwise(F.when(F.col("o_orderkey") % 2 == 0, "False").otherwise("0"))
    return B._t(spark, d, "orders", "o_orderkey").select("o_orderkey", A.strict_boolean(raw).alias("flag"))


@query("canonical_records", "select '{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":' || case when c_custkey % 5 = 0 then 'null' else '\"' || c_mktsegment || '\"' end || '}' as record from customer")
def _(spark, d):
    rows = B._t(spark, d, "customer", "c_custkey", "c_mktsegment").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    return rows.select(A.canonical_json("c_mktsegment", "c_custkey").alias("record"))
