"""Queries of linkage, folds, concepts, features, selection, audits and generic relational operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.functions import normalise as N
from tidewater.operators import audit as A
from tidewater.operators import cohort as C
from tidewater.operators import features as X
from tidewater.operators import linkage as L
from tidewater.operators import verify as V
from tidewater.operators.numbering import numbered
from tidewater.plans import bindings as B
from tidewater.plans.bindings import EVENTS_SQL, query
from tidewater.sources.shared import frozen, shared_dir

# ------------------------------------------------------------------ linkage

_LINK = f"""with {{cohort}}, {EVENTS_SQL},
itv as (select event_id, count(*) as candidates, case when count(*) = 1 then min(c.visit_id) end as tv from (select * from events_ where source_visit_id is null and bridge_key is null) e join cohort c on e.patient_id = c.patient_id and event_datetime >= c."start" and event_datetime < c.predictor_end group by 1),
l0 as (select e.*, b.visit_id as bv, coalesce(e.source_visit_id, b.visit_id) as named, c.visit_id as cv, c.patient_id as cp, candidates, tv from events_ e left join bridge b on e.bridge_key = b.bridge_key left join cohort c on c.visit_id = coalesce(e.source_visit_id, b.visit_id) left join itv using (event_id)),
linked as (select *, case when cv is not null and cp != patient_id then null when source_visit_id is not null and cv is not null then 'direct_visit' when source_visit_id is null and bridge_key is not null and cv is not null then 'bridge' when source_visit_id is null and bridge_key is null and tv is not null then 'patient_time' end as linkage_strategy,
 case when cv is not null and cp != patient_id then 'patient_mismatch' when source_visit_id is not null and cv is null then 'visit_not_in_cohort' when source_visit_id is null and bridge_key is not null and bv is null then 'bridge_unmatched' when source_visit_id is null and bridge_key is not null and cv is null then 'bridge_visit_not_in_cohort' when source_visit_id is null and bridge_key is null and candidates > 1 then 'ambiguous' when source_visit_id is null and bridge_key is null and tv is null then 'no_interval' end as reason from l0),
lv as (select *, case when linkage_strategy = 'patient_time' then tv when linkage_strategy is not null then named end as linked_visit from linked),
q as (select lv.*, c."start" as vs, date_diff('microsecond', c."start", event_datetime) / 3.6e9 as hours_from_start, c.outcome, cast(('0x' || substr(md5('42|' || c.patient_id), 1, 8)) as bigint) % 5 + 1 as fold from lv join cohort c on c.visit_id = lv.linked_visit where event_datetime >= c."start" and event_datetime < c.predictor_end)"""


def _cohort(spark, d):
    return B.gated_base(spark, d).filter("g8")


#: Buckets of days by which events without a visit meet windows.
DAYS = max(1, B.RULES.window_hours // 24 // 8)


def _visits(spark, d):
    """(visit_id, patient_id, start, predictor_end, outcome, fold) of the cohort, written once: events meet it in three ways."""
    return frozen(_cohort(spark, d).select("visit_id", "patient_id", "start", "predictor_end", "outcome", B.fold_of(F.col("patient_id")).alias("fold")), "visits")


def _linked(spark, d):
    return L.link(B.domain_events(spark, d), _visits(spark, d), B.encounters(spark, d), B.bridge(spark, d), strict=True, days=DAYS)


def _in_window(spark, d, own):
    """Qualifying events with the columns of ``own``; parts' concepts join the few rows that are left."""
    return B.with_concepts(spark, d, L.qualifying(B.domain_events(spark, d, concepts=False), own, B.bridge(spark, d), strict=True, days=DAYS))


def _qualified(spark, d, own=None):
    """Qualifying events as (event_id, visit_id, fold, outcome, concept_key, value, unit, hours_from_start)."""
    q = _in_window(spark, d, own or _visits(spark, d))
    return q.select("event_id", F.col("linked_visit").alias("visit_id"), "fold", "outcome", "concept_key", "value", "unit", "hours_from_start")


def _kept(spark, d, *columns):
    """Columns of qualifying events for queries that read them more than once: events are linked once."""
    return frozen(_qualified(spark, d).select(*columns), "qualifying")


@query("event_linkage", _LINK + " select event_id, linkage_strategy, reason, linked_visit from lv")
def event_linkage(spark, d):
    return _linked(spark, d).select("event_id", "linkage_strategy", "reason", "linked_visit")


@query("linkage_evidence", _LINK + " select event_id, linkage_strategy, linked_visit, concept_key from lv where linked_visit is not null")
def _(spark, d):
    return _linked(spark, d).filter("linked_visit is not null").select("event_id", "linkage_strategy", "linked_visit", "concept_key")


@query("linkage_audit", _LINK + " select coalesce('linked_' || linkage_strategy, 'unmatched_' || reason) as measure, count(*) as n from lv group by 1 union all select 'source', count(*) from lv union all select 'outside_window', (select count(*) from lv where linked_visit is not null) - (select count(*) from q) union all select 'qualifying', count(*) from q")
def _(spark, d):
    return L.audit(_linked(spark, d))


@query("window_qualify", _LINK + " select event_id, linked_visit from q")
def _(spark, d):
    return _in_window(spark, d, _visits(spark, d)).select("event_id", "linked_visit")


@query("hours_from_start", _LINK + " select event_id, round(hours_from_start, 6) as hours from q")
def _(spark, d):
    return _in_window(spark, d, _visits(spark, d)).select("event_id", F.round("hours_from_start", 6).alias("hours"))


_DATED = _LINK.split("q as (select lv")[0] + """lp as (select lv.*, case when l_linenumber % 3 = 0 then 'date' else 'datetime' end as prec from lv join (select distinct concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, cast(l_quantity as bigint), cast(round(l_extendedprice * 100) as bigint), strftime(l_shipdate, '%Y%m%d')) as event_id, l_linenumber from lineitem) using (event_id)),
q as (select lp.*, case when prec = 'datetime' then date_diff('microsecond', c."start", event_datetime) / 3.6e9 end as hours from lp join cohort c on c.visit_id = lp.linked_visit
 where (prec = 'datetime' and event_datetime >= c."start" and event_datetime < c.predictor_end) or (prec = 'date' and linkage_strategy != 'patient_time' and cast(event_datetime as date) >= cast(c."start" as date) and cast(event_datetime as date) <= cast(c."start" + interval 2160 hour as date)))"""


@query("window_qualify_dates", _DATED + " select event_id, linked_visit, prec as event_time_precision, round(hours, 6) as hours from q")
def _(spark, d):
    """Every third line has its day alone: it links by visit or bridge, never by time, and its window does not end with the visit."""
    e = B.domain_events(spark, d, concepts=False)
    dated = F.element_at(F.split("event_id", r"\|"), 4).cast("long") % 3 == 0
    e = e.withColumn("event_time_precision", F.when(dated, "date").otherwise("datetime")).withColumn("event_date", F.to_date("event_datetime"))
    q = L.qualifying(e, _visits(spark, d), B.bridge(spark, d), True, DAYS, B.RULES.window_hours, "procedures")
    return B.with_concepts(spark, d, q).select("event_id", "linked_visit", "event_time_precision", F.round("hours_from_start", 6).alias("hours"))


_B = "with v as (select user_id as patient_id, event_id as visit_id, ts as s, ts + interval 24 hour as e from events where event_type = 'signup'), x as (select e.event_id, count(*) as candidates, case when count(*) = 1 then min(visit_id) end as visit_id from events e join v on e.user_id = v.patient_id and e.ts >= v.s and e.ts < v.e where e.event_type != 'signup' group by 1)"


def _by_hours(spark, d):
    e = B._t(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    visits = e.filter("event_type = 'signup'").select(F.col("user_id").alias("patient_id"), F.col("event_id").alias("visit_id"), F.col("ts").alias("start"), (F.col("ts") + F.expr("make_dt_interval(1)")).alias("predictor_end"))
    return L.interval_link(e.filter("event_type != 'signup'").select("event_id", F.col("user_id").alias("patient_id"), F.col("ts").alias("event_datetime")), visits)


@query("interval_link", _B + " select event_id, candidates, visit_id from x")
def _(spark, d):
    return _by_hours(spark, d)


@query("ambiguous_links", _B + " select event_id, 'ambiguous' as reason, candidates from x where candidates > 1")
def _(spark, d):
    return _by_hours(spark, d).filter("candidates > 1").select("event_id", F.lit("ambiguous").alias("reason"), "candidates")


@query("semantics_violations", "select l_returnflag as semantics, count(*) as n from lineitem where l_returnflag not in ('A', 'R') group by 1")
def _(spark, d):
    return A.not_allowed(B._t(spark, d, "lineitem", "l_returnflag").select(F.col("l_returnflag").alias("semantics")), "semantics", ["A", "R"])


@query("semantics_allowed", "select l_returnflag as semantics, count(*) as n from lineitem group by 1")
def _(spark, d):
    rows = A.require_allowed(B._t(spark, d, "lineitem", "l_returnflag"), "l_returnflag", ["A", "N", "R"])
    return rows.groupBy(F.col("l_returnflag").alias("semantics")).agg(F.count(F.lit(1)).alias("n"))


@query("join_many_to_one", "select l_orderkey, l_linenumber, o_orderpriority from lineitem left join orders on l_orderkey = o_orderkey")
def _(spark, d):
    o = B._t(spark, d, "orders", "o_orderkey", "o_orderpriority").withColumnRenamed("o_orderkey", "l_orderkey")
    return A.join_checked(B._t(spark, d, "lineitem", "l_orderkey", "l_linenumber"), o, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "o_orderpriority")


@query("reconcile_full_outer", "with a as (select distinct o_custkey k from orders where o_orderstatus = 'F'), b as (select distinct c_custkey k from customer where c_acctbal > 0) select coalesce(a.k, b.k) as k, case when a.k is null then 'right_only' when b.k is null then 'left_only' else 'both' end as merge from a full join b on a.k = b.k")
def _(spark, d):
    a = B._t(spark, d, "orders", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k"))
    return A.reconcile(a, B._t(spark, d, "customer", "c_custkey", "c_acctbal").filter("c_acctbal > 0").select(F.col("c_custkey").alias("k")), ["k"])


@query("semi_join", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')")
def _(spark, d):
    o = B._t(spark, d, "orders", "o_custkey", "o_orderpriority").filter("o_orderpriority = '1-URGENT'")
    return B._t(spark, d, "customer", "c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi")


# ------------------------------------------------------------------ folds

_PF = "pf as (select patient_id, cast(floor((row_number() over (order by sha256('42|' || patient_id), patient_id) - 1) * 5 / count(*) over ()) as bigint) + 1 as fold from (select distinct patient_id from cohort))"


@query("patient_folds", "with {cohort}, " + _PF + " select patient_id, fold from pf")
def _(spark, d):
    return X.patient_folds(_cohort(spark, d), 5, 42)


@query("stratified_group_folds", "with {cohort}, p as (select patient_id, least(count(*), 5) as v, least(sum(outcome), 2) as o from cohort group by 1) select patient_id, (row_number() over (partition by v, o order by sha256('42|' || patient_id), patient_id) - 1) % 5 + 1 as fold from p")
def _(spark, d):
    return X.stratified_folds(_cohort(spark, d), 5, 42)


@query("fold_summary", "with {cohort}, " + _PF + " select fold, count(*) as visits, count(distinct patient_id) as patients, cast(sum(outcome) as bigint) as events from cohort join pf using (patient_id) group by 1")
def _(spark, d):
    own = _cohort(spark, d)
    return X.fold_summary(own, X.patient_folds(own, 5, 42)).withColumnRenamed("outcomes", "events")


@query("fold_checks", "with {cohort}, " + _PF + " select 'unassigned' as \"check\", count(*) as n from cohort left join pf using (patient_id) where fold is null union all select 'split_patients', count(*) from (select patient_id from pf group by 1 having count(distinct fold) > 1) union all select 'one_class_folds', count(*) from (select fold from cohort join pf using (patient_id) group by 1 having count(distinct outcome) < 2)")
def _(spark, d):
    own = _cohort(spark, d)
    return X.fold_checks(own, X.patient_folds(own, 5, 42)).select(F.col("check"), F.col("failures").alias("n"))


@query("fold_overlap", "with {scores} select a.fold, count(*) as shared from (select distinct fold, patient_id from identity) a join (select distinct fold, patient_id from identity) b on a.patient_id = b.patient_id and a.fold != b.fold group by 1")
def _(spark, d):
    i = B.identity(spark, d).select("fold", "patient_id").distinct()
    many = i.groupBy("patient_id").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    return i.join(many, "patient_id").groupBy("fold").agg(F.sum(F.col("f") - 1).alias("shared"))


# ------------------------------------------------------------------ concepts


@query("unit_convert", _LINK + " select event_id, case unit when 'R' then value * 2.0 + 1.0 when 'A' then value end as value, case when unit in ('R', 'A') then 'A' end as unit from q")
def _(spark, d):
    q = X.confirmed_units(_qualified(spark, d), [("", "R", 2.0, 1.0)], default=("A",))
    return q.select("event_id", "value", F.when(F.col("unit_status") != "invalid", "A").alias("unit"))


_MODE = ", f as (select distinct fold from q), mu as (select fold, concept_key, unit from (select f.fold, concept_key, unit, row_number() over (partition by f.fold, concept_key order by count(*) desc, unit) as r from q join f on q.fold != f.fold group by f.fold, concept_key, unit) where r = 1)"


@query("unit_modal", _LINK + _MODE + " select fold, concept_key, unit from mu")
def _(spark, d):
    return X.modal_units(_kept(spark, d, "concept_key", "unit", "fold"))


@query("unit_audit", _LINK + _MODE + " select mu.fold, q.unit, count(*) as excluded from mu join q on q.concept_key = mu.concept_key and q.fold != mu.fold where q.unit != mu.unit group by all")
def _(spark, d):
    q = _kept(spark, d, "concept_key", "unit", "fold")
    return X.unit_exclusions(q, X.modal_units(q))


_PREV = ", f as (select distinct fold from q), pv as (select f.fold, concept_key, count(distinct linked_visit) as visits from q join f on q.fold != f.fold group by 1, 2)"


@query("concept_prevalence", _LINK + _PREV + " select fold, concept_key, visits from pv")
def _(spark, d):
    return X.training_counts(_kept(spark, d, "concept_key", "fold", "visit_id"), ["concept_key"])


_TOP = _PREV + ", tk as (select *, row_number() over (partition by fold order by visits desc, lower(trim(concept_key))) as rank from pv)"


def _top(events, n=50):
    return X.top_per(X.training_counts(events, ["concept_key"]), ["fold"], [F.desc("visits"), N.concept_key(F.col("concept_key"))], n)


def _topk(spark, d, n=50):
    return _top(_kept(spark, d, "concept_key", "fold", "visit_id"), n)


@query("concept_topk", _LINK + _TOP + " select fold, concept_key, visits, rank from tk where rank <= 50")
def _(spark, d):
    return _topk(spark, d)


@query("concept_metadata_agg", _LINK + " select concept_key, string_agg(distinct unit, '|' order by unit) as units, count(*) as rows from q group by 1")
def _(spark, d):
    return _qualified(spark, d).groupBy("concept_key").agg(F.array_join(F.array_sort(F.collect_set("unit")), "|").alias("units"), F.count(F.lit(1)).alias("rows"))


@query("concept_collisions", "select lower(trim(p_name)) as k, count(distinct p_name || p_type) as n from part group by 1 having count(distinct p_name || p_type) > 1")
def _(spark, d):
    rows = B._t(spark, d, "part", "p_name", "p_type").select(N.concept_key(F.col("p_name")).alias("k"), F.concat("p_name", "p_type").alias("raw"))
    return X.key_collisions(rows, "raw", "k")


@query("concept_details", "select p_brand as concept_key, min(p_name) as concept_name, 'part' as sources, '' as semantics, string_agg(distinct p_type, '|' order by p_type) as units from part group by 1")
def _(spark, d):
    rows = B._t(spark, d, "part", "p_brand", "p_name", "p_type").select(F.col("p_brand").alias("concept_key"), F.col("p_name").alias("concept_name"), F.lit("part").alias("source_table"), F.col("p_type").alias("unit"))
    return X.concept_metadata(rows)


@query("selection_frequency", _LINK + _TOP + " select concept_key, count(distinct fold) as folds, round(avg(visits), 6) as mean_prevalence from tk where rank <= 50 group by 1")
def _(spark, d):
    return X.selection_frequency(_topk(spark, d).withColumnRenamed("visits", "prevalence")).withColumn("mean_prevalence", F.round("mean_prevalence", 6))


@query("selection_counts", _LINK + _TOP + " select fold, count(*) as observed, 50 as expected, count(*) = 50 as matches from tk where rank <= 50 group by 1")
def _(spark, d):
    return _topk(spark, d).groupBy("fold").agg(F.count(F.lit(1)).alias("observed")).select("fold", "observed", F.lit(50).cast("long").alias("expected"), (F.col("observed") == 50).alias("matches"))


@query("selection_gate", _LINK + _TOP + " select fold, count(*) as kept from tk where rank <= 20 group by 1")
def _(spark, d):
    """The query fails if a fold has fewer than 20 ranked concepts."""
    return X.require_ranked(_topk(spark, d, 20), ["fold"], 20).groupBy("fold").agg(F.count(F.lit(1)).alias("kept"))


# ------------------------------------------------------------------ features

CONCEPTS = [f"Brand#{i}-ECONOMY" for i in range(1, 6)]


def _n(c):
    return c.replace("#", "").replace("-", "_").lower()


def _named(df):
    return df.select(*[F.col(f"`{c}`").alias(_n(c)) for c in df.columns])


_MEAS = ", ".join(f"round_even(avg(value) filter (concept_key = '{c}'), 6) as {_n(c)}_mean, max(value) filter (concept_key = '{c}') as {_n(c)}_max, min(value) filter (concept_key = '{c}') as {_n(c)}_min, round_even(coalesce(stddev_samp(value) filter (concept_key = '{c}'), case when count(*) filter (concept_key = '{c}') > 0 then 0.0 end), 6) as {_n(c)}_sd, count(*) filter (concept_key = '{c}') as {_n(c)}_count, cast(count(*) filter (concept_key = '{c}') = 0 as integer) as {_n(c)}_missing" for c in CONCEPTS)


@query("measurement_features", _LINK + f" select c.visit_id, {_MEAS} from cohort c left join q on q.linked_visit = c.visit_id group by 1")
def measurement_features(spark, d):
    own = _visits(spark, d)
    events = _qualified(spark, d, own).withColumn("concept_key", F.lower(F.translate("concept_key", "#", ""))).withColumn("concept_key", F.translate("concept_key", "-", "_"))
    wide = X.measurements(events, own, [_n(c) for c in CONCEPTS])
    return wide.select(*[F.bround(c, 6).alias(c) if c.endswith(("_mean", "_sd")) else F.col(c) for c in wide.columns])


_EXPO = ", ".join(f"count(*) filter (concept_key = '{c}') as {_n(c)}_count, cast(count(*) filter (concept_key = '{c}') > 0 as integer) as {_n(c)}_exposure" for c in CONCEPTS)


@query("exposure_features", _LINK + f" select c.visit_id, {_EXPO} from cohort c left join q on q.linked_visit = c.visit_id group by 1")
def _(spark, d):
    own = _visits(spark, d)
    return _named(X.exposures(_qualified(spark, d, own), own, CONCEPTS))


def _top_cells(spark, d, aggs):
    """(fold, visit_id, concept_key, rank, aggs): every visit of the cohort with each of the 50 concepts of each training fold."""
    own = _visits(spark, d)
    events = frozen(_qualified(spark, d, own).select("visit_id", "fold", "concept_key", "value"), "qualifying")
    return X.top_cells(events, own, _top(events, 50).select("fold", "concept_key", "rank"), aggs)


_CELLS = _TOP + ", per as (select linked_visit, concept_key, {aggs} from q group by 1, 2), cells as (select tk.fold, c.visit_id, tk.concept_key, tk.rank, per.* exclude (linked_visit, concept_key) from cohort c cross join (select * from tk where rank <= 50) tk left join per on per.linked_visit = c.visit_id and per.concept_key = tk.concept_key)"


@query("measurement_features_top", _LINK + _CELLS.replace("{aggs}", "round_even(avg(value), 6) as mean, max(value) as max, min(value) as min, round_even(coalesce(stddev_samp(value), case when count(value) > 0 then 0.0 end), 6) as sd, count(value) as n") + " select fold, visit_id, concept_key, rank, mean, max, min, sd, coalesce(n, 0) as count, cast(coalesce(n, 0) = 0 as integer) as missing from cells")
def _(spark, d):
    sd = F.coalesce(F.stddev_samp("value"), F.when(F.count("value") > 0, 0.0))
    cells = _top_cells(spark, d, [F.bround(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"), F.bround(sd, 6).alias("sd"), F.count("value").alias("n")])
    n = F.coalesce("n", F.lit(0))
    return cells.select("fold", "visit_id", "concept_key", "rank", "mean", "max", "min", "sd", n.alias("count"), (n == 0).cast("int").alias("missing"))


@query("exposure_features_top", _LINK + _CELLS.replace("{aggs}", "count(*) as n") + " select fold, visit_id, concept_key, rank, coalesce(n, 0) as count, cast(coalesce(n, 0) > 0 as integer) as exposure from cells")
def _(spark, d):
    n = F.coalesce("n", F.lit(0))
    return _top_cells(spark, d, [F.count(F.lit(1)).alias("n")]).select("fold", "visit_id", "concept_key", "rank", n.alias("count"), (n > 0).cast("int").alias("exposure"))


_AGG = "cast(count(q.event_id) > 0 as integer) as any_event, count(distinct concept_key) as unique_concepts, count(q.event_id) as total_events, count(q.event_id) - count(distinct concept_key) as repeat_events, round(min(hours_from_start), 6) as first_hours"


@query("visit_event_aggregates", _LINK + f" select c.visit_id, {_AGG} from cohort c left join q on q.linked_visit = c.visit_id group by 1")
def _(spark, d):
    own = _visits(spark, d)
    return X.visit_aggregates(_qualified(spark, d, own), own).withColumn("first_hours", F.round("first_hours", 6))


# long features of a visit: four discrete columns and one with nulls
_LF = f""", wide as (select c.visit_id, any_value(c.outcome) as outcome, any_value(cast(('0x' || substr(md5('42|' || c.patient_id), 1, 8)) as bigint) % 5 + 1) as fold, count(q.event_id) as total__count, cast(count(q.event_id) > 0 as integer) as any__exposure, cast(count(q.event_id) = 0 as integer) as any__missing, round(avg(value), 4) as value__mean, least(count(distinct concept_key), 3) as unique__count from cohort c left join q on q.linked_visit = c.visit_id group by 1),
lf as (select visit_id, outcome, fold, unnest(['total__count', 'any__exposure', 'any__missing', 'value__mean', 'unique__count', 'constant']) as feature, unnest([cast(total__count as double), any__exposure, any__missing, value__mean, unique__count, 1.0]) as value from wide)"""


def _long(spark, d):
    own = _visits(spark, d)
    per = _qualified(spark, d, own).groupBy("visit_id").agg(F.count(F.lit(1)).alias("t"), F.round(F.avg("value"), 4).alias("m"), F.count_distinct("concept_key").alias("u"))
    df = own.select("visit_id", "outcome", "fold").join(per, "visit_id", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    df = frozen(df, "per-visit")  # before it becomes six rows a visit
    cells = {"total__count": F.col("t"), "any__exposure": (F.col("t") > 0).cast("int"), "any__missing": (F.col("t") == 0).cast("int"), "value__mean": F.col("m"), "unique__count": F.least(F.coalesce("u", F.lit(0)), F.lit(3)), "constant": F.lit(1.0)}
    return df.select("visit_id", "outcome", "fold", F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), v.cast("double").alias("value")) for k, v in cells.items()])).alias("x")).select("visit_id", "outcome", "fold", "x.*")


_SAID = "case when feature like '%missing' then value = 0 when feature like '%count' or feature like '%exposure' then value > 0 else value is not null end"
_SUP = f", f as (select distinct fold from lf), sup as (select f.fold, feature, count(*) filter ({_SAID}) as support, count(*) as total from lf join f on lf.fold != f.fold group by 1, 2)"


@query("derived_support", _LINK + _LF + _SUP + " select fold, feature, support, total from sup")
def _(spark, d):
    return X.support(_long(spark, d))


@query("derived_topk_support", _LINK + _LF + _SUP + " select fold, feature, rank from (select *, row_number() over (partition by fold order by support / total desc, feature) as rank from sup) where rank <= 3")
def _(spark, d):
    return X.top_per(X.support(_long(spark, d)), ["fold"], [F.desc(F.col("support") / F.col("total")), F.col("feature")], 3).select("fold", "feature", "rank")


@query("derived_eligibility", _LINK + _LF + " select feature, case when count(value) = 0 then 'no_values' when min(value) = max(value) then 'zero_variance' when count(*) filter (value > 0) < 50 then 'low_support' else 'eligible' end as reason from lf group by 1")
def _(spark, d):
    return X.eligibility(_long(spark, d), 50)


@query("median_impute", _LINK + _LF + ", f as (select distinct fold as fo from lf), md as (select fo as fold, feature, median(value) as med from lf join f on lf.fold != fo group by 1, 2) select visit_id, feature, round(coalesce(value, med), 6) as value from lf join md using (fold, feature)")
def _(spark, d):
    return X.median_impute(_long(spark, d)).select("visit_id", "feature", F.round("value", 6).alias("value"))


@query("mutual_information", _LINK + _LF + ", cell as (select feature, value, outcome, count(*) as n from lf where feature != 'value__mean' group by all), w as (select *, sum(n) over (partition by feature) as t, sum(n) over (partition by feature, value) as a, sum(n) over (partition by feature, outcome) as b from cell) select feature, round(sum(n / t * ln(n * t / (a * b))), 6) as mi from w group by 1")
def _(spark, d):
    return X.mutual_information(_long(spark, d).filter("feature != 'value__mean'")).select("feature", F.round("mi", 6).alias("mi"))


@query("information_ranking", _LINK + _LF + """, f as (select distinct fold as fo from lf), md as (select fo, feature, median(value) as med from lf join f on lf.fold != fo group by 1, 2),
tr as (select f.fo, lf.feature, coalesce(value, med) as value, outcome from lf join f on lf.fold != f.fo join md on md.fo = f.fo and md.feature = lf.feature),
bn as (select fo, feature, outcome, case when feature in ('value__mean', 'constant') then floor((rank() over (partition by fo, feature order by value) - 1) * 10 / count(*) over (partition by fo, feature)) else value end as b from tr),
cell as (select fo, feature, b, outcome, count(*) as n from bn group by all),
w as (select *, sum(n) over (partition by fo, feature) as t, sum(n) over (partition by fo, feature, b) as x, sum(n) over (partition by fo, feature, outcome) as y from cell),
mi as (select fo as fold, feature, round(sum(n / t * ln(n * t / (x * y))), 10) as mi from w group by 1, 2)
select fold, feature, round(mi, 6) as mi, rank from (select *, row_number() over (partition by fold order by mi desc, feature) as rank from mi) where rank <= 4""")
def _(spark, d):
    return X.information_ranking(_long(spark, d), keep=4).select("fold", "feature", F.round("mi", 6).alias("mi"), "rank")


@query("feature_dictionary", _LINK + _LF + " select distinct feature, coalesce(nullif(split_part(feature, '__', 1), ''), feature) as concept, nullif(split_part(feature, '__', 2), '') as summary from lf")
def _(spark, d):
    parts = F.split("feature", "__")
    return _long(spark, d).select("feature").distinct().select("feature", parts[0].alias("concept"), F.get(parts, 1).alias("summary"))


@query("selection_audit", _LINK + _TOP + ", s as (select concept_key, string_agg(cast(fold as varchar), '|' order by fold) as folds, min(rank) as best from tk where rank <= 50 group by 1) select concept_key, folds, best from s")
def _(spark, d):
    return _topk(spark, d).groupBy("concept_key").agg(F.array_join(F.array_sort(F.collect_list(F.col("fold").cast("string"))), "|").alias("folds"), F.min("rank").alias("best"))


@query("matrix_assemble", _LINK + f", agg as (select c.visit_id, {_AGG} from cohort c left join q on q.linked_visit = c.visit_id group by 1) select visit_id, sex, age, total_events, unique_concepts from cohort join agg using (visit_id)")
def _(spark, d):
    own = _cohort(spark, d)
    visits = _visits(spark, d)
    part = X.visit_aggregates(_qualified(spark, d, visits), visits).select("visit_id", "total_events", "unique_concepts")
    out = X.assemble(own.select("visit_id", "sex", "age"), [part], "visit_id")
    X.screen(out.drop("visit_id"))
    return out


# ------------------------------------------------------------------ preprocessing


@query("impute_apply", "select l_orderkey, l_partkey, round(coalesce(case when l_linenumber % 3 != 0 then l_quantity end, (select median(l_quantity) from lineitem where l_linenumber % 3 != 0)), 6) as q from lineitem")
def _(spark, d):
    df = B._t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_linenumber").withColumn("x", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity")))
    return df.crossJoin(F.broadcast(df.agg(F.median("x").alias("med")))).select("l_orderkey", "l_partkey", F.round(F.coalesce("x", "med"), 6).alias("q"))


@query("one_hot", "select o_orderkey, cast(p = '1-URGENT' as integer) as h_1, cast(p = '2-HIGH' as integer) as h_2, cast(p = '__MISSING__' as integer) as h_missing from (select o_orderkey, coalesce(case when o_orderkey % 7 != 0 then o_orderpriority end, '__MISSING__') as p from orders)")
def _(spark, d):
    p = F.coalesce(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")), F.lit("__MISSING__"))
    known = (("h_1", "1-URGENT"), ("h_2", "2-HIGH"), ("h_missing", "__MISSING__"))
    return B._t(spark, d, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", *[(p == v).cast("int").alias(n) for n, v in known])


@query("variance_filter", _LINK + _LF + " select feature from lf group by 1 having coalesce(var_pop(value), 0) > 0")
def _(spark, d):
    return _long(spark, d).groupBy("feature").agg(F.var_pop("value").alias("v")).filter("coalesce(v, 0) > 0").select("feature")


@query("standardise", "select l_orderkey, l_partkey, round((l_quantity - m) / s, 6) as z from lineitem, (select avg(l_quantity) as m, stddev_pop(l_quantity) as s from lineitem)")
def _(spark, d):
    df = B._t(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    return df.crossJoin(F.broadcast(df.agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s")))).select("l_orderkey", "l_partkey", F.round((F.col("l_quantity") - F.col("m")) / F.col("s"), 6).alias("z"))


@query("preprocessing_params", _LINK + _LF + " select feature, round(median(value), 6) as median, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as scale, count(value) as support from lf group by 1")
def _(spark, d):
    return _long(spark, d).groupBy("feature").agg(F.round(F.median("value"), 6).alias("median"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("scale"), F.count("value").alias("support"))


_DIG = "count(*) as row_count, cast(coalesce(sum(cast(('0x' || substr(sha256({row}), 1, 15)) as bigint)), 0) as varchar) as digest"


@query("partition_digest", "with {scores} select fold, " + _DIG.replace("{row}", "'n=' || n || '|patient_id=' || patient_id") + " from identity group by 1")
def _(spark, d):
    i = B.identity(spark, d)
    return A.partition_digests(i, ["fold"], ["n", "patient_id"])


@query("partition_frozen", "with {scores} select fold, " + _DIG.replace("{row}", "'n=' || n || '|patient_id=' || patient_id") + " from identity group by 1")
def _(spark, d):
    kept = frozen(B.identity(spark, d), "identity")
    return A.require_equal_digests(A.partition_digests(B.identity(spark, d), ["fold"], ["n", "patient_id"]), A.partition_digests(kept, ["fold"], ["n", "patient_id"]), ["fold"])


# ------------------------------------------------------------------ audits


@query("constraint_violations", "select 'positive_quantity' as \"constraint\", count(*) filter (not l_quantity > 10) as violations from lineitem union all select 'known_flag', count(*) filter (l_returnflag not in ('A', 'N')) from lineitem")
def _(spark, d):
    return A.violations(B._t(spark, d, "lineitem", "l_quantity", "l_returnflag"), {"positive_quantity": F.col("l_quantity") > 10, "known_flag": F.col("l_returnflag").isin("A", "N")})


@query("event_counts", _LINK + " select 'source' as stage, count(*) as observed from events_ union all select 'linked', count(*) from lv where linked_visit is not null union all select 'qualifying', count(*) from q")
def _(spark, d):
    return L.stage_counts(_linked(spark, d))


@query("event_count_gate", _LINK + " select 'source' as stage, (select count(*) from events_) as expected, count(*) as observed, 0 as absolute_difference, 0 as tolerance, true as matches from lv")
def _(spark, d):
    """What linkage keeps of the source rows, all of them, against the source itself; the query fails where they differ."""
    seen = L.stage_counts(_linked(spark, d)).filter("stage = 'source'")
    want = B.domain_events(spark, d).agg(F.count(F.lit(1)).alias("expected")).select(F.lit("source").alias("stage"), "expected", F.lit(0).cast("long").alias("tolerance"))
    return C.require_counts(seen, want, ["stage"])


@query("table_digest", "select " + _DIG.replace("{row}", "'o_custkey=' || o_custkey || '|o_orderkey=' || o_orderkey || '|o_orderpriority=' || o_orderpriority") + " from orders")
def _(spark, d):
    return A.plain_digest(B._t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority"))


@query("content_digest", "select " + _DIG.replace("{row}", "'{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderpriority\":\"' || o_orderpriority || '\"}'") + " from orders")
def _(spark, d):
    return A.digest(B._t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority"), schema=False)


@query("ordered_digest", "select " + _DIG.replace("{row}", "'{\"__place\":' || place || ',\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || '}'") + " from (select *, row_number() over (order by o_orderkey) as place from orders)")
def _(spark, d):
    return A.ordered_digest(B._t(spark, d, "orders", "o_orderkey", "o_custkey"), ["o_orderkey"], schema=False)


@query("table_diff", "select o_orderkey, 'o_totalprice' as \"column\", 'value' as kind from orders where o_orderkey % 50 = 0 and o_orderkey % 70 != 0 union all select o_orderkey, '*', 'only_left' from orders where o_orderkey % 70 = 0")
def _(spark, d):
    a = B._t(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    b = a.filter("o_orderkey % 70 != 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 50 == 0, F.col("o_totalprice") + 1e-6).otherwise(F.col("o_totalprice")))
    return A.table_diff(a, b, ["o_orderkey"])


#: What the other engine's regular expressions can say; they have no lookahead.
_PLAIN = {n: p for n, p in A.SENSITIVE.items() if n != "connection"}
_SCAN = " union all ".join(f"select 'text' as \"column\", '{n}' as pattern, count(*) filter (regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')) as rows from documents" for n, p in _PLAIN.items())


@query("sensitive_scan", _SCAN)
def _(spark, d):
    return A.sensitive_scan(B._t(spark, d, "documents", "text"), ["text"], _PLAIN)


@query("sensitive_scan_all")
def _(spark, d):
    return A.sensitive_scan(B._t(spark, d, "documents", "text"), ["text"])


_PBF = """with {cohort}, b as (select visit_id, age, sex, visit_type, cast(('0x' || substr(md5('42|' || patient_id), 1, 8)) as bigint) % 5 + 1 as fold from cohort), f as (select unnest(range(1, 6)) as k),
t as (select k, b.* from f join b on b.fold != k)
select k as fold, 'age' as "column", '' as level, 'median' as statistic, round(median(age), 6) as value from t group by k
union all select k, 'age', '', 'mean', round(avg(age), 6) from t group by k union all select k, 'age', '', 'deviation', round(stddev_pop(age), 6) from t group by k
union all select k, 'sex', coalesce(sex, '__MISSING__'), 'share', round(count(*) / sum(count(*)) over (partition by k), 6) from t group by k, sex
union all select k, 'visit_type', coalesce(visit_type, '__MISSING__'), 'share', round(count(*) / sum(count(*)) over (partition by k), 6) from t group by k, visit_type"""


@query("preprocessing_by_fold", _PBF)
def _(spark, d):
    rows = _cohort(spark, d).select("visit_id", "age", "sex", "visit_type", B.fold_of(F.col("patient_id")).alias("fold"))
    return X.training_statistics(rows, ["age"], ["sex", "visit_type"]).withColumn("value", F.round("value", 6))


@query("verify_features", _LINK + " select linked_visit as visit_id, concept_key, 'n' as \"column\", 'value' as kind from q where linked_visit % 5 = 0 group by all union all select linked_visit, concept_key, '*', 'only_right' from q where linked_visit % 7 = 0 and linked_visit % 5 != 0 group by all")
def _(spark, d):
    """Features are frozen with planted faults (a count changed, rows left out), made again from the linked events and compared by ranges of their keys."""
    made = _kept(spark, d, "visit_id", "concept_key", "value").groupBy("visit_id", "concept_key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    faulty = made.filter("visit_id % 7 != 0 or visit_id % 5 = 0").withColumn("n", F.when(F.col("visit_id") % 5 == 0, F.col("n") + 1).otherwise(F.col("n")))
    path = f"{shared_dir(spark)}/frozen-{uuid.uuid4().hex}"
    V.freeze(faulty, ["visit_id", "concept_key"], path)
    return V.verify(made, ["visit_id", "concept_key"], path)


@query("small_cells", "select p_brand, p_type, 'n' as \"column\", count(*) as n from part group by p_brand, p_type having count(*) between 1 and 10")
def _(spark, d):
    cells = B._t(spark, d, "part", "p_brand", "p_type").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return A.small_cells(cells, ["n"], 11, ["p_brand", "p_type"])


@query("manifest_scan", "select 'customer.' || c_mktsegment as path, count(*) as n from customer group by 1 having count(*) < 300")
def _(spark, d):
    rows = B._t(spark, d, "customer", "c_mktsegment").groupBy(F.concat(F.lit("customer."), F.col("c_mktsegment")).alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return A.small_cells(rows, ["n"], 300, ["path"]).select("path", "n")


@query("run_summary", "with {cohort} select count(*) as visits, count(distinct patient_id) as patients, cast(sum(outcome) as bigint) as outcomes, string_agg(distinct visit_type, '|' order by visit_type) as types from cohort")
def _(spark, d):
    return _cohort(spark, d).agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("patient_id").alias("patients"), F.sum("outcome").alias("outcomes"), F.array_join(F.array_sort(F.collect_set("visit_type")), "|").alias("types"))


# ------------------------------------------------------------------ generic relational operators


@query("group_by", "select l_returnflag, count(*) as n, round(sum(l_quantity), 2) as total, round(avg(l_quantity), 6) as mean, min(l_quantity) as low, max(l_quantity) as high, count(distinct l_partkey) as parts, round(stddev_samp(l_quantity), 6) as sd, count(*) filter (l_discount > 0.05) as cheap from lineitem group by 1")
def _(spark, d):
    q = F.col("l_quantity")
    return B._t(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_partkey", "l_discount").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(q), 2).alias("total"), F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("low"), F.max(q).alias("high"), F.count_distinct("l_partkey").alias("parts"), F.round(F.stddev_samp(q), 6).alias("sd"), F.count_if(F.col("l_discount") > 0.05).alias("cheap"))


@query("quantiles", "select l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) as q1, round(median(l_quantity), 6) as q2, round(quantile_cont(l_quantity, 0.9), 6) as q9 from lineitem group by 1")
def _(spark, d):
    p = lambda x: F.round(F.percentile("l_quantity", F.lit(x)), 6)
    return B._t(spark, d, "lineitem", "l_returnflag", "l_quantity").groupBy("l_returnflag").agg(p(0.25).alias("q1"), p(0.5).alias("q2"), p(0.9).alias("q9"))


@query("value_counts", "select case when o_orderkey % 5 != 0 then o_orderpriority end as v, count(*) as n from orders group by 1")
def _(spark, d):
    return B._t(spark, d, "orders", "o_orderkey", "o_orderpriority").groupBy(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("cumcount", "select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as nth from orders")
def _(spark, d):
    return B._t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate").select("o_orderkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).cast("long").alias("nth"))


@query("first_per_group", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as r from orders) where r = 1")
def _(spark, d):
    o = B._t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    return o.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"))


@query("equal_frequency_bins", "select p_partkey, cast(floor((row_number() over (order by p_retailprice, p_partkey) - 1) * 10 / count(*) over ()) as bigint) + 1 as bin from part")
def _(spark, d):
    p = B._t(spark, d, "part", "p_partkey", "p_retailprice")
    n = numbered(p, [F.col("p_retailprice"), F.col("p_partkey")], "i")
    return n.crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("t")))).select("p_partkey", (F.floor((F.col("i") - 1) * 10 / F.col("t")) + 1).cast("long").alias("bin"))


@query("top_k", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25")
def _(spark, d):
    return B._t(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("set_operations", "select 'only_a' as side, count(*) as n from (select distinct o_custkey from orders where o_orderstatus = 'F' except select c_custkey from customer where c_acctbal > 0) union all select 'both', count(*) from (select distinct o_custkey from orders where o_orderstatus = 'F' intersect select c_custkey from customer where c_acctbal > 0)")
def _(spark, d):
    a = B._t(spark, d, "orders", "o_custkey", "o_orderstatus").filter("o_orderstatus = 'F'").select("o_custkey")
    b = B._t(spark, d, "customer", "c_custkey", "c_acctbal").filter("c_acctbal > 0").select("c_custkey")
    one = F.count(F.lit(1)).alias("n")
    return A.union([a.exceptAll(a.intersect(b)).distinct().join(b.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").agg(one).select(F.lit("only_a").alias("side"), "n"), a.intersect(b).agg(one).select(F.lit("both").alias("side"), "n")])


@query("unpivot", "select p_partkey, unnest(['size', 'price']) as name, unnest([cast(p_size as double), p_retailprice]) as value from part")
def _(spark, d):
    p = B._t(spark, d, "part", "p_partkey", "p_size", "p_retailprice").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "name", "value")


@query("grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def _(spark, d):
    return B._t(spark, d, "orders", "o_orderstatus", "o_orderpriority").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("manifest_findings", "select c_custkey, '$.runs[0].visit_id' as path, 'identifier' as finding from customer union all select c_custkey, '$.runs[0].row_count', 'small_cell' from customer where c_custkey % 7 between 1 and 4")
def _(spark, d):
    rows = B._t(spark, d, "customer", "c_custkey", "c_mktsegment")
    runs = F.array(F.struct(F.col("c_custkey").alias("visit_id"), (F.col("c_custkey") % 7).alias("row_count")))
    rows = rows.select("c_custkey", F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), runs.alias("runs"), F.lit("x").alias("note"))).alias("manifest"))
    return A.manifest_findings(rows, "manifest", 5)


@query("published_table", "select p_brand, count(*) as n from part group by 1")
def _(spark, d):
    """A table of counts that passes its list of columns and the least count; the query fails at a smaller one."""
    cells = B._t(spark, d, "part", "p_brand").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return A.publishable(cells, "brands", {"brands": ["p_brand", "n"]}, ["n"], 2)
