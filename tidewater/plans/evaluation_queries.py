"""Queries of the evaluation, bootstrap and prediction-check operators over the score table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import draws
from tidewater.operators import evaluation as E
from tidewater.operators.numbering import numbered
from tidewater.plans import bindings as B
from tidewater.plans.bindings import query

G = ["matrix", "model"]
REPS = 2000


def _curve_sql(groups: str, source: str = "scores") -> str:
    return f"""c0 as (select {groups}, p, sum(outcome) as pos, sum(1 - outcome) as neg from {source} group by all),
c as (select *, sum(pos) over (partition by {groups} order by p desc) as tp, sum(neg) over (partition by {groups} order by p desc) as fp, sum(pos) over (partition by {groups}) as pp, sum(neg) over (partition by {groups}) as nn from c0)"""


def _metrics_sql(groups: str) -> str:
    return f"""m0 as (select {groups}, sum(case when p >= 0.5 then pos else 0 end) as tp, sum(case when p >= 0.5 then neg else 0 end) as fp, sum(case when p >= 0.5 then 0 else pos end) as fn, sum(case when p >= 0.5 then 0 else neg end) as tn,
  max(pp) as pp, max(nn) as nn, sum(pos * (nn - fp + neg / 2.0)) as u, sum(pos * tp / (tp + fp)) as ap, sum(pos * (1 - p) * (1 - p) + neg * p * p) as se,
  sum(-pos * ln(greatest(least(p, 1 - 1e-15), 1e-15)) - neg * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15))) as ll, sum(pos + neg) as n from c group by {groups}),
m as (select {groups}, cast(tn as bigint) as tn, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tp as bigint) as tp, (tp + tn) / n as accuracy, case when pp > 0 and nn > 0 then (tp / pp + tn / nn) / 2 end as balanced_accuracy,
  case when tp + fp > 0 then tp / (tp + fp) end as ppv, case when tn + fn > 0 then tn / (tn + fn) end as npv, case when pp > 0 then tp / pp end as sensitivity, case when nn > 0 then tn / nn end as specificity,
  case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) end as f1, case when pp * nn > 0 then u / (pp * nn) end as auroc, case when nn > 0 and pp > 0 then ap / pp end as auprc, se / n as brier, ll / n as log_loss from m0)"""


_POOLED = "with {scores}, " + _curve_sql("matrix, model") + ", " + _metrics_sql("matrix, model")
_FOLDS = "with {scores}, " + _curve_sql("matrix, model, fold") + ", " + _metrics_sql("matrix, model, fold")


def _round(df, skip=()):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" and c not in skip else F.col(c) for c in df.columns])


def _rounded(cols: str, *names: str) -> str:
    return cols + ", " + ", ".join(f"round({n}, 6) as {n}" for n in names)


def _by(spark, d, groups=None):
    return E.counts(B.scores(spark, d), groups or G)


def _pooled(spark, d):
    return E.metrics(_by(spark, d), G)


@query("confusion_metrics", _POOLED + " select " + _rounded("matrix, model, tn, fp, fn, tp", *E.METRICS[:7]) + " from m")
def _(spark, d):
    return _round(_pooled(spark, d).select(*G, "tn", "fp", "fn", "tp", *E.METRICS[:7]))


for _name, _cols in (("auroc", ("auroc",)), ("auprc", ("auprc",)), ("brier_logloss", ("brier", "log_loss"))):

    @query(_name, _POOLED + " select " + _rounded("matrix, model", *_cols) + " from m")
    def _(spark, d, cols=_cols):
        return _round(_pooled(spark, d).select(*G, *cols))


@query("pooled_metrics", _POOLED + " select " + _rounded("matrix, model, tn, fp, fn, tp", *E.METRICS) + " from m")
def _(spark, d):
    return _round(_pooled(spark, d))


def _fold_metrics(spark, d):
    return E.metrics(_by(spark, d, [*G, "fold"]), [*G, "fold"])


@query("fold_metrics", _FOLDS + " select " + _rounded("matrix, model, fold, tn, fp, fn, tp", *E.METRICS) + " from m")
def _(spark, d):
    return _round(_fold_metrics(spark, d))


_LONG = " union all ".join(f"select matrix, model, '{x}' as metric, cast({x} as double) as v from m" for x in E.METRICS)


@query("fold_metric_summary", _FOLDS + f", l as ({_LONG}) select matrix, model, metric, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, count(v) as valid_folds from l group by all")
def _(spark, d):
    return _round(E.metric_summary(_fold_metrics(spark, d), G))


@query("best_model", _POOLED + " select matrix, model, round(auprc, 6) as auprc from (select *, row_number() over (partition by matrix order by auprc desc, auroc desc, brier, model) as r from m) where r = 1")
def _(spark, d):
    return _round(E.best_model(_pooled(spark, d)).select("matrix", "model", "auprc"))


_C = "with {scores}, " + _curve_sql("matrix, model")


@query("roc_coordinates", _C + " select matrix, model, p as threshold, round(fp / nn, 6) as fpr, round(tp / pp, 6) as tpr from c union all select distinct matrix, model, null, 0, 0 from c")
def _(spark, d):
    return _round(E.roc(_by(spark, d), G), ("threshold",))


_SENS = "s0 as (select matrix, model, p as threshold, tp / pp as sensitivity, 1 - fp / nn as specificity, tp / (tp + fp) as ppv, cast(tp + fp as bigint) as flagged from c), s1 as (select *, row_number() over (partition by matrix, model order by sensitivity desc, abs(specificity - 0.9), threshold desc) as r from s0 where specificity >= 0.9)"


@query("sens_at_spec", _C + ", " + _SENS + " select matrix, model, threshold, round(sensitivity, 6) as sensitivity, round(specificity, 6) as specificity, round(ppv, 6) as ppv, flagged from s1 where r = 1")
def _(spark, d):
    return _round(E.sensitivity_at(_by(spark, d), G))


_TOP = """t0 as (select *, row_number() over (partition by matrix, model order by p desc, n) as r, count(*) over (partition by matrix, model) as total, sum(outcome) over (partition by matrix, model) as pp from scores),
t1 as (select *, cast(ceil(0.1::double * total) as bigint) as k from t0), t2 as (select matrix, model, max(k) as flagged, sum(case when r <= k then outcome else 0 end) as captured, max(pp) as pp, max(total) as total, min(case when r <= k then p end) as cutoff from t1 group by all),
top as (select t2.matrix, t2.model, any_value(flagged) as flagged, cast(any_value(captured) as bigint) as captured, any_value(captured / t2.pp) as capture, any_value(captured / flagged) as ppv, any_value(captured / flagged / (t2.pp / t2.total)) as enrichment, any_value(cutoff) as cutoff, count(*) as ties, count(*) filter (r <= k) as ties_flagged from t2 join t1 on t1.matrix = t2.matrix and t1.model = t2.model and t1.p = t2.cutoff group by 1, 2)"""


@query("top_risk", "with {scores}, " + _TOP + " select matrix, model, flagged, captured, round(capture, 6) as capture, round(ppv, 6) as ppv, round(enrichment, 6) as enrichment, cutoff, ties, ties_flagged from top")
def _(spark, d):
    s = B.scores(spark, d)
    return _round(E.top_risk(s, E.counts(s, G), G), ("cutoff",))


@query("utility_table", _C + ", " + _SENS + ", " + _TOP + " select matrix, model, round(s1.sensitivity, 6) as sensitivity_spec, round(s1.ppv, 6) as ppv_spec, round(top.capture, 6) as capture_top, round(top.ppv, 6) as ppv_top from s1 join top using (matrix, model) where s1.r = 1")
def _(spark, d):
    s = B.scores(spark, d)
    by = E.counts(s, G)
    a = E.sensitivity_at(by, G).select(*G, F.col("sensitivity").alias("sensitivity_spec"), F.col("ppv").alias("ppv_spec"))
    return _round(a.join(E.top_risk(s, by, G).select(*G, F.col("capture").alias("capture_top"), F.col("ppv").alias("ppv_top")), G))


_BINS = """b0 as (select *, cast(floor((row_number() over (partition by matrix, model order by p, n) - 1) * 10 / count(*) over (partition by matrix, model)) as bigint) + 1 as bin from scores),
b as (select matrix, model, bin, count(*) as count, cast(sum(outcome) as bigint) as events, avg(p) as mean_p, min(p) as min_p, max(p) as max_p, sum(outcome) / count(*) as observed from b0 group by all)"""
_Z = "1.959963984540054"


@query("calibration_bins", "with {scores}, " + _BINS + f" select matrix, model, bin, count, events, round(mean_p, 6) as mean_p, min_p, max_p, round(observed, 6) as observed, round(greatest(0, ((observed + {_Z}*{_Z}/(2*count)) - {_Z}*sqrt(observed*(1-observed)/count + {_Z}*{_Z}/(4*count*count))) / (1 + {_Z}*{_Z}/count)), 6) as low, round(least(1, ((observed + {_Z}*{_Z}/(2*count)) + {_Z}*sqrt(observed*(1-observed)/count + {_Z}*{_Z}/(4*count*count))) / (1 + {_Z}*{_Z}/count)), 6) as high from b")
def _(spark, d):
    return _round(E.calibration_bins(B.scores(spark, d), G), ("min_p", "max_p"))


@query("calibration_summary", "with {scores}, " + _BINS + ", e as (select matrix, model, sum(count * abs(mean_p - observed)) / sum(count) as ece from b group by all), s as (select matrix, model, avg(p) as mean_risk, avg(outcome) as prevalence from scores group by all) select matrix, model, round(mean_risk, 6) as mean_risk, round(prevalence, 6) as prevalence, round(ece, 6) as ece, round(ln(prevalence / (1 - prevalence)) - ln(mean_risk / (1 - mean_risk)), 6) as in_the_large from e join s using (matrix, model)")
def _(spark, d):
    s = B.scores(spark, d)
    return _round(E.calibration_summary(E.calibration_bins(s, G), s, G))


_SLOPE = "with recursive {scores}, " + """x as (select matrix, model, ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) as x, sum(outcome) as pos, count(*) as w from scores group by matrix, model, p),
""" + ",\n".join(
    (f"i{k} as (select matrix, model, 0.0::double as a, 1.0::double as b from x group by all)" if k == 0 else f"i{k} as (select matrix, model, any_value(a) + (sum(v*x*x)*sum(g) - sum(v*x)*sum(g*x)) / (sum(v)*sum(v*x*x) - sum(v*x)*sum(v*x)) as a, any_value(b) + (sum(v)*sum(g*x) - sum(v*x)*sum(g)) / (sum(v)*sum(v*x*x) - sum(v*x)*sum(v*x)) as b from (select x.*, a, b, pos - w / (1 + exp(-(a + b * x))) as g, w / (1 + exp(-(a + b * x))) * (1 - 1 / (1 + exp(-(a + b * x)))) as v from x join i{k-1} using (matrix, model)) group by matrix, model)")
    for k in range(11)
)


@query("calibration_slope", _SLOPE.replace("with recursive", "with") + " select matrix, model, round(a, 6) as intercept, round(b, 6) as slope from i10")
def _(spark, d):
    return _round(E.calibration_slope(_by(spark, d), G))


_DC = "g as (select unnest(range(1, 51)) as t), dc as (select s.{k}, t / 100.0::double as threshold, sum({w} * case when floor(p * 100 + 1e-9) >= t then outcome else 0 end) / sum({w}) - sum({w} * case when floor(p * 100 + 1e-9) >= t then 1 - outcome else 0 end) / sum({w}) * (t / (100.0::double - t)) as model_, sum({w} * outcome) / sum({w}) - sum({w} * (1 - outcome)) / sum({w}) * (t / (100.0::double - t)) as all_ from {src} s, g group by {k}, t)"


@query("decision_curve", "with {scores}, " + _DC.replace("s.{k}", "matrix, model").replace("{k}", "matrix, model").replace("{w}", "1").replace("{src}", "scores") + " select matrix, model, threshold, 'model' as strategy, round(model_, 6) as net_benefit from dc union all select matrix, model, threshold, 'treat_all', round(all_, 6) from dc union all select matrix, model, threshold, 'treat_none', 0 from dc")
def _(spark, d):
    return _round(E.decision_curve(_by(spark, d), G), ("threshold",))


# ------------------------------------------------------------------ bootstrap

_BOOT = "pat as (select patient_id, row_number() over (order by patient_id) - 1 as slot from (select distinct patient_id from identity)), np as (select count(*) as np from pat), w as (select rep, pat.patient_id, weight from (select rep, cast(('0x' || substr(md5('20260727|' || rep || '|' || slot), 1, 8)) as bigint) % np as slot, count(*) as weight from pat, np, (select unnest(range(1, " + str(REPS + 1) + ")) as rep) group by 1, 2) d join pat using (slot))"
_BC = _BOOT + ", c0 as (select rep, matrix, model, p, sum(weight * outcome) as pos, sum(weight * (1 - outcome)) as neg from scores join w using (patient_id) group by all), c as (select *, sum(pos) over (partition by rep, matrix, model order by p desc) as tp, sum(neg) over (partition by rep, matrix, model order by p desc) as fp, sum(pos) over (partition by rep, matrix, model) as pp, sum(neg) over (partition by rep, matrix, model) as nn from c0), " + _metrics_sql("rep, matrix, model")


def _slots(spark, d):
    return numbered(B.gated_base(spark, d).filter("g8").select("patient_id").distinct(), [F.col("patient_id")], "slot").withColumn("slot", F.col("slot") - 1)


def _packed(spark, d):
    return draws.weights(_slots(spark, d), REPS, 20260727)


def _reps(spark, d, matrices=("x1", "x2")):
    return E.bootstrap_metrics(B.scores(spark, d, matrices), _packed(spark, d), G)


@query("bootstrap_weights", "with {scores}, " + _BOOT + " select rep, patient_id, weight from w")
def _(spark, d):
    return E.bootstrap_weights(_slots(spark, d), REPS, 20260727)


@query("bootstrap_metrics", "with {scores}, " + _BC + " select " + _rounded("rep, matrix, model, tn, fp, fn, tp", *E.METRICS) + " from m")
def bootstrap_metrics(spark, d):
    return _round(_reps(spark, d))


@query("percentile_ci", "with {scores}, " + _BC + f", l as ({_LONG}) select matrix, model, metric, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high, count(v) as valid, count(*) - count(v) as invalid from l group by all")
def _(spark, d):
    long = _reps(spark, d).unpivot(["rep", *G], list(E.METRICS), "metric", "value")
    return _round(E.percentile_interval(long, [*G, "metric"]))


@query("selected_performance", "with {scores}, " + _BC + ", q as (select matrix, model, quantile_cont(auroc, 0.025) as auroc_low, quantile_cont(auroc, 0.975) as auroc_high, quantile_cont(auprc, 0.025) as auprc_low, quantile_cont(auprc, 0.975) as auprc_high, quantile_cont(brier, 0.025) as brier_low, quantile_cont(brier, 0.975) as brier_high from m group by all) select matrix, model, " + ", ".join(f"round({m}_{s}, 6) as {m}_{s}" for m in ("auroc", "auprc", "brier") for s in ("low", "high")) + " from q")
def _(spark, d):
    names = ("auroc", "auprc", "brier")
    long = _reps(spark, d).unpivot(["rep", *G], list(names), "metric", "value")
    wide = E.percentile_interval(long, [*G, "metric"]).groupBy(*G).pivot("metric", list(names)).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    return _round(wide)


@query("decision_curve_ci", "with {scores}, " + _BOOT + ", sw as (select * from scores join w using (patient_id)), " + _DC.replace("s.{k}", "rep, matrix, model").replace("{k}", "rep, matrix, model").replace("{w}", "weight").replace("{src}", "sw") + " select matrix, model, threshold, round(quantile_cont(model_, 0.025), 6) as low, round(quantile_cont(model_, 0.975), 6) as high, count(*) as valid, 0::bigint as invalid from dc group by all")
def _(spark, d):
    curve = E.bootstrap_curves(B.scores(spark, d), _packed(spark, d), G)
    return _round(E.percentile_interval(curve, [*G, "threshold"]), ("threshold",))


@query("paired_comparisons", "with {scores}, " + _BC + ", z as (select a.model, a.rep, b.auroc - a.auroc as d1, b.auprc - a.auprc as d2, a.brier - b.brier as d3 from m a join m b on a.rep = b.rep and a.model = b.model and a.matrix = 'x1' and b.matrix = 'x2'), l as (select model, 'auroc_difference' as metric, d1 as v from z union all select model, 'auprc_difference', d2 from z union all select model, 'brier_improvement', d3 from z) select 'x1' as comparator, 'x2' as expanded, model, metric, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high, count(v) as valid, count(*) - count(v) as invalid from l group by model, metric")
def _(spark, d):
    return _round(E.percentile_interval(E.paired(_reps(spark, d), [("x1", "x2")]), ["comparator", "expanded", "model", "metric"]))


#: The prespecified pairs of a matrix and the same with one more domain.
PAIRS = [
    ("baseline", "baseline_measurements"), ("baseline", "baseline_medications"), ("baseline", "baseline_procedures"),
    ("baseline_measurements", "baseline_measurements_medications"), ("baseline_medications", "baseline_measurements_medications"),
    ("baseline_measurements", "baseline_measurements_procedures"), ("baseline_procedures", "baseline_measurements_procedures"),
    ("baseline_medications", "baseline_medications_procedures"), ("baseline_procedures", "baseline_medications_procedures"),
    ("baseline_measurements_medications", "baseline_all_domains"), ("baseline_measurements_procedures", "baseline_all_domains"), ("baseline_medications_procedures", "baseline_all_domains"),
]
ALL = tuple(dict.fromkeys(x for pair in PAIRS for x in pair))
_ALL_SCORES = B.SCORES_SQL.replace("('x1'), ('x2')", ", ".join(f"('{x}')" for x in ALL))
_PAIRS = "pr as (select * from (values " + ", ".join(f"('{a}', '{b}')" for a, b in PAIRS) + ") t(comparator, expanded))"


@query("prespecified_comparisons", "with " + _ALL_SCORES + ", " + _BC + ", " + _PAIRS + ", z as (select comparator, expanded, a.model, b.auroc - a.auroc as d1, b.auprc - a.auprc as d2, a.brier - b.brier as d3 from pr join m a on a.matrix = comparator join m b on b.matrix = expanded and b.rep = a.rep and b.model = a.model), l as (select comparator, expanded, model, 'auroc_difference' as metric, d1 as v from z union all select comparator, expanded, model, 'auprc_difference', d2 from z union all select comparator, expanded, model, 'brier_improvement', d3 from z) select comparator, expanded, model, metric, round(quantile_cont(v, 0.025), 6) as low, round(quantile_cont(v, 0.975), 6) as high, count(v) as valid, count(*) - count(v) as invalid from l group by comparator, expanded, model, metric")
def _(spark, d):
    return _round(E.percentile_interval(E.paired(_reps(spark, d, ALL), PAIRS), ["comparator", "expanded", "model", "metric"]))


# ------------------------------------------------------------------ prediction checks


@query("oof_coverage", "with {scores} select 'repeated' as \"check\", count(*) as failures from (select 1 from scores group by n, matrix, model having count(*) > 1) union all select 'missing', count(*) from (select n from scores group by n having count(*) != 6) union all select 'fold', count(*) from scores s left join identity i using (n) where s.fold is distinct from i.fold union all select 'bounds', count(*) from scores where p is null or p < 0 or p > 1")
def _(spark, d):
    return E.oof_coverage(B.scores(spark, d), B.identity(spark, d))


@query("probability_bounds", "with {scores} select matrix, model, count(*) filter (p < 0 or p > 1) as outside, count(distinct outcome) as classes from scores group by all")
def _(spark, d):
    return B.scores(spark, d).groupBy(*G).agg(F.count_if(~F.col("p").between(0, 1)).alias("outside"), F.count_distinct("outcome").alias("classes"))


@query("run_invariants", "with {scores} select count(distinct fold) as folds, count(distinct matrix) as matrices, count(distinct model) as models, count(*) // count(distinct n) as per_visit from scores")
def _(spark, d):
    return B.scores(spark, d).agg(F.count_distinct("fold").alias("folds"), F.count_distinct("matrix").alias("matrices"), F.count_distinct("model").alias("models"), F.floor(F.count(F.lit(1)) / F.count_distinct("n")).cast("long").alias("per_visit"))


@query("deterministic_sample", "with {scores} select visit_id from (select visit_id, cast(('0x' || substr(md5('42|' || visit_id), 1, 8)) as bigint) as h from identity) order by h, visit_id limit 100")
def _(spark, d):
    return E.hash_sample(B.identity(spark, d), 100, 42, "visit_id").select("visit_id")


@query("run_gate", "with {scores}, v as (select n, count(*) as c from scores group by 1) select count(distinct fold) as folds, count(distinct matrix) as matrices, count(distinct model) as models, (select count(*) from (select distinct fold, matrix, model from scores)) as fits, (select min(c) from v) as least, (select max(c) from v) as most from scores")
def _(spark, d):
    """The query fails unless there are five folds, two matrices, three models, all their fits and six probabilities a visit."""
    return E.require_run(B.scores(spark, d), 5, 2, 3)


@query("aligned_scores", "with {scores} select n, matrix, model, p from scores")
def _(spark, d):
    return E.aligned(B.scores(spark, d).select("n", "matrix", "model", "fold", "p"), B.identity(spark, d)).select("n", "matrix", "model", "p")
