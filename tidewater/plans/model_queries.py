"""Queries that fit models, which SQL cannot express: four models on eight matrices in five folds, with all trees and rounds.

What they need is made once for the given tables and rules and kept in a store in the shared folder: the encoded tables, the fits
with their predictions, and the attributions. A query that finds a part there reads it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import normalise as N
from tidewater.operators import evaluation as E
from tidewater.operators import features as X
from tidewater.operators import modeling as M
from tidewater.operators import trees as T
from tidewater.plans import bindings as B
from tidewater.plans.bindings import query
from tidewater.plans.feature_queries import _cohort, _qualified
from tidewater.sources.shared import Store, fingerprint, frozen

RULES = M.FitRules()
MODELS = M.MODELS
FOLDS = (1, 2, 3, 4, 5)
CONCEPTS, KEEP = 50, 21
BASE = (["age"], ["sex", "visit_type"])
MATRICES = {
    "baseline": (),
    "baseline_measurements": ("measurements",),
    "baseline_medications": ("medications",),
    "baseline_procedures": ("procedures",),
    "baseline_measurements_medications": ("measurements", "medications"),
    "baseline_measurements_procedures": ("measurements", "procedures"),
    "baseline_medications_procedures": ("medications", "procedures"),
    "baseline_all_domains": ("measurements", "medications", "procedures"),
}
#: The types of parts, the last word of a concept, stand for the domains of events: two each, so 50 concepts each.
DOMAINS = {"measurements": ("ECONOMY", "LARGE"), "medications": ("MEDIUM", "PROMO"), "procedures": ("SMALL", "STANDARD")}
#: Rows of training folds and of the fold itself that attributions compare.
BACKGROUND, EXPLAINED = 50, 100


def _domains(spark, d):
    """The cells of each domain, and by domain and fold the features that are kept: 21 for each at most."""
    events = frozen(_qualified(spark, d).withColumn("kind", F.element_at(F.split("concept_key", "-"), -1)), "model-events")
    cells, kept = {}, {}
    for domain, kinds in DOMAINS.items():
        own = events.filter(F.col("kind").isin(*kinds))
        cells[domain] = frozen(X.domain_cells(own, domain), f"cells-{domain}")
        top = X.top_per(X.training_counts(own, ["concept_key"]), ["fold"], [F.desc("visits"), N.concept_key(F.col("concept_key"))], CONCEPTS)
        for r in X.selected_features(cells[domain], top, KEEP).orderBy("fold", "rank").collect():  # 21 rows for each fold
            kept.setdefault((domain, r["fold"]), []).append(r["feature"])
    return cells, kept


def _medians(base: DataFrame, cells: dict[str, DataFrame], kept: dict) -> dict[tuple[int, str], float]:
    """Of each fold and numeric column, the exact median of the training rows that have a value."""
    long = base.select("fold", F.lit("age").alias("feature"), F.col("age").cast("double").alias("value"))
    for domain, of in cells.items():
        names = sorted({c for (x, _), own in kept.items() if x == domain for c in own})
        long = long.unionByName(of.filter(F.col("feature").isin(names)).select("fold", "feature", "value"))
    return {(int(r["fold"]), r["feature"]): r["med"] for r in X.training_medians(*X._by_value(long)).collect()}  # columns by folds


def _encode(spark, d, store: Store) -> None:
    """Writes the encoded table of each fold, its bins, their groups and each visit's, then the list of all columns."""
    cells, kept = _domains(spark, d)
    base = frozen(_cohort(spark, d).select("visit_id", "patient_id", "outcome", "age", "sex", "visit_type", B.fold_of(F.col("patient_id")).alias("fold")), "model-base")
    medians = _medians(base, cells, kept)
    seen = {c: base.select("fold", F.coalesce(c, F.lit(M.MISSING)).alias("v")).distinct().collect() for c in BASE[1]}  # levels by folds
    absent = {f"__{s}": v for both in (X.STATISTICS, X.AGGREGATES) for of in both.values() for s, v in of.items() if v is not None}
    parts = []
    for domain in DOMAINS:
        if names := sorted({c for (of, _), own in kept.items() if of == domain for c in own}):
            parts.append(cells[domain].filter(F.col("feature").isin(names)).groupBy("visit_id").pivot("feature", names).agg(F.first("value")))
    df = X.assemble(base, parts, "visit_id")  # the features of all folds, which share most
    df = frozen(df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) for c in df.columns if "__" in c and (v := absent.get(c[c.rindex("__") :])) is not None}), "assembled")
    columns, folds = [], []
    for k in FOLDS:
        names = {domain: kept.get((domain, k), []) for domain in DOMAINS}
        levels = {c: sorted({r["v"] for r in rows if r["fold"] != k}) for c, rows in seen.items()}
        table, own = M.encoded(df, k, BASE[0] + [c for cs in names.values() for c in cs], BASE[1], {c: m for (f, c), m in medians.items() if f == k}, levels)
        where = {c: domain for domain, cs in names.items() for c in cs}
        columns += [(k, i, name, source, where.get(source, "baseline"), m, s, n) for i, (name, source, m, s, _, n) in enumerate(own)]
        folds.append(M.Encoded(k, store.table(f"encoded-{k}", lambda table=table: table), [], [], np.zeros(0), np.zeros(0), 0))
    cuts = M.cuts_by_fold(store.table("cuts", lambda: M.cuts(folds)))
    rows = store.table("binned", lambda: M.binned(folds, cuts))
    found = store.table("groups", lambda: M.groups(rows))
    store.table("members", lambda: M.members(rows, found))
    per = {r["of"]: r["count"] for r in found.groupBy("of").count().collect()}  # a row for each fold
    columns = [(*c, per[c[0]]) for c in columns]
    store.table("columns", lambda: spark.createDataFrame(columns, "fold int, i int, name string, source string, domain string, mean double, sd double, n long, groups long"))


@dataclass
class Run:
    spark: object
    store: Store
    folds: list
    wanted: dict
    names: dict

    def all_fits(self, model: str) -> list[tuple[int, str, str]]:
        return [(k, m, model) for k, m in self.wanted]

    def coefficients(self) -> DataFrame:
        def make():
            w = M.logistic(self.folds, self.wanted)
            return self.spark.createDataFrame([(k, m, [float(x) for x in v]) for (k, m), v in w.items()], "of int, matrix string, w array<double>")

        return self.store.table("logistic", make)

    def weights(self) -> dict:
        return {(r["of"], r["matrix"]): np.array(r["w"]) for r in self.coefficients().collect()}  # one row for each fit

    def large(self) -> bool:
        return not all(e.fits() for e in self.folds)

    def trees(self, model: str) -> DataFrame:
        return self.store.table(model, lambda: M.fit_trees(self.folds, self.all_fits(model), self.wanted, RULES, self.store.table("groups")))

    def fit_large(self, model: str) -> None:
        for e in self.folds:
            for m in MATRICES:
                name, columns = f"large-{model}-{e.fold}-{m}", self.wanted[e.fold, m]
                if not (self.store.has(name) and self.store.has(f"{name}-gains")):
                    fitted = self.large_fit(e, m, model)
                    self.store.table(name, lambda: M.large_predictions(fitted, e, columns, m, model))  # noqa: B023
                    self.store.table(f"{name}-gains", lambda: self.spark.createDataFrame([(e.fold, m, [float(v) for v in fitted.featureImportances.toArray()])], "of int, matrix string, gains array<double>"))  # noqa: B023

    def large_fit(self, e: M.Encoded, matrix: str, model: str):
        """The model of Spark ML, fitted and stored if it is not there whole."""
        name = f"large-{model}-{e.fold}-{matrix}-fit"
        if not self.store.has(f"{name}/data"):  # written last
            M.large_model(e, self.wanted[e.fold, matrix], model, RULES).write().overwrite().save(f"{self.store.root}/{name}")
        return M.loaded(model, f"{self.store.root}/{name}")

    def predictions(self, model: str) -> DataFrame:
        if model == "logistic":
            return self.store.table("predicted-logistic", lambda: M.logistic_predictions(self.folds, self.wanted, self.weights()))
        if self.large():
            self.fit_large(model)
            return reduce(DataFrame.unionByName, [self.store.table(f"large-{model}-{e.fold}-{m}") for e in self.folds for m in MATRICES])
        return self.store.table(f"predicted-{model}", lambda: M.tree_predictions(self.trees(model), RULES, self.store.table("members")))

    def all_predictions(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.predictions(m) for m in MODELS])

    def gains(self, model: str) -> dict:
        if model == "logistic":
            return {k: np.abs(v[1:]) for k, v in self.weights().items()}
        if self.large():
            self.fit_large(model)
            tables = [self.store.table(f"large-{model}-{e.fold}-{m}-gains") for e in self.folds for m in MATRICES]
            return {(r["of"], r["matrix"]): np.array(r["gains"]) for t in tables for r in t.collect()}
        out: dict = {}
        for r in self.trees(model).select("of", "matrix", "gains").collect():  # a row for each part of a fit
            out[r["of"], r["matrix"]] = out.get((r["of"], r["matrix"]), 0.0) + np.array(r["gains"])
        return {k: v / v.sum() if model == "random_forest" and v.sum() else v for k, v in out.items()}

    def best(self) -> dict[str, str]:
        """The model of each matrix that the pooled predictions select."""
        outcome = self.folds[0].table.select("visit_id", "outcome")
        scored = self.all_predictions().withColumnRenamed("probability", "p").join(outcome, "visit_id")
        rows = E.best_model(E.metrics(E.counts(scored, ["matrix", "model"]), ["matrix", "model"])).collect()  # eight rows
        return {r["matrix"]: r["model"] for r in rows}


def run(spark, d) -> Run:
    paths = [f"{d}/{t}.parquet" for t in ("customer", "orders", "lineitem", "part")]
    store = Store(spark, "models", fingerprint(spark, paths, RULES, FOLDS, CONCEPTS, KEEP, BASE, MATRICES, DOMAINS, T.BINS, T.DEEPEST, M.TREES_AT_ONCE, B.RULES, "groups"))
    if not store.has("columns"):
        _encode(spark, d, store)
    rows = sorted(store.table("columns").collect(), key=lambda r: (r["fold"], r["i"]))  # columns by folds
    folds, wanted, names = [], {}, {}
    for k in FOLDS:
        own = [r for r in rows if r["fold"] == k]
        e = M.Encoded(k, store.table(f"encoded-{k}"), [r["name"] for r in own], [r["source"] for r in own], np.array([r["mean"] for r in own]), np.array([r["sd"] for r in own]), own[0]["n"], own[0]["groups"])
        folds.append(e)
        for m, of in MATRICES.items():
            wanted[k, m] = np.array([r["i"] for r in own if r["domain"] == "baseline" or r["domain"] in of], np.int64)
            names[k, m] = [e.names[i] for i in wanted[k, m]]
    return Run(spark, store, folds, wanted, names)


@query("oof_predictions")
def _(spark, d):
    return run(spark, d).all_predictions()


def _as_scores(r: Run) -> DataFrame:
    return r.all_predictions().select(F.col("visit_id").alias("n"), "fold", "matrix", "model", F.col("probability").alias("p"))


@query("model_run_gate")
def _(spark, d):
    """The query fails unless the stored predictions are of five folds, eight matrices, four models, 160 fits and 32 probabilities a visit."""
    return E.require_run(_as_scores(run(spark, d)), len(FOLDS), len(MATRICES), len(MODELS))


@query("model_coverage")
def _(spark, d):
    """(check, failures) of the stored predictions against the cohort: repeats, visits without a row, other folds, probabilities out of bounds."""
    r = run(spark, d)
    own = _cohort(spark, d).select(F.col("visit_id").alias("n"), B.fold_of(F.col("patient_id")).cast("int").alias("fold"))
    return E.oof_coverage(_as_scores(r), own)


@query("feature_importance")
def _(spark, d):
    r = run(spark, d)
    out = [(m, k, model, i, f, v) for model in MODELS for (k, m), values in r.gains(model).items() for i, (f, v) in enumerate(M.importance(r.names[k, m], values), 1)]
    return spark.createDataFrame(out, "matrix string, fold int, model string, rank int, feature string, importance double")  # as many rows as columns of the 160 fits


def _refitted(r: Run, best: dict[str, str]) -> DataFrame:
    """Predictions of new fits of each matrix's selected model in each fold; nothing of them is stored."""
    out = []
    linear = {key: c for key, c in r.wanted.items() if best[key[1]] == "logistic"}
    if linear:
        out.append(M.logistic_predictions(r.folds, linear, M.logistic(r.folds, linear)))
    trees = [(k, m, best[m]) for k, m in r.wanted if best[m] != "logistic"]
    if trees and r.large():
        out += [M.fit_large(e, r.wanted[e.fold, m], m, model, RULES)[0] for e in r.folds for k, m, model in trees if k == e.fold]
    elif trees:
        out.append(M.tree_predictions(M.fit_trees(r.folds, trees, r.wanted, RULES, r.store.table("groups")), RULES, r.store.table("members")))
    return reduce(DataFrame.unionByName, out)


@query("refit_check")
def _(spark, d):
    """Each matrix's selected model is fitted again in each fold: its largest difference from the stored predictions, and visits on one side."""
    r = run(spark, d)
    best = r.best()
    chosen = spark.createDataFrame(list(best.items()), "matrix string, model string")
    stored = r.all_predictions().join(F.broadcast(chosen), ["matrix", "model"]).withColumnRenamed("probability", "stored")
    both = _refitted(r, best).join(stored, ["visit_id", "fold", "matrix", "model"], "full")
    return both.groupBy("matrix", "fold", "model").agg(F.max(F.abs(F.col("probability") - F.col("stored"))).alias("max_difference"), F.count_if(F.col("probability").isNull() | F.col("stored").isNull()).alias("unmatched"))


def _large_attributions(r: Run, e: M.Encoded, matrix: str, model: str, background: np.ndarray, rows: np.ndarray) -> DataFrame:
    """The rows of ``_attributions`` of one fit by Spark ML."""
    own = r.wanted[e.fold, matrix]
    order = np.random.default_rng((42, e.fold)).permutation(len(own))
    per = M.large_contributions(r.large_fit(e, matrix, model), r.spark, background[:, own], rows[:, own], order)
    names = r.spark.createDataFrame([(j, e.sources[i]) for j, i in enumerate(own)], "column int, feature string")
    mean = F.sum(F.coalesce("mean_abs", F.lit(0.0))).alias("mean_abs")
    return names.join(per, "column", "left").groupBy(F.lit(matrix).alias("matrix"), F.lit(e.fold).cast("int").alias("fold"), F.lit(model).alias("model"), "feature").agg(mean)


def _attributions(r: Run) -> DataFrame:
    """(matrix, fold, model, feature, mean_abs) of the selected models: mean absolute contributions against background rows of the training folds.

    The job has a task for each fit; it reads its fit from the store and the samples of its fold. Rows for models of Spark ML are made and
    scored as a table, one fit after another, and kept.
    """
    best, spark, large = r.best(), r.spark, r.large()
    samples, cuts = {}, {} if large else M.cuts_by_fold(r.store.table("cuts"))
    for e in r.folds:
        take = lambda cond, n, seed: np.array([x["x"] for x in M.sample(e.table.filter(cond), n, seed).select("x").collect()]).reshape(-1, len(e.names))
        samples[e.fold] = (take(F.col("fold") != e.fold, BACKGROUND, 42 + e.fold), take(F.col("fold") == e.fold, EXPLAINED, 142 + e.fold), cuts.get(e.fold), e.mean, e.sd, e.sources)
    w, wanted = r.weights(), r.wanted
    shared = spark.sparkContext.broadcast((samples, w, wanted))
    parts = [spark.createDataFrame([(k, m, "logistic") for k, m in wanted if best[m] == "logistic"], "of int, matrix string, model string").select("*", F.lit(0.0).alias("start"), F.array().cast("array<binary>").alias("trees"))]
    done = []
    for e, m in ((e, m) for e in r.folds for m in MATRICES if large and best[m] != "logistic"):
        done.append(r.store.table(f"large-{best[m]}-{e.fold}-{m}-attributions", lambda e=e, m=m: _large_attributions(r, e, m, best[m], *samples[e.fold][:2])))
    for model in [] if large else sorted(set(best.values()) - {"logistic"}):
        own = r.trees(model).filter(F.col("matrix").isin([m for m, x in best.items() if x == model]))
        parts.append(own.groupBy("of", "matrix", "model").agg(F.max("start").alias("start"), F.collect_list("trees").alias("trees")))
    fits = reduce(DataFrame.unionByName, parts)
    rules = RULES

    def explain(batches):
        samples, w, wanted = shared.value
        for batch in batches:
            for of, matrix, model, start, blobs in zip(*[c.to_pylist() for c in batch.columns]):
                background, rows, cuts, mean, sd, sources = samples[of]
                own = wanted[of, matrix]
                if model == "logistic":
                    b, x = ((v[:, own] - mean[own]) / sd[own] for v in (background, rows))
                    weight = w[of, matrix]
                    score = lambda v: T._sigmoid(weight[0] + v @ weight[1:])
                else:
                    b, x = (T.binned(v, cuts)[:, own] for v in (background, rows))
                    each = [T.Ensemble.unpacked(raw) for raw in blobs]
                    total = lambda v: sum(e.total(v) for e in each)
                    score = (lambda v: total(v) / rules.trees) if model == "random_forest" else (lambda v: T._sigmoid(start + total(v)))
                order = np.random.default_rng((42, of)).permutation(len(own))
                mean_abs = np.abs(M.permutation_contributions(score, b, x, order)).mean(axis=0)
                by: dict = {}
                for i, v in zip(own, mean_abs):  # encoded columns are summed back to the columns they come from
                    by[sources[i]] = by.get(sources[i], 0.0) + float(v)
                n = len(by)
                yield pa.RecordBatch.from_arrays([pa.array([matrix] * n), pa.array([of] * n, pa.int32()), pa.array([model] * n), pa.array(list(by)), pa.array(list(by.values()))], ["matrix", "fold", "model", "feature", "mean_abs"])

    n = len(wanted)
    explained = fits.repartition(n, "of", "matrix").mapInArrow(explain, "matrix string, fold int, model string, feature string, mean_abs double")
    return reduce(DataFrame.unionByName, [explained, *done])


def _stored_attributions(spark, d) -> DataFrame:
    r = run(spark, d)
    return r.store.table("attributions", lambda: _attributions(r))


@query("attribution")
def _(spark, d):
    return _stored_attributions(spark, d)


def summary(by_fold: DataFrame) -> DataFrame:
    """(matrix, model, feature, mean_abs, folds, rank): means over the folds that selected a feature."""
    mean = by_fold.groupBy("matrix", "model", "feature").agg(F.avg("mean_abs").alias("mean_abs"), F.count_distinct("fold").alias("folds"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy("matrix").orderBy(F.desc("mean_abs"), "feature")).cast("long"))


@query("attribution_summary")
def _(spark, d):
    return summary(_stored_attributions(spark, d))
