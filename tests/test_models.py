"""The model queries cover all matrices, models and folds; fits against Spark ML, plain loops and closed sums."""

import os

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tidewater.operators import features as X
from tidewater.operators import modeling as M
from tidewater.operators import trees as T
from tidewater.plans import QUERIES, model_queries
from tidewater.sources.shared import Store, fingerprint

D = "/root/testdata/sf0.001"


def test_registered_fits_are_the_full_set():
    assert model_queries.RULES == M.FitRules(300, 100, 500)
    assert model_queries.MODELS == M.MODELS and len(model_queries.FOLDS) * len(model_queries.MATRICES) * len(M.MODELS) == 160
    assert {"oof_predictions", "feature_importance", "attribution", "attribution_summary", "refit_check"} <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_predictions_of_a_fold(spark, monkeypatch):
    """Few trees and one fold, to be quick; every matrix and model predicts every visit of the fold once."""
    monkeypatch.setattr(model_queries, "RULES", M.FitRules(2, 2, 2))
    monkeypatch.setattr(model_queries, "FOLDS", (1,))
    rows = QUERIES["oof_predictions"](spark, D).collect()
    per = {}
    for r in rows:
        assert 0 <= r["probability"] <= 1 and r["fold"] == 1
        per.setdefault((r["matrix"], r["model"]), []).append(r["visit_id"])
    assert set(per) == {(a, b) for a in model_queries.MATRICES for b in M.MODELS}
    assert len({tuple(sorted(v)) for v in per.values()}) == 1 and all(len(v) == len(set(v)) > 0 for v in per.values())


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_attribution_of_a_fold(spark, monkeypatch):
    monkeypatch.setattr(model_queries, "RULES", M.FitRules(2, 2, 2))
    monkeypatch.setattr(model_queries, "FOLDS", (1,))
    monkeypatch.setattr(model_queries, "MATRICES", {k: model_queries.MATRICES[k] for k in ("baseline", "baseline_medications")})
    rows = QUERIES["attribution_summary"](spark, D).collect()
    assert {r["matrix"] for r in rows} == set(model_queries.MATRICES) and all(r["folds"] == 1 for r in rows)
    assert any(r["feature"].startswith("medications__") for r in rows if r["matrix"] == "baseline_medications")


def test_summary_is_over_the_folds_that_have_a_feature(spark):
    df = spark.createDataFrame([("a", 1, "m", "x", 1.0), ("a", 2, "m", "x", 3.0), ("a", 2, "m", "y", 5.0)], "matrix string, fold int, model string, feature string, mean_abs double")
    assert sorted(map(tuple, model_queries.summary(df).collect())) == [("a", "m", "x", 2.0, 2, 2), ("a", "m", "y", 5.0, 1, 1)]


def test_selection_by_training_support(spark):
    """Visit 1 is of fold 1; its concept has no training support there."""
    e = spark.createDataFrame([(1, 1, "a", 2.0, 1.0), (2, 2, "b", 2.0, 1.0), (3, 2, "b", 4.0, 0.5)], "visit_id long, fold long, concept_key string, value double, hours_from_start double")
    cells = X.domain_cells(e, "medications")
    top = X.top_per(X.training_counts(e, ["concept_key"]), ["fold"], [X.F.desc("visits"), X.F.col("concept_key")], 50)
    got = {(r["fold"], r["feature"]): (r["support"], r["rank"]) for r in X.selected_features(cells, top, 3).collect()}
    assert got == {(1, "b__count"): (2, 1), (1, "b__exposure"): (2, 2), (1, "medications__any"): (2, 3), (2, "a__count"): (1, 1), (2, "a__exposure"): (1, 2), (2, "medications__any"): (1, 3)}


def _rows(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.hstack((rng.normal(size=(n, 3)), (rng.random((n, 2)) < 0.3).astype(float), rng.integers(0, 4, (n, 1)).astype(float)))
    y = (rng.random(n) < T._sigmoid(-0.5 + x[:, 0] - x[:, 3] + 0.4 * x[:, 5])).astype(int)
    return x, y, np.arange(n) % 5 + 1


def _encoded(spark, folds=(1, 2)):
    x, y, fold = _rows()
    df = spark.createDataFrame([(i, int(fold[i]), int(y[i]), x[i].tolist()) for i in range(len(y))], "visit_id long, fold long, outcome int, x array<double>").repartition(3)
    names = [f"c{i}" for i in range(6)]
    return [M.Encoded(k, df, names, names, x[fold != k].mean(axis=0), x[fold != k].std(axis=0), len(y)) for k in folds]


def test_logistic_fits_equal_spark_ml(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    folds = _encoded(spark)
    wanted = {(k, m): np.array(c) for k in (1, 2) for m, c in (("few", [0, 3]), ("all", list(range(6))))}
    w = M.logistic(folds, wanted, most=20)
    for (k, m), cols in wanted.items():
        e = folds[k - 1]
        z = F.array(*[(F.col("x")[int(i)] - float(e.mean[i])) / float(e.sd[i]) for i in cols])
        rows = e.table.filter(F.col("fold") != k).select(F.col("outcome").cast("double").alias("outcome"), array_to_vector(z).alias("features"))
        n = rows.count()
        fitted = LogisticRegression(labelCol="outcome", regParam=1.0 / n, standardization=False, tol=1e-14, maxIter=500).fit(rows)
        assert np.abs(np.append(fitted.intercept, fitted.coefficients.toArray()) - w[k, m]).max() < 1e-6
    p = {(r["visit_id"], r["matrix"]): r["probability"] for r in M.logistic_predictions(folds, wanted, w).collect()}
    x, y, fold = _rows()
    for i in (0, 5, 6, 11):
        k, e = int(fold[i]), folds[int(fold[i]) - 1]
        assert abs(p[i, "all"] - T._sigmoid(w[k, "all"][0] + ((x[i] - e.mean) / e.sd) @ w[k, "all"][1:])) < 1e-12
    assert len(p) == 2 * (fold <= 2).sum()


def _walk(e, tree, row):
    at = int(e.roots[tree])
    while e.column[at] >= 0:
        at = int(e.left[at]) + int(row[e.column[at]] > e.cut[at])
    return e.value[at]


def test_trees_against_plain_loops():
    x, y, _ = _rows(150)
    b = T.binned(x, [T.edges(x[:, i]) for i in range(6)])
    forest, gains = T.forest(b, y.astype(float), range(4, 9), 3)
    assert len(forest.roots) == 5 and abs(gains.sum() - 5) < 1e-9
    assert np.allclose(forest.leaves(b), [[_walk(forest, t, r) for t in range(5)] for r in b])
    whole, _ = T.forest_tree(b, y.astype(float), np.ones(len(y), int), np.random.default_rng(0))
    leaves = {}
    for r, v in zip(b, y):
        leaves.setdefault(r.tobytes(), []).append(v)
    e = T.Ensemble.of([whole])
    assert all(abs(e.leaves(np.frombuffer(r, np.uint8)[None])[0, 0] - np.mean(v)) < 1e-9 for r, v in leaves.items() if len(set(v)) == 1)  # grown until pure
    start, trees, _ = T.boosted(b, y.astype(float), 1, 1.0, depth=1)
    g = y - y.mean()
    best = max((g[b[:, c] <= k].sum() ** 2 / (b[:, c] <= k).sum() + g[b[:, c] > k].sum() ** 2 / (b[:, c] > k).sum(), c, k) for c in range(6) for k in range(b[:, c].max()))
    assert (trees.column[0], trees.cut[0]) == best[1:] or abs(best[0] - (g[b[:, trees.column[0]] <= trees.cut[0]].sum() ** 2 / (b[:, trees.column[0]] <= trees.cut[0]).sum() + g[b[:, trees.column[0]] > trees.cut[0]].sum() ** 2 / (b[:, trees.column[0]] > trees.cut[0]).sum())) < 1e-9
    left = b[:, trees.column[0]] <= trees.cut[0]
    h = y.mean() * (1 - y.mean())
    assert np.allclose(trees.leaves(b)[:, 0], np.where(left, g[left].sum() / (h * left.sum()), g[~left].sum() / (h * (~left).sum())))
    start, some, splits = T.boosted_leafwise(b, y.astype(float), 20, 0.1, 7, 0.8, 1, least=5)
    assert np.diff(np.append(some.roots, len(some.column))).max() <= 13 and splits.sum() == (some.column >= 0).sum()
    loss = lambda f: np.logaddexp(0, f).mean() - (y * f).mean()
    assert loss(start + some.total(b)) < loss(np.full(len(y), start))
    again = T.Ensemble.unpacked(some.packed())
    assert (again.total(b) == some.total(b)).all()


def test_contributions_sum_to_the_difference_from_the_background():
    rng = np.random.default_rng(5)
    x, y, _ = _rows(200)
    b = T.binned(x, [T.edges(x[:, i]) for i in range(6)])
    start, trees, _ = T.boosted(b, y.astype(float), 15, 0.3)
    score = lambda v: T._sigmoid(start + trees.total(v))
    back, rows, order = b[:9], b[50:62], rng.permutation(6)
    got = M.permutation_contributions(score, back, rows, order)
    assert np.abs(got.sum(axis=1) - (score(rows) - score(back).mean())).max() < 1e-9
    for i, row in enumerate(rows):
        want = np.zeros(6)
        for turn in (order, order[::-1]):
            for one in back:
                now = one.copy()
                for c in turn:
                    before = score(now[None])[0]
                    now[c] = row[c]
                    want[c] += (score(now[None])[0] - before) / 18
        assert np.abs(want - got[i]).max() < 1e-9


def test_fits_of_large_tables_go_to_spark_ml(spark, monkeypatch):
    folds = _encoded(spark, (1,))
    monkeypatch.setattr(M, "IN_MEMORY", 0)
    assert not folds[0].fits()
    with pytest.raises(M.ConstraintError, match="IN_MEMORY"):
        M.fit_trees(folds, [(1, "all", "gbt")], {(1, "all"): np.arange(6)}, M.FitRules(2, 2, 2))
    monkeypatch.setattr(T, "DEEPEST", 6)
    p, gains = M.fit_large(folds[0], np.arange(6), "all", "random_forest", M.FitRules(3, 2, 2))
    rows = p.collect()
    assert len(rows) == 80 and all(0 <= r["probability"] <= 1 for r in rows) and len(gains) == 6


def test_forests_in_parts_are_one_forest(spark, monkeypatch):
    folds, wanted, rules = _encoded(spark, (1,)), {(1, "all"): np.arange(6)}, M.FitRules(7, 3, 3)
    one = {r["visit_id"]: r["probability"] for r in M.tree_predictions(M.fit_trees(folds, [(1, "all", "random_forest")], wanted, rules), rules).collect()}
    monkeypatch.setattr(M, "TREES_AT_ONCE", 2)
    parts = M.fit_trees(folds, [(1, "all", "random_forest")], wanted, rules)
    two = {r["visit_id"]: r["probability"] for r in M.tree_predictions(parts, rules).collect()}
    assert parts.count() == 4 and set(one) == set(two) and all(abs(one[i] - two[i]) < 1e-12 for i in one)


def test_store_makes_a_table_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    store = Store(spark, "test-store", fingerprint(spark, [str(tmp_path)], tmp_path.name))
    assert store.table("a", make).count() == 3 and store.table("a", make).count() == 3 and len(made) == 1
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store.root}/a/_SUCCESS")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    assert store.table("a", make).count() == 3 and len(made) == 2  # one that was not written whole is replaced
    (tmp_path / "f").write_text("x")
    first = fingerprint(spark, [str(tmp_path)])
    (tmp_path / "f").write_text("xy")
    assert fingerprint(spark, [str(tmp_path)]) != first


def test_large_contributions_equal_those_of_a_local_score(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (200, 4)).astype(float)
    df = spark.createDataFrame([(i, 1 + i % 5, int(v[0] + v[2] > 3), [float(c) for c in v]) for i, v in enumerate(x)], "visit_id long, fold int, outcome int, x array<double>")
    e = M.Encoded(1, df, list("abcd"), list("abcd"), x.mean(axis=0), x.std(axis=0), 200)
    for model in ("random_forest", "gbt"):
        fitted = M.large_model(e, np.arange(4), model, M.FitRules(3, 3, 3))
        score = lambda v: np.array([fitted.predictProbability(Vectors.dense(r))[1] for r in v])  # noqa: B023, E731
        order = np.array([2, 0, 3, 1])
        want = np.abs(M.permutation_contributions(score, x[:5], x[50:53], order)).mean(axis=0)
        got = {r["column"]: r["mean_abs"] for r in M.large_contributions(fitted, spark, x[:5], x[50:53], order).collect()}
        assert want.max() > 0 and all(abs(got.get(i, 0.0) - v) < 1e-12 for i, v in enumerate(want))


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_attribution_of_tables_beyond_memory(spark, monkeypatch):
    monkeypatch.setattr(M, "IN_MEMORY", 0)
    monkeypatch.setattr(model_queries, "RULES", M.FitRules(3, 2, 2))
    monkeypatch.setattr(model_queries, "FOLDS", (1,))
    monkeypatch.setattr(model_queries, "MATRICES", {"baseline": (), "baseline_procedures": ("procedures",)})
    monkeypatch.setattr(model_queries.Run, "best", lambda self: {"baseline": "random_forest", "baseline_procedures": "logistic"})
    rows = QUERIES["attribution"](spark, D).collect()
    assert {(r["matrix"], r["model"]) for r in rows} == {("baseline", "random_forest"), ("baseline_procedures", "logistic")}
    assert {"age", "sex", "visit_type"} == {r["feature"] for r in rows if r["matrix"] == "baseline"} and max(r["mean_abs"] for r in rows if r["matrix"] == "baseline") > 0
