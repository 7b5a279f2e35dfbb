"""Fits over rows that are counted by their bins."""

import numpy as np

from tidewater.operators import modeling as M
from tidewater.operators import trees as T


def test_counted_rows_give_the_trees_of_all_rows():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (3000, 3)).astype(np.uint8)
    y = (rng.random(3000) < 0.2 + 0.2 * (x[:, 0] > 1)).astype(float)
    rows, place = T.distinct(x)
    n, pos = np.bincount(place), np.bincount(place, y)
    assert len(rows) == 64 and (rows[place] == x).all()
    v, c = np.unique(rng.normal(size=500).round(2), return_counts=True)
    assert np.allclose(T.edges(v, c), T.edges(np.repeat(v, c))) and np.allclose(T.edges(v, c), np.unique(np.quantile(np.repeat(v, c), np.linspace(0, 1, T.BINS + 1)[1:-1])))
    start, e, gains = T.boosted(x, y, 10, 0.3)
    start2, e2, gains2 = T.boosted(rows, pos, 10, 0.3, weight=n)
    assert abs(start - start2) < 1e-12 and np.abs(e.total(x) - e2.total(rows)[place]).max() < 1e-9 and np.abs(gains - gains2).max() < 1e-9
    # a sample of every row has no draw in it
    start, e, used = T.boosted_leafwise(x, y, 10, 0.3, 8, 1.0, 7)
    start2, e2, used2 = T.boosted_leafwise(rows, pos, 10, 0.3, 8, 1.0, 7, weight=n)
    assert abs(start - start2) < 1e-12 and np.abs(e.total(x) - e2.total(rows)[place]).max() < 1e-9 and (used == used2).all()
    forest, _ = T.forest(rows, pos, range(60), 3, weight=n)
    assert np.abs(forest.total(rows) / 60 - pos / n).max() < 0.1  # leaves are single groups, whose draws keep their shares


def test_a_table_of_many_equal_rows_is_fitted_in_tasks(spark, monkeypatch):
    """Rows are beyond the bound, distinct ones are not: before, each of the 160 fits of such a table went to Spark ML."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (900, 3)).astype(float)
    y, fold = (rng.random(900) < 0.3 + 0.3 * (x[:, 1] > 1)).astype(int), 1 + np.arange(900) % 5
    df = spark.createDataFrame([(i, int(fold[i]), int(y[i]), x[i].tolist()) for i in range(900)], "visit_id long, fold int, outcome int, x array<double>").repartition(3)
    monkeypatch.setattr(M, "IN_MEMORY", 27 * 3 * 8)
    e = M.Encoded(2, df, list("abc"), list("abc"), x.mean(axis=0), x.std(axis=0), 900)
    assert not e.fits()
    binned = M.binned([e], M.cuts_by_fold(M.cuts([e]))).persist()
    found = M.groups(binned).persist()
    e.groups = found.count()
    assert e.groups == 27 and e.fits()
    own, rules, wanted = M.members(binned, found), M.FitRules(20, 5, 5), {(2, "all"): np.arange(3)}
    models = ("random_forest", "gbt", "gbt_small_step")
    rows = M.tree_predictions(M.fit_trees([e], [(2, "all", m) for m in models], wanted, rules, found), rules, own).collect()
    assert {(r["visit_id"], r["model"]) for r in rows} == {(i, m) for i in range(900) if fold[i] == 2 for m in models} and len(rows) == 540
    b, train = T.binned(x, [T.edges(x[fold != 2, i]) for i in range(3)]), fold != 2
    start, trees, _ = T.boosted(b[train], y[train].astype(float), 5, 0.1)
    want = T._sigmoid(start + trees.total(b))
    assert all(abs(r["probability"] - want[r["visit_id"]]) < 1e-9 for r in rows if r["model"] == "gbt")
