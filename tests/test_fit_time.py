"""What makes all fits take long is done once: levels of many trees together, moments of columns by batches, the choice of models."""

import os

import numpy as np
import pytest

from tidewater.operators import modeling as M
from tidewater.operators import trees as T
from tidewater.plans import QUERIES, model_queries

D = "/root/testdata/sf0.001"


def _rows(n=400):
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 3, (n, 9)).astype(np.uint8), axis=0)
    n = rng.integers(1, 9, len(x))
    return x, rng.binomial(n, 0.2 + 0.2 * (x[:, 0] > 1)), n


def test_trees_side_by_side_are_those_grown_alone(monkeypatch):
    x, y, n = _rows()
    searches = []
    search = T._best_gini
    monkeypatch.setattr(T, "_best_gini", lambda *a: searches.append(1) or search(*a))
    each = [T.forest(x, y, range(t, t + 1), 5, weight=n) for t in range(20)]
    alone, searches[:] = len(searches), []
    together, gains = T.forest(x, y, range(20), 5, weight=n)
    assert len(searches) < alone / 4  # a level of all trees is one search
    one = T.Ensemble.of([(e.column, e.cut, e.left, e.value) for e, _ in each])
    for c in ("column", "cut", "left", "value", "roots"):
        assert (getattr(one, c) == getattr(together, c)).all()
    assert (sum(g for _, g in each) == gains).all()


def test_best_split_by_a_plain_loop():
    """Of equal gains the first drawn column and the least cut count."""
    x, y, n = _rows(60)
    node, w, wy = np.arange(len(x)) % 5, n.astype(float), y.astype(float)
    total, hits = np.bincount(node, w), np.bincount(node, wy)
    drawn = np.array([[i, (i + 3) % 9, 8 - i] for i in range(5)])
    gain, column, cut = T._best_gini(x, np.arange(len(x)), node, w, wy, total, hits, drawn)
    part = lambda m, p: (p**2 + (m - p) ** 2) / m
    for k in range(5):
        best = (0.0, None, None)
        for c in drawn[k]:
            for at in range(T.BINS - 1):
                own = (node == k) & (x[:, c] <= at)
                m, p = w[own].sum(), wy[own].sum()
                if 0 < m < total[k] and (g := part(m, p) + part(total[k] - m, hits[k] - p) - part(total[k], hits[k])) > best[0]:
                    best = (g, c, at)
        assert (gain[k], column[k], cut[k]) == best


def test_moments_by_batches(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack((rng.normal(1e6, 1, 500), np.full(500, 0.1), np.where(np.arange(500) % 5 == 2, 7.0, 3.3), rng.random(500)))
    df = spark.createDataFrame([(i, i % 5, int(i % 3 == 0), *map(float, r)) for i, r in enumerate(x)], "visit_id long, fold int, outcome int, a double, b double, c double, d double").repartition(7)
    table, columns = M.encoded(df, 2, list("abcd"), [], {}, {})
    train = np.arange(500) % 5 != 2
    assert [c[0] for c in columns] == ["a", "d"]  # b has one value, c one among training rows
    for (_, _, mean, sd, n, rows), i in zip(columns, (0, 3)):
        assert (n, rows) == (400, 500) and abs(mean - x[train, i].mean()) < 1e-9 and abs(sd - x[train, i].std()) < 1e-9
    got = {r["visit_id"]: r["x"] for r in table.collect()}
    assert all(got[i] == [x[i, 0], x[i, 3]] for i in range(500))
    with pytest.raises(M.ConstraintError, match="one class"):
        M.encoded(df.filter("fold = 2 or outcome = 0"), 2, list("abcd"), [], {}, {})
    with pytest.raises(M.ConstraintError, match="one class"):
        M.encoded(df.filter("fold = 2"), 2, list("abcd"), [], {}, {})


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_refit_check_chooses_models_once(spark, monkeypatch):
    monkeypatch.setattr(model_queries, "RULES", M.FitRules(2, 2, 2))
    monkeypatch.setattr(model_queries, "FOLDS", (1,))
    monkeypatch.setattr(model_queries, "MATRICES", {"baseline": (), "baseline_procedures": ("procedures",)})
    chosen, best = [], model_queries.Run.best
    monkeypatch.setattr(model_queries.Run, "best", lambda self: chosen.append(1) or best(self))
    rows = QUERIES["refit_check"](spark, D).collect()
    assert len(rows) == 2 and len(chosen) == 1 and all(r["unmatched"] == 0 and r["max_difference"] < 1e-9 for r in rows)
