"""Fits of four classifiers on many matrices and folds, their out-of-fold predictions, importance and attribution.

A fold's columns are encoded once for all its matrices. All logistic fits take their Newton steps together: one pass over the encoded
tables sums the gradients and Gram blocks of every fold and matrix. Rows that are equal are counted before: those of equal columns for
logistic fits, those of equal bins for trees. Tree fits are tasks of one Spark job: each reads the distinct rows of bins of its fold,
which are broadcast if their size is within ``IN_MEMORY``; tables with more are fitted by Spark ML, one fit after another.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.normalise import unit_hash
from tidewater.operators import trees as T
from tidewater.operators.audit import ConstraintError
from tidewater.operators.numbering import numbered


@dataclass(frozen=True)
class FitRules:
    trees: int = 300
    boost_rounds: int = 100
    small_step_rounds: int = 500
    seed: int = 42


#: Fixed order of models, which also settles ties.
MODELS = ("logistic", "random_forest", "gbt", "gbt_small_step")
#: The most bytes of a fold's distinct rows of bins, eight a cell, for which its trees are grown in single tasks.
IN_MEMORY = 128 << 20
#: Trees of a forest that one task grows.
TREES_AT_ONCE = 75
MISSING = "__MISSING__"


# ---------------------------------------------------------------- encoding


@dataclass
class Encoded:
    """A fold's table (visit_id, fold, outcome, x) and what its columns are: name, source, mean and deviation among training rows."""

    fold: int
    table: DataFrame
    names: list[str]
    sources: list[str]
    mean: np.ndarray
    sd: np.ndarray
    rows: int
    groups: int | None = None  # distinct rows of bins, where they have been counted

    def columns(self, sources: Iterable[str]) -> np.ndarray:
        own = set(sources)
        return np.array([i for i, s in enumerate(self.sources) if s in own], np.int64)

    def fits(self) -> bool:
        return (self.rows if self.groups is None else self.groups) * max(1, len(self.names)) * 8 <= IN_MEMORY


def encoded(df: DataFrame, fold: int, numeric: list[str], categorical: list[str], medians: dict[str, float], levels: dict[str, list[str]]) -> tuple[DataFrame, list[tuple]]:
    """(table, columns): values with the training medians and one column for each training level; columns without variance among training rows go.

    Levels that training rows lack have zeros everywhere; a column of nulls is zero. Columns are (name, source, mean, sd, training rows, rows).
    """
    cols = [(c, c, F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(medians.get(c) or 0.0)))) for c in numeric]
    cols += [(f"{c}={v}", c, (F.coalesce(F.col(f"`{c}`"), F.lit(MISSING)) == v).cast("double")) for c in categorical for v in levels[c]]
    known = df.select("visit_id", "fold", F.col("outcome").cast("int").alias("outcome"), F.array(*[c for *_, c in cols]).alias("x"))
    one = _moments(known, fold)
    if one["classes"] < 2:
        raise ConstraintError(f"training rows of fold {fold} have one class")
    kept = [(name, source, float(one["mean"][i]), float(one["sd"][i]), c) for i, (name, source, c) in enumerate(cols) if one["sd"][i] > 0]
    table = df.select("visit_id", "fold", F.col("outcome").cast("int").alias("outcome"), F.array(*[c for *_, c in kept]).alias("x"))
    return table, [(name, source, m, s, one["train"], one["rows"]) for name, source, m, s, _ in kept]


def _moments(table: DataFrame, fold: int) -> dict:
    """Rows, training rows and their classes, and the means and population deviations of their columns; a column of one value has deviation 0.

    Tasks hand on sums of squares about their own means, a row for each fold, and pairs of them are put together.
    """

    def run(batches):
        rows, train, mean, square, classes = 0, 0, 0.0, 0.0, set()
        for batch in batches:
            rows += batch.num_rows
            own = batch.filter(pc.not_equal(batch.column("fold"), fold))  # null folds are no training rows
            if not own.num_rows:
                continue
            x = _cells(own, "x")
            middle = x[0] + (x - x[0]).mean(axis=0)  # exact where all values are equal
            train, mean, square = _put_together((train, mean, square), (len(x), middle, ((x - middle) ** 2).sum(axis=0)))
            classes |= set(own.column("outcome").drop_null().unique().to_pylist())
        if rows:
            empty = train == 0
            yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([train]), pa.array([[] if empty else mean], pa.list_(pa.float64())), pa.array([[] if empty else square], pa.list_(pa.float64())), pa.array([sorted(classes)], pa.list_(pa.int32()))], ["rows", "train", "mean", "square", "classes"])

    parts = table.mapInArrow(run, "rows long, train long, mean array<double>, square array<double>, classes array<int>").collect()  # a row for each task
    train, mean, square = reduce(_put_together, [(r["train"], np.array(r["mean"]), np.array(r["square"])) for r in parts if r["train"]], (0, 0.0, 0.0))
    sd = np.sqrt(square / train) if train else np.zeros(0)
    return {"rows": sum(r["rows"] for r in parts), "train": train, "classes": len({c for r in parts for c in r["classes"]}), "mean": mean, "sd": sd}


def _put_together(a: tuple, b: tuple) -> tuple:
    """(rows, means, sums of squares about them) of two sets of rows."""
    n, d = a[0] + b[0], b[1] - a[1]
    if not a[0]:
        return b
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + d * d * (a[0] * b[0] / n)


# ---------------------------------------------------------------- logistic fits


def _cells(batch: pa.RecordBatch, column: str) -> np.ndarray:
    x = batch.column(column)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def logistic(folds: list[Encoded], wanted: dict[tuple[int, str], np.ndarray], most: int = 20) -> dict[tuple[int, str], np.ndarray]:
    """Intercept and weights of standardised columns of each (fold, matrix): the log loss plus half the square of the weights is least.

    ``wanted`` gives the matrices' columns. All fits share each pass over the tables; a step that raised a fit's loss is halved.
    """
    spark = folds[0].table.sparkSession
    parts = [e.table.filter(F.col("fold") != e.fold).groupBy("outcome", "x").agg(F.count(F.lit(1)).alias("n")).select(F.lit(e.fold).alias("of"), "outcome", "n", "x") for e in folds]
    rows = reduce(DataFrame.unionByName, parts).persist()
    scale = {e.fold: (e.mean, e.sd) for e in folds}
    w = {k: np.zeros(len(c) + 1) for k, c in wanted.items()}
    before: dict = {k: (np.inf, None) for k in wanted}
    going = set(wanted)
    for _ in range(most):
        now = spark.sparkContext.broadcast(({k: w[k] for k in going}, wanted, scale))

        def sums(batches):
            w, wanted, scale = now.value
            total: dict = {}
            for batch in batches:
                of = batch.column("of").to_numpy()
                for fold in np.unique(of):
                    part = batch.filter(pa.array(of == fold))
                    mean, sd = scale[fold]
                    z = np.hstack((np.ones((part.num_rows, 1)), (_cells(part, "x") - mean) / sd))
                    y, n = part.column("outcome").to_numpy(), part.column("n").to_numpy().astype(float)
                    for key in (k for k in w if k[0] == fold):
                        own = z[:, np.append(0, wanted[key] + 1)]
                        eta = own @ w[key]
                        p = T._sigmoid(eta)
                        got = (float(n @ (np.logaddexp(0, eta) - y * eta)), own.T @ (n * (y - p)), (own * (n * p * (1 - p))[:, None]).T @ own)
                        total[key] = tuple(a + b for a, b in zip(total[key], got)) if key in total else got
            for (fold, matrix), (loss, g, h) in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([int(fold)], pa.int32()), pa.array([matrix]), pa.array([np.concatenate(([loss], g, h.ravel()))], pa.list_(pa.float64()))], ["of", "matrix", "s"])

        def added(group):
            s = group.column("s").combine_chunks()
            total = s.flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1).sum(axis=0)
            return pa.table({"of": group.column("of").slice(0, 1), "matrix": group.column("matrix").slice(0, 1), "s": pa.array([total], pa.list_(pa.float64()))})

        schema = "of int, matrix string, s array<double>"
        for r in rows.mapInArrow(sums, schema).groupBy("of", "matrix").applyInArrow(added, schema).collect():  # one row for each fit
            key = (r["of"], r["matrix"])
            n, s = len(w[key]), np.array(r["s"])
            ridge = np.append(0.0, np.ones(n - 1))
            loss = s[0] + 0.5 * float(ridge @ w[key] ** 2)
            if loss > before[key][0] * (1 + 1e-12) + 1e-12:
                w[key] = (w[key] + before[key][1]) / 2
                continue
            before[key] = (loss, w[key])
            step = np.linalg.solve(s[1 + n :].reshape(n, n) + np.diag(ridge), s[1 : 1 + n] - ridge * w[key])
            w[key] = w[key] + step
            if np.abs(step).max() < 1e-9:
                going.discard(key)
        now.unpersist()
        if not going:
            break
    rows.unpersist()
    return w


def logistic_predictions(folds: list[Encoded], wanted: dict[tuple[int, str], np.ndarray], w: dict[tuple[int, str], np.ndarray]) -> DataFrame:
    """(visit_id, fold, matrix, model, probability) of each fold's own rows."""
    shared = folds[0].table.sparkSession.sparkContext.broadcast((w, wanted))
    out = []
    for e in folds:

        def run(batches, fold=e.fold, mean=e.mean, sd=e.sd):
            w, wanted = shared.value
            for batch in batches:
                z = (_cells(batch, "x") - mean) / sd
                for key in (k for k in w if k[0] == fold):
                    p = T._sigmoid(w[key][0] + z[:, wanted[key]] @ w[key][1:])
                    n = len(p)
                    yield pa.RecordBatch.from_arrays([batch.column("visit_id"), pa.array(np.full(n, fold, np.int32)), pa.array([key[1]] * n), pa.array(["logistic"] * n), pa.array(p)], ["visit_id", "fold", "matrix", "model", "probability"])

        out.append(e.table.filter(F.col("fold") == e.fold).select("visit_id", "x").mapInArrow(run, "visit_id long, fold int, matrix string, model string, probability double"))
    return reduce(DataFrame.unionByName, out)


# ---------------------------------------------------------------- tree fits

FITTED = "of int, matrix string, model string, first int, start double, trees binary, gains array<double>, ids array<long>, sums array<double>"


def _of(folds: list[Encoded]) -> DataFrame:
    return reduce(DataFrame.unionByName, [e.table.select(F.lit(e.fold).alias("of"), "visit_id", F.col("fold").cast("int").alias("fold"), "outcome", "x") for e in folds])


def cuts(folds: list[Encoded]) -> DataFrame:
    """(of, i, cuts) of each fold's columns, from counts of their training values; a column's distinct values meet in one task."""

    def merged(parts):
        values, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
        return values, np.bincount(at, np.concatenate([n for _, n in parts]), len(values)).astype(np.int64)

    def counted(batches):
        found: dict = {}
        for batch in batches:
            of = batch.column("of").to_numpy()
            for fold in np.unique(of):
                x = _cells(batch.filter(pa.array(of == fold)), "x")
                for i in range(x.shape[1]):
                    parts = found.setdefault((int(fold), i), [])
                    parts.append(np.unique(x[:, i], return_counts=True))
                    if len(parts) > 16:
                        parts[:] = [merged(parts)]
        for (fold, i), parts in found.items():
            values, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([i], pa.int32()), pa.array([values], pa.list_(pa.float64())), pa.array([n], pa.list_(pa.int64()))], ["of", "i", "v", "n"])

    def cut(group):
        parts = [(v.values.to_numpy(), n.values.to_numpy()) for v, n in zip(group.column("v"), group.column("n"))]
        return pa.table({"of": group.column("of").slice(0, 1), "i": group.column("i").slice(0, 1), "cuts": pa.array([T.edges(*merged(parts))], pa.list_(pa.float64()))})

    rows = _of(folds).filter("fold != of").select("of", "x").mapInArrow(counted, "of int, i int, v array<double>, n array<long>")
    return rows.groupBy("of", "i").applyInArrow(cut, "of int, i int, cuts array<double>")


def cuts_by_fold(found: DataFrame) -> dict[int, list[np.ndarray]]:
    out: dict = {}
    for r in sorted(found.collect(), key=lambda r: (r["of"], r["i"])):  # columns by folds
        out.setdefault(r["of"], []).append(np.array(r["cuts"], float))
    return out


def binned(folds: list[Encoded], by_fold: dict[int, list[np.ndarray]]) -> DataFrame:
    """(of, visit_id, fold, outcome, bins): a byte for each column."""

    def run(batches):
        for batch in batches:
            of = batch.column("of").to_numpy()
            for fold in np.unique(of):
                part = batch.filter(pa.array(of == fold))
                x = np.ascontiguousarray(T.binned(_cells(part, "x"), by_fold[int(fold)]))
                ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                bins = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("of", "visit_id", "fold", "outcome")], bins], ["of", "visit_id", "fold", "outcome", "bins"])

    return _of(folds).mapInArrow(run, "of int, visit_id long, fold int, outcome int, bins binary")


def groups(rows: DataFrame) -> DataFrame:
    """(of, bins, g, n, pos, own) of ``binned`` rows: the distinct bins of each fold, numbered in order, with how many training rows, positive ones and own rows have them."""
    own = F.col("fold") == F.col("of")
    per = rows.groupBy("of", "bins").agg(F.count_if(~own).alias("n"), F.count_if(~own & (F.col("outcome") == 1)).alias("pos"), F.count_if(own).alias("own"))
    return numbered(per, [F.col("of"), F.col("bins")], "g")


def members(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(visit_id, fold, g): the group of each row in its own fold."""
    return rows.filter("fold = of").join(found.select("of", "bins", "g"), ["of", "bins"]).select("visit_id", "fold", "g")


def _held(found: DataFrame, fold: int) -> dict:
    """A fold's groups in order; the caller has checked their size."""
    t = found.filter(F.col("of") == fold).toArrow().combine_chunks().sort_by("g")
    x = np.frombuffer(b"".join(t.column("bins").to_pylist()), np.uint8).reshape(t.num_rows, -1)
    return {"x": x, **{c: t.column(c).to_numpy() for c in ("g", "n", "pos", "own")}}


def fit_trees(folds: list[Encoded], fits: list[tuple[int, str, str]], wanted: dict[tuple[int, str], np.ndarray], rules: FitRules, found: DataFrame | None = None) -> DataFrame:
    """A row (FITTED) for each part of a fit: its trees, their importances by column of the matrix, and sums over trees for the groups of the fold's own rows.

    ``fits`` are (fold, matrix, model); a forest is grown in parts of TREES_AT_ONCE trees. ``found`` are the ``groups`` of the folds,
    which are made if they are not given.
    """
    spark = folds[0].table.sparkSession
    if large := [e.fold for e in folds if not e.fits()]:
        raise ConstraintError(f"tables of folds {large} are beyond IN_MEMORY")
    if found is None:
        found = groups(binned(folds, cuts_by_fold(cuts(folds))))
    held = spark.sparkContext.broadcast({e.fold: _held(found, e.fold) for e in folds})
    specs = []
    for k, matrix, model in fits:
        firsts = range(0, rules.trees, TREES_AT_ONCE) if model == "random_forest" else (0,)
        specs += [(k, matrix, model, first) for first in firsts]
    specs.sort(key=lambda s: -len(wanted[s[0], s[1]]))  # the longest first

    def run(batches):
        for batch in batches:
            for k, matrix, model, first in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                at = held.value[k]
                rows, place = T.distinct(at["x"][:, wanted[k, matrix]])
                n, pos, own = (np.bincount(place, at[c], len(rows)).astype(np.int64) for c in ("n", "pos", "own"))
                x, y, n = rows[n > 0], pos[n > 0], n[n > 0]
                start = 0.0
                if model == "random_forest":
                    e, gains = T.forest(x, y, range(first, min(rules.trees, first + TREES_AT_ONCE)), rules.seed, weight=n)
                elif model == "gbt":
                    start, e, gains = T.boosted(x, y, rules.boost_rounds, 0.1, weight=n)
                else:
                    start, e, gains = T.boosted_leafwise(x, y, rules.small_step_rounds, 0.03, 31, 0.8, rules.seed, weight=n)
                sums = np.zeros(len(rows))
                sums[own > 0] = e.total(rows[own > 0])
                asked = at["own"] > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([matrix]), pa.array([model]), pa.array([first], pa.int32()), pa.array([start]), pa.array([e.packed()], pa.binary()), pa.array([gains], pa.list_(pa.float64())), pa.array([at["g"][asked]], pa.list_(pa.int64())), pa.array([sums[place[asked]]], pa.list_(pa.float64()))],
                    [f.split()[0] for f in FITTED.split(", ")],
                )

    table = spark.createDataFrame([(i, *s) for i, s in enumerate(specs)], "i int, of int, matrix string, model string, first int")
    return table.repartitionByRange(len(specs), "i").mapInArrow(run, FITTED)


def tree_predictions(fitted: DataFrame, rules: FitRules, own: DataFrame | None = None) -> DataFrame:
    """(visit_id, fold, matrix, model, probability) of the ``members`` in ``own`` from the sums of the parts of fits; without them, the group's number is the visit_id."""
    each = fitted.select("of", "matrix", "model", "start", F.explode(F.arrays_zip("ids", "sums")).alias("r"))
    total = each.groupBy(F.col("r.ids").alias("g"), F.col("of").alias("fold"), "matrix", "model").agg(F.max("start").alias("start"), F.sum("r.sums").alias("s"))
    p = F.when(F.col("model") == "random_forest", F.least(F.lit(1.0), F.col("s") / rules.trees)).otherwise(1 / (1 + F.exp(-(F.col("start") + F.col("s")))))
    per = total.select("g", "fold", "matrix", "model", p.alias("probability"))
    if own is None:
        return per.withColumnRenamed("g", "visit_id")
    packed = per.groupBy("g", "fold").agg(F.collect_list(F.struct("matrix", "model", "probability")).alias("p"))  # as many as matrices and models
    return own.join(packed, ["g", "fold"]).select("visit_id", "fold", F.explode("p").alias("p")).select("visit_id", "fold", "p.*")


def importance(names: list[str], values: np.ndarray) -> list[tuple[str, float]]:
    """(feature, importance), largest first, then by name."""
    return sorted(((c, float(v)) for c, v in zip(names, values)), key=lambda x: (-x[1], x[0]))


# ---------------------------------------------------------------- fits of tables beyond IN_MEMORY


def classifier(name: str, rules: FitRules):
    common = {"featuresCol": "features", "labelCol": "outcome"}
    if name == "random_forest":
        return RandomForestClassifier(**common, numTrees=rules.trees, maxDepth=T.DEEPEST, seed=rules.seed)
    if name == "gbt":
        return GBTClassifier(**common, maxIter=rules.boost_rounds, maxDepth=3, stepSize=0.1, seed=rules.seed)
    if name == "gbt_small_step":
        return GBTClassifier(**common, maxIter=rules.small_step_rounds, maxDepth=5, stepSize=0.03, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=rules.seed)
    raise ValueError(name)


def _features(e: Encoded, columns: np.ndarray) -> DataFrame:
    x = array_to_vector(F.array(*[F.col("x")[int(i)] for i in columns])).alias("features")
    return e.table.select("visit_id", "fold", F.col("outcome").cast("double").alias("outcome"), x)


def large_model(e: Encoded, columns: np.ndarray, model: str, rules: FitRules):
    """One fit by Spark ML: rows stay distributed; its trees are cut at Spark's 32 bins."""
    return Pipeline(stages=[classifier(model, rules)]).fit(_features(e, columns).filter(F.col("fold") != e.fold)).stages[-1]


def large_predictions(fitted, e: Encoded, columns: np.ndarray, matrix: str, model: str) -> DataFrame:
    out = fitted.transform(_features(e, columns).filter(F.col("fold") == e.fold))
    return out.select("visit_id", F.lit(e.fold).cast("int").alias("fold"), F.lit(matrix).alias("matrix"), F.lit(model).alias("model"), vector_to_array("probability")[1].alias("probability"))


def fit_large(e: Encoded, columns: np.ndarray, matrix: str, model: str, rules: FitRules) -> tuple[DataFrame, np.ndarray]:
    """(predictions, importances) of one fit by Spark ML."""
    fitted = large_model(e, columns, model, rules)
    return large_predictions(fitted, e, columns, matrix, model), fitted.featureImportances.toArray()


def loaded(model: str, path: str):
    return (RandomForestClassificationModel if model == "random_forest" else GBTClassificationModel).load(path)


# ---------------------------------------------------------------- attribution


def turned(background: np.ndarray, row: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, places, columns): each background row, then that row after each column in ``turn`` that changes it; the places of the changed rows and their columns."""
    differ = background[:, turn] != row[turn]  # background rows by step
    b, step = np.nonzero(differ)
    # one row for the start of each background row and one for each step that changes it
    counts = differ.sum(axis=1)
    first = np.concatenate(([0], np.cumsum(counts + 1)))[:-1]
    mixed = np.repeat(background, counts + 1, axis=0)
    place = np.arange(len(mixed)) - np.repeat(first, counts + 1)
    rank = np.cumsum(differ, axis=1)  # how many changes a step and those before have made
    on = rank[np.repeat(np.arange(len(background)), counts + 1)] <= place[:, None]
    mixed[:, turn] = np.where(on, row[turn], mixed[:, turn])
    return mixed, np.repeat(first, counts) + rank[b, step], turn[step]


def permutation_contributions(score, background: np.ndarray, rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """(rows, columns): the mean change of the score as columns turn one by one from background rows to a row's own, there and back.

    Columns turn in ``order``, then in its reverse; a column whose values agree changes nothing and is not scored. Contributions of a
    row sum to its score less the background's mean.
    """
    total = np.zeros(rows.shape)
    for turn in (order, order[::-1]):
        for i, row in enumerate(rows):
            mixed, at, column = turned(background, row, turn)
            p = score(mixed)
            np.add.at(total[i], column, (p[at] - p[at - 1]) / len(background) / 2)
    return total


def large_contributions(fitted, spark, background: np.ndarray, rows: np.ndarray, order: np.ndarray) -> DataFrame:
    """(column, mean_abs): the means of absolute ``permutation_contributions`` of a model of Spark ML, whose turned rows are scored as a table."""

    def turn(batches):
        for batch in batches:
            for i in batch.column("id").to_pylist():
                for way in (0, 1):
                    mixed, at, column = turned(background, rows[i], order[::-1] if way else order)
                    of = np.full(len(mixed), -1, np.int32)
                    of[at] = column
                    n = len(mixed)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(np.full(n, way, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(of), pa.array(list(mixed), pa.list_(pa.float64()))], ["i", "way", "place", "column", "x"])

    made = spark.range(0, len(rows), 1, max(1, len(rows))).mapInArrow(turn, "i int, way int, place int, column int, x array<double>")
    p = fitted.transform(made.withColumn("features", array_to_vector("x"))).select("i", "way", "place", "column", vector_to_array("probability")[1].alias("p"))
    moved = p.withColumn("d", F.col("p") - F.lag("p").over(Window.partitionBy("i", "way").orderBy("place"))).filter("column >= 0")
    each = moved.groupBy("i", "column").agg(F.abs(F.sum("d") / len(background) / 2).alias("v"))
    return each.groupBy("column").agg((F.sum("v") / len(rows)).alias("mean_abs"))


def sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    """All rows if there are at most ``n``, else those of least hash of the visit."""
    return df.withColumn("__h", unit_hash(F.concat_ws("|", F.lit(str(seed)), F.col("visit_id").cast("string")))).orderBy("__h", "visit_id").limit(n).drop("__h")
