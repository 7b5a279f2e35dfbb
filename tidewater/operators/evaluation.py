"""Discrimination, calibration, utility and cluster-bootstrap tables.

Rows are counted by (group, score) first; every curve is a running sum over distinct scores in pieces of their range, so neither a
group's rows nor its scores meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.normalise import unit_hash
from tidewater.operators import draws
from tidewater.operators.audit import checked
from tidewater.operators.numbering import piece, place_within, running
from tidewater.operators.verify import with_evidence
from tidewater.sources.shared import frozen


def counts(df: DataFrame, groups: list[str], weight: Column | None = None) -> DataFrame:
    """(groups, p, pos, neg): weighted positives and negatives at each distinct score."""
    w = weight if weight is not None else F.lit(1)
    return df.groupBy(*groups, "p").agg(F.sum(w * F.col("outcome")).alias("pos"), F.sum(w * (1 - F.col("outcome"))).alias("neg"))


def curve(by_score: DataFrame, groups: list[str]) -> DataFrame:
    """Adds tp, fp (at or above the score) and the totals all_pos, all_neg."""
    return running(by_score, groups, "p", ["pos", "neg"], down=True).withColumnsRenamed({"to_pos": "tp", "to_neg": "fp"})


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b != 0, a / b)


def metrics(by_score: DataFrame, groups: list[str], threshold: float = 0.5) -> DataFrame:
    """Eleven metrics for each group; what one class alone leaves undefined is null."""
    c = curve(by_score, groups)
    hit = F.col("p") >= threshold
    n = F.col("pos") + F.col("neg")
    q = F.greatest(F.least(F.col("p").cast("double"), F.lit(1 - 1e-15)), F.lit(1e-15))
    m = c.groupBy(*groups).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(F.col("neg"))).alias("tn"),
        F.max("all_pos").alias("all_pos"),
        F.max("all_neg").alias("all_neg"),
        F.sum(F.col("pos") * (F.col("all_neg") - F.col("fp") + F.col("neg") / 2)).alias("u"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
        F.sum(F.col("pos") * (1 - F.col("p")) * (1 - F.col("p")) + F.col("neg") * F.col("p") * F.col("p")).alias("se"),
        F.sum(-F.col("pos") * F.ln(q) - F.col("neg") * F.ln(1 - q)).alias("ll"),
        F.sum(n).alias("n"),
    )
    return _ratios(m, groups)


def _ratios(m: DataFrame, groups: list[str]) -> DataFrame:
    sens, spec = ratio(F.col("tp"), F.col("all_pos")), ratio(F.col("tn"), F.col("all_neg"))
    return m.select(
        *groups, *[F.col(x).cast("long").alias(x) for x in ("tn", "fp", "fn", "tp")],
        ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), ((sens + spec) / 2).alias("balanced_accuracy"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("ppv"), ratio(F.col("tn"), F.col("tn") + F.col("fn")).alias("npv"), sens.alias("sensitivity"), spec.alias("specificity"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        ratio(F.col("u"), F.col("all_pos") * F.col("all_neg")).alias("auroc"), ratio(F.when(F.col("all_neg") > 0, F.col("ap")), F.col("all_pos")).alias("auprc"),
        (F.col("se") / F.col("n")).alias("brier"), (F.col("ll") / F.col("n")).alias("log_loss"),
    )


METRICS = ("accuracy", "balanced_accuracy", "ppv", "npv", "sensitivity", "specificity", "f1", "auroc", "auprc", "brier", "log_loss")


def metric_summary(fold_metrics: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, metric, mean, sd, valid_folds)."""
    long = fold_metrics.unpivot(groups + ["fold"], list(METRICS), "metric", "value")
    return long.groupBy(*groups, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("valid_folds"))


def best_model(pooled: DataFrame) -> DataFrame:
    order = [F.desc("auprc"), F.desc("auroc"), F.col("brier"), F.col("model")]
    return pooled.withColumn("r", F.row_number().over(Window.partitionBy("matrix").orderBy(*order))).filter("r = 1").drop("r")


def roc(by_score: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, threshold, fpr, tpr): every distinct score, and the origin with a null threshold."""
    c = curve(by_score, groups)
    points = c.select(*groups, F.col("p").alias("threshold"), (F.col("fp") / F.col("all_neg")).alias("fpr"), (F.col("tp") / F.col("all_pos")).alias("tpr"))
    origin = by_score.select(*groups).distinct().select(*groups, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def sensitivity_at(by_score: DataFrame, groups: list[str], target: float = 0.9) -> DataFrame:
    """The threshold of most sensitivity among those of at least the target specificity; then nearest specificity, then largest."""
    c = curve(by_score, groups)
    spec = 1 - F.col("fp") / F.col("all_neg")
    ok = c.select(*groups, F.col("p").alias("threshold"), (F.col("tp") / F.col("all_pos")).alias("sensitivity"), spec.alias("specificity"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("ppv"), (F.col("tp") + F.col("fp")).alias("flagged")).filter(F.col("specificity") >= target)
    order = [F.desc("sensitivity"), F.abs(F.col("specificity") - target), F.desc("threshold")]
    return ok.withColumn("r", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter("r = 1").drop("r")


def top_risk(df: DataFrame, by_score: DataFrame, groups: list[str], fraction: float = 0.1) -> DataFrame:
    """The ceil(fraction n) rows of highest score, ties by visit number: events captured, ppv, enrichment, rows tied at the cut."""
    c = curve(by_score, groups)
    k = F.ceil(F.lit(fraction) * (F.col("all_pos") + F.col("all_neg")))
    above = c.withColumn("k", k).withColumn("at", F.col("tp") + F.col("fp"))
    cut = above.filter(F.col("at") >= F.col("k")).groupBy(*groups).agg(F.max("p").alias("cutoff"), F.first("k").alias("k"), F.first("all_pos").alias("all_pos"), F.first("all_neg").alias("all_neg"))
    over = above.join(cut.select(*groups, "cutoff"), groups).groupBy(*groups).agg(F.sum(F.when(F.col("p") > F.col("cutoff"), F.col("pos")).otherwise(0)).alias("pa"), F.sum(F.when(F.col("p") > F.col("cutoff"), F.col("pos") + F.col("neg")).otherwise(0)).alias("na"))
    tied = df.join(cut.select(*groups, "cutoff"), groups).filter(F.col("p") == F.col("cutoff"))
    tied = place_within(tied, groups, F.shiftright(F.col("n").cast("long"), 16), ["n"], "r")
    some = tied.join(cut.select(*groups, "k").join(over, groups), groups).groupBy(*groups).agg(F.sum(F.when(F.col("r") <= F.col("k") - F.col("na"), F.col("outcome")).otherwise(0)).alias("pt"), F.count(F.lit(1)).alias("ties"), F.count_if(F.col("r") <= F.col("k") - F.col("na")).alias("ties_flagged"))
    out = cut.join(over, groups).join(some, groups).withColumn("captured", F.col("pa") + F.col("pt"))
    return out.select(*groups, F.col("k").cast("long").alias("flagged"), "captured", (F.col("captured") / F.col("all_pos")).alias("capture"), (F.col("captured") / F.col("k")).alias("ppv"), (F.col("captured") / F.col("k") / (F.col("all_pos") / (F.col("all_pos") + F.col("all_neg")))).alias("enrichment"), "cutoff", "ties", "ties_flagged")


def calibration_bins(df: DataFrame, groups: list[str], bins: int = 10) -> DataFrame:
    """Equal-frequency bins floor(i B / n) + 1 of rows by (p, n), with Wilson intervals of the observed rate.

    A row's place is the number of rows of lower scores plus its place among equal ones.
    """
    per = df.groupBy(*groups, "p").agg(F.count(F.lit(1)).alias("c"))
    below = running(per, groups, "p", ["c"]).select(*groups, "p", (F.col("to_c") - F.col("c")).alias("below"), F.col("all_c").alias("total"))
    placed = place_within(df, [*groups, "p"], F.shiftright(F.col("n").cast("long"), 16), ["n"], "i").join(below, [*groups, "p"])
    placed = placed.withColumn("bin", (F.floor((F.col("below") + F.col("i") - 1) * bins / F.col("total")) + 1).cast("long"))
    b = placed.groupBy(*groups, "bin").agg(F.count(F.lit(1)).alias("count"), F.sum("outcome").alias("events"), F.avg("p").alias("mean_p"), F.min("p").alias("min_p"), F.max("p").alias("max_p"))
    z, rate, n = 1.959963984540054, F.col("events") / F.col("count"), F.col("count")
    mid = (rate + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return b.select("*", rate.alias("observed"), F.greatest(F.lit(0.0), mid - half).alias("low"), F.least(F.lit(1.0), mid + half).alias("high"))


def calibration_summary(bins: DataFrame, df: DataFrame, groups: list[str]) -> DataFrame:
    ece = bins.groupBy(*groups).agg((F.sum(F.col("count") * F.abs(F.col("mean_p") - F.col("observed"))) / F.sum("count")).alias("ece"))
    mean = df.groupBy(*groups).agg(F.avg("p").alias("mean_risk"), F.avg("outcome").alias("prevalence"))

    def logit(c: Column) -> Column:
        c = F.greatest(F.least(c, F.lit(1 - 1e-12)), F.lit(1e-12))
        return F.ln(c / (1 - c))

    return mean.join(ece, groups).withColumn("in_the_large", logit(F.col("prevalence")) - logit(F.col("mean_risk")))


def calibration_slope(by_score: DataFrame, groups: list[str], rounds: int = 12) -> DataFrame:
    """(groups, intercept, slope) of a logistic regression of the outcome on the logit: Newton steps for all groups at once."""
    q = F.greatest(F.least(F.col("p").cast("double"), F.lit(1 - 1e-6)), F.lit(1e-6))
    x = by_score.select(*groups, F.ln(q / (1 - q)).alias("x"), "pos", (F.col("pos") + F.col("neg")).alias("w"))
    state = [(0.0, 1.0)]
    keys = [tuple(r) for r in x.select(*groups).distinct().collect()]  # one row for each model
    at = {k: state[0] for k in keys}
    spark = by_score.sparkSession
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.select(*groups).schema)
    x = x.persist()
    for _ in range(rounds):
        now = spark.createDataFrame([(*k, a, b) for k, (a, b) in at.items()], f"{kinds}, a double, b double")
        mu = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("x"))))
        v = F.col("w") * mu * (1 - mu)
        g = x.join(F.broadcast(now), groups).groupBy(*groups).agg(F.sum(F.col("pos") - F.col("w") * mu).alias("g0"), F.sum((F.col("pos") - F.col("w") * mu) * F.col("x")).alias("g1"), F.sum(v).alias("h00"), F.sum(v * F.col("x")).alias("h01"), F.sum(v * F.col("x") * F.col("x")).alias("h11"))
        moved = 0.0
        for r in g.collect():
            k, det = tuple(r[c] for c in groups), r["h00"] * r["h11"] - r["h01"] ** 2
            if abs(det) < 1e-12:
                continue
            da, db = (r["h11"] * r["g0"] - r["h01"] * r["g1"]) / det, (r["h00"] * r["g1"] - r["h01"] * r["g0"]) / det
            at[k] = (at[k][0] + da, at[k][1] + db)
            moved = max(moved, abs(da), abs(db))
        if moved < 1e-10:
            break
    x.unpersist()
    return spark.createDataFrame([(*k, a, b) for k, (a, b) in at.items()], f"{kinds}, intercept double, slope double")


def decision_curve(by_score: DataFrame, groups: list[str], steps: int = 50) -> DataFrame:
    """(groups, threshold, strategy, net_benefit) at 0.01 ... for the model, treating all and none.

    Scores meet the thresholds they reach by a histogram: a score counts at every threshold up to floor(100 p).
    """
    cell = by_score.withColumn("k", F.least(F.floor(F.col("p") * 100 + 1e-9).cast("int"), F.lit(steps))).groupBy(*groups, "k").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = cell.groupBy(*groups).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    grid = total.select(*groups, "all_pos", "all_neg", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("t"))
    c = cell.select(*groups, F.col("k"), "pos", "neg")
    reach = grid.join(c, groups, "left").groupBy(*groups, "t").agg(F.max("all_pos").alias("all_pos"), F.max("all_neg").alias("all_neg"), F.sum(F.when(F.col("k") >= F.col("t"), F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("k") >= F.col("t"), F.col("neg")).otherwise(0)).alias("fp"))
    odds, n = F.col("t") / (100 - F.col("t")), F.col("all_pos") + F.col("all_neg")
    each = F.array(F.struct(F.lit("model").alias("strategy"), (F.col("tp") / n - F.col("fp") / n * odds).alias("net_benefit")), F.struct(F.lit("treat_all").alias("strategy"), (F.col("all_pos") / n - F.col("all_neg") / n * odds).alias("net_benefit")), F.struct(F.lit("treat_none").alias("strategy"), F.lit(0.0).alias("net_benefit")))
    return reach.select(*groups, (F.col("t") / 100).alias("threshold"), F.explode(each).alias("e")).select(*groups, "threshold", "e.*")


#: Patients whose draws become rows at once.
ROWS_AT_ONCE = 1024
#: Rows of one key whose draws are summed at once.
SUMMED = 2048


def bootstrap_weights(patients: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(rep, patient_id, weight): as many draws with replacement as there are patients (patient_id, slot 0..n-1), by hash."""
    w = draws.weights(patients, replicates, seed, ROWS_AT_ONCE)
    own = w.placed(patients.select("patient_id"))

    def unpack(drawn, own):
        counts = draws.block_counts(drawn, replicates)[own.column("at").to_numpy()]
        which, rep = np.nonzero(counts)
        return pa.table({"rep": pa.array((rep + 1).astype(np.int32)), "patient_id": own.column("patient_id").take(pa.array(which)), "weight": pa.array(counts[which, rep].astype(np.int64))})

    kind = patients.schema["patient_id"].dataType.simpleString()
    return w.drawn.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(unpack, f"rep int, patient_id {kind}, weight long")


def _packed_sums(df: DataFrame, weights: draws.Weights, groups: list[str], key: str) -> DataFrame:
    """(groups, key, pos, neg): weighted positives and negatives at each key, arrays over replicates as bytes, once for each block of patients.

    Rows are counted for each patient and key, then meet the draws of their patient's block: an array is made for each key, none for a row.
    """
    names, reps = [*groups, key], weights.replicates
    own = weights.placed(df).groupBy("patient_id", "block", "at", *names).agg(F.sum("outcome").cast("long").alias("__o"), F.count(F.lit(1)).alias("__c"))
    own = own.select("block", "at", *names, "__o", "__c")
    kinds = {n: own.schema[n].dataType.simpleString() for n in names}

    def add(drawn, cells):
        if not cells.num_rows or not drawn.num_rows:
            return pa.table({**{n: cells.column(n).slice(0, 0) for n in names}, "pos": pa.array([], pa.binary()), "neg": pa.array([], pa.binary())})
        counts = draws.block_counts(drawn, reps)
        code = np.zeros(cells.num_rows, np.int64)
        for n in names:
            x = cells.column(n).combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * len(x.dictionary) + x.indices.to_numpy(), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        start = np.flatnonzero(np.diff(code[order], prepend=-1))
        at = cells.column("at").to_numpy()[order]
        o, c = (cells.column(x).to_numpy()[order].astype(float) for x in ("__o", "__c"))
        both = np.stack((o, c - o))
        out: tuple = ([], [])
        for low, high in zip(start, [*start[1:], len(order)]):
            total = sum(both[:, i : min(high, i + SUMMED)] @ counts[at[i : min(high, i + SUMMED)]].astype(float) for i in range(low, high, SUMMED))
            for into, x in zip(out, total):
                into.append(x.astype("<u2" if x.max() < 1 << 16 else "<i8").tobytes())
        first = pa.array(order[start])
        return pa.table({**{n: cells.column(n).take(first) for n in names}, "pos": pa.array(out[0], pa.binary()), "neg": pa.array(out[1], pa.binary())})

    schema = ", ".join(f"`{n}` {k}" for n, k in kinds.items())
    return weights.drawn.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(add, f"{schema}, pos binary, neg binary")


def _summed(column, where: np.ndarray, keys: int, reps: int) -> np.ndarray:
    """(key, replicate): the sums of arrays of ``_packed_sums`` at each key."""
    total = np.zeros((keys, reps), np.int64)
    for k, raw in zip(where, column.to_pylist()):
        total[k] += np.frombuffer(raw, "<u2" if len(raw) == 2 * reps else "<i8")
    return total


def _stacked(column, kind: str) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


#: What is summed over scores for each replicate.
_SUMS = ("tp", "fp", "fn", "tn", "u", "ap", "se", "ll")


def bootstrap_metrics(df: DataFrame, weights: draws.Weights, groups: list[str], threshold: float = 0.5) -> DataFrame:
    """Metrics of every replicate and group; a replicate is shared by all groups. ``weights`` are ``draws.weights``.

    Arrays over replicates are summed by score, scores are dealt by pieces of their range, pieces are shifted by the sums of those
    above, and each piece gives its share of every metric: a row for each replicate exists only in the result.
    """
    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)
    keys, reps = [*groups, "piece"], weights.replicates
    sums = _packed_sums(df, weights, groups, "p").withColumn("piece", piece(F.col("p")))

    def by_score(table):
        p, where = np.unique(table.column("p").to_numpy().astype(float), return_inverse=True)
        out = [_summed(table.column(name), where, len(p), reps) for name in ("pos", "neg")]
        first = table.slice(0, 1)
        return pa.table({**{k: first.column(k) for k in keys}, "ps": pa.array([p.tobytes()], pa.binary()), "pos": pa.array([out[0].tobytes()], pa.binary()), "neg": pa.array([out[1].tobytes()], pa.binary()), "all_pos": pa.array([out[0].sum(axis=0).tobytes()], pa.binary()), "all_neg": pa.array([out[1].sum(axis=0).tobytes()], pa.binary())})

    pieces = frozen(sums.groupBy(*keys).applyInArrow(by_score, f"{kinds}, piece long, ps binary, pos binary, neg binary, all_pos binary, all_neg binary"), "score-pieces")

    def above(table):
        order = np.argsort(-table.column("piece").to_numpy())
        table = table.take(pa.array(order))
        columns = {k: table.column(k) for k in keys}
        for name in ("all_pos", "all_neg"):
            x = _stacked(table.column(name), "<i8")
            upto = np.cumsum(x, axis=0)
            columns |= {f"over_{name[4:]}": pa.array([v.tobytes() for v in upto - x], pa.binary()), f"total_{name[4:]}": pa.array([upto[-1].tobytes()] * len(x), pa.binary())}
        return pa.table(columns)

    shifts = pieces.select(*keys, "all_pos", "all_neg").groupBy(*groups).applyInArrow(above, f"{kinds}, piece long, over_pos binary, total_pos binary, over_neg binary, total_neg binary")

    def share(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[i].as_py(), kind)  # noqa: B023, E731
                p = get("ps", "<f8")[::-1]
                pos, neg = (get(x, "<i8").reshape(len(p), -1)[::-1].astype(float) for x in ("pos", "neg"))
                tp, fp = (np.cumsum(x, axis=0) + get(f"over_{n}", "<i8") for x, n in ((pos, "pos"), (neg, "neg")))
                hit, q, p = (p >= threshold)[:, None], np.clip(p, 1e-15, 1 - 1e-15)[:, None], p[:, None]
                all_neg = get("total_neg", "<i8")
                ap = np.divide(pos * tp, tp + fp, out=np.zeros_like(tp), where=pos > 0)
                parts = (pos * hit, neg * hit, pos * ~hit, neg * ~hit, pos * (all_neg - fp + neg / 2), ap, pos * (1 - p) ** 2 + neg * p**2, -pos * np.log(q) - neg * np.log(1 - q))
                own = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*[own.column(own.schema.get_field_index(g)) for g in groups], pa.array([np.stack([x.sum(axis=0) for x in parts]).tobytes()], pa.binary())], [*groups, "s"])

    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    both = pieces.drop("all_pos", "all_neg").join(shifts.withColumnsRenamed({k: f"__{k}" for k in keys}).hint("merge"), on)  # arrays must not be broadcast, so not sent through the driver
    both = both.drop(*[f"__{k}" for k in keys])
    shares = both.mapInArrow(share, f"{kinds}, s binary")

    def total(table):
        s = _stacked(table.column("s"), "<f8").sum(axis=0).reshape(len(_SUMS), -1)
        n = s.shape[1]
        return pa.table({**{g: pa.concat_arrays([table.column(g).combine_chunks().slice(0, 1)] * n) for g in groups}, "rep": pa.array(np.arange(1, n + 1, dtype=np.int32)), **{k: pa.array(v) for k, v in zip(_SUMS, s)}})

    m = shares.groupBy(*groups).applyInArrow(total, f"{kinds}, rep int, " + ", ".join(f"{k} double" for k in _SUMS))
    m = m.filter("tp + fp + fn + tn > 0").select("*", (F.col("tp") + F.col("fn")).alias("all_pos"), (F.col("fp") + F.col("tn")).alias("all_neg"), (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"))
    return _ratios(m, ["rep", *groups])


def bootstrap_curves(df: DataFrame, weights: draws.Weights, groups: list[str], steps: int = 50) -> DataFrame:
    """(groups, rep, threshold, value): the model's net benefit in each replicate, from arrays summed by the last threshold that a score reaches."""
    kinds = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)
    reached = df.withColumn("k", F.least(F.floor(F.col("p") * 100 + 1e-9).cast("int"), F.lit(steps)))
    sums, replicates = _packed_sums(reached, weights, groups, "k"), weights.replicates

    def curves(table):
        k = np.maximum(table.column("k").to_numpy(), 0)
        by = [np.cumsum(_summed(table.column(name), k, steps + 1, replicates)[::-1], axis=0)[::-1] for name in ("pos", "neg")]
        tp, fp, n = by[0][1:], by[1][1:], by[0][0] + by[1][0]
        t = np.arange(1, steps + 1)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            value = (tp / n - fp / n * (t / (100 - t))).ravel()
        size, reps = len(value), value.size // steps
        return pa.table({**{g: pa.concat_arrays([table.column(g).combine_chunks().slice(0, 1)] * size) for g in groups}, "rep": pa.array(np.tile(np.arange(1, reps + 1, dtype=np.int32), steps)), "threshold": pa.array(np.repeat(np.arange(1, steps + 1) / 100, reps)), "value": pa.array(value)})

    return sums.groupBy(*groups).applyInArrow(curves, f"{kinds}, rep int, threshold double, value double").filter(~F.isnan("value"))


def percentile_interval(long: DataFrame, groups: list[str], level: float = 0.95) -> DataFrame:
    """(groups, low, high, valid, invalid) of ``value``; nulls are counted and left out."""
    a = (1 - level) / 2
    return long.groupBy(*groups).agg(F.percentile("value", F.lit(a)).alias("low"), F.percentile("value", F.lit(1 - a)).alias("high"), F.count("value").alias("valid"), F.count_if(F.col("value").isNull()).alias("invalid"))


def paired(reps: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(comparator, expanded, model, metric, rep, value): differences in one replicate; an improvement is above 0."""
    spark = reps.sparkSession
    want = spark.createDataFrame(pairs, "comparator string, expanded string")
    a = reps.select("rep", "model", F.col("matrix").alias("comparator"), *[F.col(m).alias(f"a_{m}") for m in ("auroc", "auprc", "brier")])
    b = reps.select("rep", "model", F.col("matrix").alias("expanded"), *[F.col(m).alias(f"b_{m}") for m in ("auroc", "auprc", "brier")])
    both = F.broadcast(want).join(a, "comparator").join(b, ["rep", "model", "expanded"])
    cells = F.array(*[F.struct(F.lit(f"{m}_difference" if m != "brier" else "brier_improvement").alias("metric"), (F.col(f"b_{m}") - F.col(f"a_{m}") if m != "brier" else F.col("a_brier") - F.col("b_brier")).alias("value")) for m in ("auroc", "auprc", "brier")])
    return both.select("comparator", "expanded", "model", "rep", F.explode(cells).alias("x")).select("comparator", "expanded", "model", "rep", "x.*")


def oof_coverage(scores: DataFrame, identity: DataFrame) -> DataFrame:
    """(check, failures): repeats, visits without a row, folds that differ, probabilities outside [0, 1]."""
    pairs = scores.select("matrix", "model").distinct().agg(F.count(F.lit(1)).alias("pairs"))
    per = scores.groupBy("n", "matrix", "model").agg(F.count(F.lit(1)).alias("c"))
    repeats = per.filter("c > 1").agg(F.count(F.lit(1)).alias("failures")).select(F.lit("repeated").alias("check"), "failures")
    have = per.groupBy("n").agg(F.count(F.lit(1)).alias("h"))
    missing = identity.select("n").join(have, "n", "left").crossJoin(F.broadcast(pairs)).agg(F.count_if(F.coalesce("h", F.lit(0)) != F.col("pairs")).alias("failures")).select(F.lit("missing").alias("check"), "failures")
    folds = scores.select("n", "fold").join(identity.select("n", F.col("fold").alias("f")), "n", "left").agg(F.count_if(~F.col("fold").eqNullSafe(F.col("f"))).alias("failures")).select(F.lit("fold").alias("check"), "failures")
    bounds = scores.agg(F.count_if(~F.coalesce(F.col("p").between(0, 1), F.lit(False))).alias("failures")).select(F.lit("bounds").alias("check"), "failures")
    return repeats.unionByName(missing).unionByName(folds).unionByName(bounds)


def aligned(scores: DataFrame, identity: DataFrame) -> DataFrame:
    """``identity`` with the probabilities of each (matrix, model); the query fails where a visit lacks one or has another fold."""
    pairs = scores.select("matrix", "model").distinct()
    rows = identity.crossJoin(F.broadcast(pairs)).join(scores.select("n", "matrix", "model", F.col("fold").alias("scored_fold"), "p"), ["n", "matrix", "model"], "left")
    return checked(rows, {"a visit lacks a probability": F.col("p").isNotNull(), "a probability is of another fold": F.col("fold") == F.col("scored_fold")}).drop("scored_fold")


def require_run(scores: DataFrame, folds: int = 5, matrices: int = 8, models: int = 4, evidence: str | None = None) -> DataFrame:
    """One row of (folds, matrices, models, fits, least and most probabilities of a visit); an error if they are not what a run must have.

    With ``evidence`` the row is written there before it is judged.
    """
    per = scores.groupBy("n").agg(F.count(F.lit(1)).alias("c")).agg(F.min("c").alias("least"), F.max("c").alias("most"))
    seen = scores.select("fold", "matrix", "model").distinct().agg(F.count_distinct("fold").alias("folds"), F.count_distinct("matrix").alias("matrices"), F.count_distinct("model").alias("models"), F.count(F.lit(1)).alias("fits")).crossJoin(F.broadcast(per))
    want = {"folds": folds, "matrices": matrices, "models": models, "fits": folds * matrices * models, "least": matrices * models, "most": matrices * models}
    if evidence:
        good = F.lit(True)
        for k, v in want.items():
            good = good & (F.col(k) == v)
        return with_evidence(seen, good, f"a run is not {want}", evidence)
    return checked(seen, {f"{k} is not {v}": F.col(k) == v for k, v in want.items()})


def hash_sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """All rows if there are at most ``n``, else those of least hash of the key."""
    return df.withColumn("__h", unit_hash(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))).orderBy("__h", key).limit(n).drop("__h")
