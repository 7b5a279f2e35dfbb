"""A Naive Bayes support vector machine for text quality.

A text is the set of its hashed n-grams: words and word pairs in lower case, and runs of one to three word shapes (case, last mark,
length class, whether the word repeats the one before). Indicators are scaled by the log-count ratio of the two classes, a linear
hinge-loss model is fitted to them by dual coordinate descent, and a logistic curve over its margins, fitted to rows kept apart,
gives the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import blocks_of, encoded, mix, pieces, temporary, word_hashes, written

BITS = 18
#: The most labelled rows that the model is fitted to; those of least hash are taken.
MOST_ROWS = 12_000
#: The most n-gram numbers of all those rows together, four bytes each; rows of larger hash that would exceed it are left out.
MOST_NUMBERS = 1 << 25
EPOCHS, PENALTY, SMOOTH = 12, 1.0, 1.0

_LAST = np.zeros(256, np.uint64)
for _i, _c in enumerate(b".,;:!?)]}\"'"):
    _LAST[_c] = 2 + _i
for _c in b"0123456789":
    _LAST[_c] = 1
_A = np.uint64(0xA24BAED4963EE407)


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct n-gram numbers below 2 ** BITS of each text."""
    out: list[np.ndarray] = []
    for first, last, raw, begin in blocks_of(texts):
        starts, ends, h = word_hashes(raw.lower())
        n = last - first
        if not len(h):
            out += [np.zeros(0, np.int64)] * n
            continue
        b = np.frombuffer(raw, np.uint8)
        doc = np.searchsorted(begin, starts, "right") - 1
        upper = np.concatenate(([0], np.cumsum((b >= 65) & (b <= 90))))
        lower = np.concatenate(([0], np.cumsum((b >= 97) & (b <= 122))))
        up, low = upper[ends] - upper[starts], lower[ends] - lower[starts]
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        length = np.minimum((ends - starts) // 4, 7)
        shape = np.minimum(up, 2) + 3 * (low > 0) + 6 * same + 12 * length
        shape = mix(shape.astype(np.uint64) * np.uint64(64) + _LAST[b[ends - 1]] + np.uint64(1))
        grams = [h]
        for base, k in ((h, 2), (shape, 1), (shape, 2), (shape, 3)):
            x = base.copy()
            for i in range(1, k):
                x[:-i] = x[:-i] * _A + base[i:]
            x = mix(x + np.uint64(k + 8 * (base is shape)))
            if k > 1:  # n-grams do not cross texts; what would is given the first number and dropped below
                cross = np.ones(len(x), bool)
                cross[: len(x) - k + 1] = doc[k - 1 :] != doc[: len(x) - k + 1]
                x[cross] = 0
            grams.append(x)
        number = np.concatenate([(doc << BITS) | (g >> np.uint64(64 - BITS)).astype(np.int64) for g in grams])
        number = np.unique(number)
        which = number >> BITS
        cuts = np.searchsorted(which, np.arange(1, n))
        out += np.split(number & ((1 << BITS) - 1), cuts)
    return [x[x > 0] for x in out]


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    level: float

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for i, x in enumerate(rows):
            r = self.ratio[x]
            out[i] = self.bias + float(r @ self.weight[x]) / max(1e-12, float(np.sqrt(r @ r)))
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margins(rows) + self.level, -30, 30)))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, penalty: float = PENALTY, epochs: int = EPOCHS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model; rows are (numbers, values)."""
    w, bias = np.zeros(size), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for _, v in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i]
            gradient = y[i] * (float(w[x] @ v) + bias) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), penalty)
            step = (new - alpha[i]) * y[i]
            if step:
                w[x] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def train(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """With one class alone (or no rows) the model gives that class's share everywhere."""
    size = 1 << BITS
    y = np.where(labels > 0, 1.0, -1.0)
    good = int((y > 0).sum())
    if not 0 < good < len(y):
        share = (good + 1.0) / (len(y) + 2.0)
        return Model(np.zeros(size), np.zeros(size), 0.0, 0.0, float(np.log(share / (1 - share))))
    counts = [np.full(size, SMOOTH), np.full(size, SMOOTH)]
    for x, v in zip(rows, y):
        counts[int(v > 0)][x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[0] = 0.0
    scaled = []
    for x in rows:
        r = ratio[x]
        scaled.append((x, r / max(1e-12, float(np.sqrt(r @ r)))))
    apart = np.arange(len(rows)) % 5 == 4
    fit = [i for i in range(len(rows)) if not apart[i]]
    w, bias = dual_coordinate_descent([scaled[i] for i in fit], y[fit], size)
    model = Model(ratio, w, bias, 1.0, 0.0)
    tune = [i for i in range(len(rows)) if apart[i]] or fit
    m, t = model.margins([rows[i] for i in tune]), (y[tune] > 0).astype(float)
    smooth = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        q = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - smooth) * m).sum(), (p - smooth).sum()])
        hess = np.array([[(q * m * m).sum() + 1e-6, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.level = max(float(a), 1e-6), float(b)
    return model


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits to at most ``most_rows`` labelled ids that are not held out; labels (doc_id, quality) other than 0 and 1 are left out.

    Of an id with several labels the larger counts, of one with several texts the least text; null texts are empty. Ids of least hash
    that have a document are taken, so ties do not matter. Without labels or documents the model gives one half. The driver holds those
    rows' n-gram numbers, MOST_NUMBERS of them at most.
    """
    known = labels.filter("quality in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.join(docs.select(F.col(id_col).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(most_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "quality"), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in pieces(batches):
            found = features(encoded(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array([x.astype("<u4").tobytes() for x in found], pa.binary())], ["doc_id", "quality", "x"])

    with temporary():
        counted = written(rows.mapInArrow(run, "doc_id long, quality int, x binary"), "labelled-grams")
        sizes = counted.select("doc_id", F.octet_length("x").alias("n")).orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").collect()  # at most ``most_rows``
        take, total = [], 0
        for r in sizes:
            total += r["n"] // 4
            if total > MOST_NUMBERS and take:
                break
            take.append((r["doc_id"],))
        few = counted.sparkSession.createDataFrame(take, "doc_id long")
        got = sorted(counted.join(F.broadcast(few), "doc_id").collect(), key=lambda r: r["doc_id"])
    return train([np.frombuffer(bytes(r["x"]), "<u4").astype(np.int64) for r in got], np.array([r["quality"] for r in got]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, held_out, score, predicted) of every row; null and empty texts get the score of no n-grams; rows that repeat are equal.

    A null id counts as not held out. The model is 2 ** BITS weights, sent to the executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in pieces(batches):
            s = shared.value.scores(features(encoded(batch.column(2))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["did", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("did"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "did long, held_out boolean, score double, predicted int")
