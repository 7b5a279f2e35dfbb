"""Whitening of embeddings through the singular values of their centred rows.

Rows are never multiplied into a covariance: each task reduces its centred rows, block by block, to a triangle by QR, triangles meet
by QR in groups until one is left, and that one is brought to bidiagonal form by Householder reflections. The differential quotient-
difference algorithm with shifts gives all singular values to high relative accuracy; twisted factorisations of the shifted product
give the directions, values that lie close together through a representation that is shifted next to them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import temporary, written

COMPONENTS = 4
#: Entries become floor(SCALE * entry).
SCALE = 256
#: Triangles that meet in one task.
GROUP = 32
EPS = np.finfo(float).eps
#: Values are a cluster while they differ by less than this share of the larger.
NEAR = 1e-3


# ---------------------------------------------------------------- bidiagonal form and singular values


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): diagonal and upper diagonal of a square matrix's bidiagonal form, and the orthogonal matrix of its right side."""
    x, d = r.copy(), len(r)
    v = np.eye(d)

    def reflector(u: np.ndarray) -> tuple[np.ndarray, float]:
        u, size = u.copy(), float(np.linalg.norm(u))
        if size == 0.0:
            return u, 0.0
        u[0] += np.copysign(size, u[0])
        return u, 2.0 / float(u @ u)

    for k in range(d):
        u, c = reflector(x[k:, k])
        x[k:, k:] -= c * np.outer(u, u @ x[k:, k:])
        if k < d - 2:
            u, c = reflector(x[k, k + 1 :])
            x[k:, k + 1 :] -= c * np.outer(x[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= c * np.outer(v[:, k + 1 :] @ u, u)
    return np.diag(x).copy(), np.diag(x, 1).copy(), v


def _dqds_step(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], float, bool]:
    """One transform: the new arrays, the least pivot and whether it failed before the last one."""
    qq, ee, d, least = [], [], q[0] - tau, q[0] - tau
    for i in range(len(e)):
        if d < 0.0:
            return qq, ee, d, True
        top = d + e[i]
        if top == 0.0:
            top = np.finfo(float).tiny
        qq.append(top)
        t = q[i + 1] / top
        ee.append(e[i] * t)
        d = d * t - tau
        least = min(least, d)
    return [*qq, d], ee, least, False


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """All eigenvalues of the product whose quotients and differences are q and e, largest first."""
    found, stack = [], [(list(map(float, q)), list(map(float, e)), 0.0)]
    while stack:
        q, e, sigma = stack.pop()
        while True:
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= (10 * EPS) ** 2 * (sigma + q[i])), None)
            if cut is not None:
                stack.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if len(q) == 1:
                found.append(q[0] + sigma)
                break
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            # the smaller eigenvalue of the last two rows is not below the least; what it overshoots by mends it
            a, c, o = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            half = (a - c) / 2
            root = np.hypot(half, np.sqrt(o))
            tau = max(0.0, (a * c - o) / ((a + c) / 2 + root)) if root or a + c else 0.0
            for _ in range(4):
                qq, ee, least, early = _dqds_step(q, e, tau)
                if least >= 0.0:
                    break
                tau = max(0.0, tau / 4 if early else (tau + least) * (1 - 2 * EPS))
            else:
                tau = 0.0
                qq, ee, least, early = _dqds_step(q, e, tau)
            q, e, sigma = qq, ee, sigma + tau
    return np.sort(np.array(found))[::-1]


# ---------------------------------------------------------------- directions


def _stationary(q, e, ab, shift) -> tuple[np.ndarray, np.ndarray]:
    """Pivots and multipliers of the product less ``shift``, from the top."""
    d, low, s = np.empty(len(q)), np.empty(len(ab)), -shift
    for i in range(len(ab)):
        d[i] = s + q[i] or np.finfo(float).tiny
        low[i] = ab[i] / d[i]
        s = s * (e[i] / d[i]) - shift
    d[-1] = s + q[-1]
    return d, low


def _below(q, e, shift) -> int:
    """How many eigenvalues lie below ``shift``."""
    n, s = 0, -shift
    for i in range(len(e)):
        d = s + q[i] or np.finfo(float).tiny
        n += d < 0
        s = s * (e[i] / d) - shift
    return n + (s + q[-1] < 0)


def _bisected(q, e, index: int, low: float, high: float) -> float:
    """The eigenvalue with ``index`` others below it."""
    step = max(abs(low), abs(high), np.finfo(float).tiny)
    while _below(q, e, low) > index:
        low, step = low - step, 2 * step
    step = max(abs(low), abs(high), np.finfo(float).tiny)
    while _below(q, e, high) <= index:
        high, step = high + step, 2 * step
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high) or high - low <= 2 * EPS * max(abs(low), abs(high)):
            break
        low, high = (low, mid) if _below(q, e, mid) > index else (mid, high)
    return (low + high) / 2


def twisted(q, e, ab, value: float) -> np.ndarray:
    """The unit vector of an eigenvalue: factorisations from the top and from the bottom meet where their residue is least."""
    m = len(q)
    z = np.ones(m)
    for _ in range(3):
        tiny = np.finfo(float).tiny
        low, up, s, p = np.empty(m), np.empty(m), np.empty(m), np.empty(m)
        s[0] = -value
        for i in range(m - 1):
            d = s[i] + q[i] or tiny
            low[i] = ab[i] / d
            s[i + 1] = s[i] * (e[i] / d) - value
        p[-1] = q[-1] - value
        for i in range(m - 2, -1, -1):
            d = e[i] + p[i + 1] or tiny
            up[i] = ab[i] / d
            p[i] = p[i + 1] * (q[i] / d) - value
        gamma = s + p + value
        r = int(np.argmin(np.where(np.isfinite(gamma), np.abs(gamma), np.inf)))
        z = np.zeros(m)
        z[r] = 1.0
        for i in range(r - 1, -1, -1):
            z[i] = -low[i] * z[i + 1]
        for i in range(r, m - 1):
            z[i + 1] = -up[i] * z[i]
        square = float(z @ z)
        if not np.isfinite(square):
            break
        step = float(gamma[r]) / square
        value += step
        if abs(step) <= 2 * EPS * abs(value):
            break
    return z / np.linalg.norm(z)


def _vectors(q, e, ab, values: dict[int, float], wanted: set[int], depth: int = 0) -> dict[int, np.ndarray]:
    """Vectors of the wanted eigenvalues by index from below; ``values`` are theirs and their neighbours'."""
    order, out = sorted(values), {}
    groups = [[order[0]]]
    for i in order[1:]:
        a, b = values[groups[-1][-1]], values[i]
        if abs(b - a) < NEAR * max(abs(a), abs(b)):
            groups[-1].append(i)
        else:
            groups.append([i])
    for g in groups:
        if not wanted & set(g):
            continue
        if len(g) == 1 or depth >= 8:
            for i in g:
                x = twisted(q, e, ab, values[i])
                for j in g[: g.index(i)] if depth >= 8 else ():
                    x = x - (x @ out[j]) * out[j]
                out[i] = x / np.linalg.norm(x)
            continue
        # a representation next to the cluster tells its values apart; the one whose pivots grow least is taken
        wide = max(values[g[-1]] - values[g[0]], 4 * EPS * max(abs(values[g[0]]), abs(values[g[-1]])))
        tries = []
        for tau in (values[g[-1]] + wide / 2, values[g[0]] - wide / 2, values[g[-1]] + 8 * wide, values[g[0]] - 8 * wide):
            d, low = _stationary(q, e, ab, tau)
            if np.isfinite(d).all() and np.isfinite(low).all():
                tries.append((float(np.abs(d).max()), tau, d, low))
        _, tau, d, low = min(tries, key=lambda x: x[0])
        e2 = low * ab
        near = {i: _bisected(d, e2, i, values[i] - tau - wide, values[i] - tau + wide) for i in g}
        out |= _vectors(d, e2, ab, near, wanted, depth + 1)
    return out


def leading(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): the ``k`` largest eigenvalues of r'r, largest first, and their unit vectors as columns; largest entries are positive."""
    d = len(r)
    scale = float(np.abs(r).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(k), np.eye(d)[:, :k]
    a, b, v = bidiagonal(r / scale)
    most = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    a = np.where(np.abs(a) < EPS * EPS * most, EPS * EPS * most, a)
    cuts = [i for i in range(d - 1) if abs(b[i]) <= EPS * min(abs(a[i]), abs(a[i + 1])) or abs(b[i]) < EPS * EPS * most]
    edges = [0, *[i + 1 for i in cuts], d]
    blocks, pool = [], []
    for n, (lo, hi) in enumerate(zip(edges, edges[1:])):
        q, e, ab = a[lo:hi] ** 2, b[lo : hi - 1] ** 2, a[lo : hi - 1] * b[lo : hi - 1]
        own = dqds(q, e)[::-1]
        blocks.append((lo, hi, q, e, ab, own))
        pool += [(x, n, i) for i, x in enumerate(own)]
    pool.sort(key=lambda x: (-x[0], x[1], x[2]))
    columns = {}
    for n, (lo, hi, q, e, ab, own) in enumerate(blocks):
        wanted = {i for _, m, i in pool[:k] if m == n}
        if wanted:
            for i, z in _vectors(q, e, ab, dict(enumerate(own)), wanted).items():
                x = np.zeros(d)
                x[lo:hi] = z
                columns[n, i] = v @ x
    out = np.empty((d, k))
    for j, (_, n, i) in enumerate(pool[:k]):
        x = columns[n, i]
        for h in range(j):
            x = x - (x @ out[:, h]) * out[:, h]
        x = x / np.linalg.norm(x)
        out[:, j] = x * np.sign(x[np.argmax(np.abs(x))])
    return np.array([x for x, _, _ in pool[:k]]) * scale * scale, out


# ---------------------------------------------------------------- over Spark


@dataclass
class Model:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def width(self) -> int:
        return len(self.sums)

    def rank(self) -> np.ndarray:
        """Whether a component has variance beyond rounding."""
        return self.values > (self.width * EPS) ** 2 * self.values.max(initial=0.0)


def _integers(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: machine integers where they suffice."""
    most = max(map(abs, sums), default=0)
    if n * int(np.abs(x.astype(float)).max(initial=0.0) + 1) < 1 << 61 and most < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _projected(deviations: np.ndarray, model: Model) -> np.ndarray:
    centred = (deviations / model.n).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return centred @ model.vectors / np.sqrt(model.values)


def integers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the vectors that take part; shorter ones end in zeros up to the longest."""
    v = F.col(vector_col)
    fine = F.coalesce(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))
    x = F.transform(v, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(0).cast("long"))
    return rows.filter(fine).select(F.col(id_col).cast("long").alias("id"), x.alias("x"))


def _padded(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))


def fit(rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> Model:
    """The model of the distinct vectors; what reaches the driver is one triangle and sums of one vector's width."""
    with temporary():
        good = integers(rows, id_col, vector_col)
        width = good.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
        if not width:
            return Model(good.limit(1).count(), [], np.zeros(0), np.zeros((0, 0)), 0.0, None)
        table = written(_padded(good, width).select("x").distinct(), "fit-list")

        def totals(batches):
            total, n = np.zeros(width, object), 0
            for batch in batches:
                if batch.num_rows:
                    x = _integers(batch.column(0), width)
                    small = float(np.abs(x.astype(float)).max()) * len(x) < 2**62
                    total = total + (x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0))
                    n += len(x)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([list(map(str, total))], pa.list_(pa.string()))], ["n", "sums"])

        parts = table.mapInArrow(totals, "n long, sums array<string>").select("n", F.posexplode("sums").alias("at", "s"))
        by = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()  # a row for each dimension
        n, sums = int(by[0]["n"]), [int(r["s"]) for r in by]

        def triangle(batches):
            r = np.zeros((0, width))
            for batch in batches:
                x = _integers(batch.column(0), width)
                for i in range(0, len(x), max(width, 4096)):
                    block = (_deviations(x[i : i + max(width, 4096)], n, sums) / n).astype(float)
                    r = np.linalg.qr(np.vstack((r, block)), mode="r")
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes()], pa.binary())], ["r"])

        def joined(key, group):
            r = np.zeros((0, width))
            for raw in group.column("r").to_pylist():
                r = np.linalg.qr(np.vstack((r, np.frombuffer(raw).reshape(-1, width))), mode="r")
            return pa.table({"key": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

        level = table.mapInArrow(triangle, "r binary").select(F.spark_partition_id().cast("long").alias("key"), "r")
        while True:
            level = written(level, "triangles")
            if level.count() == 1:
                break
            level = level.select(F.expr(f"key div {GROUP}").alias("key"), "r").groupBy("key").applyInArrow(joined, "key long, r binary")
        r = np.zeros((width, width))
        top = np.frombuffer(level.first()["r"]).reshape(-1, width)
        r[: len(top)] = top
        k = min(components, width)
        squares, vectors = leading(r, k)
        model = Model(n, sums, squares / n, vectors, float(np.square(r).sum()) / n, None)
        have = np.flatnonzero(model.rank())

        def moments(batches):
            one, two = np.zeros(k), np.zeros((k, k))
            for batch in batches:
                if batch.num_rows:
                    w = np.where(model.rank(), _projected(_deviations(_integers(batch.column(0), width), n, sums), model), 0.0)
                    one, two = one + w.sum(axis=0), two + w.T @ w
            yield pa.RecordBatch.from_arrays([pa.array([[*one, *two.ravel()]], pa.list_(pa.float64()))], ["m"])

        m = table.mapInArrow(moments, "m array<double>").agg(*[F.sum(F.col("m")[i]) for i in range(k + k * k)]).first()
        mean, two = np.array(m[:k]) / n, np.array(m[k:]).reshape(k, k) / n
        off = (two - np.outer(mean, mean))[np.ix_(have, have)] - np.eye(len(have))
        model.identity_error = float(np.abs(off).max()) if len(have) else None
        return model


def whiten(rows: DataFrame, model: Model, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector that takes part and component.

    Vectors that are null or hold null or non-finite entries have no row; shorter vectors end in zeros up to the longest; equal
    vectors and repeated or null ids have rows each. A component without variance has no whitened value (null), nor explained one if
    no component has any; identity_error is over the others. A deviation beyond a long is null. Without vectors there are no rows.
    """
    k = len(model.values)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        rank = m.rank()
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                d = _deviations(_integers(batch.column(1), m.width), m.n, m.sums)
                most = int(np.abs(d).max(initial=0))
                exact = (d * d).sum(axis=1) if d.dtype != object and most * most * m.width < 1 << 63 else (d.astype(object) ** 2).sum(axis=1)
                exact = [int(v) if int(v) < 1 << 63 else None for v in exact]
                w = _projected(d, m)
                n = len(d)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(np.arange(n), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, m.n, np.int64)),
                        pa.array([v for v in exact for _ in range(k)], pa.int64()),
                        pa.array(w.ravel(), mask=~np.tile(rank, n)),
                        pa.array(np.tile(m.values / m.trace if m.trace else np.zeros(k), n), mask=np.full(n * k, not m.trace)),
                        pa.array([m.identity_error] * (n * k), pa.float64()),
                    ],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    return _padded(integers(rows, id_col, vector_col), model.width).mapInArrow(run, schema)
