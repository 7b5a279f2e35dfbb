"""Approximate nearest neighbours by cross-polytope hashing.

Largest inner product becomes smallest angle: a vector gets one more coordinate that lifts all to the largest norm, a query a zero.
Candidates are in bands of norm by powers of two, each lifted to its own largest norm in its own tables, so that a few long vectors
do not drown the others' angles; a query searches all bands and the best by exact score are merged.
Each table applies three rounds of random signs and a fast Hadamard transform, a pseudo-rotation, and assigns the nearest signed axis.
A query probes the axes that lie nearest to it in each table; what it meets there is ranked exactly on the original vectors.

A bucket beyond ``BLOCK`` vectors is divided at random and its queries are repeated, so no task holds a whole hot bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import written

TABLES = 8
#: The share of all signed axes that a query probes in a table.
PROBES = 1 / 8
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """The transform of each row; the width is a power of two."""
    x, h = x.copy(), 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), -1)
        h *= 2
    return x / math.sqrt(x.shape[1])


def rotated(x: np.ndarray, table: int, seed: int) -> np.ndarray:
    signs = np.random.default_rng((seed, table)).integers(0, 2, (3, x.shape[1])) * 2.0 - 1.0
    for s in signs:
        x = hadamard(x * s)
    return x


def axes(x: np.ndarray) -> np.ndarray:
    """Similarity to each signed axis: the coordinates, then their negatives."""
    return np.concatenate((x, -x), axis=1)


def lifted(v: np.ndarray, largest: float | np.ndarray | None) -> np.ndarray:
    """Unit vectors of power-of-two width; ``largest`` is the largest norm for candidates, or a column of that of each one's band, None for queries."""
    width = 1 << max(1, v.shape[1].bit_length())
    out = np.zeros((len(v), width))
    peak = np.abs(v).max(1, keepdims=True)
    if largest is None:
        out[:, : v.shape[1]] = v / peak
        return out / np.linalg.norm(out, axis=1, keepdims=True)
    out[:, : v.shape[1]] = v / largest
    out[:, v.shape[1]] = np.sqrt(np.maximum(0.0, 1.0 - (out**2).sum(1)))
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>): one row for each id, without null, zero, or null or non-finite components; of the commonest width."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.filter(~bad & F.exists("v", lambda x: x != 0.0))
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    return rows.filter(F.size("v") == (width["w"] if width else 0)).groupBy("id").agg(F.min("v").alias("v"))


def _band(norm):
    """The power of two of a norm; sums of squares that leave the range of doubles are the first or the last band."""
    return F.when(norm == 0, -2000).when(norm == float("inf"), 2000).otherwise(F.floor(F.log2(norm))).cast("int")


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def nearest(vectors: DataFrame, queries: str, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = TABLES, probes: float = PROBES, seed: int = 29) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of each row that the SQL condition ``queries`` on ``id`` selects.

    Ties go to the smaller id; scores are inner products in double precision. Rows that repeat an id are one, the least vector; a
    query that meets fewer than ``k`` probes every axis in a second pass, so it gets all if there are fewer. No rows give an empty result.
    Vectors that are null, zero or of another width than the commonest, or that hold null or non-finite components, take no part.
    """
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = written(rows.withColumn("band", _band(norm)).withColumn("norm", norm), "banded")
    largest = {r["band"]: r["m"] or 1.0 for r in rows.groupBy("band").agg(F.max("norm").alias("m")).collect()}  # at most one for each exponent

    def coded(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = lifted(_numbers(batch.column(1)), np.array([largest[b] for b in batch.column(2).to_pylist()])[:, None])
            codes = np.stack([axes(rotated(x, t, seed)).argmax(1) for t in range(tables)], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(codes.tolist(), pa.list_(pa.int32()))], ["id", "v", "band", "codes"])

    index = rows.select("id", "v", "band").mapInArrow(coded, "id long, v array<double>, band int, codes array<int>").select("id", "v", "band", F.posexplode("codes").alias("t", "code"))
    bands = sorted(largest)
    number = F.array_position(F.array(*[F.lit(b) for b in bands]), F.col("band")).cast("int") - 1 if bands else F.lit(0)
    index = written(index.select("id", "v", (number * tables + F.col("t")).cast("int").alias("t"), "code"), "cross-polytope-index")  # each band has its own tables
    sizes = {(r["t"], r["code"]): -(-r["n"] // BLOCK) for r in index.groupBy("t", "code").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most bands x tables x axes
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    parts = rows.sparkSession.createDataFrame([(t, c, n) for (t, c), n in sorted(sizes.items())], "t int, code int, parts int")
    placed = index.join(parts, ["t", "code"]).select("t", "code", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("asks"), "id", "v")

    def probing(share: float):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = _numbers(batch.column(1))
                x, at, t_, c_ = lifted(v, None), [], [], []
                for t in range(tables):
                    near = axes(rotated(x, t, seed))
                    best = np.argsort(-near, axis=1, kind="stable")[:, : max(1, round(share * near.shape[1]))]
                    for b in range(len(bands)):
                        at.append(np.repeat(np.arange(len(v)), best.shape[1]))
                        t_.append(np.full(best.size, b * tables + t))
                        c_.append(best.ravel())
                take = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(t_).astype(np.int32)), pa.array(np.concatenate(c_).astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take)], ["t", "code", "id", "v"])

        return run

    def search(asked: DataFrame, share: float) -> DataFrame:
        probed = asked.select("id", "v").mapInArrow(probing(share), "t int, code int, id long, v array<double>").join(parts, ["t", "code"])
        probed = probed.select("t", "code", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("asks"), "id", "v")
        key = ["t", "code", "part"]
        met = placed.unionByName(probed).repartition(*key).sortWithinPartitions(*key, "asks", "id").mapInArrow(_ranker(k), "id long, ids binary, scores binary")
        return met.repartition("id").sortWithinPartitions("id").mapInArrow(_merger(k), "query_id long, rank int, id long, score double")

    asked = rows.filter(queries)
    found = written(search(asked, probes), "nearest")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = asked.join(full, "id", "left_anti")
    if probes >= 1 or short.isEmpty():
        return found
    again = search(short, 1.0)
    return found.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], scores[first]


def _ranker(k: int):
    """Blocks (t, code, part) with candidates first: each query's best of the block, merged over the blocks of a task."""

    def run(batches):
        best: dict[int, list] = {}
        size = 0

        def flush():
            rows = [(q, *_top(np.concatenate([x[0] for x in v]), np.concatenate([x[1] for x in v]), k)) for q, v in best.items()]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1].tobytes() for r in rows], pa.binary()), pa.array([r[2].tobytes() for r in rows], pa.binary())], ["id", "ids", "scores"])

        key, have_ids, have = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, asks, v = np.asarray(batch.column(4), np.int64), np.asarray(batch.column(3)).astype(bool), _numbers(batch.column(5))
            keys = np.stack([np.asarray(batch.column(i), np.int64) for i in range(3)], 1)
            cuts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(ids)]))
            for a, b in zip(cuts[:-1], cuts[1:]):
                now = tuple(keys[a])
                c = a + int((~asks[a:b]).sum())
                if now != key:
                    key, have_ids, have = now, ids[a:c], v[a:c]
                elif c > a:
                    have_ids, have = np.concatenate((have_ids, ids[a:c])), np.concatenate((have, v[a:c]))
                if c == b or not len(have_ids):
                    continue
                scores = np.einsum("qd,xd->qx", v[c:b], have)
                scores[ids[c:b, None] == have_ids[None, :]] = -np.inf
                order = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # candidates ascend by id
                for q, row, o in zip(ids[c:b].tolist(), scores, order):
                    s = row[o]
                    good = s > -np.inf
                    best.setdefault(q, []).append((have_ids[o][good], s[good]))
                size += b - c
                if size > 20_000:
                    yield flush()
                    size = 0
        if best:
            yield flush()

    return run


def _merger(k: int):
    def run(batches):
        key, parts = None, []

        def close():
            ids, scores = _top(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), k)
            n = len(ids)
            return [np.full(n, key), np.arange(1, n + 1, dtype=np.int32), ids, scores]

        for batch in batches:
            out = []
            for q, i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if q != key:
                    if parts:
                        out.append(close())
                    key, parts = q, []
                parts.append((np.frombuffer(i, np.int64), np.frombuffer(s, np.float64)))
                if len(parts) > 64:
                    parts = [_top(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["query_id", "rank", "id", "score"])
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in close()], ["query_id", "rank", "id", "score"])

    return run
