"""Windows of texts that start more than once in a corpus: what the suffix-tree and suffix-array operators share.

Only some suffixes need be sorted: those that begin at the anchor of a window, the place of the least of the hashes of its runs of
``gram`` symbols, the last if tied. Equal windows have equal anchors at equal distances, so they are a common left context and a common
right context of two such suffixes. Windows that follow one another with one anchor make a segment, and segments are grouped by the
first ``gram`` symbols of their suffix. Anchors that occur once are dropped first; a distinct segment is moved once with the number of
its occurrences.

A group beyond ``group`` segments is divided by longer prefixes: windows whose distances from the anchor lie in one cell of a grid have
all but the grid's width in common, so the suffix that begins at the cell's end is keyed by that much, and what is moved is cut to the
cell. Equal pieces are one, with the sum of their numbers. At the last grid, of width one, a prefix is a whole window: its group is a
node of full depth, whose weight is a sum that needs no task to hold it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import _BYTE, _R, INVERSE, POWER, blocks_of, discard, encoded, mix, ngram_hashes, pieces, same_key, temporary, word_hashes, written

#: The most distinct segments of a group that are sorted together.
GROUP = 512
#: Segments that are sorted at once, as whole groups.
BLOCK = 4096


@dataclass(frozen=True)
class Unit:
    """What a window is made of. ``grid`` windows share a prefix when a group is divided the first time."""

    words: bool
    width: int
    gram: int
    grid: int


def _last_least(g: np.ndarray, w: int) -> np.ndarray:
    """For each run of w values, the place of the last of the least."""
    at, size = np.arange(len(g)), 1
    value = g
    while 2 * size <= w:
        right = value[size:] <= value[:-size]
        at = np.where(right, at[size:], at[:-size])
        value = np.where(right, value[size:], value[:-size])
        size *= 2
    shift = w - size
    if shift:
        right = value[shift:] <= value[:-shift]
        at = np.where(right, at[shift:], at[:-shift])
    return at


def _byte_grams(b: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes, k a multiple of 8."""
    n = len(b) - k + 1
    x = np.ndarray((len(b) - 7,), "<u8", np.ascontiguousarray(b), strides=(1,))
    out = x[:n] * _R
    for i in range(8, k, 8):
        out ^= out >> np.uint64(29)
        out += x[i : i + n]
        out *= _R
    out ^= out >> np.uint64(32)
    out *= _R
    out ^= out >> np.uint64(29)
    return out


def segments(texts: list[bytes], unit: Unit) -> dict[str, np.ndarray]:
    """Segments of all texts: text number, anchor hash, first window, windows, anchor's distance from the first, hash."""
    out: dict[str, list] = {c: [] for c in ("text", "h", "s", "n", "o", "sk")}
    for first, _, raw, begin in blocks_of(texts, 1 << 20):
        b = np.frombuffer(raw, np.uint8)
        if unit.words:
            starts, _, h = word_hashes(raw)
            doc = np.searchsorted(begin, starts, "right") - 1
            base = np.searchsorted(doc, np.arange(len(begin)))
            n = len(h) - unit.width + 1
            if n <= 0:
                continue
            g, value = ngram_hashes(h, unit.gram), h
            valid = doc[unit.width - 1 :] == doc[:n]
        else:
            n = len(b) - unit.width + 1
            if n <= 0:
                continue
            base = begin
            g, value = _byte_grams(b, unit.gram), _BYTE[b]
            ends = np.zeros(len(b) + 1, np.int32)
            ends[begin[1:]] = 1  # the joining byte is before each of these
            ends = np.cumsum(ends)
            doc = ends[:-1]
            valid = ends[unit.width : unit.width + n] == doc[:n]
        anchor = _last_least(g, unit.width - unit.gram + 1)
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (doc[1:n] != doc[: n - 1])
        s = np.flatnonzero(new)
        e = np.append(s[1:], n)
        keep = valid[s]
        s, e = s[keep], e[keep]
        a = anchor[s]
        total = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * POWER.first(len(value)), out=total[1:])
        which = doc[s]
        key = (total[e - 1 + unit.width] - total[s]) * INVERSE.at(s)
        out["text"].append(which + first)
        out["h"].append(g[a].view(np.int64))
        out["s"].append(s - base[which])
        out["n"].append(e - s)
        out["o"].append(a - s)
        out["sk"].append(mix(key + (e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (a - s).astype(np.uint64)).view(np.int64))
    return {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()}


def anchors(docs: DataFrame, unit: Unit) -> DataFrame:
    """(h, did, th, s, n, o, sk) of every segment of ``docs`` (did, th, text)."""

    def run(batches):
        for batch in pieces(batches):
            found = segments(encoded(batch.column(2)), unit)
            at = pa.array(found["text"])
            cols = [pa.array(found["h"]), batch.column(0).take(at), batch.column(1).take(at), *(pa.array(found[c].astype(np.int32)) for c in "sno"), pa.array(found["sk"])]
            yield pa.RecordBatch.from_arrays(cols, ["h", "did", "th", "s", "n", "o", "sk"])

    return docs.mapInArrow(run, "h long, did long, th long, s int, n int, o int, sk long")


def _cut(data: bytes, unit: Unit) -> Callable[[int, int], bytes]:
    if not unit.words:
        return lambda a, b: data[a:b]
    words = data.split()  # of bytes: at space and \t \n \v \f \r alone
    return lambda a, b: b" ".join(words[a:b])


def _number(*parts: bytes) -> int:
    return int.from_bytes(blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


_PIECE = "key long, h long, sk long, at int, n int, o int, m long, seg binary, divided boolean"
_PIECE_ARROW = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("sk", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("o", pa.int32()), ("m", pa.int64()), ("seg", pa.binary()), ("divided", pa.bool_())])


def _extract(docs: DataFrame, wanted: DataFrame, unit: Unit, group: int) -> DataFrame:
    """The text of each distinct segment, divided over the grid where its group is large (``g``)."""
    lists = wanted.groupBy("did", "th").agg(F.collect_list(F.struct("h", "sk", "s", "n", "o", "m", "g")).alias("want"))

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for data, want in zip(encoded(batch.column(0)), batch.column(1).to_pylist()):
                cut = _cut(data, unit)
                for x in want:
                    s, n, o = x["s"], x["n"], x["o"]
                    if x["g"] <= group:
                        rows.append((x["h"], x["h"], x["sk"], 0, n, o, x["m"], cut(s, s + n - 1 + unit.width), False))
                        continue
                    # window i is l = o - i before the anchor; all with l in one cell of the grid share a prefix from the cell's start on
                    for q in range((o - n + 1) // unit.grid, o // unit.grid + 1):
                        low, high = q * unit.grid, q * unit.grid + unit.grid - 1
                        i, j = max(0, o - high), min(n - 1, o - low)
                        prefix = cut(s + o - low, s + o - high + unit.width)
                        rows.append((_number(x["h"].to_bytes(8, "little", signed=True), q.to_bytes(4, "little"), prefix), x["h"], x["sk"], i, j - i + 1, o - i, x["m"], cut(s + i, s + j + unit.width), True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 9, _PIECE_ARROW)], schema=_PIECE_ARROW)

    return same_key(docs, lists, "inner").select("text", "want").mapInArrow(run, _PIECE)


def _full_depth(pieces_: DataFrame, unit: Unit) -> DataFrame:
    """(h, sk, a, b) of single windows that start again: prefixes of a window's whole length, told apart by 128 bits, and their weights."""

    def run(batches):
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                cut = _cut(x["seg"], unit)
                for i in range(x["n"]):
                    d = blake2b(cut(i, i + unit.width), digest_size=16).digest()
                    rows.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), x["h"], x["sk"], x["at"] + i, x["m"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, [pa.int64()] * 4 + [pa.int32(), pa.int64()])], ["w1", "w2", "h", "sk", "a", "m"])

    windows = written(pieces_.mapInArrow(run, "w1 long, w2 long, h long, sk long, a int, m long"), "whole-windows")
    # a table, so that the join of a hot window meets two plain shuffles and Spark can split it
    again = written(windows.groupBy("w1", "w2").agg(F.sum("m").alias("m")).filter("m > 1").select("w1", "w2"), "repeated-windows")
    return windows.drop("m").join(again, ["w1", "w2"]).select("h", "sk", "a", (F.col("a") + 1).alias("b"))


def _by_group(pieces_: DataFrame, marks: Callable[[list[dict]], list[np.ndarray]], names: tuple[str, str]) -> DataFrame:
    """(names, a, b): runs of windows that ``marks`` finds again, groups being whole in one call."""

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            while len(held) > BLOCK:
                cut = next((i for i in range(BLOCK, 0, -1) if held[i]["key"] != held[i - 1]["key"]), None)
                if cut is None:
                    break
                yield _runs(held[:cut], marks, names)
                held = held[cut:]
        if held:
            yield _runs(held, marks, names)

    return pieces_.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"{names[0]} long, {names[1]} long, a int, b int")


def _runs(rows: list[dict], marks, names: tuple[str, str]) -> pa.RecordBatch:
    out = []
    for x, hit in zip(rows, marks(rows)):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
        out += [(x[names[0]], x[names[1]], x["at"] + a, x["at"] + b) for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])], [*names, "a", "b"])


def _divided(rows: DataFrame, unit: Unit, marks, group: int) -> DataFrame:
    """(h, sk, a, b) of pieces of divided groups. Equal pieces are sorted once; groups that are still large go to full depth."""
    named = written(rows.withColumn("pk", F.xxhash64("seg", "o", "n")), "divided-pieces")
    one = written(named.groupBy("key", "pk").agg(F.first(F.struct("o", "n", "seg")).alias("x"), F.sum("m").alias("m")).select("key", "pk", F.lit(0).alias("at"), "x.*", "m"), "distinct-pieces")
    large = written(one.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > group).select("key"), "large-prefixes")
    runs = written(_by_group(one.join(large, "key", "left_anti"), marks, ("key", "pk")), "piece-runs")
    found = named.select("key", "pk", "h", "sk", "at").join(runs, ["key", "pk"]).select("h", "sk", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))
    deep = named.join(large, "key", "left_semi").select("h", "sk", "at", "n", "m", "seg")
    return found.unionByName(_full_depth(deep, unit))


def repeated(docs: DataFrame, unit: Unit, marks: Callable[[list[dict]], list[np.ndarray]], group: int | None = None) -> DataFrame:
    """(did, th, spans): symbols covered by windows that start anywhere else, as [first, end) pairs, not merged; ``docs`` is keyed.

    Rows that repeat id and text are one entry and occur as often as they are there.
    """
    group = group or GROUP
    with temporary() as keep:
        every = written(anchors(docs, unit), "anchors")
        # a table of its own, so that the join below meets two plain shuffles and Spark can split a hot anchor
        often = written(every.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "anchors-often")
        found = written(every.join(often, "h"), "anchors-again")
        discard(every)
        distinct = found.groupBy("h", "sk").agg(F.min(F.struct("did", "th", "s", "n", "o")).alias("x"), F.count(F.lit(1)).alias("m"))
        distinct = written(distinct.select("h", "sk", "x.*", "m"), "segments")
        size = written(distinct.groupBy("h").agg(F.count(F.lit(1)).alias("g")), "group-sizes")
        text = written(_extract(docs, distinct.join(size, "h"), unit, group), "segment-texts")
        discard(distinct)
        runs = _by_group(text.filter("not divided"), marks, ("h", "sk"))
        if not size.filter(F.col("g") > group).isEmpty():
            runs = runs.unionByName(_divided(text.filter("divided").drop("divided"), unit, marks, group))
        runs = written(runs, "repeated-runs")
        discard(text)
        where = found.select("h", "sk", "did", "th", "s").join(runs, ["h", "sk"])
        pair = F.struct((F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b") - 1 + unit.width).alias("b"))
        return keep(written(where.groupBy("did", "th").agg(F.collect_set(pair).alias("spans")), "repeated-spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted, disjoint and apart."""
    out: list[tuple[int, int]] = []
    for x in sorted(((x["a"], x["b"]) for x in spans or [])):
        if out and x[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], x[1]))
        else:
            out.append(x)
    return out
