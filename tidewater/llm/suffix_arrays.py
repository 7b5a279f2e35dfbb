"""Removal of byte strings that start again anywhere, with suffix arrays built by linear grouping.

Segments of the corpus (see ``repeats``) are sorted in blocks. What follows each anchor is written in symbols of 16 bytes; a block's
symbols are one string, of which ``suffix_array`` sorts all suffixes in time linear in its length. Neighbours' common prefixes then
tell, at every depth, which segments agree to the right of their anchors; those that agree to the left as well hold equal windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import encoded, keyed, pieces, same_key
from tidewater.llm.repeats import Unit, merged, repeated

LENGTH = 200
#: Bytes of a symbol, a multiple of 8.
SYMBOL = 16
UNIT = Unit(words=False, width=LENGTH, gram=16, grid=16)


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes in ascending order, by groups of equal Lyndon prefixes.

    ``text`` holds ranks from 0 up, the last symbol being the only 0. First, groups are processed from the highest down: each member
    points to the last suffix before it in a lower group; those pointed at move, by how often they are, to new groups just above
    their own. Then suffixes are placed in ascending order: each placed one places those whose Lyndon prefix ends before it, at the
    next free place of their group.
    """
    n = len(text)
    start = [0] * (max(text) + 2)
    for c in text:
        start[c + 1] += 1
    for c in range(1, len(start)):
        start[c] += start[c - 1]
    group = [start[c] for c in text]  # of each suffix: where its group begins
    order, free = [0] * n, start[:]
    place = [0] * n
    for i, c in enumerate(text):
        order[free[c]], place[i] = i, free[c]
        free[c] += 1
    size = [0] * (n + 1)
    for c in range(len(start) - 1):
        size[start[c]] = start[c + 1] - start[c]
    before = [-1] * n
    high = n
    while high > 0:
        low = group[order[high - 1]]
        members = order[low:high]
        high = low
        if len(members) == 1:
            i = members[0]
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                g = group[j]
                last = size[g] - 1
                if last:
                    size[g] = last
                    end = g + last
                    k, p = order[end], place[j]
                    order[end], order[p], place[j], place[k] = j, k, end, p
                    group[j], size[end] = end, 1
            continue
        members.sort()
        count: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= low:
                j = before[j]
            before[i] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        by: dict[tuple[int, int], list[int]] = {}
        for j, c in count.items():
            by.setdefault((-c, group[j]), []).append(j)
        for _, g in sorted(by) if len(by) > 1 else by:
            moved = by[_, g]
            new = g + size[g] - len(moved)
            end = g + size[g]
            for j in moved:
                end -= 1
                k, p = order[end], place[j]
                order[end], order[p], place[j], place[k] = j, k, end, p
            if new > g:
                size[g], size[new] = new - g, len(moved)
                for j in moved:
                    group[j] = new
    free = list(range(n + 1))  # next place of each group, by where it begins
    done = [False] * n
    out = [0] * n
    out[0], done[n - 1] = n - 1, True
    free[group[n - 1]] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]], done[j] = j, True
            free[g] += 1
            j = before[j]
    return out


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)


def _common(m: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row and the one before; of the first, -1."""
    differ = m[1:] != m[:-1]
    return np.concatenate(([-1], np.where(differ.any(1), differ.argmax(1), m.shape[1])))


def _order(right: np.ndarray) -> np.ndarray:
    """Rows in ascending order, from the suffix array of all rows' symbols."""
    n, width = len(right), right.shape[1] // SYMBOL
    halves = np.ascontiguousarray(right).view(">u8").reshape(n * width, SYMBOL // 8)
    order = np.lexsort(halves.T[::-1])
    new = np.zeros(n * width, np.int64)
    new[1:] = (halves[order[1:]] != halves[order[:-1]]).any(1)
    ranks = np.empty(n * width, np.int64)
    ranks[order] = np.cumsum(new)
    ranks, symbols = ranks.reshape(n, width), halves.any(1).reshape(n, width)
    # trailing zero symbols say nothing; every row ends in a separator of its own, all below other symbols
    length = np.where(symbols.any(1), width - symbols[:, ::-1].argmax(1), 0)
    text: list[int] = []
    begin = np.concatenate(([0], np.cumsum(length + 1)))
    body = np.empty(int(begin[-1]) + 1, np.int64)
    body[begin[1:] - 1] = np.arange(1, n + 1)
    inside = np.arange(width)[None, :] < length[:, None]
    at = begin[:-1, None] + np.arange(width)[None, :]
    body[at[inside]] = ranks[inside] + n + 1
    body[-1] = 0
    # ranks without gaps
    _, body = np.unique(body, return_inverse=True)
    text = body.tolist()
    found = np.array(suffix_array(text), np.int64)
    row = np.full(len(text), -1, np.int64)
    row[begin[:-1]] = np.arange(n)
    found = row[found]
    return found[found >= 0]


def marks(rows: list[dict], width: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its windows start again among ``rows`` (seg, o, n, m)."""
    n = len(rows)
    o, count, m = (np.array([r[c] for r in rows], np.int64) for c in ("o", "n", "m"))
    span = -(-width // SYMBOL) * SYMBOL
    right = _matrix([r["seg"][r["o"] :] for r in rows], span)
    by_right = _order(right)
    left = _matrix([r["seg"][: r["o"]][::-1] for r in rows], max(1, int(o.max())))
    by_left = np.argsort(np.ascontiguousarray(left).view(f"V{left.shape[1]}").ravel(), kind="stable") if n > 1 else np.zeros(1, np.int64)
    right_common, left_common = _common(right[by_right]), _common(left[by_left])
    out = [np.zeros(c, bool) for c in count.tolist()]
    flat_at = np.concatenate(([0], np.cumsum(count)))
    flat = np.zeros(int(flat_at[-1]), bool)
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for back in range(int((o - count + 1).min()), int(o.max()) + 1):
        have = np.flatnonzero((o >= back) & (o - count + 1 <= back))
        if not len(have):
            continue
        right_class[by_right] = np.cumsum(right_common < width - back)
        left_class[by_left] = np.cumsum(left_common < back)
        both = right_class[have] * (n + 1) + left_class[have]
        order = np.argsort(both, kind="stable")
        key = both[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        first = np.flatnonzero(new)
        weight = np.add.reduceat(m[have][order], first)
        again = have[order[(weight > 1)[np.cumsum(new) - 1]]]
        flat[flat_at[again] + o[again] - back] = True
    return [flat[a:b] for a, b in zip(flat_at[:-1].tolist(), flat_at[1:].tolist())] if n else out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, text, kept, n_bytes, n_removed, spans) of every row: ``kept`` has the bytes that no repeated string of 200 covers.

    Null texts are empty; texts under 200 bytes are kept whole; a text that occurs twice goes wholly if it has 200 bytes. Rows that
    repeat id and text have equal results. ``kept`` is binary, as bytes of a character may be parted.
    """
    own = keyed(docs, id_col, text_col)
    joined = same_key(own, repeated(own, UNIT, marks), "left").select("did", "text", "spans")

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for data, spans in zip(encoded(batch.column(1)), batch.column(2).to_pylist()):
                spans, at, parts = merged(spans), 0, []
                for a, b in spans:
                    parts.append(data[at:a])
                    at = b
                rows.append((b"".join([*parts, data[at:]]), len(data), sum(b - a for a, b in spans), [{"a": a, "b": b} for a, b in spans]))
            kept, size, gone, spans = zip(*rows)
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind)], ["did", "kept", "n_bytes", "n_removed", "spans"])

    return joined.mapInArrow(run, "did long, kept binary, n_bytes long, n_removed long, spans array<struct<a:int,b:int>>")


def digest(out: DataFrame) -> DataFrame:
    return out.select(F.col("did").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by counting every string; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, np.int8)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[1 + i : 1 + i + length] = 1
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((len(t), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
