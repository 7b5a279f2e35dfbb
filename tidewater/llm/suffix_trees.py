"""Removal of word sequences that start again anywhere, with suffix trees over groups of suffixes that share a prefix.

The suffixes that begin at anchors (see ``repeats``) are dealt out by prefixes of varying length: eight words are enough where a group
stays small, 32 words and at last the whole window divide the others. Each group's suffixes become a suffix tree in the memory of one
task, as do their left contexts read backwards. A window that lies l words before an anchor is a repeat if another leaf is below the
same node of at least 35 - l words to the right and the same node of at least l words to the left; so deep nodes of both trees give the
repeats, and consecutive windows join to maximal ones.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import encoded, keyed, pieces, same_key
from tidewater.llm.repeats import Unit, merged, repeated

LENGTH = 35
UNIT = Unit(words=True, width=LENGTH, gram=8, grid=4)


class Subtree:
    """The suffix tree of a group: leaves in lexicographic order and internal nodes with string depth, span of leaves and parent."""

    def __init__(self, suffixes: np.ndarray):
        """``suffixes``: rows of word ranks from 1 up, 0 behind the end of a shorter one."""
        rows = np.ascontiguousarray(suffixes.astype(">u4"))
        n, width = rows.shape
        self.leaves = np.argsort(rows.view(f"V{4 * width}").ravel(), kind="stable") if n > 1 else np.zeros(n, np.int64)
        ordered = rows[self.leaves]
        differ = (ordered[1:] != ordered[:-1]) | (ordered[1:] == 0)
        common = np.where(differ.any(1), differ.argmax(1), width)  # of neighbours
        depth, low, high, parent = [0], [0], [n - 1], [-1]  # the root
        open_ = [0]
        for i, d in enumerate(common.tolist(), 1):
            last = -1
            while depth[open_[-1]] > d:
                last = open_.pop()
                high[last] = i - 1
                if depth[open_[-1]] >= d:
                    parent[last] = open_[-1]
            if depth[open_[-1]] < d:  # a new node, above what was just closed
                depth.append(d)
                low.append(low[last] if last >= 0 else i - 1)
                high.append(n - 1)
                parent.append(-1)
                if last >= 0:
                    parent[last] = len(depth) - 1
                open_.append(len(depth) - 1)
        for below, above in zip(open_[:0:-1], open_[-2::-1]):
            parent[below] = above
        self.depth, self.low, self.high, self.parent = (np.array(x, np.int64) for x in (depth, low, high, parent))

    def classes(self, least: int) -> np.ndarray:
        """Of each suffix, in the order given, the highest node of at least that depth above it, as a number; its own where there is none."""
        above = np.where(self.parent < 0, -1, self.depth[self.parent])
        deep = (self.depth >= least) & (above < least)
        inner = np.zeros(len(self.leaves) + 1, np.int64)
        np.add.at(inner, self.low[deep] + 1, 1)
        np.add.at(inner, self.high[deep] + 1, -1)
        out = np.empty(len(self.leaves), np.int64)
        out[self.leaves] = np.cumsum(np.cumsum(inner[:-1]) == 0)
        return out


def marks(rows: list[dict], width: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its windows start again among ``rows`` (seg, o, n, m): by nodes of the trees to both sides of anchors."""
    words = [r["seg"].split(b" ") for r in rows]
    ranks: dict[bytes, int] = {}
    o, count, m = (np.array([r[c] for r in rows], np.int64) for c in ("o", "n", "m"))
    most = max(1, int(o.max()))
    right, left = np.zeros((len(rows), width), np.int64), np.zeros((len(rows), most), np.int64)
    for i, (ws, at) in enumerate(zip(words, o.tolist())):
        x = [ranks.setdefault(w, len(ranks) + 1) for w in ws]
        after = x[at : at + width]
        right[i, : len(after)] = after
        left[i, :at] = x[:at][::-1]
    after, before = Subtree(right), Subtree(left)
    flat_at = np.concatenate(([0], np.cumsum(count)))
    flat = np.zeros(int(flat_at[-1]), bool)
    for back in range(int((o - count + 1).min()), int(o.max()) + 1):
        have = np.flatnonzero((o >= back) & (o - count + 1 <= back))
        if len(have):
            both = after.classes(width - back)[have] * (len(rows) + 1) + before.classes(back)[have]
            _, which = np.unique(both, return_inverse=True)
            again = have[np.bincount(which, weights=m[have])[which] > 1]
            flat[flat_at[again] + o[again] - back] = True
    return [flat[a:b] for a, b in zip(flat_at[:-1].tolist(), flat_at[1:].tolist())]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, kept, n_words, n_removed, spans) of every row: ``kept`` joins the words that no repeated run of 35 covers by one space.

    Null texts have no words; texts under 35 words are kept whole; a text that occurs twice goes wholly if it has 35 words. Rows that
    repeat id and text have equal results. Words compare as they are, by case and mark.
    """
    own = keyed(docs, id_col, text_col)
    joined = same_key(own, repeated(own, UNIT, marks), "left").select("did", "text", "spans")

    def run(batches):
        for batch in pieces(batches):
            rows = []
            for data, spans in zip(encoded(batch.column(1)), batch.column(2).to_pylist()):
                words, spans, at, parts = data.split(), merged(spans), 0, []
                for a, b in spans:
                    parts += words[at:a]
                    at = b
                parts += words[at:]
                rows.append((b" ".join(parts).decode("utf-8"), len(words), len(words) - len(parts), [{"a": a, "b": b} for a, b in spans]))
            kept, size, gone, spans = zip(*rows)
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, kind)], ["did", "kept", "n_words", "n_removed", "spans"])

    return joined.mapInArrow(run, "did long, kept string, n_words long, n_removed long, spans array<struct<a:int,b:int>>")


def digest(out: DataFrame) -> DataFrame:
    return out.select(F.col("did").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, str]]:
    """(n_words, n_removed, kept_sha256) by counting every window; for tests."""
    seen: dict[tuple, int] = {}
    split = [t.split() for t in texts]
    for ws in split:
        for i in range(len(ws) - length + 1):
            seen[tuple(ws[i : i + length])] = seen.get(tuple(ws[i : i + length]), 0) + 1
    out = []
    for ws in split:
        gone = [False] * len(ws)
        for i in range(len(ws) - length + 1):
            if seen[tuple(ws[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = [w for w, g in zip(ws, gone) if not g]
        out.append((len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
