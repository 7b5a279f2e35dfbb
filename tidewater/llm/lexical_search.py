"""Ranked lexical search of all documents for each of a set of items, exact, by a dual-tree search.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case. A document's score for an item
sums w(t) * g(t, document) over the item's terms, all in integers; both factors are never negative, so a node of documents that holds
the maximum of g in each coordinate, and a node of items that holds the maximum of w, bound every score between their members.

Documents become sparse rows over the items' terms, one scan for each block of items. A task reads its documents in chunks, orders
them by their two strongest terms, and builds leaves of ``LEAF`` documents and nodes of ``FANOUT`` leaves. Items have such a
hierarchy too. A pair of nodes goes on only if its bound reaches the weakest k-th score among the node's items; what is left is
scored exactly. The first k-th scores come from a search of one document in ``SEED_SHARE``: that is a subset, so they are true lower
bounds, and every document is searched afterwards. Tasks return k rows an item at most.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import discard, pieces, temporary, written

K = 50
#: Bytes of item texts that a task holds at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Documents and nonzero coordinates of a chunk, documents of a leaf, children of a node.
CHUNK, CHUNK_CELLS, LEAF, FANOUT = 2048, 1 << 19, 16, 16
#: Items of a leaf.
ITEM_LEAF = 8
SEED_SHARE = 16

_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_PIECE = 1 << 20


def terms(raw: bytes):
    """Lists of the terms of UTF-8 bytes, about a megabyte of text at a time."""
    if len(raw) <= _PIECE:
        yield raw.lower().translate(_SPACES).split()
        return
    flat, at = raw.lower().translate(_SPACES), 0
    while at < len(flat):
        end = flat.find(b" ", at + _PIECE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].split()
        at = end


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(did, th, n, ids, tfs) of the documents that have a term: all terms counted, and the counts of those in the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for batch in pieces(batches):
            n, cells, ids, tfs = [], [], [], []
            for text in batch.column(2).to_pylist():
                total, count = 0, {}
                for part in terms((text or "").encode()):
                    total += len(part)
                    for t in part:
                        if (i := known.get(t)) is not None:
                            count[i] = count.get(i, 0) + 1
                n.append(total)
                cells.append(len(count))
                for i in sorted(count):
                    ids.append(i)
                    tfs.append(count[i])
            offsets = pa.array(np.concatenate(([0], np.cumsum(cells))).astype(np.int32))
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int64()))]
            out = pa.RecordBatch.from_arrays(arrays, ["did", "th", "n", "ids", "tfs"])
            yield out.filter(pa.array(np.array(n) > 0))

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("did"), F.xxhash64(F.lit(13), F.col(id_col), text).alias("th"), text.alias("text"))
    return rows.mapInArrow(run, "did long, th long, n long, ids array<int>, tfs array<long>")


class Items:
    """The items of a block, their weights, and the hierarchy over them: leaves of near items, and the root."""

    def __init__(self, rows: list[tuple[list[int], ...]], weights: np.ndarray):
        own = [np.array(ids, np.int64) for ids in rows]
        own = [x[weights[x] > 0] for x in own]
        strongest = [tuple(x[np.lexsort((x, -weights[x]))][:2]) for x in own]
        self.order = sorted(range(len(own)), key=lambda i: strongest[i])
        self.terms, self.weights = own, weights
        self.leaves = [self.order[i : i + ITEM_LEAF] for i in range(0, len(own), ITEM_LEAF)]
        self.nodes = [self.leaves[i : i + ITEM_LEAF] for i in range(0, len(self.leaves), ITEM_LEAF)]
        union = lambda items: np.unique(np.concatenate([own[i] for i in items])) if items else np.zeros(0, np.int64)
        self.leaf_terms = [union(x) for x in self.leaves]
        self.node_terms = [union([i for leaf in x for i in leaf]) for x in self.nodes]


class Best:
    """The k best documents of each item so far: by score, then id with null last, then hash of the text."""

    def __init__(self, items: int, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.rows = [np.zeros((0, 4), np.int64) for _ in range(items)]

    def add(self, item: int, score: np.ndarray, absent: np.ndarray, did: np.ndarray, th: np.ndarray) -> None:
        good = score >= max(1, self.floor[item])
        if not good.any():
            return
        new = np.stack((score[good], absent[good], did[good], th[good]), axis=1)
        both = np.concatenate((self.rows[item], new))
        both = both[np.lexsort((both[:, 3], both[:, 2], both[:, 1], -both[:, 0]))][: self.k]
        self.rows[item] = both
        if len(both) == self.k:
            self.floor[item] = max(self.floor[item], both[-1, 0])


def gains(tfs: np.ndarray, n: np.ndarray, doc: np.ndarray, documents: int, length: int) -> np.ndarray:
    """g of each coordinate, rounded down: with weights never negative, sums of w * g are the scores."""
    if 50 * int(n.max(initial=0)) * documents < 1 << 62:
        m = 50 + (50 * n * documents) // length
    else:
        m = np.array([50 + (50 * int(x) * documents) // length for x in n], dtype=np.int64)
    return (1_000_000_000 * tfs) // (1000 * tfs + 20 * m[doc])


def search_chunk(items: Items, best: Best, did, absent, th, n, cells, ids, tfs, documents: int, length: int) -> int:
    """Adds a chunk's documents to the best; returns how many pairs of an item and a document were scored."""
    size, w = len(n), items.weights
    doc = np.repeat(np.arange(size), cells)
    g = gains(tfs, n, doc, documents, length)
    gain = w[ids] * g
    # documents in the order of their strongest terms, so that leaves hold like documents
    by = np.lexsort((ids, -gain, doc))
    first = np.concatenate(([0], np.cumsum(cells)))[:-1]
    one, two = np.full(size, -1), np.full(size, -1)
    one[cells > 0] = ids[by][first[cells > 0]]
    two[cells > 1] = ids[by][first[cells > 1] + 1]
    place = np.empty(size, np.int64)
    place[np.lexsort((two, one))] = np.arange(size)
    spot = place[doc]
    there, col = np.unique(ids, return_inverse=True)
    leaves = -(-size // LEAF)
    nodes = -(-leaves // FANOUT)
    leaf_max = np.zeros((nodes * FANOUT, len(there)))
    np.maximum.at(leaf_max, (spot // LEAF, col), g.astype(np.float64))
    node_max = leaf_max.reshape(nodes, FANOUT, len(there)).max(axis=1)
    sort = np.argsort(spot, kind="stable")
    spot, g, ids = spot[sort], g[sort], ids[sort]
    begin = np.searchsorted(spot, np.arange(size + 1))
    at = np.empty(size, np.int64)
    at[place] = np.arange(size)
    did, absent, th = did[at], absent[at], th[at]
    column = np.full(len(w), -1, np.int64)
    column[there] = np.arange(len(there))
    local = np.full(len(w), -1, np.int64)
    scored = 0

    def bounds(table: np.ndarray, own: np.ndarray) -> np.ndarray:
        have = own[column[own] >= 0]
        return table[:, column[have]] @ w[have].astype(np.float64)

    for i, node in enumerate(items.nodes):
        weakest = min(best.floor[x] for leaf in node for x in leaf)
        near = np.flatnonzero(bounds(node_max, items.node_terms[i]) >= max(1, weakest))
        if not len(near):
            continue
        own_leaves = (near[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        table = leaf_max[own_leaves]
        for j, leaf in enumerate(node, i * ITEM_LEAF):
            bound = bounds(table, items.leaf_terms[j])
            keep = bound >= max(1, min(best.floor[x] for x in leaf))
            if not keep.any():
                continue
            # the best bounds first, some leaves at a time: the k-th scores rise and later leaves fall below them
            queue = own_leaves[keep][np.argsort(-bound[keep], kind="stable")]
            limit = -np.sort(-bound[keep], kind="stable")
            used = items.leaf_terms[j]
            local[used] = np.arange(len(used))
            table_w = np.zeros((len(used), len(leaf)))
            for c, x in enumerate(leaf):
                table_w[local[items.terms[x]], c] = w[items.terms[x]]
            for k in range(0, len(queue), FANOUT):
                if limit[k] < max(1, min(best.floor[x] for x in leaf)):
                    break
                docs = (np.sort(queue[k : k + FANOUT])[:, None] * LEAF + np.arange(LEAF)).ravel()
                docs = docs[docs < size]
                counts = begin[docs + 1] - begin[docs]
                cell = np.repeat(begin[docs] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
                c = local[ids[cell]]
                row = np.repeat(np.arange(len(docs)), counts)[c >= 0]
                dense = np.zeros((len(docs), len(used)))
                dense[row, c[c >= 0]] = g[cell[c >= 0]]
                scores = np.rint(dense @ table_w).astype(np.int64)  # sums below 2 ** 53, so exact
                scored += scores.size
                for c, x in enumerate(leaf):
                    best.add(x, scores[:, c], absent[docs], did[docs], th[docs])
            local[used] = -1
    return scored


def _chunks(batches):
    """Arrays of up to CHUNK documents and about CHUNK_CELLS coordinates."""
    held, rows, cells = [], 0, 0
    for batch in batches:
        at = 0
        sizes = np.diff(batch.column(3).offsets.to_numpy())
        while at < batch.num_rows:
            ends = np.cumsum(sizes[at:]) + cells
            take = max(1, min(CHUNK - rows, int(np.searchsorted(ends, CHUNK_CELLS, "right"))))
            part = batch.slice(at, take)
            held.append(part)
            rows, cells, at = rows + part.num_rows, cells + int(sizes[at : at + take].sum()), at + take
            if rows >= CHUNK or cells >= CHUNK_CELLS:
                yield held
                held, rows, cells = [], 0, 0
    if held:
        yield held


def searched(table: DataFrame, items: Items, floor: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(item, score, did, th): of each task, the k best of each item at or above its floor; item is the place in the block."""
    shared = table.sparkSession.sparkContext.broadcast((items, floor))

    def run(batches):
        items, floor = shared.value
        best = Best(len(items.terms), floor, k)
        for held in _chunks(batches):
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, tfs = whole.column("ids").combine_chunks(), whole.column("tfs").combine_chunks()
            ids, tfs = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (ids, tfs))
            did = whole.column("did")
            search_chunk(
                items, best, did.fill_null(0).to_numpy(), did.is_null().to_numpy().astype(np.int64), whole.column("th").to_numpy(), whole.column("n").to_numpy(),
                np.diff(ids.offsets.to_numpy()).astype(np.int64), ids.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy(), documents, length,
            )
        for item, rows in enumerate(best.rows):
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), item, np.int32)), pa.array(rows[:, 0]), pa.array(rows[:, 2], mask=rows[:, 1] > 0), pa.array(rows[:, 3])], ["item", "score", "did", "th"])

    return table.mapInArrow(run, "item int, score long, did long, th long")


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank; an item's rows are cut in pieces first."""
    order = [F.desc("score"), F.asc_nulls_last("did"), F.asc("th")]
    piece = Window.partitionBy("item", F.pmod("th", F.lit(32))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(piece)).filter(F.col("rank") <= k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def _searched_block(docs: DataFrame, block: list, k: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    own = [sorted({t for part in terms((r["text"] or "").encode()) for t in part}) for r in block]
    vocabulary = {t: i for i, t in enumerate(sorted({t for x in own for t in x}))}
    table = written(vectors(docs, vocabulary, id_col, text_col), "term-vectors")
    documents, length = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(vocabulary), np.int64)
    for r in table.select(F.explode("ids").alias("t")).groupBy("t").count().collect():  # a row for each of the block's terms at most
        weights[r["t"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["count"] + 1)))
    items = Items([[vocabulary[t] for t in x] for x in own], weights)
    floor = np.zeros(len(block), np.int64)
    seed = searched(table.filter(F.pmod("th", F.lit(SEED_SHARE)) == 0), items, floor, documents, length, k)
    for r in _best(seed, k).filter(F.col("rank") == k).select("item", "score").collect():  # a row for each of the block's items at most
        floor[r["item"]] = r["score"]
    best = _best(searched(table, items, floor, documents, length, k), k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], "item int, item_id long")
    out = written(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("did").alias("doc_id"), "score"), "ranked")
    discard(table)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item (item_id, text) with a score above 0.

    Null and empty texts have no terms: such documents are not counted and never found, such items find nothing. Rows that repeat a
    document count each and are ranked each, equal scores by id with null last, then by hash of the text. Rows that repeat an item's
    id and text are one item; another text under the same id is an item of its own. Without documents or items there are no rows.
    Items come to the driver in blocks of about ``block_bytes`` of text; documents never do.
    """
    spark = docs.sparkSession
    with temporary() as keep:
        size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
        found = written(items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct(), "items")
        total = found.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()["b"]
        blocks = max(1, -(-int(total) // block_bytes))
        out = []
        for b in range(blocks):
            block = found.filter(F.pmod(F.xxhash64(F.lit(5), "item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
            if block:
                out.append(keep(_searched_block(docs, block, k, id_col, text_col)))
    if not out:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out)
