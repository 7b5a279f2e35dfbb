"""An exact similarity join of texts on their word shingles, as a blocked sparse product of texts by shingles.

Shingles have one order for all texts: rare before common, then by hash. Two sets as similar as asked share a shingle among the first
few of each, as many as their sizes allow to be missing. So only those columns of the incidence matrix are multiplied: rows meet by
shingle, a pair is discarded where it first meets if what is left after its common shingle cannot reach the bound that both sizes
set, overlaps are summed over what remains, and whole sets decide.

Many near copies of one text share all those columns, and their product would hold all their pairs. Such rows are referred to one set
in their midst, and the product is made of differences from it: two sets overlap in what the reference has, less what each lacks, plus
what their differences have in common. So two rows can only be similar if their differences share as much as their distances from the
reference exceed the bound, and edits made independently share next to nothing. Rows close to their reference are linked to it and are
not compared with one another. Where differences are shared by many again, their rows get a reference among themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import NO_ID, blocks_of, encoded, keyed, mix, ngram_hashes, numbered, pieces, repeated, same_key, temporary, word_hashes, written
from tidewater.llm.components import components

WORDS = 5
#: Similarity in percent.
PERCENT = 80
#: Shingles that count as common, the most frequent ones. It decides the order alone, not the result.
COMMON = 1 << 18
#: Sets of one shingle beyond which they look for a reference, and how often differences are taken, the second time only where many
#: still meet. Both decide the work alone.
HOT, LEVELS = 8, 2
#: Rows of a shingle that are held together; more are dealt out as pairs of blocks.
BLOCK = 1024
#: Parts of a common shingle's rows while repeated rows are dropped.
SALT = 1024
_PAIRS = 200_000


def shingles(texts: list[bytes], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of each text's shingles."""
    out: list[np.ndarray] = []
    for first, last, raw, begin in blocks_of(texts):
        starts, _, h = word_hashes(raw.lower())
        doc = np.searchsorted(begin, starts, "right") - 1
        count = np.bincount(doc, minlength=last - first)
        at = np.concatenate(([0], np.cumsum(count)))
        grams = ngram_hashes(h, k) >> np.uint64(1)
        for i in range(last - first):
            a, n = int(at[i]), int(count[i])
            if n >= k:
                out.append(np.unique(grams[a : a + n - k + 1]))
            elif n:  # too few words: the whole sequence, apart from all shingles
                out.append(mix(ngram_hashes(h[a : a + n], n) + np.uint64(n)) >> np.uint64(1))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def node(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit fingerprints of a set: equal sets are one node."""
    if not len(s):
        return 0, 0
    sums = np.array([mix(s).sum(dtype=np.uint64), mix(s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)])
    one = mix(mix(sums[:1]) + sums[1:] * np.uint64(0x2545F4914F6CDD1D) + np.uint64(len(s)))
    two = mix(mix(sums[1:] + np.uint64(len(s))) + sums[:1] * np.uint64(0xA24BAED4963EE407))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def sketch(s: np.ndarray) -> bytes:
    """Whether each cell of a table of one to two cells an element holds an odd number of elements, as bits."""
    cells = 1 << max(3, len(s).bit_length())
    return np.packbits(np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1, bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the elements that one of two sets has and the other lacks, from their sketches."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):  # the larger table is folded
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def describe(docs: DataFrame, k: int, mask: int = -1) -> DataFrame:
    """One pass over the texts: (kind 0) a row for each text, (kind 1) shingles that several texts of one batch have."""

    def run(batches):
        for batch in pieces(batches, 1 << 23):
            sets = shingles(encoded(batch.column(2)), k)
            n = len(sets)
            every = np.sort(np.concatenate(sets))
            cut = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
            times = np.diff(np.append(cut, len(every)))
            often = times > 2
            h, c = every[cut[often]].view(np.int64), times[often]
            none = [None] * len(h)
            nodes = [node(s) for s in sets]
            cols = [
                pa.array(np.concatenate((np.zeros(n, np.int32), np.ones(len(h), np.int32)))),
                pa.concat_arrays([batch.column(0), pa.array(none, pa.int64())]),
                pa.concat_arrays([batch.column(1), pa.array(none, pa.int64())]),
                pa.array([*(x & mask for x, _ in nodes), *h.tolist()], pa.int64()),
                pa.array([*(y for _, y in nodes), *none], pa.int64()),
                pa.array([*map(len, sets), *c.tolist()], pa.int64()),
                pa.array([*map(sketch, sets), *none], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["kind", "did", "th", "c", "d", "n", "sketch"])

    return docs.mapInArrow(run, "kind int, did long, th long, c long, d long, n long, sketch binary")


def postings(docs: DataFrame, common: np.ndarray, k: int, percent: int, clash: frozenset[int] = frozenset(), mask: int = -1) -> DataFrame:
    """(h, c, n, i): the first shingles of each set in the order of all, with their places; a set once per task. Common ones are negative."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    top = np.uint64(1 << 63)

    def run(batches):
        seen: set[int] = set()
        rare = shared.value
        for batch in pieces(batches, 1 << 23):
            out: list[list] = [[], [], [], []]
            for s in shingles(encoded(batch.column(0)), k):
                n = len(s)
                one, two = node(s)
                c = (one & mask) ^ two if one & mask in clash else one & mask
                if not n or c in seen:
                    continue
                seen.add(c)
                at = np.minimum(np.searchsorted(rare, s), max(0, len(rare) - 1))
                key = np.where(rare[at] == s, s | top, s) if len(rare) else s
                key.sort()
                first = n - -(-percent * n // 100) + 1
                for column, v in zip(out, (key[:first].view(np.int64), np.full(min(first, n), c), np.full(min(first, n), n, np.int32), np.arange(min(first, n), dtype=np.int32))):
                    column.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["h", "c", "n", "i"])

    return docs.select("text").mapInArrow(run, "h long, c long, n int, i int")


def _sorted(often: DataFrame) -> np.ndarray:
    """The common shingles as a sorted array, at most COMMON of eight bytes."""
    return np.sort(np.array([r["c"] for r in often.select("c").toLocalIterator()], np.int64)).view(np.uint64)


def _shared(rows: DataFrame) -> DataFrame:
    """Rows of shingles that at least two sets have among their first, and of all common shingles; equal rows once.

    The rows of a common shingle are dealt out by set, so that none is a task's own.
    """

    def run(batches):
        held, last, open_ = None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            h, c = (np.asarray(batch.column(i), np.int64) for i in (0, 1))
            new_h = np.concatenate(([last is None or h[0] != last[0]], h[1:] != h[:-1]))
            new = new_h | np.concatenate(([last is None or c[0] != last[1]], c[1:] != c[:-1]))
            # a row stays if another set of its shingle comes before or after it
            start = np.maximum.accumulate(np.where(new_h, np.arange(len(h)), -1))
            second = new & ~new_h
            keep = second | (new & (h < 0))
            firsts = start[np.flatnonzero(second)]
            keep[firsts[firsts >= 0]] = True
            if held is not None and not new_h[0]:
                end = int(np.argmax(new_h)) if new_h.any() else len(h)
                if not open_ and second[:end].any():
                    yield held
                    open_ = True
            yield batch.filter(pa.array(keep))
            if new_h.any():
                at = len(h) - 1 - int(np.argmax(new_h[::-1]))
                held, open_ = batch.slice(at, 1), bool(keep[at])
            last = (h[-1], c[-1])

    salt = F.when(F.col("h") < 0, F.pmod("c", F.lit(SALT))).otherwise(0)
    return rows.repartition(F.col("h"), salt).sortWithinPartitions("h", "c").mapInArrow(run, "h long, c long, n int, i int")


def _references(rows: DataFrame, least: int = 0) -> DataFrame | None:
    """(c, ref) for sets that meet many others: the set that most of their shingles name, of a size within about half and double.

    A shingle of many sets names the one, by class of size, that meets most others over all its shingles: an original rather than
    its copies. A set follows if an eighth of its first shingles name one. None if no shingle has many sets, or these are fewer than
    ``least`` pairs a row.
    """
    sizes = written(rows.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > HOT), "hot-shingles")
    # tables of their own, here and below, so that joins on a hot key meet two plain shuffles that Spark can split
    pairs = sizes.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0]
    if pairs is None or pairs < least * rows.count():
        return None
    hot = written(rows.select("h", "c", "first", "size").join(sizes, "h"), "hot-rows")
    degree = hot.groupBy("c").agg(F.sum("m").alias("degree"))
    size = F.log2("size")
    classes = F.explode(F.array(F.floor(size), 1000 + F.floor(size + 0.5))).alias("s")
    known = hot.join(degree, "c").select("h", "c", "first", "degree", classes)
    hubs = written(known.groupBy("h", "s").agg(F.max(F.struct("degree", "c")).alias("x")).select("h", "s", F.col("x.c").alias("hub"), F.col("x.degree").alias("hubs")), "hubs")
    votes = known.select("h", "s", "c", "first").join(hubs, ["h", "s"]).groupBy("c", "hub").agg(F.count(F.lit(1)).alias("v"), F.max("hubs").alias("hubs"), F.max("first").alias("first"))
    best = votes.groupBy("c").agg(F.max(F.struct("v", "hubs", "hub", "first")).alias("x"))
    return written(best.filter("8 * x.v >= x.first and c != x.hub").select("c", F.col("x.hub").alias("ref")), "references")


def _differences(sets: DataFrame, refs: DataFrame, percent: int) -> DataFrame:
    """(c, ref, near, first, n, u, size, keys): each set's difference from its reference, as hashes of (reference, element, lost or new).

    ``u`` is such that two sets of a reference are similar if their differences share o elements and 2 * (100 + percent) * o >= u + u'.
    ``near``: as similar to the reference as asked. ``first`` elements in an order of all must hold one that a similar set has too:
    a near one's partner is taken to be far, as near ones are linked already.
    """
    parts = refs.groupBy("ref").agg(F.count(F.lit(1)).alias("m")).select("ref", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    mine = refs.join(parts, "ref").select("c", "ref", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int").alias("part")).join(sets, "c")
    theirs = parts.join(sets.select(F.col("c").alias("ref"), F.col("s").alias("t")), "ref").select("ref", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "t")

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for c, ref, s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                lost, new = np.setdiff1d(t, s, assume_unique=True), np.setdiff1d(s, t, assume_unique=True)
                edge = (100 - percent) * len(t)
                u = 200 * len(lost) + 2 * percent * len(new) - edge
                n, near = len(lost) + len(new), u <= edge
                need = -(-(u + edge + 1) // (2 * (100 + percent))) if near else -(-(u - edge) // 200)
                base = mix(np.array([ref], np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                keys = np.concatenate((mix(lost ^ base), mix((new ^ base) + np.uint64(0xA24BAED4963EE407)))) >> np.uint64(1)
                for column, v in zip(out, (c, ref, near, max(0, n - max(1, need) + 1), n, u, len(s), keys.view(np.int64))):
                    column.append(v)
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, types)], ["c", "ref", "near", "first", "n", "u", "size", "keys"])

    both = mine.join(theirs, ["ref", "part"]).select("c", "ref", "s", "t")
    return both.mapInArrow(run, "c long, ref long, near boolean, first int, n int, u long, size int, keys array<long>")


def _residual(differences: DataFrame) -> DataFrame:
    """Rows (h, c, n, i, u, first, size) of the first elements of each difference, rare before frequent, that another one has too."""
    every = differences.filter("first > 0").select("c", "n", "u", "first", "size", F.explode("keys").alias("h"))
    often = written(every.groupBy("h").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared-elements")
    order = Window.partitionBy("c").orderBy(F.coalesce("m", F.lit(1)), "h")
    placed = every.join(often, "h", "left").withColumn("i", F.row_number().over(order) - 1)
    return placed.filter("i < first and m is not null").select("h", "c", "n", "i", "u", "first", "size")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` (level, h, c, n, i, u, next, label) with the blocks (p, q) in which they meet, and their own.

    A shingle of up to BLOCK rows is one block. In another, the rows of its commonest reference need not meet one another: their
    blocks meet those of the rest only, and the rest's meet each other.
    """
    counts = rows.groupBy("h", "next").agg(F.count(F.lit(1)).alias("m"))
    lists = counts.groupBy("h").agg(F.sum("m").alias("all"), F.max(F.when(F.col("next") != 0, F.struct("m", "next"))).alias("x")).filter(F.col("all") > BLOCK)
    most = F.coalesce("x.m", F.lit(0))
    lists = written(lists.select("h", F.coalesce("x.next", F.lit(0)).alias("main"), F.ceil(most / BLOCK).cast("int").alias("mb"), F.ceil((F.col("all") - most) / BLOCK).cast("int").alias("rb")), "long-lists")
    is_main = (F.col("next") == F.col("main")) & (F.col("main") != 0)
    turn = F.xxhash64(F.lit(5), "c")
    own = F.when(F.col("mb").isNull(), -1).when(is_main, F.pmod(turn, F.col("mb"))).otherwise(F.col("mb") + F.pmod(turn, F.col("rb"))).cast("int")
    none = F.array().cast("array<struct<p:int,q:int>>")
    pair = lambda a, b: F.struct(F.least(a, b).cast("int").alias("p"), F.greatest(a, b).cast("int").alias("q"))
    of_main = F.when(F.col("mb") > 0, F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda x: pair(x, F.col("own")))).otherwise(none)
    of_rest = F.when(F.col("rb") > 0, F.transform(F.sequence(F.lit(0), F.col("rb") - 1), lambda x: pair(x + F.col("mb"), F.col("own")))).otherwise(none)
    blocks = F.when(F.col("mb").isNull(), F.array(pair(F.lit(-1), F.lit(-1)))).when(is_main, of_rest).otherwise(F.concat(of_main, of_rest))
    met = rows.join(lists, "h", "left").withColumn("own", own).withColumn("block", F.explode(blocks))
    return met.select("h", "block.p", "block.q", "own", "c", "n", "i", "u", "next", "label", "level")


def _product(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, level, u, c, ra, rb): overlaps c of rows in the columns in which they can still reach their bound, summed in a block.

    ``ra``, ``rb``: what each has after its last common column. Rows of one next reference meet in its differences, those of one label
    are linked already; neither is a pair here. A block holds the rows of a shingle, at most twice BLOCK.
    """
    H, P, Q, OWN, C, N, I, U, NEXT, LABEL, LEVEL = range(11)
    names = ["a", "b", "level", "u", "c", "ra", "rb"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def reaching(g: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rows (a, b, level, u, ra, rb) of the pairs of g at x and y that may be similar."""
        good = (g[x, LABEL] != g[y, LABEL]) & ((g[x, NEXT] != g[y, NEXT]) | (g[x, NEXT] == 0)) & ((g[x, P] == g[x, Q]) | (g[x, OWN] != g[y, OWN])) & (g[x, C] != g[y, C])
        x, y = x[good], y[good]
        rx, ry, u = g[x, N] - 1 - g[x, I], g[y, N] - 1 - g[y, I], g[x, U] + g[y, U]
        good = 2 * (100 + percent) * (1 + np.minimum(rx, ry)) >= u
        x, y, rx, ry, u = x[good], y[good], rx[good], ry[good], u[good]
        swap = g[x, C] > g[y, C]
        return np.stack((np.where(swap, g[y, C], g[x, C]), np.where(swap, g[x, C], g[y, C]), g[x, LEVEL], u, np.where(swap, ry, rx), np.where(swap, rx, ry)), 1)

    def summed(parts: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(parts)
        x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
        first = np.flatnonzero(np.concatenate(([True], (x[1:, :3] != x[:-1, :3]).any(1)))) if len(x) else np.zeros(0, np.int64)
        least = [np.minimum.reduceat(x[:, i], first) if len(x) else x[:, i] for i in (4, 5)]
        cols = [x[first, 0], x[first, 1], x[first, 2], x[first, 3], np.diff(np.append(first, len(x))), *least]
        return pa.RecordBatch.from_arrays([pa.array(v.astype(t.to_pandas_dtype())) for v, t in zip(cols, types)], names)

    def pairs(g: np.ndarray):
        """Whole blocks; small ones all at once by the distance of two rows, each of the others row by row."""
        new = np.flatnonzero(np.concatenate(([True], (g[1:, :3] != g[:-1, :3]).any(1))))
        size = np.diff(np.append(new, len(g)))
        number = np.repeat(np.arange(len(new)), size)
        at = np.flatnonzero(size[number] <= 16)
        for d in range(1, 16):
            hit = np.flatnonzero(number[at[d:]] == number[at[:-d]]) if len(at) > d else at[:0]
            if not len(hit):
                break
            yield reaching(g, at[hit], at[hit + d])
        for first, n in zip(new[size > 16].tolist(), size[size > 16].tolist()):
            order = first + np.argsort(g[first : first + n, NEXT], kind="stable")
            follow = g[order, NEXT]
            ends = np.where(follow == 0, np.arange(1, n + 1), np.searchsorted(follow, follow, "right"))
            xs, ys, held = [], [], 0
            for j in range(n - 1):
                if ends[j] < n:
                    xs.append(np.full(n - ends[j], order[j]))
                    ys.append(order[ends[j] :])
                    held += n - ends[j]
                    if held > _PAIRS:
                        yield reaching(g, np.concatenate(xs), np.concatenate(ys))
                        xs, ys, held = [], [], 0
            if held:
                yield reaching(g, np.concatenate(xs), np.concatenate(ys))

    def run(batches):
        held = np.zeros((0, 11), np.int64)
        parts, size = [], 0
        for batch in _ended(batches):
            if batch is None:
                ready, held = held, held[:0]
            else:
                held = np.concatenate((held, np.stack([np.asarray(c, np.int64) for c in batch.columns], 1)))
                same = np.flatnonzero((held[:, :3] != held[-1, :3]).any(1))
                cut = int(same[-1]) + 1 if len(same) else 0
                ready, held = held[:cut], held[cut:]
            for x in pairs(ready) if len(ready) else ():
                parts.append(x)
                size += len(x)
                if size > _PAIRS:
                    yield summed(parts)
                    parts, size = [], 0
        if size:
            yield summed(parts)

    return rows.repartition("h", "p", "q").sortWithinPartitions("h", "p", "q", "c").mapInArrow(run, "a long, b long, level int, u long, c int, ra int, rb int")


def _ended(batches):
    yield from (b for b in batches if b.num_rows)
    yield None


def _sets(docs: DataFrame, texts: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(c, s): the whole sets of ``nodes`` (c), each from one text that has it."""
    one = texts.groupBy("c").agg(F.min(F.struct("did", "th")).alias("x")).join(nodes, "c").select("c", "x.*")

    def sets(batches):
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingles(encoded(batch.column(1)), k)], pa.binary())], ["c", "s"])

    return same_key(docs, one, "inner").select("c", "text").dropDuplicates(["c"]).mapInArrow(sets, "c long, s binary")


def _plausible(texts: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be as similar as asked by their sketches, which are a sixtieth of their sets."""
    nodes = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    one = texts.groupBy("c").agg(F.first(F.struct("n", "sketch")).alias("x"))  # before the join, as many texts may have one set
    found = written(one.join(nodes, "c", "left_semi").select("c", "x.*"), "sketches")
    left = pairs.join(found.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka")), "a")
    both = left.join(found.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb")), "b")

    def run(batches):
        for batch in batches:
            size = np.asarray(batch.column(2), np.int64) + np.asarray(batch.column(3), np.int64)
            least = np.array([least_difference(x.as_py(), y.as_py()) for x, y in zip(batch.column(4), batch.column(5))], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((100 + percent) * least <= (100 - percent) * size))

    return both.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long")


def _similar(docs: DataFrame, texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are as similar as asked, as links (u, v)."""
    nodes = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    found = written(_sets(docs, texts, nodes, k), "sets")
    left = pairs.join(found.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(found.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([a, b], ["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "u long, v long")


def _links(own: DataFrame, texts: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (u, v) that connect whatever chains of similar sets connect, from the first shingles of all sets."""
    tables = [rows.select("h", "c", "n", "i", (2 * percent * F.col("n").cast("long")).alias("u"), (F.col("n") - F.ceil(percent * F.col("n") / 100) + 1).cast("int").alias("first"), F.col("n").alias("size"))]
    follow: list[DataFrame | None] = []
    near = sets = None
    for level in range(LEVELS):
        refs = _references(tables[-1], least=4 * level)
        follow.append(refs)
        if refs is None:
            break
        if sets is None:  # later references are among these sets
            sets = written(_sets(own, texts, refs.select("c").unionByName(refs.select(F.col("ref").alias("c"))).distinct(), k), "sets")
        differ = written(_differences(sets, refs, percent), "differences")
        close = differ.filter("near").select(F.col("c").alias("u"), F.col("ref").alias("v"))
        near = close if near is None else near.unionByName(close)
        tables.append(written(_residual(differ), "residual"))
    label = near.groupBy(F.col("u").alias("c")).agg(F.max("v").alias("near")) if near is not None else None
    every = None
    for level, table in enumerate(tables):
        refs = follow[level] if level < len(follow) else None
        table = table.join(refs, "c", "left").withColumn("next", F.coalesce("ref", F.lit(0))) if refs is not None else table.withColumn("next", F.lit(0).cast("long"))
        table = table.join(label, "c", "left").withColumn("label", F.coalesce("near", "c")) if label is not None else table.withColumn("label", F.col("c"))
        table = table.select("h", "c", "n", "i", "u", "next", "label", F.lit(level).alias("level"))
        every = table if every is None else every.unionByName(table)
    met = _product(_dealt(written(every, "rows")), percent)
    met = met.groupBy("a", "b", "level").agg(F.first("u").alias("u"), F.sum("c").alias("c"), F.min("ra").alias("ra"), F.min("rb").alias("rb"))
    reach = 2 * (100 + percent) * (F.col("c") + F.least("ra", "rb"))
    met = written(met.filter(reach >= F.col("u")).select("a", "b").distinct(), "pairs")
    met = written(_plausible(texts, met, percent), "plausible")
    links = written(_similar(own, texts, met, k, percent), "far-links")
    return links if near is None else links.unionByName(near)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT, mask: int = -1) -> DataFrame:
    """(did, th, n_shingles, component_id, component) of every row of ``docs``; ``component`` names the group of sets, null without words.

    ``component_id`` is the least id that links reach, the row's own included. Texts without words have no shingles and their own id.
    Rows with equal sets are linked; rows without an id link like others but give no component id, so a component of such rows alone
    has a null one. Order and cut-offs inside change the work and never the links. Shingles are 63-bit hashes, sets are told apart by
    128 bits: names of 64 bits (``mask`` cuts them, for tests) are changed where two sets have one, few of any number of texts.
    """
    own = keyed(docs, id_col, text_col)
    with temporary() as keep:
        seen = written(describe(own, k, mask), "shingle-sets")
        texts = seen.filter("kind = 0")
        clash = [r["c"] for r in texts.groupBy("c").agg(F.min("d").alias("x"), F.max("d").alias("y")).filter("x != y").select("c").collect()]
        if clash:
            texts = texts.withColumn("c", F.when(F.col("c").isin(clash), F.col("c").bitwiseXOR(F.col("d"))).otherwise(F.col("c")))
        texts = texts.select("did", "th", "c", "n", "sketch")
        often = seen.filter("kind = 1").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(COMMON)
        rows = written(_shared(postings(own, _sorted(often), k, percent, frozenset(clash), mask)), "shared-shingles")
        joined = written(components(_links(own, texts.filter("n > 0"), rows, k, percent)), "joined")  # a table, so that Spark can split a hot set
        placed = texts.join(joined, F.col("c") == F.col("node"), "left").select("did", "th", "n", F.when(F.col("n") > 0, F.coalesce("component", "c")).alias("component"))
        placed = keep(written(placed, "components"))
        least = keep(written(placed.filter("n > 0").groupBy("component").agg(F.min("did").alias("least")), "least-ids"))
    out = placed.join(least, "component", "left")
    return out.select("did", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("did")).alias("component_id"), "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` of which each group keeps one: that of least id (null last), then of least hash.

    Texts without words are in no group and stay.
    """
    groups = near_groups(docs, id_col, text_col, **how).select("th", F.coalesce("did", F.lit(NO_ID)).alias("dk"), "component", F.struct(F.col("did").isNull().alias("x"), "did", "th").alias("order"))
    groups = written(groups.distinct(), "groups")
    first = groups.filter("component is not null").groupBy("component").agg(F.min("order").alias("order"))
    keep = first.select(F.col("order.th").alias("th"), F.coalesce("order.did", F.lit(NO_ID)).alias("dk"), F.lit(1).alias("most"))
    keep = keep.unionByName(groups.filter("component is null").select("th", "dk", F.lit((1 << 31) - 1).alias("most")))
    own = numbered(docs, id_col, text_col).join(keep, ["th", "dk"])
    return repeated(own, F.least("n", F.col("most") - F.col("before")))
