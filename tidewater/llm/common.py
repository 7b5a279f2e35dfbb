"""Helpers that the corpus operators share: the shared folder, written tables, byte-level word scanning, distributed ranks."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word, everywhere in this subpackage: a run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``; where it is unset, a new one on a local master, else an error."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(path)
        path = context.getCheckpointDir()
    return path.rstrip("/")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for ``temporary`` to remove."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if stack := getattr(_scratch, "stack", None):
        stack[-1].append((spark, path))
    return path


def until_exit(spark: SparkSession, path: str) -> None:
    """What lies at the path goes when the session's file systems close, if it is still there."""
    fs, place = _files(spark, path)
    fs.deleteOnExit(place)


_scratch = threading.local()
_cleaning, _writers = threading.Lock(), 0
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def temporary():
    """Tables that ``written`` makes inside are removed at the end, but for those given to the function that this yields."""
    if not hasattr(_scratch, "stack"):
        _scratch.stack = []
    own: list = []
    _scratch.stack.append(own)
    kept: set[str] = set()

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.written_to)
        return table

    try:
        yield keep
    finally:
        _scratch.stack.pop()
        for spark, path in own:
            if path not in kept:
                fs, place = _files(spark, path)
                fs.delete(place, True)
            elif _scratch.stack:
                _scratch.stack[-1].append((spark, path))


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession):
    """Shuffle files go when the query that made them ends; the session's own setting returns after the last writer."""
    global _writers
    with _cleaning:
        if not _writers:
            _shuffles_freed.before = spark.conf.get(_CLEANUP, "false")
        _writers += 1
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning:
            _writers -= 1
            if not _writers:
                spark.conf.set(_CLEANUP, _shuffles_freed.before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, is computed once and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(table: DataFrame) -> None:
    """Removes the files of a table from ``written`` that no later step reads."""
    fs, place = _files(table.sparkSession, table.written_to)
    fs.delete(place, True)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, th, text): the id, a hash of id and text, and the text with null as empty.

    Rows that repeat an id with other text get another ``th``; rows that repeat both have equal keys and equal results.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("did"), F.xxhash64(F.lit(7), F.col(id_col), text).alias("th"), text.alias("text"))


#: Stands for a null id in keys; ``th`` tells such rows from others.
NO_ID = -(1 << 63)


def same_key(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on (did, th); a null id equals a null id."""
    dk = F.coalesce("did", F.lit(NO_ID)).alias("dk")
    return left.select("*", dk).join(right.select(dk, *[c for c in right.columns if c != "did"]), ["th", "dk"], how).drop("dk")


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, th, dk, before, n): whole rows with their keys; a row stands for ``n`` equal ones, the numbers before + 1 to before + n of those that repeat id and text.

    Equal rows of a batch become one before they are shuffled, so a row that repeats without end does not meet itself in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    flat = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.lit(7), F.col(id_col), text).alias("th"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("dk"), F.xxhash64(F.lit(11), *flat).alias("rh"))

    def combine(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                keys = np.stack([batch.column(i).to_numpy() for i in (1, 2, 3)], axis=1)
                _, first, n = np.unique(keys, axis=0, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(first)).columns, pa.array(n, pa.int64())], ["row", "th", "dk", "rh", "n"])

    kind = own.schema["row"].dataType.simpleString()
    if "map<" not in kind:  # rows with maps could differ in them alone
        own = own.mapInArrow(combine, own.withColumn("n", F.lit(1).cast("long")).schema)
    else:
        own = own.withColumn("n", F.lit(1).cast("long"))
    over = Window.partitionBy("th", "dk").orderBy("rh").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0))).select("row", "th", "dk", "before", "n")


def repeated(rows: DataFrame, times) -> DataFrame:
    """The ``row`` of each row as often as ``times`` says."""
    return rows.select("row", times.cast("int").alias("__t")).filter("__t > 0").select("row", F.explode(F.expr("sequence(1, __t)")).alias("__i")).select("row.*")


def ranked(df: DataFrame, groups: list[str], order: list, part: str, rank: str = "rank") -> DataFrame:
    """1-based ``rank`` of each row in ``groups``, ordered by the integer column ``part`` and then ``order``.

    No group is sorted whole in one task: rows are numbered within (group, part), and each part is shifted by the counts of the
    parts before it, so ``part`` should split a hot group into many pieces and ascend with the wanted order.
    """
    keys = [*groups, part]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    shift = shift.select(*[F.col(k).alias(f"__{k}") for k in keys], "__shift")
    numbered = df.withColumn("__row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    out = numbered.join(shift, on, "left")
    return out.withColumn(rank, (F.col("__shift") + F.col("__row")).cast("long")).drop("__row", "__shift", *[f"__{k}" for k in keys])


# ---------------------------------------------------------------- words of a batch of texts, as arrays

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_R = np.uint64(0x2545F4914F6CDD1D)
_RINV = np.uint64(pow(0x2545F4914F6CDD1D, -1, 1 << 64))
_S32 = np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S32)
    x *= _M2
    x ^= x >> _S32
    x *= _M2
    x ^= x >> _S32
    return x


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _M1)


def _steps(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(1, n), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Power:
    """Powers of a base: a small table of the low part, another of the high part, grown as texts ask for it."""

    def __init__(self, base: np.uint64):
        self.low, self.base = _steps(base, 1024), np.uint64(pow(int(base), 1024, 1 << 64))
        self.high = _steps(self.base, 2048)

    def _grow(self, n: int) -> None:
        if n > len(self.high) << 10:
            self.high = _steps(self.base, (n >> 10) + 2)

    def first(self, n: int) -> np.ndarray:
        self._grow(n)
        return np.multiply.outer(self.high[: (n + 1023) >> 10], self.low).ravel()[:n]

    def at(self, i: np.ndarray) -> np.ndarray:
        self._grow(int(i.max()) + 1 if len(i) else 0)
        return self.high[i >> 10] * self.low[i & 1023]


POWER, INVERSE = _Power(_R), _Power(_RINV)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words in UTF-8 bytes; the 64-bit hash depends on the word's bytes alone."""
    b = np.frombuffer(raw, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = _SPACE[b]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = np.concatenate((np.zeros(0 if space[0] else 1, np.int64), edge, np.zeros(0, np.int64) if space[-1] else np.array([len(b)])))
    starts, ends = edge[0::2], edge[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * POWER.first(len(b)), out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * INVERSE.at(starts) + (ends - starts).astype(np.uint64))


def blocks_of(texts: list[bytes], most: int = 1 << 20):
    """Runs (first, last, bytes, starts) of texts joined by newlines, of about ``most`` bytes or one text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, i, *_joined(texts[first:i])
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts), *_joined(texts[first:])


def _joined(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    return b"\n".join(texts) + b"\n", np.concatenate(([0], np.cumsum(lengths)))


def ngram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * _R + h[i : i + n]
    return mix(out)


def encoded(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def trimmed() -> None:
    """Gives freed memory back, as workers outlive their tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches, most: int = 1 << 22, column: str = "text"):
    """Record batches cut so that each has about ``most`` bytes of text or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        total, first = np.cumsum(sizes), 0
        while first < batch.num_rows:
            base = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(first, last - first)
            first = last
    trimmed()
