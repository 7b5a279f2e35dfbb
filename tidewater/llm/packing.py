"""Best-fit packing planned over the histogram of lengths.

Texts become pieces of at most ``capacity`` tokens. Only the number of pieces of each length is gathered; best-fit decreasing over
those counts gives kinds of sequences, each with a list of lengths and how often it is made. A piece then takes the slot that its rank
among the pieces of its length has in the plan.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import pieces, ranked, written
from tidewater.llm.tokenizing import encoder

CAPACITY = 4096


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", kind: str = "words", keep_ids: bool = False) -> DataFrame:
    """(did, th, piece, start, length, ids_crc32 [, ids]): pieces of all texts, each with ``end_id`` after its tokens."""
    names = ["did", "th", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids

    def run(batches):
        enc = encoder(tokenizer, kind)
        for batch in pieces(batches):
            out: list[list] = [[] for _ in names]
            for did, th, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), enc.encode([t or "" for t in batch.column(2).to_pylist()])):
                ids = np.append(np.frombuffer(raw, enc.dtype), end_id).astype("<u4")
                for k, first in enumerate(range(0, len(ids), capacity)):
                    data = ids[first : first + capacity]
                    for column, v in zip(out, (did, th, k, first, len(data), zlib.crc32(data.tobytes()), data.tobytes())):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    rows = docs.select(F.col(id_col).cast("long").alias("did"), F.xxhash64(F.lit(7), F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).alias("th"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "did long, th long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: [(lengths of one sequence, how many such sequences)].

    The longest length left goes to the open sequences with least room that still holds it, many at a time; open sequences are kept
    as (room -> kinds with their numbers).
    """
    done: list[tuple[tuple[int, ...], int]] = []
    rooms: list[int] = []  # ascending
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(lengths: tuple[int, ...], n: int, room: int) -> None:
        if room < smallest:
            done.append((lengths, n))
            return
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((lengths, n))

    order = sorted((length for length, n in counts.items() if n), reverse=True)
    smallest = order[-1] if order else 0
    for length in order:
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                each = min(capacity // length, left)
                n = left // each
                put((length,) * each, n, capacity - each * length)
                left -= n * each
                continue
            room = rooms[i]
            lengths, n = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[i]
            each = min(room // length, max(1, left // n))
            used = min(n, left // each)
            if used < n:
                put(lengths, n - used, room)
            put(lengths + (length,) * each, used, room - each * length)
            left -= used * each
    return done + [x for kinds in open_.values() for x in kinds]


def slots(kinds: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, places of that length in a sequence, offset of the first of them), by rank."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for lengths, n in kinds:
        at, i = 0, 0
        while i < len(lengths):
            j = i
            while j < len(lengths) and lengths[j] == lengths[i]:
                j += 1
            first = taken.get(lengths[i], 0)
            out.setdefault(lengths[i], []).append((first, sequence, j - i, at))
            taken[lengths[i]] = first + n * (j - i)
            at += (j - i) * lengths[i]
            i = j
        sequence += n
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (did, th, piece, length, ...) with sequence_id and offset; repeated rows get slots of their own.

    The driver holds counts by length and the plan, of at most ``capacity`` lengths; an empty table gives an empty result.
    """
    counts = {int(r["length"]): int(r["n"]) for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = slots(plan(counts, capacity))
    own = parts.withColumn("__part", F.shiftright(F.xxhash64("did", "th", "piece"), 54).cast("int"))
    placed = ranked(own, ["length"], ["did", "th", "piece"], "__part", "__rank").drop("__part")
    schema = placed.drop("__rank").schema.add("sequence_id", "long").add("offset", "long")
    at, by = placed.columns.index("__rank"), placed.columns.index("length")

    def run(batches):
        for batch in batches:
            rank, length = np.asarray(batch.column(at), np.int64) - 1, np.asarray(batch.column(by), np.int64)
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for group in np.split(order, cuts) if len(order) else []:
                size = int(length[group[0]])
                rows = where[size]
                row = rows[np.searchsorted(rows[:, 0], rank[group], "right") - 1]
                k = rank[group] - row[:, 0]
                sequence[group] = row[:, 1] + k // row[:, 2]
                offset[group] = row[:, 3] + k % row[:, 2] * size
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return placed.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, **how) -> DataFrame:
    """Every piece of every row of ``docs`` with its sequence and place. Null and empty texts are the end id alone."""
    return pack(written(tokenized(docs, tokenizer, end_id, capacity, **how), "pieces"), capacity)
