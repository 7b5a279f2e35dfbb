"""Draws of a cluster bootstrap by hash: the head of md5("<seed>|<replicate>|<slot>") modulo the number of patients."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_K = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_TURN = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Numbers hashed at once.
CHUNK = 1 << 14


def digit_words(low: int, high: int, skip: int) -> dict[int, np.ndarray]:
    """What the digits of low..high-1, all of one length, add to the words of a message that has them after ``skip`` bytes."""
    numbers, length, out = np.arange(low, high, dtype=np.uint32), len(str(low)), {}
    for j in range(length):
        byte = (numbers // np.uint32(10 ** (length - 1 - j)) % np.uint32(10) + np.uint32(48)) << np.uint32(8 * ((skip + j) % 4))
        word = (skip + j) // 4
        out[word] = out[word] | byte if word in out else byte
    return out


def md5_heads(prefix: bytes, digits: dict[int, np.ndarray], length: int) -> np.ndarray:
    """The first eight hex digits of md5(prefix + digits), as numbers; a message has 55 bytes at most."""
    total = len(prefix) + length
    if total > 55:
        raise ValueError("messages are of one block")
    block = bytearray(64)
    block[: len(prefix)], block[total], block[56:60] = prefix, 0x80, (8 * total).to_bytes(4, "little")
    words: list = [int(x) for x in np.frombuffer(bytes(block), "<u4")]
    for i, x in digits.items():
        words[i] = x | np.uint32(words[i])
    n = len(next(iter(digits.values())))
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
        word = words[_WORD[i]]
        if isinstance(word, int):
            np.add(f, np.uint32((word + _K[i]) & 0xFFFFFFFF), f)
        else:
            np.add(f, np.uint32(_K[i]), f), np.add(f, word, f)
        np.add(f, a, f)
        np.left_shift(f, np.uint32(_TURN[i]), t), np.right_shift(f, np.uint32(32 - _TURN[i]), f), np.bitwise_or(f, t, f)
        np.add(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    return (a + np.uint32(_START[0])).byteswap()


def _ranges(n: int):
    """0..n-1 in runs of numbers of one length, CHUNK at most."""
    low = 0
    while low < n:
        high = min(n, low + CHUNK, 10 ** len(str(low)))
        yield low, high
        low = high


@dataclass
class Weights:
    """How often each replicate draws each patient: ``drawn`` (block, rep, w) has the counts of a block of slots in one replicate, two bytes each."""

    patients: DataFrame
    drawn: DataFrame
    replicates: int
    size: int

    def placed(self, df: DataFrame) -> DataFrame:
        """``df`` (patient_id, columns) with the block of its patient and the place there."""
        slots = self.patients.select("patient_id", F.floor(F.col("slot") / self.size).cast("long").alias("block"), (F.col("slot") % self.size).cast("int").alias("at"))
        return df.join(slots, "patient_id")


def block_counts(drawn: pa.Table, replicates: int) -> np.ndarray:
    """(place in the block, replicate): the counts of one block of ``Weights``."""
    order = np.argsort(drawn.column("rep").to_numpy())
    raw = drawn.column("w").to_pylist()
    return np.ascontiguousarray(np.frombuffer(b"".join(raw[i] for i in order), "<u2").reshape(replicates, -1).T)


def weights(patients: DataFrame, replicates: int, seed: int, most: int = 1 << 14) -> Weights:
    """As many draws with replacement as there are patients (patient_id, slot 0..n-1), in blocks of ``most`` slots at most.

    A task draws some replicates, one after another: it holds a few numbers for each patient, never a row for a draw.
    """
    context = patients.sparkSession.sparkContext
    n = patients.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    size = max(1, min(most, max(256, -(-n // (2 * context.defaultParallelism)))))

    def draw(batches):
        cached: dict = {}
        for batch in batches:
            for rep in batch.column("rep").to_pylist():
                prefix = f"{seed}|{rep}|".encode()
                if len(prefix) not in cached:
                    cached = {len(prefix): [(low, high, digit_words(low, high, len(prefix))) for low, high in _ranges(n)]}
                heads = np.empty(n, np.uint32)
                for low, high, digits in cached[len(prefix)]:
                    heads[low:high] = md5_heads(prefix, digits, len(str(low)))
                heads %= np.uint32(n)
                w = np.bincount(heads, minlength=-(-n // size) * size)
                if w.max() > 0xFFFF:
                    raise ValueError("a replicate draws a patient more than 65,535 times")
                raw = w.astype("<u2").reshape(-1, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(raw), dtype=np.int64)), pa.array(np.full(len(raw), rep, np.int32)), pa.array([x.tobytes() for x in raw], pa.binary())], ["block", "rep", "w"])

    if not n:
        return Weights(patients, patients.sparkSession.createDataFrame([], "block long, rep int, w binary"), replicates, size)
    reps = patients.sparkSession.range(1, replicates + 1, 1, min(replicates, max(128, 2 * context.defaultParallelism))).select(F.col("id").cast("int").alias("rep"))
    return Weights(patients, reps.mapInArrow(draw, "block long, rep int, w binary"), replicates, size)
