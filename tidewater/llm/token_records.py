"""Token ids in files of length-delimited records, with an offset index for shuffled reads.

A record is the length of its data (8 bytes, little-endian), the masked CRC-32C of those 8 bytes, the data, and the masked CRC-32C of
the data: the framing that TFRecord readers know. The data are ids as little-endian unsigned integers of ``width`` bytes. Beside each
data file ``part-N.records`` lies ``part-N.index``: for each record its id, first byte in the data file and number of ids, each as
8 bytes, so that any record can be read alone and in any order.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import new_path, pieces, until_exit
from tidewater.llm.tokenizing import encoder

_POLY = 0x82F63B78
_BLOCK = 2048


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """CRC-32C of each byte at each distance from the end of a block, and the shift of a register by one block."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(_POLY), one >> 1).astype(np.uint32)
    at = np.empty((_BLOCK, 256), np.uint32)
    at[_BLOCK - 1] = one
    for i in range(_BLOCK - 2, -1, -1):  # one more zero byte after it
        at[i] = one[at[i + 1] & 0xFF] ^ (at[i + 1] >> 8)
    return at.ravel(), one


_AT, _ONE = _tables()
_ROW = np.arange(_BLOCK, dtype=np.int64) * 256


def crc32c(data: bytes) -> int:
    """CRC-32C; blocks are looked up by position at once, as the code is linear."""
    register = 0xFFFFFFFF
    raw = np.frombuffer(data, np.uint8)
    for first in range(0, len(raw), _BLOCK):
        block = raw[first : first + _BLOCK]
        n = len(block)
        if n >= 4:
            block = block.copy()
            block[:4] ^= np.frombuffer(register.to_bytes(4, "little"), np.uint8)
            register = int(np.bitwise_xor.reduce(_AT[_ROW[_BLOCK - n :] + block]))
        else:
            for b in block.tolist():
                register = int(_ONE[(register ^ b) & 0xFF]) ^ (register >> 8)
    return register ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = len(data).to_bytes(8, "little")
    return b"".join((length, masked(crc32c(length)).to_bytes(4, "little"), data, masked(crc32c(data)).to_bytes(4, "little")))


def unframe(raw: bytes, at: int = 0) -> tuple[bytes, int]:
    """The data of the record at a byte, and where the next one begins; a wrong checksum or a short file is an error."""
    if len(raw) < at + 12:
        raise ValueError("record cut off")
    length = raw[at : at + 8]
    if masked(crc32c(length)) != int.from_bytes(raw[at + 8 : at + 12], "little"):
        raise ValueError("wrong checksum of a length")
    end = at + 12 + int.from_bytes(length, "little")
    data = raw[at + 12 : end]
    if len(raw) < end + 4 or masked(crc32c(data)) != int.from_bytes(raw[end : end + 4], "little"):
        raise ValueError("wrong checksum of data")
    return data, end + 4


def _open(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    """Spark's file:/x as file:///x."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text", kind: str = "spaced") -> DataFrame:
    """Writes the ids of all rows, with ``end_id`` after each, in ascending id order; returns the files.

    (part, file, n_records, first_token): one row for each file, at most one for each shuffle partition. Ranges of ids are
    dealt to tasks and sorted there; a task streams its rows to files of its own attempt, so a lost or repeated attempt leaves only
    files that no row names. A null text is empty and has the end id alone; rows with a null id come first; rows that repeat an id
    lie side by side, shorter texts first.
    """
    path = _uri(path)

    def run(batches):
        fs, folder = _open(path)
        fs.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}"
        enc = encoder(tokenizer, kind)
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        n, tokens, at = 0, 0, 0
        data = index = None
        for batch in pieces(batches):
            if data is None:
                data, index = fs.open_output_stream(f"{folder}/{name}.records"), fs.open_output_stream(f"{folder}/{name}.index")
            ids = batch.column(0).to_pylist()
            for did, raw in zip(ids, enc.encode([t or "" for t in batch.column(1).to_pylist()])):
                framed = frame(raw + end)
                count = len(raw) // width + 1
                # a null id is written as the lowest number
                index.write(np.array([-(1 << 63) if did is None else did, at, count], "<i8").tobytes())
                data.write(framed)
                n, tokens, at = n + 1, tokens + count, at + len(framed)
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_records": [n], "n_tokens": [tokens], "width": [width]}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_records", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    rows = docs.select(F.col(id_col).cast("long").alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange(F.col("did").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("did").asc_nulls_first(), F.length("text"), "text")
    made = sorted(dealt.mapInArrow(run, "part int, file string, n_records long, n_tokens long, width int").collect(), key=lambda r: r["part"])
    rows_, first = [], 0
    for r in made:
        rows_.append((r["part"], r["file"], r["n_records"], r["width"], first))
        first += r["n_tokens"]
    return docs.sparkSession.createDataFrame(rows_, "part int, file string, n_records long, width int, first_token long")


def read_tokens(files: DataFrame, path: str, read_bytes: int = 1 << 25) -> DataFrame:
    """(did, start, n_tokens, ids_crc32, ids) of every record; one task takes whole files and reads them in bounded pieces.

    ``start`` counts all ids before the record; ``ids_crc32`` is of the ids as little-endian unsigned 32-bit integers; checksums and
    the index are checked. ``ids`` is the data as written.
    """
    path = _uri(path)

    def run(batches):
        fs, folder = _open(path)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{folder}/{r['file']}.index") as f:
                    index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                if len(index) != r["n_records"]:
                    raise ValueError(f"{r['file']}: index has {len(index)} records of {r['n_records']}")
                dtype, start, i = f"<u{r['width']}", r["first_token"], 0
                with fs.open_input_file(f"{folder}/{r['file']}.records") as f:
                    while i < len(index):
                        j = max(i + 1, int(np.searchsorted(index[:, 1], index[i, 1] + read_bytes)))
                        f.seek(int(index[i, 1]))
                        raw = f.read(int(index[j, 1] - index[i, 1]) if j < len(index) else None)
                        out, at = {"did": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}, 0
                        for did, _, count in index[i:j].tolist():
                            data, at = unframe(raw, at)
                            ids = np.frombuffer(data, dtype)
                            if len(ids) != count:
                                raise ValueError(f"{r['file']}: a record has {len(ids)} ids of {count}")
                            out["did"].append(None if did == -(1 << 63) else did)
                            out["start"].append(start)
                            out["n_tokens"].append(count)
                            out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                            out["ids"].append(data)
                            start += count
                        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("did", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())]))
                        i = j

    # one file to a task: a file is what one task wrote
    n = max(1, files.count())
    return files.repartitionByRange(n, "part").mapInArrow(run, "did long, start long, n_tokens long, ids_crc32 long, ids binary")


def read_records(path: str, file: str, order: list[int]) -> list[bytes]:
    """The data of single records of one file in any order, each by one seek through the index."""
    fs, folder = _open(_uri(path))
    with fs.open_input_file(f"{folder}/{file}.index") as f:
        index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
    out = []
    with fs.open_input_file(f"{folder}/{file}.records") as f:
        for i in order:
            f.seek(int(index[i, 1]))
            head = f.read(12)
            out.append(unframe(head + f.read(int.from_bytes(head[:8], "little") + 4))[0])
    return out


def encode_all(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, **how) -> DataFrame:
    """Writes ``docs`` to ``path`` and reads them back; without one, to a new folder under the shared one, which goes with the session."""
    spark: SparkSession = docs.sparkSession
    own = path or new_path(spark, "tokens")
    files = write_tokens(docs, tokenizer, end_id, own, **how)
    if path is None:
        until_exit(spark, own)
    return read_tokens(files, own)
