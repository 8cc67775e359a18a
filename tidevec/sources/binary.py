"""Binary files of records and of bare vectors, as Spark data sources.

``vecbin``: records one after another (id 64 bits, timestamp 64 bits, dimension and type
code 32 bits each, elements), little-endian, with an optional count of 32 bits in front.
``fvecs``: vectors of 32-bit floats, each with its dimension in front; id and timestamp
are the position in the file.

Options: path (a file, a folder or a pattern), header (vecbin: 'count' or 'none';
a guess could misread a file), order ('asc' or 'desc': last-in-first-out within a file).
Files are read by Spark's own readers, so any store it knows will do; a file is one
partition. Results are records with vectors of double.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidevec.schema import CODES, ELEMENTS, record_schema

_HEAD = struct.Struct("<Qqii")
_NUMPY = {"int8": "i1", "int16": "<i2", "int32": "<i4", "int64": "<i8", "float32": "<f4", "float64": "<f8"}
_NUMBER = {name: code for code, name in CODES.items()}
_SCHEMA = "uid bigint, ts bigint, vec array<double>"


def encode(records: list[tuple[int, int, list]], element: str = "float32", header: str = "none") -> bytes:
    """Records as bytes."""
    kind = np.dtype(_NUMPY[element])
    body = b"".join(_HEAD.pack(uid & (2**64 - 1), ts, len(vec), _NUMBER[element]) + np.asarray(vec, kind).tobytes() for uid, ts, vec in records)
    return (struct.pack("<i", len(records)) if header == "count" else b"") + body


def decode(raw: bytes, header: str = "none") -> list[tuple[int, int, np.ndarray]]:
    """Records of bytes; what is cut off at the end, as by a writer at work, is left out."""
    at, out = 0, []
    most = None
    if header == "count":
        if len(raw) < 4:
            return []
        (most,), at = struct.unpack_from("<i", raw), 4
    elif header != "none":
        raise ValueError(f"header is 'count' or 'none', not {header!r}")
    while at + _HEAD.size <= len(raw) and (most is None or len(out) < most):
        uid, ts, dim, code = _HEAD.unpack_from(raw, at)
        if code not in CODES or dim < 0:
            raise ValueError(f"no record at byte {at}: dimension {dim}, type {code}")
        kind = np.dtype(_NUMPY[CODES[code]])
        end = at + _HEAD.size + dim * kind.itemsize
        if end > len(raw):
            break
        signed = uid - 2**64 if uid >= 2**63 else uid
        out.append((signed, ts, np.frombuffer(raw, kind, dim, at + _HEAD.size)))
        at = end
    return out


def encode_fvecs(vectors: list[list[float]]) -> bytes:
    return b"".join(struct.pack("<i", len(v)) + np.asarray(v, "<f4").tobytes() for v in vectors)


def decode_fvecs(raw: bytes) -> list[tuple[int, int, np.ndarray]]:
    at, out = 0, []
    while at + 4 <= len(raw):
        (dim,) = struct.unpack_from("<i", raw, at)
        end = at + 4 + 4 * dim
        if dim < 0:
            raise ValueError(f"no vector at byte {at}: dimension {dim}")
        if end > len(raw):
            break
        out.append((len(out), len(out), np.frombuffer(raw, "<f4", dim, at + 4)))
        at = end
    return out


def _table(rows: list[tuple[int, int, np.ndarray]], order: str) -> pa.RecordBatch:
    if order == "desc":
        rows = rows[::-1]
    elif order != "asc":
        raise ValueError(f"order is 'asc' or 'desc', not {order!r}")
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].astype(float) for r in rows], pa.list_(pa.float64()))], ["uid", "ts", "vec"]
    )


def _read(files: DataFrame, kind: str, header: str, order: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                rows = decode(raw, header) if kind == "vecbin" else decode_fvecs(raw)
                for i in range(0, len(rows), 8192) if order == "asc" else range((len(rows) - 1) // 8192 * 8192, -1, -8192) if rows else ():
                    yield _table(rows[i : i + 8192], order)

    return files.select("content").mapInArrow(run, _SCHEMA)


def read_vecbin(spark: SparkSession, path: str, header: str = "none", order: str = "asc") -> DataFrame:
    """Records of a file, a folder or a pattern; a path without files gives no rows."""
    return _missing_is_empty(spark, path, "vecbin", header, order)


def read_fvecs(spark: SparkSession, path: str, order: str = "asc") -> DataFrame:
    return _missing_is_empty(spark, path, "fvecs", "none", order)


def _missing_is_empty(spark: SparkSession, path: str, kind: str, header: str, order: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)
    return _read(files, kind, header, order)


def stream_vecbin(spark: SparkSession, folder: str, header: str = "none", max_files: int = 1000) -> DataFrame:
    """A stream of the records in files that arrive in a folder; max_files a batch holds back a fast producer."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", max_files).load(folder)
    return _read(files, "vecbin", header, "asc")


def write_vecbin(df: DataFrame, folder: str, element: str = "float32", header: str = "none") -> int:
    """Write records as files into a folder that the executors share, one for each partition; the number of rows.

    A file is written under another name first, so a task that is run again replaces its own file.
    """
    if element not in ELEMENTS:
        raise ValueError(f"unknown element type {element!r}")
    import os

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = [(r["uid"], r["ts"], r["vec"]) for b in batches for r in b.to_pylist()]
        task = TaskContext.get()
        name = os.path.join(folder, f"part-{task.partitionId():05d}.bin")
        own = f"{name}.{task.taskAttemptId()}.tmp"
        with open(own, "wb") as f:
            f.write(encode(rows, element, header))
        os.replace(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])

    os.makedirs(folder, exist_ok=True)
    return sum(r["n"] for r in df.select("uid", "ts", "vec").mapInArrow(run, "n bigint").collect())


__all__ = ["decode", "decode_fvecs", "encode", "encode_fvecs", "read_fvecs", "read_vecbin", "record_schema", "stream_vecbin", "write_vecbin"]
