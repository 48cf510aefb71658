"""Record files of compressed vectors: fixed-width rows after a header, as a Spark data source.

A file is: magic ``TQLM``, version, number of records and record width (unsigned 32-bit, little-endian),
then the dimension (unsigned 32-bit) and the bits (one byte); each record is the original and the residual
norm (32-bit floats), the packed codes and the packed signs. Ids aren't stored: a record's place is its id.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vecpack.errors import StorageError
from vecpack.model import VectorModel, packed_bytes

# Fixed values of the format.
MAGIC, VERSION = b"TQLM", 1
_HEADER = struct.Struct("<4sIII")
_PARAMETERS = struct.Struct("<IB")
DATA_OFFSET = _HEADER.size + _PARAMETERS.size
SCHEMA = "seq long, codes binary, signs binary, residual_norm float, original_norm float"
RECORDS_PER_PARTITION = 100_000


def record_bytes(dim: int, bits: int) -> int:
    return 8 + packed_bytes(dim, bits) + packed_bytes(dim, 1)


def header(count: int, dim: int, bits: int) -> bytes:
    return _HEADER.pack(MAGIC, VERSION, count, record_bytes(dim, bits)) + _PARAMETERS.pack(dim, bits)


def parse_header(raw: bytes) -> tuple[int, int, int]:
    """(records, dim, bits); raises StorageError for what isn't such a file."""
    if len(raw) < DATA_OFFSET or raw[:4] != MAGIC:
        raise StorageError("no record file: wrong magic bytes")
    _, version, count, width = _HEADER.unpack_from(raw)
    dim, bits = _PARAMETERS.unpack_from(raw, _HEADER.size)
    if version != VERSION:
        raise StorageError(f"record file of version {version}")
    if width != record_bytes(dim, bits):
        raise StorageError(f"records of {width} bytes; {dim} dimensions at {bits} bits take {record_bytes(dim, bits)}")
    return count, dim, bits


def serialize(original_norm: float, residual_norm: float, codes: bytes, signs: bytes) -> bytes:
    return struct.pack("<ff", original_norm, residual_norm) + codes + signs


def deserialize(record: bytes, dim: int, bits: int) -> tuple[float, float, bytes, bytes]:
    """(original norm, residual norm, codes, signs)."""
    if len(record) != record_bytes(dim, bits):
        raise StorageError(f"a record of {len(record)} bytes")
    cut = 8 + packed_bytes(dim, bits)
    return *struct.unpack_from("<ff", record), record[8:cut], record[cut:]


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (any that Arrow knows), and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path)


def read_header(path: str) -> tuple[int, int, int]:
    """(records, dim, bits) of a file."""
    store, name = _place(path)
    with store.open_input_file(name) as f:
        return parse_header(f.read(DATA_OFFSET))


def read_record(path: str, place: int) -> tuple[float, float, bytes, bytes]:
    """(original norm, residual norm, codes, signs) of the record at a place; reads that record alone."""
    store, name = _place(path)
    with store.open_input_file(name) as f:
        count, dim, bits = parse_header(f.read(DATA_OFFSET))
        if not 0 <= place < count:
            raise IndexError(f"place {place} of {count} records")
        width = record_bytes(dim, bits)
        return deserialize(f.read_at(width, DATA_OFFSET + place * width), dim, bits)


def _blobs(encoded: DataFrame, model: VectorModel) -> DataFrame:
    """(n, records): rows (seq, codes...) by seq, each batch's records as one value, made on the executors."""
    width, codes = model.bytes_per_vector, model.code_bytes

    def run(batches):
        from vecpack.operators.arrow import bytes_matrix

        for batch in batches:
            if batch.num_rows:
                table = np.empty((batch.num_rows, width), np.uint8)
                for k in (0, 1):
                    table[:, 4 * k : 4 * k + 4] = batch.column(k).to_numpy().astype("<f4").view(np.uint8).reshape(-1, 4)
                table[:, 8 : 8 + codes] = bytes_matrix(batch.column(2), codes)
                table[:, 8 + codes :] = bytes_matrix(batch.column(3), model.sign_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([table.tobytes()], pa.binary())], names=["n", "records"])

    return encoded.orderBy("seq").select("original_norm", "residual_norm", "codes", "signs").mapInArrow(run, "n long, records binary")


def _write(encoded: DataFrame, path: str, model: VectorModel, old: int | None) -> int:
    """A new file beside ``path``, of ``old`` records of the one there and then the rows; it takes that one's place."""
    count = encoded.count()
    if (old or 0) + count >= 1 << 32:
        raise StorageError(f"{(old or 0) + count} records; a file has at most 2^32 - 1")
    store, name = _place(path)
    written = 0
    with store.open_output_stream(f"{name}.new") as out:
        out.write(header((old or 0) + count, model.dim, model.bits))
        if old:
            with store.open_input_stream(name) as f:
                f.read(DATA_OFFSET)
                left = old * model.bytes_per_vector
                while left:
                    raw = f.read(min(left, 16 << 20))
                    if not raw:
                        raise StorageError(f"{path} ends within its records")
                    out.write(raw)
                    left -= len(raw)
        for r in _blobs(encoded, model).toLocalIterator():
            out.write(bytes(r["records"]))
            written += r["n"]
    if written != count:
        raise StorageError(f"{written} records, {count} were counted")
    store.move(f"{name}.new", name)
    return count


def write_records(encoded: DataFrame, path: str, model: VectorModel) -> int:
    """Export rows (vec_id, seq, codes...) by seq to one record file; how many there were.

    The format is one file: executors make the records, which stream through the driver a partition at a time.
    """
    return _write(encoded, path, model, None)


def append_records(encoded: DataFrame, path: str, model: VectorModel) -> int:
    """Add rows by seq behind those of a record file; how many there were. A reader sees the old file or the new one."""
    count, dim, bits = read_header(path)
    if (dim, bits) != (model.dim, model.bits):
        raise StorageError(f"a file of {dim} dimensions at {bits} bits, a model of {model.dim} at {model.bits}")
    return _write(encoded, path, model, count)


class _Range(InputPartition):
    def __init__(self, first: int, count: int):
        self.first, self.count = first, count


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.count, self.dim, self.bits = read_header(path)

    def partitions(self):
        step = RECORDS_PER_PARTITION
        return [_Range(i, min(step, self.count - i)) for i in range(0, self.count, step)] or [_Range(0, 0)]

    def read(self, partition):
        width, codes = record_bytes(self.dim, self.bits), packed_bytes(self.dim, self.bits)
        store, name = _place(self.path)
        with store.open_input_file(name) as f:
            raw = f.read_at(partition.count * width, DATA_OFFSET + partition.first * width)
        if len(raw) != partition.count * width:
            raise StorageError(f"{self.path} ends within a record")
        from vecpack.operators.arrow import binary

        table = np.frombuffer(raw, np.uint8).reshape(partition.count, width)
        norms = np.ascontiguousarray(table[:, :8]).view("<f4")
        columns = [pa.array(np.arange(partition.first, partition.first + partition.count)), binary(table[:, 8 : 8 + codes]), binary(table[:, 8 + codes :]), pa.array(norms[:, 1]), pa.array(norms[:, 0])]
        yield pa.RecordBatch.from_arrays(columns, names=["seq", "codes", "signs", "residual_norm", "original_norm"])


class RecordSource(DataSource):
    """``spark.read.format("tqlm").load(path)``; the file must be readable by that path on every executor."""

    @classmethod
    def name(cls) -> str:
        return "tqlm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

