"""Vectors to compact codes and back, as DataFrame transforms over Arrow batches."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecpack.functions import kernels
from vecpack.model import LLOYD_MAX, VectorModel
from vecpack.operators.arrow import binary, bytes_matrix, matrix, vectors

_NORMS = [T.StructField("residual_norm", T.FloatType()), T.StructField("original_norm", T.FloatType())]


def code_fields(model: VectorModel) -> list[T.StructField]:
    names = ["codes", "signs"] if model.variant == LLOYD_MAX else ["angles", "radii", "signs"]
    return [T.StructField(n, T.BinaryType()) for n in names] + _NORMS


def to_arrow(e: kernels.Encoded, model: VectorModel) -> list[pa.Array]:
    signs, norms = binary(kernels.pack_bits(e.signs, 1)), [pa.array(e.residual_norm.astype(np.float32)), pa.array(e.original_norm.astype(np.float32))]
    if model.variant == LLOYD_MAX:
        return [binary(kernels.pack_bits(e.codes, model.bits)), signs, *norms]
    angles = kernels.pack_bits(e.angles, 4) if model.angle_bits == 4 else e.angles
    return [binary(angles), binary(e.radii), signs, *norms]


def from_arrow(batch: pa.RecordBatch, model: VectorModel) -> kernels.Encoded:
    def get(name: str) -> pa.Array:
        return batch.column(batch.schema.get_field_index(name))

    signs = kernels.unpack_bits(bytes_matrix(get("signs"), model.sign_bytes), 1, model.dim)
    norms = [get(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in ("residual_norm", "original_norm")]
    if model.variant == LLOYD_MAX:
        return kernels.Encoded(kernels.unpack_bits(bytes_matrix(get("codes"), model.code_bytes), model.bits, model.dim), None, None, signs, *norms)
    angles = bytes_matrix(get("angles"), model.code_bytes - model.pairs)
    angles = kernels.unpack_bits(angles, 4, model.pairs) if model.angle_bits == 4 else angles.astype(np.int64)
    return kernels.Encoded(None, angles, bytes_matrix(get("radii"), model.pairs).astype(np.int64), signs, *norms)


def _map(df: DataFrame, drop: list[str], fields: list[T.StructField], compute) -> DataFrame:
    """``df`` without ``drop``, with ``fields`` computed from whole batches."""
    kept = [f for f in df.schema.fields if f.name not in {*drop, *(x.name for x in fields)}]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            made = compute(batch)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + made, names=names + [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(kept + fields))


def encode(df: DataFrame, model: VectorModel, vector: str = "embedding") -> DataFrame:
    """``df`` with the vector replaced by its packed codes, residual signs and two norms.

    No shuffle; a batch costs two matrix products. Vectors of another length, null vectors and null or
    non-finite components raise.
    """
    return _map(df, [vector], code_fields(model), lambda b: to_arrow(kernels.encode(matrix(b.column(b.schema.get_field_index(vector)), model.dim), model), model))


def decode(df: DataFrame, model: VectorModel, vector: str = "embedding") -> DataFrame:
    """Encoded rows with the vector that their codes stand for instead of the codes."""
    field = T.StructField(vector, T.ArrayType(T.FloatType()))
    return _map(df, [f.name for f in code_fields(model)], [field], lambda b: [vectors(kernels.decode(from_arrow(b, model), model), pa.float32())])


def reconstruct(df: DataFrame, model: VectorModel, vector: str = "embedding", into: str = "decoded") -> DataFrame:
    """``df`` with what encoding and decoding makes of each vector, in double precision and with exact norms."""
    field = T.StructField(into, T.ArrayType(T.DoubleType()))

    def compute(b):
        return [vectors(kernels.decode(kernels.encode(matrix(b.column(b.schema.get_field_index(vector)), model.dim), model), model), pa.float64())]

    return _map(df, [], [field], compute)


def inspect(df: DataFrame, model: VectorModel, vector: str = "embedding") -> DataFrame:
    """``df`` with the codec's inner values as arrays: rotated, code(s), signs (0 or 1) and both norms in double."""
    lists = ["rotated", *(["code"] if model.variant == LLOYD_MAX else ["angle", "radius"]), "sign"]
    fields = [T.StructField(n, T.ArrayType(T.DoubleType() if n == "rotated" else T.IntegerType())) for n in lists] + [T.StructField(n, T.DoubleType()) for n in ("residual_norm", "original_norm")]

    def compute(b):
        x = matrix(b.column(b.schema.get_field_index(vector)), model.dim)
        e = kernels.encode(x, model)
        codes = [e.codes] if model.variant == LLOYD_MAX else [e.angles, e.radii]
        return [vectors(kernels.unit(x)[0] @ model.rotation.T, pa.float64()), *(vectors(c, pa.int32()) for c in chain(codes, [e.signs])), pa.array(e.residual_norm), pa.array(e.original_norm)]

    return _map(df, [vector], fields, compute)
