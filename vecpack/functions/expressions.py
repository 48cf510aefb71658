"""The codec as column expressions, with the model's matrices as columns of a broadcast row.

They stay in the JVM and show the semantics one expression at a time; batches of vectors go faster through
the Arrow operators, which give the same codes and signs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecpack.model import TINY, VectorModel


def let(value: Column | str, body) -> Column:
    """``body`` of a value that is computed once: what a lambda merely closes over is computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, summed from the left in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Direction of ``v``; zeros where the norm counts as zero."""
    return let(v, lambda w: let(l2_norm(w), lambda norm: F.transform(w, lambda x: F.when(norm > TINY, x / norm).otherwise(0.0))))


def times(matrix: Column | str, v: Column | str) -> Column:
    """Matrix (array of rows) times vector."""
    return let(v, lambda w: F.transform(matrix, lambda row: dot(row, w)))


def transposed_times(matrix: Column | str, v: Column | str, dim: int) -> Column:
    """Transposed matrix times vector, without storing the transpose."""
    return let(v, lambda w: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: dot(F.transform(matrix, lambda row: F.get(row, i)), w)))


def lm_codes(rotated: Column | str, boundaries: Column | str) -> Column:
    return F.transform(rotated, lambda x: F.size(F.filter(boundaries, lambda b: x > b)))


def lookup(codes: Column | str, centroids: Column | str) -> Column:
    return F.transform(codes, lambda i: F.get(centroids, i))


def polar_codes(rotated: Column, model: VectorModel) -> Column:
    """Array of (angle, radius) structs of neighbouring pairs."""
    steps, top = 1 << model.angle_bits, (1 << model.radius_bits) - 1

    def pair(i: Column) -> Column:
        a, b = F.get(rotated, i * 2), F.coalesce(F.get(rotated, i * 2 + 1), F.lit(0.0))
        angle = F.round((F.atan2(b, a) + F.pi()) / (2 * F.pi()) * steps).cast("int") % steps
        radius = F.round(F.least(F.hypot(a, b), F.lit(model.max_radius)) / model.max_radius * top).cast("int")
        return F.struct(angle.alias("angle"), radius.alias("radius"))

    return F.transform(F.sequence(F.lit(0), F.lit(model.pairs - 1)), pair)


def naive_round_trip(v: Column, bits: int, reach: float) -> Column:
    """Uniform quantization over [-reach, reach], back to the cells' middles."""
    levels = float(1 << bits)

    def one(x: Column) -> Column:
        cell = F.least(F.greatest(F.floor((x + reach) / (2 * reach) * levels).cast("double"), F.lit(0.0)), F.lit(levels - 1))
        return (cell + 0.5) / levels * (2 * reach) - reach

    return F.transform(v, one)


def packed_hex(codes: Column | str, bits: int, values: int) -> Column:
    """Upper-case hexadecimal text of the packed codes, lowest bit first."""
    size = -(-values * bits // 8)

    def byte(codes: Column):
        def at(k: Column) -> Column:
            total = F.lit(0)
            for j in range(8):
                place = k * 8 + j
                value = F.coalesce(F.get(codes, F.floor(place / bits).cast("int")), F.lit(0))
                total = total + F.call_function("shiftright", value, (place % bits).cast("int")).bitwiseAND(1) * (1 << j)
            return F.lpad(F.hex(total), 2, "0")

        return at

    return let(codes, lambda codes: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), byte(codes)), ""))


def _uniform(seed: Column, i: Column, salt: str = "") -> Column:
    """A number in (0, 1) of 48 bits of the MD5 of seed, salt and place."""
    digits = F.substring(F.md5(F.concat_ws(":", seed, F.concat(F.lit(salt), i.cast("string")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**48)


def seeded_vector(seed: Column, dim: int) -> Column:
    """A unit vector from a seed (a number or a text): the same seed, the same vector, in whatever task or run."""
    return normalize(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: _uniform(seed.cast("string"), i) * 2 - 1))


def gaussian_vector(seed: Column, dim: int) -> Column:
    """As :func:`seeded_vector`, evenly on the sphere: normalised independent normal numbers (by Box and Muller)."""
    def normal(i: Column) -> Column:
        return F.sqrt(F.log(_uniform(seed.cast("string"), i, "r")) * -2) * F.cos(_uniform(seed.cast("string"), i, "a") * (2 * math.pi))

    return normalize(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), normal))


def hash_vector(text: Column, dim: int) -> Column:
    """A unit vector from a text's MD5: the same text, the same vector; alike texts don't get near ones."""
    return seeded_vector(F.md5(text), dim)


def one_hot(at: Column, dim: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i == at, 1.0).otherwise(0.0))


def with_model(df: DataFrame, model: VectorModel) -> DataFrame:
    """``df`` beside the model's one row, which is broadcast: literals of that size would bloat the plan."""
    row = model.to_df(df.sparkSession).select(*(F.col(c).alias(f"model_{c}") for c in ("rotation", "projection", "centroids", "boundaries")))
    return df.crossJoin(F.broadcast(row))


def encode_columns(df: DataFrame, model: VectorModel, vector: str = "embedding") -> DataFrame:
    """``df`` with rotated, code, sign, residual_norm and original_norm by column expressions (scalar codebook)."""
    x = F.col(vector).cast("array<double>")
    steps = with_model(df, model).withColumn("original_norm", l2_norm(x)).withColumn("rotated", times("model_rotation", normalize(x)))
    coded = steps.withColumn("code", lm_codes("rotated", "model_boundaries"))
    rest = coded.withColumn("rest", F.zip_with("rotated", lookup("code", "model_centroids"), lambda a, b: a - b))
    signed = rest.withColumn("residual_norm", l2_norm(F.col("rest"))).withColumn("sign", F.transform(times("model_projection", "rest"), lambda p: F.when(p > 0, 1).otherwise(0)))
    return signed.select(*df.columns, "rotated", "code", "sign", "residual_norm", "original_norm")
