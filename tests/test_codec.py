import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from vecpack.functions import expressions as X
from vecpack.functions import kernels
from vecpack.model import VectorModel
from vecpack.operators import codec, search


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 8), st.integers(1, 70), st.integers(0, 2**32 - 1))
def test_packing_round_trip(bits, values, seed):
    codes = np.random.default_rng(seed).integers(0, 1 << bits, (3, values))
    packed = kernels.pack_bits(codes, bits)
    assert packed.shape == (3, -(-values * bits // 8))
    assert (kernels.unpack_bits(packed, bits, values) == codes).all()


def test_packing_is_lowest_bit_first():
    assert kernels.pack_bits(np.array([[3, 12, 7, 15, 0]]), 4).tobytes().hex() == "c3f700"
    assert kernels.pack_bits(np.array([[1, 2, 3]]), 3).tobytes().hex() == "d100"


def rows(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


@pytest.mark.parametrize("model", [VectorModel.lloyd_max(16, 3), VectorModel.lloyd_max(7, 8), VectorModel.polar(16), VectorModel.polar(7, 3, 5)], ids=lambda m: f"{m.label} {m.dim}")
def test_encode_and_decode_frames(spark, model):
    x = np.random.default_rng(5).standard_normal((50, model.dim))
    x[3] = 0
    encoded = codec.encode(rows(spark, x), model)
    sizes = encoded.select(sum((F.length(c) for c, t in encoded.dtypes if t == "binary"), F.lit(8)).alias("n")).distinct().collect()
    assert [r["n"] for r in sizes] == [model.bytes_per_vector]
    back = np.array([r["embedding"] for r in codec.decode(encoded, model).orderBy("vec_id").collect()])
    assert np.allclose(back, kernels.decode(kernels.encode(x, model), model), atol=1e-5)
    assert (back[3] == 0).all()


@pytest.mark.parametrize("bits", [1, 3, 4, 8])
def test_expressions_and_batches_agree(spark, bits):
    m = VectorModel.lloyd_max(12, bits)
    df = rows(spark, np.random.default_rng(6).standard_normal((20, 12)))
    fast = codec.inspect(df, m).orderBy("vec_id").collect()
    slow = X.encode_columns(df, m).orderBy("vec_id").collect()
    assert [(r["code"], r["sign"]) for r in fast] == [(r["code"], r["sign"]) for r in slow]
    assert np.allclose([r["residual_norm"] for r in fast], [r["residual_norm"] for r in slow])
    packed = codec.encode(df, m).select("vec_id", F.hex("codes").alias("h")).orderBy("vec_id").collect()
    assert [r["h"] for r in packed] == [r["h"] for r in X.encode_columns(df, m).select("vec_id", X.packed_hex("code", bits, 12).alias("h")).orderBy("vec_id").collect()]


@pytest.mark.parametrize("bad", [None, [1.0], [1.0, None], [1.0, float("nan")], [1.0, float("inf")]])
def test_bad_vectors_raise(spark, bad):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, bad)], "vec_id long, embedding array<double>")
    with pytest.raises(PythonException):
        codec.encode(df, VectorModel.lloyd_max(2, 4)).collect()


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a", [0.6, 0.8])], "vec_id long, note string, embedding array<float>")
    assert codec.encode(df, VectorModel.lloyd_max(2, 4)).columns == ["vec_id", "note", "codes", "signs", "residual_norm", "original_norm"]
    assert codec.encode(df.limit(0), VectorModel.lloyd_max(2, 4)).count() == 0


def test_hash_vectors(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "t string").select(X.hash_vector(F.col("t"), 16).alias("v"))
    a, again, b = (np.array(r["v"]) for r in df.collect())
    assert (a == again).all() and abs(np.linalg.norm(a) - 1) < 1e-12 and a @ b < 0.9
    assert spark.range(1).select(X.one_hot(F.lit(2), 4).alias("v")).first()["v"] == [0, 0, 1, 0]


def test_code_similarity_gives_all_pairs_in_small_batches(spark):
    """However many rows a batch of the right side has: what leaves the worker at once is bounded."""
    model, x = VectorModel.polar(16), np.random.default_rng(7).standard_normal((5000, 16))

    class Right:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    left = codec.encode(rows(spark, x[:300]), model)
    e = kernels.encode(x, model)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(5000)), *codec.to_arrow(e, model)], names=["vec_id", *(f.name for f in codec.code_fields(model))])
    made = list(search.code_similarity(left, Right(), model).run([batch]))
    assert max(b.num_rows for b in made) <= 250_000
    near = e.approximation(model)
    got = pa.Table.from_batches(made)
    a, b = got["left_id"].to_numpy(), got["right_id"].to_numpy()
    assert len(set(zip(a.tolist(), b.tolist(), strict=True))) == got.num_rows == 300 * 5000
    assert np.allclose(got["similarity"].to_numpy(), (near[:300] @ near.T)[a, b])
    assert search.code_similarity(left.where("false"), Right(), model).count() == 0
