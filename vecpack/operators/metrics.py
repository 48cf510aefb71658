"""How good codes are: distortion, inner-product errors, recall and sizes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecpack.functions import kernels
from vecpack.functions.expressions import dot, let
from vecpack.model import VectorModel
from vecpack.operators.arrow import matrix
from vecpack.operators.codec import reconstruct


def squared_error(a: Column, b: Column) -> Column:
    return let(F.zip_with(a, b, lambda x, y: x - y), lambda d: dot(d, d)) / F.size(a)


def cosine(a: Column, b: Column) -> Column:
    """Full cosine; 0 where either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def reconstruction(df: DataFrame, models: list[VectorModel], vector: str = "embedding") -> DataFrame:
    """(label, bytes_per_vector, n, mse, cosine): mean error a dimension and mean cosine for each model."""
    def one(m: VectorModel) -> DataFrame:
        both = reconstruct(df.select(vector), m, vector)
        original = F.col(vector).cast("array<double>")
        return both.agg(F.count("*").alias("n"), F.avg(squared_error(original, F.col("decoded"))).alias("mse"), F.avg(cosine(original, F.col("decoded"))).alias("cosine")).select(F.lit(m.label).alias("label"), F.lit(m.bytes_per_vector).alias("bytes_per_vector"), "n", "mse", "cosine")

    return reduce(DataFrame.unionAll, map(one, models))


def inner_products(df: DataFrame, queries: np.ndarray, ids: list[int], model: VectorModel, vector: str = "embedding") -> DataFrame:
    """(query_id, vec_id, exact, plain, corrected): inner products with each of the stated queries.

    ``plain`` leaves the residual's signs out, ``corrected`` has them.
    """
    rotated, projected = kernels.prepare(queries, model)
    query_ids = np.array(ids, np.int64)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index(vector)), model.dim)
            vec = batch.column(batch.schema.get_field_index("vec_id")).to_numpy(zero_copy_only=False)
            e = kernels.encode(x, model)
            three = [x @ queries.T, kernels.score(e, rotated, projected, model, False), kernels.score(e, rotated, projected, model, True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(query_ids, len(vec))), pa.array(np.repeat(vec, len(query_ids))), *(pa.array(s.ravel()) for s in three)], names=["query_id", "vec_id", "exact", "plain", "corrected"])

    return df.select("vec_id", vector).mapInArrow(run, "query_id long, vec_id long, exact double, plain double, corrected double")


def estimate_errors(products: DataFrame, estimate: str) -> DataFrame:
    """One row: n, bias, mae, var, std_err, relative_bias (in percent of the mean size of the truth) and slope.

    The slope is that of the estimate on the truth through the origin: 1 for an unbiased estimator, below 1
    for one that shrinks, which the mean error of random pairs can't show.
    """
    e, t = F.col(estimate), F.col("exact")
    error = e - t
    sums = products.agg(F.count("*").alias("n"), F.avg(error).alias("bias"), F.avg(F.abs(error)).alias("mae"), F.var_samp(error).alias("var"), F.avg(F.abs(t)).alias("size"), (F.sum(e * t) / F.sum(t * t)).alias("slope"))
    return sums.select("n", "bias", "mae", "var", F.sqrt(F.col("var") / F.col("n")).alias("std_err"), (F.abs("bias") / F.col("size") * 100).alias("relative_bias"), "slope")


_SUMS = ["n", "error", "size_of_error", "squared_error", "size", "product", "square"]


def inner_product_errors(df: DataFrame, queries: DataFrame, model: VectorModel, vector: str = "embedding") -> DataFrame:
    """(estimate, n, bias, mae, var, std_err, relative_bias, slope) over all pairs of rows and stated queries.

    The two estimates, ``plain`` and ``corrected``, are as in :func:`inner_products`, the measures as in
    :func:`estimate_errors`. A batch gives one row of sums for each estimate and pass of queries: pairs don't
    leave the worker, and what is added up doesn't grow with their number.
    """
    from vecpack.operators.search import QUERIES_PER_PASS, query_vectors

    q = np.array([v for _, v in query_vectors(queries, vector)], np.float64).reshape(-1, model.dim)

    def sums(part: np.ndarray):
        rotated, projected = kernels.prepare(part, model)

        def run(batches):
            for batch in batches:
                x = matrix(batch.column(batch.schema.get_field_index(vector)), model.dim)
                e, t = kernels.encode(x, model), x @ part.T
                rows = []
                for signs in (False, True):
                    estimate = kernels.score(e, rotated, projected, model, signs)
                    d = estimate - t
                    rows.append([float(d.size), d.sum(), np.abs(d).sum(), (d * d).sum(), np.abs(t).sum(), (estimate * t).sum(), (t * t).sum()])
                yield pa.RecordBatch.from_arrays([pa.array(["plain", "corrected"]), *(pa.array(list(map(float, c))) for c in zip(*rows, strict=True))], names=["estimate", *_SUMS])

        return df.select(vector).mapInArrow(run, ", ".join(["estimate string", *(f"{c} double" for c in _SUMS)]))

    passes = [sums(q[i : i + QUERIES_PER_PASS]) for i in range(0, len(q), QUERIES_PER_PASS)]
    if not passes:
        return df.sparkSession.createDataFrame([], "estimate string, n long, bias double, mae double, var double, std_err double, relative_bias double, slope double")
    total = reduce(DataFrame.unionAll, passes).groupBy("estimate").agg(*[F.sum(c).alias(c) for c in _SUMS])
    n, bias = F.col("n"), F.col("error") / F.col("n")
    var = F.when(n > 1, (F.col("squared_error") - F.col("error") * bias) / (n - 1))
    return total.select("estimate", n.cast("long").alias("n"), bias.alias("bias"), (F.col("size_of_error") / n).alias("mae"), var.alias("var"), F.sqrt(var / n).alias("std_err"), (F.abs(bias) / F.try_divide("size", n) * 100).alias("relative_bias"), F.try_divide("product", "square").alias("slope"))


def recall(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """One row, recall: the mean share of each query's exact top k that the other search found too."""
    found = exact.select("query_id", "vec_id").join(approximate.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return found.groupBy("query_id").agg((F.count("hit") / k).alias("recall")).agg(F.avg("recall").alias("recall"))


def overlap(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """(query_id, overlap): how many ids two top-k lists share."""
    lists = [d.groupBy("query_id").agg(F.collect_set("vec_id").alias(n)) for d, n in ((exact, "a"), (approximate, "b"))]
    return lists[0].join(lists[1], "query_id").select("query_id", F.size(F.array_intersect("a", "b")).alias("overlap"))


def coordinate_statistics(rotated: DataFrame, column: str = "rotated") -> DataFrame:
    """One row over all coordinates of all rows: n, mean, variance and standard deviation."""
    return rotated.select(F.explode(column).alias("x")).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("variance"), F.stddev_pop("x").alias("std"))


def sizes(spark: SparkSession, models: list[VectorModel]) -> DataFrame:
    """(label, dim, bytes_per_vector, bits_per_dim, ratio) of each model."""
    rows = [(m.label, m.dim, m.bytes_per_vector, m.bits_per_dim, m.compression_ratio) for m in models]
    return spark.createDataFrame(rows, "label string, dim int, bytes_per_vector int, bits_per_dim double, ratio double")


def configs(spark: SparkSession, models: list[VectorModel]) -> DataFrame:
    """(label, variant, bits, angle_bits, radius_bits, bytes_per_vector): what tells the models apart."""
    rows = [(m.label, m.variant, m.bits, m.angle_bits, m.radius_bits, m.bytes_per_vector) for m in models]
    return spark.createDataFrame(rows, "label string, variant string, bits int, angle_bits int, radius_bits int, bytes_per_vector int")


def head_to_head(df: DataFrame, models: list[VectorModel], vector: str = "embedding") -> DataFrame:
    """(label, bytes_per_vector, bits_per_dim, ratio, n, mse, cosine): one table of all models, of either variant."""
    made = sizes(df.sparkSession, models).drop("dim", "bytes_per_vector")
    return reconstruction(df, models, vector).join(F.broadcast(made), "label").select("label", "bytes_per_vector", "bits_per_dim", "ratio", "n", "mse", "cosine")


def record_file_bytes(model: VectorModel, vectors: int) -> int:
    """A record file's size: 16 bytes of header, 5 of parameters, then the records."""
    return 21 + vectors * model.bytes_per_vector


def kv_cache_bytes(model: VectorModel, tokens: int, layers: int = 1, raw_bytes: int = 4) -> tuple[int, int]:
    """(raw, compressed) bytes of the key and value vectors of so many tokens and layers."""
    return 2 * raw_bytes * model.dim * tokens * layers, 2 * model.bytes_per_vector * tokens * layers
