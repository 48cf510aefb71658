"""The codec as SQL functions: vq_encode, vq_decode, vq_score and the table function vq_search."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vecpack.functions import kernels
from vecpack.model import VectorModel
from vecpack.operators.codec import code_fields, from_arrow, to_arrow
from vecpack.operators.search import best_rows

def _struct(model: VectorModel) -> str:
    return f"struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in code_fields(model))}>"


def _batch(codes: pd.DataFrame) -> pa.RecordBatch:
    return pa.RecordBatch.from_pandas(codes, preserve_index=False)


def register(spark: SparkSession, model: VectorModel) -> None:
    """Register the functions for one model, of either variant.

    ``vq_encode(vector)`` gives a struct of codes, ``vq_decode(codes)`` a vector, ``vq_score(codes, query)``
    the estimated inner product; ``vq_search(TABLE(...), query, k)`` gives (vec_id, seq, score) of the k best
    rows of each partition of a table of vec_id, seq and codes: rank those again for the best of all.
    """
    names = [f.name for f in code_fields(model)]

    @F.pandas_udf(_struct(model))
    def vq_encode(vectors: pd.Series) -> pd.DataFrame:
        e = kernels.encode(np.array(vectors.tolist(), np.float64).reshape(-1, model.dim), model)
        return pd.DataFrame({n: a.to_pylist() if pa.types.is_binary(a.type) else a.to_numpy() for n, a in zip(names, to_arrow(e, model), strict=True)})

    @F.pandas_udf("array<float>")
    def vq_decode(codes: pd.DataFrame) -> pd.Series:
        return pd.Series(list(kernels.decode(from_arrow(_batch(codes), model), model).astype(np.float32)))

    @F.pandas_udf("double")
    def vq_score(codes: pd.DataFrame, queries: pd.Series) -> pd.Series:
        q = np.array(queries.tolist(), np.float64).reshape(-1, model.dim)
        e = from_arrow(_batch(codes), model)
        rotated, projected = kernels.prepare(q, model)
        scale = np.where(e.residual_norm > 1e-10, e.residual_norm * np.sqrt(np.pi / (2 * model.dim)), 0.0)
        return pd.Series(e.original_norm * (np.einsum("ij,ij->i", e.approximation(model), rotated) + scale * np.einsum("ij,ij->i", 2.0 * e.signs - 1, projected)))

    @F.arrow_udtf(returnType="vec_id bigint, seq bigint, score double")
    class VqSearch:
        """Batches of rows, of which k are kept at a time."""

        def __init__(self):
            self.k, self.best = 0, []

        def eval(self, rows: pa.RecordBatch, query: pa.Array, k: pa.Array):
            if not rows.num_rows:
                return
            self.k = k[0].as_py()
            rotated, projected = kernels.prepare(np.array([query[0].as_py()], np.float64), model)
            seq, vec = (rows.column(n).to_numpy(zero_copy_only=False) for n in ("seq", "vec_id"))
            scores = kernels.score(from_arrow(rows, model), rotated, projected, model)[:, 0]
            top = best_rows(scores, seq, self.k)
            self.best = sorted([*self.best, *zip((-scores[top]).tolist(), seq[top].tolist(), vec[top].tolist(), strict=True)])[: self.k]

        def terminate(self):
            score, seq, vec = zip(*self.best, strict=True) if self.best else ([], [], [])
            yield pa.table({"vec_id": pa.array(vec, pa.int64()), "seq": pa.array(seq, pa.int64()), "score": pa.array([-s for s in score], pa.float64())})

    for name, f in (("vq_encode", vq_encode), ("vq_decode", vq_decode), ("vq_score", vq_score)):
        spark.udf.register(name, f)
    spark.udtf.register("vq_search", VqSearch)
