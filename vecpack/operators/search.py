"""Top-k inner-product search over codes or raw vectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecpack.errors import DimensionMismatch
from vecpack.functions import kernels
from vecpack.model import VectorModel
from vecpack.operators.arrow import matrix
from vecpack.operators.codec import code_fields, from_arrow

#: Queries that one pass takes to the executors (at 64 dimensions 1 kB each); more go in further passes.
QUERIES_PER_PASS = 2000
#: Scores of one batch against all queries that are held at a time.
SCORES_AT_A_TIME = 4_000_000
#: Pairs of codes that leave a worker in one batch (24 bytes each), and left rows that are decoded at a time.
PAIRS_AT_A_TIME, LEFT_AT_A_TIME = 250_000, 1000

HITS = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("score", T.DoubleType())])


def best_rows(scores: np.ndarray, seq: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best scores, ties by smaller seq; NaN scores are never among them."""
    good = np.flatnonzero(~np.isnan(scores))
    if len(good) > k:
        least = np.partition(scores[good], len(good) - k)[len(good) - k]
        good = good[scores[good] >= least]
    return good[np.lexsort((seq[good], -scores[good]))][:k]


def _hits(rows: DataFrame, queries: list[tuple[int, object]], k: int, score_batch) -> DataFrame:
    """The k best of each batch for each query: what the window above ranks is small however many rows there are."""
    ids = np.array([q for q, _ in queries], np.int64)

    def run(batches):
        for batch in batches:
            vec = batch.column(batch.schema.get_field_index("vec_id")).to_numpy(zero_copy_only=False)
            seq = batch.column(batch.schema.get_field_index("seq")).to_numpy(zero_copy_only=False)
            for scores, first in score_batch(batch):
                picked = [best_rows(scores[:, j], seq, k) for j in range(scores.shape[1])]
                at = np.concatenate(picked) if picked else np.zeros(0, np.int64)
                query = np.repeat(np.arange(len(picked)), [len(p) for p in picked])
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + query]), pa.array(vec[at]), pa.array(seq[at]), pa.array(scores[at, query])], names=HITS.names)

    return rows.mapInArrow(run, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "seq")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query_vectors(queries: DataFrame, vector: str) -> list[tuple[int, list[float]]]:
    """Queries are a stated set: they go to the driver once, to be prepared there, and on in passes."""
    return [(r[0], r[1]) for r in queries.select("query_id", F.col(vector).cast("array<double>")).orderBy("query_id").collect()]


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def _passes(encoded: DataFrame, queries: list, k: int, make) -> DataFrame:
    if not queries or k < 1:
        return _empty(encoded)
    parts = [queries[i : i + QUERIES_PER_PASS] for i in range(0, len(queries), QUERIES_PER_PASS)]
    return reduce(DataFrame.unionAll, [_ranked(_hits(encoded, part, k, make(np.array([v for _, v in part], np.float64))), k) for part in parts])


def topk_join(encoded: DataFrame, queries: DataFrame, model: VectorModel, k: int, use_qjl: bool = True, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``encoded`` (vec_id, seq, codes...) for each query.

    Equal scores rank by seq. k below 1 gives no rows, k above the number of rows all of them. Queries of
    another length raise. Each batch is scored by one matrix product and gives k rows a query.
    """
    vectors = query_vectors(queries, vector)
    for _, v in vectors:
        if v is None or len(v) != model.dim:
            raise DimensionMismatch(model.dim, 0 if v is None else len(v))

    def make(q):
        rotated, projected = kernels.prepare(q, model)
        step = max(1, SCORES_AT_A_TIME // 10_000)

        def score_batch(batch):
            e = from_arrow(batch, model)
            for i in range(0, len(q), step):
                yield kernels.score(e, rotated[i : i + step], projected[i : i + step], model, use_qjl), i

        return score_batch

    return _passes(encoded.select("vec_id", "seq", *[f.name for f in code_fields(model)]), vectors, k, make)


def topk(encoded: DataFrame, query: list[float], model: VectorModel, k: int, use_qjl: bool = True) -> DataFrame:
    """(vec_id, score) of the k best, best first; no rows for a query of another length."""
    spark = encoded.sparkSession
    if len(query) != model.dim or k < 1:
        return spark.createDataFrame([], "vec_id long, score double")
    rotated, projected = kernels.prepare(np.array([query], np.float64), model)

    def score_batch(batch):
        yield kernels.score(from_arrow(batch, model), rotated, projected, model, use_qjl), 0

    hits = _hits(encoded.select("vec_id", "seq", *[f.name for f in code_fields(model)]), [(0, query)], k, score_batch)
    return hits.orderBy(F.desc("score"), "seq").limit(k).select("vec_id", "score")


def exact_topk(rows: DataFrame, queries: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """As :func:`topk_join`, by exact inner products of raw vectors; ties by vec_id."""
    vectors = query_vectors(queries, vector)
    dim = len(vectors[0][1]) if vectors else 0

    def make(q):
        step = max(1, SCORES_AT_A_TIME // 10_000)

        def score_batch(batch):
            x = matrix(batch.column(batch.schema.get_field_index(vector)), dim)
            for i in range(0, len(q), step):
                yield x @ q[i : i + step].T, i

        return score_batch

    return _passes(rows.select("vec_id", F.col("vec_id").alias("seq"), vector), vectors, k, make)


def score_pairs(encoded: DataFrame, query: list[float], model: VectorModel, use_qjl: bool = True) -> DataFrame:
    """``encoded`` with the ``score`` of each row against one query."""
    if len(query) != model.dim:
        raise DimensionMismatch(model.dim, len(query))
    rotated, projected = kernels.prepare(np.array([query], np.float64), model)
    schema = T.StructType([*encoded.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            s = kernels.score(from_arrow(batch, model), rotated, projected, model, use_qjl)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, "score"])

    return encoded.mapInArrow(run, schema)


def code_similarity(left: DataFrame, right: DataFrame, model: VectorModel) -> DataFrame:
    """(left_id, right_id, similarity) of polar codes with polar codes, norms and residuals left out.

    ``left`` is a stated set of rows and goes to the executors as packed codes; ``right`` is streamed past it.
    All pairs come back, a bounded number at a time however many rows either side or a batch has.
    """
    names = [f.name for f in code_fields(model)]
    table = left.select("vec_id", *names).toArrow().combine_chunks()
    schema = "left_id long, right_id long, similarity double"
    if not table.num_rows:
        return left.sparkSession.createDataFrame([], schema)
    packed = table.to_batches()[0]

    def run(batches):
        for batch in batches:
            b = from_arrow(batch, model).approximation(model)
            right_ids = batch.column(batch.schema.get_field_index("vec_id")).to_numpy(zero_copy_only=False)
            for i in range(0, packed.num_rows, LEFT_AT_A_TIME):
                some = packed.slice(i, LEFT_AT_A_TIME)
                a, ids = from_arrow(some, model).approximation(model), some.column(0).to_numpy(zero_copy_only=False)
                step = max(1, PAIRS_AT_A_TIME // len(ids))
                for j in range(0, len(b), step):
                    s, vec = a @ b[j : j + step].T, right_ids[j : j + step]  # of rotated directions
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, len(vec))), pa.array(np.tile(vec, len(ids))), pa.array(s.ravel())], names=["left_id", "right_id", "similarity"])

    return right.select("vec_id", *names).mapInArrow(run, schema)
