"""Every operator as a query over whole tables, with the SQL that gives the same rows.

Doubles are rounded to four places on both sides. Queries that search take as queries every row whose id
is divisible by 20; single searches take the row 0.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecpack.functions import expressions as X
from vecpack.functions.sql import register
from vecpack.model import VectorModel, codebook
from vecpack.operators import codec, metrics, search
from vecpack.operators.embed import embed
from vecpack.plans import oracle as O
from vecpack.sources.index import VectorIndex

DIM = 64
LM_BITS = [1, 2, 3, 4, 6, 8]
POLAR_BITS = [(2, 2), (2, 4), (3, 4), (3, 6), (4, 6), (4, 8)]
#: The grid of the polar sweep: angle bits by radius bits.
SWEEP = [(a, r) for a in (2, 3, 4) for r in (4, 6, 8)]
EVERY = "vec_id % 20 = 0"


@lru_cache(32)
def lm(bits: int = 4) -> VectorModel:
    return VectorModel.lloyd_max(DIM, bits)


@lru_cache(32)
def polar(angle: int = 4, radius: int = 8) -> VectorModel:
    return VectorModel.polar(DIM, angle, radius)


def embeddings(spark: SparkSession, sf_dir: str, scaled: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    if scaled:  # the rows have unit norms: else the norms' part would go untested
        df = df.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * (1 + F.col("vec_id") % 5)))
    return df


def row_zero(spark: SparkSession, sf_dir: str, scaled: bool = False) -> list[float]:
    return embeddings(spark, sf_dir, scaled).where("vec_id = 0").first()["embedding"]


def query_rows(df: DataFrame) -> DataFrame:
    return df.where(EVERY).select(F.col("vec_id").alias("query_id"), "embedding")


def encoded(spark: SparkSession, sf_dir: str, model: VectorModel, scaled: bool = False, where: str = "true") -> DataFrame:
    """Codes without an index: a row's place is its id. Filters and unread columns end at the scan, below the codec."""
    rows = embeddings(spark, sf_dir, scaled).where(where).select("vec_id", "embedding")
    return codec.encode(rows, model).withColumn("seq", F.col("vec_id"))


def r4(c, name: str):
    return (F.round(c, 4) + 0.0).alias(name)  # + 0.0: no negative zero


S4 = "(round({0}, 4) + 0.0) AS {1}"


def s4(expression: str, name: str) -> str:
    return S4.format(expression, name)


def spread(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    return df.select("vec_id", F.posexplode(column).alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), r4(F.col("x"), name))


def spread_sql(ctes: str, source: str, column: str, name: str = "value") -> str:
    return f"WITH {ctes} SELECT vec_id, i, {s4('x', name)} FROM (SELECT vec_id, unnest(range(len(l))) AS i, unnest(l) AS x FROM (SELECT vec_id, {column} AS l FROM {source}))"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that executors share: beside the checkpoints where those have a place, else our own."""
    shared = spark.sparkContext._jsc.sc().getCheckpointDir()
    base = shared.get() if shared.isDefined() else spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="index-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def index_of(spark: SparkSession, sf_dir: str, model: VectorModel | None = None, name: str = "index") -> VectorIndex:
    index = VectorIndex.create(spark, scratch(spark, name), model or lm())
    index.insert(embeddings(spark, sf_dir))
    return index


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def registered(sql=None):
    """Register a query under its function's name; ``sql`` is made when asked for."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Vectors as they are

_WITH_ZERO = "(SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE) * (1 + vec_id % 5)) AS x FROM embeddings UNION ALL SELECT -1, list_transform(range(64), lambda i: 0.0::DOUBLE))"


def _with_zero(spark, sf_dir):
    zero = spark.range(1).select(F.lit(-1).cast("long").alias("vec_id"), F.array_repeat(F.lit(0.0), DIM).alias("embedding"))
    return embeddings(spark, sf_dir, True).select("vec_id", "embedding").unionAll(zero)


@registered(lambda: f"SELECT vec_id, {s4('sqrt(list_inner_product(x, x))', 'norm')} FROM {_WITH_ZERO}")
def vec_l2_norm(spark, sf_dir):
    return _with_zero(spark, sf_dir).select("vec_id", r4(X.l2_norm(F.col("embedding")), "norm"))


@registered(lambda: f"SELECT vec_id, i, {s4('CASE WHEN n > 1e-10 THEN z / n ELSE 0 END', 'value')} FROM (SELECT vec_id, unnest(range(len(x))) AS i, unnest(x) AS z, sqrt(list_inner_product(x, x)) AS n FROM {_WITH_ZERO})")
def vec_normalize(spark, sf_dir):
    return spread(_with_zero(spark, sf_dir).withColumn("u", X.normalize(F.col("embedding"))), "u")


_EXACT = f"(SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE {EVERY}) q)"


def _top(source: str, k: int = 10) -> str:
    return f"SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, {s4('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM {source}) WHERE rank <= {k}"


@registered(lambda: _top(_EXACT))
def exact_topk_batch(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return search.exact_topk(df, query_rows(df), 10).select("query_id", "rank", "vec_id", r4(F.col("score"), "score"))


@registered(lambda: f"SELECT vec_id, score FROM ({_top(_EXACT)}) WHERE query_id = 0")
def exact_topk(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    q = F.array(*map(F.lit, row_zero(spark, sf_dir))).cast("array<double>")
    return df.select("vec_id", X.dot(F.col("embedding").cast("array<double>"), q).alias("s")).orderBy(F.desc("s"), "vec_id").limit(10).select("vec_id", r4(F.col("s"), "score"))


# The codec, a step at a time

@registered(lambda: spread_sql(O.encoded(lm(), True), "enc", "rotated"))
def rotate(spark, sf_dir):
    return spread(codec.inspect(embeddings(spark, sf_dir, True), lm()), "rotated")


@registered(lambda: spread_sql(O.encoded(lm(), True), "enc", "list_transform(x, lambda z: z / norm)"))
def inverse_rotate_roundtrip(spark, sf_dir):
    turned = X.with_model(codec.inspect(embeddings(spark, sf_dir, True), lm()), lm())
    return spread(turned.withColumn("back", X.transposed_times("model_rotation", "rotated", DIM)), "back")


@registered(lambda: f"SELECT CAST(bits AS INTEGER) AS bits, i, {s4('centroid', 'centroid')}, {s4('(centroid + lead(centroid) OVER (PARTITION BY bits ORDER BY i)) / 2', 'boundary')}, CAST(rounds AS INTEGER) AS rounds FROM ({O.codebook(DIM, [1, 2, 3, 4])})")
def lm_codebook(spark, sf_dir):
    rows = [(b, i, c, (bounds[i] if i < len(bounds) else None), rounds) for b in (1, 2, 3, 4) for cs, bounds, rounds in [codebook(DIM, b)] for i, c in enumerate(cs)]
    return spark.createDataFrame(rows, "bits int, i long, centroid double, boundary double, rounds int").select("bits", "i", r4(F.col("centroid"), "centroid"), r4(F.col("boundary"), "boundary"), "rounds")


def _sums(column: str) -> list:
    c = F.transform(column, lambda x, i: x.cast("long") * (i + 1))
    return [F.aggregate(column, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x).alias("weighted")]


def _sums_sql(column: str) -> str:
    return f"CAST(list_sum({column}) AS BIGINT) AS total, CAST(list_sum(list_transform(range(len({column})), lambda i: {column}[i + 1] * (i + 1))) AS BIGINT) AS weighted"


@registered(lambda: " UNION ALL ".join(f"(WITH {O.encoded(lm(b), True)} SELECT vec_id, {b} AS bits, {_sums_sql('code')} FROM enc)" for b in LM_BITS))
def lm_codes(spark, sf_dir):
    return reduce(DataFrame.unionAll, [codec.inspect(embeddings(spark, sf_dir, True), lm(b)).select("vec_id", F.lit(b).alias("bits"), *_sums("code")) for b in LM_BITS])


@registered(lambda: " UNION ALL ".join(f"(WITH {O.encoded(lm(b))} SELECT vec_id, {b} AS bits, {O.packed('code', b, DIM)} AS codes FROM enc)" for b in (3, 4)))
def lm_packed(spark, sf_dir):
    return reduce(DataFrame.unionAll, [codec.encode(embeddings(spark, sf_dir).select("vec_id", "embedding"), lm(b)).select("vec_id", F.lit(b).alias("bits"), F.hex("codes").alias("codes")) for b in (3, 4)])


@registered(lambda: f"WITH {O.encoded(lm(3), True)} SELECT vec_id, {O.packed('code', 3, DIM)} AS codes, {O.packed('sign', 1, DIM)} AS signs, {s4('norm', 'original_norm')}, {s4('residual', 'residual_norm')} FROM enc")
def encode_expressions(spark, sf_dir):
    made = X.encode_columns(embeddings(spark, sf_dir, True), lm(3))
    return made.select("vec_id", X.packed_hex("code", 3, DIM).alias("codes"), X.packed_hex("sign", 1, DIM).alias("signs"), r4(F.col("original_norm"), "original_norm"), r4(F.col("residual_norm"), "residual_norm"))


@registered(lambda: f"WITH {O.encoded(lm(), True)} SELECT vec_id, {O.packed('code', 4, DIM)} AS codes, {O.packed('sign', 1, DIM)} AS signs, {s4('residual_f', 'residual_norm')}, {s4('norm_f', 'original_norm')} FROM enc")
def encode_rows(spark, sf_dir):
    rows = codec.encode(embeddings(spark, sf_dir, True).select("vec_id", "embedding"), lm())
    return rows.select("vec_id", F.hex("codes").alias("codes"), F.hex("signs").alias("signs"), r4(F.col("residual_norm").cast("double"), "residual_norm"), r4(F.col("original_norm").cast("double"), "original_norm"))


@registered(lambda: " UNION ALL ".join(f"(WITH {O.encoded(lm(b))} SELECT vec_id, {b} AS bits, {_sums_sql('sign')}, {s4('residual', 'residual_norm')} FROM enc)" for b in (1, 4)))
def qjl_signs(spark, sf_dir):
    return reduce(DataFrame.unionAll, [codec.inspect(embeddings(spark, sf_dir), lm(b)).select("vec_id", F.lit(b).alias("bits"), *_sums("sign"), r4(F.col("residual_norm"), "residual_norm")) for b in (1, 4)])


@registered(lambda: spread_sql(O.encoded(lm(), True), "enc, m", f"list_transform({O.decoded(norm='norm_f')}, lambda z: CAST(CAST(z AS FLOAT) AS DOUBLE))"))
def lm_decode(spark, sf_dir):
    rows = codec.decode(codec.encode(embeddings(spark, sf_dir, True), lm()), lm())
    return spread(rows.withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding")


# Scores and searches

def _scores(model, scaled=False, where="vec_id = 0", stored=True, qjl=True) -> str:
    return f"WITH {O.encoded(model, scaled)}, {O.prepared(where)}, scores AS (SELECT query_id, vec_id, label, norm, {O.score(model, stored, qjl)} AS score FROM enc, q)"


@registered(lambda: f"{_scores(lm(), True)} SELECT vec_id, {s4('score', 'score')} FROM scores")
def score_all(spark, sf_dir):
    return search.score_pairs(encoded(spark, sf_dir, lm(), True), row_zero(spark, sf_dir, True), lm()).select("vec_id", r4(F.col("score"), "score"))


@registered(lambda: f"{_scores(lm(), True, qjl=False)} SELECT vec_id, {s4('score', 'score')} FROM scores")
def score_without_signs(spark, sf_dir):
    return search.score_pairs(encoded(spark, sf_dir, lm(), True), row_zero(spark, sf_dir, True), lm(), use_qjl=False).select("vec_id", r4(F.col("score"), "score"))


def _best(where: str = "true", k: int = 10) -> str:
    return f"SELECT vec_id, {s4('score', 'score')} FROM scores WHERE {where} ORDER BY scores.score DESC, vec_id LIMIT {k}"


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("vec_id", r4(F.col("score"), "score"))


@registered(lambda: f"{_scores(lm())} {_best()}")
def search_topk(spark, sf_dir):
    return _rounded(search.topk(encoded(spark, sf_dir, lm()), row_zero(spark, sf_dir), lm(), 10))


@registered(lambda: f"{_scores(lm(), where=EVERY)} {_top('scores')}")
def search_topk_batch(spark, sf_dir):
    hits = search.topk_join(encoded(spark, sf_dir, lm()), query_rows(embeddings(spark, sf_dir)), lm(), 10)
    return hits.select("query_id", "rank", "vec_id", r4(F.col("score"), "score"))


@registered(lambda: f"{_scores(lm())} {_best('label = 3')}")
def search_filtered(spark, sf_dir):
    return _rounded(search.topk(encoded(spark, sf_dir, lm(), where="label = 3"), row_zero(spark, sf_dir), lm(), 10))


@registered(lambda: f"{_scores(lm())} SELECT vec_id, label, {s4('score', 'score')} FROM scores ORDER BY scores.score DESC, vec_id LIMIT 10")
def payload_join(spark, sf_dir):
    hits = search.topk(encoded(spark, sf_dir, lm()), row_zero(spark, sf_dir), lm(), 10)
    return embeddings(spark, sf_dir).select("vec_id", "label").join(F.broadcast(hits), "vec_id").select("vec_id", "label", r4(F.col("score"), "score"))


# The index

@registered(lambda: f"{_scores(lm())} {_best()}")
def index_search(spark, sf_dir):
    index = index_of(spark, sf_dir)
    return _rounded(VectorIndex.open(spark, index.store.root, lm()).search(row_zero(spark, sf_dir), 10))


@registered(lambda: f"{_scores(lm(), where=EVERY)} {_top('scores')}")
def index_search_batch(spark, sf_dir):
    return index_of(spark, sf_dir).search_batch(query_rows(embeddings(spark, sf_dir)), 10).select("query_id", "rank", "vec_id", r4(F.col("score"), "score"))


def _without_thirds(spark, sf_dir) -> VectorIndex:
    index = index_of(spark, sf_dir)
    index.delete(embeddings(spark, sf_dir).where("vec_id % 3 = 0").select("vec_id"))
    return index


@registered(lambda: f"{_scores(lm())} {_best('vec_id % 3 <> 0')}")
def search_after_delete(spark, sf_dir):
    return _rounded(_without_thirds(spark, sf_dir).search(row_zero(spark, sf_dir), 10))


@registered(lambda: f"{_scores(lm())} {_best('vec_id % 3 <> 0')}")
def search_after_reinsert(spark, sf_dir):
    """An id that is inserted again before compaction stays hidden."""
    index = _without_thirds(spark, sf_dir)
    index.insert(embeddings(spark, sf_dir).where("vec_id % 3 = 0"))
    return _rounded(index.search(row_zero(spark, sf_dir), 10))


@registered(lambda: f"{_scores(lm())} {_best('vec_id % 3 <> 0')}")
def search_after_compact(spark, sf_dir):
    index = _without_thirds(spark, sf_dir)
    index.compact()
    return _rounded(VectorIndex.open(spark, index.store.root).search(row_zero(spark, sf_dir), 10))


@registered(lambda: "SELECT count(*) AS inserted, count(*) FILTER (WHERE vec_id % 3 <> 0) AS after_delete, count(*) FILTER (WHERE vec_id % 3 <> 0) AS after_compact, max(vec_id) + 1 AS next_id, CAST(count(*) * 48 AS BIGINT) AS bytes FROM embeddings")
def index_len(spark, sf_dir):
    index = index_of(spark, sf_dir)
    inserted, size, next_id = len(index), index.storage_bytes(), index.next_id()
    index.delete(embeddings(spark, sf_dir).where("vec_id % 3 = 0").select("vec_id"))
    deleted = len(index)
    index.compact()
    return spark.createDataFrame([(inserted, deleted, index.live_count(), next_id, size)], "inserted long, after_delete long, after_compact long, next_id long, bytes long")


# The polar variant

@registered(lambda: f"WITH {O.encoded(polar(3, 6), True)} SELECT vec_id, unnest(range(len(angle))) AS i, unnest(angle) AS angle, unnest(radius) AS radius FROM enc")
def polar_codes(spark, sf_dir):
    rows = codec.inspect(embeddings(spark, sf_dir, True), polar(3, 6))
    return rows.select("vec_id", F.posexplode(F.arrays_zip("angle", "radius")).alias("i", "z")).select("vec_id", F.col("i").cast("long").alias("i"), "z.angle", "z.radius")


@registered(lambda: f"WITH {O.encoded(polar(), True)} SELECT vec_id, unnest(range(len(angle))) AS i, unnest(angle) AS angle, unnest(radius) AS radius FROM enc")
def polar_codes_expressions(spark, sf_dir):
    rows = codec.inspect(embeddings(spark, sf_dir, True), polar())
    made = rows.select("vec_id", F.posexplode(X.polar_codes(F.col("rotated"), polar())).alias("i", "z"))
    return made.select("vec_id", F.col("i").cast("long").alias("i"), "z.angle", "z.radius")


@registered(lambda: spread_sql(O.encoded(polar(), True), "enc, m", f"list_transform({O.decoded(norm='norm_f')}, lambda z: CAST(CAST(z AS FLOAT) AS DOUBLE))"))
def polar_decode(spark, sf_dir):
    rows = codec.decode(codec.encode(embeddings(spark, sf_dir, True), polar()), polar())
    return spread(rows.withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding")


@registered(lambda: f"{_scores(polar(), where=EVERY)} {_top('scores')}")
def polar_search(spark, sf_dir):
    hits = search.topk_join(encoded(spark, sf_dir, polar()), query_rows(embeddings(spark, sf_dir)), polar(), 10)
    return hits.select("query_id", "rank", "vec_id", r4(F.col("score"), "score"))


@registered(lambda: f"WITH {O.encoded(polar())} SELECT a.vec_id AS left_id, b.vec_id AS right_id, {s4('list_inner_product(a.near, b.near)', 'similarity')} FROM (SELECT * FROM enc WHERE {EVERY}) a, enc b")
def polar_code_similarity(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return search.code_similarity(codec.encode(rows.where(EVERY), polar()), codec.encode(rows, polar()), polar()).select("left_id", "right_id", r4(F.col("similarity"), "similarity"))


# Baselines and measures

_NAIVE = "(least(greatest(floor((z + {r}) / (2 * {r}) * {l}), 0), {l} - 1) + 0.5) / {l} * (2 * {r}) - {r}"


def _naive_sql(bits: int, reach: float) -> str:
    made = _NAIVE.format(r=repr(reach), l=f"{float(1 << bits)}")
    x = "embedding::DOUBLE[]"
    mse = f"list_sum(list_transform({x}, lambda z: ({made} - z) * ({made} - z))) / len(embedding)"
    return f"(SELECT vec_id, {bits} AS bits, CAST({reach!r} AS DOUBLE) AS reach, {s4(mse + ' * 64', 'scaled_mse')}, {s4(f'list_inner_product({x}, list_transform({x}, lambda z: {made})) / (sqrt(list_inner_product({x}, {x})) * sqrt(list_inner_product(list_transform({x}, lambda z: {made}), list_transform({x}, lambda z: {made}))))', 'cosine')} FROM embeddings)"


def _naive(spark, sf_dir, bits: list[int], reach: float) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    made = [X.naive_round_trip(x, b, reach) for b in bits]
    df = embeddings(spark, sf_dir)
    return reduce(DataFrame.unionAll, [df.select("vec_id", F.lit(b).alias("bits"), F.lit(reach).alias("reach"), r4(metrics.squared_error(x, y) * DIM, "scaled_mse"), r4(metrics.cosine(x, y), "cosine")) for b, y in zip(bits, made, strict=True)])


@registered(lambda: " UNION ALL ".join(_naive_sql(b, 0.5) for b in (2, 4, 8)))
def naive_uniform(spark, sf_dir):
    """Range 4 / sqrt(64), which holds the coordinates."""
    return _naive(spark, sf_dir, [2, 4, 8], 0.5)


@registered(lambda: " UNION ALL ".join(_naive_sql(b, 1.0) for b in (2, 4, 8)))
def naive_miscalibrated(spark, sf_dir):
    """A range twice too wide."""
    return _naive(spark, sf_dir, [2, 4, 8], 1.0)


def _error_sql(m: VectorModel) -> str:
    return f"""(WITH {O.encoded(m)}, two AS (SELECT x, {O.decoded()} AS y FROM enc, m)
        SELECT '{m.label}' AS label, {m.bytes_per_vector} AS bytes_per_vector, count(*) AS n,
               {s4('avg(list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) ', 'scaled_mse')},
               {s4('avg(list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))))', 'cosine')} FROM two)"""


def _errors(spark, sf_dir, models: list[VectorModel]) -> DataFrame:
    return metrics.reconstruction(embeddings(spark, sf_dir), models).select("label", "bytes_per_vector", "n", r4(F.col("mse") * DIM, "scaled_mse"), r4(F.col("cosine"), "cosine"))


@registered(lambda: " UNION ALL ".join(_error_sql(m) for m in map(lm, LM_BITS)))
def reconstruction_lm(spark, sf_dir):
    return _errors(spark, sf_dir, [lm(b) for b in LM_BITS])


@registered(lambda: " UNION ALL ".join(_error_sql(polar(*p)) for p in POLAR_BITS))
def reconstruction_polar(spark, sf_dir):
    return _errors(spark, sf_dir, [polar(*p) for p in POLAR_BITS])


def _all_models() -> list[VectorModel]:
    return [*(polar(*p) for p in POLAR_BITS), *map(lm, LM_BITS)]


@registered(lambda: f"SELECT *, {s4(f'8.0 * bytes_per_vector / {DIM}', 'bits_per_dim')}, {s4(f'4.0 * {DIM} / bytes_per_vector', 'ratio')} FROM ({' UNION ALL '.join(map(_error_sql, _all_models()))})")
def head_to_head(spark, sf_dir):
    """Twelve configurations, six of each variant, in one table."""
    made = metrics.head_to_head(embeddings(spark, sf_dir), _all_models())
    return made.select("label", "bytes_per_vector", "n", r4(F.col("mse") * DIM, "scaled_mse"), r4(F.col("cosine"), "cosine"), r4(F.col("bits_per_dim"), "bits_per_dim"), r4(F.col("ratio"), "ratio"))


def _configs_sql() -> str:
    of_polar = f"SELECT 'PQ ' || a || 'a/' || r || 'r' AS label, 'polar' AS variant, 0 AS bits, a AS angle_bits, r AS radius_bits, {DIM // 2} + CASE WHEN a = 4 THEN {DIM // 4} ELSE {DIM // 2} END + {DIM // 8} + 8 AS bytes_per_vector FROM (VALUES {', '.join(map(str, POLAR_BITS))}) AS t(a, r)"
    of_lm = f"SELECT 'LM ' || b, 'lloyd_max', b, 0, 0, {DIM // 8} * b + {DIM // 8} + 8 FROM (VALUES {', '.join(f'({b})' for b in LM_BITS)}) AS t(b)"
    return f"{of_polar} UNION ALL {of_lm}"


@registered(_configs_sql)
def configs(spark, sf_dir):
    return metrics.configs(spark, _all_models())


@registered(lambda: " UNION ALL ".join(_error_sql(polar(*p)) for p in SWEEP))
def bit_width_sweep(spark, sf_dir):
    return _errors(spark, sf_dir, [polar(*p) for p in SWEEP])


def _both_tops(spark, sf_dir):
    df = embeddings(spark, sf_dir)
    return search.exact_topk(df, query_rows(df), 10), search.topk_join(encoded(spark, sf_dir, lm()), query_rows(df), lm(), 10)


_TOPS = "{0}, hits AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scores) WHERE n <= 10), truth AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM {1}) WHERE n <= 10), shared AS (SELECT t.query_id, count(h.vec_id) AS found FROM truth t LEFT JOIN hits h ON t.query_id = h.query_id AND t.vec_id = h.vec_id GROUP BY t.query_id)"


@registered(lambda: f"{_TOPS.format(_scores(lm(), where=EVERY), _EXACT)} SELECT {s4('avg(found / 10.0)', 'recall')} FROM shared")
def recall_at_10(spark, sf_dir):
    return metrics.recall(*_both_tops(spark, sf_dir), 10).select(r4(F.col("recall"), "recall"))


@registered(lambda: f"{_TOPS.format(_scores(lm(), where=EVERY), _EXACT)} SELECT query_id, CAST(found AS INTEGER) AS overlap FROM shared")
def topk_overlap(spark, sf_dir):
    return metrics.overlap(*_both_tops(spark, sf_dir))


def _ip_sql(bits: int) -> str:
    m = lm(bits)
    kinds = {"plain": O.score(m, False, False), "corrected": O.score(m, False, True)}
    parts = [
        f"""(WITH {O.encoded(m)}, {O.prepared(EVERY)}, p AS (SELECT list_inner_product(x, qx) AS t, {s} AS e FROM enc, q)
        SELECT {bits} AS bits, '{k}' AS estimate, count(*) AS n, {s4('avg(e - t)', 'bias')}, {s4('avg(abs(e - t))', 'mae')}, {s4('var_samp(e - t)', 'var')}, {s4('sqrt(var_samp(e - t) / count(*))', 'std_err')}, {s4('abs(avg(e - t)) / avg(abs(t)) * 100', 'relative_bias')}, {s4('sum(e * t) / sum(t * t)', 'slope')} FROM p)"""
        for k, s in kinds.items()
    ]
    return " UNION ALL ".join(parts)


@registered(lambda: " UNION ALL ".join(map(_ip_sql, (1, 4))))
def inner_product_errors(spark, sf_dir):
    df, out = embeddings(spark, sf_dir), []
    for bits in (1, 4):
        e = metrics.inner_product_errors(df, query_rows(df), lm(bits))
        out.append(e.select(F.lit(bits).alias("bits"), "estimate", "n", *[r4(F.col(c), c) for c in ("bias", "mae", "var", "std_err", "relative_bias", "slope")]))
    return reduce(DataFrame.unionAll, out)


@registered(lambda: f"WITH {O.encoded(lm())} SELECT count(*) AS n, {s4('avg(z)', 'mean')}, {s4('var_pop(z)', 'variance')}, {s4('stddev_pop(z)', 'std')} FROM (SELECT unnest(rotated) AS z FROM enc)")
def rotated_coordinates(spark, sf_dir):
    made = metrics.coordinate_statistics(codec.inspect(embeddings(spark, sf_dir), lm()))
    return made.select("n", *[r4(F.col(c), c) for c in ("mean", "variance", "std")])


@registered(lambda: " UNION ALL ".join(f"SELECT 'LM {b}' AS label, {d} AS dim, 8 + ceil({d} * {b} / 8.0)::INT + ceil({d} / 8.0)::INT AS bytes_per_vector, {s4(f'8.0 * (8 + ceil({d} * {b} / 8.0) + ceil({d} / 8.0)) / {d}', 'bits_per_dim')}, {s4(f'4.0 * {d} / (8 + ceil({d} * {b} / 8.0) + ceil({d} / 8.0))', 'ratio')}" for d in (64, 384) for b in LM_BITS))
def compression_summary(spark, sf_dir):
    models = [VectorModel.lloyd_max(d, b) for d in (64, 384) for b in LM_BITS]
    return metrics.sizes(spark, models).select("label", "dim", "bytes_per_vector", r4(F.col("bits_per_dim"), "bits_per_dim"), r4(F.col("ratio"), "ratio"))


@registered(lambda: "SELECT count(*) AS vectors, CAST(21 + count(*) * 48 AS BIGINT) AS file_bytes, CAST(count(*) * 256 AS BIGINT) AS raw_bytes FROM embeddings")
def storage_size(spark, sf_dir):
    n = embeddings(spark, sf_dir).count()
    return spark.createDataFrame([(n, metrics.record_file_bytes(lm(), n), 4 * DIM * n)], "vectors long, file_bytes long, raw_bytes long")


@registered(lambda: "SELECT tokens, layers, 2 * 4 * 128 * tokens * layers AS raw_bytes, 2 * (8 + 48 + 16) * tokens * layers AS compressed_bytes FROM (VALUES (1::BIGINT, 1::BIGINT), (4096, 32)) AS t(tokens, layers)")
def kv_cache_size(spark, sf_dir):
    m = VectorModel.lloyd_max(128, 3)
    return spark.createDataFrame([(t, n, *metrics.kv_cache_bytes(m, t, n)) for t, n in ((1, 1), (4096, 32))], "tokens long, layers long, raw_bytes long, compressed_bytes long")


# Vectors from seeds and texts

def _uniform_sql(salt: str = "") -> str:
    return f"((('0x' || substr(md5(seed || ':{salt}' || i), 1, 12))::BIGINT + 0.5) / 281474976710656.0)"


def _unit_sql(value: str, source: str) -> str:
    """Unit vectors of ``value`` over the seeds and places of ``source`` (vec_id, seed)."""
    parts = f"SELECT vec_id, i, {value} AS z FROM (SELECT vec_id, seed, unnest(range({DIM})) AS i FROM {source})"
    return f"SELECT vec_id, i, {s4('z / sqrt(sum(z * z) OVER (PARTITION BY vec_id))', 'value')} FROM ({parts})"


@registered(lambda: _unit_sql(f"({_uniform_sql()} * 2 - 1)", "(SELECT doc_id AS vec_id, md5(text) AS seed FROM documents)"))
def hash_embedding(spark, sf_dir):
    """Hash vectors of the documents: whole texts, no model needed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("vec_id"), X.hash_vector(F.col("text"), DIM).alias("embedding"))
    return spread(docs, "embedding")


@registered(lambda: _unit_sql(f"({_uniform_sql()} * 2 - 1)", "(SELECT vec_id, CAST(vec_id AS VARCHAR) AS seed FROM embeddings)"))
def seeded_vectors(spark, sf_dir):
    """A unit vector from each id as its seed."""
    return spread(embeddings(spark, sf_dir).select("vec_id", X.seeded_vector(F.col("vec_id"), DIM).alias("v")), "v")


@registered(lambda: _unit_sql(f"(sqrt(-2 * ln({_uniform_sql('r')})) * cos(2 * pi() * {_uniform_sql('a')}))", "(SELECT vec_id, CAST(vec_id AS VARCHAR) AS seed FROM embeddings)"))
def gaussian_vectors(spark, sf_dir):
    """Unit vectors spread evenly, by normal components."""
    return spread(embeddings(spark, sf_dir).select("vec_id", X.gaussian_vector(F.col("vec_id"), DIM).alias("v")), "v")


#: Of the encoder that stands for a model in queries: tokens, and dimensions of their hidden states.
TOKENS, WIDTH = 97, 8


def _tokenize(texts):
    import hashlib

    return [[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % TOKENS for w in t.split(" ") if w] for t in texts]


def _states() -> np.ndarray:
    """Hidden states by token: a fixed table."""
    i, j = np.indices((TOKENS, WIDTH))
    return ((i * 7 + j * 13 + i * j) % 31 - 15) / 16


def _forward(ids, mask):
    return _states()[ids]


def _embed_sql() -> str:
    words = f"SELECT doc_id AS vec_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {TOKENS} AS t FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> ''"
    pooled = f"SELECT vec_id, j, avg(((t * 7 + j * 13 + t * j) % 31 - 15) / 16.0) AS z FROM ({words}), range({WIDTH}) AS r(j) GROUP BY vec_id, j"
    made = f"SELECT d.doc_id AS vec_id, r.j, coalesce(p.z, 0) AS z FROM documents d CROSS JOIN range({WIDTH}) AS r(j) LEFT JOIN ({pooled}) p ON p.vec_id = d.doc_id AND p.j = r.j"
    return f"SELECT vec_id, j AS i, {s4('CASE WHEN n > 0 THEN z / n ELSE 0 END', 'value')} FROM (SELECT *, sqrt(sum(z * z) OVER (PARTITION BY vec_id)) AS n FROM ({made}))"


@registered(_embed_sql)
def embed_documents(spark, sf_dir):
    """Whole texts through tokens, padding, an encoder and the masked mean; the encoder is a table of states by token."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("vec_id"), "text")
    return spread(embed(docs, _tokenize, _forward), "embedding")


@registered(lambda: f"SELECT label, i, {s4('v / sqrt(sum(v * v) OVER (PARTITION BY label))', 'value')} FROM (SELECT label, i, avg(z) AS v FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding::DOUBLE[]) AS z FROM embeddings) GROUP BY label, i)")
def mean_pool(spark, sf_dir):
    """The mean vector of each label, normalised: rows of one pool need not meet in one task."""
    parts = embeddings(spark, sf_dir).select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = parts.groupBy("label", F.col("i").cast("long").alias("i")).agg(F.avg("x").alias("v"))
    norms = means.groupBy("label").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return means.join(norms, "label").select("label", "i", r4(F.col("v") / F.col("norm"), "value"))


# SQL

@registered(lambda: f"{_scores(lm())} {_best()}")
def sql_functions(spark, sf_dir):
    register(spark, lm())
    embeddings(spark, sf_dir).createOrReplaceTempView("vq_input")
    return spark.sql(f"SELECT vec_id, round(score, 4) + 0.0D AS score FROM (SELECT vec_id, vq_score(vq_encode(embedding), array({', '.join(f'{float(x)!r}D' for x in row_zero(spark, sf_dir))})) AS score FROM vq_input) AS t ORDER BY t.score DESC, vec_id LIMIT 10")


@registered(lambda: f"{_scores(polar())} {_best()}")
def sql_functions_polar(spark, sf_dir):
    register(spark, polar())
    embeddings(spark, sf_dir).createOrReplaceTempView("vq_input")
    return spark.sql(f"SELECT vec_id, round(score, 4) + 0.0D AS score FROM (SELECT vec_id, vq_score(vq_encode(embedding), array({', '.join(f'{float(x)!r}D' for x in row_zero(spark, sf_dir))})) AS score FROM vq_input) AS t ORDER BY t.score DESC, vec_id LIMIT 10")


#: Rows that the table function ranks in one place; places are 0, 1, 2, ... so that tasks grow with the table.
BLOCK = 65_536


@registered(lambda: f"{_scores(lm())} {_best()}")
def sql_search(spark, sf_dir):
    """The search as a table function: ``vq_search(TABLE(codes), query, k)`` ranks each block of rows, in batches."""
    register(spark, lm())
    encoded(spark, sf_dir, lm()).select("vec_id", "seq", "codes", "signs", "residual_norm", "original_norm").createOrReplaceTempView("vq_codes")
    query = f"array({', '.join(f'{float(x)!r}D' for x in row_zero(spark, sf_dir))})"
    return spark.sql(f"SELECT vec_id, round(score, 4) + 0.0D AS score FROM vq_search(TABLE(SELECT * FROM vq_codes) PARTITION BY (seq DIV {BLOCK}), {query}, 10) AS t ORDER BY t.score DESC, vec_id LIMIT 10")
