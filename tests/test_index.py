import numpy as np
import pytest
from pyspark.sql import functions as F

from vecpack import DimensionMismatch, InvalidVector, ModelMismatch, NotFound, StorageError, VectorIndex, VectorModel
from vecpack.operators import search
from vecpack.sources import tqlm
from vecpack.streaming import insert_stream


def one_hot(i, d=16):
    return [float(j == i) for j in range(d)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def ids(hits):
    return [r["vec_id"] for r in hits.collect()]


@pytest.fixture
def index(spark, tmp_path):
    index = VectorIndex.create(spark, str(tmp_path / "index"), VectorModel.lloyd_max(16))
    index.insert(frame(spark, [(i, one_hot(i)) for i in (1, 2, 3)]))
    return index


def test_insert_search_delete_compact_reopen(spark, index):
    assert ids(index.search(one_hot(2), 1)) == [2]
    assert (len(index), index.is_empty(), index.next_id()) == (3, False, 4)
    index.delete(2)
    assert len(index) == 2 and 2 not in ids(index.search(one_hot(2), 10))
    index.delete(2)
    before = index.search(one_hot(1), 10).collect()
    index.compact()
    assert len(index) == index.live_count() == 2
    again = VectorIndex.open(spark, index.store.root)
    after = again.search(one_hot(1), 10).collect()
    assert len(again) == 2 and [r["vec_id"] for r in after] == [r["vec_id"] for r in before]
    assert np.allclose([r["score"] for r in after], [r["score"] for r in before], rtol=1e-12)  # other batches round otherwise
    assert index.store.exists("gen=1") and not index.store.exists("gen=0")
    index.compact()
    assert again.store.read_text("_CURRENT") == "1"
    with pytest.raises(NotFound):
        index.delete(2)


def test_unknown_id_and_wrong_length(index, spark):
    with pytest.raises(NotFound):
        index.delete([1, 999])
    assert len(index) == 3
    with pytest.raises(DimensionMismatch) as e:
        index.insert_one(4, [1.0, 2.0])
    assert (e.value.expected, e.value.got) == (16, 2)
    with pytest.raises(DimensionMismatch):
        index.insert(frame(spark, [(4, one_hot(4)), (5, [1.0])]))
    assert index.search([1.0, 2.0], 3).collect() == [] and len(index) == 3


@pytest.mark.parametrize("bad", [None, [float("nan")] * 16, [None] * 16, [float("inf")] * 16])
def test_vectors_that_cant_be_stored(index, spark, bad):
    with pytest.raises(InvalidVector):
        index.insert(frame(spark, [(4, bad)]))


def test_ids_that_cant_be_stored(index, spark):
    for i in (2**63, -1):
        with pytest.raises(InvalidVector):
            index.insert_one(i, one_hot(1))
    with pytest.raises(InvalidVector):
        index.insert(spark.createDataFrame([(str(2**63), one_hot(1))], "vec_id string, embedding array<double>").withColumn("vec_id", F.col("vec_id").cast("decimal(20,0)")))
    index.insert_one(2**63 - 1, one_hot(5))
    assert ids(index.search(one_hot(5), 1)) == [2**63 - 1]


def test_copies_and_reinsertion(index, spark):
    index.insert_one(1, one_hot(7))
    assert ids(index.search(one_hot(7), 4)).count(1) == 2
    index.delete(1)
    assert (len(index), index.live_count()) == (3, 2)  # ids less tombstones counts a copy too many
    index.insert_one(1, one_hot(1))
    assert 1 not in ids(index.search(one_hot(1), 10))
    index.compact()
    assert sorted(ids(index.search(one_hot(1), 10))) == [2, 3]
    index.insert_one(1, one_hot(1))
    assert ids(index.search(one_hot(1), 1)) == [1]


@pytest.mark.parametrize(("k", "n"), [(0, 0), (2, 2), (3, 3), (8, 3)])
def test_k(index, k, n):
    assert len(ids(index.search(one_hot(1), k))) == n


def test_ties_rank_by_insertion(spark, tmp_path):
    index = VectorIndex.create(spark, str(tmp_path / "ties"), VectorModel.lloyd_max(16))
    for i in (9, 4, 7):
        index.insert_one(i, one_hot(3))
    assert ids(index.search(one_hot(3), 3)) == [9, 4, 7]


def test_empty_index(spark, tmp_path):
    index = VectorIndex.create(spark, str(tmp_path / "empty"), VectorModel.lloyd_max(16, 2))
    assert index.is_empty() and index.search(one_hot(1), 5).collect() == [] and index.next_id() == 0 and index.storage_bytes() == 0
    index.compact()


def test_create_and_open_are_careful(spark, index, tmp_path):
    with pytest.raises(StorageError):
        VectorIndex.create(spark, index.store.root, index.model)
    assert VectorIndex.create(spark, index.store.root, index.model, overwrite=True).is_empty()
    with pytest.raises(StorageError):
        VectorIndex.open(spark, str(tmp_path / "nowhere"))
    with pytest.raises(ModelMismatch):
        VectorIndex.open(spark, index.store.root, VectorModel.lloyd_max(16, rotation_seed=1))


@pytest.mark.parametrize("model", [VectorModel.polar(16), VectorModel.lloyd_max(16, 2)], ids=lambda m: m.label)
def test_other_models(spark, tmp_path, model):
    index = VectorIndex.create(spark, str(tmp_path / "other"), model)
    index.insert(frame(spark, [(i, one_hot(i)) for i in range(4)]))
    assert ids(index.search(one_hot(1), 1)) == [1]
    assert index.storage_bytes() == 4 * model.bytes_per_vector
    assert index.get(index.all_vectors().first()["seq"]).count() == 1


def test_places_are_dense_and_in_order(spark, tmp_path):
    """Over inserts of several tasks, empty ones among them, and again after compaction."""
    index = VectorIndex.create(spark, str(tmp_path / "dense"), VectorModel.lloyd_max(16, 2))
    first = frame(spark, [(i, one_hot(i % 16)) for i in range(50)]).repartitionByRange(6, "vec_id").where("vec_id < 10 OR vec_id > 30")
    index.insert(first)
    index.insert(first.limit(0))
    index.insert(frame(spark, [(100 + i, one_hot(i)) for i in range(5)]))
    want = [*range(10), *range(31, 50), *range(100, 105)]
    rows = sorted((r["seq"], r["vec_id"]) for r in index.all_vectors().collect())
    assert rows == list(enumerate(want))
    assert [r["vec_id"] for r in index.get(10).collect()] == [31] and index.get(34).count() == 0
    index.delete([0, 31, 104])
    index.compact()
    assert sorted((r["seq"], r["vec_id"]) for r in index.all_vectors().collect()) == list(enumerate(i for i in want if i not in (0, 31, 104)))
    index.insert_one(7, one_hot(1))
    assert index.get(31).first()["vec_id"] == 7 and not index.store.exists("staged")


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    index = VectorIndex.create(spark, str(tmp_path / "again"), VectorModel.lloyd_max(16))
    for _ in range(2):
        index.insert(frame(spark, [(1, one_hot(1)), (2, one_hot(2))]), batch="a")
    assert len(index) == 2 and sorted(r["seq"] for r in index.all_vectors().collect()) == [0, 1]


def test_recall(spark, tmp_path):
    x = np.random.default_rng(42).standard_normal((220, 384))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = VectorIndex.create(spark, str(tmp_path / "recall"), VectorModel.lloyd_max(384))
    data = frame(spark, [(i, v.tolist()) for i, v in enumerate(x[:200])])
    index.insert(data)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[200:])], "query_id long, embedding array<double>")
    got = {}
    for r in index.search_batch(queries, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    truth = np.argsort(-(x[200:] @ x[:200].T), axis=1)[:, :10]
    assert all([k for k, _ in sorted(v)] == list(range(1, 11)) for v in got.values())
    assert np.mean([len({i for _, i in got[q]} & {*truth[q].tolist()}) / 10 for q in range(20)]) > 0.75
    exact = {}
    for r in search.exact_topk(data, queries, 10).collect():
        exact.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert [[i for _, i in sorted(exact[q])] for q in range(20)] == truth.tolist()


def test_many_queries_go_in_passes(spark, index, monkeypatch):
    queries = spark.createDataFrame([(i, one_hot(1 + i % 3)) for i in range(7)], "query_id long, embedding array<double>")

    def hits():
        return sorted((q, rank, i, round(s, 9)) for q, rank, i, s in index.search_batch(queries, 2).collect())

    whole = hits()
    monkeypatch.setattr(search, "QUERIES_PER_PASS", 3)
    assert hits() == whole and len(whole) == 14
    with pytest.raises(DimensionMismatch):
        index.search_batch(spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>"), 2)


def test_best_rows_skip_nan_and_keep_order():
    scores = np.array([0.5, np.nan, 0.9, 0.9, 0.1])
    assert search.best_rows(scores, np.array([0, 1, 3, 2, 4]), 3).tolist() == [3, 2, 0]
    assert search.best_rows(scores, np.arange(5), 10).tolist() == [2, 3, 0, 4]


def test_record_files(spark, index, tmp_path):
    path = str(tmp_path / "index.tqlm")
    assert tqlm.write_records(index.vectors(), path, index.model) == 3
    assert (tmp_path / "index.tqlm").stat().st_size == 21 + 3 * index.model.bytes_per_vector
    spark.dataSource.register(tqlm.RecordSource)
    back = spark.read.format("tqlm").load(path).orderBy("seq").collect()
    kept = index.vectors().orderBy("seq").collect()
    assert [(r["codes"], r["signs"], r["original_norm"], r["residual_norm"]) for r in back] == [(r["codes"], r["signs"], r["original_norm"], r["residual_norm"]) for r in kept]
    raw = (tmp_path / "index.tqlm").read_bytes()
    assert tqlm.parse_header(raw) == (3, 16, 4)
    first = tqlm.deserialize(raw[21 : 21 + index.model.bytes_per_vector], 16, 4)
    assert tqlm.serialize(*first) == raw[21 : 21 + index.model.bytes_per_vector]
    for broken in (b"", b"ABCD" + raw[4:], raw[:12] + b"\0\0\0\0" + raw[16:]):
        with pytest.raises(StorageError):
            tqlm.parse_header(broken)
    with pytest.raises(StorageError):
        tqlm.deserialize(b"short", 16, 4)


def test_records_are_appended_and_read_by_place(spark, index, tmp_path):
    path, width = str(tmp_path / "more.tqlm"), index.model.bytes_per_vector
    tqlm.write_records(index.vectors().limit(0), path, index.model)
    assert tqlm.read_header(path) == (0, 16, 4) and (tmp_path / "more.tqlm").stat().st_size == 21
    for n in (1, 2):
        assert tqlm.append_records(index.vectors(), path, index.model) == 3
        assert tqlm.read_header(path) == (3 * n, 16, 4) and (tmp_path / "more.tqlm").stat().st_size == 21 + 3 * n * width
    kept = index.vectors().orderBy("seq").collect()
    for place in range(6):
        assert tqlm.read_record(path, place) == tuple(kept[place % 3][k] if isinstance(kept[0][k], float) else bytes(kept[place % 3][k]) for k in ("original_norm", "residual_norm", "codes", "signs"))
    for place in (-1, 6):
        with pytest.raises(IndexError):
            tqlm.read_record(path, place)
    spark.dataSource.register(tqlm.RecordSource)
    assert [r["seq"] for r in spark.read.format("tqlm").load(f"file://{path}").orderBy("seq").collect()] == list(range(6))
    with pytest.raises(StorageError):
        tqlm.append_records(index.vectors(), path, VectorModel.lloyd_max(16, 2))
    assert tqlm.read_header(path)[0] == 6


def test_stream(spark, index, tmp_path):
    source = str(tmp_path / "source")
    frame(spark, [(10, one_hot(10)), (11, one_hot(11))]).coalesce(1).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema("vec_id long, embedding array<double>").parquet(source)
        insert_stream(stream, index).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    assert len(index) == 5 and ids(index.search(one_hot(11), 1)) == [11]
