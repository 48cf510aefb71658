"""A persistent index of compressed vectors: insert, soft delete, compact, search, reopen."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecpack.errors import DimensionMismatch, InvalidVector, ModelMismatch, NotFound, StorageError
from vecpack.model import VectorModel
from vecpack.operators.arrow import invalid_reason, raise_invalid
from vecpack.operators.codec import code_fields, encode
from vecpack.operators.search import topk, topk_join
from vecpack.sources.store import Store

_CURRENT = "_CURRENT"
#: Places that compaction numbers in one task.
BLOCK = 1_000_000
#: Tombstones whose ids are broadcast to be skipped, at most; more are joined by a shuffle.
MAX_BROADCAST_TOMBSTONES = 1_000_000


class VectorIndex:
    """Folders of Parquet: the model, and for each generation vectors and tombstones.

    ``_CURRENT`` names the generation that counts; compaction writes the next one and then changes that
    name, so that a crash leaves the old one whole. Ids are stored with their codes. Equal ids may be
    inserted again; a deleted id hides all its copies, later ones included, until compaction drops them.
    """

    def __init__(self, spark: SparkSession, path: str, model: VectorModel, generation: int):
        self.spark, self.model = spark, model
        self.store = Store(spark, path)
        self.generation = generation
        self._vectors = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("seq", T.LongType()), *code_fields(model), T.StructField("part", T.StringType())])

    # Making and opening

    @staticmethod
    def create(spark: SparkSession, path: str, model: VectorModel, overwrite: bool = False) -> VectorIndex:
        index = VectorIndex(spark, path, model, 0)
        if index.store.exists(_CURRENT):
            if not overwrite:
                raise StorageError(f"there is an index at {path}")
            index.store.delete()
        model.to_df(spark).coalesce(1).write.mode("overwrite").parquet(index.store.path("model"))
        index._write_empty(0)
        index.store.write_text(_CURRENT, "0")
        return index

    @staticmethod
    def open(spark: SparkSession, path: str, expected: VectorModel | None = None) -> VectorIndex:
        store = Store(spark, path)
        if not store.exists(_CURRENT):
            raise StorageError(f"no index at {path}")
        model = VectorModel.from_row(spark.read.parquet(store.path("model")).first())
        if expected is not None and expected.fingerprint != model.fingerprint:
            raise ModelMismatch("the index was made with another model")
        return VectorIndex(spark, path, model, int(store.read_text(_CURRENT)))

    def _folder(self, name: str, generation: int | None = None) -> str:
        return self.store.path(f"gen={self.generation if generation is None else generation}", name)

    def _write_empty(self, generation: int) -> None:
        self.store.make(f"gen={generation}", "vectors")
        self.spark.createDataFrame([], "vec_id long").write.mode("overwrite").parquet(self._folder("tombstones", generation))

    # Reading

    def all_vectors(self) -> DataFrame:
        """Rows as stored, deleted ones too; ``part`` names the insert that they came by."""
        return self.spark.read.schema(self._vectors).parquet(self._folder("vectors"))

    def tombstones(self) -> DataFrame:
        return self.spark.read.schema("vec_id long").parquet(self._folder("tombstones")).distinct()

    def vectors(self) -> DataFrame:
        """Rows that aren't deleted; the filter is below whatever decodes or scores them."""
        dead = self.tombstones()
        small = dead.count() <= MAX_BROADCAST_TOMBSTONES
        return self.all_vectors().join(F.broadcast(dead) if small else dead, "vec_id", "left_anti")

    def get(self, seq: int) -> DataFrame:
        """The row at a place, from 0 in the order of insertion; none where there is no such place."""
        return self.all_vectors().where(F.col("seq") == seq)

    def __len__(self) -> int:
        """Rows less deleted ids: too many by each further copy of a deleted id. See :meth:`live_count`."""
        return self.all_vectors().count() - self.tombstones().count()

    def is_empty(self) -> bool:
        return len(self) == 0

    def live_count(self) -> int:
        return self.vectors().count()

    def next_id(self) -> int:
        """One more than the largest id that was ever inserted in this generation; 0 for none."""
        return self.all_vectors().agg(F.coalesce(F.max("vec_id") + 1, F.lit(0)).alias("n")).first()["n"]

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        """(vec_id, score) of the k best; none for a query of another length."""
        return topk(self.vectors(), [float(x) for x in query], self.model, k)

    def search_batch(self, queries: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score) for a stated set of queries (query_id, vector)."""
        return topk_join(self.vectors(), queries, self.model, k, vector=vector)

    # Writing

    def insert(self, rows: DataFrame, vector: str = "embedding", batch: str | None = None) -> None:
        """Append (vec_id, vector) rows in their order; all of them, or none if one can't be stored.

        One pass checks the rows, one encodes them to a folder beside the index; what is there, the codes alone,
        is then appended with its places, which go on from the last without gaps. ``batch`` names an insert
        that may come again: it replaces what an insert of that name appended.
        """
        kind = rows.schema["vec_id"].dataType
        wrong = F.col("vec_id").isNull()
        if not isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
            wrong = wrong | F.col("vec_id").cast("decimal(38,0)").isNull() | (F.col("vec_id").cast("decimal(38,0)") >= F.lit("9223372036854775808").cast("decimal(38,0)"))
        checked = rows.agg(F.max(invalid_reason(F.col(f"`{vector}`"), self.model.dim)).alias("why"), F.coalesce(F.bool_or(wrong | (F.col("vec_id") < 0)), F.lit(False)).alias("wrong")).first()
        raise_invalid(checked["why"], self.model.dim)
        if checked["wrong"]:
            raise InvalidVector("ids must be 0 to 2^63 - 1")

        name = batch or uuid.uuid4().hex
        staged, folder = f"staged-{name}", self.store.path(f"gen={self.generation}", "vectors", f"part={name}")
        numbered = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), F.col(f"`{vector}`").alias("vector"))
        encode(numbered, self.model, "vector").write.mode("overwrite").parquet(self.store.path(staged))
        codes = self.spark.read.parquet(self.store.path(staged))
        counts = codes.groupBy("task").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("task").collect()
        if counts:
            before = self.all_vectors().where(F.col("part") != name) if batch else self.all_vectors()
            base = before.agg(F.coalesce(F.max("seq") + 1, F.lit(0)).alias("n")).first()["n"]
            starts = accumulate((r["n"] for r in counts), initial=base)
            offsets = self.spark.createDataFrame([(r["task"], start - r["first"]) for r, start in zip(counts, starts, strict=False)], "task int, shift long")
            placed = codes.join(F.broadcast(offsets), "task").withColumn("seq", F.col("at") + F.col("shift"))
            placed.select(*self._vectors.names[:-1]).write.mode("overwrite").parquet(folder)
        self.store.delete(staged)

    def insert_one(self, vec_id: int, vector: Sequence[float]) -> None:
        if len(vector) != self.model.dim:
            raise DimensionMismatch(self.model.dim, len(vector))
        if not 0 <= vec_id < 2**63:
            raise InvalidVector("ids must be 0 to 2^63 - 1")
        self.insert(self.spark.createDataFrame([(vec_id, [float(x) for x in vector])], "vec_id long, embedding array<double>"))

    def delete(self, ids: int | Iterable[int] | DataFrame) -> None:
        """Hide ids; one that was never inserted raises NotFound and nothing is deleted, one deleted before is fine."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(int(i),) for i in ([ids] if isinstance(ids, int) else ids)], "vec_id long")
        gone = ids.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
        missing = gone.join(self.all_vectors().select("vec_id"), "vec_id", "left_anti").first()
        if missing is not None:
            raise NotFound(missing["vec_id"])
        gone.write.mode("append").parquet(self._folder("tombstones"))

    def compact(self) -> None:
        """Drop deleted rows for good and close the gaps between places; does nothing if there are none."""
        if self.tombstones().isEmpty():
            return
        old, new = self.generation, self.generation + 1
        self._write_empty(new)
        blocks = self.vectors().groupBy(F.expr(f"seq DIV {BLOCK}").alias("block")).agg(F.count("*").alias("n")).orderBy("block").collect()
        starts = accumulate((r["n"] for r in blocks), initial=0)
        offsets = self.spark.createDataFrame([(r["block"], start) for r, start in zip(blocks, starts, strict=False)], "block long, start long")
        rank = F.row_number().over(W.partitionBy("block").orderBy("seq"))
        placed = self.vectors().withColumn("block", F.expr(f"seq DIV {BLOCK}")).withColumn("rank", rank).join(F.broadcast(offsets), "block")
        closed = placed.withColumn("seq", F.col("start") + F.col("rank") - 1)
        closed.select(*self._vectors.names[:-1]).write.mode("overwrite").parquet(self.store.path(f"gen={new}", "vectors", "part=compacted"))
        self.store.write_text(_CURRENT, str(new))
        self.generation = new
        self.store.delete(f"gen={old}")

    def storage_bytes(self) -> int:
        """Sum of the codes', signs' and norms' bytes of all rows."""
        codes = [f.name for f in code_fields(self.model) if isinstance(f.dataType, T.BinaryType)]
        width = sum((F.length(c) for c in codes), F.lit(8))
        return self.all_vectors().agg(F.coalesce(F.sum(width), F.lit(0)).alias("n")).first()["n"]
