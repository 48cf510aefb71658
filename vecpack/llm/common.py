"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecpack.llm.memory import give_back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory, by Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in a file of a checkpoint whose size is known.
ROWS_PER_FILE = 100_000
#: Bytes of the largest table that a join may broadcast; its rows are counted first.
MAX_BROADCAST_BYTES = 16 << 20


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with its lineage cut by files in the shared folder of ``spark.checkpoint.dir``.

    Only where that setting is absent (tests on one machine) a folder of our own is used. ``rows`` is the
    most rows there can be, if that is known: a small table then goes to a few files.
    """
    if rows is not None:
        df = df.coalesce(rows // ROWS_PER_FILE + 1)
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def small_batches(spark: SparkSession, rows: int = 256, size: str = "4m") -> None:
    """Bound what one Arrow batch of long texts can weigh, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns named like one of ``names``, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind as it takes for no column of ``df`` to be named so."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def hinted(df: DataFrame, rows: int, bytes_a_row: int) -> DataFrame:
    """``df``, whose rows have been counted, to be broadcast in a join if it is small enough, by its bytes."""
    return F.broadcast(df) if rows * bytes_a_row <= MAX_BROADCAST_BYTES else df


def with_python_columns(df: DataFrame, inputs: list[str], compute, fields: list[T.StructField], drop: tuple[str, ...] = ()) -> DataFrame:
    """Append ``fields``, computed from the columns ``inputs`` by ``compute(*lists) -> lists``, batch by batch.

    ``compute`` gets one Python list for each input and returns one list for each field. Columns of ``df``
    that are named like a new field are replaced. Those in ``drop`` go to the worker and don't come back.
    """
    kept = without(df, [f.name for f in fields if f.name not in inputs])
    back = [f for f in kept.schema.fields if f.name not in {*drop, *(x.name for x in fields)}]
    types = [_arrow(f.dataType) for f in fields]
    names = [f.name for f in back]

    def run(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in inputs]
            made = [pa.array(v, t) for v, t in zip(compute(*columns), types, strict=True)]
            del columns
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + made, names=names + [f.name for f in fields])
        give_back()

    return kept.mapInArrow(run, T.StructType(back + fields))


def _arrow(kind: T.DataType) -> pa.DataType:
    simple = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.BinaryType(): pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return simple[kind]
