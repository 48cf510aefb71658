"""Command line: build an index of texts, and search it.

python -m vecpack build INDEX TABLE [--id doc_id] [--text text] [--bits 4] [--model-dir DIR] [--dim 384]
python -m vecpack search INDEX "some text" [-k 5] [--model-dir DIR]
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecpack.functions.expressions import hash_vector
from vecpack.model import VectorModel
from vecpack.operators.embed import OnnxEncoder, embed
from vecpack.sources.index import VectorIndex


def _vectors(texts: DataFrame, folder: str | None, dim: int) -> DataFrame:
    """(vec_id, embedding) of (vec_id, text): by the model of a folder, or by the texts' hashes."""
    if folder:
        encoder = OnnxEncoder(folder, dim)
        return embed(texts, encoder.tokenize, encoder.forward)
    return texts.select("vec_id", hash_vector(F.coalesce("text", F.lit("")), dim).alias("embedding"))


def main(arguments: Sequence[str] | None = None) -> list[tuple[int, float]] | int:
    """Run a command; the hits of a search, or how many texts were indexed."""
    parser = argparse.ArgumentParser(prog="vecpack", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    build, search = commands.add_parser("build"), commands.add_parser("search")
    for command, second in ((build, "table"), (search, "query")):
        command.add_argument("index")
        command.add_argument(second)
        command.add_argument("--model-dir", help="folder with an ONNX model and its tokenizer.json; without it, vectors are hashes of the texts")
    build.add_argument("--id", default="doc_id")
    build.add_argument("--text", default="text")
    build.add_argument("--bits", type=int, default=4)
    build.add_argument("--dim", type=int, default=384, help="of the vectors, where the model doesn't say")
    search.add_argument("-k", type=int, default=5)
    given = parser.parse_args(arguments)

    spark = SparkSession.builder.appName("vecpack").getOrCreate()
    if given.command == "build":
        texts = spark.read.parquet(given.table).select(F.col(f"`{given.id}`").cast("long").alias("vec_id"), F.col(f"`{given.text}`").alias("text"))
        dim = OnnxEncoder(given.model_dir, given.dim).dim if given.model_dir else given.dim
        index = VectorIndex.create(spark, given.index, VectorModel.lloyd_max(dim, given.bits))
        index.insert(_vectors(texts, given.model_dir, dim))
        print(f"{len(index)} texts, {index.storage_bytes()} bytes of codes")
        return len(index)
    index = VectorIndex.open(spark, given.index)
    query = _vectors(spark.createDataFrame([(0, given.query)], "vec_id long, text string"), given.model_dir, index.model.dim).first()["embedding"]
    hits = [(r["vec_id"], r["score"]) for r in index.search(query, given.k).collect()]
    for rank, (vec_id, score) in enumerate(hits, 1):
        print(f"{rank}\t{vec_id}\t{score:.4f}")
    return hits


if __name__ == "__main__":
    main()
