"""Texts to vectors: padding, masked mean, batches, and an ONNX model with its tokenizer."""

import json

import numpy as np
import pytest

from vecpack import OnnxEncoder, embed, embed_texts
from vecpack.functions import expressions as X
from vecpack.operators.embed import masked_mean, pad


def test_padding_and_masked_mean():
    ids, mask = pad([[5, 6, 7], [], [8]], padding=1)
    assert ids.tolist() == [[5, 6, 7], [1, 1, 1], [8, 1, 1]] and mask.tolist() == [[1, 1, 1], [0, 0, 0], [1, 0, 0]]
    hidden = np.array([[[1.0, 0], [3, 0], [5, 3]], [[9, 9]] * 3, [[0, 2], [7, 7], [7, 7]]])
    assert np.allclose(masked_mean(hidden, mask), [[3 / np.sqrt(10), 1 / np.sqrt(10)], [0, 0], [0, 1]])
    assert pad([]) [0].shape == (0, 0) and embed_texts([""], lambda t: [[] for _ in t], lambda i, m: np.zeros((*i.shape, 4))).tolist() == [[0.0] * 4]


def test_frame(spark):
    """Any batch gives each text the vector that it has alone; null, empty and long texts, repeated rows and clashing names too."""
    texts = [None, "", "a", "b a", "a " * 3000, "b a", "c"]
    tokenize = lambda texts: [["abc".index(w) for w in t.split()] for t in texts]
    forward = lambda ids, mask: np.stack([ids + 1, ids * ids + 1], axis=2).astype(float)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "vec_id long, text string, Embedding string").drop("Embedding").repartition(2)
    got = {r["vec_id"]: r["embedding"] for r in embed(df, tokenize, forward, texts_at_a_time=2).collect()}
    for i, t in enumerate(texts):
        assert np.allclose(got[i], embed_texts([t or ""], tokenize, forward)[0])
    assert embed(df.limit(0), tokenize, forward).count() == 0


def test_vectors_from_seeds(spark):
    for make in (X.seeded_vector, X.gaussian_vector):
        x = np.array([r[0] for r in spark.range(400).select(make(X.F.col("id"), 32)).collect()])
        assert np.allclose((x * x).sum(axis=1), 1) and abs(x.mean()) < 0.01
        again = spark.range(3).select(make(X.F.col("id").cast("string"), 32)).collect()
        assert np.array_equal(np.array([r[0] for r in again]), x[:3]) and abs(x[0] @ x[1]) < 0.9


def field(number, value):
    """A field of a protocol buffer: a number, text, or bytes."""
    def varint(n):
        out = b""
        while True:
            out += bytes([n & 127 | (128 if n > 127 else 0)])
            n >>= 7
            if not n:
                return out

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(raw)) + raw


def onnx_model(table):
    """A model that looks hidden states up by token: Gather(table, input_ids), written byte by byte."""
    def info(name, kind, dims):
        shape = b"".join(field(1, field(2, d) if isinstance(d, str) else field(1, d)) for d in dims)
        return field(1, name) + field(2, field(1, field(1, kind) + field(2, shape)))

    node = field(1, "table") + field(1, "input_ids") + field(2, "last_hidden_state") + field(4, "Gather")
    tensor = b"".join(field(1, d) for d in table.shape) + field(2, 1) + field(8, "table") + field(9, table.astype("<f4").tobytes())
    unused = field(1, "attention_mask") + field(2, "mask_again") + field(4, "Identity")
    inputs = [info("input_ids", 7, ["n", "t"]), info("attention_mask", 7, ["n", "t"])]
    graph = field(1, node) + field(1, unused) + field(2, "g") + field(5, tensor) + b"".join(field(11, i) for i in inputs) + field(12, info("last_hidden_state", 1, ["n", "t", table.shape[1]]))
    return field(1, 8) + field(7, graph) + field(8, field(1, "") + field(2, 13))


TABLE = np.random.default_rng(1).standard_normal((5, 6)).astype(np.float32)


def write_encoder(folder):
    (folder / "model.onnx").write_bytes(onnx_model(TABLE))
    vocabulary = {"[UNK]": 0, "red": 1, "green": 2, "blue": 3, "sky": 4}
    (folder / "tokenizer.json").write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": {"type": "Lowercase"}, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": vocabulary, "unk_token": "[UNK]"}}))
    return folder


def test_onnx_encoder(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    pytest.importorskip("tokenizers")
    table = TABLE
    encoder = OnnxEncoder(str(write_encoder(tmp_path)))
    assert encoder.dim == 6 and encoder.tokenize(["Blue sky", ""]) == [[3, 4], []]
    df = spark.createDataFrame([(1, "Blue sky"), (2, "red green other"), (3, "")], "vec_id long, text string")
    got = {r["vec_id"]: r["embedding"] for r in embed(df, encoder.tokenize, encoder.forward).collect()}
    for i, ids in ((1, [3, 4]), (2, [1, 2, 0])):
        mean = table[ids].mean(axis=0)
        assert np.allclose(got[i], mean / np.linalg.norm(mean), atol=1e-6)
    assert got[3] == [0.0] * 6
    with pytest.raises(FileNotFoundError):
        OnnxEncoder(str(tmp_path / "none")).dim  # noqa: B018


@pytest.mark.parametrize("with_model", [False, True])
def test_command_line(spark, tmp_path, capsys, with_model):
    """A few sentences, indexed and found again by one of them."""
    from vecpack.__main__ import main

    sentences = ["red sky", "green blue", "blue sky red", "other things", None]
    table, index = str(tmp_path / "texts.parquet"), str(tmp_path / "index")
    spark.createDataFrame([(i, t) for i, t in enumerate(sentences)], "doc_id long, text string").where("text IS NOT NULL").write.parquet(table)
    more = []
    if with_model:
        pytest.importorskip("onnxruntime")
        folder = write_encoder(tmp_path)
        more = ["--model-dir", str(folder)]
    assert main(["build", index, table, "--bits", "8", *([] if with_model else ["--dim", "64"]), *more]) == 4
    hits = main(["search", index, "green blue", "-k", "2", *more])
    assert hits[0][0] == 1 and hits[0][1] > 0.9 and len(hits) == 2
    assert "4 texts" in capsys.readouterr().out
