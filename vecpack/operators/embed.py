"""Texts to vectors by an encoder that the caller brings: tokens, hidden states, masked mean, unit length."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vecpack.operators.arrow import vectors

Tokenize = Callable[[Sequence[str]], list[list[int]]]
Forward = Callable[[np.ndarray, np.ndarray], np.ndarray]


def pad(ids: list[list[int]], padding: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(ids, mask) as matrices of 64-bit numbers, as wide as the longest text's tokens; the mask is 1 at tokens."""
    width = max(map(len, ids), default=0)
    mask = (np.arange(width) < np.array([len(x) for x in ids], np.int64).reshape(-1, 1)).astype(np.int64)
    out = np.full(mask.shape, padding, np.int64)
    out[mask.astype(bool)] = np.concatenate([np.asarray(x, np.int64) for x in ids]) if width else 0
    return out, mask


def masked_mean(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors of the mean hidden state (texts x tokens x dimensions) over each text's tokens; zero for no tokens."""
    weight = mask.astype(np.float64)
    pooled = np.einsum("ntd,nt->nd", hidden.astype(np.float64), weight) / np.maximum(weight.sum(axis=1), 1)[:, None]
    norm = np.sqrt(np.einsum("ij,ij->i", pooled, pooled))[:, None]
    return np.divide(pooled, norm, out=np.zeros_like(pooled), where=norm > 0)


def embed_texts(texts: Sequence[str], tokenize: Tokenize, forward: Forward, padding: int = 0) -> np.ndarray:
    """A row for each text: tokenised together, padded, encoded, pooled."""
    ids, mask = pad(tokenize(texts), padding)
    return masked_mean(forward(ids, mask), mask)


def embed(df: DataFrame, tokenize: Tokenize, forward: Forward, text: str = "text", into: str = "embedding", texts_at_a_time: int = 32, padding: int = 0) -> DataFrame:
    """``df`` without ``text``, with the vector of each text.

    ``tokenize(texts)`` gives each text's token ids, ``forward(ids, mask)`` the hidden states (texts x tokens x
    dimensions); both are sent to the executors and may load their model there when they are first called.
    Null texts have no tokens. Texts of like lengths are padded together: a batch is taken in order of length, so
    that a long text doesn't widen the short ones. No shuffle.
    """
    kept = [f for f in df.schema.fields if f.name not in (text, into)]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            parts = [embed_texts([texts[i] for i in order[k : k + texts_at_a_time]], tokenize, forward, padding) for k in range(0, len(order), texts_at_a_time)]
            if not parts:
                continue
            made = np.empty((len(texts), parts[0].shape[1]))
            made[order] = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), vectors(made, pa.float64())], names=[*names, into])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(into, T.ArrayType(T.DoubleType()))]))


@lru_cache(4)
def _session(folder: str):
    import onnxruntime

    models = sorted(Path(folder).glob("*.onnx"))
    if not models:
        raise FileNotFoundError(f"no .onnx file in {folder}")
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = 1  # tasks are the parallelism
    return onnxruntime.InferenceSession(str(models[0]), options, providers=["CPUExecutionProvider"])


@lru_cache(4)
def _tokenizer(folder: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(f"{folder}/tokenizer.json")
    made.no_padding()
    return made


@dataclass(frozen=True)
class OnnxEncoder:
    """``tokenize`` and ``forward`` of a folder with an ONNX model and a ``tokenizer.json``; both are loaded once a process.

    The first ``*.onnx`` file by name counts. ``dim`` is the width of the model's last hidden state, or
    ``default_dim`` where the model leaves it open. The folder must be there on every executor.
    """

    folder: str
    default_dim: int = 384

    @property
    def dim(self) -> int:
        size = _session(self.folder).get_outputs()[0].shape[-1]
        return size if isinstance(size, int) else self.default_dim

    def tokenize(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in _tokenizer(self.folder).encode_batch(list(texts))]

    def forward(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        session = _session(self.folder)
        given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        wanted = {i.name for i in session.get_inputs()}
        outputs = [o.name for o in session.get_outputs()]
        name = "last_hidden_state" if "last_hidden_state" in outputs else outputs[0]
        return session.run([name], {k: v for k, v in given.items() if k in wanted})[0]
