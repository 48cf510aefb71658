"""Compressed vectors as DataFrames: encode, store, search and measure."""

from vecpack.errors import DimensionMismatch, InvalidVector, ModelMismatch, NotFound, StorageError, VectorError
from vecpack.model import VectorModel
from vecpack.operators.codec import decode, encode, inspect, reconstruct
from vecpack.operators.embed import OnnxEncoder, embed, embed_texts
from vecpack.operators.search import exact_topk, topk, topk_join
from vecpack.sources.index import VectorIndex

__all__ = [
    "DimensionMismatch", "InvalidVector", "ModelMismatch", "NotFound", "StorageError", "VectorError", "VectorIndex", "VectorModel",
    "OnnxEncoder", "decode", "embed", "embed_texts", "encode", "exact_topk", "inspect", "reconstruct", "topk", "topk_join",
]
