"""The codec's parameters: rotation, codebook and sign projection, all made on the driver from two seeds."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

LLOYD_MAX, POLAR = "lloyd_max", "polar"
#: Norms up to this count as zero.
TINY = 1e-10
# Fixed values of the codebook's iteration: half-width in standard deviations, intervals of the trapezoid
# rule in each cell, most rounds, largest change at which it stops, least mass of a cell that moves.
SPAN, INTERVALS, ROUNDS, TOLERANCE, LEAST_MASS = 5.0, 200, 100, 1e-8, 1e-15
#: Seeds go with one of these, so that a model never repeats the numbers of data, or of its other matrix, of the same seed.
_ROTATION, _PROJECTION = 1, 2

MODEL_SCHEMA = T.StructType([
    T.StructField("dim", T.IntegerType()), T.StructField("variant", T.StringType()), T.StructField("bits", T.IntegerType()),
    T.StructField("angle_bits", T.IntegerType()), T.StructField("radius_bits", T.IntegerType()),
    T.StructField("rotation_seed", T.StringType()), T.StructField("qjl_seed", T.StringType()),
    T.StructField("rotation", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("projection", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("centroids", T.ArrayType(T.DoubleType())), T.StructField("boundaries", T.ArrayType(T.DoubleType())),
    T.StructField("max_radius", T.DoubleType()), T.StructField("fingerprint", T.StringType()), T.StructField("format_version", T.IntegerType()),
])
FORMAT_VERSION = 1


def random_rotation(dim: int, seed: int) -> np.ndarray:
    """An orthogonal matrix: the Q of a seeded Gaussian matrix's QR decomposition with a positive R diagonal.

    That is what orthonormalising its columns in turn gives, without that process's rounding.
    """
    q, r = np.linalg.qr(np.random.default_rng([_ROTATION, seed]).standard_normal((dim, dim)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def sign_projection(dim: int, seed: int) -> np.ndarray:
    """A seeded matrix of independent N(0, 1/dim)."""
    return np.random.default_rng([_PROJECTION, seed]).standard_normal((dim, dim)) / np.sqrt(dim)


def gaussian_density(x: np.ndarray, sigma: float) -> np.ndarray:
    return np.exp(-(x * x) / (2 * sigma * sigma)) / (sigma * np.sqrt(2 * np.pi))


def cell_means(edges: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """(mass, first moment) of N(0, sigma^2) between neighbouring edges, by the trapezoid rule."""
    low, high = edges[:-1, None], edges[1:, None]
    x = low + (high - low) * (np.arange(INTERVALS + 1) / INTERVALS)
    weight = np.full(INTERVALS + 1, 1.0)
    weight[[0, -1]] = 0.5
    p = gaussian_density(x, sigma) * weight * ((high - low) / INTERVALS)
    return p.sum(axis=1), (p * x).sum(axis=1)


@lru_cache(64)
def codebook(dim: int, bits: int) -> tuple[tuple[float, ...], tuple[float, ...], int]:
    """(centroids, boundaries, rounds): the scalar quantizer of N(0, 1/dim) that its fixed-point iteration reaches.

    Centroids start evenly spaced over +-5 sigma, where the outermost cells also end.
    """
    sigma, levels = 1 / np.sqrt(dim), 1 << bits
    reach = SPAN * sigma
    c = -reach + 2 * reach * (np.arange(levels) + 0.5) / levels
    rounds = 0
    for rounds in range(1, ROUNDS + 1):
        edges = np.concatenate([[-reach], (c[:-1] + c[1:]) / 2, [reach]])
        mass, moment = cell_means(edges, sigma)
        new = np.where(mass > LEAST_MASS, moment / np.maximum(mass, LEAST_MASS), c)
        change = np.abs(new - c).max()
        c = new
        if change < TOLERANCE:
            break
    c = np.sort(c)
    return tuple(map(float, c)), tuple(map(float, (c[:-1] + c[1:]) / 2)), rounds


def packed_bytes(values: int, bits: int) -> int:
    return -(-values * bits // 8)


@dataclass(frozen=True, eq=False)
class VectorModel:
    """A codec for vectors of ``dim`` components; equal fingerprints mean equal codes and scores."""

    dim: int
    variant: str
    bits: int
    angle_bits: int
    radius_bits: int
    rotation_seed: int
    qjl_seed: int
    rotation: np.ndarray = field(repr=False)
    projection: np.ndarray = field(repr=False)
    centroids: np.ndarray = field(repr=False)
    boundaries: np.ndarray = field(repr=False)
    max_radius: float

    @staticmethod
    def lloyd_max(dim: int, bits: int = 4, rotation_seed: int = 42, qjl_seed: int = 99) -> VectorModel:
        if not 1 <= bits <= 8:
            raise ValueError(f"bits must be 1 to 8, not {bits}")
        if dim < 1:
            raise ValueError(f"dim must be positive, not {dim}")
        c, b, _ = codebook(dim, bits)
        return VectorModel(dim, LLOYD_MAX, bits, 0, 0, rotation_seed, qjl_seed, random_rotation(dim, rotation_seed), sign_projection(dim, qjl_seed), np.array(c), np.array(b), 0.0)

    @staticmethod
    def polar(dim: int, angle_bits: int = 4, radius_bits: int = 8, rotation_seed: int = 42, qjl_seed: int = 99) -> VectorModel:
        if not (1 <= angle_bits <= 8 and 1 <= radius_bits <= 8):
            raise ValueError(f"angle and radius bits must be 1 to 8, not {angle_bits} and {radius_bits}")
        if dim < 1:
            raise ValueError(f"dim must be positive, not {dim}")
        none = np.zeros(0)
        return VectorModel(dim, POLAR, 0, angle_bits, radius_bits, rotation_seed, qjl_seed, random_rotation(dim, rotation_seed), sign_projection(dim, qjl_seed), none, none, 4 / float(np.sqrt(dim)))

    @property
    def pairs(self) -> int:
        return -(-self.dim // 2)

    @property
    def label(self) -> str:
        return f"LM {self.bits}" if self.variant == LLOYD_MAX else f"PQ {self.angle_bits}a/{self.radius_bits}r"

    @property
    def code_bytes(self) -> int:
        """Bytes of the codes alone; angles of other than 4 bits and radii take a byte each."""
        if self.variant == LLOYD_MAX:
            return packed_bytes(self.dim, self.bits)
        return (packed_bytes(self.pairs, 4) if self.angle_bits == 4 else self.pairs) + self.pairs

    @property
    def sign_bytes(self) -> int:
        return packed_bytes(self.dim, 1)

    @property
    def bytes_per_vector(self) -> int:
        """Codes, signs and two 4-byte norms."""
        return self.code_bytes + self.sign_bytes + 8

    @property
    def bits_per_dim(self) -> float:
        return 8 * self.bytes_per_vector / self.dim

    @property
    def compression_ratio(self) -> float:
        return 4 * self.dim / self.bytes_per_vector

    @property
    def fingerprint(self) -> str:
        h = hashlib.sha256(f"{self.dim}:{self.variant}:{self.bits}:{self.angle_bits}:{self.radius_bits}".encode())
        for a in (self.rotation, self.projection, self.centroids, np.array([self.max_radius])):
            h.update(np.ascontiguousarray(a, "<f8").tobytes())
        return h.hexdigest()

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row with everything, so that nothing ever depends on a generator's sequence again."""
        row = (
            self.dim, self.variant, self.bits, self.angle_bits, self.radius_bits, str(self.rotation_seed), str(self.qjl_seed), self.rotation.tolist(), self.projection.tolist(),
            self.centroids.tolist(), self.boundaries.tolist(), float(self.max_radius), self.fingerprint, FORMAT_VERSION,
        )
        return spark.createDataFrame([row], MODEL_SCHEMA)

    @staticmethod
    def from_row(row: Row) -> VectorModel:
        from vecpack.errors import ModelMismatch, StorageError

        if row["format_version"] != FORMAT_VERSION:
            raise StorageError(f"model format {row['format_version']}, not {FORMAT_VERSION}")
        model = VectorModel(
            row["dim"], row["variant"], row["bits"], row["angle_bits"], row["radius_bits"], int(row["rotation_seed"]), int(row["qjl_seed"]), np.array(row["rotation"]), np.array(row["projection"]),
            np.array(row["centroids"]), np.array(row["boundaries"]), row["max_radius"],
        )
        if model.fingerprint != row["fingerprint"]:
            raise ModelMismatch("the stored model isn't the one that was written")
        return model
