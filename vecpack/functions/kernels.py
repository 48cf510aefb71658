"""The codec on matrices of vectors, one row each: what the Arrow operators run on each batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from vecpack.model import LLOYD_MAX, TINY, VectorModel


def pack_bits(codes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of numbers below 2^bits to rows of bytes, lowest bit first, numbers side by side."""
    if bits == 8:
        return codes.astype(np.uint8)
    planes = codes.astype(np.uint8)[:, :, None] >> np.arange(bits, dtype=np.uint8) & 1
    return np.packbits(planes.reshape(len(codes), -1), axis=1, bitorder="little")


def unpack_bits(packed: np.ndarray, bits: int, values: int) -> np.ndarray:
    """The inverse of :func:`pack_bits` for ``values`` numbers a row."""
    if bits == 8:
        return packed[:, :values].astype(np.int64)
    planes = np.unpackbits(packed, axis=1, bitorder="little")[:, : values * bits].reshape(len(packed), values, bits)
    return planes @ (1 << np.arange(bits))


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(directions, norms); a norm that counts as zero has the direction zero."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return np.where((norm > TINY)[:, None], x / np.where(norm > TINY, norm, 1.0)[:, None], 0.0), norm


def half_up(x: np.ndarray) -> np.ndarray:
    """Nearest whole number, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) + 0.5), x)


def lm_codes(y: np.ndarray, model: VectorModel) -> np.ndarray:
    """Number of boundaries below each coordinate; one on a boundary is in the lower cell."""
    return np.searchsorted(model.boundaries, y, side="left")


def polar_codes(y: np.ndarray, model: VectorModel) -> tuple[np.ndarray, np.ndarray]:
    """(angle, radius) codes of neighbouring pairs; an odd last coordinate is paired with zero."""
    if y.shape[1] % 2:
        y = np.pad(y, ((0, 0), (0, 1)))
    a, b = y[:, ::2], y[:, 1::2]
    steps, top = 1 << model.angle_bits, (1 << model.radius_bits) - 1
    angles = half_up((np.arctan2(b, a) + np.pi) / (2 * np.pi) * steps).astype(np.int64) % steps
    return angles, half_up(np.clip(np.sqrt(a * a + b * b), 0, model.max_radius) / model.max_radius * top).astype(np.int64)


def polar_points(angles: np.ndarray, radii: np.ndarray, model: VectorModel) -> np.ndarray:
    theta = angles / (1 << model.angle_bits) * (2 * np.pi) - np.pi
    r = radii / ((1 << model.radius_bits) - 1) * model.max_radius
    return np.stack([r * np.cos(theta), r * np.sin(theta)], axis=2).reshape(len(angles), -1)[:, : model.dim]


@dataclass
class Encoded:
    """Codes of each vector: ``codes`` of the scalar codebook, or ``angles`` and ``radii``; unpacked."""

    codes: np.ndarray | None
    angles: np.ndarray | None
    radii: np.ndarray | None
    signs: np.ndarray
    residual_norm: np.ndarray
    original_norm: np.ndarray

    def approximation(self, model: VectorModel) -> np.ndarray:
        """The rotated direction that the codes stand for."""
        return model.centroids[self.codes] if model.variant == LLOYD_MAX else polar_points(self.angles, self.radii, model)


def encode(x: np.ndarray, model: VectorModel) -> Encoded:
    u, norm = unit(x.astype(np.float64))
    y = u @ model.rotation.T
    codes = angles = radii = None
    if model.variant == LLOYD_MAX:
        codes = lm_codes(y, model)
        near = model.centroids[codes]
    else:
        angles, radii = polar_codes(y, model)
        near = polar_points(angles, radii, model)
    rest = y - near
    signs = (rest @ model.projection.T > 0).astype(np.uint8)
    return Encoded(codes, angles, radii, signs, np.sqrt(np.einsum("ij,ij->i", rest, rest)), norm)


def decode(e: Encoded, model: VectorModel) -> np.ndarray:
    """Norm times the approximation rotated back; the residual's signs don't take part."""
    return e.original_norm[:, None] * (e.approximation(model) @ model.rotation)


def prepare(q: np.ndarray, model: VectorModel) -> tuple[np.ndarray, np.ndarray]:
    """Queries, not normalised, as (rotated, rotated and projected): all that scoring needs of them."""
    rotated = q.astype(np.float64) @ model.rotation.T
    return rotated, rotated @ model.projection.T


def score(e: Encoded, rotated: np.ndarray, projected: np.ndarray, model: VectorModel, use_qjl: bool = True) -> np.ndarray:
    """Estimated inner products, vectors x queries, as one matrix product of [codes | scaled signs]."""
    left, right = e.approximation(model), rotated
    if use_qjl:
        scale = np.where(e.residual_norm > TINY, e.residual_norm * np.sqrt(np.pi / (2 * model.dim)), 0.0)
        left = np.concatenate([left, scale[:, None] * (2.0 * e.signs - 1)], axis=1)
        right = np.concatenate([rotated, projected], axis=1)
    return e.original_norm[:, None] * (left @ right.T)


def naive_round_trip(x: np.ndarray, bits: int, reach: float) -> np.ndarray:
    """Uniform quantization over [-reach, reach] by 2^bits levels, and back to the cells' middles."""
    levels = 1 << bits
    cell = np.clip(np.floor((x + reach) / (2 * reach) * levels), 0, levels - 1)
    return (cell + 0.5) / levels * (2 * reach) - reach
