import numpy as np
import pytest

from vecpack.errors import ModelMismatch, StorageError
from vecpack.functions import kernels
from vecpack.model import VectorModel, codebook, random_rotation, sign_projection


def gauss(n, d, seed):
    x = np.random.default_rng(seed).standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_rotation_is_orthogonal_and_seeded():
    q = random_rotation(16, 42)
    assert np.abs(q.T @ q - np.eye(16)).max() < 1e-12
    assert (q == random_rotation(16, 42)).all()
    assert (q != random_rotation(16, 43)).any()
    x = np.arange(32) / 32
    r = random_rotation(32, 42)
    assert np.allclose(r.T @ (r @ x), x)
    assert np.isclose(np.linalg.norm(random_rotation(64, 1)[:, 0]), 1)


def test_projection_estimates_inner_products():
    s = sign_projection(128, 42)
    assert (s == sign_projection(128, 42)).all()
    a, b = np.eye(128)[0], np.zeros(128)
    b[:2] = 0.8, 0.6
    assert abs((s @ a) @ (s @ b) - 0.8) < 0.5


@pytest.mark.parametrize(("bits", "table"), [(1, [0.79788]), (2, [0.4528, 1.510]), (3, [0.2451, 0.7560, 1.344, 2.152])])
def test_codebook_is_the_gaussian_one(bits, table):
    c, b, rounds = codebook(384, bits)
    c = np.array(c) * np.sqrt(384)
    assert np.allclose(c[len(c) // 2 :], table, atol=1e-3)
    assert np.allclose(c, -c[::-1], atol=1e-9)
    assert (np.diff(c) > 0).all() and len(b) == len(c) - 1
    assert rounds in {1: (2,), 2: (30, 31, 32), 3: (100,)}[bits]


def test_codebook_stops_after_a_hundred_rounds():
    c, _, rounds = codebook(64, 4)
    assert rounds == 100
    assert abs(c[-1] * 8 - 2.7617) < 1e-3


@pytest.mark.parametrize("bits", [0, 9])
def test_bits_out_of_range(bits):
    with pytest.raises(ValueError):
        VectorModel.lloyd_max(8, bits)
    with pytest.raises(ValueError):
        VectorModel.polar(8, bits, 8)
    with pytest.raises(ValueError):
        VectorModel.polar(8, 4, bits)


def test_sizes():
    assert [VectorModel.lloyd_max(384, b).code_bytes for b in (1, 2, 3, 4, 8)] == [48, 96, 144, 192, 384]
    assert [VectorModel.lloyd_max(384, b).bytes_per_vector for b in (1, 2, 3, 4, 6, 8)] == [104, 152, 200, 248, 344, 440]
    assert [VectorModel.lloyd_max(64, b).bytes_per_vector for b in (1, 2, 3, 4, 6, 8)] == [24, 32, 40, 48, 64, 80]
    assert VectorModel.lloyd_max(384, 4).compression_ratio > 6
    assert [VectorModel.polar(384, a, r).bytes_per_vector for a, r in ((4, 8), (2, 2), (3, 6))] == [344, 440, 440]
    p = VectorModel.polar(384)
    assert (p.code_bytes, p.code_bytes - p.pairs, p.sign_bytes) == (288, 96, 48) and p.compression_ratio > 4
    assert VectorModel.lloyd_max(7, 3).bytes_per_vector == 8 + 3 + 1


def test_model_row_round_trip(spark):
    m = VectorModel.lloyd_max(8, 3, rotation_seed=2**63 + 5)
    row = m.to_df(spark).first()
    back = VectorModel.from_row(row)
    assert back.fingerprint == m.fingerprint and back.rotation_seed == 2**63 + 5
    assert VectorModel.lloyd_max(8, 3, rotation_seed=1).fingerprint != m.fingerprint
    with pytest.raises(ModelMismatch):
        VectorModel.from_row({**row.asDict(), "fingerprint": "0"})
    with pytest.raises(StorageError):
        VectorModel.from_row({**row.asDict(), "format_version": 9})


@pytest.mark.parametrize(("model", "cos", "scaled_mse"), [
    (VectorModel.lloyd_max(384, 1), 0.799, 0.3616), (VectorModel.lloyd_max(384, 2), 0.940, 0.1164), (VectorModel.lloyd_max(384, 3), 0.983, 0.0344), (VectorModel.lloyd_max(384, 4), 0.995, 0.0094),
    (VectorModel.lloyd_max(384, 6), 0.9993, 0.0015), (VectorModel.polar(384, 2, 2), 0.867, 0.2799), (VectorModel.polar(384, 3, 4), 0.973, 0.0538), (VectorModel.polar(384, 4, 8), 0.994, 0.0128),
], ids=lambda x: getattr(x, "label", ""))
def test_distortion_by_width(model, cos, scaled_mse):
    x = gauss(200, 384, 123)
    y = kernels.decode(kernels.encode(x, model), model)
    assert abs(((x * y).sum(1) / np.linalg.norm(y, axis=1)).mean() - cos) < 0.005
    assert abs(((x - y) ** 2).sum(1).mean() - scaled_mse) < 0.06 * scaled_mse + 1e-4


def test_signs_make_estimates_unbiased():
    """The slope tells a right correction from none and from a wrong one, which the mean error can't."""
    x, q = gauss(200, 384, 1), gauss(200, 384, 2)
    truth = x @ q.T
    m = VectorModel.lloyd_max(384, 1)
    e = kernels.encode(x, m)
    rotated, projected = kernels.prepare(q, m)

    def slope(s):
        return (s * truth).sum() / (truth * truth).sum()

    assert abs(slope(kernels.score(e, rotated, projected, m)) - 1) < 0.02
    assert slope(kernels.score(e, rotated, projected, m, use_qjl=False)) < 0.7
    assert slope(kernels.score(e, rotated, -projected, m)) < 0.4


@pytest.mark.parametrize("model", [VectorModel.lloyd_max(32, 3), VectorModel.polar(32), VectorModel.polar(7), VectorModel.lloyd_max(63, 5)], ids=lambda m: f"{m.label} {m.dim}")
def test_score_without_signs_is_the_decoded_inner_product(model):
    x, q = gauss(20, model.dim, 3) * np.arange(1, 21)[:, None], gauss(5, model.dim, 4)
    e = kernels.encode(x, model)
    assert np.allclose(kernels.score(e, *kernels.prepare(q, model), model, use_qjl=False), kernels.decode(e, model) @ q.T)
    assert kernels.encode(x, model).approximation(model).shape == (20, model.dim)


def test_boundaries_belong_to_the_lower_cell():
    m = VectorModel.lloyd_max(16, 2)
    assert kernels.lm_codes(np.array([m.boundaries]), m).tolist() == [[0, 1, 2]]


def test_halves_round_away_from_zero():
    assert kernels.half_up(np.array([0.5, 1.5, 2.5, -2.5, 2.4])).tolist() == [1, 2, 3, -3, 2]


@pytest.mark.parametrize(("norm", "zero"), [(0.0, True), (1e-11, True), (1e-9, False)])
def test_zero_norms(norm, zero):
    m = VectorModel.lloyd_max(16, 4)
    e = kernels.encode(np.eye(16)[:1] * norm, m)
    u, n = kernels.unit(np.eye(16)[:1] * norm)
    assert (not u.any()) == zero and n[0] == norm
    assert abs(kernels.score(e, *kernels.prepare(np.eye(16)[:1], m), m)[0, 0]) <= 2 * norm


def test_similar_vectors_score_higher():
    x = np.zeros((3, 64))
    x[0, 0] = x[2, 1] = 1
    x[1, :2] = np.array([0.9, 0.1]) / np.hypot(0.9, 0.1)
    for m in (VectorModel.lloyd_max(64, rotation_seed=55, qjl_seed=77), VectorModel.polar(64, rotation_seed=55, qjl_seed=77)):
        s = kernels.score(kernels.encode(x, m), *kernels.prepare(x[:1], m), m)[:, 0]
        assert s[1] > s[2] and s[0] > 0.7


def test_naive_baseline():
    x = gauss(300, 384, 42)
    reach = 4 / np.sqrt(384)
    for bits, cos in ((2, 0.868), (3, 0.961), (4, 0.990), (6, 0.9994)):
        y = kernels.naive_round_trip(x, bits, reach)
        assert abs(((x * y).sum(1) / np.linalg.norm(y, axis=1)).mean() - cos) < 0.005


def test_calibration_free_codes_beat_a_miscalibrated_baseline():
    x, q = gauss(200, 384, 77), gauss(30, 384, 78)
    truth = np.argsort(-(q @ x.T), axis=1)[:, :10]

    def recall(scores):
        return np.mean([len({*a} & {*b}) / 10 for a, b in zip(np.argsort(-scores, axis=1)[:, :10].tolist(), truth.tolist(), strict=True)])

    m = VectorModel.polar(384)
    ours = recall(kernels.score(kernels.encode(x, m), *kernels.prepare(q, m), m).T)
    wrong, right = (recall(q @ kernels.naive_round_trip(x, 4, r).T) for r in (1.0, 4 / np.sqrt(384)))
    assert ours > 0.6 and ours > wrong and wrong < right
    assert ours >= 0.8 * recall(q @ kernels.naive_round_trip(x, 8, 4 / np.sqrt(384)).T)
