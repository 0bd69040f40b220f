import numpy as np
import pytest

from quiverlake.functions import constants as C
from quiverlake.operators import model as M


def test_chacha_zero_key():
    assert C.chacha8(bytes(32), 8).tobytes().hex() == "3e00ef2f895f40d67f5bb8e81f09a5a12c840ec3ce9a7f3b181be188ef711a1e"


def test_rotation_golden():
    for dim, head in ((8, [4, 3, 6, 7, 5, 2, 1, 0]), (64, [35, 12, 57, 3, 56, 21, 22, 60]), (200, [173, 82, 139, 13, 132, 53, 167, 33]), (1536, [1032, 604, 441, 461, 492, 1230, 633, 368])):
        signs, perm, block = C.rotation(dim)
        assert list(perm[:8]) == head and list(signs[:8]) == [-1, -1, 1, 1, 1, 1, 1, -1]
        assert sorted(perm) == list(range(dim))
    assert [C.rotation(d)[2] for d in (64, 200, 1536)] == [64, 8, 512]


@pytest.mark.parametrize("dim", [8, 200, 256, 768, 1024, 1536])
def test_rotation_keeps_norms(dim):
    x = np.sin(0.1 * np.arange(dim) + 1)[None]
    x /= np.linalg.norm(x)
    assert abs(np.linalg.norm(C.rotate(x)) - 1) < 1e-9


def test_rotation_matrix_agrees():
    x = np.random.default_rng(0).standard_normal((4, 200))
    assert np.allclose(C.rotate(x), x @ C.rotation_matrix(200).T)


@pytest.mark.parametrize("bits", [2, 3, 4])
@pytest.mark.parametrize("dim", [8, 128, 200, 768])
def test_codebook_properties(bits, dim):
    bounds, cents = C.codebook(bits, dim)
    assert len(cents) == 2**bits and len(bounds) == 2**bits - 1 and (np.diff(cents) > 0).all()
    c = cents.astype(np.float32)
    assert (bounds.astype(np.float32) == (c[1:] + c[:-1]) * np.float32(0.5)).all()


def test_codebook_golden():
    for key, half in (((2, 64), [0.0565148703, 0.1874968558]), ((3, 64), [0.0304691791, 0.0938322618, 0.1661678552, 0.2639139294]), ((4, 1536), [0.0032748819, 0.0098974891, 0.0167505182, 0.0240326765, 0.0320347994, 0.0412554070, 0.0527419485, 0.0696287527])):
        assert np.allclose(C.codebook(*key)[1][2 ** key[0] // 2 :], half, atol=2e-8)


def test_landmarks_orthonormal_and_prefix():
    b = C.landmark_basis(128, 96)
    assert np.abs(b.T @ b - np.eye(96)).max() < 1e-5
    assert (C.landmark_basis(128, 40) == b[:, :40]).all()


def test_q4_projection_close():
    m = M.Model(128, 4, 96, seed=1)
    q = np.random.default_rng(3).standard_normal((4, 128))
    a, b = m.prepare(q)[0], m.prepare(q, "q4")[0]
    assert (np.linalg.norm(a - b, axis=1) / np.linalg.norm(a, axis=1) < 0.15).all()


def test_shapes_are_checked():
    for args in ((12,), (64, 5), (64, 4, 65), (64, 4, 0)):
        with pytest.raises(ValueError):
            C.check_shape(*args)


@pytest.mark.parametrize("bits", [2, 3, 4])
def test_pack_round_trip(bits):
    codes = np.random.default_rng(1).integers(0, 2**bits, (5, 48)).astype(np.uint8)
    assert (M.unpack(M.pack(codes, bits), bits) == codes).all()
    planes = M.bit_planes(codes, bits)
    back = sum(np.unpackbits(planes[:, p * 6 : (p + 1) * 6], axis=1).astype(int) << p for p in range(bits))
    assert (back == codes).all()
