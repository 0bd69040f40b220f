"""Constants of the vector model: functions of dimension, bits and seed alone, computed on the driver and memoised."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

MAX_DIM = 16384
TINY_NORM = 1e-10
#: Key of the rotation's random numbers (a fixed value).
ROTATION_KEY = bytes([164, 143, 161, 123, 88, 50, 61, 10, 234, 184, 161, 204, 105, 1, 20, 184, 43, 140, 200, 117, 24, 180, 247, 84, 141, 68, 110, 161, 228, 223, 32, 242])


def check_shape(dim: int, bits: int = 4, landmarks: int | None = None) -> None:
    if dim % 8 or not 8 <= dim <= MAX_DIM:
        raise ValueError(f"dim must be a multiple of 8 from 8 to {MAX_DIM}, not {dim}")
    if bits not in (2, 3, 4):
        raise ValueError(f"bits must be 2, 3 or 4, not {bits}")
    if landmarks is not None and not 1 <= landmarks <= dim:
        raise ValueError(f"landmarks must be from 1 to {dim}, not {landmarks}")


def chacha8(key: bytes, n: int) -> np.ndarray:
    """First n 32-bit words of the ChaCha keystream with 8 rounds and a 64-bit block counter; all blocks at once."""
    blocks = -(-n // 16)
    s = np.zeros((16, blocks), np.uint32)
    s[:4] = np.frombuffer(b"expand 32-byte k", "<u4")[:, None]
    s[4:12] = np.frombuffer(key, "<u4")[:, None]
    count = np.arange(blocks, dtype=np.uint64)
    s[12], s[13] = count & np.uint64(0xFFFFFFFF), count >> np.uint64(32)
    w = s.reshape(4, 4, blocks).copy()
    for half in range(8):
        if half % 2:  # odd rounds work on diagonals
            w = np.stack([np.roll(w[r], -r, axis=0) for r in range(4)])
        for x, y, z, turn in ((0, 1, 3, 16), (2, 3, 1, 12), (0, 1, 3, 8), (2, 3, 1, 7)):
            w[x] += w[y]
            w[z] ^= w[x]
            w[z] = w[z] << np.uint32(turn) | w[z] >> np.uint32(32 - turn)
        if half % 2:
            w = np.stack([np.roll(w[r], r, axis=0) for r in range(4)])
    return (w.reshape(16, blocks) + s).T.ravel()[:n]


@lru_cache(maxsize=32)
def rotation(dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(signs, permutation, block): signs first, then a shuffle from the top; the block is the largest power of two in dim."""
    check_shape(dim)
    stream = chacha8(ROTATION_KEY, dim + 2 * dim)
    signs = 1.0 - 2.0 * (stream[:dim] & 1)
    perm = list(range(dim))
    draws = stream[dim:].astype(object)
    for k, i in enumerate(range(dim - 1, 0, -1)):
        j = int(draws[2 * k] | draws[2 * k + 1] << 32) % (i + 1)
        perm[i], perm[j] = perm[j], perm[i]
    return signs, np.array(perm), dim & -dim


@lru_cache(maxsize=8)
def rotation_matrix(dim: int) -> np.ndarray:
    """The rotation as one dense matrix: rotated = matrix @ vector."""
    signs, perm, block = rotation(dim)
    out = np.zeros((dim, dim))
    i = np.arange(block)
    h = np.where(np.array([[bin(a & b).count("1") & 1 for b in i] for a in i]) == 1, -1.0, 1.0) / math.sqrt(block)
    for lo in range(0, dim, block):
        out[lo : lo + block, perm[lo : lo + block]] = h * signs[lo : lo + block]
    return out


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows of x, rotated: signed gather, then the block Walsh-Hadamard transform by butterflies."""
    n, dim = x.shape
    signs, perm, block = rotation(dim)
    y = (x[:, perm] * signs).reshape(n, dim // block, block)
    width = 1
    while width < block:
        y = y.reshape(n, -1, block // (2 * width), 2, width)
        y = np.stack([y[:, :, :, 0] + y[:, :, :, 1], y[:, :, :, 0] - y[:, :, :, 1]], axis=3).reshape(n, dim // block, block)
        width *= 2
    return y.reshape(n, dim) / math.sqrt(block)


@lru_cache(maxsize=64)
def codebook(bits: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(boundaries, centroids) of the Lloyd-Max quantiser for a coordinate of a random unit vector, as float32 values.

    The density is C (1 - x^2)^(a - 1) with a = (dim - 1) / 2. First moments have a closed form; masses are taken by
    Gauss-Legendre on what lies within 14 standard deviations. At most 200 passes, from an even grid on three sigma.
    """
    check_shape(dim, bits)
    a = (dim - 1) / 2
    log_c = math.lgamma(2 * a) - 2 * math.lgamma(a) - (2 * a - 1) * math.log(2)
    sigma = math.sqrt(1 / (2 * dim))
    levels = np.linspace(-3 * sigma, 3 * sigma, 2**bits)
    nodes, weights = np.polynomial.legendre.leggauss(96)
    far = min(1.0, 14 / math.sqrt(dim))

    def tail(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(np.abs(x) >= 1, 0.0, np.exp(log_c + a * np.log1p(-np.minimum(x * x, 1.0))) / (2 * a))

    for _ in range(200):
        edges = np.r_[-1.0, (levels[1:] + levels[:-1]) / 2, 1.0]
        lo, hi = np.maximum(edges[:-1], -far), np.minimum(edges[1:], far)
        x = (lo + hi)[:, None] / 2 + (hi - lo)[:, None] / 2 * nodes
        mass = (np.exp(log_c + (a - 1) * np.log1p(-x * x)) * weights).sum(1) * (hi - lo) / 2
        new = np.where(mass < 1e-15, levels, (tail(edges[:-1]) - tail(edges[1:])) / np.maximum(mass, 1e-300))
        moved = np.abs(new - levels).max()
        levels = new
        if moved < 1e-12:
            break
    cents = levels.astype(np.float32)
    return ((cents[1:] + cents[:-1]) * np.float32(0.5)).astype(float), cents.astype(float)


@lru_cache(maxsize=16)
def landmark_basis(dim: int, m: int, seed: int = 0) -> np.ndarray:
    """dim x m orthonormal columns of seeded normal numbers; the first columns of a wider basis are those of a narrower one."""
    check_shape(dim, 4, m)
    rng = np.random.Generator(np.random.Philox(seed))
    q, r = np.linalg.qr(np.stack([rng.standard_normal(dim) for _ in range(m)], axis=1))
    return (q * np.where(np.diag(r) < 0, -1.0, 1.0)).astype(np.float32).astype(float)


@lru_cache(maxsize=16)
def basis_q4(dim: int, m: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(codes from -7 to 7, column scales) of the basis; halves round away from zero."""
    basis = landmark_basis(dim, m, seed)
    scale = np.abs(basis).max(axis=0) / 7
    ratio = basis / np.where(scale > 0, scale, 1)
    return np.clip(np.sign(ratio) * np.floor(np.abs(ratio) + 0.5), -7, 7), scale


def scan_dim(m: int) -> int:
    return -(-m // 8) * 8


def beta_cdf(a: float, t: float) -> float:
    """Regularised incomplete beta function with equal parameters."""
    if t <= 0 or t >= 1:
        return float(t >= 1)
    nodes, weights = np.polynomial.legendre.leggauss(400)
    log_c = math.lgamma(2 * a) - 2 * math.lgamma(a) - (2 * a - 1) * math.log(2)
    x, far = 2 * t - 1, min(1.0, 14 / math.sqrt(2 * a + 1))
    hi = min(abs(x), far)
    at = hi / 2 + hi / 2 * nodes
    half = float((np.exp(log_c + (a - 1) * np.log1p(-at * at)) * weights).sum() * hi / 2)
    return 0.5 + math.copysign(min(half, 0.5), x)
