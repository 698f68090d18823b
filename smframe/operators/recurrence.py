"""Linear recurrences over the last axis of arrays, a block at a time: filters, oscillators and smoothing without a loop over samples."""

from __future__ import annotations

import numpy as np

BLOCK = 64


def one_pole(c: np.ndarray, pole: complex, block: int = BLOCK) -> np.ndarray:
    """z with z[k] = pole * z[k - 1] + c[k], from rest.

    Within a block one product with a triangular matrix gives all samples; blocks hand on one number for each row.
    """
    c = np.asarray(c)
    n = c.shape[-1]
    if not np.isfinite(c).all():  # what isn't finite must spoil what follows it only
        z, last = np.empty(c.shape, np.result_type(c, pole)), 0.0
        for k in range(n):
            z[..., k] = last = pole * last + c[..., k]
        return z
    blocks = -(-n // block)
    padded = np.zeros((*c.shape[:-1], blocks * block), np.result_type(c, pole, float))
    padded[..., :n] = c
    k = np.arange(block)
    lag = k[None, :] - k[:, None]
    inner = padded.reshape(*c.shape[:-1], blocks, block) @ np.where(lag >= 0, np.power(pole, np.maximum(lag, 0)), 0)
    far, carry, at = pole**block, np.zeros(inner.shape[:-1], inner.dtype), np.zeros(c.shape[:-1], inner.dtype)
    for b in range(blocks):
        carry[..., b] = at
        at = inner[..., b, -1] + far * at
    return (inner + carry[..., None] * np.power(pole, k + 1)).reshape(padded.shape)[..., :n]


def two_states(a: np.ndarray, f: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both states of s[k] = a s[k - 1] + f[k] from rest, for a 2 x 2 matrix with a conjugate pair of eigenvalues."""
    values, v = np.linalg.eig(a)
    w = np.linalg.inv(v)
    z = one_pole(w[0, 0] * f[0] + w[0, 1] * f[1], values[0])
    return 2 * (v[0, 0] * z).real, 2 * (v[1, 0] * z).real


def second_order(x: np.ndarray, numerator: np.ndarray, denominator: np.ndarray) -> np.ndarray:
    """A filter section b(z) / a(z) of order two at most with a[0] = 1, from rest."""
    b, a = np.pad(numerator, (0, 3 - len(numerator))), np.pad(denominator, (0, 3 - len(denominator)))
    v = b[0] * x
    v[..., 1:] += b[1] * x[..., :-1]
    v[..., 2:] += b[2] * x[..., :-2]
    p = np.roots(a)
    p = np.pad(p, (0, 2 - len(p)))
    if abs(p[0].imag) > 0:
        return (p[0] * one_pole(v, p[0])).imag / p[0].imag
    return one_pole(one_pole(v, float(p[0].real)), float(p[1].real))
