"""Numerical kernels that have no relational form, on the matrix of one segment (loci x times). NumPy alone; run inside grouped maps."""

from __future__ import annotations

import numpy as np


def shrink(y: np.ndarray, tau: float) -> np.ndarray:
    return np.sign(y) * np.maximum(np.abs(y) - tau, 0.0)


def shrink_singular(y: np.ndarray, tau: float) -> tuple[np.ndarray, float]:
    """Singular values less tau, not under 0, and their sum: from the eigenvectors of the small square, not of the long side."""
    values, vectors = np.linalg.eigh(y @ y.T)
    s = np.sqrt(np.maximum(values, 0.0))
    kept = np.maximum(s - tau, 0.0)
    weight = np.divide(kept, s, out=np.zeros_like(s), where=s > 0)
    return (vectors * weight) @ (vectors.T @ y), float(kept.sum())


class _Recurrence:
    """x[k] = g[k] + m[k] x[k-1] along the first axis, for fixed m: blocks side by side, then their starts one after the other."""

    def __init__(self, m: np.ndarray):
        self.n, width = m.shape
        self.block = max(int(np.sqrt(self.n)), 1)
        self.blocks = -(-self.n // self.block)
        self.m = np.zeros((self.blocks * self.block, width))
        self.m[: self.n] = m
        self.m = self.m.reshape(self.blocks, self.block, width)
        self.reach = np.cumprod(self.m, axis=1)

    def __call__(self, g: np.ndarray) -> np.ndarray:
        x = np.zeros((self.blocks * self.block, g.shape[1]))
        x[: self.n] = g
        x = x.reshape(self.blocks, self.block, g.shape[1])
        for j in range(1, self.block):
            x[:, j] += self.m[:, j] * x[:, j - 1]
        for b in range(1, self.blocks):
            x[b] += self.reach[b] * x[b - 1, -1]
        return x.reshape(-1, g.shape[1])[: self.n]


class Tridiagonal:
    """Symmetric tridiagonal systems with one off-diagonal value, one a row, factored once and solved for many right sides."""

    def __init__(self, diagonal: np.ndarray, off: float, least: float = 1e-12):
        d = np.ascontiguousarray(diagonal.T)
        self.pivot, ratio = np.empty_like(d), np.zeros_like(d)
        for k in range(len(d)):
            p = d[k] - (off * ratio[k - 1] if k else 0.0)
            self.pivot[k] = np.where(np.abs(p) < least, least, p)
            ratio[k] = off / self.pivot[k]
        down = -off / self.pivot
        down[0] = 0.0
        self.down, self.up = _Recurrence(down), _Recurrence(-ratio[::-1])

    def solve(self, right: np.ndarray) -> np.ndarray:
        x = self.down(right.T / self.pivot)
        return self.up(x[::-1])[::-1].T


def masked_rpca(x: np.ndarray, m: np.ndarray, lam: float = 1e-2, mu: float = 1.0, rho: float = 5.0, gamma: float = 0.0, max_iter: int = 200, tol: float = 1e-4):
    """Smooth low-rank part S and sparse part A of x on the mask: least ||S||_* + lam ||A||_1 + gamma/2 ||dS/dt||^2 with S + A = x there.

    Alternating directions with a copy Z of S for the rank and scaled multipliers. Returns S, A and diagnostics."""
    if min(lam, mu, rho) <= 0 or gamma < 0:
        raise ValueError("lam, mu and rho must be over 0, gamma not under 0")
    m = m & np.isfinite(x)
    x = np.where(np.isfinite(x), x, 0.0)
    w = m.astype(float)
    s, a, z, y, u = (np.zeros_like(x) for _ in range(5))
    smooth = gamma > 0 and x.shape[1] > 1
    if smooth:
        ends = np.full(x.shape[1], 2.0)
        ends[[0, -1]] = 1.0
        system = Tridiagonal(rho + mu * w + gamma * ends, -gamma)
    norm, done, worst, k = np.linalg.norm(x[m]), False, np.inf, 0
    for k in range(1, max_iter + 1):
        a = np.where(m, shrink(x - s + y, lam / mu), 0.0)
        z, nuclear = shrink_singular(s + u, 1.0 / rho)
        right = rho * (z - u) + mu * w * (x - a + y)
        s = system.solve(right) if smooth else right / (rho + mu * w)
        left = np.where(m, x - s - a, 0.0)
        apart = s - z
        y, u = y + left, u + apart
        worst = max(np.linalg.norm(left) / (norm + 1e-12), np.linalg.norm(apart) / (np.linalg.norm(s) + 1e-12))
        if worst < tol:
            done = True
            break
    return s, a, {"iterations": k, "converged": done, "residual": float(worst), "nuclear_norm": nuclear if k else 0.0}


def true_runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of runs of True, end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def welch(y: np.ndarray, fs: float, nperseg: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """One-sided power density: periodic Hann windows, half overlapping, each less its mean."""
    n = min(nperseg, len(y))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    starts = range(0, len(y) - n + 1, max(n - n // 2, 1))
    power = np.mean([np.abs(np.fft.rfft((y[k : k + n] - y[k : k + n].mean()) * window)) ** 2 for k in starts], axis=0) / (fs * (window**2).sum())
    power[1 : -1 if n % 2 == 0 else None] *= 2
    return np.fft.rfftfreq(n, 1 / fs), power


def heartbeat(y: np.ndarray, fs: float, low: float = 0.5, high: float = 2.0, nperseg: int = 256, least: int = 64) -> tuple[float, float]:
    """(beats a minute, peak density) in a band, on the longest run that is there; NaN if that is too short."""
    runs = true_runs(np.isfinite(y))
    if not runs:
        return np.nan, np.nan
    a, b = max(runs, key=lambda r: (r[1] - r[0], -r[0]))
    if b - a < least:
        return np.nan, np.nan
    f, p = welch(y[a:b], fs, nperseg)
    band = np.flatnonzero((f >= low) & (f <= high))
    if not len(band):
        return np.nan, np.nan
    top = band[np.argmax(p[band])]
    return float(f[top] * 60), float(p[top])


def butterworth(order: int, edges: float | tuple[float, float], fs: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a low-pass, or of a band-stop between two edges, by the bilinear transform of the analogue prototype."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    if np.ndim(edges) == 0:
        w = warp(edges)
        poles, zeros, gain = poles * w, np.zeros(0, complex), w**order
    else:
        lo, hi = (warp(e) for e in edges)
        centre, width = lo * hi, hi - lo
        half = width / 2 / poles
        root = np.sqrt(half**2 - centre + 0j)
        poles = np.concatenate([half + root, half - root])
        zeros, gain = np.tile([1j * np.sqrt(centre), -1j * np.sqrt(centre)], order), 1.0
    digital = lambda r: (2 * fs + r) / (2 * fs - r)
    z = np.concatenate([digital(zeros), -np.ones(len(poles) - len(zeros))])
    gain = gain * np.real(np.prod(2 * fs - zeros) / np.prod(2 * fs - poles))
    return np.real(np.poly(z)) * gain, np.real(np.poly(digital(poles)))


def _filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray, block: int = 64) -> np.ndarray:
    """A recursive filter along the last axis, a block at a time: what the state and the block's own samples give are two matrix products."""
    k = len(a) - 1
    step = np.column_stack([-a[1:], np.eye(k)[:, : k - 1]])  # the next state from the last one, and from a sample
    into = b[1:] - a[1:] * b[0]
    powers = [np.eye(k)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    seen = np.array([p[0] for p in powers[:block]])  # outputs from the state
    heard = np.array([b[0], *(p[0] @ into for p in powers[: block - 1])])  # outputs from one sample
    own = np.array([[heard[i - j] if i >= j else 0.0 for j in range(block)] for i in range(block)])
    after = np.column_stack([powers[block - 1 - j] @ into for j in range(block)])
    flat = x.reshape(-1, x.shape[-1])
    out, s = np.empty_like(flat), np.array([np.broadcast_to(v, x.shape[:-1]).reshape(-1) for v in state])
    for at in range(0, flat.shape[1], block):
        part = flat[:, at : at + block].T
        n = len(part)
        out[:, at : at + n] = (seen[:n] @ s + own[:n, :n] @ part).T
        if n == block:
            s = powers[block] @ s + after @ part
    return out.reshape(x.shape)


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filter along the last axis, with odd extension and steady-state start."""
    if not np.isfinite(x).all():
        raise ValueError("the signal has missing values")
    pad, n = 3 * max(len(a), len(b)), x.shape[-1]
    if n <= pad:
        raise ValueError(f"the signal must be longer than {pad} samples")
    b, a = b / a[0], a / a[0]
    k = len(a) - 1
    companion = np.eye(k) - np.column_stack([-a[1:], np.eye(k)[:, : k - 1]])
    steady = np.linalg.solve(companion, b[1:] - a[1:] * b[0])
    wide = np.concatenate([2 * x[..., :1] - x[..., pad:0:-1], x, 2 * x[..., -1:] - x[..., -2 : -pad - 2 : -1]], axis=-1)
    start = lambda v: [s * v for s in steady]
    once = _filtered(b, a, wide, start(wide[..., 0]))
    back = _filtered(b, a, once[..., ::-1].copy(), start(once[..., -1]))
    return back[..., ::-1][..., pad : pad + n]


def lowpass(x: np.ndarray, fs: float, cutoff: float, order: int = 4) -> np.ndarray:
    return zero_phase(*butterworth(order, cutoff, fs), x)


def bandstop(x: np.ndarray, fs: float, low: float, high: float, order: int = 2) -> np.ndarray:
    return zero_phase(*butterworth(order, (low, high), fs), x)


def lowpass_runs(y: np.ndarray, m: np.ndarray, fs: float, cutoff: float, order: int = 4, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(low, rest) of one locus: each run that is there is filtered by itself; short runs and impossible cut-offs pass unchanged."""
    low = np.where(m & np.isfinite(y), y, np.nan)
    out = low.copy()
    if 0 < cutoff < fs / 2:
        for a, b in true_runs(np.isfinite(low)):
            if b - a >= (least or 3 * order + 1):
                try:
                    out[a:b] = lowpass(low[a:b], fs, cutoff, order)
                except ValueError:
                    pass
    return out, low - out


def edge_taper(y: np.ndarray, share: float = 0.05) -> np.ndarray:
    """Half Hann windows at both ends."""
    n = max(int(len(y) * share), 1)
    w = 0.5 - 0.5 * np.cos(np.pi * np.arange(n) / n)
    out = y.copy()
    out[:n] *= w
    out[-n:] *= w[::-1]
    return out


def effective_rank(x: np.ndarray) -> dict[str, float]:
    """Shares of variance of the first two components of times x loci, over complete rows, centred by locus."""
    rows = x[np.isfinite(x).all(axis=1)] if x.size else x
    return rank_of_sums(len(rows), rows.sum(axis=0), rows.T @ rows)


def rank_of_sums(n: int, sums: np.ndarray, products: np.ndarray) -> dict[str, float]:
    """The same from the number of rows, their sums and the sums of their products."""
    out = {"pc1": np.nan, "pc2": np.nan, "n_loci": len(sums), "n_samples": n}
    if n < 5 or len(sums) < 2:
        return out
    var = np.sort(np.maximum(np.linalg.eigvalsh(products - np.outer(sums, sums) / n), 0.0))[::-1]
    if var.sum() > 0:
        out |= {"pc1": float(var[0] / var.sum()), "pc2": float(var[1] / var.sum())}
    return out


def pchip(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Monotone cubic pieces (c0..c3 in powers of t - x[k]), one row an interval: harmonic mean slopes, three-point ends."""
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(len(x))
    for k in range(1, len(x) - 1):
        if d[k - 1] * d[k] > 0:
            w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            m[k] = (w1 + w2) / (w1 / d[k - 1] + w2 / d[k])
    for k, (h0, h1, d0, d1) in ((0, (h[0], h[1], d[0], d[1])), (-1, (h[-1], h[-2], d[-1], d[-2]))):
        end = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        m[k] = 0.0 if end * d0 <= 0 else 3 * d0 if d0 * d1 <= 0 and abs(end) > 3 * abs(d0) else end
    return np.column_stack([y[:-1], m[:-1], (3 * d - 2 * m[:-1] - m[1:]) / h, (m[:-1] + m[1:] - 2 * d) / h**2])


def wilcoxon(diff: np.ndarray) -> float:
    """Two-sided signed-rank p: zeros dropped, mean ranks; exact up to 50 pairs without ties or zeros, else normal with tie correction."""
    d = diff[diff != 0]
    size = np.abs(d)
    order = np.sort(size)
    ranks = (np.searchsorted(order, size, "left") + np.searchsorted(order, size, "right") + 1) / 2
    t = np.unique(size, return_counts=True)[1].astype(float)
    return signed_rank_p(len(diff), len(d), float(ranks[d > 0].sum()), float((t**3 - t).sum()))


def signed_rank_p(n_all: int, n: int, plus: float, ties: float) -> float:
    """The same from the numbers of pairs (all, and those that differ), the sum of the positive ranks, and the sum of t^3 - t over ties."""
    from math import erfc, sqrt

    if not n:
        return np.nan
    total = n * (n + 1) / 2
    if n <= 50 and n == n_all and ties == 0:
        ways = np.zeros(int(total) + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + ways[:-k].copy()
        p = ways[: int(min(plus, total - plus)) + 1].sum() / 2.0**n
        return float(min(1.0, 2 * p))
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return float(erfc(abs(plus - total / 2) / sqrt(var) / sqrt(2))) if var > 0 else np.nan
