"""Matrix and signal kernels against closed forms, brute force and their defining properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwave.operators import kernels as K

rng = np.random.default_rng(3)


def test_tridiagonal_solves_the_dense_system():
    d, off = 4 + rng.random((3, 50)), -1.3
    b = rng.normal(size=(3, 50))
    x = K.Tridiagonal(d, off).solve(b)
    for k in range(3):
        a = np.diag(d[k]) + off * (np.eye(50, k=1) + np.eye(50, k=-1))
        assert np.allclose(a @ x[k], b[k], atol=1e-10)


def test_singular_shrinkage_matches_svd():
    y = rng.normal(size=(6, 200))
    u, s, v = np.linalg.svd(y, full_matrices=False)
    want = (u * np.maximum(s - 3, 0)) @ v
    got, total = K.shrink_singular(y, 3.0)
    assert np.allclose(got, want, atol=1e-9) and np.isclose(total, np.maximum(s - 3, 0).sum())


def test_rpca_separates_low_rank_and_spikes_on_the_mask():
    low = rng.normal(size=(20, 1)) @ rng.normal(size=(1, 400))
    spikes = np.zeros_like(low)
    spikes.flat[rng.choice(low.size, 80, replace=False)] = 15
    m = rng.random(low.shape) > 0.05
    s, a, info = K.masked_rpca(np.where(m, low + spikes, np.nan), m, lam=0.5, mu=1.0, rho=1.0, max_iter=500, tol=1e-5)
    assert (a[~m] == 0).all()
    assert np.allclose((s + a)[m], (low + spikes)[m], atol=1e-2)
    assert np.median(np.abs(a[(spikes > 0) & m])) > 5
    assert info["converged"]


def test_smoothness_lowers_roughness():
    x = 5 * np.sin(np.arange(300) / 30)[None, :] + rng.normal(size=(8, 300))
    rough = lambda z: np.abs(np.diff(z, axis=1)).mean()
    m = np.ones(x.shape, bool)
    assert rough(K.masked_rpca(x, m, 0.5, gamma=100, max_iter=40)[0]) < 0.6 * rough(K.masked_rpca(x, m, 0.5, max_iter=40)[0])


def test_rpca_refuses_bad_weights():
    with pytest.raises(ValueError):
        K.masked_rpca(np.ones((2, 3)), np.ones((2, 3), bool), lam=0)


def test_heartbeat_of_a_sine():
    t = np.arange(5000) / 25
    assert abs(K.heartbeat(np.sin(2 * np.pi * 1.2 * t), 25)[0] - 72) < 5
    assert np.isnan(K.heartbeat(np.full(500, np.nan), 25)[0]) and np.isnan(K.heartbeat(np.ones(10), 25)[0])


def test_filters_pass_and_stop():
    t = np.arange(2000) / 25
    slow, fast = np.sin(2 * np.pi * 0.2 * t), np.sin(2 * np.pi * 5 * t)
    out = K.lowpass(slow + fast, 25, 1.0)
    assert np.abs(out - slow)[100:-100].max() < 0.02
    stopped = K.bandstop(slow + np.sin(2 * np.pi * 1.2 * t), 25, 0.9, 1.5)
    assert np.abs(stopped - slow)[200:-200].max() < 0.1
    with pytest.raises(ValueError):
        K.lowpass(np.array([1.0, np.nan] * 100), 25, 1.0)


def test_butterworth_half_power_and_unit_gain():
    b, a = K.butterworth(4, 2.0, 25.0)
    gain = lambda f: abs(np.polyval(b, np.exp(2j * np.pi * f / 25)) / np.polyval(a, np.exp(2j * np.pi * f / 25)))
    assert np.isclose(gain(0), 1) and np.isclose(gain(2.0), 2**-0.5)


def test_runs_are_filtered_apart():
    y = np.r_[np.ones(40), np.full(5, np.nan), np.full(8, 3.0), np.full(3, np.nan), np.full(40, 7.0)]
    low, rest = K.lowpass_runs(y, np.isfinite(y), 25, 2.0)
    assert (np.isnan(low) == np.isnan(y)).all() and np.nanmax(np.abs(low - y)) < 1e-6 and np.nanmax(np.abs(rest)) < 1e-6


def test_effective_rank_of_rank_one():
    r = K.effective_rank(np.outer(rng.normal(size=50), rng.normal(size=4)))
    assert r["pc1"] > 0.999999 and np.isnan(K.effective_rank(np.ones((3, 4)))["pc1"])


def test_pchip_is_monotone_and_exact_at_knots():
    x, y = np.array([0.0, 1, 3, 4, 7]), np.array([0.0, 0, 2, 2, 5])
    c = K.pchip(x, y)
    value = lambda t, k: sum(c[k, j] * (t - x[k]) ** j for j in range(4))
    for k in range(4):
        assert np.isclose(value(x[k], k), y[k]) and np.isclose(value(x[k + 1], k), y[k + 1])
        ts = np.linspace(x[k], x[k + 1], 50)
        assert (np.diff([value(t, k) for t in ts]) >= -1e-12).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=9, unique=True), st.data())
def test_wilcoxon_exact_is_the_enumeration(sizes, data):
    signs = np.array(data.draw(st.lists(st.sampled_from([-1, 1]), min_size=len(sizes), max_size=len(sizes))))
    d = np.array(sizes) * signs
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    low = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    hits = sum(sum(r for k, r in enumerate(ranks) if bits >> k & 1) <= low for bits in range(1 << len(d)))
    assert np.isclose(K.wilcoxon(d.astype(float)), min(1, 2 * hits / 2 ** len(d)))


def test_tapers_fall_to_zero_at_both_ends():
    y = np.ones(200)
    t = K.edge_taper(y, 0.1)
    assert t[0] == 0 and t[-1] == 0 and (t[20:-20] == 1).all() and np.allclose(t, t[::-1]) and (np.diff(t[:20]) > 0).all() and (y == 1).all()
    assert K.edge_taper(np.ones(3)).tolist() == [0.0, 1.0, 0.0]
