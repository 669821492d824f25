"""Draws without replacement from counts beyond what numpy's hypergeometric draws hold."""

import numpy as np
import pytest

from registrum.llm import mixing


def test_large_draws_are_distributed_as_small_ones(monkeypatch):
    good, bad, n, times = 30, 50, 24, 6000
    rng = np.random.default_rng(1)
    want = np.bincount(rng.hypergeometric(good, bad, n, 400_000), minlength=n + 1) / 400_000
    monkeypatch.setattr(mixing, "_MOST_DRAWN", 10)
    monkeypatch.setattr(mixing, "_TRIES", 64)
    found = np.bincount([mixing.hypergeometric(rng, good, bad, n) for _ in range(times)], minlength=n + 1)
    often = want * times >= 5
    chi = ((found[often] - want[often] * times) ** 2 / (want[often] * times)).sum()
    assert chi < 3 * often.sum()
    edges = [mixing.hypergeometric(rng, *x) for x in ((5, 20, 0), (5, 20, 25), (0, 30, 7), (30, 0, 7))]
    assert edges == [0, 5, 0, 7]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_splits_of_many_slots(seed):
    counts = np.array([4_000_000_000, 0, 9_000_000_000, 37, 2_500_000_000], np.int64)
    left = 6_000_000_000
    out = mixing.split(counts, left, (seed,))
    assert out.sum() == left and (out >= 0).all() and (out <= counts).all()
    share = left / counts.sum()
    sd = np.sqrt(counts * share * (1 - share) * (1 - counts / counts.sum()))
    assert (np.abs(out - counts * share) <= 6 * sd + 1).all()
    assert (out == mixing.split(counts, left, (seed,))).all()
    assert any(out[0] != mixing.split(counts, left, (s,))[0] for s in (11, 12))
