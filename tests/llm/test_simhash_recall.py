"""Operator 9's keys lead to most pairs at every distance that verification accepts."""

import numpy as np
import pytest

from sahifa.llm import simhash


@pytest.mark.parametrize("bits,least", [(11, 1.0), (14, 0.99), (16, 0.98), (simhash.MOST_BITS, 0.97)])
def test_recall_by_differing_bits(bits, least):
    rng = np.random.default_rng(bits)
    n = 2000
    a = rng.integers(0, 256, (n, 16), dtype=np.uint8).view(np.uint64)
    flips = np.zeros((n, 128), np.uint8)
    for i in range(n):
        flips[i, rng.choice(128, bits, replace=False)] = 1
    b = a ^ np.packbits(flips, axis=1).view(np.uint64)
    keys = [np.stack(simhash.bucket_keys(p[:, 0], p[:, 1])).astype(np.int64) for p in (a, b)]
    shared = np.intersect1d(*((row << 32) | key for row, key in keys))
    assert len(np.unique(shared >> 32)) >= least * n
