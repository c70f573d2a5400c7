"""Operator 4's audit sees what is missed of small groups beside a large one."""

import numpy as np

from sahifa.llm import hnsw


def test_a_large_group_does_not_hide_small_ones(monkeypatch):
    rng = np.random.default_rng(2)
    twins = hnsw.normalised(rng.normal(size=(300, 32)).astype(np.float32)).repeat(2, 0) + 0.02 * rng.normal(size=(600, 32))
    large = rng.normal(size=32) + 0.02 * rng.normal(size=(600, 32))
    x = hnsw.normalised(np.concatenate([twins, large]).astype(np.float32))
    g = hnsw.Graph(np.arange(len(x)), x)
    search = g.search

    def poor(q, beam):
        """Narrow beams miss all of the twins."""
        ids, sims = search(q, beam)
        return np.where((ids < 600) & (beam <= hnsw.FIRST_BEAM), -1, ids), sims

    monkeypatch.setattr(g, "search", poor)
    g.audit(0.9)
    assert g.beam != hnsw.FIRST_BEAM
