"""Operator 3: sequences that a limit closes before they are full are cut into powers of two."""
import numpy as np
import pytest

from caresignal.llm import packing


@pytest.mark.parametrize("low, high", [(1, 1), (3, 10), (5, 5), (7, 7), (12, 12), (1, 50), (100, 300), (1, 5000)])
def test_no_padding_for_documents_of_any_length(low, high):
    rng, packer = np.random.default_rng(0), packing.Packer(2048, 256, 2048)
    seen, total, padding = {}, 0, 0
    sequences = []
    for k in range(3000):
        n = int(rng.integers(low, high + 1))
        total += n
        sequences += packer.add(packing.Piece(k, 0, np.arange(n, dtype="<u4"), n))
    sequences += packer.finish()
    for s in sequences:
        n = sum(len(p.ids) for p in s)
        assert 0 < n <= 2048 and len(s) <= 256
        padding += 2048 - n if n & (n - 1) else 0
        for p in s:
            seen.setdefault(p.key, []).append((p.start, len(p.ids), p.total))
            assert p.ids[0] == p.start and p.ids[-1] == p.start + len(p.ids) - 1
    assert sum(x[1] for v in seen.values() for x in v) == total and len(seen) == 3000
    for v in seen.values():
        at = 0
        for start, n, whole in sorted(v):
            assert start == at
            at += n
        assert at == whole
    assert padding == 0


def test_loss_limit_closes_sequences():
    """The loss limit binds where loss-bearing tokens are dense; no limit is passed and every id is placed."""
    rng, packer = np.random.default_rng(1), packing.Packer(256, 16, 40)
    total, sequences = 0, []
    for k in range(500):
        n = int(rng.integers(1, 120))
        bits = rng.random(n) < 0.5
        total += n
        sequences += packer.add(packing.Piece(k, 0, np.zeros(n, "<u4"), n, np.concatenate([[0], np.cumsum(bits)])))
    sequences += packer.finish()
    for s in sequences:
        assert sum(len(p.ids) for p in s) <= 256 and len(s) <= 16 and sum(p.n_loss() for p in s) <= 40
        n = sum(len(p.ids) for p in s)
        assert n == 256 or n & (n - 1) == 0
    assert sum(len(p.ids) for s in sequences for p in s) == total
