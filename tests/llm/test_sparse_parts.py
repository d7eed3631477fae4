"""Count tables of tasks travel as the bits of their entries that are not zero, then these entries."""

import numpy as np

from tapelens.llm.common import packed, unpacked


def test_sparse_parts_come_back_smaller():
    rng = np.random.default_rng(7)
    table = np.zeros(100_003, np.uint16)
    table[rng.integers(0, len(table), 8_000)] = rng.integers(1, 65_536, 8_000)
    table[rng.integers(0, len(table), 8_000)] = 1
    for t in (table, np.zeros(13, np.uint16), np.full(9, 65_535, np.uint16), np.array([0, 3, 0], np.uint8)):
        part = packed(t, sparse=True).column(0)[0].as_py()
        assert (unpacked(part, t, sparse=True) == t).all() and (unpacked(packed(t).column(0)[0].as_py(), t) == t).all()
    ones = (table > 0).astype(np.uint16)
    sizes = [len(packed(ones, sparse).column(0)[0].as_py()) for sparse in (True, False)]
    assert 1.5 * sizes[0] < sizes[1]
