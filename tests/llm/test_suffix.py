import numpy as np
import pytest

from vellumine.llm.suffix import WaveletIndex, permuted_lcp, suffix_array


@pytest.mark.parametrize("seed", range(40))
def test_against_sorting(seed):
    g = np.random.default_rng(seed)
    for _ in range(8):
        t = np.r_[g.integers(1, g.integers(1, 5) + 1, g.integers(0, 70)), 0]
        sa = suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        plcp = permuted_lcp(t, sa, 13)
        for a, b in zip(sa[:-1], sa[1:]):
            k = 0
            while k < 13 and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
                k += 1
            assert plcp[b] == k
        if len(t) > 4:
            starts = np.arange(len(t) - 3)
            found = WaveletIndex(t, sa).count(t, starts, 3)
            for s in starts:
                n = sum(t[i : i + 3].tolist() == t[s : s + 3].tolist() for i in range(len(t) - 2))
                assert found[s] == (n if n >= 2 else 0)
