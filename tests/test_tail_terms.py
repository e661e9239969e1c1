import math

import numpy as np

from plait.operators import associate


def test_tails_of_large_counts_end_early():
    """Two hundred million terms are not summed one by one: the sum is that of the normal law at four deviations."""
    cov, a, k = 4e8, 2e8, 1e8 + 20000
    z = associate._significance(*(np.array([float(x)]) for x in (k, a, a, cov)))[0]
    deviation = math.sqrt(a * a * (cov - a) ** 2 / cov**2 / (cov - 1))
    assert abs(z + math.log10(0.5 * math.erfc((k - 0.5 - a * a / cov) / deviation / math.sqrt(2)))) < 1e-4


def test_tails_are_whole_sums():
    term = lambda i, a, b, c: math.comb(a, i) * math.comb(c - a, b - i)
    cases = [(k, a, b, c) for c in (1, 7, 30, 400) for a in {0, c // 3, c} for b in {0, c // 2, c} for k in range(max(0, a + b - c), min(a, b) + 1, max(1, c // 25))]
    got = associate._significance(*(np.array(x, np.float64) for x in zip(*cases)))
    for (k, a, b, c), z in zip(cases, got):
        low = sum(term(i, a, b, c) for i in range(max(0, a + b - c), k + 1)) / math.comb(c, b)
        high = sum(term(i, a, b, c) for i in range(k, min(a, b) + 1)) / math.comb(c, b)
        assert abs(z + math.log10(min(1, low if k == 0 or low < high else high))) < 1e-6
