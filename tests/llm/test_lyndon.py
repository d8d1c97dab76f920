import random

import numpy as np
import pytest

from pagewright.llm.lyndon import suffix_arrays


@pytest.mark.parametrize("alphabet", [1, 2, 3, 26])
def test_orders_are_those_of_sorting(alphabet):
    rng = random.Random(alphabet)
    for _ in range(60):
        strings = [[rng.randrange(1, alphabet + 1) for _ in range(rng.choice((0, 1, 5, 30)))] for _ in range(rng.randrange(1, 12))]
        strings += [[1, 2] * 7, [2, 1] * 7, [1] * 9, [3, 2, 1], [1, 2, 3], [2, 2, 1, 2, 2, 1, 2]]
        symbols = np.array([x for s in strings for x in (*s, 0)])
        starts = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])])
        got = suffix_arrays(symbols, starts)
        for s, a, b in zip(strings, starts[:-1], starts[1:]):
            whole = [*s, 0]
            assert [int(i - a) for i in got[a:b]] == sorted(range(len(whole)), key=lambda i: whole[i:]), whole
