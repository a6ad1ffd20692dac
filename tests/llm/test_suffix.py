import random
from collections import Counter

import numpy as np
import pytest

from laddersmith.llm import suffix


@pytest.mark.parametrize("buckets", [2048, 3])
def test_suffix_array(monkeypatch, buckets):
    monkeypatch.setattr(suffix, "BUCKETS", buckets)
    rng = random.Random(1)
    for _ in range(150):
        n, a = rng.randint(1, 60), rng.choice([1, 2, 3, 8])
        s = [rng.randint(1, a) for _ in range(n)] + [0]
        assert suffix.suffix_array(np.array(s), a + 1).tolist() == sorted(range(n + 1), key=lambda i: s[i:])


def test_repeated_starts():
    rng = random.Random(2)
    for _ in range(150):
        strings = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
        k = rng.randint(1, 6)
        c = Counter(s[i : i + k] for s in strings for i in range(len(s) - k + 1))
        assert [x.tolist() for x in suffix.repeated_starts(strings, k)] == [[i for i in range(len(s) - k + 1) if c[s[i : i + k]] > 1] for s in strings]
