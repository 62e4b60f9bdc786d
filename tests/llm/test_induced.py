import random

import numpy as np
import pytest

from chronofold.llm import induced
from llm_cases import prose


@pytest.mark.parametrize("memory", [16, 1 << 20])
def test_order_and_common_prefixes(tmp_path, memory):
    r = random.Random(5)
    for size, n in [(2, 60), (3, 200), (26, 300), (1, 40), (2, 1), (4, 600)]:
        t = np.array([r.randrange(size) for _ in range(n)], np.int64)
        sa, lcp = induced.suffix_order(t, str(tmp_path), memory, 20)
        raw = t.tolist()
        want = sorted(range(n), key=lambda i: raw[i:])
        assert sa.tolist() == want
        for k in range(1, n):
            a, b = raw[want[k - 1] :], raw[want[k] :]
            m = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(m, 20)
    assert not list(tmp_path.iterdir())


def test_removed_bytes(tmp_path):
    from test_substrings import brute

    texts = [prose(1, 60), prose(2, 40) + " " + prose(1, 60), "ab" * 150, prose(3, 20), "", prose(2, 40)]
    masks = induced.removed_mask([t.encode() for t in texts], str(tmp_path), 64)
    want = brute(list(enumerate(texts)))
    for i, (t, m) in enumerate(zip(texts, masks)):
        assert int(m.sum()) == want[(i, t.encode())][1]
