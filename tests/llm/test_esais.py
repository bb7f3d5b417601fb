import random

import numpy as np
import pytest

from tsumugi.llm import esais


def plain(t):
    s = list(t)
    sa = sorted(range(len(s)), key=lambda i: s[i:])
    lcp = [0] * len(sa)
    for k in range(1, len(sa)):
        a, b = s[sa[k - 1] :], s[sa[k] :]
        while lcp[k] < min(len(a), len(b)) and a[lcp[k]] == b[lcp[k]]:
            lcp[k] += 1
    return sa, lcp


CASES = [[], [1], [1, 1], [2, 1], [1, 2], [1] * 50, list(b"mississippi"), list(b"banana" * 9), list(b"abcabcabd" * 20), list(range(1, 60)), list(range(60, 0, -1))]


@pytest.mark.parametrize(("memory", "base"), [(10**6, 0), (8, 0), (10**6, 1 << 19), (8, 20)])
def test_equals_plain_sorting(memory, base, tmp_path, monkeypatch):
    monkeypatch.setattr(esais, "BASE", base)
    rnd = random.Random(memory)
    more = [[rnd.randint(1, k) for _ in range(rnd.randint(2, 300))] for k in (1, 2, 3, 5, 40, 1000) for _ in range(25)]
    for t in CASES + more:
        sa, lcp = esais.suffix_array(np.array(t, np.int64), f"file://{tmp_path}", memory)
        assert (sa.tolist(), lcp.tolist()) == plain(t), t


def test_long_repeats():
    rnd = random.Random(1)
    p = [rnd.randint(1, 4) for _ in range(700)]
    t = p + [9] + p + [1] * 300 + p[100:600] + [1] * 200
    sa, lcp = esais.suffix_array(np.array(t))
    assert (sa.tolist(), lcp.tolist()) == plain(t)


def test_store_spills_and_returns(tmp_path):
    s = esais.Store(f"file://{tmp_path}", 10)
    for i in range(20):
        s.add(i % 5, np.array([[i], [i * 2]]))
    assert s.spilled
    assert [s.take(k)[0].tolist() for k in range(5)] == [[k, k + 5, k + 10, k + 15] for k in range(5)]
    assert s.take(9) is None


def test_memory_stays_small_beside_the_string(tmp_path):
    """In a process of its own: 1.2 million symbols with 50,000 tuples in memory, result checked as it streams."""
    import subprocess
    import sys

    code = f"""
import resource, numpy as np
from tsumugi.llm import esais
rnd = np.random.default_rng(3)
words = [bytes(rnd.integers(97, 110, rnd.integers(2, 9)).astype(np.uint8)) for _ in range(3000)]
t = np.frombuffer(b" ".join(words[i] for i in rnd.zipf(1.3, 300_000) % 3000)[:1_200_000], np.uint8)
esais.suffix_array(t[:3000], "file://{tmp_path}", 500)
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
before, raw, n, last = peak(), t.tobytes(), 0, None
seen = np.zeros(len(t), bool)
for sa, lcp in esais.suffix_runs(t, "file://{tmp_path}", 50_000):
    seen[sa] = True
    for i in range(0, len(sa), 997):
        a = last if not i else int(sa[i - 1])
        b, k = int(sa[i]), int(lcp[i])
        if a is not None:
            assert raw[a:a + k] == raw[b:b + k] and raw[a + k:a + k + 99] < raw[b + k:b + k + 99]
    last, n = int(sa[-1]), n + len(sa)
assert n == len(t) and seen.all()
print((peak() - before) / len(t))
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).parents[2]))
    assert out.returncode == 0, out.stderr[-2000:]
    assert float(out.stdout) < 64, out.stdout  # bytes a symbol, with what the process needs besides
