"""Very long texts of many hits take time in proportion."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa

from plumbline.llm import contamination, secrets, toxicity
from plumbline.llm.kernel import ALNUM, buffers, words


def test_many_spans():
    rng = random.Random(3)
    spans = [(x, rng.randrange(3), x + rng.randrange(1, 40)) for x in (rng.randrange(2000) for _ in range(60))]
    covered = np.zeros(2100, bool)
    for x, _, y in spans:
        covered[x:y] = True
    union = secrets._union(spans)
    for _ in range(200):
        a = rng.randrange(2000)
        b = a + rng.randrange(1, 99)
        free = np.zeros(2100, bool)
        for x, y in secrets._free(a, b, union):
            assert a <= x < y <= b and not free[x:y].any()
            free[x:y] = True
        assert (free[a:b] == ~covered[a:b]).all() and not free[:a].any() and not free[b:].any()
    text = b" ".join(b"token=%032x" % rng.getrandbits(128) for _ in range(80_000))
    began = time.process_time()
    assert len(secrets.find(text, secrets.Markov(secrets.default_samples()))) == 160_000  # patterns cover all, no run is left
    assert time.process_time() - began < 30


def test_many_insults():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(400), rng.randrange(6))) for _ in range(2))
        assert toxicity._nearest(a, b) == min((abs(i - j) for i in a for j in b), default=99)
    insult, second = min(toxicity.INSULTS), min(toxicity.SECOND)
    began = time.process_time()
    assert toxicity.features(f"{second} filler {insult} " * 100_000, {})[:4] == [100_000, 100 / 3, 1, 0.5]
    assert toxicity._nearest(list(range(0, 900_000, 3)), list(range(1, 900_000, 3))) == 1
    assert time.process_time() - began < 30


def suffix_runs(docs, items, width):
    """The matches of contamination._runs, windows compared one by one."""
    for t, d in enumerate(docs):
        for i, w in enumerate(items):
            n = min(width, len(w))
            same = lambda o, p: n and 0 <= o <= len(w) - n and 0 <= p <= len(d) - n and d[p : p + n] == w[o : o + n]  # noqa: B023, E731
            for o in range(len(w) - n + 1):
                for p in range(len(d) - n + 1):
                    if same(o, p) and not same(o - 1, p - 1):
                        k = 0
                        while same(o + k, p + k):
                            k += 1
                        yield i, o, t, p, k + n - 1


def test_runs_against_brute_force(monkeypatch):
    rng = random.Random(5)
    for trial in range(150):
        width, letters = rng.choice((1, 2, 3, 5)), "ab" if trial % 2 else "abcd"
        docs = [[rng.choice(letters) for _ in range(rng.randrange(60))] for _ in range(rng.randrange(1, 5))]
        items = [[rng.choice(letters) for _ in range(rng.randrange(25))] for _ in range(3)]
        monkeypatch.setattr(contamination, "PAIRS", rng.choice((1, 7, 50, 10**6)))
        monkeypatch.setattr(contamination, "PIECE", rng.choice((1, 2, 5, 23, 1 << 20)))
        h, at = words(*buffers(pa.array([" ".join(d).encode() for d in docs], pa.binary())), ALNUM)
        test = contamination.TestSuffixes([(str(k), " ".join(w).encode()) for k, w in enumerate(items)], width)
        got = [x for part in contamination._runs(h, at, test) for x in zip(*(c.tolist() for c in part))]
        assert sorted(got) == sorted(suffix_runs(docs, items, width))


def test_repetitive_text_and_item():
    test = contamination.TestSuffixes([("1", b"a " * 1000), ("2", b"a a a")], 10)
    for n in (1_000_000, 2_500_000):
        h, at = words(*buffers(pa.array([b"a " * n], pa.binary())), ALNUM)
        began = time.process_time()
        tracemalloc.start()
        hit, found, best = contamination._hits(h, at, test)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert hit.all() and found == [{"1", "2"}] and best == [(1000, "1", 0, 0)]
        assert most < 1 << 30 and time.process_time() - began < 60
