"""Runs of words: against brute force, on texts that repeat heavily, and on odd rows."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from siltstone.llm import periodic_runs as pr


def brute(x, least=12):
    """Every stretch by every period, of equal stretches the smallest period."""
    out, n = {}, len(x)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i - a + q >= max(least, 2 * q):
                out.setdefault((a, i - a + q), q)
            i += 1
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def drawn(rng):
    x = [rng.randint(1, rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(0, 70))]
    if x and rng.random() < 0.5:
        a = rng.randrange(len(x))
        p = rng.randint(1, len(x) // 3 + 1)
        x = [x[i] if i < a else x[min(len(x) - 1, a + (i - a) % p)] for i in range(len(x))]
    return x


@pytest.mark.parametrize("least", [2, 12])
def test_runs_like_brute_force(least):
    rng = random.Random(least)
    for _ in range(3000):
        x = drawn(rng)
        assert pr.runs_of(x, least) == brute(x, least), x


def test_many_together_like_each_alone():
    rng = random.Random(5)
    texts = [[b"%d" % w for w in drawn(rng)] for _ in range(400)]
    texts += [[], [b"a"], [b"a"] * 500, [b"%d" % (i % 90) for i in range(400)], [b"%d" % i for i in range(3000)] + [b"%d" % i for i in range(2999, 0, -1)]]
    number = {w: i + 1 for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    assert pr.runs_of_all(texts) == [brute([number[w] for w in t]) if len(t) < 1000 else pr.runs_of([number[w] for w in t]) for t in texts]


def test_lyndon_edges():
    rng = random.Random(8)
    for _ in range(500):
        x = [*drawn(rng), 0]
        nss, reach = pr.lyndon(x)
        for i in range(len(x) - 1):
            j = next(j for j in range(i + 1, len(x)) if x[j:] < x[i:])
            assert nss[i] == j
            assert reach[i] == next(k for k in range(len(x)) if x[i + k] != x[j + k])


def test_time_is_linear():
    fib = [1], [1, 2]
    while len(fib[1]) < 400_000:
        fib = fib[1], fib[1] + fib[0]
    for x in ([1] * 400_000, fib[1][:400_000], list(range(1, 200_001)) * 2):
        began = time.time()
        pr.unsettled([np.array(x)])
        pr.runs_of(x)
        assert time.time() - began < 20


def test_kept():
    assert pr.kept(10, []) == [(0, 10)]
    assert pr.kept(10, [(2, 6, 2), (5, 5, 1)]) == [(0, 4)]
    assert pr.kept(0, []) == []


def test_digests_on_odd_rows(spark):
    tenth = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    text = " ".join(f"w{i % 7}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, text), (4, text), (tenth, "a\u00a0b c"), (None, text), (5, "x" * 300_000), (6, "z " * 40_000)]
    got = pr.digests(spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, start int"))
    assert got.columns == [c.split()[0] for c in pr.DIGEST.split(", ")]
    rows = got.collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == 9 and [r for r in rows if r.doc_id == 4][0] == [r for r in rows if r.doc_id == 4][1]
    empty = hashlib.sha256(b"").hexdigest()
    for k in (1, 2, 3):
        assert tuple(found[k])[1:] == (0, None, None, None, None, empty, empty)
    want = hashlib.sha256(b" ".join(b"w%d" % i for i in range(7))).hexdigest()
    for k in (4, None):
        assert tuple(found[k])[1:6] == (1, 0, 50, 7, 1000 * 50 // 7) and found[k].collapsed_sha256 == want
    assert found[6].length == 40_000 and found[6].period == 1
    assert pr.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_planted_end():
    for k in range(200):
        words = [b"%d" % i for i in range(k % 50)]
        h = zlib.crc32(str(k).encode())
        g, n = h // 10, len(words)
        want = list(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            want = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert pr.periodic(words, k) == want


def test_collapse_and_runs_of_documents(spark):
    text = "start " + "one two three " * 8 + "end"
    docs = spark.createDataFrame([(1, text, "en"), (2, "as\tit  is", "en"), (3, None, "de")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, pr.collapse(docs).collect()), key=str) == [(1, "start one two three end", "en"), (2, "as\tit  is", "en"), (3, None, "de")]
    assert [tuple(r) for r in pr.runs(docs).collect()] == [(1, 1, 24, 3)]
