"""Hard negatives and URL rules against plain Python, and on odd rows."""

import itertools
import math
import random

import pytest

from siltstone.llm import hard_negatives as hn
from siltstone.llm import url_rules as ur


def mined(rows):
    """(vec_id, vector, label) by the contract."""
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        one = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        kept[i] = min(kept.get(i, one), one)
    score = lambda a, b: sum(x * y for x, y in zip(kept[a][1], kept[b][1], strict=False))
    out = []
    for a in (i for i in kept if i % 100 == 0):
        near = sorted((-score(a, b), b) for b in kept if b != a and kept[b][0] == kept[a][0])[:5]
        for p, b in near:
            bad = sorted((-score(a, c), c) for c in kept if kept[c][0] != kept[a][0] and 30 * -p <= 100 * score(a, c) <= 90 * -p)[:10]
            out += [(a, b, k + 1, c, -p, -s) for k, (s, c) in enumerate(bad)]
    return sorted(out)


def drawn(n, seed, step=1):
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    rows = []
    for i in range(0, n * step, step):
        label = rng.randrange(10)
        rows.append((i, [x + rng.gauss(0, 0.8) for x in middle[label]], label))
    return rows


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 100)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    monkeypatch.setattr(hn, "ROW_SLICE", 16)
    monkeypatch.setattr(hn, "ANCHOR_SLICE", 2)
    monkeypatch.setattr(hn, "MOST_TASKS", 4)


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_negatives_like_plain_python(spark, small_groups):
    rows = [(i, [round(x, 2) for x in v], label) for i, v, label in drawn(300, 3, 25)]
    rows = spark.createDataFrame(rows, SCHEMA)
    got = hn.op13(rows)
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(map(tuple, got.collect())) == mined([tuple(r) for r in rows.collect()]) != []


def test_negatives_of_copies_and_odd_rows(spark, small_groups):
    nan, inf = float("nan"), float("inf")
    rows = [(100 * k, [1.0, 0.25], 1) for k in range(40)] + [(100 * k + 1, [0.5, 0.5], 2) for k in range(60)] + [(3, [1.0, 0.25], 1)] * 5
    rows += [(None, [1.0, 1.0], 1), (5, None, 1), (6, [None, 1.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [1.0, 1.0], None), (11, [0.9], 2), (12, [], 2), (13, [-0.1, -3.0], 3), (200, [0.5, 1.0], 3)]
    table = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", score int")
    got = sorted(map(tuple, hn.op13(table).collect()))
    assert got == mined([tuple(r[:3]) for r in table.collect()]) != []
    assert hn.op13(spark.createDataFrame([], SCHEMA)).count() == 0
    assert hn.op13(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).count() == 0
    assert hn.op13(spark.createDataFrame([(100, [1.0], 1)], SCHEMA)).count() == 0


def test_bounds_hold():
    import numpy as np

    rng = np.random.default_rng(1)
    v, a = rng.integers(-3000, 3000, (200, 6)), rng.integers(-500, 500, (9, 6))
    cells = hn.Cells(v.min(axis=0).tolist(), v.max(axis=0).tolist())
    low, high = cells.bounds(cells.tables(a), cells.approximate(v))
    exact = v @ a.T
    assert (low <= exact).all() and (exact <= high).all() and (high - low).max() > 0
    with pytest.raises(OverflowError):
        cells.tables(a * (1 << 48))


def judged(pages):
    """Rules and verdicts of (page_id, url) by plain Python; patterns of up to three tokens by counting all."""
    rows = []
    for page, url in pages:
        host, path, tokens = "", "", []
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
            cut = min((rest.find(c) for c in "?#" if c in rest), default=len(rest))
            path = rest[:cut]
            query = rest[cut + 1 :].split("#")[0] if rest[cut : cut + 1] == "?" else ""
            *labels, tld = host.split(".")
            stem, dot, ext = path.rpartition(".")
            if not (dot and ext.isascii() and ext.isalnum()):
                stem, ext = path, ""
            tokens = [f"tld={tld}"] + [f"host={w}" for x in reversed(labels) for w in reversed(x.split("-"))]
            tokens += ["path=" + (f"#{len(s)}" if s.isdigit() else s) for s in stem.split("/") if s] + [f"ext={ext}"] + [f"query={k.split('=')[0]}" for k in query.split("&")]
            tokens = list(dict.fromkeys(t for t in tokens if not t.endswith("=")))
        fits = [(len(name), name, said) for said, name in ur.RULES for h, _, p in [name.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        _, rule, said = max(fits, default=(0, None, None))
        rows.append((page, host, path, rule, said, tokens))
    known = [(frozenset(t[:12]), said) for *_, said, t in rows if said]
    n, both, alone = len(known), {}, {}
    for t, said in known:
        for k in (1, 2, 3):
            for items in itertools.combinations(sorted(t), k):
                both[said, items] = both.get((said, items), 0) + 1
                alone[items] = alone.get(items, 0) + 1
    of = {s: sum(x == s for _, x in known) for s in ("allow", "block")}
    rules = {k: (b, alone[k[1]]) for k, b in both.items() if b >= max(5, -(-n * 5 // 1000)) and 100 * b >= 80 * alone[k[1]] and b * n > alone[k[1]] * of[k[0]]}
    rules = {(s, i): (b, a) for (s, i), (b, a) in rules.items() if not any(x == s and set(y) < set(i) and c * a >= b * d for (x, y), (c, d) in rules.items())}
    out = []
    for page, host, path, rule, said, tokens in rows:
        best = max(((b / a, b, len(i), s, i) for (s, i), (b, a) in rules.items() if set(i) <= set(tokens)), default=None)
        out.append((page, host, path, rule, said or (best[3] if best else "allow"), " ".join(best[4]) if best and not rule else None))
    return sorted(out, key=str)


def test_url_filter_like_plain_python(spark):
    rng = random.Random(4)
    urls = []
    for i in range(600):
        host = rng.choice(["www.", "blog.", "m.", ""]) + rng.choice(["cheap-pills", "news", "a", "Best-News"]) + ".example." + rng.choice(["com", "org", "net"])
        urls.append((i, f"{rng.choice(['http', 'https'])}://{host}/{rng.choice(['en', 'de', 'fr', 'es'])}/{rng.randint(1, 2000)}{rng.choice(['', '/', '.html', '?page=2&ref=x', '#top', '?utm_source=feed'])}"))
    urls += [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://ORG"), (6, "x://com/fr/ü?a=1#b?c"), (7, "http://a.b://example.org/en/1"), (8, urls[9][1]), (8, urls[9][1]), (None, urls[3][1]), (9, "http://long.org/" + "seg/" * 5000)]
    table = spark.createDataFrame([(*u, "t") for u in urls], "page_id long, url string, tokens string")
    got = sorted(map(tuple, ur.op11(table).collect()), key=str)
    want = judged(urls)
    assert got == want
    assert any(r[5] and r[4] == "block" for r in got) and any(r[5] and r[4] == "allow" for r in got)


def test_rules_use_tokens_behind_the_twelfth(spark):
    segments = "/".join(f"s{i}" for i in range(14))
    urls = [f"http://a{i % 3}.com/{'de' if i % 2 else 'fr'}/{segments}/{'pills' if i % 2 else 'news'}" for i in range(40)]
    urls += [f"http://b.net/x/{word}" for word in ("pills", "news", "other")]
    got = ur.op11(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r.verdict, r.pattern) for r in got[-3:]] == [("block", "path=pills"), ("allow", "path=news"), ("allow", None)]


def test_frequent_combinations_are_all_those_of_up_to_three(spark):
    rng = random.Random(8)
    rows = [(rng.sample([f"t{i}" for i in range(18)], rng.randrange(17)), rng.choice(["allow", "block", "block"])) for _ in range(120)]
    got = {tuple(r["items"]): (r.allow, r.block) for r in ur.frequent(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 9).collect()}
    want = {}
    for tokens, said in rows:
        for k in (1, 2, 3):
            for items in itertools.combinations(sorted(tokens), k):
                a, b = want.get(items, (0, 0))
                want[items] = (a + (said == "allow"), b + (said == "block"))
    assert got == {i: c for i, c in want.items() if max(c) >= 9} != {}


def test_url_filter_without_labels(spark):
    schema = "page_id long, url string"
    assert ur.op11(spark.createDataFrame([], schema)).count() == 0
    got = ur.op11(spark.createDataFrame([(1, "http://a.net/x"), (2, None)], schema)).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a.net", "/x", None, "allow", None), (2, "", "", None, "allow", None)]
