import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import decision_list, mixing, quality

RND = random.Random(6)
SCHEMA = "doc_id long, text string, source string, lang string, size long, n_words long, path string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1, 2, "p") for i, t, s in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- mixing -----------------------------------------------------------------------


def slow_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float([3, 1, 2][i % 3]) for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        free = [s for s in names if s not in capped]
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        target = {s: 2.0 * sizes[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def mixed(spark, rows):
    got = mixing.op5(documents(spark, rows)).collect()
    size, taken, source = Counter(), Counter(), {i: s for i, _, s in rows}
    for _, t, s in rows:
        size[s] += len(words(t))
    for r in got:
        assert r.size == len(words(dict((i, t) for i, t, _ in rows)[r.doc_id])) and 0 <= r.taken <= 2 * r.size and r.source_size == size[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    want = slow_targets(size)
    for r in got:
        assert r.target == pytest.approx(want[source[r.doc_id]])
    return got, taken, want


def test_mix_comes_near_targets(spark):
    rows = [(i, "w " * int(RND.lognormvariate(4, 1)), RND.choice(["a", "b", "é", "Z", None, "a"])) for i in range(600)]
    rows += [(600 + i, "same text here", "a") for i in range(300)] + [(2000, None, "b"), (2001, " \n", "a")]
    got, taken, want = mixed(spark, rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.002 * t), s
    again = mixing.op5(documents(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_edges(spark):
    assert mixing.op5(documents(spark, [])).count() == 0
    assert {r.taken for r in mixing.op5(documents(spark, [(1, None, None), (2, "", "a")])).collect()} == {0}
    one = mixing.op5(documents(spark, [(1, "a b c d", "x")])).first()
    assert one.target == pytest.approx(6) and one.taken in (4, 8)
    twice = mixing.op5(documents(spark, [(1, "a b", "x"), (1, "a b", "x"), (2, "c", "y")])).collect()
    assert len(twice) == 3


def test_tilt_is_the_balanced_one(spark):
    cells = spark.createDataFrame([("s", n, k) for n, k in ((1, 50), (5, 20), (40, 3))], "key string, size long, n long")
    total = 50 + 100 + 120
    for share in (0.1, 0.7, 1.0, 1.6):
        wanted = spark.createDataFrame([("s", total, 2.0 * total, share * total)], "key string, source_size long, cap double, target double")
        (r,) = mixing.tilts(cells, wanted, 2.0).collect()
        mass = sum(n * k * 2 / (1 + math.exp(-r.tilt * n / r.mean)) for n, k in ((1, 50), (5, 20), (40, 3)))
        assert mass == pytest.approx(share * total, abs=0.6)


def test_repeated(spark):
    rows = [(i, "w " * RND.randint(1, 40), RND.choice("abc")) for i in range(60)]
    docs = documents(spark, rows)
    copies = {r.doc_id: r.copies for r in mixing.mix(mixing.sized(docs), [3, 1, 2]).collect()}
    out = mixing.repeated(docs, [3, 1, 2])
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter({i: n for i, n in copies.items() if n})


# -- decision lists -----------------------------------------------------------------


def slow_statistics(text):
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = set()
    for i in range(len(w) - 2):
        if seen[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines), len(lines) - len(set(lines)), len(hit)


def test_statistics(spark):
    texts = [None, "", " \n", "a b", "a b c", "a b c a b c", "a a a a a", "x|y <z>\nx|y <z>\n \n x|y <z>", "é\x0bü\xa0x # $", "q " * 5000]
    texts += [" ".join(RND.choice("abcd") for _ in range(RND.randint(0, 60))) + "\n" * RND.randint(0, 2) for _ in range(60)]
    docs = documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for r in decision_list.statistics(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == slow_statistics(texts[r.doc_id]), texts[r.doc_id]


def good(n=90):
    return " ".join("".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 8))) for _ in range(n))


def labelled(n):
    rows = []
    for i in range(n):
        kind = i % 5
        text = good()
        if kind == 3:
            text = " ".join(w + RND.choice(["!!", "!!!"]) for w in text.upper().split())
        elif kind == 4:
            text = " ".join(w + " |" for w in text.split())
        rows.append((i, text, RND.choice("abc"), int(kind < 3)))
    return rows


def test_list_holds_on_other_rows(spark):
    train, rest = labelled(200), labelled(160)
    rows = [(i, t, s) for i, t, s, _ in train] + [(1000 + i, t, s) for i, t, s, _ in rest] + [(5000, None, "a"), (5001, "short", "a")]
    labels = spark.createDataFrame([(i, q) for i, _, _, q in train] + [(7, None), (None, 0), (0, 1), (0, 1)], "doc_id long, quality int")
    out, rules = decision_list.judged(documents(spark, rows), labels)
    kept = {r.doc_id: r for r in out.collect()}
    assert rules and all(kept[1000 + i].kept == bool(q) for i, _, _, q in rest)
    assert kept[5000].base_failed and not kept[5001].kept and len(kept) == len(rows)
    assert str(rules[0][0])


def test_list_without_labels(spark):
    docs = documents(spark, [(1, good(), "a"), (2, "x", "a")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted((r.doc_id, r.kept) for r in decision_list.op10(docs, none).collect()) == [(1, True), (2, False)]
    assert decision_list.op10(docs.limit(0), none).count() == 0


# -- quality -------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    train, rest = labelled(300), labelled(150)
    rows = [(i, t, s) for i, t, s, _ in train] + [(1000 + i, t, s) for i, t, s, _ in rest] + [(5000, None, None), (5001, "", "a")]
    labels = spark.createDataFrame([(i, q, 0) for i, _, _, q in train] + [(3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.op6(documents(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(got[1000 + i].kept == bool(q) for i, _, _, q in rest)
    kept = quality.keep_good(documents(spark, rows), labels)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ") and kept.count() == sum(r.kept for r in got.values())


def slow_posteriors(rows, llr, good):
    """By the formulas, over Python lists: rows (id, host, path), evidence by id, labels by id."""
    share = sum(good.values()) / len(good)
    base = math.log(share / (1 - share))
    y = [good.get(i, 1 / (1 + math.exp(-(llr[i] + base)))) for i, _, _ in rows]
    hosts, paths = defaultdict(list), defaultdict(list)
    for (_, h, p), v in zip(rows, y, strict=True):
        hosts[h].append(v)
        paths[h, p].append(v)
    n, mean = len(y), sum(y) / len(y)
    k = quality.strength(mean, sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in hosts.values()) / n, mean * (1 - mean) * len(hosts) / n)
    inner = sum(len(v) * (sum(v) / len(v) - sum(hosts[h]) / len(hosts[h])) ** 2 for (h, _), v in paths.items()) / n
    kp = quality.strength(mean, inner, mean * (1 - mean) * len(paths) / n)
    out = []
    for (i, h, p), v in zip(rows, y, strict=True):
        host = (sum(hosts[h]) - v + k * mean) / (len(hosts[h]) - 1 + k)
        path = (sum(paths[h, p]) - v + kp * host) / (len(paths[h, p]) - 1 + kp)
        bounded = min(0.99, max(0.01, path))
        out.append((i, host, path, 1 / (1 + math.exp(-(llr[i] + math.log(bounded / (1 - bounded)))))))
    return out


def test_posteriors_by_hand(spark):
    rows = [(i, t, RND.choice(["big", "big", "big", "h1", "h2", None]), RND.choice(["x", "y", None])) for i, t, _, _ in labelled(150)] + [(500, "lone words here", "rare", "x"), (501, "word " * 20000, "big", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    good = {i: int(i % 5 < 3) for i in range(0, 150, 2)}
    labels = spark.createDataFrame(list(good.items()), "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    want = slow_posteriors([(i, h, p) for i, _, h, p in rows], {i: r.llr for i, r in got.items()}, good)
    for i, host, path, posterior in want:
        assert np.allclose((got[i].host_rate, got[i].path_rate, got[i].posterior), (host, path, posterior), atol=1e-9)
    assert len({round(r.host_rate, 3) for r in got.values()}) > 3


def test_rows_that_share_a_doc_id_are_judged_apart(spark):
    train = labelled(200)
    rows = [(i, t, s) for i, t, s, _ in train] + [(900, train[0][1], "a"), (900, train[3][1], "a"), (None, train[0][1], "a"), (None, train[4][1], "a")]
    labels = spark.createDataFrame([(i, q) for i, _, _, q in train], "doc_id long, quality int")
    kept = [(r.doc_id, r.text) for r in quality.keep_good(documents(spark, rows), labels).collect()]
    assert (900, train[0][1]) in kept and (900, train[3][1]) not in kept and (None, train[0][1]) in kept and (None, train[4][1]) not in kept


def test_sample_is_bounded(spark):
    train = labelled(300)
    table = quality.features(documents(spark, [(i, t, s) for i, t, s, _ in train] * 2).repartition(7), "source", "lang")
    labels = spark.createDataFrame([(i, float(q)) for i, _, _, q in train], "doc_id long, good double")
    ids = []
    fitted = quality.Regression
    try:
        quality.Regression = lambda x, y: ids.append(len(y)) or fitted(x, y)
        quality.fit(table, labels, 100)
        quality.fit(table.repartition(2), labels, 300)
    finally:
        quality.Regression = fitted
    assert 60 < ids[0] <= 100 and ids[1] == 300


def sent_to_driver(spark, work) -> int:
    """Bytes of task results while ``work`` runs, without the 10 kB that a task's metrics take at most."""
    sc = spark.sparkContext
    store, jvm = sc._jsc.sc().statusStore(), sc._jvm
    stages = lambda: store.stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    total = lambda: sum(max(0, x.resultSize() - 10_000 * x.numCompleteTasks()) for x in (stages().apply(i) for i in range(stages().size())))
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    work()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_sample_on_the_driver_does_not_grow_with_partitions(spark):
    train = labelled(500)
    rows = [(i + 500 * k, t, s, q) for k in range(16) for i, t, s, q in train]
    table = quality.features(documents(spark, [r[:3] for r in rows]), "source", "lang")
    labels = spark.createDataFrame([(i, float(q)) for i, *_, q in rows], "doc_id long, good double")
    for n in (2, 20):  # 400 rows of some 200 bytes, and counts
        assert sent_to_driver(spark, lambda n=n: quality.fit(table.repartition(n), labels, 400)) < 200_000


def test_quality_edges(spark):
    docs = documents(spark, [(1, "a b", None), (2, None, "s"), (2, None, "s")])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.kept for r in quality.op6(docs, none).collect()] == [True] * 3
    assert quality.op6(docs.limit(0), none).count() == 0


def test_regression_recovers_a_boundary():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] + 0.2 * rng.normal(size=500) > 0).astype(float)
    model = quality.Regression(x, y)
    # the noise alone puts atan(0.2) / pi, or 6.3 per cent, on the other side
    assert ((model.evidence(x) + model.base > 0) == y).mean() > 0.92


# -- pipeline --------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rows = labelled(120)
    for n in range(10):  # near copies of one document
        text = rows[0][1].split()
        text[RND.randrange(len(text))] = "edit"
        rows.append((200 + n, rows[0][1] if n % 2 else " ".join(text), "a", 1))
    passage = good(60)
    rows += [(300 + n, good(50) + " " + passage + " " + good(20), "b", 1) for n in range(6)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, _, q in rows], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf, quality_of = f"file://{tmp_path}", {i: q for i, _, _, q in rows}
    now = spark.read.parquet(f"{sf}/documents.parquet")
    tables = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{sf}/out{k}")
        now = spark.read.parquet(f"{sf}/out{k}")
        tables.append(now)
    assert {r.doc_id for r in tables[0].collect()} == {i for i, q in quality_of.items() if q}
    assert all(t.columns == docs.columns for t in tables[:4])
    left = {r.doc_id for r in tables[1].collect()}
    assert 0 in left and not left & {200 + n for n in range(1, 10, 2)} and left >= {300 + n for n in range(6)}
    cut = {r.doc_id: r for r in tables[2].collect()}
    assert passage in cut[300].text and all(passage not in cut[300 + n].text and cut[300 + n].n_chars == len(cut[300 + n].text) for n in range(1, 6))
    taken = Counter(r.doc_id for r in tables[3].collect())
    pieces = defaultdict(int)
    for r in tables[4].collect():
        pieces[r.doc_id] += r.piece == 0
    assert pieces == taken and max(taken.values()) <= 2
    assert corpus_pipeline.run(spark, sf).count() == tables[4].count()


def test_repeated_rows_stand_for_each_other(spark):
    docs = documents(spark, [(1, "a b c", "x"), (1, "a b c", "x"), (1, "d e f g", "x"), (None, "h i", "x"), (2, "j", "y")])
    count = Counter((r.doc_id, r.text) for r in mixing.repeated(docs, [3, 1, 2], share=2.0).collect())
    assert count == {(1, "a b c"): 4, (1, "d e f g"): 2, (None, "h i"): 2, (2, "j"): 2}


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    text = good(80)
    rows = [(1, text, "a", "en", 9), (1, text, "a", "en", 9), (2, text + " more", None, None, None), (3, None, "a", "en", 0), (4, "", None, "en", 0), (None, good(), "a", "en", 1), (5, good(20_000), "b", "en", 1)]
    columns = "doc_id long, text string, source string, lang string, n_chars long, d string, e string, row string, marks string, copy int, fp long, root long"
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    for name, part in (("rows", rows), ("none", [])):
        now = spark.createDataFrame([(*r, "d", "e", "row", "marks", 1, 2, 3) for r in part], columns)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, f"file://{tmp_path}").write.parquet(f"file://{tmp_path}/{name}{k}")
            assert k == 4 or spark.read.parquet(f"file://{tmp_path}/{name}{k}").columns == now.columns
            now = spark.read.parquet(f"file://{tmp_path}/{name}{k}")
        assert bool(now.count()) == bool(part)
    kept = sorted(str(r.doc_id) for r in spark.read.parquet(f"file://{tmp_path}/rows1").collect())
    assert kept == ["1", "3", "5", "None"]


def test_entry_registers_all():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
