"""Near-copies and repeats against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import simhash, suffix_dedup

RND = random.Random(4)
WORDS = ["".join(RND.choice("abcdefgh") for _ in range(RND.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(RND.choice(WORDS) for _ in range(n))


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "fp", 1, "d", "marks") for i, t in rows], "doc_id long, text string, fp string, t int, d string, marks string")


def slow_fingerprint(text, shingle):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for j in range(64):
            counts[j] += h >> j & 1
    return sum(1 << j for j in range(64) if 2 * counts[j] > len(shingles))


def slow_components(prints, radius):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_pair(radius):
    tables = simhash.masks(radius)
    assert len(tables) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        differ = sum(1 << b for b in RND.sample(range(64), radius))
        assert any(not differ & m for m in tables)


def corpus():
    rows = [(i, prose(RND.randint(1, 60))) for i in range(60)]
    base = prose(150)
    for i in range(60, 100):
        words = base.split()
        for _ in range(RND.randint(0, 6)):
            words[RND.randrange(len(words))] = RND.choice(WORDS)
        rows.append((i, " ".join(words)))
    rows += [(i, rows[3][1].upper() + "\n\t ") for i in range(100, 104)]
    return rows + [(104, None), (105, ""), (106, " \n\x0b"), (107, "É é x"), (108, prose(3000)), (-5, "x")]


@pytest.mark.parametrize("block", [3, simhash.BLOCK])
def test_simhash(spark, block):
    rows = corpus()
    prints = {i: slow_fingerprint(t, 4) for i, t in rows}
    want = slow_components(prints, 4)
    got = simhash.near_duplicates(documents(spark, rows).repartition(5), 4, 4, block).collect()
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == want
    assert len(got) == len(rows)


def test_simhash_edges(spark):
    assert simhash.op2(documents(spark, [])).count() == 0
    got = simhash.op2(documents(spark, [(2, "same"), (2, "same"), (1, "same"), (None, "same"), (3, None)])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("1", 1), ("2", 1), ("2", 1), ("3", 3), ("None", 1)]
    assert next(r.fingerprint for r in got if r.doc_id == 3) == "0" * 16


def test_keep_one(spark):
    rows = corpus()
    want = {v for v in slow_components({i: slow_fingerprint(t, 5) for i, t in rows}, 6).values()}
    kept = simhash.keep_one(documents(spark, rows), 5, 6)
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == documents(spark, []).columns


def test_components_of_a_long_chain(spark):
    chain = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1000, 1300).select(F.lit(1400).cast("long").alias("a"), F.col("id").alias("b"))
    got = simhash.components(chain.union(star)).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(1, 41)} | {i: 1000 for i in [*range(1001, 1300), 1400]}


def slow_repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeating():
    passage, line = prose(40), prose(14)
    rows = [(i, prose(RND.randint(0, 80))) for i in range(30)]
    rows += [(i, prose(RND.randint(0, 20)) + " " + passage[RND.randint(0, 60) :] + " " + prose(RND.randint(0, 20))) for i in range(30, 60)]
    rows += [(i, line + "\n" + prose(30)) for i in range(60, 80)] + [(i, rows[5][1]) for i in range(80, 90)]
    rows += [(90, "ab" * 400), (91, "a" * 700), (92, "ba" * 300), (93, None), (94, ""), (95, "x" * 99), (96, "x" * 100), (97, "x" * 100), (98, "é" * 120), (99, prose(2500)), (-3, passage)]
    return rows


@pytest.mark.parametrize(
    ("length", "piece", "many", "hold"),
    [(100, 2 << 20, 256, 1 << 20), (100, 700, 1, 3), (100, 700, 256, 2), (50, 900, 2, 9), (33, 2 << 20, 1, 1), (64, 300, 256, 5), (5, 2 << 20, 256, 99), (190, 700, 9, 99), (191, 700, 256, 99), (200, 2 << 20, 9, 5), (300, 900, 9, 9)],
)
def test_repeats(monkeypatch, length, piece, many, hold):
    rows = repeating()
    for name, value in (("SLICE", piece), ("MANY", many), ("HELD", hold), ("COMBINE", 500)):
        monkeypatch.setattr(suffix_dedup, name, value)

    got = run_patched(rows, length, suffix_dedup)
    assert got == slow_repeats(rows, length)


def run_patched(rows, length, module):
    """The steps over plain iterators in this process, under small limits."""
    import pyarrow as pa

    docs = sorted(rows)
    texts = {i: t or "" for i, t in docs}
    size = (length - (1 << (length // 2).bit_length() - 1)) // 2

    def batches(frame, n=7):
        table = pa.Table.from_batches(frame) if frame else None
        return iter(table.to_batches(max_chunksize=n)) if table is not None else iter([])

    source = [pa.RecordBatch.from_pydict({"d": pa.array([i for i, _ in docs[k::3]], pa.int64()), "e": pa.array([7] * len(docs[k::3]), pa.int64()), "text": pa.array([texts[i] for i, _ in docs[k::3]], pa.string())}) for k in range(3)]
    sent = [b for s in source for b in module._send(iter([s]), length)]
    table = pa.Table.from_batches(sent).sort_by([(c, "ascending") for c in module.ROW_NAMES]) if sent else None
    marks = [b for b in module._receive(iter(table.to_batches(max_chunksize=50)), length, size)] if table is not None else []
    pairs = [(d, m) for b in marks for d, m in zip(b.column("d").to_pylist(), b.column("mark").to_pylist(), strict=True)]
    todo = {}
    for d, m in pairs:
        if m & 3 == module.OPEN:
            todo.setdefault(d, []).append(m)
    ranked = []
    for part in (sorted(todo)[::2], sorted(todo)[1::2]):
        if part:
            b = pa.RecordBatch.from_pydict({"d": pa.array(part, pa.int64()), "e": pa.array([7] * len(part), pa.int64()), "text": pa.array([texts[d] for d in part]), "marks": pa.array([todo[d] for d in part], pa.list_(pa.int64()))})
            ranked += list(module._rank(iter([b]), length))
    later = []
    if ranked:
        table = pa.Table.from_batches(ranked).sort_by([(c, "ascending") for c in module.WINDOW_NAMES])
        later = [b for b in module._rerank(iter(table.to_batches(max_chunksize=40)))]
    gone = {}
    for d, m in [(d, m) for d, m in pairs if m & 3 == module.GONE] + [(d, m) for b in later for d, m in zip(b.column("d").to_pylist(), b.column("mark").to_pylist(), strict=True)]:
        gone.setdefault(d, []).append(m)
    out = {}
    for i, t in texts.items():
        data = t.encode()
        mask = module._removed(len(data), np.array(gone.get(i, []), np.int64), length)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], mask.astype(int)])) == 1))
        out[i] = (len(data), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~mask].tobytes()).hexdigest())
    return out


def test_repeats_through_spark(spark):
    rows = repeating()
    got = suffix_dedup.digests(documents(spark, rows).repartition(6), 100).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == slow_repeats(rows, 100)
    assert len(got) == len(rows)


def test_repeats_edges(spark):
    assert suffix_dedup.digests(documents(spark, [])).count() == 0
    text = prose(60)
    got = suffix_dedup.digests(documents(spark, [(1, text), (1, text), (None, text)])).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", len(text)), ("1", len(text)), ("None", 0)]
    same = suffix_dedup.digests(documents(spark, [(1, text), (1, text)])).collect()
    assert [r.n_removed for r in same] == [0, 0]


def test_rows_that_share_a_doc_id(spark):
    shared, own = prose(50), [prose(50) for _ in range(4)]
    rows = [(0, shared), (1, shared), (1, own[0]), (1, shared + own[1]), (1, own[1]), (None, own[2]), (None, own[2] + "x"), (None, own[3]), (None, own[3])]
    docs = documents(spark, rows).repartition(3)
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted({(-(1 << 63) if i is None else i, hashes[t], t) for i, t in rows})
    place = {(i, t): n for n, (i, _, t) in enumerate(order)}
    want = slow_repeats([(place[i, t], t) for i, _, t in order], 100)
    got = suffix_dedup.digests(docs).collect()
    key = lambda i, t: want[place[-(1 << 63) if i is None else i, t]]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(i), *key(i, t)) for i, t in rows)
    kept = suffix_dedup.cut_texts(docs.select(F.col("doc_id").alias("d"), "text", F.col("t").alias("marks"), F.col("fp").alias("row")), 100, "d").collect()
    assert sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in kept) == sorted(key(i, t)[3] for i, t in rows)


def test_cut_texts(spark):
    text = "é" * 40 + prose(60)
    docs = documents(spark, [(1, text), (2, "start " + text[1:] + " end"), (3, None)])
    got = {r.doc_id: r for r in suffix_dedup.cut_texts(docs).collect()}
    assert got[1].text == text and got[3].text is None and got[2].text.startswith("start ") and got[2].text.endswith(" end") and len(got[2].text) < 20
    assert got[1].fp == "fp" and got[1].marks == "marks"
    with pytest.raises(ValueError, match="length"):
        suffix_dedup.repeats(docs, 3)
