"""The stored text index and vector spaces against scans, and their gates."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import fulltext, retrieval, textindex, vector
from siltstone.operators.spaces import EmbeddingBuild, VectorSpaces, recall
from siltstone.operators.textindex import TextIndex, cover, term

WEIGHTS = {"content": 1.0, "title": 1.5}


def documents(spark, n=60, seed=3):
    rng = random.Random(seed)
    words = ["aaaa", "Apache", "licence", "banana", "anana", "Straße", "数据库", "the", "an", "LICENSED"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.choice([*words, None]), f"src{i % 3}") for i in range(n)]
    rows += [(n, None, None, "src0"), (n + 1, "", "", "src1"), (n + 2, "a" * 5000 + " banana", "aaaa", "src2")]
    return spark.createDataFrame(rows, "doc_id long, content string, title string, source string")


def index(spark, tmp_path, name="index"):
    return TextIndex(spark, f"file://{tmp_path}/{name}", "doc_id", ["content", "title"], ["source"])


def found(rows):
    return [(r.doc_id, round(r.score, 9)) for r in rows.collect()]


QUERIES = ["banana anana aaa", "licensed the straße 数据库", "nothing here"]


def test_search_like_a_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("siltstone.operators.textindex.BLOCK_CHARS", 1500)
    docs, ix = documents(spark), index(spark, tmp_path)
    ix.build("one", docs)
    with pytest.raises(LookupError):
        ix.search("apache", WEIGHTS)
    ix.activate("one", docs)
    for query in QUERIES:
        assert found(ix.search(query, WEIGHTS, 30)) == found(fulltext.bm25(docs, query, "doc_id", WEIGHTS, 30)), query
    narrow = F.col("source") == "src1"
    assert found(ix.search("banana apache", WEIGHTS, 30, narrow)) == found(fulltext.bm25(docs.where(narrow), "banana apache", "doc_id", WEIGHTS, 30))
    with pytest.raises(ValueError):
        ix.search("an a", WEIGHTS)


def test_only_the_terms_folders_are_read(spark, tmp_path):
    docs, ix = documents(spark), index(spark, tmp_path)
    ix.build("one", docs)
    ix.activate("one", docs)
    plan = ix.search("apache", WEIGHTS)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert all("content:" not in line.split("ReadSchema")[1] for line in scans)
    of_terms = [line for line in scans if "term" in line.split("ReadSchema")[1]]
    assert len(of_terms) >= 2 and all("bucket" in line.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "In(term" in line or "EqualTo(term" in line for line in of_terms)


def test_refresh_merge_and_the_gate(spark, tmp_path):
    docs, ix = documents(spark), index(spark, tmp_path)
    ix.build("one", docs)
    ix.activate("one", docs)
    fresh = spark.createDataFrame([(3, "banana split", "new", "src0"), (99, "apache apache", None, "src1")], docs.schema)
    gone = spark.createDataFrame([(5,), (6,)], "doc_id long")
    after = docs.where("doc_id not in (3, 5, 6)").unionByName(fresh)
    assert sorted(map(tuple, ix.uncovered("one", after).collect())) == [(3, "stale"), (5, "orphan"), (6, "orphan"), (99, "missing")]
    with pytest.raises(ValueError):
        ix.activate("one", after)
    ix.refresh("one", fresh, gone)
    ix.activate("one", after)
    again = spark.createDataFrame([(99, "only banana now", None, "src1")], docs.schema)
    ix.refresh("one", again)
    after = after.where("doc_id <> 99").unionByName(again)
    ix.merge("one", "two")
    for generation in ("one", "two"):
        assert ix.uncovered(generation, after).count() == 0
        for query in QUERIES:
            assert found(ix.search(query, WEIGHTS, 30, generation=generation)) == found(fulltext.bm25(after, query, "doc_id", WEIGHTS, 30)), (generation, query)


def test_building_moves_no_postings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("siltstone.operators.textindex.BLOCK_CHARS", 1500)
    docs, ix = documents(spark), index(spark, tmp_path)
    for generation, rows, tasks in (("few", docs.coalesce(4), 4), ("many", docs.repartition(60), 4)):  # of small partitions several to a task
        ix.build(generation, rows)
        ix.activate(generation, docs)
        made = F.shiftright("block", 32).alias("made")
        wrote = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("long").alias("wrote")
        pairs = [tuple(r) for r in ix._postings(generation).select(made, wrote).distinct().collect()]
        assert len(pairs) == tasks and all(a == b for a, b in pairs), generation
    assert found(ix.search(QUERIES[0], WEIGHTS, 30)) == found(fulltext.bm25(docs, QUERIES[0], "doc_id", WEIGHTS, 30))
    monkeypatch.setattr("siltstone.operators.textindex.TASK_CHARS", 1000)
    ix.build("large", docs.repartition(60))
    assert ix._postings("large").select(F.shiftright("block", 32)).distinct().count() > 8


def test_repeated_keys_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, "apache", None, "s"), (1, "banana", None, "s"), (None, "apache", None, "s")], "doc_id long, content string, title string, source string")
    ix = index(spark, tmp_path)
    ix.build("one", rows, unique=False)
    assert ix.documents("one").count() == 1
    assert len(found(ix.search("apache", WEIGHTS, generation="one"))) + len(found(ix.search("banana", WEIGHTS, generation="one"))) == 1
    ix.build("none", rows.limit(0))
    assert found(ix.search("apache", WEIGHTS, generation="none")) == []


def test_cover():
    counts = {term(w): n for w, n in (("lic", 9), ("ice", 1), ("cen", 9), ("enc", 9), ("nce", 2))}
    assert cover("licence", counts) == [(term("ice"), 1), (term("nce"), 4), (term("lic"), 0)]
    assert cover("abc", {}) == [(term("abc"), 0)]


def test_hybrid_search_on_the_index(spark, tmp_path):
    docs, ix = documents(spark), index(spark, tmp_path)
    ix.build("one", docs)
    ix.activate("one", docs)
    narrow = retrieval.Filters(source="src2")
    a, b = (retrieval.hybrid_search(docs, "banana apache", "doc_id", mode="text", filters=narrow, index=i).rows.select("doc_id", "score", "excerpt").collect() for i in (None, ix))
    assert a == b != []


# -- vectors --------------------------------------------------------------------


def vectors(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(8, 16))
    rows = [(i, f"h{i}", (middle[i % 8] + 0.3 * rng.normal(size=16)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, content_hash string, embedding array<float>")


def test_probing_and_exact_search(spark, tmp_path):
    rows = vectors(spark)
    held = VectorSpaces(spark, f"file://{tmp_path}/spaces")
    held.create("a", "f", 16)
    held.write("a", rows, cells=12)
    assert held.vectors("a").count() == 400 and sum(c.n for c in held.cells("a")) == 400
    for i in (0, 17, 101):
        query = rows.where(F.col("chunk_id") == i).first().embedding
        want = [r.chunk_id for r in vector.nearest(rows, query, "chunk_id", "embedding", 60).collect()]
        assert [r.chunk_id for r in held.search(query, 60, probes=1, exact=True, space="a").collect()] == want
        assert held.search(query, 60, probes=1, space="a").count() <= 60
    exact = vector.semantic_neighbors(rows, "chunk_id", "embedding", 5)
    all_cells = held.neighbors("a", 5, probes=12, block=40)
    assert sorted((r.chunk_id, r.rank, r.neighbor) for r in all_cells.collect()) == sorted((r.chunk_id, r.rank, r.neighbor) for r in exact.collect())
    probes = held.probes_for("a", 0.95, 5)
    assert 1 <= probes < 12
    got = recall(held.neighbors("a", 5, probes), exact, "chunk_id").first()
    assert got.n_queries == 400 and got.n_found >= 0.9 * got.n_wanted


def test_vectors_move_to_blocks_not_to_cells(spark, tmp_path, monkeypatch):
    """However many cells are probed, a vector goes once to each block; its neighbours are the best of those cells."""
    rows = vectors(spark, 500).withColumn("embedding", F.when(F.col("chunk_id") % 5 > 1, F.array(*[F.lit(float(i % 3)) for i in range(16)])).otherwise(F.col("embedding")))
    held = VectorSpaces(spark, f"file://{tmp_path}/spaces")
    held.create("a", "f", 16)
    held.write("a", rows, cells=12)
    moved, compare = [], vector.best_of_blocks
    monkeypatch.setattr(vector, "best_of_blocks", lambda pairs, *rest: moved.append(pairs) or compare(pairs, *rest))
    v, cells = held.vectors("a").orderBy("chunk_id").toPandas(), held.cells("a")
    x = np.stack(v.v).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(x @ x.T, 9)
    near = np.stack(v.v).astype(float) @ np.array([c.centroid for c in cells]).T
    for probes, block in ((1, 40), (3, 40), (3, 4096), (len(cells), 40), (len(cells), 4096)):
        got = {(r.chunk_id, r["rank"]): r.neighbor for r in held.neighbors("a", 5, probes, block).collect()}
        want = {}
        for i, best in enumerate(np.argsort(-near, axis=1)[:, :probes]):
            probed = [j for j in np.flatnonzero(v.cell.isin([cells[k].cell for k in best])) if j != i]
            want |= {(i, k + 1): j for k, j in enumerate(sorted(probed, key=lambda j: (-score[i, j], j))[:5])}
        assert got == want
    assert max(c.n for c in cells) >= 300
    assert moved[-1].agg(F.sum(F.size("a")), F.max(F.size("c"))).first() == (500, 500)
    assert moved[1].agg(F.max(F.size("a"))).first()[0] < 100


def test_life_of_spaces(spark, tmp_path):
    rows = vectors(spark, 50)
    held = VectorSpaces(spark, f"file://{tmp_path}/spaces")
    for name, own in (("a", rows), ("holed", rows.where("chunk_id <> 7")), ("b", rows)):
        held.create(name, "f", 16)
        held.write(name, own)
    with pytest.raises(ValueError):
        held.create("a", "f", 16)
    with pytest.raises(ValueError, match="49 of 50"):
        held.activate("holed", rows)
    with pytest.raises(LookupError):
        held.search([1.0] * 16)
    held.activate("a", rows)
    held.activate("b", rows)
    assert held.active() == "b" and {r.space: r.state for r in held.registry().collect()} == {"a": "deprecated", "b": "ready", "holed": "ready"}
    with pytest.raises(ValueError):
        held.delete("b")
    held.activate("a", rows)
    held.delete("b")
    assert {r.space: (r.state, r.active) for r in held.registry().collect()} == {"a": ("ready", True), "b": ("deleted", False), "holed": ("ready", False)}
    with pytest.raises(Exception):  # noqa: B017
        held.vectors("b").count()
    with pytest.raises(ValueError):
        held.activate("b", rows)
    held.create("bad", "f", 16)
    with pytest.raises(Exception, match="invalid vector"):
        held.write("bad", spark.createDataFrame([(1, "h", [0.0] * 16)], rows.schema))


def test_a_killed_build_repeats_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, hashlib.sha256(b"%d" % (i % 30)).hexdigest(), f"text {i % 30}") for i in range(100)], "chunk_id long, content_hash string, text string")
    build = EmbeddingBuild(spark, f"file://{tmp_path}/build", "space")
    seen = spark.sparkContext.accumulator(0)

    def embed(text):
        @F.udf("array<float>")
        def one(t):
            seen.add(1)
            return [float(len(t))]

        return one(text)

    assert build.run(rows, embed, "text", size=4, stop_after=3) == 3
    part, left = build.done().count(), build.left(rows).count()
    assert 0 < part < 30 and seen.value == part and left == rows.join(build.done(), "content_hash", "left_anti").count() > 0
    (tmp_path / "build/space/unfinished").mkdir()  # a batch without its success file
    build.run(rows, embed, "text", size=4)
    assert build.done().count() == 30 == seen.value and build.left(rows).count() == 0
    assert build.run(rows, embed, "text", size=4) == 0


def test_numbers_in_few_bytes_come_back():
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 1 << int(b), int(n)) for b, n in zip(rng.integers(1, 31, 60), rng.integers(0, 40, 60), strict=True)]
    column = textindex._packed(np.concatenate(rows), np.cumsum([len(r) for r in rows]))
    assert [textindex._unpacked(column.slice(i, 1)).tolist() for i in range(60)] == [r.tolist() for r in rows]
    assert textindex._unpacked(column.slice(7, 30)).tolist() == np.concatenate(rows[7:37]).tolist()
    assert len(textindex._packed(np.zeros(1000, np.int32), np.array([1000]))[0].as_py()) == 1000  # an array of int takes 4,000


def test_a_block_is_indexed_in_little_memory():
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(97, 123, 4000))) + "ß中" for _ in range(200)]
    tracemalloc.start()
    textindex._block(texts, 0, "content")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * 800_000, peak
