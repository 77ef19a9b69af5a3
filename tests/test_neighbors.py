"""Neighbours among many equal vectors."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import vector


@pytest.mark.parametrize("block", [16, 4096])
def test_equal_vectors(spark, block):
    rnd = np.random.default_rng(3)
    same = rnd.normal(size=8)
    rows = [(i, [float(x) for x in (same if i % 2 else rnd.normal(size=8))]) for i in rnd.permutation(120).tolist()]
    v = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    at = {i: np.asarray(x, np.float32).astype(float) for i, x in rows}
    got = {}
    for r in vector.semantic_neighbors(v, "id", "embedding", 8, block).collect():
        got.setdefault(r.id, {})[r.rank] = r.neighbor
    for i, x in at.items():
        score = {j: round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 9) for j, y in at.items() if j != i}
        want = sorted(score, key=lambda j: (-score[j], j))[:8]
        assert [got[i][k] for k in range(1, 9)] == want


def test_slices_of_large_blocks(spark, monkeypatch):
    """Answers come in slices; a block's best and their ties are those of one product."""
    monkeypatch.setattr(vector, "ASKING", 7)
    monkeypatch.setattr(vector, "ANSWERING", 11)
    monkeypatch.setattr(vector, "FIRST", 9)
    test_equal_vectors(spark, 4096)
    test_equal_vectors(spark, 40)


def test_vectors_go_to_as_many_blocks_as_before_when_there_are_more(spark):
    """Twice the vectors are twice the rows of a fixed number of blocks, up to the size of a block."""
    rows = lambda n: spark.range(n).select("id", F.array(*[F.rand(i).cast("float") for i in range(4)]).alias("embedding"))
    plans = [vector.semantic_neighbors(rows(n), "id", "embedding")._jdf.queryExecution().analyzed().toString() for n in (20_000, 40_000)]
    assert [re.findall(r"sequence\(0, (\d+)", p) for p in plans] == [["3", "3"]] * 2
