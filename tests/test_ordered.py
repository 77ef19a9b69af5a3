"""Running sums and rows before, against plain windows, with one key that has most rows."""

import random

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators import ordered, retrieval, versioning


def table(spark, n=3000):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else rng.choice(["a", "b", None]), i, rng.choice([None, 0, 3, 70]), rng.choice("xy")) for i in range(n)]
    return spark.createDataFrame(rows, "k string, at long, v long, d string").repartition(5)


def test_running_sum_and_previous(spark):
    rows = table(spark)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows would be one part
    try:
        compare(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def compare(spark, rows):
    w = Window.partitionBy("k").orderBy("at")
    want = rows.withColumns({"position": F.row_number().over(w).cast("long"), "before": F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    got = ordered.running_sum(rows, ["k"], ["at"], "v")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    want = rows.withColumn("previous", F.lag(F.struct("at", "d")).over(w))
    got = ordered.previous(rows, ["k"], ["at"], ["at", "d"])
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert ordered.dealt(rows, ["k"], ["at"]).where("k = 'hot'").select("_part").distinct().count() > 1
    assert ordered.running_sum(rows.limit(0), ["k"], ["at"], "v").count() == ordered.previous(rows.limit(0), ["k"], ["at"], ["d"]).count() == 0


def test_budget_and_revisions(spark):
    rows = table(spark, 300).withColumn("v", F.coalesce("v", F.lit(5)))
    w = Window.partitionBy("k").orderBy("at")
    used = F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = rows.withColumn("used", used).where(500 - F.col("used") >= 64).select("k", "at", "used")
    assert sorted(map(str, retrieval.budget_cut(rows, ["at"], "v", 500, ["k"]).select("k", "at", "used").collect())) == sorted(map(str, want.collect()))
    again = F.lag("d").over(w).eqNullSafe(F.col("d")) & (F.row_number().over(w) > 1)
    want = rows.withColumn("reused", again).withColumn("sequence", F.sum(F.when(F.col("reused"), 0).otherwise(1)).over(w))
    got = versioning.revisions(rows, "k", ["at"], "d")
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_pairs_of_documents_move_texts_not_tokens(spark, monkeypatch):
    from siltstone.plans import catalog

    seen, real = [], ordered.previous
    monkeypatch.setattr(ordered, "previous", lambda rows, *rest: (seen.append(dict(rows.dtypes)), real(rows, *rest))[1])
    catalog.chunk_jaccard_pairs(spark, "/root/testdata/sf0.001")
    assert seen and "array<string>" not in seen[0].values()
