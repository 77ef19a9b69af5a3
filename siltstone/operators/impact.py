"""What hangs on a resource, over all kinds at once, and plans that hold only while that stays so.

``closure`` walks from a start along every link table to a fixed point. A round joins
the frontier, what was first reached in the round before, with each table by a
semi-join and drops what is known by an anti-join, which kinds met for the first time
need not; whole numbers move as such. Rounds end when nothing is new, so cycles end too. Only each round's count reaches the driver.

A plan keeps the digest of a closure and of the rows in it. It is refused when it has
expired, when it was applied before, or when the closure has another digest by then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources import digests
from siltstone.sources.scratch import written

#: Minutes that a plan can be applied.
MINUTES = 15
#: Rounds of a walk: more links in a row are an error.
MOST_ROUNDS = 1000
PLAN = "plan_id string, action string, digest string, n long, created_at timestamp, expires_at timestamp"


WHOLE = ("tinyint", "smallint", "int", "bigint")


def _dependents(frontier: DataFrame, kind: str, table: DataFrame, a: str, b: str) -> DataFrame:
    """(id) of the dependents that ``table`` gives to the frontier's resources of one kind."""
    pairs = table.select(F.col(a).alias("id"), F.col(b).alias("to")).where("id is not null and to is not null")
    known, held = frontier.where(F.col("kind") == kind).select("id"), dict(pairs.dtypes)["id"]
    if held in WHOLE:
        known = known.select(F.col("id").try_cast(held).alias("n"), "id").where(F.col("n").cast("string") == F.col("id")).select(F.col("n").alias("id"))
    else:
        pairs = pairs.withColumn("id", F.col("id").cast("string"))
    return pairs.join(known, "id", "left_semi").select(F.col("to").cast("string").alias("id"))


def closure(start: DataFrame, links: list[tuple[str, str, DataFrame, str, str]]) -> DataFrame:
    """(kind, id, depth) of ``start`` (kind, id) and all that hangs on it.

    A link is (kind, dependent kind, table, column of the id, column of the dependent's id). Rows with a null id link nothing.
    """
    frontier = written(start.select("kind", F.col("id").cast("string").alias("id")).where("id is not null").distinct().withColumn("depth", F.lit(0)))
    reached, met = frontier, set()
    for depth in range(1, MOST_ROUNDS):
        kinds = {r.kind for r in frontier.select("kind").distinct().collect()}  # as many as there are kinds
        met |= kinds
        found: dict[str, DataFrame] = {}
        for kind, target, table, a, b in links:
            if kind in kinds:
                hit = _dependents(frontier, kind, table, a, b)
                found[target] = found[target].unionByName(hit) if target in found else hit
        if not found:
            return reached
        fresh = None
        for target, ids in found.items():
            new = ids.distinct()
            if target in met:
                new = new.join(reached.where(F.col("kind") == target).select("id"), "id", "left_anti")
            new = new.select(F.lit(target).alias("kind"), "id", F.lit(depth).alias("depth"))
            fresh = new if fresh is None else fresh.unionByName(new)
        frontier = written(fresh)
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
    raise RecursionError(f"links go on for {MOST_ROUNDS} rounds")


def counts(reached: DataFrame) -> DataFrame:
    """kind, depth, n."""
    return reached.groupBy("kind", F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"))


def with_state(reached: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(kind, id, before): a hash of each reached resource's row; ``tables``: kind to (table, id column)."""
    out = None
    for kind, (rows, key) in tables.items():
        row = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
        one = rows.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), row.alias("before")).join(reached.where(F.col("kind") == kind).select("id"), "id", "left_semi")
        out = one if out is None else out.unionByName(one.select(*out.columns))
    return out.select("kind", "id", "before")


class Plans:
    """Plans under one folder, each a row and the resources that it changes."""

    def __init__(self, spark: SparkSession, root: str, now: Callable[[], datetime] = lambda: datetime.now(UTC)):
        self.spark, self.root, self.now = spark, root.rstrip("/"), now

    def _digest(self, changes: DataFrame):
        line = changes.select(F.concat_ws("|", "kind", "id").alias("key"), "before")
        return digests.root(line, "key", "before").first()

    def create(self, action: str, changes: DataFrame, minutes: int = MINUTES) -> str:
        """A plan to do ``action`` to (kind, id, before)."""
        plan, found, now = uuid.uuid4().hex, self._digest(changes), self.now()
        changes.write.parquet(f"{self.root}/changes/plan={plan}")
        row = [(plan, action, found.watermark, found.n, now, now + timedelta(minutes=minutes))]
        self.spark.createDataFrame(row, PLAN).coalesce(1).write.mode("append").parquet(f"{self.root}/plans")
        return plan

    def listed(self) -> DataFrame:
        """All plans with their state: applied, expired or open."""
        rows = self.spark.read.schema(PLAN).parquet(f"{self.root}/plans")
        applied = self._applied()
        state = F.when(F.col("operation_id").isNotNull(), "applied").when(F.col("expires_at") < F.lit(self.now()), "expired").otherwise("open")
        return rows.join(applied, "plan_id", "left").withColumn("state", state)

    def _applied(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/operations")
        schema = "plan_id string, operation_id string"
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(str(path)) if there else self.spark.createDataFrame([], schema)

    def changes(self, plan: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/changes/plan={plan}")

    def apply(self, plan: str, present: DataFrame, do: Callable[[DataFrame], None]) -> str:
        """``do`` the plan's changes if ``present``, the same closure as it is now, has the plan's digest. Returns an operation id."""
        found = self.listed().where(F.col("plan_id") == plan).first()
        if found is None:
            raise LookupError(f"no plan {plan}")
        if found.state != "open":
            raise ValueError(f"plan {plan} is {found.state}")
        if self._digest(present).watermark != found.digest:
            raise ValueError(f"plan {plan} is stale: what it changes is not what it was")
        do(self.changes(plan))
        operation = uuid.uuid4().hex
        self.spark.createDataFrame([(plan, operation)], "plan_id string, operation_id string").coalesce(1).write.mode("append").parquet(f"{self.root}/operations")
        return operation
