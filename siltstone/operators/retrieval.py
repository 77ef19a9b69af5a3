"""Fusion, hybrid search, depth presets and evidence under a token budget."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.text import excerpt
from siltstone.operators import fulltext, ordered, vector
from siltstone.operators.textindex import TextIndex

RRF_K = 60
TITLE_BOOST = 0.01
#: A context takes no further item when fewer tokens than this are left.
LEAST_LEFT = 64


@dataclass(frozen=True)
class RetrievalPlan:
    seeds: int
    claims: int
    budget: int
    graph_depth: int


# The depth presets.
PLANS = {"shallow": RetrievalPlan(6, 8, 2400, 1), "normal": RetrievalPlan(12, 20, 6000, 1), "deep": RetrievalPlan(20, 40, 12000, 2)}


def retrieval_plan(depth: str = "normal", budget: int | None = None) -> RetrievalPlan:
    p = PLANS[depth]
    return RetrievalPlan(p.seeds, p.claims, budget or p.budget, p.graph_depth)


def _instant(text: str | None) -> datetime | None:
    """An ISO 8601 time; UTC where it names no zone. Anything else is an error."""
    found = datetime.fromisoformat(text) if text is not None else None
    return found.replace(tzinfo=UTC) if found and found.tzinfo is None else found


@dataclass(frozen=True)
class Filters:
    """What a search is narrowed to; all of it is applied before the candidates are cut."""

    source: str | None = None
    path_prefix: str | None = None
    media_type: str | None = None
    tag: str | None = None
    since: str | None = None
    until: str | None = None

    def __post_init__(self):
        since, until = (_instant(x) for x in (self.since, self.until))
        if since and until and since > until:
            raise ValueError("since is after until")

    def condition(self) -> Column:
        held = F.lit(True)
        if self.source is not None:
            held = held & (F.col("source") == self.source)
        if self.path_prefix is not None:
            held = held & F.startswith(F.col("path"), F.lit(self.path_prefix))
        if self.media_type is not None:
            held = held & (F.col("media_type") == self.media_type)
        if self.tag is not None:
            held = held & F.array_contains("tags", self.tag)
        if self.since is not None:
            held = held & (F.col("updated_at") >= F.lit(_instant(self.since)))
        if self.until is not None:
            held = held & (F.col("updated_at") <= F.lit(_instant(self.until)))
        return held

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.where(self.condition())


def candidates(limit: int) -> int:
    """How many rows each route brings."""
    return min(100, max(4 * limit, 20))


def fuse(routes: dict[str, DataFrame], key: str, weights: dict[str, float] | None = None) -> DataFrame:
    """key, score, routes by reciprocal rank: the sum of weight / (60 + rank) over routes of (key, rank)."""
    both = None
    for name, rows in routes.items():
        w = (weights or {}).get(name, 1.0)
        one = rows.select(key, F.lit(name).alias("route"), F.col("rank").cast("long").alias("rank"), (F.lit(w) / (RRF_K + F.col("rank"))).alias("part"))
        both = one if both is None else both.unionByName(one)
    return both.groupBy(key).agg(F.sum("part").alias("score"), F.array_sort(F.collect_list(F.struct("route", "rank"))).alias("routes"))


def top(fused: DataFrame, key: str, limit: int) -> DataFrame:
    return fused.orderBy(F.round("score", 9).desc(), key).limit(limit)


@dataclass
class SearchResult:
    """Rows of a search, what it could not do, and what it did."""

    rows: DataFrame
    warnings: list[str] = field(default_factory=list)
    trace: dict[str, object] = field(default_factory=dict)


def hybrid_search(
    chunks: DataFrame, query: str, key: str = "chunk_id", limit: int = 20, mode: str = "hybrid", vectors: DataFrame | None = None, query_vector: list[float] | None = None,
    filters: Filters | None = None, fields: dict[str, float] | None = None, covered: bool = True, index: TextIndex | None = None,
) -> SearchResult:
    """Search ``chunks`` (key, content, title, ...) by text, by ``vectors`` (key, embedding), or by both.

    Without a complete vector space a hybrid search falls back to text and warns.
    With an ``index`` of the chunks the text route reads its postings; it must keep the
    columns that ``filters`` name. Only the candidates, at most 100 a route, meet the
    chunks again: their keys are in the plan, so the scan skips what holds none of them.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be from 1 to 100")
    out = SearchResult(chunks, trace={"mode": mode, "candidates": candidates(limit)})
    rows = (filters or Filters()).apply(chunks)
    routes = {}
    if mode in ("text", "hybrid"):
        weights = fields or {"content": 1.0, "title": 1.5}
        if index is not None and fulltext.query_tokens(query):
            routes["fts"] = fulltext.ranked(index.search(query, weights, candidates(limit), (filters or Filters()).condition()), key)
        else:
            routes["fts"] = fulltext.search(rows, query, key, weights, "content", candidates(limit))
    if mode in ("vector", "hybrid"):
        if vectors is not None and query_vector is not None and covered:
            near = vector.nearest(vectors.join(rows.select(key), key, "left_semi"), query_vector, key, "embedding", candidates(limit))
            routes["vector"] = near.withColumn("rank", F.row_number().over(Window.orderBy(F.round("similarity", 9).desc(), key)))
        elif mode == "vector":
            raise ValueError("no complete vector space")
        else:
            out.warnings.append("vector space incomplete: text only")
    fused = fuse(routes, key)
    found = [r[key] for r in fused.select(key).collect()]  # at most 200 candidates
    held = rows.where(F.col(key).isin(found)).join(F.broadcast(fused), key)
    boosted = F.col("score") + F.when(F.contains(F.lower("title"), F.lit(query.lower())), TITLE_BOOST).otherwise(0.0)
    first = (fulltext.query_tokens(query) or [query])[0]
    out.rows = top(held.withColumn("score", boosted).withColumn("excerpt", excerpt("content", first)), key, limit)
    return out


def budget_cut(rows: DataFrame, order: list, tokens: str, budget: int, partition: list[str] | None = None) -> DataFrame:
    """Rows in order while ``LEAST_LEFT`` tokens are left; the last one is clipped to what is left: adds ``position``, ``used`` and ``taken``.

    Without a partition the rows are one context, a cut result; partitions in the order of columns may be of any size.
    """
    if partition and all(isinstance(c, str) for c in order):
        marked = ordered.running_sum(rows, partition, order, tokens).withColumnRenamed("before", "used")
    else:
        w = Window.partitionBy(*(partition or [])).orderBy(*order)
        before = F.coalesce(F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        marked = rows.withColumn("position", F.row_number().over(w).cast("long")).withColumn("used", before.cast("long"))
    left = F.lit(budget) - F.col("used")
    return marked.where(left >= LEAST_LEFT).withColumn("taken", F.least(F.col(tokens), left).cast("long"))


def assemble_context(seeds: DataFrame, graph: DataFrame, budget: int) -> DataFrame:
    """Evidence in order: graph items before seeds, each (chunk, claim) once, under the budget.

    ``seeds`` has chunk_id, position, token_estimate, content; ``graph`` also claim_id
    and role. Both are cut results of a search, a few hundred rows at most.
    """
    none = F.lit(None).cast("string")
    g = graph.select("chunk_id", "claim_id", F.lit(0).alias("part"), "position", "token_estimate", "content", F.when(F.col("role") == "contradict", "graph_contradict").otherwise("graph_support").alias("role"))
    s = seeds.select("chunk_id", none.alias("claim_id"), F.lit(1).alias("part"), "position", "token_estimate", "content", F.lit("seed").alias("role"))
    both = g.unionByName(s)
    once = Window.partitionBy("chunk_id", "claim_id").orderBy("part", "position")
    both = both.withColumn("again", F.row_number().over(once)).where("again = 1").drop("again").withColumnRenamed("position", "rank")
    cut = budget_cut(both, ["part", "rank", "chunk_id"], "token_estimate", budget)
    end = F.least(F.length("content"), F.greatest(F.lit(1), F.col("taken") * 4))
    return cut.select(F.concat(F.lit("E"), "position").alias("evidence_key"), "position", "chunk_id", "claim_id", "role", "taken", F.substr("content", F.lit(1), end).alias("excerpt"))


#: Quotes with fewer letters and digits are found exactly or not at all.
LEAST_NEAR = 4


@cache
def _plain(character: str) -> str:
    folded = unicodedata.normalize("NFKC", character).lower()
    return "".join(c for c in folded if unicodedata.category(c)[0] in "LN")


def near(quote: str | None, content: str | None) -> tuple[int, int] | None:
    """Start, from 1, and length in ``content`` of a quote by its letters and digits alone, each in NFKC and lower case."""
    wanted = "".join(map(_plain, quote or ""))
    if len(wanted) < LEAST_NEAR:
        return None
    parts = [_plain(c) for c in content or ""]
    at = "".join(parts).find(wanted)
    if at < 0:
        return None
    places = [i for i, p in enumerate(parts) for _ in p]  # of every folded character its own
    first, last = places[at], places[at + len(wanted) - 1]
    return first + 1, last - first + 1


def locate(quote: Column, content: Column) -> Column:
    """struct(start, length, exact): where a quote stands, from 1 and in characters, exactly or by its letters and digits; null if nowhere.

    A near match is mapped back: it covers the original's characters from the first
    to the last that took part, whatever stands between them.
    """

    @F.pandas_udf("struct<start:int,length:int,exact:boolean>")
    def by_letters(quotes: pd.Series, contents: pd.Series) -> pd.DataFrame:
        found = [near(q, c) for q, c in zip(quotes, contents, strict=True)]
        columns = {"start": [f and f[0] for f in found], "length": [f and f[1] for f in found]}
        return pd.DataFrame(columns, dtype="Int32").assign(exact=pd.array([f and False for f in found], dtype="boolean"))

    at = F.instr(content, quote)
    exact = (F.length(quote) >= 1) & (at > 0)
    # texts of exact matches don't enter Python
    left = by_letters(F.when(~F.coalesce(exact, F.lit(False)), quote), F.when(~F.coalesce(exact, F.lit(False)), content))
    found = F.when(exact, F.struct(at.cast("int").alias("start"), F.length(quote).alias("length"), F.lit(True).alias("exact")))
    return found.when(left["start"].isNotNull(), left)


def validate_answer(statements: DataFrame, evidence: DataFrame) -> DataFrame:
    """Statements (statement_id, kind, text, evidence_keys) with the label their citations bear out, or why they fail."""
    cited = statements.select("statement_id", "kind", "text", F.explode_outer("evidence_keys").alias("evidence_key")).join(evidence, "evidence_key", "left")
    per = cited.groupBy("statement_id", "kind").agg(
        F.count_if(F.col("content").isNotNull()).alias("found"), F.count_if(F.col("evidence_key").isNotNull() & F.col("content").isNull()).alias("unknown"),
        F.count_distinct("source_id").alias("sources"), F.bool_or(F.coalesce(F.col("claim_status") == "disputed", F.lit(False))).alias("disputed"),
        F.bool_or(F.coalesce(F.contains("content", F.col("text")), F.lit(False))).alias("quoted"),
    )
    error = F.when(F.col("unknown") > 0, "unknown_evidence").when(F.col("found") == 0, "citation_required")
    error = error.when((F.col("kind") == "inference") & (F.col("found") < 2), "inference_needs_two").when((F.col("kind") == "fact") & ~F.col("quoted"), "not_in_evidence")
    label = F.when(F.col("disputed"), "conflict").when((F.col("kind") == "fact") & (F.col("sources") < 2), "single_source").otherwise(F.col("kind"))
    return per.select("statement_id", error.alias("error"), F.when(error.isNull(), label).alias("label"))
