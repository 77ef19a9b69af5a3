"""A typed property graph: building, links, bounded walks, comparison, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import decode_path
from siltstone.sources.scratch import written

EDGE = ["subject", "predicate", "object"]


def both_ways(edges: DataFrame, predicates: list[str] | None = None, skip: tuple[str, ...] = ("similar_to",)) -> DataFrame:
    """(here, there, subject, predicate, object): every edge from both of its ends, so that a walk is an equi-join."""
    kept = edges.where(F.col("predicate").isin(predicates)) if predicates else edges.where(~F.col("predicate").isin(*skip))
    out = kept.select(F.col("subject").alias("here"), F.col("object").alias("there"), *EDGE)
    return out.unionByName(kept.select(F.col("object").alias("here"), F.col("subject").alias("there"), *EDGE))


def neighborhood(edges: DataFrame, start: DataFrame, depth: int, predicates: list[str] | None = None) -> DataFrame:
    """(node, depth): every node within ``depth`` (1 to 4) steps of ``start`` (node), by the fewest steps.

    One join a step from the frontier alone; nodes reached before are taken out, so cycles end.
    """
    if not 1 <= depth <= 4:
        raise ValueError("depth must be from 1 to 4")
    steps = both_ways(edges, predicates).select("here", "there")
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for d in range(1, depth + 1):
        reached = frontier.join(steps, frontier["node"] == steps["here"]).select(F.col("there").alias("node")).distinct()
        frontier = written(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def neighborhood_edges(edges: DataFrame, nodes: DataFrame, predicates: list[str] | None = None, skip: tuple[str, ...] = ("similar_to",)) -> DataFrame:
    """Edges between visited nodes with the lesser depth of their ends."""
    kept = edges.where(F.col("predicate").isin(predicates)) if predicates else edges.where(~F.col("predicate").isin(*skip))
    a = nodes.select(F.col("node").alias("subject"), F.col("depth").alias("d1"))
    b = nodes.select(F.col("node").alias("object"), F.col("depth").alias("d2"))
    return kept.join(a, "subject").join(b, "object").select(*EDGE, F.least("d1", "d2").alias("depth"))


def shortest_path(edges: DataFrame, start: str, end: str, most: int = 4, predicates: list[str] | None = None) -> DataFrame:
    """(depth, path): the shortest path of at most ``most`` steps, of several the first in order; no row if there is none.

    Each step keeps only the first path to a node, so the rows are nodes, not walks.
    """
    steps = both_ways(edges, predicates).select("here", "there")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, 0, [start])], "node string, depth int, path array<string>")
    frontier = seen
    for d in range(1, most + 1):
        walked = frontier.join(steps, frontier["node"] == steps["here"]).select(F.col("there").alias("node"), F.lit(d).alias("depth"), F.concat("path", F.array("there")).alias("path"))
        fresh = walked.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min("depth").alias("depth"), F.min("path").alias("path"))
        frontier = written(fresh)
        seen = seen.unionByName(frontier)
        if not frontier.where(F.col("node") == end).isEmpty():
            break
    return seen.where(F.col("node") == end).select("depth", "path")


def links(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("subject") == node)


def backlinks(edges: DataFrame) -> DataFrame:
    """(object, n_links, n_subjects): how often and from how many nodes each is linked."""
    return edges.groupBy("object").agg(F.count("*").alias("n_links"), F.count_distinct("subject").alias("n_subjects"))


def generation_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change of added or removed, by EXCEPT both ways."""
    a, b = old.select(*keys), new.select(*keys)
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))


def relations(edges: DataFrame, registry: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``issue`` by the predicate registry (predicate, domain, range, symmetric); symmetric ones with their ends in order, repeats dropped.

    The registry is a list of predicates, a few dozen rows.
    """
    kind = nodes.select("node_id", "kind")
    r = F.broadcast(registry)
    held = edges.join(r, "predicate", "left")
    swap = F.coalesce(F.col("symmetric"), F.lit(False)) & (F.col("subject") > F.col("object"))
    held = held.withColumn("s", F.when(swap, F.col("object")).otherwise(F.col("subject"))).withColumn("o", F.when(swap, F.col("subject")).otherwise(F.col("object")))
    held = held.join(kind.select(F.col("node_id").alias("s"), F.col("kind").alias("s_kind")), "s", "left").join(kind.select(F.col("node_id").alias("o"), F.col("kind").alias("o_kind")), "o", "left")
    issue = F.when(F.col("domain").isNull(), "unknown_predicate").when(F.col("s_kind").isNull() | F.col("o_kind").isNull(), "missing_node")
    issue = issue.when(~F.array_contains("domain", F.col("s_kind")), "domain").when(~F.array_contains("range", F.col("o_kind")), "range")
    return held.select(F.col("s").alias("subject"), "predicate", F.col("o").alias("object"), issue.alias("issue")).distinct()


def references(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, kind, target): wiki links, embeds, relative links and citations, line by line."""
    lines = texts.select(key, F.posexplode(F.split(text, "\\r?\\n")).alias("at", "l"))
    patterns = [
        ("embed", "!\\[\\[([^\\]]+)\\]\\]"),
        ("wiki", "(?<!!)\\[\\[([^\\]]+)\\]\\]"),
        ("markdown", "(?<!!)\\[[^\\]]*\\]\\(([^)]+)\\)"),
        ("citation", "\\[@([^\\]]+)\\]"),
    ]

    def of_kind(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("l", F.lit(pattern), F.lit(1)), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("target")))

    found = [of_kind(*x) for x in patterns]
    out = lines.select(key, (F.col("at") + 1).alias("line"), F.explode(F.concat(*found)).alias("r")).select(key, "line", "r.kind", F.trim("r.target").alias("target"))
    named = F.col("kind").isin("wiki", "embed")
    out = out.withColumn("target", F.when(named, F.trim(F.element_at(F.split("target", "\\|"), 1))).otherwise(F.col("target")))
    return out.where("target <> ''").where(~((F.col("kind") == "markdown") & F.col("target").rlike("(?i)^[a-z]+://")))


def link_keys(documents: DataFrame) -> DataFrame:
    """(link_key, document_id): all names by which a document (document_id, path, title) can be meant.

    Its path, that without .md, every tail of the path, and its title; so that resolving is an equi-join.
    """
    path = F.lower("path")
    parts = F.split(path, "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    bare = F.transform(tails, lambda t: F.regexp_replace(t, "\\.md$", ""))
    names = F.array_distinct(F.filter(F.concat(tails, bare, F.array(F.lower("title"))), lambda n: n.isNotNull() & (n != "")))
    return documents.select(F.explode(names).alias("link_key"), "document_id")


def resolve_links(refs: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """refs with the number of documents meant, and resolved, ambiguous or missing; the first one's id if resolved."""
    name = F.lower(decode_path(F.trim(F.element_at(F.split("target", "#"), 1))))
    wanted = refs.withColumn("link_key", F.regexp_replace(name, "^(\\.{0,2}/)+", ""))
    counts = link_keys(documents).groupBy("link_key").agg(F.count_distinct("document_id").alias("n_targets"), F.min("document_id").alias("document_id"))
    joined = wanted.join(counts, "link_key", "left").withColumn("n_targets", F.coalesce("n_targets", F.lit(0)))
    state = F.when(F.col("n_targets") == 1, "resolved").when(F.col("n_targets") > 1, "ambiguous").otherwise("missing")
    return joined.withColumn("state", state).withColumn("document_id", F.when(F.col("n_targets") == 1, F.col("document_id")))


def redirects(pairs: DataFrame, most: int = 32) -> DataFrame:
    """(entity, final) of merged entities by pointer jumping; a cycle gives a null ``final``.

    Steps double, so ``most`` rounds follow chains of 2^most merges; it stops when nothing moves.
    """
    now = pairs.select(F.col("from").alias("entity"), F.col("to").alias("final"))
    for _ in range(most):
        step = now.select(F.col("entity").alias("final"), F.col("final").alias("next"))
        jumped = now.join(step, "final", "left").select("entity", F.coalesce("next", "final").alias("final"))
        jumped = written(jumped)
        open_ = jumped.join(now.select(F.col("entity").alias("final")).distinct(), "final", "left_semi")
        loops = open_.where("entity = final")
        if open_.join(loops.select("entity"), "entity", "left_anti").isEmpty():
            now = jumped
            break
        now = jumped
    inner = now.join(pairs.select(F.col("from").alias("final")).distinct().withColumn("inner", F.lit(True)), "final", "left")
    return inner.select("entity", F.when(F.col("inner").isNull(), F.col("final")).alias("final"))


def verify(nodes: DataFrame, edges: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(check, id) of what a generation must not have: edges or claims without their nodes, claims without evidence, repeated edges."""
    ids = nodes.select(F.col("node_id").alias("id"))
    bad = edges.select(F.col("subject").alias("id")).join(ids, "id", "left_anti").select(F.lit("edge_subject").alias("check"), "id")
    bad = bad.unionByName(edges.select(F.col("object").alias("id")).join(ids, "id", "left_anti").select(F.lit("edge_object").alias("check"), "id"))
    bad = bad.unionByName(claims.select(F.col("subject").alias("id")).join(ids, "id", "left_anti").select(F.lit("claim_subject").alias("check"), "id"))
    bad = bad.unionByName(claims.select(F.col("claim_id").alias("id")).join(evidence.select(F.col("claim_id").alias("id")), "id", "left_anti").select(F.lit("claim_evidence").alias("check"), "id"))
    twice = edges.groupBy(*EDGE).count().where("count > 1").select(F.lit("edge_repeated").alias("check"), F.concat_ws("|", *EDGE).alias("id"))
    return bad.unionByName(twice).distinct()


def carry_forward(old: DataFrame, gone: DataFrame) -> DataFrame:
    """Last generation's edges with ``status`` stale where an end is among ``gone`` (node)."""
    g = gone.select("node").distinct()
    hit = old.join(g, old["subject"] == g["node"], "left_semi").select(*EDGE).unionByName(old.join(g, old["object"] == g["node"], "left_semi").select(*EDGE)).distinct()
    return old.join(hit.withColumn("hit", F.lit(True)), EDGE, "left").withColumn("status", F.when(F.col("hit"), "stale").otherwise("accepted")).drop("hit")


def contains_edges(table: DataFrame, parent: Column, child: Column) -> DataFrame:
    """``contains`` edges of a hierarchy."""
    return table.select(parent.alias("subject"), F.lit("contains").alias("predicate"), child.alias("object")).where("subject is not null and object is not null")


OPEN_SETS = ["proposed", "confirmed", "partially_resolved"]


def resolve_implicit(sets: DataFrame, members: DataFrame, claims: DataFrame) -> DataFrame:
    """``sets`` (conflict_id, status) with open ones resolved where no member claim states a scope.

    ``members``: conflict_id, claim_id. ``claims``: claim_id, conflict_scope; a blank scope is none.
    """
    scoped = claims.where(F.trim(F.coalesce("conflict_scope", F.lit(""))) != "").select("claim_id")
    held = members.join(scoped, "claim_id", "left_semi").select("conflict_id").distinct().withColumn("stated", F.lit(True))
    after = F.when(F.col("status").isin(*OPEN_SETS) & F.col("stated").isNull(), "resolved").otherwise(F.col("status"))
    return sets.join(held, "conflict_id", "left").withColumn("status", after).drop("stated")


def conflict_details(members: DataFrame, claims: DataFrame) -> DataFrame:
    """(conflict_id, n_claims, n_positions, least, most): what a conflict set holds. ``claims``: claim_id, position."""
    held = members.join(claims.select("claim_id", "position"), "claim_id")
    return held.groupBy("conflict_id").agg(F.count_distinct("claim_id").alias("n_claims"), F.count_distinct("position").alias("n_positions"), F.min("position").alias("least"), F.max("position").alias("most"))


def bounded_neighborhood(edges: DataFrame, start: DataFrame, depth: int, most_nodes: int = 500, most_edges: int = 1000) -> DataFrame:
    """EDGE, depth, truncated: the nearest ``most_nodes`` nodes' first ``most_edges`` edges, and whether there are more.

    The limits are the feature; both are top-k selections, so only their rows reach one task.
    """
    nodes = written(neighborhood(edges, start, depth))
    order = [F.col("depth"), F.col("node")]
    kept = nodes.orderBy(*order).limit(most_nodes)
    found = written(neighborhood_edges(edges, kept).orderBy("depth", *EDGE).limit(most_edges + 1))
    more = (nodes.count() > most_nodes) or (found.count() > most_edges)
    return found.orderBy("depth", *EDGE).limit(most_edges).withColumn("truncated", F.lit(more))
