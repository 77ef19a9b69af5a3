"""Topic pages as typed components: what a page says, what it rests on, and which parts a new build can keep.

A page is two tables. ``items`` has a row for everything shown: (topic, component, kind,
item_id, item), an item being one JSON object. ``components`` has a row for each part of
a page with its number of items, a digest of its content and one of its dependencies.
The digests add up hashes of rows, so they are partial sums before any exchange and no
topic's items ever meet in one place; a topic may have any number of claims. A page's
own JSON lists its components, a dozen at most.

Kinds of component: hero (one), a set of cards for each conclusion type but conflicts,
evidence, timeline (claims with a time), comparison (topics of two claims or more),
graph, conflicts, gaps, sources. Components without items don't exist, but for hero.
Null topics are a topic of their own; repeated rows are repeated items.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.topics import level_of, rank_of

#: Order of the components on a page, with their kinds; cards are one component for each type.
KINDS = {"hero": "hero", "cards": "conclusion_cards", "evidence": "evidence_blocks", "timeline": "timeline", "comparison": "comparison_matrix", "graph": "knowledge_graph", "conflicts": "conflicts", "gaps": "knowledge_gaps", "sources": "source_directory"}
#: Hexadecimal digits of a hash that are added up as one number, and how many numbers.
DIGITS, LIMBS = 15, 4


def _item(topic: str, rows: DataFrame, component: Column, kind: str, item_id: Column, **values) -> DataFrame:
    body = F.to_json(F.struct(*[c.alias(k) for k, c in values.items()]), {"ignoreNullFields": "false"})
    return rows.select(topic, component.alias("component"), F.lit(KINDS[kind]).alias("kind"), item_id.cast("string").alias("item_id"), body.alias("item"))


def items(topic: str, reports: DataFrame, claims: DataFrame, evidence: DataFrame, relations: DataFrame, gaps: DataFrame) -> DataFrame:
    """Everything on the pages.

    ``reports``: see ``topics.report``. ``claims``: topic, claim_id, statement, conclusion_type,
    confidence_level, independent_source_count, valid_from, valid_to (strings). ``evidence``:
    claim_id, chunk_id, source_id. ``relations``: topic, relation_id, subject, predicate, object.
    ``gaps``: topic, severity, question.
    """
    c = F.col
    cited = claims.select(topic, "claim_id").join(evidence.select("claim_id", "chunk_id", "source_id"), "claim_id")
    several = claims.groupBy(topic).agg(F.count("*").alias("n")).where("n > 1").select(topic)
    of_sources = cited.groupBy(topic, "source_id").agg(F.count("*").alias("n"))
    conflict = c("conclusion_type") == "conflict"
    card = {"claim": c("claim_id"), "statement": c("statement"), "confidence": c("confidence_level")}
    parts = [
        _item(topic, reports, F.lit("hero"), "hero", c(topic), health=c("health_status"), confidence=c("confidence_level"), claims=c("n_claims"), rule=c("decisive_rule")),
        _item(topic, claims.where(~conflict), F.concat(F.lit("cards-"), "conclusion_type"), "cards", c("claim_id"), **card),
        _item(topic, cited, F.lit("evidence"), "evidence", c("chunk_id"), claim=c("claim_id"), chunk=c("chunk_id"), source=c("source_id")),
        _item(topic, claims.where("valid_from is not null or valid_to is not null"), F.lit("timeline"), "timeline", c("claim_id"), claim=c("claim_id"), start=c("valid_from"), end=c("valid_to")),
        _item(topic, claims.join(several, topic, "left_semi"), F.lit("comparison"), "comparison", c("claim_id"), claim=c("claim_id"), category=c("conclusion_type"), sources=c("independent_source_count")),
        _item(topic, relations, F.lit("graph"), "graph", c("relation_id"), source=c("subject"), label=c("predicate"), target=c("object")),
        _item(topic, claims.where(conflict), F.lit("conflicts"), "conflicts", c("claim_id"), **card),
        _item(topic, gaps, F.lit("gaps"), "gaps", F.sha2("question", 256), severity=c("severity"), question=c("question")),
        _item(topic, of_sources, F.lit("sources"), "sources", c("source_id"), source=c("source_id"), citations=c("n")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _limbs(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with the first digits of a hash of ``value`` as LIMBS numbers, ``name`` and 0 to 3."""
    cut = lambda k: F.conv(F.substring("_h", 1 + DIGITS * k, DIGITS), 16, 10).cast("long")
    return rows.withColumn("_h", F.sha2(value, 256)).withColumns({f"{name}{k}": cut(k) for k in range(LIMBS)}).drop("_h")


def added_up(name: str) -> Column:
    """A digest of a multiset of strings as an aggregate: the same in any order, from sums alone.

    A limb's 60 bits are added up as three long sums of 20 each, which is far cheaper than a decimal for each row.
    """
    part = lambda k, at: F.sum(F.shiftright(f"{name}{k}", at).bitwiseAND(F.lit((1 << 20) - 1))).cast("decimal(20,0)")
    whole = lambda k: part(k, 40) * F.lit(1 << 40).cast("decimal(14,0)") + part(k, 20) * F.lit(1 << 20).cast("decimal(14,0)") + part(k, 0)
    return F.sha2(F.concat_ws("|", F.count("*").cast("string"), *[whole(k).cast("decimal(38,0)").cast("string") for k in range(LIMBS)]), 256)


def components(found: DataFrame, topic: str) -> DataFrame:
    """(topic, component, kind, n_items, content_hash, dependency_hash) of ``items``."""
    hashed = _limbs(_limbs(found, "_c", F.concat_ws("\n", "item_id", "item")), "_d", F.col("item_id")).drop("item_id", "item")
    return hashed.groupBy(topic, "component", "kind").agg(F.count("*").alias("n_items"), added_up("_c").alias("content_hash"), added_up("_d").alias("dependency_hash"))


def rated(parts: DataFrame, claims: DataFrame, topic: str) -> DataFrame:
    """``components`` with the confidence and health of those that conclusions make up; null for the rest."""
    own = F.when(F.col("conclusion_type") == "conflict", "conflicts").otherwise(F.concat(F.lit("cards-"), "conclusion_type"))
    best = claims.groupBy(topic, own.alias("component")).agg(F.max(rank_of(F.col("confidence_level"))).alias("best"))
    against, alone = F.col("component") == "conflicts", F.col("component") == "cards-single_source"
    level = F.when(F.col("best").isNotNull(), F.when(against, "disputed").otherwise(level_of(F.col("best"))))
    health = F.when(F.col("best").isNotNull(), F.when(against, "needs_review").when(alone, "degraded").otherwise("healthy"))
    return parts.join(best, [topic, "component"], "left").withColumns({"confidence_level": level, "health_status": health}).drop("best")


def invalid(found: DataFrame, parts: DataFrame, topic: str) -> DataFrame:
    """(topic, component): parts of an unknown kind, without items, or whose digests aren't those of their items."""
    keys = [topic, "component", "kind", "n_items", "content_hash", "dependency_hash"]
    right = parts.select(*keys).join(components(found, topic), keys, "left_semi").where(F.col("kind").isin(*KINDS.values()))
    return parts.select(topic, "component").exceptAll(right.select(topic, "component"))


def page(parts: DataFrame, topic: str) -> DataFrame:
    """(topic, page): a JSON object for each topic that lists its components."""
    listed = F.array_sort(F.collect_list(F.struct(*sorted(set(parts.columns) - {topic}))))  # one for each component
    return parts.groupBy(topic).agg(F.to_json(F.struct(F.lit(1).alias("version"), F.col(topic).alias("topic"), listed.alias("components"))).alias("page"))


def html(found: DataFrame, topic: str) -> DataFrame:
    """(topic, no, value): a page's lines as HTML: no is their order. Write with ``partitionBy(topic)`` as text, sorted by no within tasks."""
    esc = lambda c: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")], c)
    place = F.array_position(F.lit(list(KINDS.values())), F.col("kind")).cast("string")
    line = F.concat(F.lit('<li data-component="'), "component", F.lit('" data-kind="'), "kind", F.lit('" id="'), esc(F.col("item_id")), F.lit('">'), esc(F.col("item")), F.lit("</li>"))
    body = found.select(topic, F.concat_ws("|", place, "component", "item_id").alias("no"), line.alias("value"))
    name = esc(F.coalesce(F.col(topic).cast("string"), F.lit("")))
    head = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), name, F.lit("</title></head><body><ul>"))
    ends = found.select(topic).distinct()
    return ends.select(topic, F.lit("0").alias("no"), head.alias("value")).unionByName(body).unionByName(ends.select(topic, F.lit("~").alias("no"), F.lit("</ul></body></html>").alias("value")))
