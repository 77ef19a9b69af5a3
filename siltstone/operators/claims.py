"""Extraction of entities and claims, their identity, conflicts and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scoring import confidence
from siltstone.functions.text import normalize_label


def _field(parts: Column, i: int, other: str) -> Column:
    return F.coalesce(F.get(parts, F.lit(i)), F.lit(other))


def directives(texts: DataFrame, key: str, text: str, mark: str) -> DataFrame:
    """(key, line, parts): lines that begin with ``@mark`` and their fields."""
    lines = texts.select(key, F.explode(F.split(text, "\\r?\\n")).alias("line")).where(F.startswith(F.col("line"), F.lit(f"@{mark} ")))
    return lines.withColumn("parts", F.split(F.substr("line", F.lit(len(mark) + 3)), "\\|"))


def extract_entities(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``@entity id|type|name|aliases|identity key``."""
    d = directives(texts, key, text, "entity")
    aliases = F.filter(F.split(_field(F.col("parts"), 3, ""), ","), lambda a: a != "")
    out = d.select(key, *[_field(F.col("parts"), i, "").alias(n) for i, n in enumerate(("local_id", "type", "name"))], aliases.alias("aliases"), F.nullif(_field(F.col("parts"), 4, ""), F.lit("")).alias("identity_key"), F.col("line").alias("evidence_excerpt"))
    return out.where("local_id <> '' and type <> '' and name <> ''")


def extract_claims(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``@claim subject|predicate|object or $value|statement|epistemic status|directness|conflict scope``."""
    p = F.col("parts")
    d = directives(texts, key, text, "claim")
    target = _field(p, 2, "")
    value = F.startswith(target, F.lit("$"))
    scope = F.nullif(_field(p, 6, ""), F.lit(""))
    out = d.select(
        key, _field(p, 0, "").alias("subject_local_id"), _field(p, 1, "").alias("predicate"),
        F.when(~value, target).alias("object_local_id"), F.when(value, F.substr(target, F.lit(2))).alias("value"),
        _field(p, 3, "").alias("statement"), F.when(scope.isNotNull(), F.create_map(F.lit("conflict_scope"), scope)).otherwise(F.expr("cast(map() as map<string,string>)")).alias("qualifiers"),
        _field(p, 4, "fact").alias("epistemic_status"), F.lit("support").alias("evidence_role"), _field(p, 5, "direct").alias("directness"), F.col("line").alias("evidence_excerpt"),
        (target != "").alias("ok"),
    )
    return out.where("ok and subject_local_id <> '' and predicate <> '' and statement <> ''").drop("ok")


def extract_once(chunks: DataFrame, extract) -> DataFrame:
    """Extraction of each distinct content, given back to every chunk that has it."""
    distinct = chunks.groupBy("content_hash").agg(F.first("content_text").alias("content_text"))
    return chunks.select("chunk_id", "content_hash").join(extract(distinct, "content_hash", "content_text"), "content_hash")


def check_grounding(entities: DataFrame, claims: DataFrame, chunks: DataFrame, predicates: DataFrame, key: str) -> DataFrame:
    """(key, issue, item): repeated local ids, excerpts that aren't in the text, unknown predicates."""
    twice = entities.groupBy(key, "local_id").count().where("count > 1").select(key, F.lit("repeated_local_id").alias("issue"), F.col("local_id").alias("item"))
    texts = chunks.select(key, "content_text")
    both = entities.select(key, "evidence_excerpt").unionByName(claims.select(key, "evidence_excerpt")).join(texts, key)
    loose = both.where(~F.contains("content_text", F.col("evidence_excerpt"))).select(key, F.lit("excerpt").alias("issue"), F.col("evidence_excerpt").alias("item"))
    strange = claims.join(F.broadcast(predicates.select("predicate")), "predicate", "left_anti").select(key, F.lit("unknown_predicate").alias("issue"), F.col("predicate").alias("item"))
    return twice.unionByName(loose).unionByName(strange)


def entity_ids(entities: DataFrame, key: str) -> DataFrame:
    """Adds entity_id: by type and identity key anywhere, else by type and normal name within one chunk."""
    own = F.when(F.col("identity_key").isNotNull(), F.concat_ws("\n", F.lit("key"), "type", "identity_key"))
    own = own.otherwise(F.concat_ws("\n", F.lit("name"), "type", normalize_label("name"), F.col(key).cast("string")))
    return entities.withColumn("entity_id", F.concat(F.lit("entity:ent_"), F.substring(F.sha2(own, 256), 1, 32)))


def claim_ids(claims: DataFrame, statement: str = "statement") -> DataFrame:
    """Adds claim_id: the same statement, qualifiers, subject and object or value are one claim."""
    parts = [normalize_label(statement), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("qualifiers")))), F.coalesce("subject", F.lit("")), F.coalesce("object", F.concat(F.lit("$"), "value"), F.lit(""))]
    return claims.withColumn("claim_id", F.concat(F.lit("claim:clm_"), F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 32)))


def conflicts(claims: DataFrame, scope: list[str], position: str) -> DataFrame:
    """scope, n_claims, n_positions of the sets of claims that differ in ``position`` within one scope; nulls of a scope are alike."""
    grouped = claims.groupBy(*scope).agg(F.count("*").alias("n_claims"), F.count_distinct(position).alias("n_positions"))
    return grouped.where("n_positions > 1")


def conflict_pairs(claims: DataFrame, scope: list[str], position: str) -> DataFrame:
    """(left_id, right_id) of claims that differ, only within scopes that have a conflict; for looking at one scope."""
    hot = conflicts(claims, scope, position).select(*scope)
    a, b = claims.alias("a"), claims.alias("b")
    same = F.lit(True)
    for c in scope:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    kept = claims.alias("c").join(hot.alias("h"), [F.col(f"c.{c}").eqNullSafe(F.col(f"h.{c}")) for c in scope], "left_semi")
    a, b = kept.alias("a"), kept.alias("b")
    differ = ~F.col(f"a.{position}").eqNullSafe(F.col(f"b.{position}")) & (F.col("a.claim_id") < F.col("b.claim_id"))
    return a.join(b, same & differ).select(F.col("a.claim_id").alias("left_id"), F.col("b.claim_id").alias("right_id"))


def with_confidence(claims: DataFrame, evidence: DataFrame, disputed: DataFrame) -> DataFrame:
    """Claims (claim_id, status) with confidence from their active evidence and open conflicts, and the status that follows."""
    rank = F.when(F.col("directness") == "direct", 2).when(F.col("directness") == "paraphrase", 1).otherwise(0)
    per = evidence.groupBy("claim_id").agg(F.count_distinct("source_lineage_key").alias("lineages"), F.max(rank).alias("best"))
    held = claims.join(per, "claim_id", "left").join(disputed.select("claim_id").distinct().withColumn("open", F.lit(True)), "claim_id", "left")
    directness = F.when(F.col("best") == 2, "direct").when(F.col("best") == 1, "paraphrase").otherwise("inferred")
    sources = F.greatest(F.lit(1), F.coalesce("lineages", F.lit(0)))
    verified = F.when(F.col("status") == "user_confirmed", "confirmed").when(F.col("status") == "rejected", "rejected").otherwise("none")
    is_open = F.coalesce("open", F.lit(False))
    held = held.withColumn("confidence", confidence(directness, sources, is_open, verified))
    status = F.when(is_open & ~F.col("status").isin("rejected", "user_confirmed"), "disputed").when(~is_open & (F.col("status") == "disputed"), "proposed").otherwise(F.col("status"))
    return held.withColumn("status", status).drop("open", "best", "lineages")
