"""Trigram full-text search with BM25.

A query reads the corpus once: term counts of the query's tokens are columns
beside the lengths, so no posting is shuffled and only partial sums of the
statistics and the top rows move. The postings table serves stored indexes.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Okapi's parameters and the weights of the fields.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"content": 1.0, "title": 1.5, "path": 0.8, "tags": 0.6}


def query_tokens(query: str) -> list[str]:
    """NFKC words of three characters or more, in lower case."""
    words = unicodedata.normalize("NFKC", query).lower().split()
    return list(dict.fromkeys(w for w in words if len(w) >= 3))


def trigrams(text: Column | str) -> Column:
    """All runs of three characters of the lower-case text."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.length(low) - 2)
    return F.when(F.length(low) >= 3, F.transform(places, lambda i: F.substr(low, i, F.lit(3)))).otherwise(F.expr("cast(array() as array<string>)"))


def postings(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(term, key, field, tf) of the trigrams of every field."""
    parts = [rows.select(key, F.lit(f).alias("field"), F.explode(trigrams(f)).alias("term")) for f in fields]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("term", key, "field").agg(F.count("*").alias("tf"))


def occurrences(text: Column, token: str) -> Column:
    """How often a token's characters stand in a text, overlaps not counted."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("long")


def bm25(rows: DataFrame, query: str, key: str, fields: dict[str, float], most: int = 100) -> DataFrame:
    """The best ``most`` rows by weighted BM25 over the query's tokens: key, score. No token of three characters: see ``substring``."""
    words = query_tokens(query)
    names = list(fields)
    low = rows.select(key, *[F.lower(F.coalesce(f, F.lit(""))).alias(f) for f in names])
    tf = [sum((F.lit(w) * occurrences(F.col(f), t) for f, w in fields.items()), F.lit(0.0)).alias(f"tf{i}") for i, t in enumerate(words)]
    length = sum((F.greatest(F.length(f) - 2, F.lit(0)) for f in names), F.lit(0)).cast("double").alias("dl")
    counted = low.select(key, length, *tf)
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(words))])
    return scores(counted, stats, len(words), key, most)


def scores(counted: DataFrame, stats: DataFrame, words: int, key: str, most: int) -> DataFrame:
    """key, score of the best ``most``, from (key, dl, tf0, tf1, ...) and one row of n, avgdl, df0, df1, ..."""
    some = sum((F.col(f"tf{i}") for i in range(words)), F.lit(0.0)) > 0
    hits = counted.where(some).join(F.broadcast(stats))  # one row of statistics
    score = F.lit(0.0)
    for i in range(words):
        t, d = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n") - d + 0.5) / (d + 0.5)))
        score = score + idf * t * (K1 + 1) / (t + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.select(key, score.alias("score")).orderBy(F.round("score", 9).desc(), key).limit(most)


def substring(rows: DataFrame, query: str, key: str, text: str, most: int = 100) -> DataFrame:
    """Rows that hold the query anywhere, whatever its case, in order of key."""
    return rows.where(F.contains(F.lower(text), F.lit(query.lower()))).select(key).orderBy(key).limit(most)


def search(rows: DataFrame, query: str, key: str, fields: dict[str, float], text: str, most: int = 100) -> DataFrame:
    """key, score, rank: by BM25, or by substring with score 0 if no token has three characters."""
    found = bm25(rows, query, key, fields, most) if query_tokens(query) else substring(rows, query.strip(), key, text, most).withColumn("score", F.lit(0.0))
    return ranked(found, key)


def ranked(found: DataFrame, key: str) -> DataFrame:
    """Adds ``rank`` to a result that is already cut to its top rows."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), key)).cast("long"))


def coverage(active: DataFrame, indexed: DataFrame, key: str) -> DataFrame:
    """Keys that an index misses or holds without need, as (key, issue)."""
    missing = active.select(key).join(indexed.select(key), key, "left_anti").withColumn("issue", F.lit("missing"))
    return missing.unionByName(indexed.select(key).distinct().join(active.select(key), key, "left_anti").withColumn("issue", F.lit("orphan")))


def raw_score(score: Column) -> Column:
    """What an explained search shows beside the rank: 1 / (1 + |score|)."""
    return 1 / (1 + F.abs(score))
