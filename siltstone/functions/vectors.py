"""Vector functions."""

from __future__ import annotations

import hashlib
import operator
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Features of texts that are kept at once.
FEATURES = 1 << 16


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def literal(vector: list[float]) -> Column:
    """A query vector inside the plan, so that scoring a table needs no join."""
    return F.lit(np.asarray(vector, float))


def cosine(v: Column, query: list[float]) -> Column:
    size = float(np.sqrt(np.square(np.asarray(query, float)).sum()))
    return dot(v, literal(query)) / (norm(v) * F.lit(size))


def normalized(v: Column | str, dimensions: int) -> Column:
    """Unit length; an error for a wrong dimension, a zero vector or one that isn't finite."""
    v = F.col(v) if isinstance(v, str) else v
    size = norm(v)
    bad = (F.size(v) != dimensions) | F.isnan(size) | (size == 0) | (size == float("inf"))
    return F.when(bad, F.raise_error(F.lit("invalid vector"))).otherwise(F.transform(v, lambda x: (x / size).cast("float")))


def vector_hash(v: Column | str) -> Column:
    """A digest of a vector at five decimals."""
    return F.sha2(F.array_join(F.transform(v, lambda x: F.format_number(x.cast("double"), 5)), ","), 256)


class Slots(dict):
    """Where a feature counts, made once; in the second half, against."""

    def __init__(self, salt: str, dimensions: int):
        self.salt, self.dimensions, self.made = salt, dimensions, 0

    def __missing__(self, feature: str) -> int:
        if len(self) >= FEATURES:
            self.clear()
        d = hashlib.sha256(f"{self.salt}\n{feature}".encode()).digest()
        self.made += 1
        self[feature] = (d[0] << 8 | d[1]) % self.dimensions + self.dimensions * (d[2] % 2)
        return self[feature]


def fixture_embedding(dimensions: int, salt: str):
    """A deterministic embedding: signed feature hashing of words and character bi- and trigrams."""

    def one(text: str, slots: Slots) -> list[float]:
        x = unicodedata.normalize("NFKC", text or "").lower()
        two = list(map(operator.add, x, x[1:]))
        features = {*x.split(), *two, *map(operator.add, two, x[2:])}
        n = np.bincount(np.fromiter(map(slots.__getitem__, features), np.int64, len(features)), minlength=2 * dimensions)
        return (n[:dimensions] - n[dimensions:]).astype(np.float32).tolist()

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(text: pd.Series) -> pd.Series:
        slots = Slots(salt, dimensions)
        return text.map(lambda x: one(x, slots))

    # or Catalyst would move it into the lambdas of later expressions, once for each use
    return embed.asNondeterministic()
