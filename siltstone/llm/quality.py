"""A quality classifier under hierarchical empirical Bayes.

Each document's own evidence is a log likelihood ratio from a logistic regression
on the whole text's byte and word shape. A site is a host, below it a path; their
shares of good documents are posteriors under beta priors whose strengths are
fitted by moments: hosts shrink toward the global share, paths toward their host,
the sparser the more. A document's posterior combines its own evidence with its
path's share as prior odds; its own part in that share is left out, so no
evidence counts twice. All site figures are grouped aggregations with partial
sums, so a host with a third of all rows costs what any other costs.

``documents`` has no addresses: there ``source`` stands for the host and ``lang``
for the path below it. Both are parameters.

The regression is fitted on at most ``sample`` labelled documents, those of the
smallest hashes of doc_id; everything else covers all documents. A label stands
for the document's own evidence where there is one, in the share of others of its
site only.

Nulls and empties: a null text is empty; null hosts or paths are sites of their
own; labels of null are none; without labels of both kinds there is no evidence
and everything is kept. Repeated rows are separate rows, each judged by itself;
repeated labels of a document count as their greatest. Texts of any length are
read whole. An empty table gives no rows. Extra columns are ignored, or kept by
``keep_good``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import map_arrow, materialize, renamed

#: Labelled rows that the regression is fitted on, at most.
SAMPLE = 20_000
#: Strongest evidence that one document's text can give, as a log likelihood ratio.
CLIP = 12.0
ROW = ["doc_id", "e", "host", "path"]
PUNCTUATION = np.array([b for b in range(33, 127) if not chr(b).isalnum()])


def shape(text: str | None) -> list[float]:
    """Shares of kinds of bytes, of repeated words and lines, and the logarithm of the length."""
    data = (text or "").encode()
    n = len(data) or 1
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = len(words) or 1
    top = Counter(words).most_common(1)[0][1] if words else 0
    kinds = [counts[97:123].sum() / n, counts[65:91].sum() / n, counts[48:58].sum() / n, counts[128:].sum() / n, counts[:33].sum() / n]
    marks = np.sqrt(counts[PUNCTUATION] / n).tolist()
    stirred = len(set(words)) / math.sqrt(m)
    return [*map(float, kinds), *marks, n / m / 10, min(stirred, 40.0) / 10, top / m, 1 - len(set(lines)) / (len(lines) or 1), math.log1p(len(words)) / 5]


def features(docs: DataFrame, host: str, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, e (a hash of the row), host, path, f for every row, as a written table."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = pa.array([shape(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ROW], f], [*ROW, "f"])

    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in ((doc_id, "doc_id"), (host, "host"), (path, "path"), (text, "text"))])
    own = own.withColumn("e", F.xxhash64("text", "host", "path"))
    return materialize(map_arrow(own, rows, "doc_id long, e long, host string, path string, f array<float>"), "features")


class Regression:
    """Ridge-penalised logistic regression on standardised features, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, good: np.ndarray, ridge: float = 1.0):
        self.middle, self.scale = x.mean(axis=0), x.std(axis=0)
        self.scale[self.scale < 1e-6] = np.inf
        z = np.column_stack([self._standard(x), np.ones(len(x))])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        self.w = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (p - good) + penalty * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break
        share = np.clip(good.mean(), 1e-6, 1 - 1e-6)
        self.base = math.log(share / (1 - share))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.middle) / self.scale, -10, 10)

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """The log likelihood ratio of good against bad."""
        return np.clip(self._standard(x) @ self.w[:-1] + self.w[-1] - self.base, -CLIP, CLIP)


#: Hashes of doc_id lie below this.
HASHES = 1 << 40


def fit(table: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Regression | None:
    """From at most ``sample`` labelled documents; None unless both kinds are among them.

    The hash below which a document is taken leaves a tenth for chance, so what
    reaches the driver does not grow with the table or its partitions.
    """
    ids = table.select("doc_id").join(labels, "doc_id").groupBy("doc_id").agg(F.max("good").alias("good"))
    ids = materialize(ids, "labelled")
    total = ids.count()
    below = HASHES if total <= sample else int(HASHES * 0.9 * sample / total)
    picked = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) < below)
    rows = table.join(picked, "doc_id").groupBy("doc_id").agg(F.min("f").alias("f"), F.max("good").alias("good")).limit(sample).toArrow().sort_by("doc_id")
    good = rows.column("good").to_numpy()
    if not len(good) or good.min() == good.max():
        return None
    f = rows.column("f").combine_chunks().flatten().to_numpy().reshape(len(good), -1)
    return Regression(f.astype(float), good)


def evidence(table: DataFrame, model: Regression | None) -> DataFrame:
    """The rows with llr in place of their features."""
    if model is None:
        return table.select(*ROW, F.lit(0.0).alias("llr"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("f")
            x = f.flatten().to_numpy().reshape(len(f), len(model.middle)).astype(float)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ROW], pa.array(model.evidence(x), pa.float64())], [*ROW, "llr"])

    return map_arrow(table, rows, "doc_id long, e long, host string, path string, llr double")


def strength(share: float, spread: float, sampling: float) -> float:
    """A beta prior's strength by moments: spread of group shares beyond what sampling alone gives."""
    own = share * (1 - share)
    between = max(spread - sampling, own * 1e-3)
    return float(np.clip(own / between - 1, 1.0, 1000.0)) if own else 1000.0


def sites(known: DataFrame) -> tuple[DataFrame, float, float, float]:
    """host, path, n, s, hn, hs from ``host, path, y``, y being the share of good that each row stands for.

    Also the global share and the strengths of the hosts' and the paths' priors.
    """
    paths = materialize(known.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("groups")).first()
    rows = total.n or 0
    share = total.s / rows if rows else 0.5
    spread = hosts.agg((F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - share, 2)) / F.sum("hn")).alias("v")).first().v or 0.0
    k = strength(share, spread, share * (1 - share) * total.groups / max(rows, 1))
    both = paths.join(hosts, paths["host"].eqNullSafe(hosts["host"])).drop(hosts["host"])
    both = materialize(both.select("host", "path", "n", "s", "hn", "hs"), "sites")
    raw = F.col("hs") / F.col("hn")
    inner = both.agg((F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - raw, 2)) / F.sum("n")).alias("v"), F.count("*").alias("groups")).first()
    return both, share, k, strength(share, inner.v or 0.0, share * (1 - share) * inner.groups / max(rows, 1))


def judged(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, e, llr, host_rate, path_rate, posterior, kept for every row of ``docs``; ``labels`` has doc_id and quality (0 or 1).

    The rates are those that the site has without the row itself.
    """
    known = renamed(labels, doc_id="doc_id", quality="quality").where("quality is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("good"))
    table = features(docs, host, path)
    model = fit(table, known, sample)
    base = model.base if model else 0.0
    scored = materialize(evidence(table, model).join(known, "doc_id", "left"), "evidence")
    own = 1 / (1 + F.exp(-(F.col("llr") + F.lit(base))))
    scored = scored.withColumn("y", F.coalesce("good", own))
    table_of, share, k, kp = sites(scored.select("host", "path", "y"))
    joined = scored.join(table_of, scored["host"].eqNullSafe(table_of["host"]) & scored["path"].eqNullSafe(table_of["path"]))
    joined = joined.withColumn("host_rate", (F.col("hs") - F.col("y") + k * share) / (F.col("hn") - 1 + k))
    joined = joined.withColumn("path_rate", (F.col("s") - F.col("y") + kp * F.col("host_rate")) / (F.col("n") - 1 + kp))
    bounded = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("path_rate")))
    posterior = 1 / (1 + F.exp(-(F.col("llr") + F.log(bounded / (1 - bounded)))))
    kept = F.col("posterior") >= least if model else F.lit(True)
    return joined.withColumn("posterior", posterior).select("doc_id", "e", "llr", "host_rate", "path_rate", "posterior", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that the classifier rejects, known by doc_id, text, host and path."""
    none = F.lit(-(1 << 63))
    bad = judged(docs, labels, host, path, least, sample).where("not kept").select(F.coalesce("doc_id", none).alias("d"), "e").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.coalesce(F.col("doc_id"), none).alias("d"), F.xxhash64("text", f"`{host}`", f"`{path}`").alias("e"))
    return keyed.join(bad, ["d", "e"], "left_anti").select("row.*")


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = judged(docs, labels)
    return out.select("doc_id", *[F.round(c, 9).alias(c) for c in ("llr", "host_rate", "path_rate", "posterior")], "kept")
