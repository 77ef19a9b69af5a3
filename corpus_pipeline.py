"""The training-data pipeline: five stages over ``documents``, each a written table.

Counted as part of the subpackage ``siltstone.llm``. Every stage takes
``(spark, docs, sf_dir)`` and works on all that the one before it kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import mixing, packing, quality, simhash, suffix_dedup
from siltstone.llm.common import materialize, table

#: Near-duplicates: five-word shingles of a Jaccard similarity of 8 tenths; 61 of 64 equal fingerprint bits are looked at first.
SHINGLE, RADIUS, TENTHS = 5, 3, 8
#: Shortest repeat that is cut, in bytes.
REPEAT = 100


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return simhash.keep_one_similar(docs, SHINGLE, RADIUS, TENTHS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings that start earlier in the corpus are cut; ``n_chars`` follows the text."""
    return suffix_dedup.cut_texts(docs, REPEAT).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, once or twice."""
    return mixing.repeated(docs, [3, 1, 2], share=1.5, most=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL has the stages' models, fingerprints, repeats and packing; tests hold each against brute force.
ORACLE_SQL = None
