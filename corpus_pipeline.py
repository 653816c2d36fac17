"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows of its predecessor; ``run`` writes every stage's
rows as Parquet in the shared folder and reads them again for the next one.

Edge cases: null and empty texts are scored like others by the classifier; of near copies the smallest doc_id stays
(rows that repeat a doc_id are one document, rows without one all stay); texts without words link with nothing, have
size 0 and are never taken by the mix; very long texts are cut into several sequences, never shortened; a null source
is a source of its own; columns beside those of documents are carried through all stages but the last, whatever their
names (those that begin with __vl are the operators' own); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm import mixing, ngram_join, packing, pii, quality, tokens
from vectorloom.runtime import Scratch


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = [*docs.columns]
    return quality.score(docs, labels).where("predicted = 1").select(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in training sequences."""
    return packing.pack(docs, tokens.vocabulary(), 1, 4096)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: The classifier, the bootstrap, the cube method and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        written = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:
            scratch.drop(docs)
        docs = written
    return docs
