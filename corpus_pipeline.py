"""Corpus pipeline: toxic documents go, one of each near-duplicate group stays,
secrets are masked, sources are mixed to their targets, and the mix is packed.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``, and any others that the table has, under their names.

In every stage rows of null or repeated ids are documents like others, a null text counts
as an empty one, very long texts are read whole, and an empty table gives an empty result.
What else a stage does with such cases, and with ties, its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papergraph.llm import common, mixing, near_dedup, packing, secrets, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns as op4 does.

    Null and empty texts have the intercept's score and stay unless most labels are toxic;
    a score of exactly the limit goes; repeated rows go or stay alike; without labels nothing
    goes.
    """
    labels = common.table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    return toxicity.drop_toxic(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, 0.8) the smallest id stays.

    Texts without words are near nothing and stay; rows equal in id and text stay together;
    an id with two texts may lose one of them; rows without an id stay.
    """
    return near_dedup.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every reported span is masked and n_chars follows; no document goes.

    Null texts stay null with a null n_chars; spans that overlap or tie share one mask.
    """
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes out as often as the mix takes it.

    Texts without words have size 0 and are never taken; a null source is a source of its
    own; equal rows have one rank, and of them as many come out as the mix takes.
    """
    return mixing.draw_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their place in sequences of 2048 tokens.

    An empty text is its end token; a longer one than a sequence is cut; repeated rows are
    packed each.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The first stage is a fitted classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
