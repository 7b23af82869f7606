"""A corpus pipeline of five training-data operators, each stage on what the one before kept.

Defined results: a null text is empty, and an empty document is clean, a copy of
every other empty one, and one end id in the token files; null doc_ids, languages
and sources are values like others (last among copies, last among sources, first in
the files); repeated rows are copies, of which one stays; an empty table ends as no
rows; extra columns pass through all stages but the last, which returns its own.
Tables between stages are in the folder of ``spark.checkpoint.dir``; they stay there
for whoever owns that folder to remove, as the result is read from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontamination import keep_uncontaminated
from tessera.llm.mixing import mix_documents
from tessera.llm.shared import written
from tessera.llm.simhash import drop_near_duplicates
from tessera.llm.token_files import token_digests
from tessera.llm.toxicity import keep_clean


#: Whether near copies are searched among all pairs that share a key: exact there, at a cost that grows with the square of a group just below the similarity; else among the nearest only.
EXHAUSTIVE = True


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Second stage: one document of each group of near copies."""
    return drop_near_duplicates(spark, docs, sf_dir, EXHAUSTIVE)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: token ids of the mix in shards, and each document's place in them."""
    return token_digests(docs)


#: Toxic documents go; one document of each group of near copies stays; documents
#: with benchmark passages go; sources are mixed to their weights; ids are written.
STAGES = [
    ("toxicity", keep_clean),
    ("simhash_dedup", near_copies),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_documents),
    ("token_ids", token_ids),
]

#: Stages with trained models, balanced sampling and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
