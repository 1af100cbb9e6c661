"""From raw documents to packed training sequences: five stages, each one operator of ``tessera.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each
stage's rows as Parquet into the shared folder and reads them again for the next, and drops the tables that the stage itself
has written.

Defined results: columns besides doc_id, text, source and n_chars are carried through the first four stages, whatever their names;
a null, empty or blank text is scored as a passage of zeros, is near nothing, loses no words and is not taken by the mix; a row with a null doc_id
is scored, is a class of its own, loses no words and is mixed by its size; rows that repeat a doc_id and its text are
one document to the near-duplicate stage, which keeps or drops them together, and documents of their own elsewhere; equal
scores, sizes and odds are decided by doc_id; without labels of both kinds nothing reaches 0.7 unless all labels are 1;
an empty table gives an empty result at every stage; n_chars is the length of the text that is left, null for a null text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.mixing import mixed_documents
from tessera.llm.near_dedup import near_distinct
from tessera.llm.packing import pack_documents
from tessera.llm.quality import good_documents
from tessera.llm.queries import table, tokenizer
from tessera.llm.substring_dedup import cut_documents
from tessera.tables import drop_written, made, written


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.7 go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the smallest doc_id stays."""
    return near_distinct(docs, plain=True)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that a smaller doc_id has, too, are cut from the text; n_chars follows."""
    out = cut_documents(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("quality", reject_poor), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("mixing", mix), ("packing", pack)]

#: The classifier, the near-duplicate classes and the tokenizer cannot be said in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = made()
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_written(spark, before, but_last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
