"""The training-corpus pipeline: from raw documents to packed sequences, in stages that each take and give documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxloom.llm.common import materialize, read
from voxloom.llm.exact_dedup import drop_exact_duplicates
from voxloom.llm.mixing import mix_rows
from voxloom.llm.neardup import drop_near_duplicates
from voxloom.llm.packing import pack_documents, vocabulary
from voxloom.llm.quality import STRICT, apply_policy


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the strict policy rejects."""
    return apply_policy(docs, STRICT)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest doc_id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 80 percent or more, the one with the smallest doc_id."""
    return drop_near_duplicates(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; weights 5, 2, 1 over sources, 150 percent of the words."""
    return mix_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents packed into sequences of 1024 tokens."""
    return pack_documents(docs, vocabulary())


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: Tokenising is beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again.

    Null texts have no words and go with the rules. Null identifiers are documents of their own, as are rows repeated with one
    identifier and different texts; null sources are one source. Other columns travel along. An empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
