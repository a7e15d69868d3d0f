"""From raw documents to tokens: quality rules, near-duplicate removal, secret masking, mixing, BPE.

Each stage takes the documents that the one before it kept; all but the last return the columns of
``documents``. ``run`` writes each stage's rows to the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.bpe import bpe_round_trip, digests
from marlstone.llm.common import materialize, read_table
from marlstone.llm.mixing import mixed_documents
from marlstone.llm.ngram_join import one_per_component
from marlstone.llm.quality import quality_filter
from marlstone.llm.secrets import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted of lines of their own."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that 4-word-shingle links connect, the one with the smallest id."""
    return one_per_component(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the text decoded from them."""
    return digests(bpe_round_trip(docs), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scan", secret_scan),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", encoding),
]

#: SQL can express neither the lexer of the secret scan nor BPE; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{i + 1}")
    return docs
