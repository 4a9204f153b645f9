"""The corpus pipeline: language ID, near-duplicate join, repeated passages, secrets, packing.

STAGES holds (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of documents. A stage works on all that the one before kept. Every stage takes an empty table, nulls in
any column, and columns beyond those of documents, which it ignores whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from relweave.llm import jaccard_join, langid, packing, secrets, suffix_dedup
from relweave.llm.bpe_codec import vocabulary
from relweave.llm.common import materialize, read


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those whose language is found with a score below one half.

    Null texts have no letter and go; repeated rows are judged alike; a null doc_id or lang teaches nothing, but the
    row is judged like any other; without any labelled row no language is known, and all go."""
    return langid.accepted(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id in each group of near duplicates.

    Texts without a word (null ones too) are copies of each other. Repeated rows are one. Rows that share a doc_id but
    not a text are all kept, each text once, and so are rows without a doc_id."""
    return jaccard_join.deduplicated(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every passage of more than 50 words, or of 400 bytes or more, that occurs elsewhere.

    All places of a passage are cut, those within one document too. A document may become empty, but stays; a null text
    stays null; repeated rows repeat each other and become empty where they are long enough."""
    return suffix_dedup.without_repeats(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark. Null and empty texts stay as they are; repeated rows stay."""
    return secrets.redacted(docs, vocabulary("byte_bpe_50k.tiktoken"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens. A null or empty text is its end id alone; repeated rows are packed once each."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("secret_scan", secret_scan),
    ("pack", pack),
]

#: The stages cannot be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
