"""A training corpus from ``documents``: stages that each call one operator of ``loomtext.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import byte_bpe, line_dedup, mixing, quality_rules, simhash

#: Words of a shingle; documents are near-duplicates at a Jaccard similarity of 0.8 of their sets of shingles.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words and go.  Repeated rows are judged each, alike.  Empty table: no rows.  Columns stay as they are, whatever
    their names.
    """
    return quality_rules.passed(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that a document of smaller id has are taken out; no row goes.

    A null text stays null, a row with a null id stays as it is, rows that repeat an id do not touch each other.  Empty table: no rows.
    ``n_chars`` is counted anew, a column ``removed_lines`` of the table goes, all others stay.
    """
    return line_dedup.deduplicated(docs).drop("removed_lines").withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document of least id stays.

    Each row is judged by its own text.  Null and empty texts are one group, a null id comes after all others, rows that repeat an id and
    a text leave one.  Empty table: no rows.  Columns stay as they are, whatever their names.
    """
    return simhash.without_copies(docs, k=SHINGLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for.

    Null texts have size 0 but keep their place in the sampling; a null source is a source of its own.  Rows that repeat an id share what is
    due to it.  Empty table: no rows.  Columns stay as they are, whatever their names.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of the bytes that they decode to, by the public byte-level vocabulary.

    Null and empty texts have no ids; repeated rows one result each; empty table: no rows; other columns go.
    """
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.encoded(docs, ranks, public_tokenizers.PATTERN, digests=True)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash", near_duplicates), ("mixing", mix), ("byte_bpe", encode)]
#: No SQL: expectation-maximisation, alignment and byte pair merges are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
