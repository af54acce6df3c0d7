"""Queries of this subpackage over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.leaks import leaked_items
from tickloom.llm.mix import mixture, shares, token_counter
from tickloom.llm.residue import residue_of_records
from tickloom.llm.sql import SQL
from tickloom.sources.tables import read_table, with_checkpoints

#: Vocabulary file of a public tokenizer: what the mixture counts tokens by.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items of every document, with the number of passages and the share of the item's shingles in them."""
    items = read_table(spark, sf_dir, "eval_item").select("item_id", F.col("item_text").alias("text"))
    return leaked_items(read_table(spark, sf_dir, "documents"), items)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and an item that leaked into it."""
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their tokens; written once, as later steps read it several times."""
    with_checkpoints(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", token_counter(VOCABULARY)("text").alias("n_tokens"))
    return docs.checkpoint()


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: documents with their number of copies."""
    return mixture(_sizes(spark, sf_dir), read_table(spark, sf_dir, "mix_target"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source."""
    docs, targets = _sizes(spark, sf_dir), read_table(spark, sf_dir, "mix_target")
    return shares(mixture(docs, targets), docs, targets)


def p9_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with template residue or replaced content, and the kind."""
    return residue_of_records(read_table(spark, sf_dir, "documents"), status="http_status").where("kind is not null").select("doc_id", F.col("kind").alias("residue_kind"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of those pages."""
    return p9_residue(spark, sf_dir).select("doc_id")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without them."""
    return residue_of_records(read_table(spark, sf_dir, "documents"), status="http_status").where("kind is null").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {"p7_found": p7_found, "p7_leaks": p7_leaks, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_residue": p9_residue, "p9_clean": p9_clean}


def oracle_sql() -> dict[str, str]:
    """SQL by the name of the query."""
    return SQL
