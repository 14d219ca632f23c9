"""A training corpus from raw documents, stage by stage; every stage's rows are written and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all documents that the one before it kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, line_dedup, packing, simhash, tokens
from tidemark.llm import toxicity as toxic


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """docs with columns of those names renamed, and the columns that give all of docs back."""
    moved = {c: common.unused([*docs.columns, *names], c) for c in docs.columns if c in names}
    return docs.withColumnsRenamed(moved), [F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that score toxic go.

    The score depends on the text alone, so equal texts and repeated rows go or stay together, whatever their doc_id, null
    too. Null, empty and blank texts score as a text without words. Without labels of both kinds all score alike. An empty
    table gives no rows.
    """
    model = toxic.trained(docs, common.table(spark, sf_dir, "labels"))
    scored, columns = _aside(docs, "score")
    return toxic.score(scored, model).filter(F.col("score") < toxic.THRESHOLD).select(columns)


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: repeated chunks of lines go; a document of which nothing is left goes too. n_chars follows the text.

    Null, empty and blank texts have nothing to remove and stay. Rows that share doc_id (null too) and text are one
    document and all stay or all change alike. Of ties the first place is that of the least doc_id, null first, then text
    hash. An empty table gives no rows.
    """
    named, columns = _aside(docs, *line_dedup.ADDED)
    found = line_dedup.dedup_lines(named)
    kept = found.filter((F.col("removed_chunks") == 0) | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    counted = F.when(F.col("removed_chunks") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", counted).select(columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7, five words and a similarity of 0.8: of each group of near duplicates one row stays, that of the least doc_id.

    A row with a null doc_id stays only where its group has no other; of repeated rows one stays; a doc_id at two unlike
    texts keeps both. Null, empty and blank texts are one group. An empty table gives no rows.
    """
    return simhash.one_of_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents of which a twentieth or more of the words stand in benchmark passages go.

    Every row is judged by its own text, whatever its doc_id, null or repeated. Null and empty texts stay. An empty table
    or benchmark removes nothing.
    """
    named, columns = _aside(docs, *decontamination.FOUND.names)
    found = decontamination.contamination(named, common.table(spark, sf_dir, "benchmark"), keep=named.columns)
    return found.filter(~decontamination.is_contaminated()).select(columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: every kept document lies in windows of at most 2048 ids; one row a piece, its ids in it.

    Null and empty texts are the end id alone; repeated rows and null doc_ids are documents each for itself; a very long
    text is cut into whole windows and a rest. An empty table gives no rows.
    """
    return packing.pack(docs, tokens.public_path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_chunks),
    ("simhash", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Compressed lengths, rolling hashes and token ids are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
