"""A training-corpus pipeline: five stages over `documents`, each a use of one operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from lineweave.llm import language, lines, mixing, pieces, simhash
from lineweave.llm.common import settled, tune
from lineweave.llm.queries import PIECE_BPE, tokenizer_path

#: Calibrated score below which a document's language counts as unknown.
SURE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some certainty; `lang` becomes the predicted one. Null texts and texts without a
    letter go; null ids stay, repeated rows all stay."""
    tune(spark)
    return language.identified(docs, language.fitted(docs), SURE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has, but for two edits. Every row stays, also null and emptied texts and
    rows without a doc_id; equal rows stay alike."""
    tune(spark)
    return lines.dedup_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id: texts whose five-word shingles have
    a Jaccard similarity of 0.8 or more. Texts without words are one group; rows without a doc_id stay, and so do all rows
    of a kept doc_id."""
    tune(spark)
    return simhash.keep_one(docs, width=5)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights: documents are left out or repeated. A null source is one source; texts without
    words go or come like others of their source; rows that repeat a doc_id go together."""
    tune(spark)
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, checked against the sentencepiece library and by decoding; one row each, null texts have none."""
    tune(spark)
    return pieces.encoded(docs, tokenizer_path(PIECE_BPE), with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing sources", mixing_sources),
    ("SentencePiece", sentencepiece),
]

#: The stages learn models and walk graphs: SQL can't express them. tests/llm compares them with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settled(docs, before)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
