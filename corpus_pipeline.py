"""The corpus pipeline: quality rules, line dedup, near-duplicate documents, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents. As a stage's docs are stored, it begins by removing the tables that the
stages before it wrote on their way.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import line_dedup, mixing, ngram_join, pieces, quality
from lodestrata.llm.common import WORD, Scratch, documents, free_name, written


def _as_before(df: DataFrame, docs: DataFrame) -> DataFrame:
    """df's rows with the columns and types of docs; n_chars, where there is one, follows the text."""
    chars = F.length("text")
    return df.select(*((F.when(F.col("text").isNotNull(), chars).cast(f.dataType) if f.name == "n_chars" else F.col(f"`{f.name}`")).alias(f.name) for f in docs.schema.fields))


#: Tables that the stage before wrote on its way to its result.
_SCRATCH = Scratch()


def _stage(function):
    """A stage that first removes the tables the one before wrote on its way, as that one's result is stored by now."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _SCRATCH.clear(spark)
        with _SCRATCH:
            return function(spark, docs, sf_dir)

    return run


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; lines that too many texts of a source share go from the others.

    Rows with null ids are judged like others, by their texts. Rows that repeat are judged alike.
    """
    return _as_before(quality.kept_documents(docs), docs)


@_stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All but one occurrence of similar lines go. A document that has no word left, but had some, goes too."""
    lines, removed = free_name(docs, "_lines"), free_name(docs, "_removed")
    found = line_dedup.dedup_lines(docs, lines_col=lines, removed_col=removed)
    return _as_before(found.filter((F.col(removed) == 0) | F.col("text").rlike(WORD)), docs)


@_stage
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents (five-word shingles, Jaccard 0.8) the one with the least id stays, once. Documents
    without words, or without an id, stay.
    """
    return _as_before(ngram_join.one_of_each(docs, percent=80, size=5), docs)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights: rows leave or come twice."""
    return _as_before(mixing.mixed(docs), docs)


@_stage
def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, and piece_ids, n_pieces, and whether the pieces decode to the text (round_trip); columns of docs
    with one of these names keep it, and the new one gets a longer name.
    """
    model = pieces.load_model()
    ids, count, same, decoded = (free_name(docs, name) for name in ("piece_ids", "n_pieces", "round_trip", "decoded"))
    back = pieces.decode_pieces(pieces.encode_pieces(docs, model, out_col=ids), model, ids_col=ids, out_col=decoded)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return back.select(*own, ids, F.size(ids).cast("long").alias(count), F.col(decoded).eqNullSafe(F.col("text")).alias(same))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("mix_sources", mixing_stage),
    ("sentencepiece", pieces_stage),
]

#: No SQL has these hashes, draws and best paths; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
