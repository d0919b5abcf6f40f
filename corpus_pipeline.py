"""The corpus pipeline: five stages over documents, each a call of one llm operator.

Documents that the quality model rejects go; repeated three-line windows are cut from what is left;
one document of each group of near duplicates stays; documents that hold a copy of a benchmark item
go; the rest is packed into sequences. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import materialize, reads, release, written
from ledgerline.llm.decontam import drop_contaminated
from ledgerline.llm.lines import drop_repeated_lines
from ledgerline.llm.minhash import drop_near_duplicates
from ledgerline.llm.packing import pack, pieces
from ledgerline.llm.quality import resample
from ledgerline.llm.queries import table, vocabulary


#: What stages have written on their way.
_left: list[list[str]] = []


def _stage(f: Callable) -> Callable:
    """Once a stage's result is written and read again, nothing reads what the stage wrote on its way;
    the next stage begins by deleting it."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for paths in [p for p in _left if not reads(docs, p)]:
            release(*paths)
            _left.remove(paths)
        with written() as paths:
            out = f(spark, docs, sf_dir)
        _left.append(paths)
        return out

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resample(docs, table(spark, sf_dir, "labels")).select(docs.columns)


@_stage
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text where lines went."""
    kept = drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, w=5, num=80, den=100, bands=32)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(pieces(docs, vocabulary("word_bpe_49k.json"), capacity=2048, end_id=1), capacity=2048)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The quality model, the alignment and the packing have no SQL form; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        if hasattr(before, "written_to"):
            release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
