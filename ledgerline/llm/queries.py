"""The thin queries opN_<name>: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), w=3, num=85, den=100, bands=24)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from ledgerline.llm.lines import drop_repeated_lines

    kept = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.pii import personal_spans

    return personal_spans(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.quality import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.secrets import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.packing import pack, pieces

    return pack(pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=2048, end_id=1), capacity=2048)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.suffix import drop_repeats

    return drop_repeats(table(spark, sf_dir, "documents"), length=100)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerline.llm.media import media_digests

    return media_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    from ledgerline.llm import lines

    return {"op2_line_dedup": lines.SQL}
