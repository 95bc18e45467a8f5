"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, language, licenses, line_dedup, mixing, pii, quality, simhash, tiff
from .common import table
from .sql import ORACLES  # noqa: F401


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    mixed = mixing.mix_sources(docs, size=F.col("_size"), weight=F.col("quality_weight"), tie=F.col("_tie"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.store_texts(table(spark, sf_dir, "documents"))
    return tiff.digests(tiff.explode_pages(stored, "key", "media"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.replace_entities(docs, key="query-key")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _held_out(folds: int, fold: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)) == fold


def op6_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op8_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = _held_out(4, 2)
    found = language.identify(docs.select("doc_id", "text"), language.sample(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), _held_out(3, 1)
    model = quality.fit(quality.sample(docs, table(spark, sf_dir, "labels"), ~held_out))
    return quality.classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_scan_licenses": op2_scan_licenses,
    "op3_tiff_pages": op3_tiff_pages,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_decontaminate": op5_decontaminate,
    "op6_extract_html": op6_extract_html,
    "op7_dedup_lines": op7_dedup_lines,
    "op8_identify_language": op8_identify_language,
    "op9_score_quality": op9_score_quality,
    "op10_simhash_groups": op10_simhash_groups,
}
