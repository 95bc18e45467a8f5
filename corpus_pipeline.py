"""From raw documents to a weighted mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. The first four return rows with the columns of documents; the last returns
the mix: which documents it takes, how often, and the words that makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import decontamination, language, line_dedup, mixing, simhash
from parlance.llm.common import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages stay; text without letters, or that fits none, goes."""
    return language.keep_identified(docs, language.sample(docs, F.lit(True)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of lines stay in their first document; documents of which nothing is left go."""
    found = line_dedup.dedup_lines(docs).filter("removed_lines = 0 or text <> ''")
    size = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", size).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: doc_id, source, size, source_size, target, copies, taken."""
    weighed = mixing.with_quality(docs, table(spark, sf_dir, "labels"))
    mixed = mixing.mix_sources(weighed, size=F.col("_size"), weight=F.col("quality_weight"), tie=F.col("_tie"))
    copies = F.col("epochs") + F.col("sampled").cast("long")
    return mixed.withColumn("copies", copies).filter("copies > 0").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("language", identify_language),
    ("line dedup", dedup_lines),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix),
]

#: SQL can't express language identification or SimHash; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
