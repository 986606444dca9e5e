"""Corpus pipeline: quality, near-copies, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
`docs`. `run` writes each stage's result and reads it again, so that a lost executor never repeats more than a stage, and deletes
what the stage has written on its way.

Defined cases: a null or empty text has the quality score of the curve at 0 and stays or goes by that; texts without words are
near copies of nothing and all stay, as does one of each group of equal or similar texts (the smallest doc_id; where ids are
null or repeated, one of the rows that have the text); benchmark items that are null or empty remove nothing; personal data is
replaced in place and n_chars follows the text; every row that is left is packed, an empty text as its closing id alone. Empty
tables, extra columns with any names and rows without labels are allowed; columns that are not text pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, packing, pii_bootstrap, quality_zdict, trie_join
from textloom.llm.common import prepare, stored
from textloom.llm.queries import id_fold, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_zdict.fit_quality(docs, labels.where(id_fold(3) != 1))
    return quality_zdict.score_quality(docs, model, keep=0.5)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return trie_join.keep_one(docs)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return decontaminate.remove_contaminated(docs, prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    prepare(spark)
    return pii_bootstrap.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack(docs, packing.PackOptions(tokenizer_path()))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_distinct),
    ("benchmark decontamination", keep_unseen),
    ("PII", hide_personal),
    ("packing", pack),
]

#: No stage before the last is expressible in SQL; tests hold each stage's operator against a brute-force version on small tables.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
