"""Corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the
columns of ``documents``. ``run`` writes each stage's result as Parquet in the shared folder
and reads it back as the next one's input.

- language: documents without a letter (or without text) go; a missing ``lang`` is filled
  in with the predicted one, and stays missing where no row has a language to learn.
- near: of each class of near duplicates the document that comes first stays.
- substrings: words of repeated passages are cut out of the text and ``n_chars`` follows;
  documents of which nothing is left go.
- decontaminate: documents with a benchmark item in them go.
- packing: what is left becomes sequences of 4096 tokens.

Nulls in any column, empty tables and repeated rows pass through each stage as its operator
defines; columns other than those of ``documents`` are left behind by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common, decontaminate, language, near, packing, substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.configure(spark)
    docs = docs.select(*COLUMNS)
    model = language.learn_from_split(docs)
    found = language.identify(docs, model, keep=COLUMNS[1:]).where(language.has_letter(F.col("text")))
    lang = F.coalesce("lang", "lang_pred") if model.languages else F.col("lang")
    return found.select("doc_id", "text", lang.alias("lang"), "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.configure(spark)
    docs = docs.select(*COLUMNS)
    first = near.jaccard_classes(docs).where(F.col("rid") == F.col("class")).select(F.col("id").alias("_id"), F.col("key").alias("_key"))
    keyed = docs.withColumn("_k", common.row_key("doc_id", "text"))
    kept = keyed.join(first, (F.col("_k") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    # rows equal in id and text are copies of each other: one stays
    return kept.dropDuplicates(["doc_id", "_k"]).select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.configure(spark)
    cut = substrings.remove_repeats(docs.select(*COLUMNS), keep_text=True, keep=("text", "lang", "source", "n_chars"))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.where("n_words = 0 OR n_removed < n_words").select("doc_id", text.alias("text"), "lang", "source", size.alias("n_chars"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.configure(spark)
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near", drop_near_duplicates),
    ("substrings", drop_repeated_passages),
    ("decontaminate", drop_benchmark_leaks),
    ("packing", pack),
]

#: SQL can express neither the models nor the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}", "zstd")
    return STAGES[-1][1](spark, docs, sf_dir)
