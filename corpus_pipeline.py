"""From raw documents to packed training sequences: quality, toxicity, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``; all but the last return such rows."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogspark.llm.mixing import mixed
from catalogspark.llm.ngram_jaccard import jaccard_components
from catalogspark.llm.packing import pack
from catalogspark.llm.quality import ledger, passes
from catalogspark.llm.queries import word_tokenizer_path
from catalogspark.llm.tables import drop_stored, scratch, stored
from catalogspark.llm.toxicity import score, train


#: Shares of tokens. The filters before have taken out nearly all that isn't of high quality (half a hundredth of the
#: tokens is left): more of it could only come from the same few documents again and again.
MIXTURE = {"clean_high": 0.995, "clean_low": 0.002, "toxic": 0.003}
#: No document comes more often than this.
MOST_COPIES = 2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Columns of ``docs`` may be named like measurements."""
    whole = docs.select("text", F.struct(*docs.columns).alias("_doc"))
    return ledger(whole).where(passes("v1")).select("_doc.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """(_key, _doc): a number of each row's own, kept in a file so that it stays the same, and the row, whatever its
    columns are called."""
    return stored(docs.select(F.monotonically_increasing_id().alias("_key"), F.struct(*docs.columns).alias("_doc")), "keyed", "zstd")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more go, each by its own text. The model learns from the documents that are left and
    their labels."""
    with scratch() as keep:
        model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        rows = keep(_keyed(docs))
        toxic = score(rows.select(F.col("_key").alias("doc_id"), "_doc.text"), model).where("score >= 0.5").select(F.col("doc_id").alias("_key"))
        toxic = keep(stored(toxic, "toxic"))
    return rows.join(toxic, "_key", "left_anti").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) one row stays, that with the smallest doc_id, of
    equal ones any; null doc_ids come last. Rows without words stay."""
    with scratch() as keep:
        rows = keep(_keyed(docs))
        groups = jaccard_components(rows.select(F.col("_key").alias("doc_id"), "_doc.text"), n=5, percent=80)
        several = stored(groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "several")
        groups = groups.join(several, "component_id").select(F.col("doc_id").alias("_key"), "component_id")
        placed = stored(groups.join(rows.select("_key", "_doc.doc_id"), "_key"), "groups")
        stays = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_key"))["_key"].alias("_key"))
        gone = keep(stored(placed.select("_key").join(stays.select("_key"), "_key", "left_anti"), "gone"))
    return rows.join(gone, "_key", "left_anti").select("_doc.*")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the rates fitted to the target weights say, MOST_COPIES times at most. Where such rates
    miss the weights by more than a hundredth of all tokens, a warning says so."""
    out, off = mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), MIXTURE, most=MOST_COPIES)
    if off > 0.01:
        warnings.warn(f"rates of 0 to {MOST_COPIES} miss the target weights by {off:.1%} of all tokens", stacklevel=2)
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, word_tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: The models and the tokenizer can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch() as keep:  # what a stage stores is deleted as soon as its result is written
            docs = keep(stored(stage(spark, before, sf_dir), name.split()[0]))
        drop_stored(before)
    packed = STAGES[-1][1](spark, docs, sf_dir)
    drop_stored(docs)  # the pieces are stored
    return packed
