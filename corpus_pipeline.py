"""From documents to token ids: toxicity, repeated lines, near duplicates, source weights, tokens.

Each stage works on all that the one before it kept, and its decisions take effect. All but the last return the columns of
documents; a document that the mix repeats is a row for each time. Null and empty texts pass every stage: they are not
toxic beyond the bias, have no repeated lines, no duplicates, size 0 in the mix, and no tokens. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm.byte_bpe import round_trip
from logsift.llm.line_windows import remove_repeated_lines
from logsift.llm.mixture import mix, size_of
from logsift.llm.queries import tokenizer
from logsift.llm.shared import arrow_batches
from logsift.llm.shingle_join import jaccard_components
from logsift.llm.toxic_cnn import score, train
from logsift.session import discard, stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of their language go."""
    arrow_batches(spark)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).where("NOT toxic").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go; n_chars follows the text."""
    arrow_batches(spark)
    return remove_repeated_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    arrow_batches(spark)
    return jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document is there as often as the mix takes it."""
    mixed = mix(docs.withColumn("__size", size_of("text")), size="__size").documents
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether the decoded ids are the text."""
    arrow_batches(spark)
    done = round_trip(docs.select("doc_id", "lang", "source", "text"), tokenizer())
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("same"))


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("mixture", mixture), ("byte-level BPE", tokens)]

#: A trained classifier, connected components and tokens: SQL cannot express them; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage returned is removed when the next one has read it."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(*read)
        read = [docs]
    return docs
