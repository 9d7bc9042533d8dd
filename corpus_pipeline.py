"""A corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common
from granary.llm import queries as q

#: Posterior below which a language isn't told.
SURE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told. The classifier learns from the whole labelled table.

    Rejected: no text, no letter, or no language with a posterior of 0.5.
    """
    from granary.llm.language_id import UNKNOWN, predict_languages

    training = common.documents(spark, sf_dir).select("text", "lang")
    told = predict_languages(docs, training)
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= SURE)).select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated passages; those that nothing is left of go."""
    from granary.llm.line_dedup import line_dedup

    cut = line_dedup(docs).where(F.length(F.trim("text")) > 0)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id (null: larger than any), then text hash.

    Rows that share a doc_id but not a text are told apart. Of rows equal in both, one stays. Texts without words are a group of their own each.
    """
    from granary.llm.ngram_join import ngram_join

    mark = F.xxhash64("text")
    found = ngram_join(docs.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", mark.alias("mark")).alias("key"), "text"), doc_id="key")
    kept = common.materialize(found.where(F.col("doc_id") == F.col("component_id")).select("doc_id.doc_id", "doc_id.mark").distinct().toDF("own", "own_mark"), "kept")
    rows = docs.withColumn("_mark", mark)
    stay = rows.join(common.checked_broadcast(kept), common.same(F.col("doc_id"), F.col("own")) & (F.col("_mark") == F.col("own_mark")), "left_semi")
    # Rows equal in both columns share a key; only where a key has several rows are they brought together.
    again = common.materialize(stay.groupBy(F.col("doc_id").alias("own"), F.col("_mark").alias("own_mark")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "again")
    if again.isEmpty():
        return stay.select(*docs.columns)
    several = common.same(F.col("doc_id"), F.col("own")) & (F.col("_mark") == F.col("own_mark"))
    one = stay.join(common.checked_broadcast(again), several, "left_semi").dropDuplicates(["doc_id", "_mark"])
    return stay.join(common.checked_broadcast(again), several, "left_anti").unionByName(one).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say, so that expected token shares of domains match the targets."""
    from granary.llm.mixing import mix, take

    mixed = mix(docs, q.labelled_domains(spark, sf_dir), q.TARGETS)
    return take(mixed).select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token counts and the digests of their ids and of the text decoded from them."""
    import public_tokenizers

    from granary.llm.byte_bpe import bpe_encode

    got = bpe_encode(docs, q.tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", keep_languages),
    ("line_dedup", cut_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Naive Bayes, shingle components, mixing and BPE aren't expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again. What a stage wrote on its way goes when its result is written."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with common.own_tables() as keep:
            docs = keep(common.materialize(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
