"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all rows of docs.

All but the last return the columns of docs. Labels are the only other table read, to train the classifier. docs may
have any more columns: names of a stage's own are chosen so that they clash with none, whatever the case of letters.
Texts may have any length; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import bpe, crf, mixing, secrets, simhash
from tidemark.llm.common import table, unused
from tidemark.llm.queries import tokenizer_path
from tidemark.session import prepare


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is trained on labelled documents of docs that aren't held out.

    A null, empty or blank text has the score of the average labelled document. Repeated rows are judged alike.
    """
    model = crf.train(docs, table(prepare(spark), sf_dir, "labels"))
    score = unused(docs.columns, "score")
    return crf.score(docs, model, out=score).filter(F.col(score) >= crf.THRESHOLD).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id: texts that share four fifths or more
    of their distinct 5-word shingles are linked. Rows are judged by their texts, with or without id; of repeated rows
    one stays, as of texts without words."""
    return simhash.near_texts(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated rows included, with the secrets that the scan finds replaced by a mark in the text, and
    n_chars counted anew where there was one. Null texts stay null; other columns are as they were."""
    found = unused(docs.columns, "found")
    n_chars = F.when(F.size(found) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    text = secrets.masked(F.col("text"), F.col(found))
    return secrets.scan(docs, "text", found).withColumn("text", text).withColumn("n_chars", n_chars).select(docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or repeated. A text without words isn't taken.

    Rows that share id, source and number of words can't be told apart by the mix; each gets the most that one has.
    """
    mixed = mixing.mix(docs, F.array(F.col("source")), mixing.words(), mark=F.xxhash64("text"))
    taken = mixed.filter("taken > 0").select(F.struct(F.col("doc_id").alias("id"), F.expr("pattern[0]").alias("source"), "size").alias("key"), F.expr("cast(taken div size as int)").alias("copies"))
    taken = taken.groupBy("key").agg(F.max("copies").alias("copies"))
    named = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(F.col("doc_id").alias("id"), named.alias("source"), mixing.words().alias("size")).alias("key"))
    # Struct keys compare nulls as equal within them, and no name of the documents' columns stands beside them.
    rows = rows.join(taken, "key")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids (little-endian unsigned 32-bit integers) of every row.

    A null or empty text has no tokens; a null id stays null; other columns aren't kept.
    """
    prepare(spark)
    return bpe.digests(docs, tokenizer_path(), with_ids=True)
