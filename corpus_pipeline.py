"""From documents to packed training sequences: language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
run() writes each stage's result as Parquet to the shared folder and reads it again for the next one.

Nulls and empty texts: the language stage rejects them; a table that becomes empty stays empty through all
stages. Very long texts are judged, compared, cut and packed whole. Of rows that repeat an id and a text, that whose
other columns have the least hash stays; of rows with one id and different texts, all that near duplicates leave.
Columns beyond doc_id and text pass through, whatever their names; n_chars, where there is one, follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparklog.llm import langid, ngram_join, packing, substring
from sparklog.llm.shared import free_name, stored

#: Documents whose strongest language is less certain than this, or that have no letter, are rejected.
LEAST_LANGUAGE_SCORE = 0.35
#: Near duplicates share this percentage of their shingles of so many words.
SIMILAR_PERCENT, SHINGLE_WORDS = 80, 5
#: Repeated passages are found by windows of so many words.
PASSAGE_WORDS = 20
MAX_SEQUENCE, END_ID = 4096, 2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language."""
    model = langid.learn(docs.filter(langid.fold() != 1))
    name = free_name(docs, "_language")
    found = langid.identify(docs, model, out=name)
    kept = (F.col(name)["lang"] != "und") & (F.col(name)["score"] >= LEAST_LANGUAGE_SCORE)
    return found.filter(kept).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of least id, of each group of near duplicates."""
    groups = ngram_join.similarity_components(docs, n=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    first, copy = free_name(docs, "_first"), free_name(docs, "_copy")
    least = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(first)).distinct()
    kept = docs.join(least, F.col("doc_id").eqNullSafe(F.col(first)), "left_semi")
    others = F.xxhash64(F.to_json(F.struct(*[c for c in docs.columns if c != "text"])))
    again = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(others)  # rows that repeat a document
    return kept.withColumn(copy, F.row_number().over(again)).filter(F.col(copy) == 1).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that occur earlier; the rest of a text keeps its layout."""
    others = {c: f"_column{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}  # names that no result has
    renamed = docs.select("doc_id", "text", *[F.col(c).alias(name) for c, name in others.items()])
    kept = substring.drop_repeated(renamed, window=PASSAGE_WORDS, keep=list(others.values()), layout=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")} | {c: F.col(name) for c, name in others.items()}
    return kept.select(*[columns[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two lengths."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, MAX_SEQUENCE)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("packing", packed)]

#: Language inference, the similarity join and tokenization have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
