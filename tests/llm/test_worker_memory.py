"""Worker processes keep the memos of one stage only."""

import os
import time

import public_tokenizers
import pyarrow as pa

from sparklog.llm import langid, ngram_join, packing, substring


def kept_memos(spark):
    """process -> what the memos of the operators hold there."""

    def look(batches):
        from sparklog.llm import ngram_join, packing, shared

        for _ in batches:
            time.sleep(0.05)  # so that all processes get tasks
            n = len(shared.WORD_HASHES) + len(ngram_join._WORDS) + packing.tokenizer_of.cache_info().currsize
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([n])], names=["pid", "n"])

    return {r["pid"]: r["n"] for r in spark.range(0, 32, 1, 32).mapInArrow(look, "pid long, n long").collect()}


def test_memos_of_earlier_stages_are_let_go(spark):
    docs = spark.createDataFrame([(k, f"alpha beta{k} gamma delta epsilon", "aa" if k % 2 else "bb") for k in range(64)], "doc_id long, text string, lang string").repartition(32)
    ngram_join.similarity_components(docs).count()
    substring.drop_repeated(docs).count()
    packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2).select("ids").collect()
    assert sum(kept_memos(spark).values()) > 0
    langid.identify(docs, langid.learn(docs)).select("language").collect()
    left = kept_memos(spark)
    assert left and not any(left.values())


def test_memos_last_for_a_stage(spark):
    docs = spark.createDataFrame([(k, f"alpha beta{k}") for k in range(64)], "doc_id long, text string").repartition(32)
    packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2).select("ids").collect()
    assert max(kept_memos(spark).values()) == 1  # the tokenizer, not a memo of words
