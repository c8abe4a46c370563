"""Columns with the names that operators and stages use themselves, and empty tables."""

import pytest

from sparklog.llm import bpe, langid, licenses, media, packing, winnow

TEXT = "The town was built by the sea, and the sea has taken most of it back, as it does. "
ROWS = [(k, TEXT * (1 + k % 3) + f"Number {k} of many.", "en" if k % 2 else "de", "a", "b", k, 2, "d", "e") for k in range(12)]
SCHEMA = "doc_id long, text string, lang string, _first string, _copy string, _language int, n_words int, kept_text string, component_id string"


def test_stages_of_the_pipeline_keep_columns_with_names_of_their_own(spark):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([*ROWS, ROWS[3], (99, None, None, "a", "b", 9, 2, "d", "e")], SCHEMA)
    now = docs
    for _, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == docs.columns
    found = {r["doc_id"]: tuple(r)[3:] for r in now.collect()}
    assert found and all(found[k] == tuple(ROWS[k])[3:] for k in found)
    assert pipeline.STAGES[-1][1](spark, now, "").count() > 0


@pytest.mark.parametrize("name", ["reason", "clip", "start", "mean", "doc_id"])
def test_clips_of_ids_with_any_name(spark, name):
    table = media.store_texts(spark.createDataFrame([(7, "some text")], "doc_id long, text string")).select("doc_id", "media").toDF(name, "bytes")
    rows = media.clips_of(table, name, "bytes").collect()
    assert rows and rows[0][0] == 7


def test_empty_tables(spark):
    import public_tokenizers

    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_documents(docs.select("doc_id", "text"), ranks)
    assert bpe.decode_documents(encoded.select("doc_id", "ids"), ranks).collect() == []
    assert packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2).collect() == []
    assert licenses.scan_documents(docs, licenses.train()).collect() == []
    assert langid.identify(docs.select("doc_id", "text"), langid.learn(docs)).collect() == []
    assert winnow.edited_against_next(docs).collect() == []
    assert media.store_texts(docs).collect() == []
