"""Limits are raised, not silently applied."""

import random
from types import SimpleNamespace

import pytest

from sparklog.llm import langid, ngram_join, shared

PARTS = {"aa": "ba ke li mo nu", "bb": "stra chen bung heit kopf", "cc": "eau oux aise ille oire", "dd": "ska owy czek nych prze", "ee": "inen aatt yyli kkaa oinen"}


def words_in(lang, n, rng):
    return " ".join("".join(rng.choice(PARTS[lang].split()) for _ in range(3)) for _ in range(n))


def test_a_document_in_five_languages(spark):
    rng = random.Random(1)
    rows = [(k, words_in(lang, 60, rng), lang) for k, lang in enumerate(list(PARTS) * 40)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    shares = {x["lang"]: x["share"] for x in next(model.results([" ".join(words_in(lang, 160, rng) for lang in PARTS)]))["languages"]}
    assert set(shares) == set(PARTS) and all(0.1 < s < 0.3 for s in shares.values())
    one = next(model.results([words_in("cc", 300, rng)]))
    assert [x["lang"] for x in one["languages"]] == ["cc"]


def test_shares_do_not_depend_on_the_other_documents(spark):
    rng = random.Random(2)
    rows = [(k, words_in(lang, 60, rng), lang) for k, lang in enumerate(list(PARTS) * 40)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = [" ".join(words_in(lang, rng.randint(8, 90), rng) for lang in rng.sample(list(PARTS), rng.randint(1, 4))) for _ in range(30)]
    together = list(model.results(mixed))
    for text, result in zip(mixed, together):
        alone = next(model.results([text]))
        assert alone["lang"] == result["lang"] and abs(alone["score"] - result["score"]) < 1e-9


def test_components_that_do_not_settle_raise(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        shared.components(chain, max_rounds=1)


def test_counts_end_at_255(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    with pytest.raises(ValueError):
        ngram_join.similarity_components(docs, frequent=255)


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError):
        shared.shared_path(session("spark://host:7077", None), "t")
    with pytest.raises(ValueError):
        shared.shared_path(session("local-cluster[2,1,1024]", None), "t")
    assert shared.shared_path(session("local[4]", None), "t").startswith("file:///tmp/")
    assert shared.shared_path(session("yarn", "hdfs://x/y/"), "t").startswith("hdfs://x/y/t-")
