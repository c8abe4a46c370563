"""Index keys of the n-gram join: frequent ones in pairs at every size, and keys of many members split into blocks."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklog.llm import ngram_join
from sparklog.llm.shared import mix
from tests.llm.test_corpus_operators import brute_components, by_id


def passages(seed, many, pool, each, length=9):
    """Texts of passages of one pool: nearly all of their shingles are frequent."""
    rng = random.Random(seed)
    parts = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(length)) for _ in range(pool)]
    return [" ".join(rng.sample(parts, rng.randint(*each))) for _ in range(many)]


def near(seed, many):
    rng = random.Random(seed)
    own = [f"n{k}" for k in range(50)]
    return [" ".join(w if rng.random() > 0.01 else f"x{rng.randint(0, 9)}" for w in own) for _ in range(many)]


@pytest.mark.parametrize(("percent", "frequent", "most", "parts"), [(85, 3, 16, 64), (80, 2, 16, 8), (62, 4, 16, 64), (85, 3, 4096, 1)])
def test_split_keys_lose_no_link(spark, percent, frequent, most, parts):
    values = passages(1, 130, 9, (1, 6)) + passages(2, 40, 30, (8, 20)) + near(3, 60) + [None, "", "a b"]
    rows = list(enumerate(values))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = by_id(ngram_join.similarity_components(docs, 4, percent, frequent=frequent, parts=parts, most=most, group_bytes=20_000))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in out.items()} == brute_components(rows, 4, percent)


def test_similar_sets_share_a_key():
    """Sets of 1 to 400 shingles, all frequent or some: the two of every pair that links share an index key."""
    rng = np.random.default_rng(5)
    count = {}
    for size, percent in itertools.product([*range(1, 40), 63, 64, 75, 127, 128, 129, 150, 256, 300, 400], [62, 80, 85, 100]):
        own = mix(rng.integers(0, 1 << 40, size).astype(np.uint64))
        own = np.unique(own)
        drop = (len(own) * (100 - percent)) // 100
        other = np.sort(rng.permutation(own)[drop:])
        df_of = {int(t): int(rng.choice([2, 90, 101, 150, 255])) for t in own}
        keys = []
        for tokens in (own, other):
            n = len(tokens)
            df = np.array([df_of[int(t)] for t in tokens], np.uint8)
            keys.append(ngram_join.signatures(tokens, df, n - (percent * n + 99) // 100, 100, ngram_join.classes_of(n, percent, 64)))
        count[size, percent] = len(np.intersect1d(*keys))
    assert min(count.values()) > 0


def test_percent_too_low_for_prefixes(spark):
    docs = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    for wrong in ({"percent": 40}, {"parts": 48}, {"most": 2}):
        with pytest.raises(ValueError):
            ngram_join.similarity_components(docs, **wrong)


def test_one_key_of_many_members_without_links(spark):
    """20 000 members under one key, none linked, and one pair that is: found by units of two blocks."""
    spark.sparkContext.setLogLevel("ERROR")
    node = F.col("id")
    words = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64(node, k), F.lit(256))), 2, "0")))
    bitmap = F.aggregate(words, F.lit(b""), lambda a, b: F.concat(a, b))
    ranked = spark.range(20_000).select(node.alias("node"), F.lit(40).cast("long").alias("n"), F.lit(0).alias("own"), bitmap.alias("bitmap"))
    tokens = F.when(node >= 19_998, F.lit(np.arange(40, dtype=np.uint64).tobytes()))
    ranked = ranked.withColumn("bitmap", F.when(F.col("node") >= 19_998, F.lit(bytes(64))).otherwise(F.col("bitmap")))
    nodes = ranked.join(spark.range(20_000).select(node.alias("node"), F.coalesce(tokens, F.lit(b"")).alias("tokens")), "node")
    keys = spark.range(20_000).select(F.lit(7).cast("long").alias("sig"), node.alias("node"))
    found = ngram_join._linked(keys, nodes, 85, 4, 4096).collect()
    assert {r["node"]: r["component"] for r in found} == {19_998: 19_998, 19_999: 19_998}
