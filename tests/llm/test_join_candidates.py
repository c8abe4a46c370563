"""Candidates of the n-gram join: once for each set of members, and judged by bitmaps as wide as the sets need."""

import numpy as np
import pyarrow as pa

from sparklog.llm import ngram_join


def test_keys_of_the_same_members_are_one(spark):
    rows = [(sig, node) for sig in range(200) for node in (1, 2)] + [(sig, node) for sig in range(200, 203) for node in (1, 2, 3)] + [(300, 1), (301, 2)]
    found = ngram_join._distinct_groups(spark.createDataFrame(rows, "sig long, node long"))
    assert sorted(map(tuple, found.collect())) == [(0, 2), (200, 3)]


def test_wide_bitmaps_rule_out_large_sets_that_differ_and_lose_none_that_links():
    random, percent = np.random.default_rng(5), 80
    base = random.integers(0, 1 << 62, 4000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 1500 - k], random.integers(0, 1 << 62, k + more, dtype=np.uint64)])) for k in (0, 60, 160, 167, 400, 1500) for more in (0, 100, 549)]
    sets += [base[:500], base[:520], base[:1020], base[:1030]]  # around the steps of the width
    wide = pa.chunked_array([pa.array([ngram_join.parities(s, ngram_join.wide_bits(len(s))) if len(s) > 512 else None for s in sets], pa.binary())])
    size = np.array([len(s) for s in sets])
    a, b = np.triu_indices(len(sets), 1)
    rows = np.concatenate([ngram_join._rows_of(np.arange(len(sets)), a, b)] * 2)  # each pair twice
    left = set(map(tuple, ngram_join._by_wide(rows, size, wide, percent).tolist()))
    share = {(x, y): len(np.intersect1d(sets[x], sets[y])) / len(np.union1d(sets[x], sets[y])) for x, y in zip(a.tolist(), b.tolist())}
    assert {p for p, s in share.items() if 100 * s >= percent} <= left
    assert not {p for p, s in share.items() if s < 0.6 and min(size[list(p)]) > 1000} & left  # bitmaps of 512 bits let all of them pass
