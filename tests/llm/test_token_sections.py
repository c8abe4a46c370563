"""Token counts of sections against a count by single characters, on multi-byte text."""

import random

import public_tokenizers
import pytest
import tiktoken

from sparklog.llm import bpe, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(oracle, text, rule):
    """(start, end, tokens, crossing) of each line; a token covers the characters that its bytes are of."""
    char_of_byte = [k for k, c in enumerate(text) for _ in c.encode()]
    sections, at = [], 0
    for line in text.split("\n"):
        end = min(at + len(line) + 1, len(text))
        sections.append((at, end))
        at = end
    if len(sections) > 1 and sections[-1][0] == sections[-1][1]:
        sections.pop()  # nothing behind the last line end
    tokens, crossing, place = [0] * len(sections), [0] * len(sections), 0
    for token in oracle.encode_ordinary(text):
        size = len(oracle.decode_single_token_bytes(token))
        chars = sorted(set(char_of_byte[place : place + size]))
        place += size
        held = [sum(a <= c < b for c in chars) for a, b in sections]
        touched = [k for k, n in enumerate(held) if n]
        for k in touched if len(touched) > 1 else ():
            crossing[k] += 1
        tokens[{"first": touched[0], "last": touched[-1], "largest": max(touched, key=lambda k: (held[k], -k))}[rule]] += 1
    return [(a, b, t, c) for (a, b), t, c in zip(sections, tokens, crossing)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_against_brute_force(spark, rule):
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(7)
    texts = ["".join(rng.choice(("the ", "word", "\n", "\n\n", " \n", "é", "漢字", "🙂", "x", " ", "\t")) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, section string")
    found = {}
    for r in token_counts.section_counts(rows, RANKS, rule).collect():
        found.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["end"], r["n_tokens"], r["n_crossing"]))
    for k, text in enumerate(texts):
        assert [r[1:] for r in sorted(found[k])] == brute(oracle, text, rule), repr(text)


def test_null_empty_and_repeated_rows(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "a\nb"), (3, "a\nb"), (None, "c")], "doc_id long, text string")
    out = sorted(((r["doc_id"], r["section"], r["n_tokens"]) for r in token_counts.section_counts(rows, RANKS).collect()), key=repr)
    assert out == sorted([(1, 0, 0), (2, 0, 0), (3, 0, 2), (3, 0, 2), (3, 1, 1), (3, 1, 1), (None, 0, 1)], key=repr)
    assert token_counts.section_counts(rows.limit(0), RANKS).count() == 0
