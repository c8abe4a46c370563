"""The chosen set of languages against an exhaustive search over all sets."""

import itertools
import math
import random

import numpy as np

from sparklog.llm import langid

PARTS = {"aa": "ba ke li mo nu", "bb": "stra chen bung heit kopf", "cc": "eau oux aise ille oire", "dd": "ska owy czek nych prze", "ee": "baux kelle linych mopf nuska"}


def words_in(lang, n, rng):
    return " ".join("".join(rng.choice(PARTS[lang].split()) for _ in range(3)) for _ in range(n))


def segment_scores(model, text):
    """Per segment of 8 words: the log-likelihood under each language, and its letters; word by word."""
    words = text.split()
    out = []
    for k in range(0, len(words), model.words):
        points, _ = langid._points([" ".join(words[k : k + model.words])])
        at, grams = langid.trigrams(points)
        out.append((model.log_likelihood[grams].astype(float).sum(axis=0), len(at)))
    return np.array([s for s, _ in out]), np.array([n for _, n in out], float)


def best_of_set(scores, weight, chosen):
    """The log-likelihood that EM from equal shares reaches with just these languages."""
    own = scores[:, chosen]
    top = own.max(axis=1, keepdims=True)
    like, share = np.exp(own - top), np.full(len(chosen), 1 / len(chosen))
    for _ in range(2000):
        part = like * share
        part *= (weight / part.sum(axis=1))[:, None]
        share = part.sum(axis=0) / weight.sum()
    return float(np.log((like * share).sum(axis=1)).sum() + top.sum())


def test_no_set_of_languages_is_better(spark):
    rng = random.Random(11)
    rows = [(k, words_in(lang, 60, rng), lang) for k, lang in enumerate(list(PARTS) * 30)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    every = [list(c) for size in range(1, len(PARTS) + 1) for c in itertools.combinations(range(len(PARTS)), size)]
    texts = [" ".join(words_in(lang, rng.choice([8, 16, 24, 60, 120]), rng) for lang in rng.sample(list(PARTS), rng.randint(1, 5))) for _ in range(40)]
    sizes = set()
    for text, share in zip(texts, model.mixtures(texts)[1]):
        scores, weight = segment_scores(model, text)
        cost = model.penalty * math.log1p(len(scores))
        values = {tuple(c): best_of_set(scores, weight, c) - len(c) * cost for c in every}
        found = tuple(np.flatnonzero(share > 0).tolist())
        assert values[found] >= max(values.values()) - 0.05
        sizes.add(len(found))
    assert sizes >= {1, 2, 3}
