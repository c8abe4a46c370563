"""Identifiers, notices of owners and names of other licences; scores against a plain computation."""

import numpy as np
import pytest

from sparklog.llm import licenses


@pytest.fixture(scope="module")
def model():
    return licenses.train()


def families(model, line):
    return [x["family"] for x in model.scan(line)[1]]


@pytest.mark.parametrize(
    ("line", "found"),
    [
        ("SPDX-License-Identifier: Zlib", ["unknown"]), ("SPDX-License-Identifier: WTFPL", ["unknown"]), ("GNU Free Documentation License", ["unknown"]), ("SPDX-License-Identifier: MIT", ["MIT"]),
        ("Copyright 2019 Foo Inc. All rights reserved.", ["proprietary"]), ("Copyright (c) 2001-2020 The Bar Company of Elsewhere. All rights reserved.", ["proprietary"]),
        ("SPDX-License-Identifier: Apache-2.0 OR MIT", ["Apache-2.0", "MIT"]), ("SPDX-License-Identifier: (GPL-2.0-only AND BSD-3-Clause)", ["GPL", "BSD"]),
        ("The driver lost his license after the accident.", []), ("Copyright is a difficult subject for authors and editors.", []), ("He has all rights to be proud of his work.", []),
        ("The restaurant got its license in May", []), ("She holds a pilot license, too.", []),
    ],
)
def test_lines(model, line, found):
    assert families(model, line) == found


def test_places_of_identifiers_with_several_licences(model):
    n, found = model.scan("one\nSPDX-License-Identifier: Apache-2.0 OR MIT\n\ntwo")
    assert n == 3 and [(x["start"], x["end"]) for x in found] == [(4, 46)] * 2


def test_probabilities_equal_a_plain_computation(model):
    """The softmax of summed weights of each known word and pair, scaled by the paragraph's length and the temperature."""
    lines = ["Licensed under the MIT License.", "some words about nothing", "Released under GPL-3.0", "all rights reserved by the public", "x"]
    got = model.probabilities([licenses.words(x) for x in lines])
    for line, row in zip(lines, got):
        own = [model.number.get(w, 0) for w in licenses.words(line)]
        score = np.zeros(len(model.families))
        for w in own:
            if w:
                score += model.single[w]
        for a, b in zip(own, own[1:]):
            if a and b and model.pair_index[a, b]:
                score += model.pair[model.pair_index[a, b]]
        score = (score / np.sqrt(max(1, 2 * len(own) - 1)) + model.intercept) / model.temperature
        want = np.exp(score - score.max())
        assert np.allclose(row, want / want.sum())
