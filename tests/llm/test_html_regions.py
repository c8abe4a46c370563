"""Regions of pages: suspects, clustering against brute force, linear time, clashing names."""

import math
import random
import time

import numpy as np
import public_tokenizers
import pytest

from sparklog.llm import bpe, html_text, langid, winnow

PARA = "<p>" + "The quick brown fox jumps over the lazy dog and runs away. " * 3 + "</p>"
ARTICLE = "<h1>Title</h1>" + PARA * 4
WANT = "\n".join(["Title"] + [("The quick brown fox jumps over the lazy dog and runs away. " * 3).strip()] * 4)
NOTICE = '<div class="cookie-banner"><p>We use cookies to improve your experience on this site and nothing else at all.</p></div>'
COMMENTS = '<section class="comments">' + "".join(f"<p>I am reader {k} and say that this is a very good article, thank you so much.</p>" for k in range(20)) + "</section>"


@pytest.mark.parametrize("rest", ["", NOTICE, COMMENTS, '<div id="sidebar"><p>Other things to read after this page, if one has the time for it.</p></div><footer>c</footer>'])
@pytest.mark.parametrize(
    "wrapper",
    [
        'div class="layout has-sidebar"', 'div class="content no-sidebar"', 'div class="single-post social-enabled"', 'div id="main" class="page search-results"', 'div class="post-header-image"',
        'div class="with-ads"', 'section class="promo-free"', 'article class="post comments-open"', 'article class="post has-related"', 'form id="aspnetForm"', 'div class="banner-layout"', 'div style="display:none"',
    ],
)
def test_a_name_does_not_empty_a_page(wrapper, rest):
    tag = wrapper.split()[0]
    nav = "<nav><a href=x>Home</a> <a>News</a></nav>"
    assert html_text.main_text(f"<html><body>{nav}<{wrapper}>{ARTICLE}{rest}</{tag}></body></html>") == WANT
    assert html_text.main_text(f"<html><body>{nav}<{wrapper}>{ARTICLE}</{tag}>{rest}</body></html>") == WANT


def test_boilerplate_alone_is_no_article():
    assert html_text.main_text(f"<body><nav><a>x</a></nav>{NOTICE}<footer>Imprint of the company, with its long address and all telephone numbers.</footer></body>") == ""


def brute_content(ratio, sigma=1.0, share=0.5):
    n = len(ratio)
    if n < 2:
        return [True] * n
    smooth = []
    for i in range(n):
        own = [(math.exp(-0.5 * ((i - j) / sigma) ** 2), ratio[j]) for j in range(n) if abs(i - j) <= int(3 * sigma)]
        smooth.append(math.log1p(sum(w * r for w, r in own) / sum(w for w, _ in own)))
    low, high = min(smooth), max(smooth)
    for _ in range(20):
        cut = low + (high - low) * share
        below, above = [x for x in smooth if x <= cut], [x for x in smooth if x > cut]
        if not below or not above:
            break
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    least = min(low + (high - low) * share, max(smooth))
    return [x >= least - 1e-9 for x in smooth]


def test_clusters_against_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        ratio = [rng.choice((rng.uniform(0, 5), rng.uniform(20, 200), 1.0)) for _ in range(rng.randint(0, 60))]
        assert html_text.content(np.array(ratio)).tolist() == brute_content(ratio)


def test_suspects_against_brute_force():
    """Opening the largest suspect, one at a time, until enough content lies outside."""
    rng = random.Random(3)
    for _ in range(300):
        around = [0] + [rng.randrange(k) for k in range(1, rng.randint(1, 9))]
        lines = [("x" * rng.choice((5, 100, 2000)), 1, 0, 0, rng.randrange(len(around)), False) for _ in range(rng.randint(0, 8))]
        chain = lambda k: {k} | (chain(around[k]) if k else {0})  # noqa: B023, E731
        opened = {0}
        while True:
            outside = sum(len(t) for t, _, _, _, s, _ in lines if chain(s) <= opened)
            shut = [(sum(len(t) for t, _, _, _, s, _ in lines if k in chain(s)), -k) for k in range(1, len(around)) if k not in opened and around[k] in opened]
            if not shut or max(shut)[0] < html_text.SOME_PROSE or outside >= html_text.LEAST_OUTSIDE * max(shut)[0]:
                break
            opened.add(-max(shut)[1])
        assert html_text.dropped_suspects(lines, around, list(range(len(lines)))) == set(range(len(around))) - opened


def test_nested_pages_take_linear_time():
    def seconds(n):
        pages = ("<div>" * n + "x" + "</span>" * n + "</p>" * n, "<b><div>" + "<i>" * n + "x" + "</b>" * n, '<div class="ad">' * n + "x " * 200, "<svg>" + "<g>" * n + "</div>" * n)
        began = time.process_time()
        for page in pages:
            html_text.main_text(page)
        return time.process_time() - began

    seconds(1000)
    assert seconds(20000) < 40 * seconds(2000) + 0.5  # ten times the input


def test_clashing_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "a text", "x", "y")], "doc_id long, text string, IDS string, ids_input string")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    r = bpe.decode_documents(bpe.encode_documents(docs, ranks), ranks, out="text").first().asDict()
    assert (r["IDS_input_input"], r["ids_input"], r["text_input"], bytes(r["text"])) == ("x", "y", "a text", b"a text")
    assert list(r["ids"]) == bpe.encoder_of(ranks).encode("a text")
    r = html_text.extract_pages(docs, "text").first().asDict()
    assert (r["text"], r["text_input"]) == ("a text", "a text")
    r = winnow.fingerprint(docs, out="ids").first().asDict()
    assert len(r["ids"]) == 1 and r["IDS_input_input"] == "x"
    r = langid.identify(docs, langid.learn(docs, lang_col="IDS"), out="Text").first().asDict()
    assert r["Text"]["lang"] == "x" and r["text_input"] == "a text"


def test_empty_pages_table(spark):
    rows = spark.createDataFrame([], "page_id long, html string")
    assert html_text.extract_pages(rows).columns == ["page_id", "html", "text"] and html_text.extract_pages(rows).count() == 0
