"""Names, headings, tables and inline elements of articles against whole pages of known text."""

import random

import pytest

from sparklog.llm import html_text

SENTENCES = [
    "The harbour was built by hand in the second century and has been dredged ever since.", "Its walls carry the marks of the masons who were paid by the cubit.",
    "Ships from the south brought oil, and took back wool, timber and salted fish.", "Nobody remembers when the lighthouse was lit for the last time.",
    "A survey of the sea bed found eleven wrecks, the oldest of them loaded with amphorae.", "The town council has voted twice to move the market, and twice has changed its mind.",
]
BODY = [f"<p>{s}</p>" for s in SENTENCES]


@pytest.mark.parametrize(
    ("part", "text"),
    [
        ('<div class="entry-header"><h1>The harbour</h1></div>', "The harbour"), ('<div class="page-header"><h1>The harbour</h1></div>', "The harbour"), ('<h2 class="section-header">Walls</h2>', "Walls"),
        ('<section id="social-history"><p>' + SENTENCES[3] + "</p></section>", SENTENCES[3]), ('<section class="menu-recipes"><p>' + SENTENCES[2] + "</p></section>", SENTENCES[2]),
        ('<div class="widget-guide"><p>' + SENTENCES[1] + "</p></div>", SENTENCES[1]), ('<p id="reply-to-critics">' + SENTENCES[4] + "</p>", SENTENCES[4]),
        ('<p>It has <mark class="search-hit">a mark</mark> inside.</p>', "It has a mark inside."), ('<pre><span class="hljs-comment"># note</span> x = 1</pre>', "# note x = 1"),
        ('<p>See <a class="related">this</a> and <abbr class="ad">AD</abbr> 79.</p>', "See this and AD 79."), ("<table><tr><td>1</td><td>two</td></tr></table>", "1\ntwo"),
    ],
)
@pytest.mark.parametrize("wrapper", ["article", "main", "div"])
def test_parts_of_an_article_stay(part, text, wrapper):
    for place in (0, 3, len(BODY)):
        blocks, want = BODY[:], SENTENCES[:]
        blocks.insert(place, part)
        want.insert(place, text)
        page = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><{wrapper}>{''.join(blocks)}</{wrapper}><footer>Imprint</footer></body></html>"
        if wrapper == "div" and place != 3 and not part.startswith(("<div class=\"e", "<div class=\"p", "<h2", "<section", "<p id")):
            continue  # at its edge, outside of any article, only what holds content is told from furniture
        assert html_text.main_text(page) == "\n".join(want), (wrapper, place)


def test_containers_without_article_or_main():
    inner = f'<div class="title"><h1>The harbour</h1></div><div><p>{SENTENCES[0]}</p><p>{SENTENCES[1]}</p></div><div><p>Short.</p></div><div><p>{SENTENCES[2]}</p></div><div>The end.</div>'
    page = f'<body><div class="menu"><a href="/">Home</a></div><div id="content">{inner}</div><div class="sidebar">Follow us on all channels for more news of the day</div></body>'
    assert html_text.main_text(page) == "\n".join(["The harbour", SENTENCES[0], SENTENCES[1], "Short.", SENTENCES[2], "The end."])


def test_names():
    furniture = ["sidebar", "ad", "ad-slot-3", "cookie-notice", "siteHeader", "main-menu", "related-posts", "comments", "comment-list", "newsletter_signup", "share-buttons", "page-footer", "breadcrumbs", "gdpr-consent-modal"]
    assert [n for n in furniture if html_text.suspect_name(n, False) != 2] == []
    assert [n for n in ("social-history", "menu-recipes", "widget-guide", "reply-to-critics", "banner-carriers") if html_text.suspect_name(n, False) != 1] == []
    assert [n for n in ("entry-header", "page-header", "content", "no-sidebar", "has-ads", "loading", "article-body") if html_text.suspect_name(n, False)] == []


FURNITURE = [
    '<div class="sidebar"><p>Follow us on all channels for more news, offers and pictures of the day.</p></div>', '<div class="ad">Buy two, get one free. Only this week.</div>',
    '<div id="cookie-notice"><p>We use cookies to improve your visit. By staying you accept them all.</p></div>', "<form><label>Mail</label><input><p>Subscribe to our letter, it is free of charge.</p></form>",
    '<aside><p>More of the same kind, chosen for you by our editors in chief.</p></aside>', '<div class="comments"><p>Great piece, I have read it twice and sent it to my aunt.</p></div>',
    '<ul class="share-buttons"><li><a href="#">Share</a></li><li><a href="#">Mail</a></li></ul>', '<div role="banner">The daily paper of the town and the coast</div>', '<script>var t = "</p>";</script>', "<style>p{margin:0}</style>",
]


def test_whole_pages_of_known_text():
    """Random pages: an article of paragraphs, headings, lists, tables and notes, furniture around and inside it."""
    rng = random.Random(5)
    for _ in range(300):
        blocks, want = [], []
        for _ in range(rng.randint(4, 12)):
            text = " ".join(rng.sample(SENTENCES, rng.randint(1, 3)))
            kind = rng.choice(["p", "p", "p", "h2", "ul", "table", "div", "quote"])
            if kind == "h2":
                text = text.split(".")[0][:30].strip()
                blocks.append(f'<h2 class="{rng.choice(["section-header", "widget-title", ""])}">{text}</h2>')
            elif kind == "ul":
                blocks.append(f"<ul><li>{text}</li></ul>")
            elif kind == "table":
                blocks.append(f"<table><tr><td>{text}</td></tr></table>")
            elif kind == "div":
                blocks.append(f'<div class="{rng.choice(["social-history", "note", "menu-recipes"])}"><p>{text}</p></div>')
            elif kind == "quote":
                blocks.append(f"<blockquote>{text}</blockquote>")
            else:
                blocks.append(f"<p>{text.replace(' the ', ' <b class=ad>the</b> ')}</p>")
            want.append(text)
            if rng.random() < 0.2:
                blocks.append(rng.choice(FURNITURE))
        around = [rng.choice(FURNITURE) for _ in range(rng.randint(0, 3))]
        page = f"<html><head><title>x</title></head><body><header>Site</header><nav><a>Home</a></nav>{''.join(around[:1])}<article>{''.join(blocks)}</article>{''.join(around[1:])}<footer>Imprint</footer></body></html>"
        assert html_text.main_text(page) == "\n".join(want)
