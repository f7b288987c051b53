"""Line-block distribution: windows decide with and without a declared article."""

import html
import re
import resource
import time

import pandas as pd
import pytest

from pulsewide.llm.html import main_text

STORY = "Long text of a story that goes on and on, with many words in it and more to come, so it surges."
MORE = "And another paragraph, which has as many words as the first one had, and perhaps one or two more."


def article_of(page):
    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", article)]
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_every_page_with_and_without_its_declaration(size):
    """Without ``article`` the windows alone find the same text."""
    for page in pd.read_parquet(f"/root/testdata/{size}/pages.parquet").html:
        want = article_of(page)
        assert main_text(page) == want
        plain = page.replace("<article>", "<div>").replace("</article>", "</div>")
        assert main_text(plain) == want


@pytest.mark.parametrize(("page", "want"), [
    # text goes on behind an advert, before a share box, in a headline that is a link
    (f"<body><div><p>{STORY}</p><div class=ad>x</div><p>Short last one.</p></div></body>", f"{STORY}\nShort last one."),
    (f"<body><div><h1>Head</h1><div class=share>tell</div><p>{STORY}</p></div></body>", f"Head\n{STORY}"),
    (f"<body><div><h1><a href=x>Head line</a></h1><p>{STORY}</p></div></body>", f"Head line\n{STORY}"),
    (f"<body><div><div><p>{STORY}</p></div><aside>x</aside><div><p>Short.</p></div></div></body>", f"{STORY}\nShort."),
    # a stray line behind the footer is not the article
    (f"<body><div><p>{STORY}</p></div><footer>f</footer><p>stray</p></body>", STORY),
    # a story outside, teaser cards in articles
    (f"<body><div class=story><p>{STORY}</p><p>{MORE}</p></div><article>Teaser one</article><article>Teaser two</article></body>", f"{STORY}\n{MORE}"),
    (f"<body><article><p>Brief.</p></article><div>{STORY[:15]}</div></body>", "Brief."),
    # whole names decide, and what is named last
    (f"<article><div class='social-science'><p>{STORY}</p></div><p class='legal-history'>{MORE}</p></article>", f"{STORY}\n{MORE}"),
    (f"<article class='post has-sidebar'><p>{STORY}</p><div class='comments-open'>{MORE}</div></article>", f"{STORY}\n{MORE}"),
    (f"<body><div><p>{STORY}</p></div><div class='post-comments'><p>{MORE}{MORE}</p></div></body>", STORY),
    (f"<body><div><p>{STORY}</p></div><div class='sidebar-left ad-slot-3'><p>{MORE}{MORE}</p></div></body>", STORY),
    (f"<article><p>{STORY}</p><div style='color:red; display: none'>gone</div><p style='display:block'>stays</p></article>", f"{STORY}\nstays"),
    # the windows run into zero at a long list of links
    (f"<body><div><p>{STORY}</p>" + "<p><a href=x>a link of some length</a></p>" * 9 + "</div></body>", STORY),
])
def test_what_belongs_to_the_article(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("page", [
    "<div class=ad>some text" * 45_000, "<div>some text" * 70_000, "<article>x" * 90_000, "<svg>" * 90_000, "<noscript>a<p>" * 60_000,
    "<p>a <b class='menu'>b" * 45_000, "<" * 1_000_000, "<a href='" * 100_000, "<p>" + "word " * 200_000,
])
def test_long_and_deep_pages_need_little(page):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    start = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - start < 10
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000
