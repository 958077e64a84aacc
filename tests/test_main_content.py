"""Main text: hand-made pages with boilerplate, the articles of the given pages, options, repeated segments."""

import re
from html import unescape

import pytest

from claimspark.plans import QUERIES
from claimspark.sources import main_content
from claimspark.sources.main_content import Options, best_segments

from .compare import DATA, connect

BODY = ["The council met on Monday to vote on the plan that it had put off since the spring, and nobody spoke against it.", "After two hours the mayor read out the result: forty votes for, three against, and the rest did not take part at all.", "Work on the bridge begins next year, as the paper had reported before, if the money is found by then."]
MENU = "<ul>" + "".join(f"<li><a href='/{w}'>{w} and more news</a></li>" for w in ("Sports", "Arts", "World", "Money")) + "</ul>"
PAGES = {
    "plain divs": f"<html><body><div>{MENU}</div><div><h1>Bridge vote</h1>{''.join(f'<p>{x}</p>' for x in BODY)}</div><div>{MENU}<p>Contact us</p></div></body></html>",
    "named boilerplate": f"<body><div class='cookie-banner'><p>{'We use cookies to keep you signed in and to count visits. ' * 5}</p></div><div id='x'>{''.join(f'<p>{x}</p>' for x in BODY)}</div><div class='related'><p>{'Other stories that you may like to read today. ' * 6}</p></div></body>",
    "article": f"<body><article><h1>Bridge vote</h1>{''.join(f'<p>{x}</p>' for x in BODY)}</article><div><p>Subscribe to our paper for more news every day of the week.</p></div></body>",
    "open paragraphs": f"<body><nav>{MENU}</nav><div>{''.join(f'<p>{x}' for x in BODY)}</div><footer>All rights reserved</footer></body>",
    "breaks": f"<body><div><td>{MENU}</td></div><table><tr><td>{'<br><br>'.join(BODY)}</td></tr></table></body>",
    "broken": f"<body><div>{MENU}</div><div><p>{BODY[0]}</p><b><p>{BODY[1]}</div><p>{BODY[2]}</p></span></body>",
}


def words(t):
    return re.findall(r"\w+", t or "")


@pytest.mark.parametrize("name", sorted(PAGES))
def test_boilerplate(name):
    found, reason = best_segments(PAGES[name])
    got, want = words(" ".join(found)), words(" ".join(BODY))
    hits = sum(min(got.count(w), want.count(w)) for w in set(want))
    assert reason is None and hits / len(want) == 1 and hits / len(got) > 0.9, found


def test_options():
    page = PAGES["article"]
    assert best_segments("<p>x") == (None, "file too small") and best_segments("", Options(min_file_size=0)) == (None, "no content")
    assert best_segments(page, Options(max_file_size=100)) == (None, "file too large")
    assert best_segments(page, Options(max_tree_size=3)) == (None, "too many elements")
    assert best_segments(page, Options(min_output_size=10_000)) == (None, "no content")
    short = "<body><div><a href='/'>home page</a></div><p>Too short to be an article.</p></body>"
    assert best_segments(short) == (["Too short to be an article."], None)
    assert best_segments("<body><nav>x</nav><p><a href='/'>home page</a></p></body>") == (["home page"], None)
    assert best_segments("<p>" + "&amp; " * 300)[0] == [" ".join(["&"] * 300)]


def test_repeated_segments(spark):
    notice = "This paper is printed by the same press as its sister papers, and all that it says is free to be quoted with its name."
    own = [f"Story number {k} is about the bridge over river {k} and tells at length how it was built, by whom, and what it cost then." for k in range(5)]
    page = lambda k: f"<body><div><p>{own[k]}</p><p>{notice}</p><p>{own[k]} It goes on.</p></div></body>"
    rows = [(k, "https://a.org/x" if k < 3 else "https://b.org/y", page(k)) for k in range(5)] + [(9, None, None), (10, "https://a.org/z", "<p>")]
    got = {r.page_id: r for r in main_content.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), "page_id", "url", "html").collect()}
    assert all(notice not in got[k].content and got[k].n_dropped == 1 and own[k] in got[k].content for k in range(3))
    assert all(notice in got[k].content and got[k].n_dropped == 0 for k in (3, 4))  # twice is allowed
    assert (got[9].content, got[9].reason, got[9].site) == (None, "no page", "") and got[10].reason == "file too small"
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert main_content.extract(none, "page_id", "url", "html").count() == 0
    loose = main_content.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", "url", "html", Options(max_repetitions=9)).collect()
    assert sum(r.n_dropped for r in loose) == 0


def test_given_pages(spark):
    """Precision and recall of words against what stands in the pages' article elements."""
    got = {r.page_id: r.content for r in QUERIES["main_content"](spark, DATA).collect()}
    pages = connect().sql("SELECT page_id, html FROM pages").fetchall()
    hits = said = there = 0
    for page, html in pages:
        article = re.search(r"(?s)<article>(.*?)</article>", html)
        if article and got[page]:
            want, have = words(unescape(re.sub(r"<[^>]*>", " ", article[1]))), words(got[page])
            hits, said, there = hits + sum(min(have.count(w), want.count(w)) for w in set(want)), said + len(have), there + len(want)
    assert len(got) == len(pages) and there > 1000 and hits / there > 0.95 and hits / said > 0.95
