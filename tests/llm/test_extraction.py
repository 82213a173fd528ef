from collections import Counter

import numpy as np

from phylospark.llm import extraction as X
from tests.llm import labelled_pages


def test_article_among_furniture():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div>
    <article><header><h1>Title &amp; more</h1></header><p>First   <b>bold</b>text of the article, with enough words to count.<p>Short.</p><form><input name=q><label>Mail</label></form>
    <ul><li>one</li><li><a href=/y>two</a></li></ul><aside>Aside</aside></article>
    <div id="sidebar">Latest posts and other things</div><section class="comments"><article><p>I liked this, says a reader at some length, again and again.</p></article></section><footer>&copy; us</footer></body></html>"""
    assert X.main_text(html) == "Title & more First boldtext of the article, with enough words to count. Short. one two"


def test_without_article_the_ratio_selects():
    menu = "".join(f"<div><a href='/{i}'>Entry {i}</a></div>" for i in range(8))
    body = "".join(f"<p>{'Some running text of a page. ' * 6}</p>" for _ in range(6))
    text = X.main_text(f"<body><div>{menu}</div><div>{body}<p>End.</p></div></body>")
    assert "Entry" not in text and text.endswith("End.") and text.count("Some running") == 36


def test_one_long_paragraph_drops_nothing():
    short, long = "Words of a paragraph. " * 5, "Words of a long paragraph, many of them. " * 125
    for middle in (f"<p>{long}</p>", f"<p><b>{long}</p>", f"<p>{long[:2500]}<br>{long[2500:]}</p>"):
        got = X.main_text(f"<body><h1>T</h1><p>{short}</p>{middle}<p>End: {short}</p></body>")
        assert got.startswith("T Words of a paragraph.") and got.endswith(f"End: {short.strip()}") and got.count("long") == 125


def test_sibling_sections_all_belong():
    intro, body, close = "Some words of an intro. " * 12, "Running text of the body of it. " * 12, "Closing words of a page. " * 12
    got = X.main_text(f"<body><nav><a href=/>Home</a></nav><div><p>{intro}</p></div><div>{f'<p>{body}</p>' * 20}</div><div><p>{close}</p></div></body>")
    assert got.count("intro") == 12 and got.count("body") == 240 and got.count("Closing") == 12 and "Home" not in got
    got = X.main_text(f"<body><article><p>{body}</p><ul><li><a href=/y>two</a></ul></article><div>{f'<p>{close}</p>' * 2}</div></body>")
    assert got.count("body") == 12 and got.count("Closing") == 24 and "two" in got


def test_broken_and_empty_pages():
    assert X.main_text(None) == X.main_text("") == X.main_text("<p>") == ""
    assert X.main_text("plain &lt;text&gt; only") == "plain <text> only"
    assert X.main_text("<article><p><b>Open<br><p>Next</article></div></p>") == "Open Next"
    assert X.main_text("<article><p>a</p><!-- open <p>b") .startswith("a")
    assert X.main_text("<div>" * 3000 + "deep") == "deep"


def test_smoothing_keeps_a_constant():
    assert np.allclose(X.smooth(np.full(9, 3.0)), 3.0)


def test_table(spark):
    rows = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "<p>a  b</p>", "y"), (None, None, "<p>é</p>", None)], "page_id long, url string, html string, text string")
    got = sorted(map(str, (tuple(r) for r in X.extract(rows, "page_id", "html", ["url"]).collect())))
    assert got == sorted(map(str, [(1, "u", ""), (1, "u", "a b"), (None, None, "é")]))
    assert X.extract(rows.limit(0), "page_id", "html").count() == 0


def quality():
    """(name, precision, recall) by words of each labelled page."""
    for name, html, wanted in labelled_pages.pages():
        got, own = Counter(X.main_text(html).split()), Counter(wanted.split())
        both = (got & own).total()
        yield name, both / max(1, got.total()), both / own.total()


def test_labelled_pages():
    rows = list(quality())
    assert len(rows) >= 40
    assert np.mean([p for _, p, _ in rows]) >= 0.97 and np.mean([r for *_, r in rows]) >= 0.97, [r for r in rows if min(r[1:]) < 0.95]


def test_names_around_a_region_do_not_matter():
    text = "Some running text of the page that goes on. " * 6
    for name in ("widget-content", "search-results-page", "notice-board", "header-and-text"):
        for attr in ("class", "id"):
            got = X.main_text(f"<body><nav><a href=/>Home</a></nav><div {attr}='{name}'><h1>Title</h1>{f'<p>{text}</p>' * 3}<p>End.</p></div><footer>&copy; us</footer></body>")
            assert got.startswith("Title Some") and got.endswith("End.") and got.count("running") == 18


def changed(monkeypatch, name, value):
    """Shares of labelled pages, all and those without article or main, whose text is another with this part of the method replaced."""
    pages = list(labelled_pages.pages())
    before = [X.main_text(html) for _, html, _ in pages]
    with monkeypatch.context() as patch:
        patch.setattr(X, name, value)
        other = [X.main_text(html) != b for (_, html, _), b in zip(pages, before, strict=True)]
    plain = [o for o, (_, html, _) in zip(other, pages, strict=True) if "<article" not in html and "<main" not in html]
    return np.mean(other), np.mean(plain)


def test_smoothing_clusters_and_names_decide(monkeypatch):
    clusters = X.clusters
    assert changed(monkeypatch, "smooth", lambda ratio, sigma=0: ratio)[1] > 0.1
    assert changed(monkeypatch, "clusters", lambda lines: (np.ones(len(lines), bool), clusters(lines)[1]))[1] > 0.05
    assert changed(monkeypatch, "clusters", lambda lines: (np.ones(len(lines), bool),) * 2)[0] > 0.2
    assert 0.1 < changed(monkeypatch, "found_marks", lambda value, tag, inside: set())[0] < 0.3


def test_comments_and_sidebars_however_long():
    short, reader = "Short words of the article here, some.", "I was there too and it was far worse than the paper says, believe me. " * 38
    two = f"<p>{reader}</p><p>{reader}</p>"
    assert X.main_text(f"<body><article><h1>T</h1><p>{short}</p><p>{short}</p><section class='comments'>{two}</section></article>") == f"T {short} {short}"
    assert X.main_text(f"<body><div>{f'<p>{short}</p>' * 30}</div><div class='comments'>{two}</div>") == " ".join([short] * 30)
    assert X.main_text(f"<body><article><p>{short}</p></article><aside><p>{reader}</p></aside>") == short
    assert X.main_text(f"<body><div class='comments'><p>{short}</p></div><a href=/>Home</a>") == short  # there is no other text


def test_deep_and_unclosed_pages_take_their_time_once():
    import time

    took = []
    for n in (5_000, 40_000):
        began = time.perf_counter()
        assert X.main_text("<div><p>text" * n).count("text") == n
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 1
    assert X.main_text("<div class=ad>" * 20_000 + "deep") == "deep"


def test_very_long_page_keeps_all():
    body = "".join(f"<p>Paragraph {i} of a very long page with some words.</p>" for i in range(20_000))
    got = X.main_text(f"<body><ul><li><a href=/>Home</a></li></ul><div>{body}</div></body>")
    assert got.count("Paragraph") == 20_000 and "Home" not in got


def test_query_equals_the_kernel(spark, tmp_path):
    rows = [(i, f"u{i}", html, "t") for i, (_, html, _) in enumerate(labelled_pages.pages())] + [(900, None, None, "t"), (901, "u", "", "t")]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(map(tuple, X.op4_extraction(spark, str(tmp_path)).collect()))
    assert got == [(i, u, X.main_text(h), len(X.main_text(h))) for i, u, h, _ in rows]
