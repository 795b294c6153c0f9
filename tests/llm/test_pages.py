"""HTML extraction: what stays in an article, what goes, and exact matching of long lists."""

import random
import time

import numpy as np

from kinespark.llm import dom, pages


def test_repeated_blocks_and_innocent_names_stay_in_an_article(spark):
    def html(k):
        body = f"<h1>Title {k}</h1><h2>Background</h2><p>Text {k} of this page.</p><p>All prices include tax.</p><p class='share-price'>12.{k}</p><section id='market-search'>Markets {k}</section>"
        body += f"<p class='legal'>Terms {k}</p><noscript>Shown {k}</noscript><xmp>a < b &amp; {k}</xmp><h2>Summary</h2>"
        body += f"<div class='ad-box'>buy {k}</div><div id='reader-comments'>nice {k}</div><div class='cookie_notice2'>ok {k}</div><ul class='menu2'><li>go {k}</li></ul>"
        return f"<html><body><ul class='menu2'><li>m {k}</li></ul><article>{body}</article></body></html>"

    rows = [(k, f"http://one.example/{k}", html(k), "clash") for k in range(5)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, _others string")).collect()}
    for k in range(5):
        want = ["Title %d", "Background", "Text %d of this page.", "All prices include tax.", "12.%d", "Markets %d", "Terms %d", "Shown %d", "a < b &amp; %d", "Summary"]
        lines = [w % k if "%d" in w else w for w in want]
        # Inline text between blocks is a block of its own.
        assert got[k] == "\n".join(lines), got[k]


def test_constant_headings_among_slots_stay_where_the_root_is_found(spark):
    def html(k):
        return f"<body><div><div>Welcome to the site</div><div>Read all our offers</div></div><div><h2>Background</h2><p>{'words of page %d ' % k * 9}</p><p>All prices include tax.</p><div>Sign here</div></div></body>"

    rows = [(k, "http://two.example/", html(k)) for k in range(5)]
    for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r["text"] == "Background\n" + ("words of page %d " % r["page_id"] * 9).strip() + "\nAll prices include tax."


def test_long_lists_match_exactly(monkeypatch):
    rng = random.Random(7)
    for table in (1, 50, 4_000_000):
        monkeypatch.setattr(dom, "TABLE", table)
        for _ in range(30):
            n, m = rng.randint(1, 25), rng.randint(1, 25)
            weights = np.array([[rng.choice((0, 0, 1, 2, 5)) for _ in range(4)] for _ in range(4)])
            xs, ys = [np.array([rng.randrange(4) for _ in range(k)]) for k in (n, m)]
            best = [[0] * (m + 1) for _ in range(n + 1)]
            for i in range(n):
                for j in range(m):
                    best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weights[xs[i]][ys[j]])
            found = dom.matched(weights, xs, ys)
            assert sum(weights[xs[i], ys[j]] for i, j in found) == best[n][m]
            assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:]))


def test_long_lists_of_siblings():
    rng = random.Random(8)
    make = lambda: "<div>" + "".join(f"<{t}>x</{t}>" for t in rng.choices(("dl", "ul", "ol", "table"), k=600)) + "</div>"
    a, b = dom.parse(make()), dom.parse(make())
    assert dom.align(a, b) > 200


def test_very_long_page(spark):
    html = "<article>" + "<p>some words of a paragraph</p>" * 50_000 + "</article>"
    rows = [(k, "http://three.example/", html + f"<p>{k}</p>") for k in range(3)] + [(9, None, None), (10, "", "")]
    got = {r["page_id"]: r for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0]["n_chars"] == 50_000 * 26 - 1 and got[9]["text"] == got[10]["text"] == ""


def test_articles_beside_one_another_are_all_kept():
    page = lambda k: f"<html><body><nav>menu</nav><article><p>First story {k} goes on for a while.</p></article><article><h2>Second {k}</h2><p>It has words {k}.</p></article><footer>end</footer></body></html>"
    others = [dom.parse(page(k)) for k in range(1, 5)]
    want = "First story 0 goes on for a while.\nSecond 0\nIt has words 0."
    assert pages.extract(page(0), others) == want == pages.extract(page(0))


def test_an_unclosed_quote_leaves_no_markup():
    assert pages.extract('<article><p>one</p>\n<a href="x>link\n</a><p>two') == "one\nlink\ntwo"


def test_broken_markup_is_read_in_linear_time():
    for piece, end in (('<a "x" ', ""), ('<a "x" ', '">'), ("<b>", ""), ("</i>", ""), ("<!a ", ""), ("<li><ul>", "</li>"), ("<a '>", '"')):
        page = "<article><p>text</p>" + piece * (500_000 // len(piece)) + end * 50_000
        began = time.time()
        dom.parse(page)
        assert time.time() - began < 10, piece
    page = "<b>" * 20_000 + "<p>x</p></i>" * 20_000
    began = time.time()
    dom.parse(page)
    assert time.time() - began < 10
