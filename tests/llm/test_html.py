from __future__ import annotations

import html as entities
import re

from pyspark.sql import functions as F

from countinghouse.llm import html_template, queries
from tests.llm.conftest import FOLDER

PAGE = """<!doctype html><html><body class="no-sidebar"><header class="site"><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><nav><a>Home</a></nav><main><article class="post">
<header><h1>Title &amp; more</h1><p class="byline">By X</p></header><p>One<br>two <a href="a>b">link</a>.
<p>Three &#8217;q&nbsp;z</p><aside>side</aside><div class="ad-slot">AD</div><ul><li>a<li>b</ul>
<table><tr><td>1<td>2</table><form><input>f</form><script>var t="</p>"</script><style>p{}</style>
<section class="comments"><p>comment</p></section></article><div class="related"><article><p>teaser</p>
</article></div></main><footer>foot</footer></body></html>"""


def text_of(html):
    return html_template.SEPARATOR.join(text for text, _ in html_template.Page(html).main())


def test_article_without_the_rest():
    assert text_of(PAGE) == "Title & more\n\nOne two link.\n\nThree ’q z\n\na\n\nb\n\n1 2"
    box = "<article><{0} class='market-share'>x</{0}><p class='notice'>y</p><p>z</p></article>"
    assert [text_of(box.format(name)) for name in ("p", "div")] == ["x\n\nz", "x\n\nz"]
    assert text_of("<div><p>a<p>b <b>x</b>y</div> c < 5 <p class='x") == "a\n\nb xy\n\nc < 5"
    assert [text_of(x) for x in ("", "<", "plain", "<p>" * 3, "<script>x")] == ["", "<", "plain", "", ""]


def test_only_names_of_other_things_leave_text_out():
    kept = [
        '<p data-class="comment">x</p>', '<p title="a class=ads here">x</p>', "<div class='share-price'>x</div>",
        '<div class="search-engines">x</div>', '<p class="ad-hoc">x</p>', '<div id="related-work">x</div>',
        '<div class="market-share">x</div>', "<div data-x='1' title='role=search'>x</div>",
        '<div class="with-sidebar">x</div>', '<div aria-label="comment" class=text>x</div>',
        '<div title="class=" ad>x</div>', '<div class="commentary advertiser">x</div>',
    ]
    gone = [
        '<div class="ad">x</div>', '<div CLASS=ad-slot>x</div>', "<div id='top-banner'>x</div>",
        '<p class="comment">x</p>', '<div class="box related-posts">x</div>', '<div class="shareButtons">x</div>',
        '<div role="search">x</div>', '<section class="comments-list">x</section>', '<div class="site-footer">x</div>',
        '<div class="cookie-notice">x</div>', '<div class="a" id="newsletter-signup-form">x</div>',
        '<div data-a="b>c" class="ad">x</div>', "<div class = 'ad_unit_2'>x</div>",
    ]
    for part in kept:
        assert text_of(f"<article><p>y</p>{part}</article>") == "y\n\nx", part
    for part in gone:
        assert text_of(f"<article><p>y</p>{part}</article>") == "y", part


def test_long_and_deep_pages():
    for html in ("<div>" * 5_000 + "x", "<p><b>" * 20_000 + "x", "<" * 100_000, '<a "' * 20_000,
                 "<p " + "a=b " * 50_000 + ">x", "<p " + "a = '" * 50_000, "<div class='" + "ad-x " * 50_000 + "'>x"):
        html_template.Page(html)


def plain(html):
    article = html.split("<article>")[1].split("</article>")[0]
    blocks = (
        " ".join(entities.unescape(re.sub("<[^>]*>", " ", x)).split())
        for x in re.split("</?(?:p|h1)>", article)
    )
    return "\n\n".join(x for x in blocks if x)


def test_query(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    wanted = sorted((p.page_id, p.url, plain(p.html), len(plain(p.html))) for p in pages)
    assert sorted(map(tuple, queries.op10_site_templates(spark, FOLDER).collect())) == wanted


def test_templates_go_copies_stay(spark):
    body = "<body><div><a>Home</a> start</div><div><p>story {}</p></div><p>Join us</p></body>"
    rows = [(n, f"https://a.com/{n}", body.format(n)) for n in range(20)]
    rows += [(100 + n, f"http://b.org/{n}", f"<body><div>bar</div><p>x{n}</p>") for n in range(5)]
    shared = "<article><div>read more here</div><p>same text</p><p>n{}</p></article>"
    rows += [(200 + n, f"//c.de/{n}?q", shared.format(n)) for n in range(12)]
    rows += [(300, None, None), (301, "https://a.com/q", ""), (302, "no address", "just text")]
    rows += [(0, "https://a.com/0", body.format(0))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for name in ("row", "text", "host", "hash", "blocks"):
        pages = pages.withColumn(name, F.lit("x"))
    found = sorted(((r.page_id, r.text) for r in html_template.main_text(pages).collect()))
    wanted = [(0, "story 0")] + [(n, f"story {n}") for n in range(20)]
    wanted += [(100 + n, f"bar\n\nx{n}") for n in range(5)]
    wanted += [(200 + n, f"same text\n\nn{n}") for n in range(12)]
    assert found == [*wanted, (300, ""), (301, ""), (302, "just text")]
    assert html_template.main_text(pages.limit(0)).count() == 0


def test_template_paragraphs_in_articles_go_and_copied_passages_stay(spark):
    """In hosts of any size: a paragraph at one place goes, one at any place and copies stay."""
    page = "<title>{0} | Site</title><article><h1>{0}</h1>{1}<p>Join us</p><blockquote>Ask</blockquote></article>"

    def paragraphs(n):
        own = [f"<p>own {n} {k}</p>" for k in range(6)]
        own[n % 6] = "<p>a copied passage</p>"
        return "".join(own)

    rows = [(n, f"https://a.com/{n}", page.format(f"Title {n}", paragraphs(n))) for n in range(60)]
    rows.append((99, "https://a.com/99", page.format("Title 99", "<p>Join us</p><p>own</p>")))
    copy = "<title>Same</title><article><h1>Same</h1><p>Copied {}</p><p>whole</p></article>"
    rows += [(100 + n, f"https://a.com/c{n}", copy.format(n)) for n in range(40)]
    rows += [(1_000 + n, f"https://a.com/o{n}", f"<article><p>x {n}</p></article>") for n in range(900)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {row.page_id: row.text for row in html_template.main_text(pages).collect()}
    for n in range(60):
        kept = html_template.SEPARATOR.join(re.findall("<p>(.*?)</p>", paragraphs(n)))
        assert found[n] == f"Title {n}\n\n{kept}"
    assert found[99] == "Title 99\n\nJoin us\n\nown"
    assert all(found[100 + n] == f"Same\n\nCopied {n}\n\nwhole" for n in range(40))
    assert all(found[1_000 + n] == f"x {n}" for n in range(900))
