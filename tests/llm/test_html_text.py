import re
from collections import Counter

import pytest

from ledgerlake.llm import html_text

from .helpers import table

P = "<p>" + "Words of an article that goes on for a while, with marks. " * 3 + "</p>"
T = ("Words of an article that goes on for a while, with marks. " * 3).strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("   \n", ""),
        (f"<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1>{P}{P}</article><footer>All rights</footer></body></html>", f"Title\n{T}\n{T}"),
        (f"<body><div class='menu'>Menu item</div><div>{P}{P}</div><div id=comments><p>{T} {T}</p></div></body>", f"{T}\n{T}"),
        ("<article><p>a &amp; b&nbsp;&#x41; &eacute; &lt;tag&gt;</p></article>", "a & b A é <tag>"),
        ("<article><p>a\n  b\t c<br>d <b>e</b>f</p><script>var x = '<p>no</p>';</script><style>p{}</style><!-- no --></article>", "a b c d ef"),
        ("<article><p>one<p>two</article>", "one\ntwo"),
        ("<article><aside>no</aside><p>yes</p><form>no<input value=no></form><div class='ad banner'>no</div></article>", "yes"),
        ("<article><p>cut off</p><div class=", "cut off"),
        ("<article><p>short</p></article><div>" + P + "</div>", "short"),
        (f"<article>{P}<p class=ad>buy{P}{P}</article>", f"{T}\n{T}\n{T}"),
        (f"<article>{P}<p class='lead related'>marked as a style</p>{P}</article>", f"{T}\nmarked as a style\n{T}"),
        (f"<article>{P}<p class='notice'>no</p><ul class=share><li>no</ul>{P}</article>", f"{T}\n{T}"),
        (f"<div class='layout has-sidebar'><article>{P}</article><div class=sidebar>no</div></div>", T),
        (f"<div class='sidebar'><article>{P}</article></div>", T),
        (f"<div class='sidebar'><article>teaser</article></div><article>{P}</article>", T),
        (f"<form action=x><div id=main>{P}{P}<p>short</p></div><input name=q><label>no</label></form>", f"{T}\n{T}\nshort"),
        (f"<div>{P}{P}</div><form>{T}</form>", f"{T}\n{T}"),
        (f"<article><div class='article-header'><h1>Title</h1></div>{P}</article>", f"Title\n{T}"),
        (f"<article><header><h1>Title</h1></header>{P}<article class=comment>{P}</article><footer>no</footer></article>", f"Title\n{T}"),
        (f"<div class=page-header>{P}{P}{P}<ul><li><a href=a>one</a><li><a href=b>two</a></ul></div>", f"{T}\n{T}\n{T}"),
        (f"<div><div id=c>{P}<p>a <a href=x>whole paragraph of links</a></p><p><b>x</b></p><p>y</p><p>z</p><p>the last one is short</p></div><div>far off</div></div>", f"{T}\na whole paragraph of links\nx\ny\nz\nthe last one is short"),
        (f"<body>{P}<p>flat</p><table><tr><td class=ad>no<td>cell<tr><td>cell</table></body>", f"{T}\nflat\ncell\ncell"),
        ("<article><p>one <span class=ad>buy <b>now</b></span>two<p>three <button>no</button></article>", "one two\nthree"),
        ("<article><p>one <span class=ad>buy<p>two</article>", "one\ntwo"),
        (f"<article>{P}<ul><li class=ad>no<li>yes</ul><dl><dt class=promo>no<dd>yes</dl></article>", f"{T}\nyes\nyes"),
    ],
)
def test_pages(page, text):
    assert html_text.main_text(page) == text


def test_long_page():
    page = "<article>" + P * 20_000 + "</article>"
    assert html_text.main_text(page) == "\n".join([T] * 20_000)


def test_odd_cases(spark):
    rows = [(1, None, None), (None, "u", "<article><p>x</p></article>"), (None, "u", "<article><p>x</p></article>"), (2**53 + 1, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'own' AS text", "'own' AS n_chars")
    got = sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [("1", None, "", 0), ("9007199254740993", "v", "", 0), ("None", "u", "x", 1), ("None", "u", "x", 1)]
    assert html_text.extract(pages.limit(0)).collect() == []


def by_definition(page):
    """The fixture's pages read by another parser: blocks of the article, nothing but text."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.blocks = False, [""]

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in ("p", "h1", "article"):
                self.blocks.append("")
            if tag == "br":
                self.blocks[-1] += " "

        def handle_endtag(self, tag):
            self.inside &= tag != "article"
            if tag in ("p", "h1", "article"):
                self.blocks.append("")

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    reader = Reader()
    reader.feed(page)
    reader.close()
    return "\n".join(t for b in reader.blocks if (t := " ".join(b.split())))


def unmarked(page):
    """The page without any element or name that says what is what."""
    page = re.sub(r"<(/?)(?:article|nav|footer|header|aside|main)\b[^>]*>", r"<\1div>", page)
    return re.sub(r" class=\"[^\"]*\"", "", page)


def test_fixture_by_another_parser(spark):
    for r in table(spark, "pages").collect():
        assert html_text.main_text(r.html) == by_definition(r.html)


def test_windows_alone(spark):
    lines = Counter()
    for r in table(spark, "pages").collect():
        want, got = Counter(by_definition(r.html).split("\n")), Counter(html_text.main_text(unmarked(r.html)).split("\n"))
        for name, c in (("want", want), ("got", got), ("both", want & got)):
            lines[name] += sum(len(k) * n for k, n in c.items())
    assert lines["both"] >= 0.98 * lines["want"]
    assert lines["both"] >= 0.97 * lines["got"]


def test_query(spark):
    got = html_text.op9_html_text(spark, "/root/testdata/sf0.001").collect()
    html = {r.page_id: r.html for r in table(spark, "pages").collect()}
    assert {r.page_id for r in got} == set(html)
    for r in got:
        assert r.text == html_text.main_text(html[r.page_id])
        assert r.n_chars == len(r.text)
        assert not any(x != x.strip() or not x for x in r.text.split("\n") if r.text)
    assert sum(r.n_chars > 0 for r in got) >= 0.9 * len(got)
