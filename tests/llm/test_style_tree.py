import random

import pytest
from pyspark.sql import functions as F

from llm_fixtures import clashing
from veriframe.llm import style_tree


def text_of(markup, removed=frozenset()):
    return style_tree.Page(markup, style_tree.numbering(), removed).text()


@pytest.mark.parametrize("markup, want", [
    ("", ""),
    ("<p>a  b\n\tc</p>", "a b c"),
    ("plain &amp; text &lt;p&gt; &eacute; &#233; &#xe9; &am &amp", "plain & text <p> é é é &am &"),
    ("<html><head><title>no</title><style>p{}</style></head><body><nav>no</nav><article><h1>Head</h1><p>One<p>Two <b>bold</b>er<br>line</article><footer>no</footer>", "Head\nOne\nTwo bolder line"),
    ("<article><p><b>Open<br><p>Next</p></article><div class=ad>no</div>", "Open\nNext"),
    ("<p>Text that is longer</p><div class=ad>no</div>", "Text that is longer"),
    ("<div class='site-menu'>no</div><div>yes, and more</div><div id=cookie-notice>no</div><div hidden>no</div><div style='display: none'>no</div>", "yes, and more"),
    ("<article>a<script>if (1 < 2) document.write('</p>')</script>b<!-- <p>no</p> -->c</article>", "abc"),
    ("<article>a<script>never closed <p>no", "a"),
    ("<p>a<!-- never closed <p>no", "a"),
    ("<p>a</p><p>b</p><p cla", "a\nb"),
    ("<p>a < b and 1<2</p>", "a < b and 1<2"),
    ('<p title="a > b">x</p>', "x"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<article><p>x</p><section class=comments><p>reader</p></section><form>f</form><aside>s</aside></article>", "x"),
    ("<main><header><h1>H</h1></header><p>x</p></main><header>no</header>", "H\nx"),
    ("<article>one</article><div>between</div><article>two</article>", "one\ntwo"),
    ("<p>a</p></div></article><p>b</p>", "a\nb"),
    ('<main class="content has-sidebar"><p>Hello world</p></main>', "Hello world"),
    ('<div class="page-with-sidebar"><article><p>Text</p></article></div><div class="sidebar">no</div>', "Text"),
    ('<article><div class="article-header"><h1>Headline</h1></div><p class="social-history">History</p><div class=header><h2>Second</h2></div></article>', "Headline\nHistory\nSecond"),
    ('<div class="sidebar left"><main><p>a</p><div class=ads>no</div></main></div>', "a"),
    ('<div class=menu><p>' + "the whole page under a wrong name " * 9 + "</p></div><p>rest</p>", ("the whole page under a wrong name " * 9).strip() + "\nrest"),
    ("<div class='post'><p>text of the post, which is long enough</p><ul class='share links'><li>no</li></ul></div>", "text of the post, which is long enough"),
    ("<div class=post>short</div><section id=comments>" + "a long thread of readers " * 9 + "</section>", "short"),
    ("<article><div class=menu>all of the article</div></article><p>x</p>", "all of the article"),
    ("<div hidden><article>no</article></div><p>yes</p>", "yes"),
    ("<!DOCTYPE html><?php no ?><p>a</p></ x><p>b", "a\nb"),
])
def test_markup(markup, want):
    assert text_of(markup) == want


def site(spark, n=40):
    rng = random.Random(1)
    word = lambda: rng.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta"])
    rows = []
    for i in range(n):
        body = "".join(f"<p>{word()} {word()} {word()} {i}</p>" for _ in range(rng.randrange(1, 5)))
        rows.append((i, f"http://a.org/{i}", f"<body><div class=top><p>The same words</p><p>on every page</p></div><div class=main2>{body}</div><div class=end>also {'this' if i else 'that'}</div></body>"))
    rows += [(100 + i, "http://small.org/x", "<body><div class=top>The same words</div><p>x</p></body>") for i in range(3)]
    rows += [(200, None, None), (201, "", ""), (None, "http://a.org/1", rows[1][2]), (1, *rows[1][1:]), (202, "http://b.org", "<p>" + "long text " * 60_000), (203, "http://b.org", "<div>" * 3000 + "deep")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_site_branches_that_repeat_are_removed(spark):
    pages = clashing(site(spark))
    got = style_tree.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert len(rows) == pages.count() and all(r.n_chars == len(r.text) for r in rows)
    own = [r for r in rows if r.page_id is not None and r.page_id < 40]
    assert all("same words" not in r.text and "every page" not in r.text and "also" not in r.text and r.text for r in own)
    by_id = {r.page_id: r.text for r in rows}
    assert by_id[100] == "The same words\nx"  # too few pages to tell
    assert by_id[200] == by_id[201] == "" and by_id[203] == "deep" and len(by_id[202]) == 60_000 * 10 - 1
    assert style_tree.extract(pages.where("false")).collect() == []


def test_copies_of_a_page_keep_their_text(spark):
    page = lambda body: f"<body><div class=top>The same words</div><div class=post>{body}</div></body>"
    rows = [(i, f"http://copies.org/{i}", page("<p>The one article</p>")) for i in range(50)]
    rows += [(1000 + i, f"http://mixed.org/{i}", page("<p>A copied article</p>")) for i in range(970)]
    rows += [(2000 + i, f"http://mixed.org/o{i}", page(f"<p>Article {i} of its own</p>")) for i in range(30)]
    rows += [(3000 + i, f"http://path.org/{i}", "<body><div class=post-123><p>Copied under its own class</p></div></body>") for i in range(25)]
    rows += [(4000 + i, f"http://path.org/o{i}", page(f"<p>Other {i}</p>")) for i in range(30)]
    rows += [(5000 + i, f"http://bare.org/{i}", page(f"<p>Other {i}</p>")) for i in range(30)] + [(5100, "http://bare.org/x", "<body><div class=top>The same words</div></body>")]
    got = {r.page_id: r.text for r in style_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("The one article" in got[i] for i in range(50))
    assert all(got[1000 + i] == "A copied article" for i in range(970)) and all(got[2000 + i] == f"Article {i} of its own" for i in range(30))
    assert all(got[3000 + i] == "Copied under its own class" for i in range(25)) and all(got[4000 + i] == f"Other {i}" for i in range(30))
    assert got[5000] == "Other 0" and got[5100] == "The same words"


def test_importance_is_normalised_entropy(spark):
    nodes = spark.createDataFrame([("h", 1, 0, 5, c) for c in (1, 1, 2, 3)] + [("h", 2, 1, 5, 5)] * 4 + [("g", 1, 0, 5, 5)], "host string, node long, above long, shape long, content long")
    got = {(r.host, r.node): (r.pages, round(r.importance, 6)) for r in style_tree.importance(nodes).collect()}
    assert got == {("h", 1): (4, 0.75), ("h", 2): (4, 0.0), ("g", 1): (1, 1.0)}
    low = style_tree.low_branches(nodes, least_pages=2, low=0.1).collect()
    assert [(r.host, r.nodes) for r in low] == [("h", [2])]


def test_hot_host_counts_every_page(spark):
    pages = site(spark).where(F.col("url").startswith("http://a.org/")).withColumn("host", F.lit("a.org"))
    top = style_tree.importance(style_tree.style_nodes(pages)).agg(F.max("pages")).first()[0]
    assert top == pages.count()


def test_tree_sees_declared_and_unnamed_menus(spark):
    rows = [(i, f"http://s.org/{i}", f"<body><nav><ul><li>Home</li><li>About</li></ul></nav><div class=c7><ul><li>Home</li><li>Contact</li></ul></div><div class=x><p>Story {i} of its own</p></div></body>")
            for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract(pages).collect()}
    assert got == {i: f"Story {i} of its own" for i in range(40)}
    hosted = pages.withColumn("host", F.lit("s.org"))
    number = style_tree.numbering()
    body = number(0, "body", "")
    assert set(style_tree.low_branches(style_tree.style_nodes(hosted)).first().nodes) == {number(body, "nav", ""), number(body, "div", "c7")}
