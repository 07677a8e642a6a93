"""Article texts: the generated pages against their own article element, and made-up pages of other shapes."""

import html as entities
import re

from pyspark.sql import functions as F

from stringloom.llm import html

SHOP = """<html><body class="page"><header class="site-header"><h1>Site</h1></header><div id="cookie-notice">We use cookies, lots of them</div>
<div class="wrap"><div class="sidebar"><ul><li><a href=x>one</a><li><a href=y>two</a></ul></div>
<div class="content post-{n}"><h2>Title &amp; more</h2><p>First para <a href="/x">link</a> text, number {n} long enough.<p>Second<br>line &lt;b&gt; <i>it</i>al
<ul><li>item 1<li>item 2</ul><form><label>Name</label><input value=1>Send</form><div class="ad-slot">Buy</div><blockquote>Quote</blockquote></div>
<div class="comments"><p>Nice article! I read it all and this is a very long comment text, longer than the article itself is, by far and away.</p></div>
</div><footer>foot</footer><script>if (a<b) document.write("<p>x</p>")</script></body></html>"""
WANT = "Title & more\nFirst para link text, number {n} long enough.\nSecond line <b> ital\nitem 1\nitem 2\nQuote"


def test_generated_pages_give_their_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in html.article_texts(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for row in rows:
        inner = re.search(r"<article>(.*?)</article>", row["html"], re.S)[1]
        blocks = re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1)>", "\x01", inner).replace("<br>", " ")).split("\x01")
        want = "\n".join(x for x in (" ".join(entities.unescape(b).split()) for b in blocks) if x)
        assert got[row["page_id"]]["text"] == want and got[row["page_id"]]["n_chars"] == len(want) and got[row["page_id"]]["url"] == row["url"]


def test_other_shapes_and_odd_rows(spark):
    rows = [(n, f"https://Shop.example.com/{n}", SHOP.format(n=n)) for n in range(6)]
    # too short to win by itself: the host's path still finds it
    rows.append((6, "http://shop.example.com:80/x", '<body class="page"><div class="wrap"><div class="content post-9">Short.</div></div><div class="box">' + "Much longer other words. " * 30))
    rows += [(7, None, None), (8, "u", ""), (9, "u", "no markup & all <b>text</b>"), (None, "u", "<p>one<p>two"), (9, "u", "no markup & all <b>text</b>"),
             (10, "u", "<div>" * 3000 + "deep" + "</div>" * 3000), (11, "u", "<p>" + "long words " * 50_000), (12, "u", "<nav>only a menu</nav>"), (13, "u", "<a 'x><<<")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("host", F.lit(1))
    got = html.article_texts(pages).collect()
    assert len(got) == len(rows)
    texts = {r["page_id"]: r["text"] for r in got}
    assert [texts[n] for n in range(6)] == [WANT.format(n=n) for n in range(6)]
    assert texts[6] == "Short." and texts[7] == texts[8] == texts[12] == "" and texts[9] == "no markup & all text"
    assert texts[None] == "one\ntwo" and texts[10] == "deep" and texts[11] == ("long words " * 50_000).strip()


def test_empty_table(spark):
    assert html.article_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


SLUGS = """<html><body><nav>menu</nav><div class="ad">Buy</div><article><h1 id="skip-lists">Skip lists</h1><h2 id="why-you-should-share">Why you should share</h2>
<section id="side-effects"><h3>Side effects</h3><p>Few are known.</p></section><div id="related-work"><p>Others did <a href=x>this</a> long ago and it is well known.</p></div>
<section class="legal-history"><p id="legal">It began in 1900.</p></section><section id="comments"><h2>Comments</h2><p>On the text of the law.</p></section>
<div id="hidden-markov-models"><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x = 1</annotation></math> hold.</p></div>
<div class="ad-slot">Buy</div><div class="related-posts"><a href=1>More</a> <a href=2>and more</a></div><div id="share"><a href=1>Post it</a></div>
<div class="subscribe-now">Mail <input name=mail></div></article><footer>foot</footer></body></html>"""


def test_ids_of_headings_and_formulas_stay_and_marked_link_lists_go():
    want = ["Skip lists", "Why you should share", "Side effects", "Few are known.", "Others did this long ago and it is well known.", "It began in 1900.", "Comments",
            "On the text of the law.", "Let x=1 hold."]
    assert html.main_text(SLUGS, None).split("\n") == want
    assert html.main_text(SLUGS.replace("article>", "div>"), None).split("\n") == want


READERS = """<p>Reader remark one.</p><p>Reader remark two.</p>"""
BLOG = """<html><body><main><article><h1>Title</h1><p>The first paragraph of the article, long enough to win.</p><p>And the second one, which says more about it.</p>%s</article>%s</main></body></html>"""
KEPT = ["Title", "The first paragraph of the article, long enough to win.", "And the second one, which says more about it."]
UNIT = """<li class="comment"><article class="comment-body"><b class="fn">Ann</b><p>Well said, I would add that this and that is so.</p></article></li>"""


def test_readers_comments_go_inside_and_outside_of_the_article():
    marked = [f'<section class="comments">{READERS}</section>', f'<div id="comments" class="comments-area"><h2>Remarks</h2><ol class="comment-list">{UNIT * 8}</ol></div>',
              f'<div id="comments"><h2>2 remarks</h2><div class="c"><b>Ann</b><p>So it is.</p></div><div class="c"><b>Bob</b><p>I think not.</p></div></div>',
              f'<ul class="replies"><li>Yes.</li></ul>', f'<div class="comment-thread">{READERS}</div>']
    for section in marked:
        for page in (BLOG % (section, ""), BLOG % ("", section)):
            for source in (page, page.replace("main>", "div>")):
                assert html.main_text(source, None).split("\n") == KEPT, source
                votes = html.votes_of(source)
                assert html.main_text(source, max(votes, key=lambda v: v[1])[0]).split("\n") == KEPT


def test_an_id_alone_does_not_drop_a_section_of_the_article():
    page = BLOG % ('<section id="comments"><h2>Comments</h2><p>In code they begin with a hash.</p></section><div id="code-comments"><p>More on them.</p></div>', "")
    assert html.main_text(page, None).split("\n") == [*KEPT, "Comments", "In code they begin with a hash.", "More on them."]


def test_stray_quotes_and_empty_comments_lose_no_text():
    page = "<html><body><article><p title=5\">First text \"big\" and more.</p><!--><p>Second 'text'.</p><!---><p class='a>b' title=\"x>y\">Third.</p><p a\"b>Fourth \" one.</p><!-- gone --!><p>Fifth.</p></article></body></html>"
    assert html.main_text(page, None).split("\n") == ['First text "big" and more.', "Second 'text'.", "Third.", 'Fourth " one.', "Fifth."]
    assert html._ATTRIBUTE.findall(" title=5\" id='x'") == [("title", "", "", '5"'), ("id", "", "x", "")]
