import time

import pytest

from millrace.llm import pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="post">
<header>Top</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<article class="post"><h1>Title &amp; more</h1><p><b>One&nbsp;  two<br>three<p>Four &lt;tag&gt; &#233;</p><aside>Side</aside>
<div id="share-box">Share</div><form><p>Sign up</p></form><blockquote>Quote</blockquote><ul><li>x<li>y</ul>
<section class="comments"><article><p>Reader says</p></article></section><p style="display:none">hidden</p></article>
<div class="sidebar">Links</div><footer>&copy; foot</footer></body></html>"""
TEXT = "Title & more\nOne two three\nFour <tag> é\nQuote\nx\ny"


def test_article_of_a_page():
    assert pages.main_text(PAGE, frozenset()) == TEXT
    assert pages.main_text(PAGE.replace("</article>\n<div class", "<div class").replace("</body></html>", ""), frozenset()).startswith(TEXT)


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("", ""),
        ("plain text", "plain text"),
        ("<p>a<p>b</i></p>c", "a\nb\nc"),
        ("<div>a<span>b</span> c<div>d</div>e</div>", "ab c\nd\ne"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ('<a title="x > y">t</a> <b class=unquoted>u', "t u"),
        ("<p>1 < 2 & 3 &amp;lt; <", "1 < 2 & 3 &lt; <"),
        ("<script>a<b</script>z<style>", "z"),
        ("<main><p>in</p></main><p>out</p>", "in"),
        ('<div role="navigation">n</div><div aria-hidden="true">h</div><p>k</p>', "k"),
    ],
)
def test_markup(source, text):
    assert pages.main_text(source, frozenset()) == text


def test_deep_and_long_pages():
    assert pages.main_text("<div>" * 20_000 + "x" + "</div>" * 20_000, frozenset()) == "x"
    assert len(pages.main_text("<p>" + "word " * 200_000, frozenset())) == 999_999
    assert pages.main_text('<p a="' * 20_000, frozenset()) is not None


@pytest.mark.parametrize("piece", ['<a href="x', "<a", "<a'\"", "<!-", "</a ", "<a <"])
@pytest.mark.parametrize("head", ["", "<p>one</p>", "<p>1 > 2 "])
def test_broken_markup_takes_linear_time(head, piece):
    start = time.process_time()
    got = pages.main_text(head + piece * 32_000, frozenset())
    assert time.process_time() - start < 1.5
    assert got.split(" ")[0].split("<")[0].strip() == {"": "", "<p>one</p>": "one", "<p>1 > 2 ": "1"}[head]


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>a</p><!-- b > c", "a"),
        ("<p>a</p> b <!-- c", "a\nb"),
        ("<p>a</p> <!-- b --> c <d", "a\nc <d"),
        ("a<!-- b > c --> d", "a d"),
    ],
)
def test_what_follows_the_last_tag(source, text):
    assert pages.main_text(source, frozenset()) == text


def test_a_teaser_does_not_hide_the_text(spark):
    body = "<div>The long text of the page, which no tag marks.</div>"
    rows = [(1, "http://one.example/", f"<article class=card><p>Teaser</p></article>{body}", 1), (2, None, f"<nav>Menu</nav>{body}", 1)]
    rows.append((3, "http://one.example/", f"<article>{'<p>The article itself, which is long.</p>' * 3}</article><div>Beside it</div>", 1))
    df = spark.createDataFrame(rows, "page_id int, url string, html string, _noise int")
    text = {r["page_id"]: (r["text"], r["_noise"]) for r in pages.extract(df, ["page_id", "_noise"]).collect()}
    long = "The long text of the page, which no tag marks."
    assert text == {1: (f"Teaser\n{long}", 1), 2: (long, 1), 3: ("\n".join(["The article itself, which is long."] * 3), 1)}


def test_importance_outweighs_doubtful_labels(spark):
    rows = []
    for i in range(8):
        parts = f"<div class=related-work><p>Work {i}</p></div><div class=related><p>Link {i}</p></div><div class=user-comments><p>Reader {i}</p></div>"
        parts += "<div class=cookie-policy><p>We bake</p></div>"
        rows.append((i, "http://papers.example/", f"<article><p>Lead {i}</p>{parts}</article>"))
    rows.append((100, "http://few.example/", "<article><p>Lead</p><div class=related-work><p>Work</p></div></article>"))
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    text = {r["page_id"]: r["text"] for r in pages.extract(df, ["page_id"]).collect()}
    assert text == {100: "Lead", **{i: f"Lead {i}\nWork {i}" for i in range(8)}}


def test_threshold_is_kept(spark):
    """A text on two of four pages has an importance of a half: it goes only below that."""
    rows = [(i, "http://h.example/", f"<div><span>Own {i}</span></div><section>{'Half' if i < 2 else f'Other {i}'}</section>") for i in range(4)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    for threshold, kept in ((0.5, "Own 0\nHalf"), (0.51, "Own 0")):
        got = pages.extract(df, ["page_id"], threshold=threshold).where("page_id = 0").first()
        assert got["text"] == kept


def test_site_style_tree_finds_what_repeats(spark):
    rows = []
    for i in range(12):
        body = f"<div class=c{i}x><p>Story number {i}</p></div><div class=tail{i}>Read on, all of you</div><p>Passage</p>"
        rows.append((i, "https://Site.example:80/x", f"<div class=box>Best site ever</div><main>{body}</main>", "clash"))
        rows.append((100 + i, "http://u@bare.example/y", f"<div class=top>Welcome back</div><div class=mid>Words {i}</div>", "clash"))
    rows += [(200, None, None, "clash"), (201, "nonsense", "<p>ok</p>", "clash"), (202, "http://site.example/z", "<main><p>Passage</p></main>", "x")]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text string").repartition(4)
    got = pages.extract(df, ["page_id", "url"]).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    for i in range(12):
        assert text[i] == f"Story number {i}\nPassage"
        assert text[100 + i] == f"Words {i}"
    assert (text[200], text[201], text[202]) == ("", "ok", "Passage")


def test_only_the_tree_tells(spark):
    """Pages with an article, without labels or telling tags: importance decides in the article and outside."""
    rows = []
    for i in range(12):
        card = f"<article><p>Card {i}</p><div>Told on every page</div><div>Told only on page {i}</div></article>"
        body = f"<section><p>Body {i}</p><p>Second of {i}</p><p>Written under all</p></section>"
        rows.append((i, "http://card.example/", f"<div><div>Home and away</div></div>{card}{body}"))
        rows.append((100 + i, "http://bare.example/", f"<section><p>Text {i}</p><p>Written under all</p></section>"))
    rows.append((200, "http://few.example/", "<article><p>In</p></article><section><p>Out</p></section>"))
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(4)
    text = {r["page_id"]: r["text"] for r in pages.extract(df, ["page_id"]).collect()}
    for i in range(12):
        assert text[i] == f"Card {i}\nTold only on page {i}\nBody {i}\nSecond of {i}"
        assert text[100 + i] == f"Text {i}"
    assert text[200] == "In"


def test_copies_of_an_article_are_no_noise(spark):
    df = spark.createDataFrame([(i, "http://h/", "<div class=mid>The same story</div>") for i in range(20)], "page_id int, url string, html string")
    assert {r["text"] for r in pages.extract(df, ["page_id"]).collect()} == {"The same story"}


def test_importance(spark):
    tree = spark.createDataFrame(
        [("h", 1, 0, 0, 4), ("h", 1, 2, 7, 4), ("h", 2, 0, 0, 4), *(("h", 2, 2, i, 1) for i in range(4)), ("h", 3, 0, 0, 1), ("h", 3, 2, 1, 1)],
        "host string, path long, kind int, feature long, pages long",
    )
    assert {r["path"]: round(r["importance"], 6) for r in pages.importance(tree).collect()} == {1: 0.0, 2: 1.0, 3: 1.0}


def test_empty_table(spark):
    assert pages.extract(spark.createDataFrame([], "page_id int, url string, html string"), ["page_id"]).count() == 0
