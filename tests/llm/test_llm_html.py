"""Main text: wrappers whose names or tags only look like page furniture."""

import pytest

from matchgrain.llm.html_text import Page, main_text

BODY = "<p>The ferry crossed the strait at dawn, and the pilot told us of the old lighthouse.</p><p>By noon the harbour was full, so we walked up to the fort above the town.</p>"
WANT = "The ferry crossed the strait at dawn, and the pilot told us of the old lighthouse.\nBy noon the harbour was full, so we walked up to the fort above the town."


@pytest.mark.parametrize(
    "start,end",
    [
        ('<div class="layout has-sidebar"><article>', "</article></div>"), ('<div class="site no-sidebar"><article>', "</article></div>"), ('<div class="post comments-open">', "</div>"),
        ('<div id="content-widget"><div>', "</div></div>"), ('<div title="the hidden valley"><article>', "</article></div>"), ("<form action=x><div>", "</div></form>"),
        ('<div class="sidebar"><main>', "</main></div>"), ('<div class="widget"><div>', "</div></div>"), ('<div class="comments"><div>', "</div></div>"), ('<div class="has-header">', "</div>"),
        ('<div class="header"><main>', "</main></div>"), ("<input type=hidden><div>", "</div>"), ("<main><div class='text-share-guide'>", "</div></main>"), ("<div class='reply-story'>", "</div>"), ("<form><main>", "</main></form>"),
        ("<div class='login-history'><article>", "</article></div>"), ("<div id=search-for-gold>", "</div>"),
    ],
)
def test_wrappers_do_not_take_the_text_with_them(start, end):
    assert Page(f'<html><body><nav><a href="/">Home</a></nav>{start}{BODY}{end}<footer>Imprint</footer></body></html>').text([]) == WANT


@pytest.mark.parametrize("out", ['div class="ad"', 'div class="cookie-banner"', 'div id="site-footer"', 'div class="widget-area"', 'ul class="comment-list"', "aside", "div hidden", 'div hidden="until-found"', "form", 'div class="ad-slot-3"', 'div class="related-posts"', 'div class="sidebar-left"'])
def test_furniture_still_goes(out):
    page = f"<html><body><div class=content>{BODY}<{out}><p>Buy now, or leave a note.</p></{out.split()[0]}></div></body></html>"
    assert Page(page).text([]) == WANT


def test_whole_table(spark):
    page = f'<html><body><div class="layout has-sidebar"><article>{BODY}</article></div></body></html>'
    got = main_text(spark.createDataFrame([(1, "http://a.b/1", page), (2, "http://a.b/2", None)], "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.text) for r in got} == {(1, WANT), (2, "")}


@pytest.mark.parametrize(
    "html,want",
    [
        ("", ""), ("   \n ", ""), ("no markup at all", "no markup at all"), ("<p>never closed <b>bold", "never closed bold"), ("<p>a &amp; b &#233; &nbsp;c</p>", "a & b é c"), ("<div><p>one\n  two</p><p>three</p>", "one two\nthree"),
        ("<script>var x = '<p>no</p>';</script><p>yes</p>", "yes"), ("<p>ends<br>here</p><!-- <p>no</p> -->", "ends here"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<style>p{}</style>", ""), ("<p" + " x" * 50 + ">ok</p>", "ok"), ("<p>" + "long " * 20000 + "</p>", ("long " * 20000).strip()),
    ],
)
def test_odd_pages(html, want):
    assert Page(html).text([]) == want


def test_hosts_agree_on_a_path(spark):
    """One page of a host whose own best container is another one is read by the host's path; rows of null hosts stay apart."""
    usual = '<html><body><div class="box-12"><p>Short, dated note.</p></div><div class="story-{0}">' + BODY + "</div></body></html>"
    odd = '<html><body><div class="box-7">' + BODY * 3 + '</div><div class="story-9"><p>A short story, but the one that counts.</p></div></body></html>'
    rows = [(i, f"https://news.example/{i}", usual.format(i)) for i in range(8)] + [(8, "https://news.example/8", odd), (9, None, odd), (10, "https://news.example/10", None), (10, "https://news.example/10", None)]
    frame = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, host string, paths string")
    got = main_text(frame).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == WANT for i in range(8)) and text[8] == "A short story, but the one that counts." and text[9] == "\n".join([WANT] * 3) and text[10] == ""
    assert main_text(frame.limit(0)).count() == 0


@pytest.mark.parametrize(
    "body,want",
    [
        ("<article><h1>T</h1><div class=lead><p>L1</p></div><div class=rest><p>R1</p><p>R2</p><p>R3</p></div></article>", "T\nL1\nR1\nR2\nR3"),
        ("<article><h1>T</h1><div class=lead>L1</div><div class=rest>R1 R2 R3</div></article>", "T\nL1\nR1 R2 R3"),
        ("<main><div class=intro><p>The way in.</p></div><div class=chapter>" + BODY + "</div><div class=outro><p>The way out.</p></div></main>", "The way in.\n" + WANT + "\nThe way out."),
        ("<main><header><h1>T</h1></header><div class=content>" + BODY + "</div></main>", "T\n" + WANT),
        ("<article><header><h1>T</h1><p>A lead.</p><p class=byline>By A. N. Other</p><div class=tools>Print this</div></header>" + BODY + "</article>", "T\nA lead.\n" + WANT),
        ("<div class=story><div class=chapter-1>" + BODY + "</div><div class=chapter-2>" + BODY + "</div></div>", WANT + "\n" + WANT),
        ("<div class=wrap><div class=first>" + BODY + "</div><div class=second>" + BODY + "</div></div>", WANT + "\n" + WANT),
        ("<main><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><div>" + BODY + "</div></main>", WANT),
        ("<article>" + BODY + "<div><article><p>A reader writes of the ferry.</p></article></div></article>", None),
        ("<header><p>Site line</p></header><div>" + BODY + "</div>", WANT),
    ],
)
def test_articles_of_several_containers(spark, body, want):
    page = f"<html><body><nav><a href=/>Home</a></nav>{body}<footer>Imprint</footer></body></html>"
    want = want or Page(page).text([])
    assert Page(page).text([]) == want and want.startswith(WANT) == body.startswith(("<div", "<main><ul", "<article><p", "<header"))


def test_all_containers_win_on_their_host(spark):
    """Twenty pages of a host whose articles have three containers of different lengths, one of them very long."""
    page = "<html><body><main><div class='intro-{0}'><p>The way in, number {0}.</p></div><div class='chapter-{0}'>{1}</div><div class='outro'><p>The way out, number {0}.</p></div></main></body></html>"
    rows = [(i, "http://a.b/x", page.format(i, BODY * (30_000 if i == 7 else 1))) for i in range(20)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join([f"The way in, number {i}.", *[WANT] * (30_000 if i == 7 else 1), f"The way out, number {i}."]) for i in range(20)}
