import time

from helpers import plain

from millrace.llm.html_text import extract, main_texts, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<div id="cookie-notice">We use cookies.</div><header><a href="/">Home</a></header><nav><ul><li>Menu</ul></nav>
<div class="wrap post-12"><article><header><h1>The &amp; title</h1></header><script>var t = "</p>";</script>
<p>First <b>bold</b>&nbsp;text,
   on two lines<br>and a third.<p>Second, unclosed <i>paragraph
<div class="ad">Buy!</div><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>
<form>Name <input></form><aside>Aside</aside><blockquote>quoted 1 < 2</blockquote><!-- <p>gone</p> -->
<section id="comments"><p>Reader says</p></section></article></div>
<div class="sidebar"><p>Side text</p></div><footer>&copy; Foot</footer></body></html>"""
TEXT = ["The & title", "First bold text, on two lines and a third.", "Second, unclosed paragraph", "one", "two", "a", "b",
        "quoted 1 < 2"]


def test_article_of_a_page():
    assert extract(PAGE, []) == "\n\n".join(TEXT)
    assert extract(PAGE, ["html>body.has-sidebar>div.post-#.wrap>article"]) == "\n\n".join(TEXT)


def test_parts_of_class_names_do_not_remove_text():
    kept = ('<article><div class="article-header"><h1>Title</h1></div><section class="related-work"><p>Others did so.</p></section>'
            '<p class="sharing-economy">Cars.</p><p class="share-price noticeable">Up.</p><div class="header2"><h1>Late</h1></div>')  # fmt: skip
    gone = "".join(
        f'<div class="x {c}"><p>gone</p></div>'
        for c in ("ad", "comment-list", "site_header", "related-posts", "ad-42", "Share-Buttons", "sidebar-left-2", "nav")
    )
    text = ["Title", "Others did so.", "Cars.", "Up.", "Late"]
    assert extract(f"<body>{gone}{kept}{gone}</article>{gone}</body>", []) == "\n\n".join(text)


def test_broken_and_empty_pages():
    assert extract("", []) == extract("<html></html>", []) == extract("<script>x", []) == ""
    assert extract("just text &eacute; &am", []) == "just text é &am"
    assert extract("<p>a</p><p>b <a href='x>y'>c</a>", ["no>such"]) == "a\n\nb c"
    assert extract("<article><p>cut off <b>here</article", []) == "cut off here"
    assert extract("<p>quote \" <i class='x>open</p>", []) != ""
    assert extract("<body>" + "<div>" * 5000 + "deep" + "</div>" * 5000, []) == "deep"


def test_time_is_linear_in_the_page():
    took = []
    for n in (2000, 8000):
        page = "<article>" + '<p class="a b">some text &amp; more <a href="x">link</a>' * n + '"<' * n
        began = time.process_time()
        parse(page)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_hosts_agree_on_a_path(spark):
    good = '<body><div class="top-{0}"><p>{1}</p></div><div class="body-{0}"><p>{2}</p></div></body>'
    rows = [(i, f"https://u@Shop.example:80/p/{i}", good.format(i, "short", f"the long article text number {i}")) for i in range(12)]
    # this page alone would choose its teaser
    rows.append((50, "http://shop.example/x", good.format(50, "a teaser that is longer than what this page has to say", "brief")))
    rows += [(60, "http://other.example/", good.format(1, "a teaser that is longer than what this page has to say", "brief")),
             (61, None, "<p>no host</p>"), (62, "http://shop.example/y", None), (62, "http://shop.example/y", None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, n_chars string, host string")
    out = main_texts(df)
    got = [(i, t) for i, t in plain(out.select("page_id", "text"))]
    assert (50, "brief") in got and (3, "the long article text number 3") in got
    assert (60, "a teaser that is longer than what this page has to say") in got
    assert (61, "no host") in got and got.count((62, "")) == 2
    assert all(n == len(t) for t, n in plain(out.select("text", "n_chars")))
    assert out.columns == ["page_id", "url", "html", "host", "text", "n_chars"]
    assert main_texts(df.limit(0)).count() == 0


def test_article_in_unequal_sibling_sections(spark):
    long, short = "a long part of the article " * 10, "a brief end"
    split = f'<body><div class="page"><section class="a"><p>{long}</p></section><section class="b"><p>{short}</p></section></div></body>'
    whole = f"{long.strip()}\n\n{short}"
    assert extract(split, []) == extract(split, ["no>such"]) == whole
    same = f'<body><div class="part"><p>{long}</p></div><div class="part"><p>{short}</p></div></body>'
    assert extract(same, ["body>div.part"]) == whole
    middle = "the rest of the article, not as long " * 4
    deep = f'<body><div class="x"><div class="l"><div><p>{long}</p></div></div><div class="r"><div><p>{middle}</p></div></div></div></body>'
    rows = [(i, f"http://{h}.example/{i}", page) for h, page in (("a", split), ("b", deep)) for i in range(3)]
    out = main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {(u[7], t) for u, t in plain(out.select("url", "text"))}
    assert got == {("a", whole), ("b", f"{long.strip()}\n\n{middle.strip()}")}
