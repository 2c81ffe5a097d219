import html as H
import re
import time

from sightline.llm import html_text as X

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav><!-- ad --><div class="cookie-notice">We use cookies</div>
<div class="wrap"><div class="post-12 content"><h1>Head &amp; line</h1><p><b>First<br>line<br><p>Second &lt;p&gt; &eacute; a &lt b<ul><li>one<li>two</ul>
<div class="ad-slot">Buy</div><form><label>Mail</label><input name=x></form><table><tr><td>c1<td>c2</table><p>Third paragraph of some length, to score well.
<div id="comments"><p>A very long reader comment that should never be part of the text at all, whatever its length.</p></div></div>
<aside><p>Side</p></aside></div><footer>&copy; F</footer></body></html>"""


def test_blocks():
    assert X.extract(PAGE, None) == "Head & line\n\nFirst line\n\nSecond <p> é a < b\n\none\n\ntwo\n\nc1 c2\n\nThird paragraph of some length, to score well."
    assert X.Page(PAGE).best()[0] == "body.with-sidebar>div.wrap>div.content.post-#"


def test_broken_markup():
    for h in [None, "", "<", "<p", "a < b", "<!-- x", "<script>x", "</p></div>", "<p>a</b></i><div>b", "<a <b>", "&amp", '<p title="a>b">x</p>', "<P>x<P>y" * 50]:
        X.extract(h, ["body"])
    assert X.extract("a < b <p>c", None) == "a < b\n\nc"
    assert X.extract('<body><p title="a>b">x</p><!-- <p>no</p>', None) == "x"
    assert X.extract("<div>" * 3000 + "deep", None) == "deep"


def test_an_article_that_is_named_a_comment():
    said = "A paragraph of the opinion piece, which goes on for quite a while. " * 8
    page = "<body><h1>Title</h1><div class='%s'><p>%s</p><p>%s</p><div class='comments'><p>Reader: I disagree.</p></div></div><footer>Copyright x</footer></body>"
    for name in ("comment", "opinion comment", "op-comment", "blog-comment"):
        assert X.extract(page % (name, said, said), None).split("\n\n")[-2:] == [said.strip()] * 2
        assert "Copyright" not in X.extract(page % (name, said, said), None) and "Reader" not in X.extract(page % (name, said, said), None)
    # beside an article, however short, and in a list of many, comments are comments
    beside = "<body><div class='post'><p>A short article of one sentence only.</p></div><div class='comments'><p>%s</p></div></body>"
    assert X.extract(beside % (said[:500]), None) == "A short article of one sentence only."
    many = "<body><article><p>Article text that is an article.</p></article>" + "<div class='comment'><p>%s</p></div>" % said * 3 + "</body>"
    assert X.extract(many, None) == "Article text that is an article."
    assert X.extract("<body>" + "<div class='comment'><p>%s</p></div>" % said * 3 + "</body>", None) == ""


def test_consensus(spark, monkeypatch):
    good = '<body><div class="story"><p>%s</p></div><div class="more"><p>%s</p></div></body>'
    rows = [(i, f"http://H.example/{i}", good % ("long text, " * 30, "short")) for i in range(6)]
    rows += [(7, "http://h.example:80/x", good % ("short article", "a teaser, " * 60)), (8, None, None), (9, "odd", "<p>alone"), (9, "odd", "<p>alone")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    for limit in (1 << 20, 0):
        monkeypatch.setattr(X, "BROADCAST_BYTES", limit)
        got = X.main_text(df).collect()
        by = {r["page_id"]: r["text"] for r in got}
        assert len(got) == len(rows) and by[7] == "short article" and by[8] == "" and by[9] == "alone" and by[0] == ("long text, " * 30).strip()
    assert X.main_text(df.where("false")).collect() == []


def test_query_over_table(spark, sf_dir):
    """The pages' own template: what stands in <article>, block by block."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = X.op4_html_extraction(spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


STORY = "word " * 60


def test_names_that_only_hold_a_word_of_furniture():
    for c in ("post category-social", "entry comments-open", "content search-result-detail", "story related-topic-economy", "article-body ad-free", "no-sidebar", "share"):
        assert X.extract(f'<body><nav><a href="/">Home</a></nav><div class="{c}"><p>{STORY}</p></div></body>', None) == STORY.strip(), c
    inside = f'<article><p>{STORY}</p><p class="notice-period">three months</p><section class="skip-level"><p>second level</p></section><p>a <span class="alert">red</span> word</p></article>'
    assert X.extract(inside, None) == f"{STORY.strip()}\n\nthree months\n\nsecond level\n\na red word"


def test_furniture_goes():
    goes = ["cookie-notice", "main-nav", "ad-slot", "socialShare", "related-posts", "comments", "comment-list", "sidebar-left", "newsletter-box", "breadcrumbs", "popup"]
    page = "".join(f'<div class="{c}"><p>gone {c}</p></div>' for c in goes)
    for article in (f"<article><h1>T</h1><p>{STORY}</p>{page}</article>{page}", f"{page}<div class=text><h1>T</h1><p>{STORY}</p>{page}</div>"):
        assert X.extract(f"<body><div class=site-header>gone</div>{page}{article}<footer>gone</footer></body>", None) == f"T\n\n{STORY.strip()}"
    remarks = "".join(f"<li class=comment><article class=comment-body><p>{STORY * 5}</p></article></li>" for _ in range(9))
    assert X.extract(f"<main><p>short</p><ol class=comment-list>{remarks}</ol></main>", None) == "short"


def test_wrappers_lose_nothing():
    for wrap in ('<form id="aspnetForm">%s</form>', '<div style="display:none">%s</div>', "<nav><ul><li>x</ul>%s", '<div class="modal">%s</div>', "<header>%s</header>"):
        assert STORY.strip() in X.extract(f"<body>{wrap % f'<div><p>{STORY}</p></div>'}</body>", None)


def test_sections_of_uneven_length():
    sections = "".join(f"<section><p>{'w ' * n}</p></section>" for n in (300, 60, 40))
    for t in ("article", "div"):
        assert X.extract(f"<body><div><{t}>{sections}</{t}></div></body>", None).count("\n\n") == 2


def test_long_and_deep_pages_take_time_in_proportion():
    pages = ["<a " * 350_000, "<div class=a>" * 100_000 + "x", '<a ">" ' * 100_000, "<b><li>" * 50_000, "<b>" * 20_000 + "<li>" * 20_000 + "</b>" * 20_000, "&#" + "9" * 100_000, "<!--" * 250_000, "<" * 500_000]
    start = time.perf_counter()
    for h in pages:
        X.extract(h, ["body>div.a"])
    assert time.perf_counter() - start < 60
