import html
import random
import re
import time

from kegler.llm import queries
from kegler.llm.html_extract import extract_pages, main_text

PAGE = """<!DOCTYPE html><html><head><title>T, t</title><style>p{margin:0}</style><script>var t="</p>,,,,";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">One, two</a></li></ul></nav><div class="notice cookie-bar">We use cookies, really.</div>
%s
<div id="comments"><h2>Comments</h2><p>First, great, post, thanks, all.</p></div><aside class="side">Related, things, here.</aside><form><p>Name, mail</p></form><footer>&copy; us, 2020</footer></body></html>"""


def test_article_with_furniture():
    body = "<article><h1>Head &amp; line</h1><p><b>One,  two\n three<br>four<p>Five &lt;six&gt; &#233;&nbsp;x</p><div class='ad'>Buy, now</div><ul><li>a point</li><li>b <a href=x>link</a> text</li></ul><section class='reader-comments'><p>me, too</p></section></article>"
    assert main_text(PAGE % body) == "Head & line\nOne, two three four\nFive <six> é x\na point\nb link text"


def test_short_article_beats_long_furniture():
    assert main_text(PAGE % "<article><h1>T.</h1><p>Be.</p></article>") == "T.\nBe."


def test_without_article():
    long = "Some words, and more words, that go on for a while, as paragraphs do. " * 4
    body = f"<div id='wrap'><div class='menu'><a href=x>{long}</a></div><div class='content'><h1>Title</h1><p>{long}</p><p>{long}</p></div></div>"
    assert main_text(PAGE % body) == "\n".join(["Title", long.strip(), long.strip()])


def test_sections_of_one_article():
    body = "<article><h1>T</h1><section><p>one, two, three</p></section><section><p>four, five</p></section></article>"
    assert main_text(PAGE % body) == "T\none, two, three\nfour, five"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<script>x") == ""
    assert main_text("plain, text < 3 & more") == "plain, text < 3 & more"
    assert main_text("<p>open <b>bold") == "open bold"
    assert main_text("</div></p><p>x</p></article>") == "x"
    assert main_text("<article><p>a<!-- <p>no</p> --> b</p><!-- open <p>c") == "a b"


def test_time_in_proportion():
    for page in ("<div>" * 50_000 + "x", "<p>x, y" * 50_000, "<b>" * 100_000, "<" * 200_000, "<a href='" * 20_000, "</div>" * 50_000, "<ul><li>" * 20_000 + "x", "<!--" * 50_000):
        began = time.time()
        main_text(page)
        assert time.time() - began < 20, page[:12]


def expected(page):
    """The generated pages have one article of a heading and paragraphs."""
    blocks = re.split(r"</?(?:h1|p)[^>]*>", re.search(r"<article>(.*?)</article>", page, re.S)[1])
    texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_op2_on_table(spark, sf):
    rows = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op2_html_extraction(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["url"] == rows[r["page_id"]]["url"] and r["text"] == expected(rows[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"])


def test_null_repeated_and_empty(spark):
    rows = spark.createDataFrame([(1, None, None, "a"), (None, "u", "<p>x", "b"), (None, "u", "<p>x", "b")], "page_id long, url string, html string, text string")
    assert sorted(tuple(r) for r in extract_pages(rows).na.fill(-1).na.fill("-").collect()) == [(-1, "u", "x", 1), (-1, "u", "x", 1), (1, "-", "", 0)]
    assert extract_pages(rows.where("false")).count() == 0


def test_names_that_mislead():
    long = "Some words, and more words, that go on for a while, as paragraphs do. " * 3
    p, text = f"<p>{long}</p>", long.strip()
    article = f"<article><h1>T</h1>{p}</article>"
    for name in ("content has-sidebar", "no-sidebar", "layout-with-sidebar", "page with-menu", "layout-sidebar-right", "post comments-open", "widget"):
        assert main_text(PAGE % f"<div class='{name}'>{article}</div>") == f"T\n{text}", name
        assert main_text(PAGE % f"<div class='{name}'>{p}{p}</div>") == f"{text}\n{text}", name
        assert main_text(PAGE % f"<main><div id='{name.split()[-1]}'>{p}{p}</div></main>") == f"{text}\n{text}", name
    assert main_text(PAGE % f"<form id='aspnetForm'>{article}</form>") == f"T\n{text}"
    assert main_text(PAGE % f"<article class='post comments-open'><h1>T</h1>{p}</article>") == f"T\n{text}"
    for holder in ("<article>%s</article>", "<div>%s</div>", "<main>%s</main>"):
        assert main_text(PAGE % (holder % f"<div class='entry-header'><h1>T</h1></div>{p}{p}")) == f"T\n{text}\n{text}"


def test_named_sections_of_an_article():
    body = "<article><h1>T</h1><section id='results'><h2>Results</h2><p>One, two.</p></section><section id='discussion'><h2>Discussion</h2><p>Three, four.</p></section><section class='comments'><h2>Comments</h2><p>me, too</p></section></article>"
    assert main_text(PAGE % body) == "T\nResults\nOne, two.\nDiscussion\nThree, four."


def test_lists_of_links():
    links = "<ul><li><a href=x>Ref one</a></li><li><a href=y>Ref two</a></li></ul>"
    assert main_text(PAGE % f"<ul><li><a href=x>Home</a><li><a href=y>News</a></ul><article><h1>T</h1><p>Be.</p>{links}</article>{links}") == "T\nBe.\nRef one\nRef two"


def test_siblings_of_article():
    long = "Some words, and more words, that go on for a while, as paragraphs do. " * 3
    one, text = f"<p>{long}</p><p>{long}</p>", f"{long.strip()}\n{long.strip()}"
    for a, b in (("article", "article"), ("article", "section"), ("main", "section")):
        assert main_text(PAGE % f"<div><{a}>{one}</{a}><{b}>{one}</{b}></div>") == f"{text}\n{text}", (a, b)
    assert main_text(PAGE % f"<h1>T</h1><article>{one}</article>") == f"T\n{text}"


def test_furniture_stays_out():
    long = "Some words, and more words, that go on for a while, as paragraphs do. " * 3
    article, text = f"<article><h1>T</h1><p>{long}</p></article>", f"T\n{long.strip()}"
    teasers = "<div class='related'>" + "<article><h3>R</h3><p>Teaser, one.</p></article>" * 3 + "</div>"
    comments = "<div id='comments'>" + f"<article id='div-comment-1'><p>{long}</p></article><p>{long}</p>" * 9 + "</div>"
    for body in (article + teasers, article + comments, f"<main>{article}{teasers}{comments}</main>", f"<div class='has-sidebar'>{article}{comments}<div class='sidebar'><p>{long}</p></div></div>"):
        assert main_text(PAGE % body) == text
    assert main_text(PAGE % article.replace("</article>", teasers + comments + "</article>")) == text


def test_names_are_no_verdict_on_the_article():
    paragraphs = "".join(f"<p>This is paragraph {k}, with some words, and some more words that go on for a while here.</p>" for k in range(6))
    want = main_text(f"<html><body><div>{paragraphs}</div></body></html>")
    assert want.count("\n") == 5
    for name in ("content", "layout with-sidebar", "post has-comments", "social-science", "no-widgets", "single-post post comments-open", "search-results-article", "entry-related", "share", "sidebar-layout", "newsletter-archive", "header-content"):
        for tag in ("div", "section"):
            for attribute in ("class", "id"):
                page = f"<html><body><nav><a href=/>Home</a></nav><{tag} {attribute}='{name}'>{paragraphs}</{tag}><footer>f</footer></body></html>"
                assert main_text(page) == want, (name, tag)


def test_depth_is_no_limit():
    text = "<p>Some words, and more words, that go on for a while, as paragraphs do, here and there.</p>" * 3
    for deep in (1, 5, 9, 40):
        page = PAGE % ("<article>" + "<div>" * deep + "<header><h1>T</h1></header>" + text + "</div>" * deep + "</article>")
        assert main_text(page).split("\n")[0] == "T" and main_text(page).count("\n") == 3, deep


def random_page(rng, depth=0):
    """A tree as (tag, children); a leaf is (tag, text, linked text)."""
    if depth > 2 and rng.random() < 0.7 or depth > 6:
        words = lambda n: " ".join(rng.choice(["a,", "word", "other", "longer"]) for _ in range(n))
        return ("p", words(rng.randint(1, 40)), words(rng.randint(1, 12)) if rng.random() < 0.3 else "")
    return (rng.choice(["div", "section"]), [random_page(rng, depth + 1) for _ in range(rng.randint(1, 4))])


def test_scores_by_brute_force():
    """The scoring stated anew, from the top down: each element sums what its paragraphs pass up to it."""
    rng = random.Random(11)

    def markup(node):
        if node[0] == "p":
            return f"<p>{node[1]}" + (f" <a href=x>{node[2]}</a>" if node[2] else "") + "</p>"
        return f"<{node[0]}>" + "".join(map(markup, node[1])) + f"</{node[0]}>"

    def leaves(node, depth=0):
        return [(node, depth)] if node[0] == "p" else [x for c in node[1] for x in leaves(c, depth + 1)]

    def text(p):
        return p[1] + (" " + p[2] if p[2] else "")

    def worth(node):
        points = chars = linked = 0
        for p, depth in leaves(node):
            t, own = text(p), len("".join(p[2].split()))
            points += (1 + t.count(",") + min(len(t) / 100, 3)) * (1 - min(1, own / len(t))) * 0.5 ** (depth - 1)
            chars, linked = chars + len(t), linked + own
        return points * (1 - linked / chars)

    def inner(node):
        return [] if node[0] == "p" else [node] + [x for c in node[1] for x in inner(c)]

    for _ in range(150):
        top = ("div", [random_page(rng) for _ in range(rng.randint(1, 4))])
        body = ("body", [top, ("div", [("p", "x", "")])])
        scored = [(worth(v), -k, v) for k, v in enumerate(inner(body))]
        best = max(scored, key=lambda x: x[:2])
        parent = next((v for v in inner(body) if any(c is best[2] for c in v[1])), None)
        kept = [best[2]]
        if parent is not None:
            kept += [c for w, _, c in scored if any(c is x for x in parent[1]) and w >= max(10, 0.2 * best[0])]
            kept += [c for c in parent[1] if c[0] == "p" and len(text(c)) > 80 and len("".join(c[2].split())) < 0.25 * len(text(c))]
        inside = {id(p) for v in kept for p, _ in leaves(v)}
        want = "\n".join(text(p) for p, _ in leaves(body) if id(p) in inside)
        assert main_text("<html>" + markup(body) + "</html>") == want
