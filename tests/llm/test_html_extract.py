import html
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trekframe.llm import html_extract as H
from trekframe.llm.common import table

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header>Site <b>name</b></header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>A &amp; B</h1><p>One<b>two</b>&nbsp;three<br>four<p>five <span class="ad">buy</span>six</p><form><input>go</form>
<!-- hidden --><aside>side</aside><pre>a
 b</pre></article><section id="comments"><p>first!</p></section></main><footer>&copy; x</footer></body></html>"""


def test_one_page():
    assert H.main_texts([H.blocks(PAGE)]) == ["A & B Onetwo three four five six a b"]


def test_pages_table(spark, sf_dir):
    got = {r.page_id: r for r in H.extract_pages(table(spark, sf_dir, "pages")).collect()}
    rows = table(spark, sf_dir, "pages").collect()
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article[^>]*>(.*?)</article>", r.html, re.S)[1]
        inner = re.sub(r"<[^>]*>", "", re.sub(r"<(/?)(p|h1|br|div)\b[^>]*>", " ", inner))
        want = " ".join(html.unescape(inner).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (want, len(want), r.url)


def test_repeated_passages_go_where_no_element_vouches(spark):
    boiler = " ".join(f"b{i}" for i in range(20))
    unique = [" ".join(f"u{k}x{i}" for i in range(30)) for k in range(3)]
    rows = [(k, "http://h.example/" + str(k), f"<body><div>{boiler}</div><div>{u}</div></body>") for k, u in enumerate(unique)]
    rows += [(9, "http://other.example/", f"<body><div>{boiler}</div></body>"), (10, None, None), (11, "", ""), (12, "x", "<p>unclosed &amp"), (13, None, "<b>" * 5000 + "deep" + "</i>" * 5000)]
    pages = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r.page_id: r.text for r in H.extract_pages(pages).collect()}
    assert got == {0: unique[0], 1: unique[1], 2: unique[2], 9: boiler, 10: "", 11: "", 12: "unclosed &", 13: "deep"}
    assert H.extract_pages(pages.limit(0)).count() == 0
    article = spark.createDataFrame([(i, "http://h.example/", f"<article><p>{boiler}</p></article>") for i in range(3)], "page_id long, url string, html string")
    assert {r.text for r in H.extract_pages(article).collect()} == {boiler}


def test_a_host_in_several_chunks_loses_no_page(spark):
    rows = [(i, "http://h.example/", f"<article>{i}</article>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(r.page_id, r.text) for r in H.extract_pages(pages, chunk=40).collect()} == {(i, str(i)) for i in range(300)}


def bare(page):
    """The page with div in place of every element that tells what its text is, and without class names."""
    return re.sub(r"<(/?)(?:article|nav|footer|ul|li|h1)\b[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", page))


def test_text_comes_through_the_suffix_array_where_markup_says_nothing(spark):
    """Article, menu and footer elements made div, class names gone: words of the article are still told from the rest."""
    from collections import Counter

    rows = [(r.page_id, r.url, r.html) for r in table(spark, "/root/testdata/sf0.1", "pages").where("page_id % 2 = 0 or url like '%blog%'").collect()]
    want = {i: Counter(html.unescape(re.sub(r"<[^>]*>", " ", re.search(r"<article[^>]*>(.*?)</article>", h, re.S)[1])).split()) for i, _, h in rows}
    around = {i: Counter(html.unescape(re.sub(r"<(script|style|title)>.*?</\1>|<!--.*?-->|<[^>]*>", " ", h, flags=re.S)).split()) - want[i] for i, _, h in rows}
    pages = spark.createDataFrame([(i, u, bare(h)) for i, u, h in rows], "page_id long, url string, html string")
    got = {}
    for size in (1, 60, 2000):
        got[size] = {r.page_id: r.text for r in H.extract_pages(pages.repartition(1 + size % 7), chunk=size).collect()}
    assert got[1] == got[60] == got[2000]
    found = {i: Counter(t.split()) for i, t in got[60].items()}
    right = sum((found[i] & want[i]).total() for i in want)
    assert right / sum(c.total() for c in want.values()) >= 0.95
    assert right / sum(c.total() for c in found.values()) >= 0.97
    large = [i for i, u, _ in rows if "blog.tionsh.example.com" in u]  # enough pages that nearly all of its chrome repeats
    assert len(large) > 100
    assert sum((found[i] - want[i]).total() for i in large) <= 0.1 * sum(around[i].total() for i in large)


def test_hidden_elements_go_and_an_articles_header_stays():
    page = '<header>Site</header><article><header class="entry-header"><h1>Title</h1></header><p title="hidden gem">hello</p><div hidden>secret</div><div class="note" hidden="until-found">more</div></article>'
    assert H.main_texts([H.blocks(page)]) == ["Title hello"]


def test_passages_of_a_host_go_and_copies_stay(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    six = [(i, "http://a.example/", f"<div>own {i} words w{i} x{i}</div><div>{passage}</div>") for i in range(6)]
    body = "".join(f"<div>{' '.join(f's{k}t{i}' for i in range(30))}</div>" for k in range(4))
    copies = [(100 + i, "http://b.example/", f"<div>top {i}</div>{body}<div>end {i} of it</div>") for i in range(5)]
    want = {i: f"own {i} words w{i} x{i}" for i in range(6)} | {100 + i: " ".join(re.sub("<[^>]*>", " ", f"top {i} {body} end {i} of it").split()) for i in range(5)}
    pages = spark.createDataFrame(six + copies, "page_id long, url string, html string")
    for size in (1, 2, 2000):
        assert {r.page_id: r.text for r in H.extract_pages(pages, chunk=size).collect()} == want
    clash = pages.selectExpr("*", "1 host", "'x' kinds", "array(1) texts", "2 part", "3 owner", "true split", "0 k", "'' repeated", "'' cover", "1 hot_host")
    assert {r.page_id: r.text for r in H.extract_pages(clash, chunk=2).collect()} == want
    long = spark.createDataFrame([(i, "http://a.example/", "<div>" + " ".join(f"{i}z{k}" for k in range(200_000)) + "</div>") for i in range(3)], pages.schema)
    assert [r.n_chars for r in H.extract_pages(long, chunk_bytes=1000).collect()] == [r.n_chars for r in H.extract_pages(long).collect()] and H.extract_pages(long).agg({"n_chars": "min"}).first()[0] > 1_000_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=12), max_size=5), st.integers(1, 4))
def test_covered_equals_brute_force(streams, run):
    owners = {}
    for k, s in enumerate(streams):
        for i in range(len(s) - run + 1):
            owners.setdefault(tuple(s[i : i + run]), set()).add(k)
    want = []
    for s in streams:
        flags = np.zeros(len(s), bool)
        for i in range(len(s) - run + 1):
            if len(owners[tuple(s[i : i + run])]) > 1:
                flags[i : i + run] = True
        want.append(flags.tolist())
    assert [x.tolist() for x in H.covered(streams, run)] == want


def test_repetition_is_found_over_the_whole_host(spark):
    """Notices that two or three of 400 pages share go, whichever chunks the pages are in; other pages and repeats of one page_id stay."""
    rows, want = [], {}
    for i in range(400):
        own = " ".join(f"u{i}x{k}" for k in range(20))
        notice = " ".join(f"n{i % 150}y{k}" for k in range(15))
        menu = f"<nav>{' '.join(f'm{i}z{k}' for k in range(15))}</nav>"
        echo = " ".join(f"m{i - 1}z{k}" for k in range(15)) if i % 10 == 5 else f"alone{i}"
        rows.append((i, f"http://h.example/{i}", f"{menu}<div>{own}</div><div>{notice}</div><div>{echo}</div>"))
        want[i] = own + ("" if i % 10 == 5 else f" alone{i}")
    rows += [(999, f"http://h.example/copy{k}", "<div>" + " ".join(f"c{j}" for j in range(30)) + "</div>") for k in range(3)]
    want[999] = " ".join(f"c{j}" for j in range(30))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = H.extract_pages(pages, chunk=80).collect()
    assert len(got) == 403 and {(r.page_id, r.text) for r in got} == set(want.items())
    assert {(r.page_id, r.text) for r in H.extract_pages(pages, chunk=8000).collect()} == set(want.items())


def test_names_of_layouts_and_anchors_lose_no_text():
    text = lambda page: H.main_texts([H.blocks(page)])[0]
    assert text('<div class="layout has-sidebar"><article><p>Hello world of text</p></article></div>') == "Hello world of text"
    assert text('<div id="main" class="with-header"><article><p>Hello</p></article><div class="sidebar">side</div></div>') == "Hello"
    assert text('<main><section id="social-history"><p>Of towns</p></section><section id="comments"><p>first!</p></section></main>') == "Of towns"
    assert text('<article><p>Read <a class="share" href="#">the report</a> of <span class="related">others</span> <span class="ad">buy</span>now</p></article>') == "Read the report of others now"
    assert text('<body><div class="search-page"><p>' + "word " * 60 + '</p></div><div class="menu">Home</div></body>') == ("word " * 60).strip()
    assert text('<article><p>a</p><div class="share-buttons">Share</div><div id="related-links">More</div><div class="newsletter">Join</div><p>b</p></article>') == "a b"
    assert text('<div class="nav-wrapper"><div class="page-header"><main><p>deep</p></main></div></div>') == "deep"


def test_nested_wrappers_take_little_time():
    import time

    start = time.time()
    page = '<div class="sidebar">' * 300 + "<article>" + "word " * 20_000 + "</article>" + "</div>" * 300
    assert len(H.blocks(page)) == 1 and time.time() - start < 10
