import re
from html import unescape

import numpy as np
import pytest

from talentweave.llm import html_extract as H

PAGES = "page_id long, url string, html string, text string"


def test_markup_settles_roles():
    html = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
    <header>site</header><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad top">buy</div><!-- <p>hidden</p> -->
    <main><header><h1>Head  line</h1></header><p>One&nbsp;two<br>three <b>four<p>Caf&eacute; &lt;b&gt; a < b<div class="comments"><p>reader</p></div>
    <form>name<input></form><aside>side</aside><ul><li>a<li>b</ul><p></p><p> \n </p><p hidden>secret</p></main><footer>&copy; x</footer></body></html>"""
    got = H.blocks_of(html)
    assert [t for r, t in got if r == H.CONTENT] == ["Head line", "One two three four", "Café <b> a < b", "a", "b"]
    assert {"menu", "buy", "site", "© x", "reader", "side"} <= {t for r, t in got if r == H.CHROME}
    assert H.blocks_of(None) == [] and H.blocks_of("plain &amp; text") == [(H.OPEN, "plain & text")]
    deep = H.blocks_of("<div>" * 20000 + "x" + "</p>" * 20000 + "</div>" * 30000 + "y")
    assert deep == [(H.OPEN, "x"), (H.OPEN, "y")]
    assert H.blocks_of("<nav><p>a</nav><p>b</div>c") == [(H.CHROME, "a"), (H.OPEN, "b"), (H.OPEN, "c")]
    assert H.blocks_of("<div>a<script>unclosed") == [(H.OPEN, "a")]


def brute_repeated(tokens, page, run, limit=2):
    seen, out = {}, [False] * len(tokens)
    for i in range(len(tokens) - run + 1):
        if len(set(page[i : i + run])) == 1:
            seen.setdefault(tuple(tokens[i : i + run]), []).append(i)
    for places in seen.values():
        if len({page[i] for i in places}) >= limit:
            for i in places:
                out[i : i + run] = [True] * run
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 5, 8])
def test_repeated_runs_equal_brute_force(run):
    rng = np.random.default_rng(run)
    for n in (0, 1, 5, 60, 400):
        tokens, page = rng.integers(1, 4, n), np.sort(rng.integers(0, 6, n))
        for limit, got in zip((2, 3), H.repeated(tokens, page, run, (2, 3)), strict=True):
            assert got.tolist() == brute_repeated(tokens.tolist(), page.tolist(), run, limit)


def test_suffixes_decide_open_blocks_on_every_host(spark):
    menu = "<div>home products about contact us imprint privacy terms jobs</div>"
    rows = [(i, f"https://h{i % 2}.example/{i}", f"{menu}<div>page {i} has words of its own here {i * 7} {i * 11}</div>", "clash") for i in range(8)]
    rows += [(20, None, None, None), (21, "https://h0.example/z", "", "x"), (21, "https://h0.example/z", "", "x"), (22, "https://alone.example", menu, "x")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in H.extract(spark.createDataFrame(rows, PAGES)).collect())
    assert len(got) == len(rows)
    texts = dict((k, t) for k, t, _ in got)
    assert texts[3] == "page 3 has words of its own here 21 33" and texts[20] == texts[21] == "" and texts[22].startswith("home")
    assert all(n == len(t) for _, t, n in got)
    assert H.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_forms_and_wrappers_do_not_hide_articles():
    page = '<html class="no-sidebar"><body class="has-sidebar"><form id="aspnetForm"><div class="content-with-sidebar"><article><p>main text</p></article><p>x</p></div><div class="sidebar"><article>teaser</article></div></form></body></html>'
    assert [t for r, t in H.blocks_of(page) if r != H.CHROME] == ["main text"]
    assert H.blocks_of("<form><p>all of it is in a form</p></form><p>x</p>") == [(H.OPEN, "all of it is in a form"), (H.OPEN, "x")]
    assert H.blocks_of("<form><p>name</p></form><p>most is elsewhere</p>") == [(H.CHROME, "name"), (H.OPEN, "most is elsewhere")]
    assert H.blocks_of('<div class="comments"><article>reader</article></div><aside><article>more</article></aside>') == [(H.CHROME, "reader"), (H.CHROME, "more")]


def test_arrays_decide_inside_articles_and_beside_them(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    note = "all rights belong to the site and its owners as the imprint says"
    beside = "see the newest offers of our partners in the shop of this site"
    page = lambda i: f"<article><p>{own(i)}</p><p>{note}</p></article><div>{beside}</div><div>{beside} {own(100 + i)}</div><div>short one</div>"
    rows = [(i, "https://a.example/x", page(i), "") for i in range(8)]
    # A copied article, a passage on two pages and an article on most pages of its host stay.
    rows += [(20 + i, "https://b.example/x", f"<article><p>{own(50)}</p><p>{note}</p></article>", "") for i in range(3)] + [(30 + i, "https://b.example/x", f"<article><p>{own(60 + i)}</p></article>", "") for i in range(6)]
    rows += [(40 + i, "https://c.example/x", f"<article><p>{own(70 + i)}</p>" + (f"<p>{note}</p>" if i < 2 else "") + "</article>", "") for i in range(8)]
    rows += [(60 + i, "https://d.example/x", f"<article><p>{own(80)}</p><p>{own(90 + i)[:29]}</p></article>", "") for i in range(4)]
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[i] == f"{own(i)}\n\n{own(100 + i)}" for i in range(8))
    assert all(got[20 + i] == f"{own(50)}\n\n{note}" for i in range(3))
    assert all(got[40 + i] == own(70 + i) + (f"\n\n{note}" if i < 2 else "") for i in range(8))
    assert all(got[60 + i] == f"{own(80)}\n\n{own(90 + i)[:29]}" for i in range(4))


def test_hot_hosts_are_dealt_into_groups(spark):
    rows = [(i, "https://hot.example/x", f"<article><p>text {i}</p></article><p>open {i}</p>", "") for i in range(200)]
    df = H.extract(spark.createDataFrame(rows, PAGES), group_bytes=1000)
    assert sorted((r.page_id, r.text) for r in df.collect()) == [(i, f"text {i}") for i in range(200)]


def test_columns_of_any_name_do_not_clash(spark):
    rows = [("u", "<p>text of host one</p>", "c")]
    df = spark.createDataFrame(rows, "host string, roles string, part string")
    assert [tuple(r) for r in H.extract(df, key="host", url="part", html="roles").collect()] == [("u", "c", "text of host one", 16)]


def test_pages_of_the_fixture_equal_a_plain_reading(spark):
    import os

    path = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    pages = spark.read.parquet(path)
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want[r.page_id] = "\n\n".join(p for p in parts if p)
    assert {r.page_id: r.text for r in H.extract(pages).collect()} == want


def test_runs_repeated_across_groups_only_are_found(spark):
    menu = "home products about contact us imprint privacy terms jobs"
    rows = [(i, "https://hot.example/x", f"<div>{menu if i % 20 == 0 else 'own %d ' % i * 9}</div><div>page {i} says {i * 3} and {i * 5} and {i * 7} to {i * 9}</div>", "") for i in range(60)]
    one = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES)).collect()}
    many = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, PAGES), group_bytes=150).collect()}
    assert one == many and one[20] == "page 20 says 60 and 100 and 140 to 180"


def test_run_hashes_tell_runs_apart():
    words = [f"w{i % 7}" for i in range(50)]
    got = H.run_hashes(words, 3)
    assert len(got) == 48 and len(set(got.tolist())) == 7 and got[0] == got[7] and len(H.run_hashes(words[:2], 3)) == 0


def test_groups_do_not_change_what_is_the_sites(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    note, rare = "all rights belong to the site and its owners as the imprint says", "a passage of more than eight words that two of the pages share"
    rows = [(i, "https://hot.example/x", f"<article><p>{own(i)}</p><p>{note}</p>" + (f"<p>{rare}</p>" if i < 2 else "") + "</article>", "") for i in range(4)]
    # Repeated rows are one page: three of them do not make a block the site's.
    rows += [(9, "https://copies.example/x", f"<article><p>{own(9)}</p><p>{note}</p></article>", "")] * 4 + [(10, "https://copies.example/x", f"<article><p>{own(10)}</p></article>", "")]
    df = spark.createDataFrame(rows, PAGES)
    for size in (10**9, 600, 150, 1):
        got = {r.page_id: r.text for r in H.extract(df, group_bytes=size).collect()}
        assert got == {i: own(i) + (f"\n\n{rare}" if i < 2 else "") for i in range(4)} | {9: f"{own(9)}\n\n{note}", 10: own(10)}


def test_names_inside_articles_need_all_their_words():
    page = """<h1>The headline</h1><h1 class="banner">Shop</h1><article><div class="related-work">other work</div><section class="share-prices">prices rose</section><p id="comment-on-law">law</p>
    <div class="related-posts">more</div><div id="comment-12">reader</div><div class="ad-slot">buy</div><ul class="share-buttons"><li>post it</li></ul></article><h1>After</h1>"""
    assert [t for r, t in H.blocks_of(page) if r == H.CONTENT] == ["The headline", "other work", "prices rose", "law"]
    assert [t for r, t in H.blocks_of("<h1>Site</h1><article><h1>Own</h1><p>x</p></article>") if r == H.CONTENT] == ["Own", "x"]
    assert H.blocks_of('<div class="page-header-content"><p>all of the page</p></div><p>x</p>') == [(H.OPEN, "all of the page"), (H.OPEN, "x")]
    assert H.blocks_of("<h1>Title</h1><p>x</p>") == [(H.OPEN, "Title"), (H.OPEN, "x")]


def test_short_blocks_do_not_depend_on_the_size_of_groups(spark):
    menu = "<div>home products</div><div>about contact us</div><div>imprint privacy terms jobs</div>"
    rows = [(i, "https://short.example/x", f"{menu}<div>page {i} {i * 7}</div>", "") for i in range(12)]
    # Rows of one page: no run goes from one into the other.
    rows += [(i, "https://rows.example/x", t, "") for i in (20, 21) for t in ("<p>one two three four</p>", "<p>five six seven eight</p>")]
    df = spark.createDataFrame(rows, PAGES)
    for size in (10**9, 400, 1):
        got = sorted((r.page_id, r.text) for r in H.extract(df, group_bytes=size).collect())
        assert got == sorted([(i, f"page {i} {i * 7}") for i in range(12)] + [(i, t) for i in (20, 21) for t in ("one two three four", "five six seven eight")])
