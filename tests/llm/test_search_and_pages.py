import time

import numpy as np

from tallyreef.llm import site_tree, topk
from tests.compare import same
from tests.llm import plain


def test_op10_equals_oracle(spark, duck, sf):
    same(topk.op10_top_k(spark, sf), duck.sql(topk.ORACLE_SQL))


def brute(q_rows, q, rows, ids, c, top):
    found = []
    for r, x in zip(q_rows, q, strict=True):
        scores = [max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for y in c]
        best = sorted((i for i in range(len(c)) if rows[i] != r), key=lambda i: (-scores[i], ids[i]))[:top]
        found += [(r, ids[i], scores[i]) for i in best]
    return sorted(found)


def test_blocks_equal_brute_force():
    draw = np.random.default_rng(11)
    c = np.floor(256 * draw.normal(0, 0.2, (900, 24)))
    c[100:150] = c[100]  # ties
    rows, ids = np.arange(900), np.arange(900) % 700  # ids repeat
    for scale in (1, 1 << 20, 1e30):  # scores beyond doubles, and beyond 64 bits
        held = topk.Held([(rows[i : i + 250], ids[i : i + 250], c[i : i + 250] * scale) for i in range(0, 900, 250)])
        places, found, scores = held.best(rows[:120], c[:120] * scale, 5)
        expected = brute(rows[:120].tolist(), c[:120] * scale, rows.tolist(), ids.tolist(), c * scale, 5)
        assert sorted(zip(places.tolist(), found.tolist(), scores.tolist(), strict=True)) == expected


def test_bounds_prune_groups_of_vectors():
    """Vectors in groups: the bounds leave few pairs, and the best are found all the same."""
    draw = np.random.default_rng(5)
    middles = draw.normal(0, 100, (40, 64))
    c = np.floor(middles[draw.integers(0, 40, 4000)] + draw.normal(0, 5, (4000, 64)))
    rows = np.arange(4000)
    held = topk.Held([(rows[i : i + 500], rows[i : i + 500], c[i : i + 500]) for i in range(0, 4000, 500)])
    places, found, scores = held.best(rows[:40], c[:40], 5)
    assert sorted(zip(places.tolist(), found.tolist(), scores.tolist(), strict=True)) == brute(rows[:40].tolist(), c[:40], rows.tolist(), rows.tolist(), c, 5)
    shares = held.left / held.pairs
    print("left by the bounds", shares)


def test_top_k_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, None, 2), (2, [nan, 1.0], 3), (3, [inf, 1.0], 4), (4, [None, 1.0], 5), (5, [], 6), (None, [1.0, 1.0], 7), (6, [1.0, 1.0], 8), (6, [1.0, 1.0], 9), (7, [1.0, 1.0], 9), (50, [-1.0, 0.25, 3.0], 1), (100, [0.5, 0.5], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").repartition(3)
    found = [tuple(r) for r in topk.top_k(df, top=3).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 6, 256 * 384), (0, 2, 6, 256 * 384), (0, 3, 7, 256 * 384), (100, 1, 6, 2 * 128 * 256), (100, 2, 6, 2 * 128 * 256), (100, 3, 7, 2 * 128 * 256)]
    assert topk.top_k(df.filter("vec_id < 0")).count() == 0


def test_each_query_row_has_its_own_ranks(spark):
    """Two query rows of one id: each has all five ranks, and meets the other."""
    rows = [(50, [1.0]), (50, [1.0])] + [(i, [float(i)]) for i in (8, 7, 6, 5, 4)]
    found = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert found == sorted((50, rank, i, 65536 * i) for rank, i in enumerate((8, 7, 6, 5, 4), 1) for _ in range(2))
    alone = topk.top_k(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")).collect()
    assert sorted((r["rank"], r.vec_id) for r in alone) == [(1, 8), (1, 8), (2, 50), (2, 50)]


def page(i, body):
    menu = "<div class='alpha'><a href='/'>Home</a><a href='/all'>All items</a></div>"
    return f"<html><head><title>t</title><style>p {{}}</style></head><body>{menu}<div class='beta'>{body}</div><div class='gamma'>All rights kept since 1999</div><script>var a = '<p>no</p>'</script></body></html>"


def test_site_tree_drops_what_all_pages_share(spark):
    """No name says what is a menu or a footer here: only the site's pages do."""
    rows = [(i, f"http://h.example/{i}", page(i, f"<p>Story {i} &amp; more\n text.</p><p>Second part {i * 7}.</p>"), "x", 5) for i in range(12)]
    rows += [(100, None, None, "x", 5), (101, "", "", "x", 5), (102, "http://one.example/", "<p>Alone <b>bo</b>ld</p><nav>menu</nav><p>next", "x", 5), (103, "http://h.example/0", page(0, "<p>Story 0 &amp; more\n text.</p><p>Second part 0.</p>"), "x", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path int").repartition(3)
    found = {r.page_id: r.main_text for r in site_tree.extract(pages).collect()}
    assert found[3] == "Story 3 & more text. Second part 21."
    assert found[0] == found[103] and found[100] == found[101] == "" and found[102] == "Alone bold next"
    assert site_tree.extract(pages.filter("page_id < 0")).count() == 0


def test_site_tree_named_noise():
    html = "<body><header>Top</header><main><article><h1>T</h1><p>Body<script>x()</script> text</p><aside>see also</aside><form>f</form></article><section class='comments'><p>first!</p></section></main><footer>F</footer></body>"
    assert site_tree.main_text(site_tree.parse(html), frozenset()) == "T Body text"


def test_site_tree_copies_count_once(spark):
    """Most pages of the host are copies of one; the others keep their text, whose container has a neutral class."""
    rows = [(i, "http://h.example/", f"<body><div class='post-body'><p>Story {i if i < 40 else 0} told.</p></div></body>") for i in range(100)]
    found = {r.page_id: r.main_text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: f"Story {i if i < 40 else 0} told." for i in range(100)}


def test_site_tree_names_spare_the_article():
    for body in ("<div class='has-sidebar'><article><p>Body</p><div class='share'>S</div></article></div>", "<div class='share layout'><main><p>Body</p></main></div>", "<main><div class='with-sidebar'><article>Body</article></div></main>", "<main><p>Body</p><div class='comments'><article>first!</article></div></main>", "<article>Body</article><div class='related'><article>Other</article></div>"):
        assert site_tree.main_text(site_tree.parse(f"<body>{body}<div class='footer'>F</div></body>"), frozenset()) == "Body"


def test_op3_has_a_text_for_every_page(spark, sf):
    rows = site_tree.op3_site_tree(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all(r.n_chars == len(r.text) and r.text == " ".join(r.text.split()) for r in rows)


def test_site_tree_reads_names_as_a_whole():
    for html, text in (
        ('<div class="content no-sidebar"><p>Whole article here.</p></div>', "Whole article here."),
        ('<article><div class="social-history"><p>A history.</p></div></article>', "A history."),
        ("<p title=it's>Don't lose this</p><p>next</p>", "Don't lose this next"),
        ("<p>a</p><div class='site-footer'>f</div><div id='commentList'>c</div><ul class='nav-links'><li>n</ul><div class='ad-slot'>x</div>", "a"),
        ("<p>1 < 2</p><p class=\"x>y</p>\"></p>z<p title='>'>w</p>", "1 < 2 z w"),
    ):
        assert site_tree.main_text(site_tree.parse(html), frozenset()) == text


def test_site_tree_is_linear_in_depth():
    def seconds(n):
        html = "<div><b>" * n + "x" * n + "</i></p>" * n + "</b></div>" * n + "<p title='a" * 3
        began = time.perf_counter()
        page = site_tree.parse(html)
        site_tree.node_rows(page)
        site_tree.main_text(page, frozenset())
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 60 * seconds(1_000)


def test_importance_equals_plain_trees(spark, sf):
    """Entropies of the hosts' trees against a plain tree, for the test pages with what they are told by name taken away."""
    d = sf.replace("sf0.001", "sf0.01")
    rows = [(r.url, r.html.replace("<footer>", "<div class=k1>").replace("</footer>", "</div>").replace("<nav>", "<div class=k2>").replace("</nav>", "</div>")) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    rows += [("http://same.example/", f"<body><div class=a>All rights kept</div><div class=b><p>{i % 3}<p>{'x' * i}</div>") for i in range(20)] + [("http://same.example/", "<body><div class=a>All rights kept</div>")] * 5
    expected = plain.node_importance([(u, h) for u, h in rows])
    found = {(r.host, r.path): (r.pages, r.importance) for r in site_tree.site_trees(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert found.keys() == expected.keys()
    assert all(n == expected[k][0] and abs(x - expected[k][1]) < 1e-9 for k, (n, x) in found.items())
    assert any(n >= site_tree.LEAST_PAGES and x < site_tree.LEAST_IMPORTANCE for n, x in found.values())


def test_site_tree_on_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, "<p>a"), (2, "http://h.example/", deep), (3, "http://h.example/", "<p>" + "long text " * 50_000), (4, "no address", "<"), (5, "http://h.example/", "plain"), (None, "http://h.example/", "plain"), (5, "http://h.example/", "plain")]
    found = [(r.page_id, r.main_text_) for r in site_tree.extract(spark.createDataFrame([(*r, "m", "h") for r in rows], "page_id long, url string, html string, main_text string, digest string")).collect()]
    assert sorted(found, key=str) == sorted([(1, "a"), (2, "deep"), (3, ("long text " * 50_000).strip()), (4, "<"), (5, "plain"), (None, "plain"), (5, "plain")], key=str)
