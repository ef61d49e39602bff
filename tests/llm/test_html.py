"""Page parsing, tree matching and wrapper induction."""

import random
import time

from tidemark.llm import html_extract as h


def texts(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    return {r.page_id: r.text for r in h.extract(df).collect()}


BODY = (
    "<html><head><title>T &amp; t</title><style>p{{}}</style><script>var a='</p><p>no';</script></head><body><!-- <p>no</p> -->"
    "<header>Site</header><nav><ul><li>Home<li>News</ul></nav><div class='cookie-notice'>ok?</div><div id=sidebar>side</div>"
    "{}<form>Name <input><button>Go</button></form><section class=comments><article>first!</article></section><footer>&copy; x</footer>"
)


def test_article_and_boilerplate(spark):
    art = "<article><header><h1>Head&nbsp;line</h1></header><p>One <b>bold<br>two\n three<p>A &lt; B &#233;</p><div class=ad>buy</div>tail<ul><li>x<li>y</ul></article>"
    got = texts(spark, [(1, "http://a/1", BODY.format(art)), (2, "http://a/2", BODY.format("")), (3, None, None), (4, "", "")])
    assert got[1] == "Head line\n\nOne bold two three\n\nA < B é\n\ntail\n\nx\n\ny"
    assert (got[2], got[3], got[4]) == ("", "", "")


def test_cut_pages(spark):
    got = texts(spark, [(1, "http://a", "<body><article><p>Whole text</p><p>rest &amp then <b"), (2, "http://a", "<nav>menu<article>t</article>"), (3, "http://b", "a < b and c > d"), (4, "http://b", "<p title='x")])
    assert got == {1: "Whole text\n\nrest & then", 2: "t", 3: "a < b and c > d", 4: ""}


def test_wrapper_of_a_host_without_names(spark):
    page = "<div class=x1>Our site</div><div class=x2><h2>{0} title</h2><p>{0} text of {0}</p>{1}</div><div class=x3>Terms</div>"
    rows = [(i, f"https://Host.example/{i}", page.format(f"n{i}", "<p>more</p>" if i % 2 else "")) for i in range(12)]
    got = texts(spark, rows)
    assert got[0] == "n0 title\n\nn0 text of n0" and got[1] == "n1 title\n\nn1 text of n1\n\nmore"


def test_many_trees_are_dealt_in_groups(spark, monkeypatch):
    monkeypatch.setattr(h, "TREES", 4)
    rows = [(i, "https://h/", f"<div class=t>same</div><main>{'<p>a</p><hr><div>b</div>' * (i % 3)}<h{1 + i % 6}>t{i}</h{1 + i % 6}></main>") for i in range(40)]
    got = texts(spark, rows)
    assert all(got[i].endswith(f"t{i}") and "same" not in got[i] for i in range(40))


def test_groups_of_trees_decide_nothing(spark, monkeypatch):
    # Every page has a tree of its own; a box that is on few pages is template whatever group its pages are in.
    box = "<div class=x9>Subscribe and never miss a story</div>"
    page = lambda i: f"<article><h1>t{i}</h1>{box if i % 10 == 3 else ''}{'<p>a%d</p><hr><ul><li>b%d</ul>' % (i, i) * (1 + i // 9)}<h{2 + i % 5} class=c{i % 9}>z{i}</h{2 + i % 5}></article>"
    rows = [(i, f"http://{'few' if i >= 80 else 'many'}/{i}", page(i)) for i in range(90)] + [(90, None, ""), (91, "http://many/", None)]
    found = []
    for size in (3, 10, 10_000):
        monkeypatch.setattr(h, "TREES", size)
        found.append(texts(spark, rows))
    assert found[0] == found[1] == found[2]
    assert not any("Subscribe" in found[0][i] for i in range(80)) and found[0][3].startswith("t3\n\na3\n\nb3") and found[0][91] == ""


def score(a, b):
    matcher = h.Matcher()
    shapes = matcher.number(a) | matcher.number(b)
    x, y = shapes[id(a)], shapes[id(b)]
    matcher.settle(x, y)
    return matcher.score(x, y)


def test_simple_tree_matching():
    a, _ = h.tree_of("-1 - \n0 - div\n1 - p\n1 - ul\n3 - li\n0 - foot", {})
    b, _ = h.tree_of("-1 - \n0 - div\n1 - h1\n1 - ul\n3 - li\n0 - x\n0 - foot", {})
    assert score(a, b) == 5


def test_matching_equals_the_textbook_recursion(monkeypatch):
    def brute(a, b):
        if (a.key, a.role) != (b.key, b.role):
            return 0
        best = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, c in enumerate(a.children):
            for j, d in enumerate(b.children):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute(c, d))
        return best[-1][-1] + 1

    rng = random.Random(3)

    def tree(n):
        nodes = [h.Node("r", "-")]
        for _ in range(n):
            node = h.Node(rng.choice("abc"), rng.choice("--s"))
            rng.choice(nodes[-4:]).children.append(node)
            nodes.append(node)
        return nodes[0]

    for cells in (4_000_000, 3):
        monkeypatch.setattr(h, "CELLS", cells)
        for _ in range(60):
            a, b = tree(rng.randrange(14)), tree(rng.randrange(14))
            want, sizes = brute(a, b), (len(h._all(a)), len(h._all(b)))
            assert score(a, b) == want
            found = {}
            h.merge(a, b, found)
            assert len(found) == sizes[1] and len(h._all(a)) == sizes[0] + sizes[1] - want


def test_names_count_as_whole_words(spark):
    kept = [
        '<body class="single no-sidebar"><p>{0}</p>', '<body class="has-sidebar nav-open"><main><p>{0}</p></main>', '<article><section id="related-work"><p>{0}</p></section></article>',
        '<main><div class="promotion-talk"><p>{0}</p></div></main>', '<main><p title="a hidden gem">{0}</p></main>', '<article><div class="entry-header"><h1>{0}</h1></div></article>',
        '<article id="comments"><h2 class="alert">{0}</h2></article>', '<main><p data-style="display:none">{0}</p></main>',
    ]
    lost = ['<div class="site-footer">{0}</div>', '<div class="box newsletter-signup">{0}</div>', "<p hidden>{0}</p>", "<p style='color:red; display : none'>{0}</p>", "<div id=cookie_banner>{0}</div>", "<div role=navigation>{0}</div>"]
    rows = [(i, f"http://h{i}/", html.format(f"text {i}")) for i, html in enumerate(kept + lost)]
    got = texts(spark, rows)
    assert [got[i] for i in range(len(rows))] == [f"text {i}" for i in range(len(kept))] + [""] * len(lost)


def test_constant_boxes_of_a_host_go_from_its_articles(spark):
    rows = [(i, "http://a/", f"<article><h1>title {i}</h1><p>text {i}</p><div class=x9>Share this with all your friends</div></article>") for i in range(40)]
    rows += [(100 + i, "http://b/", "<article><h1>One</h1><p>only text</p></article>") for i in range(5)]
    got = texts(spark, rows)
    assert all(got[i] == f"title {i}\n\ntext {i}" for i in range(40)) and got[100] == "One\n\nonly text"


def test_deep_pages_and_many_siblings(spark):
    deep = lambda n: "<div>" * n + "<p>inside</p>" + "</div>" * n
    many = lambda n, word: "".join(f"<h2>{word} {i}</h2><p>{word} text {i}</p>" for i in range(n))
    rows = [(1, "http://a/", deep(5000)), (2, "http://a/", deep(4000)), (3, "http://b/", many(10_000, "x")), (4, "http://b/", "<hr>" + many(9_000, "y") + "<ul><li>z</ul>" + many(900, "y"))]
    start = time.time()
    got = texts(spark, rows)
    assert time.time() - start < 60
    assert got[1] == got[2] == "inside" and got[3].startswith("x 0\n\nx text 0\n\nx 1") and got[4].endswith("y text 899")


def test_repeated_pages_and_empty_table(spark):
    page = "<article><p>only text</p></article>"
    df = spark.createDataFrame([(1, "http://a", page)] * 5, "page_id long, url string, html string")
    assert [r.text for r in h.extract(df).collect()] == ["only text"] * 5
    assert h.extract(df.limit(0)).count() == 0
