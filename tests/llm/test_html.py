import json
import random

from taskledger.llm import html as H

from .conftest import WORDS

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav>
<header>Site name</header><!-- <p>no</p> --><div class="ad">Buy</div><article><h1>Title &amp; more</h1><p>One <b>two
  three</b><br>four<p>A &lt; B &#233; &nbsp; end<div class="share-bar">Share</div><section id="comments"><p>First!</p></section>
<ul><li>x<li>y</ul><table><tr><td>c1<td>c2</table><form><p>Name</p></form></article><aside>Side</aside><footer>&copy;</footer>"""
WANT = "Title & more\nOne two three four\nA < B é end\nx\ny\nc1\nc2"


def alone(page):
    """The article by the wrapper of this page alone."""
    return H.article(page, H.judged(H.wrapper_of(H.parse(page)[0])))


def bare(items):
    """A sequence without what its slots carry."""
    return [x[0] if x[0] == "#" else [*x[:-1], bare(x[-1])] for x in items]


def together(*pages):
    wrapper = H.wrapper_of(H.parse(pages[0])[0])
    for page in pages[1:]:
        wrapper = H.align(wrapper, H.wrapper_of(H.parse(page)[0]), H._over_pages)
    return wrapper


def test_article_of_one_page():
    assert alone(PAGE) == WANT


def test_folding():
    li = ["e", "li", ["#"]]
    assert bare(H.parse("<ul><li>a<li>b</ul>")[0]) == [["e", "ul", [["+", [li]]]]]
    assert bare(H.parse("<dl>" + "<dt>a<dd>b" * 3 + "</dl>")[0]) == [["e", "dl", [["+", [["e", "dt", ["#"]], ["e", "dd", ["#"]]]]]]]
    names = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "dl", "ul", "hr", "address"]
    row = "".join(f"<{n}>x</{n}>" for n in names)
    assert [x[0] for x in H.parse(row * 4 + "end")[0]] == ["+", "#"]  # groups of any length


def test_alignment_makes_optional_and_repeated_groups():
    a, b = "<div class=x><p>x</p><p>y</p></div>", "<div class=x><h1>t</h1><p>z</p></div>"
    want = [["e", "div.x", [["?", [["e", "h1", ["#"]]]], ["+", [["e", "p", ["#"]]]]]]]
    assert bare(together(a, b)) == want == bare(together(b, a)) == bare(together(a, b, a, b))
    shape, slots = H.flat(together(a, b))
    assert H.built(shape, slots) == together(a, b) and [s[0] for s in slots] == [1, 2]


def test_slots_know_what_never_changes():
    pages = [f"<div><p>Menu</p></div><div><h1>Title {i}</h1><p>Text {i * i}</p></div>" for i in range(3)]
    (_, _, menu), (_, _, text) = (H._opened(x)[2][0] for x in together(*pages))
    assert menu[0][2][0][1] == 3 and menu[0][2][0][4] is not None
    assert [x[2][0][4] for x in text] == [None, None]


def test_deep_and_wide_pages():
    deep = "<div>" * 3_000 + "text" + "</div>" * 3_000
    assert alone(deep) == "text"
    wide = "<article>" + "".join(f"<p>a<b>{i}</b></p><h2>t</h2><ul><li>x</li></ul>" for i in range(500)) + "</article>"
    assert len(alone(wide).split("\n")) == 1_500 and len(H.flat(H.wrapper_of(H.parse(wide)[0]))[0]) < 200


def test_pages_without_article_element():
    page = "<html><body><div class='top-header'>H</div><div id=menu>M</div><div class=post><p>text</p></div><div class='cookie-notice'>N</div></body></html>"
    assert alone(page) == "text"


def test_only_what_the_page_surrounds_the_article_with_goes():
    """Elements of an article that aren't furniture stay: formulas, drawings, what stands in for scripts."""
    page = "<article><p>Sum <math><mi>x</mi></math> and <svg><text>drawn</text></svg></p><noscript><p>no script</p></noscript><object><p>inner</p></object></article>"
    assert alone(page) == "Sum x and drawn\nno script\ninner"


def test_classes_that_hold_listed_words_keep_their_article():
    text = "The market moved again today, and nobody could say why it did so. " * 5
    for name in ("share-prices", "search-engines", "notice-board", "related-work"):
        page = f"<body><div class=page><div class='share-bar'><p>Tell a friend</p></div><div class='{name}'><h1>News</h1><p>{text}</p></div></div></body>"
        assert alone(page) == f"News\n{text.strip()}"
        page = f"<body><article><h1>News</h1><p>{text}</p><div class='{name}'><p>{text}</p></div><div class='share'>Share</div></article></body>"
        assert alone(page) == f"News\n{text.strip()}\n{text.strip()}"


def site(seed, host, n):
    """(pages, articles): pages of one host of invented make, without a telling class or element, and the blocks that are the article's."""
    draw = random.Random(seed)

    def sentence(k):
        return " ".join(draw.choices(WORDS, k=k)).capitalize() + "."

    first, last = sentence(draw.randrange(3, 40)), sentence(draw.randrange(20, 60))
    around = [lambda: f"<div><p>{first}</p></div>", lambda: "<div><ul>" + "".join(f"<li><a href=/{k}>{sentence(2)}</a></li>" for k in range(draw.randrange(3, 9))) + "</ul></div>"]
    draw.shuffle(around)
    pages, articles = [], []
    for _ in range(n):
        blocks = [("h1", sentence(5))] + [("p", sentence(draw.randrange(8, 40))) for _ in range(draw.randrange(1, 6))]
        if draw.random() < 0.4:
            blocks.insert(2, ("h2", sentence(3)))
        if draw.random() < 0.3:
            blocks += [("li", sentence(6)) for _ in range(3)]
        inner = "".join(f"<{t}>{x}</{t}>" for t, x in blocks if t != "li")
        inner += "<ul>" + "".join(f"<li>{x}</li>" for t, x in blocks if t == "li") + "</ul>" if any(t == "li" for t, _ in blocks) else ""
        pages.append("<body>" + "".join(a() for a in around) + f"<div>{inner}</div><div><p>{last}</p><p>{host}</p></div></body>")
        articles.append("\n".join([x for t, x in blocks if t != "li"] + [x for t, x in blocks if t == "li"]))
    return pages, articles


def test_generated_sites(spark):
    """Every page of sites whose furniture no name gives away; by its own wrapper alone many a page keeps furniture, so alignment decides."""
    rows, want, single = [], {}, 0
    for seed in range(12):
        pages, articles = site(seed, f"h{seed}.example", 8)
        for page, text in zip(pages, articles):
            want[len(rows)] = text
            rows.append((len(rows), f"https://h{seed}.example/{len(rows)}", page))
            single += alone(page) != text
    got = {r.page_id: r.text for r in H.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want and single > len(want) / 4


def test_rounds_give_one_wrapper_a_host(spark, monkeypatch):
    """A host of many shapes goes through several rounds of small groups."""
    monkeypatch.setattr(H, "FAN", 4)
    kinds = ["h2", "pre", "ul", "dl", "table", "address", "section"]
    rows = [(i, "http://one.example/", "<article><p>t</p>" + "".join(f"<{k}>x{i}</{k}>" for j, k in enumerate(kinds) if i >> j & 1) + "</article>") for i in range(100)]
    found = H.infer_wrappers(H.with_host(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    assert len(found) == 1 and {s[0] for s in json.loads(found[0].slots)} >= {100}


def test_query(spark):
    rows = [(1, "http://a.example/x", PAGE, 1), (2, "http://A.example:80/y", "<article><p>second</p></article>", 2), (3, None, None, 3), (4, "http://b.example/", "", 4), (None, "no url", "plain text only", 5), (2, "http://a.example/y", "<article><p>second</p></article>", 6),
            (7, "http://c.example/", "<article>" + "<p>long words </p>" * 3_000 + "</article>", 7), (8, "http://c.example/", "<article><div><p>unclosed &amp <i>x", 8), (9, "http://d.example/", "<script>never closed", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int").repartition(2)
    got = sorted((r.page_id or -1, r.text, r.n_chars, r.url) for r in H.extract_articles(pages).collect())
    want = {1: WANT, 2: "second", 3: "", 4: "", None: "plain text only", 7: "\n".join(["long words"] * 3_000), 8: "unclosed & x", 9: ""}
    assert got == sorted((i or -1, want[i], len(want[i]), u) for i, u, _, _ in rows)
    assert H.extract_articles(pages.limit(0)).count() == 0


def test_large_wrappers_are_joined(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_CHARS", -1)
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example/", f"<article><p>t{i}</p></article>") for i in range(20)], "page_id long, url string, html string")
    assert {r.text for r in H.extract_articles(pages).collect()} == {f"t{i}" for i in range(20)}


def test_pages_of_a_host_without_main_element_keep_their_text(spark):
    menu = "<div class='main-menu'>Menu</div>"
    rows = [(1, "http://a.example/1", f"{menu}<div class=content><p>one</p></div>"), (2, "http://a.example/2", "<p>out</p><article><p>two</p></article>"), (3, None, "<p>three</p>"), (4, None, "<main>four</main>"),
            (5, "http://b.example/", f"{menu}<div class=content><p>five</p></div>"), (6, "http://b.example/6", "<aside><article>teaser</article></aside><p>six</p><article> </article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract_articles(pages).collect()} == {1: "one", 2: "two", 3: "three", 4: "four", 5: "five", 6: "six"}


TEXT = "The market moved again today, and nobody could say why it did so. " * 5


def test_no_name_drops_what_is_nearly_all_of_the_article():
    page = f"<body><nav>n</nav><article><h1>T</h1><div class='editor-comment'><p>{TEXT}</p><p>{TEXT}</p></div><p>End.</p></article></body>"
    assert alone(page) == f"T\n{TEXT.strip()}\n{TEXT.strip()}\nEnd."
    page = f"<article><p>{TEXT}</p><div class=comments><div class=comment>{TEXT}</div><div class=comment>{TEXT}</div></div></article>"
    assert alone(page) == TEXT.strip()


def test_a_menu_of_dishes_is_text():
    dishes = "".join(f"<li>Dish {i} with sauce</li>" for i in range(8))
    page = f"<body><div class=menu><a href=/>Home</a> <a href=/x>News</a></div><article><h1>Eat</h1><p>We went there.</p><ul class=menu>{dishes}</ul><p>Good.</p><div class='page-menu'><a href=/1>One</a> <a href=/2>Two</a></div></article></body>"
    assert alone(page) == "\n".join(["Eat", "We went there.", *[f"Dish {i} with sauce" for i in range(8)], "Good."])


def test_linked_sources_in_the_article_stay(spark):
    def page(i):
        sources = "".join(f"<li><a href=/{i}/{k}>Source {i} {k} of the matter</a></li>" for k in range(4))
        links = "".join(f"<li><a href=/m{k}>Page {k} {i}</a></li>" for k in range(9))
        return f"<body><div><ul>{links}</ul></div><div class=text><h1>Title {i}</h1><p>{TEXT} {i}</p><ul>{sources}</ul></div></body>"

    want = {i: "\n".join([f"Title {i}", f"{TEXT} {i}".replace("  ", " "), *[f"Source {i} {k} of the matter" for k in range(4)]]) for i in range(5)}
    assert {i: alone(page(i)) for i in range(5)} == want
    pages = spark.createDataFrame([(i, "http://a.example/", page(i)) for i in range(5)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in H.extract_articles(pages).collect()} == want


def test_what_is_set_aside_is_so_at_any_depth():
    for depth in (5, 10, 70, 200, 3000):
        inner = f"<nav>menu</nav><p>{TEXT}</p><footer>end</footer><div><form>fill in</form><div class=comments><p>First!</p></div>tail</div>"
        page = "<body><article>" + "<div>" * depth + inner + "</div>" * depth + "</article></body>"
        assert alone(page) == f"{TEXT.strip()}\ntail", depth


def test_time_grows_with_the_page():
    import time

    names = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "address", "ul"]

    def page(n, seed):
        draw = random.Random(seed)
        return "<body>" + "".join(f"<{x}>text {i} more</{x}>" for i, x in enumerate(draw.choices(names, k=n))) + "</body>"

    big = page(40_000, 1)
    assert len(big) > 900_000
    began = time.time()
    stream, pieces = H.parse(big)
    took = time.time() - began
    assert took < 10 and len([p for p in pieces if p[1] is not None]) == 40_000
    other = H.wrapper_of(H.parse(page(40_000, 2))[0])
    began = time.time()
    wrapper = H.align(H.wrapper_of(stream), other, H._over_pages)
    assert time.time() - began < 60
    kinds = lambda items: sum(kinds(x[-1]) if x[0] != "#" else 1 for x in items)
    assert kinds(wrapper) >= kinds(other)
    began = time.time()
    assert len(alone("<div>" * 100_000 + "text").split("\n")) == 1 and time.time() - began < 20


def test_cut_alignments_keep_every_item_in_order(monkeypatch):
    monkeypatch.setattr(H, "CELLS", 30)
    draw = random.Random(3)
    for _ in range(200):
        a, b = ([["e", draw.choice("pqrstuv"), [["#"]]] for _ in range(draw.randrange(60))] for _ in range(2))
        found = H.pairs(a, b)
        assert [x for x, _ in found if x] == a and [y for _, y in found if y] == b
        assert all(x[1] == y[1] for x, y in found if x and y)


def test_folded_groups_of_any_size():
    draw = random.Random(5)
    for _ in range(60):
        names = draw.sample("abcdefghijklmnopqrstuvwxyz", draw.randrange(2, 9))
        row = "".join(f"<h1 class={n * 3}>x</h1>" for n in names)
        times = draw.randrange(2, 6)
        stream = bare(H.parse("<p>0</p>" + row * times + "end")[0])
        assert stream == [["e", "p", ["#"]], ["+", [["e", f"h1.{n * 3}", ["#"]] for n in names]], "#"]


def test_sites_whose_articles_have_marked_classes(spark):
    """Names that are listed, on the elements that hold the articles of whole hosts."""
    rows, want = [], {}
    for seed, name in enumerate(["comment", "menu", "sidebar", "newsletter", "ads", "related", "search", "notice", "header"]):
        pages, articles = site(100 + seed, f"m{seed}.example", 6)
        for page, text in zip(pages, articles):
            want[len(rows)] = text
            rows.append((len(rows), f"https://m{seed}.example/{len(rows)}", page.replace("<div><h1>", f"<div class='{name}'><h1>")))
    got = {r.page_id: r.text for r in H.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
