import random

from corvid.llm.decontaminate import Matcher, drop_contaminated, item_blocks, matches, myers, normal
from corvid.llm import html_extract
from corvid.llm.html_extract import body_text, extract, match, parse
from tests.llm.cases import frame


def distance(p, t):
    """Least edit distance of p to a substring of t, by the plain table."""
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(2)
    for _ in range(400):
        p = "".join(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        masks = {}
        for k, c in enumerate(p):
            masks[c] = masks.get(c, 0) | 1 << k
        want = distance(p, t)
        got, _ = myers(masks, len(p), t, len(p))
        assert min(got, len(p)) == want


def test_matcher_against_table():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(20)]
    m = Matcher(items, 12)
    for _ in range(60):
        body = [word() for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.7:
            piece = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 10)):
                piece[rng.randrange(len(piece))] = rng.choice("xyz ")
            body.insert(rng.randint(0, len(body)), "".join(piece))
        text = " ".join(body)
        got = {(i, d) for i, d, _, _ in m.find(text)}
        want = {(i, d) for i, t in items if (d := distance(normal(t), normal(text))) <= len(t) // 12}
        assert got == want


def test_tables(spark):
    bench = spark.createDataFrame([(1, "The quick, brown fox jumps over the lazy dog again"), (2, None), (3, "..."), (1, "zzz yyy")], "item_id long, text string")
    rows = [(1, "say: the QUICK brown fox\njumps over the lazy dog again!", "en", "s", 1, 1, ""), (2, "the quick brown fox", "en", "s", 1, 1, ""), (3, None, None, None, None, 1, ""), (3, "a zzz yyy b zzz", None, None, None, 1, "")]
    docs = frame(spark, rows)
    assert sorted((r.doc_id, r.item_id, r.distance) for r in matches(docs, bench).collect()) == [(1, 1, 0), (3, 1, 0)]
    assert sorted((r.doc_id, r.text) for r in drop_contaminated(docs, bench).collect()) == [(2, "the quick brown fox"), (3, None)]
    assert len(list(item_blocks(bench, 9))) == 3
    assert matches(docs, bench.limit(0)).count() == 0 and matches(docs.limit(0), bench).count() == 0


def test_many_blocks_of_items_give_what_one_gives(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6)))
    items = [(k, " ".join(word() for _ in range(15))) for k in range(12)]
    texts = [" ".join([word(), rng.choice(items)[1].replace("a", "x", rng.randint(0, 2)), word() * 2]) if rng.random() < 0.6 else " ".join(word() for _ in range(20)) for _ in range(40)]
    docs = frame(spark, [(k, t, "en", "s", 1, 1, "") for k, t in enumerate([*texts, None, "", "long " * 60_000 + items[3][1]])] + [(None, items[0][1], None, None, None, 1, ""), (3, "free", None, None, None, 1, "")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, matches(docs, bench, limit=n).collect())) for n in (1 << 20, 200))
    assert one == many and len(one) > 10
    one, many = (sorted(map(str, drop_contaminated(docs, bench, limit=n).collect())) for n in (1 << 20, 200))
    assert one == many and 2 < len(one) < 43


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li>menu</li></ul></nav>
<div class="ad">buy</div><article><header><h1>Head &amp; line</h1></header><p><b>One<br>two  three<br><p>Four<div class="comments"><p>me too</p></div></article>
<div id="site-footer">foot</div></body></html>"""


def test_body():
    assert body_text(PAGE) == "Head & line\n\nOne two three\n\nFour"
    assert body_text("") == "" and body_text("<<<") == "<<<" and body_text("<p>a<p>b") == "a\n\nb"
    assert body_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert body_text("plain <i>te</i>xt &lt;b&gt;<script>var t='</p>'</script>") == "plain text <b>"


def test_match_is_largest():
    a, b = parse("<div><p>1</p><ul><li>2</li></ul><p>3</p></div>"), parse("<div><ul><li>2</li></ul><p>3</p><p>4</p></div>")
    assert len(match(a, b)) == 5  # root, div, ul, li, p
    a, b = parse("<div><i>1</i></div><div><p>2</p><p>3</p><p>4</p></div>"), parse("<div><p>2</p><p>3</p><p>4</p></div>")
    assert len(match(a, b)) == len(match(b, a)) == 5  # a div in front costs nothing


def largest(a, b):
    """Pairs of the largest mapping, by the textbook recursion."""
    left, right = a.children(), b.children()
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (largest(x, y) if x.tag == y.tag else 0))
    return 1 + best[-1][-1]


def test_match_against_recursion(monkeypatch):
    rng = random.Random(6)

    def tree(depth):
        return "".join(f"<{t}>{tree(depth - 1) if rng.random() < 0.7 else 'x'}</{t}>" for t in (rng.choice(["div", "b", "i"]) for _ in range(rng.randint(0, 4)))) if depth else ""

    for cells in (html_extract.CELLS, 2):
        monkeypatch.setattr(html_extract, "CELLS", cells)
        for _ in range(150):
            a, b = parse(tree(4)), parse(tree(4))
            pairs = match(a, b)
            assert len(pairs) == largest(a, b)
            assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs)
            to = {id(x): y for x, y in pairs}
            at = lambda n: [id(c) for c in n.children()]
            for x, y in pairs:  # parents with parents, in order
                assert x.tag == y.tag and (x.up is None or to[id(x.up)] is y.up)
                order = [at(y).index(id(to[c])) for c in at(x) if c in to]
                assert order == sorted(order)


def test_match_of_deep_and_wide_trees():
    a, b = parse("<div>" * 4000 + "<p>x"), parse("<div>" * 4000 + "<b>x")
    assert len(match(a, b)) == 4001
    wide = lambda tags: parse("".join(f"<{t}>1</{t}>" for t in tags))
    a, b = wide(["p", "b"] * 900), wide(["b", "p"] * 900)
    assert len(match(a, b)) == 1800


def test_what_browsers_read_and_what_names_furniture():
    body = lambda x: body_text(f"<body><article>{x}</article></body>")
    assert body('One <a href="x" title="5" tall">link</a> and <b>') == "One link and"
    assert body("It<a href='x>y") == "It" and body("a < b <!-- c --!> d </> e") == "a < b d e"
    assert body_text('<article>Main<article class="comment">reader</article></article><article class="related">more</article>') == "Main"
    assert body('<h1 class="article-header">Title</h1><p class="share-price">Up 3</p><div class="side">by side</div><label>name</label>') == "Title\n\nUp 3\n\nby side\n\nname"
    for name in "comments reader-comments share-buttons advert site-header ad-slot cookie-banner relatedPosts newsletter-signup post-comments sidebar".split():
        assert body(f"<p>text</p><div class='x {name}'>no</div>") == "text", name
        assert body(f"<p>text</p><div id={name}>no</div>") == "text", name
    for name in "article-header post-header header story-body noticeable comment-free menu-del-dia".split():
        assert body(f"<div class='{name}'>yes</div>") == "yes", name
    assert body_text("<header>site</header><div class='page-header'>top</div><p>text</p><p hidden>no</p><div role=navigation>no</div>") == "text"


def test_a_class_word_alone_takes_no_article_text():
    text = "<p>the first words of this article</p>"
    for part in ("<section class='discussion'><p>more</p></section>", "<section id='related'><p>more</p></section>", "<p class='notice'>more</p>", "<div class='alert-text'>more</div>", "<ol class='menu'><li>more</ol>"):
        assert body_text(f"<article>{text}{part}</article>") == "the first words of this article\n\nmore"
        linked = part.replace("more", "<a href='x'>more</a>")
        assert body_text(f"<article>{text}{linked}</article>") == "the first words of this article"
    assert body_text("<article class='post responses'><p>all</p></article>") == body_text("<article><div class='sidebar'>all</div></article>") == "all"
    assert body_text("<main><article>A1</article><p>between</p><article>A2</article><nav>no</nav></main>") == "A1\n\nbetween\n\nA2"
    assert body_text("<main><article>A1</article><article class='comment'>no</article></main><article class='related'>no</article>") == "A1"


def _texts(spark, pages):
    out = extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(out) == len(pages)
    return {r.page_id: r.text for r in out}


def test_wrapper_decides_inside_articles(spark):
    """Without the wrapper the constant lines would be part of each text."""
    page = "<html><body><article><h1>Title {0}</h1><p>First of {0}, with words</p><p>Thank you for reading</p><p>More {0}<b>Save this</b></p>{1}</article></body></html>"
    pages = [(k, f"http://a.example/{k}", page.format(f"n{k}", f"<ul><li>e{k}</li></ul>" * (k % 3))) for k in range(30)]
    got = _texts(spark, pages)
    for k, _, html in pages:
        assert "Thank you for reading" in body_text(html) and "Save this" in body_text(html)
        assert got[k] == "\n\n".join([f"Title n{k}", f"First of n{k}, with words", f"More n{k}", *[f"e{k}"] * (k % 3)])
    # one page of a host has no template, and neither have copies of one article
    copy = [(k, f"http://b.example/{k}", pages[0][2]) for k in range(20)] + [(50, "http://c.example/", pages[1][2])]
    assert all(t == body_text(html) for (k, _, html), t in zip(copy, (_texts(spark, copy)[k] for k, *_ in copy)))


def test_layouts_of_a_host_have_their_own_exemplars(spark):
    one = "<body><article><p>Start of series one</p><p>Own words of {0}</p></article></body>"
    two = "<body><main><table><tr><td>Facts and figures</td></tr><tr><td>Value {0} here</td></tr></table></main></body>"
    three = "<body><section><h1>Heading {0}</h1><ol><li>Our usual list</li><li>entry {0}</li></ol></section></body>"
    got = _texts(spark, [(k, f"http://a.example/{k}", (one, two, three)[k % 3].format(f"n{k}")) for k in range(45)])
    classes = {0: ("Own words of n{0}",), 1: ("Value n{0} here",), 2: ("Heading n{0}", "entry n{0}")}
    assert sum(got[k] == "\n\n".join(classes[k % 3]).format(k) for k in got) >= 30  # layouts may share a class by their hash


def test_repeated_and_tied_pages(spark):
    page = lambda k: f"<div><p>Welcome to our site</p><p>story {k} with its own words</p></div>"
    rows = [(1, "http://h.example/1", page(k)) for k in range(8)] + [(1, "http://h.example/1", page(3))] * 3
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in out) == sorted(f"story {k} with its own words" for k in [*range(8), 3, 3, 3])
    long = "<article><p>" + "word " * 300_000 + "</p></article>"
    assert _texts(spark, [(1, "http://x.example", long), (2, "http://x.example", long)])[1] == ("word " * 300_000).strip()


def test_wrapper_drops_what_is_constant(spark):
    page = lambda k: f"<div><p>Welcome to our site</p><p>story {k} with its own words</p></div><div>All rights</div>"
    rows = [(k, f"http://h.example/{k}", page(k), "x") for k in range(12)] + [(20, "http://other.example/", page(3), "x"), (21, None, None, "x"), (22, "bad", "", "x"), (3, "http://h.example/3", page(3), "x")]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(out) == len(rows)
    texts = {(r.page_id, r.url): r.text for r in out}
    assert texts[3, "http://h.example/3"] == "story 3 with its own words"
    assert texts[20, "http://other.example/"] == "Welcome to our site\n\nstory 3 with its own words\n\nAll rights"
    assert texts[21, None] == "" and all(r.n_chars == len(r.text) for r in out)
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_empty_page_is_no_exemplar(spark):
    page = "<html><body><div><p>Home and contact</p></div><div><p>Text number {0} of its own</p></div></body></html>"
    rows = [(None, "http://a.b/0", None), (0, "http://a.b/x", ""), (1, "http://a.b/y", "<html><body></body></html>")]
    rows += [(k, f"http://a.b/{k}", page.format(k)) for k in range(2, 12)]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).where("page_id > 1").collect()
    assert sorted(r.text for r in out) == sorted(f"Text number {k} of its own" for k in range(2, 12))
