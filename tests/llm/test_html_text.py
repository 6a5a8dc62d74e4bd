import random

import pytest

from patchlight.llm import html_text
from patchlight.llm import wrappers as wr
from patchlight.llm.html_blocks import read_page
from patchlight.llm.html_text import main_text

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}


def blocks(html):
    return [t for _, t, _ in read_page(html).blocks]


def test_blocks_are_read_as_browsers_read_them():
    assert blocks("<p><b>One<br>two<p>three</b> four</p>five<div>six</div>") == ["One two", "three four", "five", "six"]
    assert blocks('<p title="a>b">x</p><!-- <p>no</p> --><p>y<!-- open') == ["x", "y"]
    assert blocks('<script>var t="</p>";</script><style>p{}</style><title>t</title>a<SCRIPT>b</SCRIPT >c') == ["ac"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert blocks("<table><tr><td>a<td>b<tr><th>c</table>d") == ["a", "b", "c", "d"]
    assert blocks("&lt;p&gt; &amp;amp; &#233;&#x1F600; &am &amp x&nbsp; y") == ["<p> &amp; é\U0001f600 &am & x y"]
    assert blocks("a < b and </ c><p>1<2</p><p cut='") == ["a < b and", "1<2"]
    assert blocks("<h1>t<h2>u</h2></div></p>v<textarea><p>w</textarea>x<svg><text>no</text></svg>") == ["t", "u", "vx", "no"]
    assert blocks("") == blocks(" \n ") == [] and blocks("plain") == ["plain"]
    assert len(blocks("<div>" * 5000 + "deep" + "</div>" * 10)) == 1 and len(blocks("<p>x</q>" * 3000)) == 3000


def test_nodes_share_what_repeats_and_name_their_part():
    page = read_page('<body><div class="post-12"><p>a<p>b<div class=AdBox>c</div><p>d</div><div id="user_comments">e</div><div style="display: none">f</div>')
    named = dict(zip(page.labels, page.parts, strict=True))
    assert named["div.post-0"] == "content" and named["div.AdBox"] == "ad" and named["div#user_comments"] == "comments" and named["div"] == "hidden"
    assert page.labels.count("p") == 1


def brute_matched(a, b):
    """The most nodes that correspond, by trying every way to match children in order."""
    if not wr._same(a, b):
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), brute_matched(x[0], y[0]) + best(x[1:], y[1:]) if wr._same(x[0], y[0]) else 0)

    return 1 + best(a.children, b.children)


def test_tree_matching_matches_brute_force():
    rng = random.Random(2)

    def grown(depth):
        return wr.Node(rng.choice("ab"), "", 1, children=[grown(depth - 1) for _ in range(rng.randrange(4 if depth else 1))])

    for _ in range(200):
        a, b = grown(3), grown(3)
        b.label = a.label
        want, n, m = brute_matched(a, b), len(list(a.walk())), len(list(b.walk()))
        assert wr.matched(a, b, {}) == want and len(wr.aligned(a, b)) == want
        assert wr.dumped(wr.loaded(wr.dumped(a))) == wr.dumped(a)
        assert len(list(wr.merge(a, b).walk())) == n + m - want


def test_a_wrapper_keeps_the_rare_nodes_of_many_pages():
    rng = random.Random(5)

    def page(k):
        # Many nodes of its own beside what all pages have, and a header that holds the article and so is no frame.
        kids = [wr.Node(f"div.own{k}x{rng.choice('abcdef')}{j}", "", 1) for j in range(40)]
        return wr.Node("body", "", 1, children=[wr.Node(f"div.top{k}", "frame", 1, children=[wr.Node("article", "article", 1, 90, 0, 1, k, k), *kids]), wr.Node("p", "", 1, 5, 0, 1, k, k)])

    pages = [page(k) for k in range(420)]
    copies = [wr.loaded(wr.dumped(x)) for x in pages]
    wrapper = pages[0]
    for other in pages[1:]:
        wr.merge(wrapper, other)
    assert len(list(wrapper.walk())) == 2 + 420 * 42
    for tree in copies[::60]:
        nodes = list(tree.walk())
        assert len(wr.aligned(wrapper, tree)) == len(nodes)
        assert len(wr.content(wrapper, wr.template(wrapper, True), tree, nodes)) == len(nodes)


def site(k, rng, *, article=True):
    """A page with all that isn't its text, and the text."""
    say = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    title, paragraphs, points = say(5), [say(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 6))], [say(4) for _ in range(rng.randrange(3))]
    body = f"<h1>{title}</h1>" + "".join(f"<p>{p} <a href=x>more</a> &amp; so on.</p>" for p in paragraphs[:2]) + (f"<ul>{''.join(f'<li>{x}' for x in points)}</ul>" if points else "") + "".join(f"<p>{p}" for p in paragraphs[2:])
    noise = f"<div class='cookie-notice'>We use cookies {k}</div>" if k % 3 else ""
    inner = f"<div class=promo><p>Buy {say(3)}</p></div>" if k % 2 else ""
    main = f"<article class='post-{k}'>{body}{inner}<p>Read it all at our site.</p><section class='comments'><p>{say(9)}</p></section></article>" if article else f"<div class='x{k}'>{body}</div><div class=comments><p>{say(8)}</p></div>"
    html = (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body class='has-sidebar'>{noise}<header><a href=/>Home of {k}</a></header>"
        f"<nav><ul>{''.join(f'<li><a href=/{j}>{say(1)}</a>' for j in range(4))}</ul></nav><div class=strap>Every day since 1990</div>{main}"
        f"<aside><p>{say(6)}</p></aside><form><label>Name</label><input><button>Go</button></form><footer>&copy; {say(4)}</footer><script>x='<p>'</script>"
    )
    text = "\n".join([title, *(f"{p} more & so on." for p in paragraphs[:2]), *points, *paragraphs[2:]])
    return html, text


@pytest.mark.parametrize("joined", [False, True])
def test_sites_give_their_articles(spark, monkeypatch, joined):
    if joined:  # as if too much were learned to be broadcast; many rounds of few trees
        monkeypatch.setattr(html_text, "FEW_BYTES", -1)
        monkeypatch.setattr(html_text, "TREES", 3)
    rng = random.Random(4)
    rows, want = [], {}
    for k in range(120):
        html, want[k] = site(k, rng, article=k % 4 != 3)
        rows.append((k, f"https://{'abcd'[k % 4]}.example.com/{k}", html))
    html, want[500] = site(500, rng)
    # A host of one page learns nothing, so what only repetition shows stays.
    rows.append((500, "http://alone.example.org", html))
    want[500] += "\nRead it all at our site."
    # Copies of one page are one page.
    for k in range(600, 640):
        rows.append((k, "http://copies.example.org", "<body><article><h1>T</h1><p>Same text here.</p></article>"))
        want[k] = "T\nSame text here."
    assert texts(spark, rows) == want


def test_titles_stand_in_or_just_before_the_main_part(spark):
    pages = {
        1: ("<body><h1>Site</h1><main><h1>Title</h1><article><p>Text.</p></article></main><h1>After</h1>", "Title\nText."),
        2: ("<body><h1 class=post-title>Title</h1><div class=sidebar><h1>Side</h1></div><div id=content><p>Text.</p></div>", "Title\nText."),
        3: ("<body><h1>Site</h1><article><header><h1>Title</h1><p>By me</p></header><p>Text.</p><footer>Tags</footer></article>", "Title\nBy me\nText."),
        4: ("<body><header><h1>Site</h1></header><div class=content><h1>Title</h1><p class=notice>Look</p><p>Text.</p></div>", "Title\nText."),
    }
    assert texts(spark, [(k, f"http://h{k}.org", h) for k, (h, _) in pages.items()]) == {k: t for k, (_, t) in pages.items()}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "nowhere", "<p>a</p>"), (4, "http://x", "\x00<p>\x01b"), (None, "http://x", "<article><p>c"), (5, "http://x", "<p>" + "long " * 100_000), (5, "http://x", "<p>" + "long " * 100_000), (6, "http://y", "<div>" * 3000 + "deep")]
    frame = spark.createDataFrame([(*r, "mine", "host", 7) for r in rows], f"{SCHEMA}, text string, host string, shape int")
    got = main_text(frame)
    assert got.columns == ["page_id", "url", "host", "shape", "text", "n_chars"] and got.count() == len(rows)
    by = {r["page_id"]: r for r in got.collect()}
    assert by[1]["text"] == by[2]["text"] == "" and by[3]["text"] == "a" and by[None]["text"] == "c" and by[6]["text"] == "deep" and by[5]["n_chars"] == 499_999
    assert all(r["n_chars"] == len(r["text"]) for r in by.values())
    assert main_text(frame.limit(0)).count() == 0
