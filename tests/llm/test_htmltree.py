import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from concordat.llm import htmltree

ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div id="cookie-notice">We use cookies</div>
<main><article class="post"><header><h1>Head &amp; line</h1></header><p>One <b>bold</b>&nbsp;two<br>three
four.</p><p>Unclosed <b>bold<p>Next &lt;tag&gt; &copy; &amp x &#233; &unknown;</p><aside>Side</aside><div class="ad-slot">Buy</div>
<form>Name <input></form><ul><li>a<li>b</ul><!-- hidden <p>x</p> --><div class="share-bar">Share</div><blockquote>Quote</blockquote>
<noscript>no</noscript><table><tr><td>1<td>2</table><section id="comments"><p>Nice!</p></section><footer>By me</footer></article></main>
<article class="comment"><p>A reader</p></article><div class="sidebar"><article>Other</article></div><footer>&copy; me</footer></body></html>"""


def test_article_without_the_rest():
    assert htmltree.main_text(ARTICLE) == "Head & line One bold two three four. Unclosed bold Next <tag> © & x é &unknown; a b Quote 1 2"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain & simple < 3", "plain & simple < 3"),
        ("<article>", ""),
        ("<article><p>cut of", "cut of"),
        ("<article><p>a</p><p class='x", "a"),
        ("<article><p>a<!-- never ends", "a"),
        ("<article>a<script>b", "a"),
        ("<div role=main>in<div role='navigation'>no</div></div>out", "in"),
        ('<article><a title="a>b">link</a> <p>x', "link x"),
        ("<p>x<p>y</p></p>z<div>w</div>v", "x y z w v"),
        ("<ARTICLE><P>Big</P></ARTICLE><NAV>n</NAV>", "Big"),
        ("<article>a<div hidden>b</div>  c</article>", "a b c"),
        ("<body><div class=comments>c</div><p>only</p><footer>f</footer>", "only"),
        ("<article>one</article><article>two</article>", "one two"),
        ("""<article><p>A <a title="Bob's">x</a> tail</p></article>""", "A x tail"),
        ("""<article><p>A <a title="Bob's">x</a> don't <b>go</b> on</p><p>isn't it</p></article>""", "A x don't go on isn't it"),
        ("""<article><a title='say "hi>'>x</a> y</article>""", "x y"),
        ('<article><div data-x="' + "<b>t</b>" * 20 + '">in</div> out</article>', "in out"),
        ("<article><a title=Bob's>x</a> <a b' c>y</a> z", "x y z"),
        ("<article>a <b title='x>never closed", "a"),
        ("<article>" + "<div>" * 5000 + "deep", "deep"),
        ("<article>" + "word " * 200_000, ("word " * 200_000).strip()),
    ],
)
def test_odd_pages(page, text):
    assert htmltree.main_text(page) == text
    htmltree.style_nodes(page)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("<>/!-?\"'= abp&;#&lt"), max_size=60), st.sampled_from(["", "<article>", "<div class=", "<!--", "<script>"]))
def test_any_text_is_taken(noise, start):
    htmltree.main_text(start + noise)
    htmltree.style_nodes(start + noise)


def site(rng, i, words):
    """A page that declares nothing: the same frame, a text of its own."""
    body = "".join(f"<p>{' '.join(rng.choices(words, k=12))}</p>" for _ in range(3))
    return f"<html><body><div><a href=/>Home</a><a href=/n>News</a></div><div>{body}</div><div><span>All rights of this house</span></div></body></html>"


def test_style_tree_removes_the_frame_and_keeps_the_texts(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, f"http://host.example/{i}", site(rng, i, words)) for i in range(12)]
    rows += [(100, "http://lone.example/1", site(rng, 0, words)), (101, None, None), (102, "not a url", ""), (3, rows[3][1], rows[3][2])]
    rows += [(200 + i, f"http://copies.example/{i}", f"<article><h1>The same syndicated text</h1><div class=x1>Share it</div><p>again{'.' * (i % 2)}</p></article>") for i in range(9)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, text string, number int")
    got = sorted((tuple(r) for r in htmltree.extract(df).collect()), key=repr)
    assert len(got) == len(rows)
    by_id = {r[0]: r[2] for r in got}
    for i in range(12):
        paragraphs = [p.split("</p>")[0] for p in rows[i][2].split("<p>")[1:]]
        assert by_id[i] == " ".join(paragraphs)
    assert by_id[100].startswith("HomeNews") and by_id[100].endswith("All rights of this house")  # one page shows no frame
    assert by_id[101] == by_id[102] == ""
    assert by_id[200] == "The same syndicated text Share it again"  # one story shows no frame
    assert all(r[3] == len(r[2]) for r in got)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmltree.extract(df).count() == 0


def test_importance_formulas(spark):
    rows = [(7, 1, 1, i) for i in range(4)] + [(8, i, 1, i) for i in range(4)] + [(9, i % 2, 0, i) for i in range(4)] + [(10, 1, 1, 1)] + [(11, 1, 1, 5)] * 4
    df = spark.createDataFrame(rows, "node long, feature long, leaf int, story int")
    got = {r.node: round(r.importance, 6) for r in htmltree.importances(df).collect()}
    assert got == {7: 0.0, 9: 0.5}


def plain_tree(rows):
    """The whole method, written plainly: texts by row, and how many branches the tree removes."""
    stories = {}
    parsed = {}
    for k, (_, url, page) in enumerate(rows):
        root, nodes = htmltree.parse(page or "")
        parsed[k] = root, nodes
        heads = [t for tag in ("h1", "h2", "title") for n in nodes if n.tag == tag and (t := htmltree.main_text(page) and "".join(x for x in n.parts if isinstance(x, str)).strip())]
        story = heads[0] if heads else page
        host = (url or "").split("/")[2] if "//" in (url or "") else ""

        def walk(node, path, host=host, story=story):
            for place, child in enumerate(node.children):
                if child.noise == 1:
                    continue
                own = (*path, tuple(x.label for x in node.children), place)
                text = " ".join("".join(x for x in child.parts if isinstance(x, str)).split())
                leaf = bool(text) or not child.children
                feature = (child.label, text) if leaf else tuple(x.label for x in child.children)
                stories.setdefault((host, own), {}).setdefault((leaf, feature), set()).add(story)
                child.path = own
                walk(child, own)

        walk(root, ())

    def importance(host, path):
        features = stories[host, path]
        counts = [len(x) for x in features.values()]
        m = sum(counts)
        if m < htmltree.LEAST_STORIES:
            return 1.0
        if any(leaf for leaf, _ in features):
            return 1 - sum(math.log(c, m) for c in counts) / len(counts)
        return sum(-c / m * math.log(c / m, m) for c in counts)

    out, removed = [], 0
    for k, (_, url, page) in enumerate(rows):
        root, nodes = parsed[k]
        host = (url or "").split("/")[2] if "//" in (url or "") else ""
        main = htmltree._main_parts(nodes)
        gone = set()

        def composite(node, host=host, main=main, gone=gone):
            inside, up = False, node
            while up is not None:
                inside, up = inside or any(up is x for x in main), up.parent
            below = [c for c in node.children if c.noise != 1]
            parts = [composite(c) for c in below]
            c = importance(host, node.path)
            if below:
                w = htmltree.GAMMA ** len(below)
                c = (1 - w) * c + w * sum(parts) / len(below)
            if c < 1 - htmltree.prior(node, inside) - 1e-9 and all(id(x) in gone for x in below):
                gone.add(id(node))
            return c

        for child in root.children:
            if child.noise != 1:
                composite(child)
        text = []
        for part in main or [root]:
            htmltree._collect(part, not main, gone, text)
            text.append(" ")
        out.append(" ".join("".join(text).split()))
        removed += len(gone)
    return out, removed


def test_whole_method_against_a_plain_tree(spark, monkeypatch):
    plain = type("Plain", (htmltree.Node,), {})  # takes further attributes
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows, wanted = [], []
    for i in range(60):
        head, paragraphs = f"Story {i // 2 if i % 5 == 0 else i} {prose(3)}", [prose(15) for _ in range(2 + i % 2)]
        frame = ["<div><a href=/>Home</a><a href=/n>News</a></div>", "<div>Edition of today</div>"]
        inside = ["<div><a>Back</a><a>On</a></div>", "<p>Do subscribe to our letter</p>", "<div class='share-price'>" + prose(4) + "</div>"]
        body = f"<h1>{head}</h1><p>{paragraphs[0]}</p>{inside[0]}" + "".join(f"<p>{p}</p>" for p in paragraphs[1:]) + inside[1] + (inside[2] if i % 3 == 0 else "")
        page = f"<html><body>{frame[0]}<article>{body}</article>{frame[1]}</body></html>" if i % 2 else f"<html><body>{frame[0]}<div>{body}</div>{frame[1]}</body></html>"
        rows.append((i, f"http://h{i % 2}.example/{i}", page))
        wanted.append(" ".join([head, *paragraphs]))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltree.extract(df).collect()}
    alone = {i: htmltree.main_text(page) for i, _, page in rows}
    monkeypatch.setattr(htmltree, "Node", plain)
    expected, removed = plain_tree(rows)
    assert [got[i] for i in range(60)] == expected and removed > 60
    assert sum(got[i] != alone[i] for i in range(60)) == 60  # the tree changes each of these pages
    # Whole texts are kept; of the noise only what the tree cannot know stays.
    for i in range(60):
        assert all(part in got[i] for part in wanted[i].split(" Story "))
        assert "Home" not in got[i] and "Edition" not in got[i] and "Back" not in got[i]


def test_doubtful_words_do_not_decide_alone():
    for name in ("share-price", "related-work", "form-of-address"):
        assert htmltree.main_text(f"<article><p>a</p><div class={name}>kept</div></article>") == "a kept"
    for name in ("share-bar", "site-footer", "comment-list", "ad", "cookie-notice", "mainNav"):
        assert htmltree.main_text(f"<article><p>a</p><div class={name}>gone</div></article>") == "a"


def test_line_breaks_and_images_do_not_take_text_with_them(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div>Text {i} of its own<br><img src=a></div><div>Same here</div><div>More {i}<span></span><hr></div></body>") for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltree.extract(df).collect()}
    assert got == {i: f"Text {i} of its own More {i}" for i in range(6)}
