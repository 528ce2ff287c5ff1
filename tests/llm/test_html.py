import random
import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pytest

from seqloom.llm import html


def text(page):
    return html.main_text(page)[0]


def test_tree_learns_its_table():
    for page, marks in html.LABELLED:
        for scale in html.SCALES:
            rows = html.blocks(html.labelled(page, scale))[1]
            assert html.keep(rows).tolist() == [c == "+" for c in marks], (page, html.tree())


def test_text_features_decide_where_markup_does_not():
    """Without words, links and neighbours the table of pages without telling markup cannot be learned."""
    found = set()

    def walk(node):
        if isinstance(node, tuple):
            found.add(html.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(html.tree())
    assert {"words", "links", "before_links", "after_links"} <= found and len(found & {"before_words", "after_words", "near"}) >= 2
    for page, marks in html.PLAIN:
        assert not html.blocks(html.labelled(page, 1))[1][:, html.FEATURES.index("inside") :].any() and marks


class Slow(HTMLParser):
    """Blocks by a parsed tree and their ancestors, for well-formed pages; the features follow from the lists."""

    def __init__(self, page):
        super().__init__()
        self.open, self.found, self.now, self.links = [], [], [], 0
        self.feed(page)
        self.close()
        self.cut()

    def cut(self):
        words = " ".join(x for x, _ in self.now).split()
        if words:
            self.found.append((len(words), sum(len(x.split()) for x, link in self.now if link) / len(words), list(self.above), " ".join(words)))
        self.now = []

    @property
    def above(self):
        return [(t, dict(a)) for t, a in self.open]

    def handle_starttag(self, tag, attrs):
        if tag in html.BLOCK:
            self.cut()
        self.open.append((tag, attrs))

    def handle_endtag(self, tag):
        if tag in html.BLOCK:
            self.cut()
        self.open.pop()

    def handle_data(self, data):
        self.now.append((data, any(t == "a" for t, _ in self.open)))

    def rows(self):
        out = []
        marks = []
        for words, links, above, _ in self.found:
            names = [html.signs(" ".join(f'{k}="{v}"' for k, v in a.items()))[0] * (t not in ("body", "article", "main")) for t, a in above]
            tags = [t for t, _ in above]
            beside = any(t in html.BESIDE or (t == "header" and not {"article", "main"} & set(tags[:i])) for i, t in enumerate(tags))
            around = [t for t in tags if t in html.BLOCK]
            heading = any(t in ("h1", "h2", "h3") for t in tags)
            marks.append((heading, heading or bool(around) and around[-1] in ("p", "pre", "li", "blockquote", "dd", "dt"), -1 if -1 in names else max(names, default=0), bool({"article", "main"} & set(tags)), beside))
        for i, (words, links, _, _) in enumerate(self.found):
            at = lambda k: self.found[k][:2] if 0 <= k < len(self.found) else (0, 0)  # noqa: B023, E731
            near = max([w for w, share in (at(i + k) for k in (-2, -1, 1, 2)) if share <= 1 / 3], default=0)
            most = lambda found: max([w for w, share, *_ in found if share <= 1 / 3], default=0)
            out.append((words, links, *at(i - 1), *at(i + 1), near, most(self.found[:i]), most(self.found[i + 1 :]), *map(float, marks[i]), float(any(m[3] for m in marks))))
        return out


def decide(node, row):
    return node if isinstance(node, bool) else decide(node[2] if row[node[0]] <= node[1] else node[3], row)


def varied(rng):
    """A page of random regions and its article."""
    said = lambda k: " ".join(rng.choice(["bar", "den", "fol", "gur"]) for _ in range(k))
    menu = lambda: "<ul>" + "".join(f"<li><a>{said(rng.randrange(1, 4))}</a></li>" for _ in range(rng.randrange(2, 6))) + "</ul>"
    texts = [said(rng.choice([1, 2, 5, 12, 25, 60, 90])) for _ in range(rng.randrange(3, 9))]
    body = "".join(f"<{t}>{x}</{t}>" for x in texts for t in [rng.choice(["p", "p", "p", "h2", "div"])])
    kind = rng.randrange(3)
    if kind == 0:
        return f"<nav>{menu()}</nav><div class='{rng.choice(['ad', 'top-banner'])}'>{said(8)}</div><article>{body}</article><aside>{said(30)}</aside><footer>{said(12)}</footer>", texts
    if kind == 1:
        return f"<header>{said(3)}</header><main>{body}</main><div id='comments'><p>{said(40)}</p></div>{menu()}", texts
    texts = [said(40), *texts, said(35)]
    body = "".join(f"<p>{x}</p>" for x in texts)
    return f"{menu()}{body}{menu()}", texts


def test_equals_a_slow_classifier():
    rng = random.Random(5)
    right = total = 0
    for _ in range(300):
        page, texts = varied(rng)
        slow = Slow(page)
        got, rows = html.blocks(page)
        assert got == [f[3] for f in slow.found]
        np.testing.assert_allclose(rows, np.array(slow.rows()))
        assert html.keep(rows).tolist() == [decide(html.tree(), r) for r in slow.rows()]
        right += text(page) == "\n".join(texts)
        total += 1
    assert right >= 0.97 * total


def test_given_pages_without_sections(spark):
    """The same pages with sections, footers and menus as plain divisions: words, links, neighbours and a class name of the advert decide."""
    right = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        if r.html:
            total += 1
            right += text(re.sub(r"<(/?)(?:article|nav|footer|header|main|aside|section)(?=[\s>])", r"<\1div", r.html)) == text(r.html)
    assert right >= 0.9 * total, (right, total)


def test_given_pages(spark):
    """The given pages mark their article, so that the main text is known."""
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        parts = [" ".join(unescape(re.sub(r"<(br)?[^>]*>", lambda m: " " if m[1] else "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner[1] if inner else "")]
        assert text(r.html or "") == "\n".join(x for x in parts if x)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<article><p>a&amp;b &eacute;&nbsp; c<br>d</p>x</article>", "a&b é c d\nx"),
        ('<head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- ad 0 --><div class="ad">Nicht aulich.</div><article><h1>H.</h1><p><b>H.<br><p>Of.</p><p>Two <a href="q">li</a></p></article><footer>&copy; m</footer>', "H.\nH.\nOf.\nTwo li"),
        ("<article><p>one<p>two</article><div class='comments'><p>bad long comment text of many words and more words than that</p></div>", "one\ntwo"),
        ("<article>a<script>never closed <p>b", "a"),
        ("<article>1 < 2 and 3 > 2 <b", "1 < 2 and 3 > 2"),
        ('<article><header class="entry-header"><h1>Title</h1></header><p>Text.</p></article>', "Title\nText."),
        ('<div class="wrapper no-sidebar"><p>Some words that are the text of this page and go on.</p><p>x</p></div>', "Some words that are the text of this page and go on.\nx"),
        ('<div class="content right-sidebar"><p>Some words of it.</p></div>', "Some words of it."),
        ('<div class="modal-body page"><p>Some words that are the text.</p></div>', "Some words that are the text."),
        ('<article><p>One.</p><section class="related-work"><h2>Related work</h2><p>Two.</p></section></article>', "One.\nRelated work\nTwo."),
        ("<article><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> by law.</p><svg><text>drawn</text></svg></article>", "Energy is E=m by law.\ndrawn"),
        ('<main><p>Text.</p><div id=responses><p>r</p></div><div class=reader-feedback><p>f</p></div><div class=related-posts><a>x</a></div></main>', "Text."),
        ('<article><p>One.</p><p hidden>h</p><div style="color:red; display: none"><p>n</p></div><ins class=adsbygoogle></ins><div class="adsbygoogle">b</div><p class="hidden-gem">Two.</p></article>', "One.\nTwo."),
        ('<article><ul><li class="ad">Buy<li>Keep this</ul><p>x</p></article>', "Keep this\nx"),
        ("<article><p>x</p><!-- <p>no</p> --><form>Name <input value='a>b'> send</form><section id=comments>c</section>y</article>", "x\ny"),
    ],
)
def test_pages(page, want):
    assert text(page) == want


def test_very_long_page_is_whole():
    page = "<article>" + "<p>word of it</p>" * 50_000 + "</article>"
    assert text(page).count("\n") == 49_999


def test_rows(spark):
    rows = [(1, "u", None), (2, None, "<article><p>x</p></article>"), (2, None, "<article><p>x</p></article>"), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text")
    got = sorted(map(str, (tuple(r)[:4] for r in html.extract(df).collect())))
    assert got == sorted(map(str, [(1, "u", "", 0), (2, None, "x", 1), (2, None, "x", 1), (None, "v", "", 0)]))
    assert html.extract(df.limit(0)).collect() == []
