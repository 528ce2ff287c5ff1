"""Main text of web pages: flat text blocks and a small decision tree.

A page becomes a flat list of blocks, cut at block-level tags. Each block has its word count and link density, those
of the blocks before and after it, the longest link-poor block near it, the longest anywhere before and after it, whether it is a paragraph, heading or item
or bare text of a division, and signs of the markup around it: whether it is in an
``article`` or ``main`` element, whether in an element for things beside the text (``nav``, ``aside``, ``footer``, a
form, a header of the page) or one that is not shown (``hidden``, ``display: none``), and one weak sign from class names. A decision tree, grown without any preference among these on the labelled blocks of
``LABELLED`` when a worker starts, keeps or drops each block. Most labelled pages share no markup, so that words, links
and neighbours have to decide on them. Nothing is cut off by length.

Null html gives an empty text. Null ids and urls stay, repeated rows are extracted one by one, and columns other than the three named are not read, whatever their names. Comments, scripts, styles and the contents of form fields are never text; formulas and
the text of drawings are. An unclosed raw element runs to the end of the page, as in HTML; a tag that the page ends within is dropped. A list item, table
cell or term that is not closed ends where the next one starts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import slices, texts_of

#: Fixed values of HTML: elements that end a block, that hold no text of the page, that never have an end tag.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes select button object canvas audio video annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose extent matters to the blocks in them; others need no place on the stack.
NESTED = frozenset("article aside blockquote body center dd details dialog dir div dl dt fieldset figure footer form header hgroup main menu nav ol search section table tbody td tfoot th thead tr ul li".split())
#: Elements that end an open one of the same list, table or group of terms, and what holds those.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tr": ({"tr"}, {"table"})}
INSIDE = frozenset("article main".split())
BESIDE = frozenset("nav footer aside form menu dialog search fieldset".split())
BESIDE_ROLE = frozenset("navigation complementary contentinfo banner search dialog alertdialog alert menu menubar toolbar form".split())
#: Words of class names and ids that often go with things beside the text, or with the text.
OFF_NAME = frozenset("ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent adsbygoogle cookie cookies copyright disclaimer discussion disqus footer menu modal nav navbar navigation newsletter notice notices notification notifications overlay pagination pager paywall popup promo promos promotion recommended related replies respond response responses feedback share sharing sidebar signup skyscraper social sponsor sponsored sponsors subscribe subscription toolbar topbar trackback masthead".split())
ON_NAME = frozenset("article articlebody content entry post story maincontent postbody articletext".split())
#: Words that say nothing by themselves, so that the one before them counts; words that undo the one behind them.
GENERIC = frozenset("container list item items area box block section slot links link buttons bar panel inner unit text title form widget group row posts articles stories".split())
UNDONE = frozenset("no has with without".split())
#: Elements whose own text is running text; the first two hold no other block.
RUNNING = frozenset("p pre".split())
HOLDS_RUNNING = frozenset("li blockquote dd dt".split())

TAG = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[!?/][^>]*(?:>|\Z)|/?[a-zA-Z][^>]*\Z)""", re.S)
NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
UNSHOWN = re.compile(r"""(?<![\w-])(?:aria-hidden\s*=\s*["']?true|style\s*=\s*(?:"[^"]*|'[^']*)display\s*:\s*none)""", re.I)
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
FEATURES = "words links before_words before_links after_words after_links near earlier later heading running named inside beside page_inside".split()


def sign(name: str) -> int:
    """-1, 0 or 1: what one class name says. Its last word counts, or the one before a word that says nothing."""
    words = [w.lower() for w in PARTS.split(name) if w]
    while len(words) > 1 and words[-1] in GENERIC:
        words.pop()
    if not words or len(words) > 1 and words[-2] in UNDONE:
        return 0
    return (words[-1] in ON_NAME) - (words[-1] in OFF_NAME)


def signs(attributes: str) -> tuple[int, bool]:
    """What the class names and the id say together, and whether the role is one for things beside the text."""
    total, beside = 0, False
    for m in NAMED.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            beside |= value.strip().lower() in BESIDE_ROLE
        else:
            total += sum(map(sign, value.split()))
    return (total > 0) - (total < 0), beside


def unshown(attributes: str) -> bool:
    """Whether an element with these attributes is not shown."""
    low = attributes.lower()
    if "hidden" not in low and "none" not in low:
        return False
    return bool(UNSHOWN.search(attributes) or HIDDEN.search(QUOTED.sub("=", attributes)))


def blocks(html: str) -> tuple[list[str], np.ndarray]:
    """The text blocks of a page and a row of features for each."""
    texts: list[str] = []
    rows: list[tuple] = []
    stack: list[tuple[str, int, bool, bool]] = []
    named, inside, beside = 0, False, False
    in_link = in_heading = in_running = running_hidden = page_inside = False
    held: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal held, linked
        words = "".join(held).split()
        if words:
            texts.append(" ".join(words))
            running = in_heading or in_running or bool(stack) and stack[-1][0] in HOLDS_RUNNING
            rows.append((len(words), min(1.0, linked / len(words)), in_heading, running, named, inside, beside or running_hidden))
        held, linked = [], 0

    at = 0
    while True:
        m = TAG.search(html, at)
        chunk = html[at : m.start() if m else len(html)]
        if chunk:
            chunk = unescape(chunk) if "&" in chunk else chunk
            held.append(chunk)
            if in_link:
                linked += len(chunk.split())
        if m is None:
            break
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in RAW:
            if tag in BLOCK:
                flush()
            if not closing:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCK:
            flush()
            in_link = False
            in_running = not closing and tag in RUNNING
            running_hidden = False
            if tag[0] == "h" and tag[1:].isdigit():
                in_heading = not closing
            if not closing and (in_running or in_heading) and attributes:
                running_hidden = unshown(attributes)
        if tag not in NESTED:
            continue
        if not closing:
            if tag in ENDS:
                same, holder = ENDS[tag]
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in same or stack[k][0] in holder), -1)
                if depth >= 0 and stack[depth][0] in same:
                    _, named, inside, beside = stack[depth]
                    del stack[depth:]
            says, by_role = signs(attributes) if "=" in attributes else (0, False)
            stack.append((tag, named, inside, beside))
            if tag in ("body", "article", "main"):
                says = max(says, 0)
            named = -1 if named < 0 or says < 0 else max(named, says)
            beside |= by_role or tag in BESIDE or unshown(attributes) or (tag == "header" and not inside)
            inside |= tag in INSIDE and not beside
            page_inside |= inside
        elif any(t[0] == tag for t in reversed(stack)):
            while True:
                t, named, inside, beside = stack.pop()
                if t == tag:
                    break
    flush()
    n = len(rows)
    out = np.zeros((n, len(FEATURES)))
    if n:
        raw = np.array(rows, float)
        out[:, 0:2] = raw[:, 0:2]
        out[1:, 2:4], out[:-1, 4:6] = raw[:-1, 0:2], raw[1:, 0:2]
        plain = np.concatenate(([0, 0], np.where(raw[:, 1] <= 1 / 3, raw[:, 0], 0), [0, 0]))
        out[:, 6] = np.max([plain[0:n], plain[1 : n + 1], plain[3 : n + 3], plain[4 : n + 4]], axis=0)
        poor = plain[2:-2]
        out[1:, 7], out[:-1, 8] = np.maximum.accumulate(poor)[:-1], np.maximum.accumulate(poor[::-1])[::-1][1:]
        out[:, 9:14], out[:, 14] = raw[:, 2:7], page_inside
    return texts, out


#: The labelled table: pages whose blocks are marked + (text) or - (beside it), in page order. {12} stands for twelve
#: words, {a3} for a link of three words; each page is taken with its numbers times each of ``SCALES``.
#: Pages without telling markup. They are taken as they are, as the content of an article, and as what stands beside one.
PLAIN = (
    ("<div>{a1} {a1} {a2}</div><h1>{6}</h1><p>{45}</p><p>{3}</p><p>{60}</p><div>{a1} {a2}</div>", "-++++-"),
    ("<table><tr><td>{a1}</td><td>{a1}</td></tr></table><p>{30}</p><p>{5}</p><p>{28}</p><p>{40}</p><div>{a2} | {a1} | {a2}</div>", "--++++-"),
    ("<ul><li>{a2}</li><li>{a1}</li><li>{a2}</li></ul><h2>{4}</h2><p>{80}</p><ul><li>{6}</li><li>{4}</li></ul><p>{33}</p><p>{a4}</p>", "---+++++-"),
    ("<div class=x1>{a1} {a1}</div><div class=x2><p>{25} {a3} {12}</p><p>{40}</p></div><div class=x3>{a5}</div><div class=x3>{a6}</div>", "-++--"),
    ("<p>{1}</p>", "+"),
    ("<p>{14}</p>", "+"),
    ("<h1>{3}</h1><p>{4}</p>", "++"),
    ("<div>{a1}</div><div>{a2}</div><p>{70}</p><p>{24} {a2} {20}</p><p>{2}</p><p>{50}</p><div>{a1}</div><div>{a3}</div>", "--++++--"),
    ("<p>{a1} {a1} {a1}</p><h1>{5}</h1><p>{22}</p><p>{31}</p><p>{a2}</p>", "-+++-"),
    ("<center>{a1} {a2}</center><p>{18}</p><p>{1}</p><p>{44}</p><p>{7}</p><p>{38}</p><center>{a2} {a1} {1}</center>", "-+++++-"),
    ("<div>{a3}</div><div>{a4}</div><div>{a2}</div><h1>{8}</h1><p>{90}</p><h2>{3}</h2><p>{66}</p><div>{a5}</div>", "---++++-"),
    ("<ul><li>{a2}</li><li>{a1}</li></ul><p>{20}</p><ul><li>{a1}</li><li>{a1}</li></ul>", "--+--"),
    ("<p>{40}</p><blockquote>{9}</blockquote><p>{25}</p><p>{a6} {2}</p>", "+++-"),
    ("<div>{a1} {a1} {a1} {a1}</div><pre>{30}</pre><p>{12}</p><p>{35}</p>", "-+++"),
    ("<div>{a1} {a1}</div><div>{2}</div><div>{a2}</div><h1>{6}</h1><p>{40}</p><p>{3}</p><p>{50}</p><div>{a1}</div><div>{6}</div>", "---++++--"),
    ("<div>{a1} {a2}</div><p>{4}</p><p>{60}</p><p>{5}</p><div>{a1}</div>", "-+++-"),
    ("<div>{3} {a1} {2} {a1}</div><h1>{5}</h1><p>{30} {a25} {20}</p><p>{20} {a28} {12}</p><p>{44}</p><div>{a3}</div><div>{7}</div><div>{a1}</div>", "-++++---"),
    ("<td>{2}</td><td>{a2}</td><td>{3}</td><td>{a1}</td><p>{26}</p><p>{30}</p><div>{a1} {a1} {a1}</div><div>{8}</div>", "----++--"),
    ("<h1>{4}</h1><p>{35} {a12} {9}</p><p>{2}</p><p>{18} {a16} {8}</p><div>{a9}</div><div>{a11}</div><div>{2} {a8}</div>", "++++---"),
    ("<p>{a2}</p><p>{2}</p><p>{a3}</p><p>{1}</p><p>{48}</p><p>{a2}</p><p>{3}</p>", "----+--"),
    # a line without links at the end, after long and after short paragraphs
    ("<div>{a1} {a1} {a1}</div><h1>{7}</h1><p>{70}</p><p>{45}</p><div>{9}</div>", "-+++-"),
    ("<ul><li>{a1}</li><li>{a1}</li><li>{a1}</li></ul><div>{9}</div><h1>{6}</h1><p>{90}</p><p>{8}</p><p>{35}</p><p>{5}</p><div>{16}</div>", "----+++++-"),
    ("<div><ul><li>{a1}</li><li>{a1}</li></ul></div><div><h1>{9}</h1><p>{12}</p></div><div>{12}</div>", "--++-"),
    ("<div>{a1} {a1}</div><h1>{4}</h1><p>{25}</p><p>{6}</p><p>{150}</p><p>{11}</p><div>{20}</div>", "-+++++-"),
    ("<div>{a1}</div><h2>{5}</h2><p>{110}</p><p>{30}</p><div>{8}</div><div>{14}</div>", "-+++--"),
    # a line that heads a list of links, and one of the text in the same place
    ("<div>{a1} {a1}</div><h1>{5}</h1><p>{60}</p><p>{40}</p><p>{3}</p><ul><li>{a6}</li><li>{a5}</li><li>{a7}</li></ul>", "-+++----"),
    ("<h1>{6}</h1><p>{50}</p><p>{3}</p><p>{44}</p><p>{4}</p><div>{a4}</div><div>{a6}</div>", "++++---"),
    ("<h1>{6}</h1><p>{50}</p><p>{44}</p><p>{4}</p><p>{28}</p><p>{3}</p>", "++++++"),
    # text in divisions
    ("<div>{a1} {a1}</div><div>{60}</div><div>{7}</div><div>{55}</div><div>{48}</div><div>{13}</div>", "-++++-"),
    ("<h1>{5}</h1><div>{70}</div><div>{34}</div>", "+++"),
)
#: Pages whose markup tells, or misleads.
TELLING = (
    # class names that mislead or are of no use
    ("<div class='wrapper no-sidebar'><div>{a1} {a1}</div><h1>{5}</h1><p>{40}</p><p>{6}</p><p>{30}</p></div>", "-++++"),
    ("<div class='content right-sidebar'><h1>{6}</h1><p>{35}</p><p>{3}</p><p>{20}</p></div>", "++++"),
    ("<div class='modal-body page'><p>{20}</p><p>{44}</p></div>", "++"),
    ("<div class='post'><div>{a2} {a1}</div><p>{33}</p><p>{2}</p></div>", "-++"),
    ("<div class=content><p>{5}</p><p>{2}</p><p>{8}</p></div><div>{a2}</div>", "+++-"),
    # class names that are right
    ("<div>{a1} {a1}</div><h1>{5}</h1><p>{50}</p><p>{40}</p><div class=sidebar><h3>{2}</h3><p>{22}</p><ul><li>{a4}</li><li>{a3}</li></ul></div>", "-+++----"),
    ("<div class=ad>{8}</div><p>{40}</p><div class=ad>{12}</div><p>{38}</p>", "-+-+"),
    ("<div id=menu>{a1} {a1}</div><div class=content><h2>{1}</h2><p>{1}</p><p>{a6}</p><p>{18}</p></div><div class=comments><p>{40}</p><p>{3}</p></div>", "-++++--"),
    ("<div class=cookie-notice>{16}</div><p>{33}</p><p>{4}</p><p>{51}</p><div id=newsletter-box>{13}</div>", "-+++-"),
    ("<h1>{7}</h1><p>{60}</p><p>{35}</p><div id=comments><p>{80}</p><p>{28}</p></div><div class=copyright>{9}</div>", "+++---"),
    ("<div class=entry-content><p>{12}</p><div class=share-buttons>{4}</div><p>{a3}</p><p>{6}</p></div>", "+-++"),
    # elements that tell
    ("<nav><ul><li>{a1}</li><li>{a1}</li></ul></nav><div class=ad>{8}</div><article><h1>{10}</h1><p>{3}</p><p>{1}</p><p>{17}</p><p>{80}</p></article><footer>{12}</footer>", "---+++++-"),
    ("<nav>{a2}</nav><article><p>{60}</p><p>{2}</p><p>{a3}</p><p>{1}</p></article><footer>{30}</footer>", "-++++-"),
    ("<header>{a1} {5}</header><main><h1>{4}</h1><p>{14} {a2} {5}</p><ul><li>{2}</li><li>{a3}</li></ul><p>{1}</p></main><aside><h3>{1}</h3><p>{24}</p></aside>", "-+++++--"),
    ("<article><header class=entry-header><h1>{6}</h1></header><p>{30}</p><section class=related-work><h2>{2}</h2><p>{44}</p></section><footer>{6}</footer></article>", "++++-"),
    ("<main><div class=share>{a1}</div><h1>{1}</h1><p>{6}</p><div class=newsletter>{16}</div><p>{6}</p></main>", "-++-+"),
    ("<article><p>{40}</p><aside>{20}</aside><p>{2}</p><section id=comments><p>{50}</p><p>{2}</p></section><form><label>{1}</label><p>{10}</p></form></article>", "+-+----"),
    ("<p>{4}</p><div><p>{25}</p></div><article><h1>{1}</h1><p>{3}</p></article><p>{40}</p><p>{5}</p>", "--++--"),
    ("<div role=navigation>{3}</div><article><h2>{3}</h2><p>{9}</p></article><article><h2>{4}</h2><p>{70}</p></article><div>{7}</div>", "-++++-"),
    ("<article><h2>{2}</h2><ol><li>{a7}</li><li>{a5} {2}</li></ol></article>", "+++"),
    ("<article><p>{a2}</p><p>{a1}</p><p>{a9}</p></article><footer>{a1} {3}</footer>", "+++-"),
    ("<header><p>{9}</p></header><p>{30}</p><p>{44}</p><form>{6}</form><footer>{25}</footer>", "-++--"),
    ("<nav>{4}</nav><div>{a1}</div><p>{50}</p><p>{3}</p><p>{61}</p><footer><p>{7}</p></footer>", "--+++-"),
)
LABELLED = (
    *PLAIN,
    *((f"<article>{page}</article>", "+" * len(marks)) for page, marks in PLAIN),
    *((f"{page}<article><p>{{30}}</p><p>{{2}}</p></article>", "-" * len(marks) + "++") for page, marks in PLAIN),
    *TELLING,
)
SCALES = (0.7, 1, 1.5)


def labelled(page: str, scale: float) -> str:
    """A page of the table with its words."""

    def words(m: re.Match) -> str:
        text = " ".join(["word"] * max(1, int(int(m[2]) * scale + 0.5)))
        return f"<a>{text}</a>" if m[1] else text

    return re.sub(r"\{(a?)(\d+)\}", words, page)


@lru_cache(1)
def tree() -> tuple:
    """The decision tree: nested (feature, threshold, low side, high side), leaves are booleans."""
    xs, ys = [], []
    for page, marks in LABELLED:
        for scale in SCALES:
            rows = blocks(labelled(page, scale))[1]
            if len(rows) != len(marks):
                raise ValueError(f"{len(rows)} blocks, {len(marks)} labels: {page[:60]}")
            xs.append(rows)
            ys.append(np.array([c == "+" for c in marks]))

    def impurity(y: np.ndarray) -> float:
        return len(y) * y.mean() * (1 - y.mean()) if len(y) else 0.0

    def grow(x: np.ndarray, y: np.ndarray):
        found = []
        for f in range(x.shape[1] if y.any() and not y.all() else 0):
            v = np.unique(x[:, f])
            found += [(impurity(y[x[:, f] <= t]) + impurity(y[x[:, f] > t]), f, t) for t in (v[1:] + v[:-1]) / 2]
        if not found:
            return bool(y.mean() >= 0.5)
        _, f, t = min(found)
        low = x[:, f] <= t
        return (f, float(t), grow(x[low], y[low]), grow(x[~low], y[~low]))

    return grow(np.vstack(xs), np.concatenate(ys))


def keep(rows: np.ndarray) -> np.ndarray:
    """The tree's decision for each block."""
    out = np.zeros(len(rows), bool)
    todo = [(tree(), np.arange(len(rows)))]
    while todo:
        node, own = todo.pop()
        if not isinstance(node, tuple):
            out[own] = node
        elif len(own):
            low = rows[own, node[0]] <= node[1]
            todo += [(node[2], own[low]), (node[3], own[~low])]
    return out


def main_text(html: str) -> tuple[str, int, int]:
    """The kept blocks joined by line ends, their number and the number of all blocks."""
    texts, rows = blocks(html)
    kept = [t for t, k in zip(texts, keep(rows).tolist(), strict=True) if k]
    return "\n".join(kept), len(kept), len(texts)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page id, url, main text, its code points, and the numbers of kept and of all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [main_text(h) for h in texts_of(batch, "html")]
            cols = [batch.column(0), batch.column(1), pa.array([t for t, _, _ in found], pa.string()), pa.array([len(t) for t, _, _ in found], pa.int64())]
            cols += [pa.array([x[k] for x in found], pa.int64()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "url", "text", "n_chars", "n_kept", "n_blocks"])

    picked = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    out = picked.mapInArrow(run, "id long, url string, text string, n_chars long, n_kept long, n_blocks long")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
