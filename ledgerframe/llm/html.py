"""Main-text extraction with a tree-structured graphical model over the DOM.

Every element is a node that is content or not. A node's own evidence is the product of the odds
of its features (length and link share of its own text; the words of its class, id and role; whether it lies in an article or main element, outside it, or on a page without one; its
share of the page's text and the links in it); parent and child are tied by a 2 x 2 potential of the child's tag. Both are
counted on labelled pages, which ``labelled_pages`` writes from layouts with known main text.
Sum-product messages run from the leaves up and from the root down, and give each element its
marginal; the text blocks of elements whose marginal exceeds one half are the main text, in page
order. On a page where none does, the bound is half the greatest marginal among elements that hold
``FLOOR`` characters of text of their own, mostly outside links; a page without such has no main text.

Blocks are what block-level tags separate; <br> and inline tags do not start one. Character
references are decoded, white space inside a block becomes one blank. The head, scripts, styles,
templates and what form controls hold are no text; all else, formulas, drawings, buttons and the
fallback text of embedded media among it, is judged by the model with the block around it.

Defined results: a null, empty or text-less page gives "". Unclosed and stray tags are closed as
browsers do for the common cases. Texts of any length and depth are read whole, without
recursion. One row per row, repeated rows alike; only page_id, url and html are read.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br button canvas cite code data del dfn em font i iframe img ins kbd label mark math object q s samp small span strike strong sub sup svg time tt u var video wbr".split()
)
#: Formulas and drawings; nothing inside them starts a block.
FOREIGN = frozenset("math svg".split())
#: Never text of the page, whatever the model says: the head, code, and what form controls hold.
HIDDEN = frozenset("head title script style noscript template select option datalist textarea input".split())
#: A start tag closes an open element of these kinds, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_TOKEN = re.compile(r"[a-z]+")
#: Characters of its own text that make an element count where nothing is surely content.
FLOOR = 100
#: Elements of one part of a page are alike, so each one's evidence counts for less than its odds; set on labelled pages of another seed.
TEMPER = {"size": 0.5, "where": 0.1, "name": 1.0}


class Page(HTMLParser):
    """Elements of a page in page order (a parent before its children) and its text blocks."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.names, self.label = ["#root"], [-1], [()], [None]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self.inline = [False]
        self.open, self.block = [0], []
        self.place: dict[str, list[int]] = {}  # where in ``open`` each tag is
        self.holder = [0]  # of each element, the nearest that is not inline, itself included
        self.links = self.hidden = self.linked = self.foreign = 0
        self.feed(html)
        self.close()
        self._flush()

    def _flush(self):
        if self.block:
            text = " ".join("".join(self.block).split())
            if text:
                self.blocks.append((self.holder[self.open[-1]], text, self.linked))
        self.block, self.linked = [], 0

    def _pop(self, to: int):
        for k in self.open[to:]:
            tag = self.tag[k]
            self.place[tag].pop()
            self.links -= tag == "a"
            self.hidden -= tag in HIDDEN
            self.foreign -= tag in FOREIGN
        del self.open[to:]

    def _nearest(self, kinds, stop=()) -> int:
        """Where in ``open`` the last element of ``kinds`` is, 0 if one of ``stop`` is open inside it."""
        at = max((self.place[k][-1] for k in kinds if self.place.get(k)), default=0)
        return at if at > max((self.place[k][-1] for k in stop if self.place.get(k)), default=0) else 0

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.block.append(" ")
            return
        inline = tag in INLINE or self.foreign > 0
        if not inline:
            self._flush()
            at = self._nearest(*CLOSES[tag]) if tag in CLOSES else 0 if tag in HIDDEN else self._nearest(("p",), ("table", "td", "div", "article", "section", "li", "body"))
            if at:
                self._pop(at)
        if tag in VOID:
            return
        known = dict(attrs)
        words = " ".join(known.get(k) or "" for k in ("class", "id", "role")).lower()
        self.tag.append(tag)
        self.inline.append(inline)
        self.parent.append(self.open[-1])
        self.names.append(tuple(_TOKEN.findall(words)))
        self.label.append(known.get("data-main"))
        me = len(self.tag) - 1
        self.holder.append(self.holder[self.open[-1]] if inline else me)
        self.place.setdefault(tag, []).append(len(self.open))
        self.open.append(me)
        self.links += tag == "a"
        self.hidden += tag in HIDDEN
        self.foreign += tag in FOREIGN

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        at = self._nearest((tag,))
        if at:
            if not self.inline[self.open[at]]:
                self._flush()
            self._pop(at)

    def handle_data(self, data):
        if self.hidden:
            return
        self.block.append(data)
        if self.links:
            self.linked += len(data.strip())


def _size(characters: int) -> int:
    return min(5, int(math.log(characters + 1, 4)))


def features(page: Page) -> list[list[str]]:
    """Names of the features that each element has."""
    n = len(page.tag)
    own: dict[int, tuple[int, int]] = {}
    for element, text, linked in page.blocks:
        a, b = own.get(element, (0, 0))
        own[element] = (a + len(text), b + linked)
    size, links, inside = [0] * n, [0] * n, [False] * n
    for k, (a, b) in own.items():
        size[k], links[k] = a, b
    for k in range(n - 1, 0, -1):
        size[page.parent[k]] += size[k]
        links[page.parent[k]] += links[k]
    marked = False
    for k in range(1, n):
        inside[k] = page.tag[k] in ("article", "main") or inside[page.parent[k]]
        marked = marked or inside[k]
    out = []
    for k in range(n):
        where = "in" if inside[k] else "out" if marked else "none"
        f = []
        if k in own:  # length and share of links go together
            a, b = own[k]
            f.append(f"size={_size(a)} links={min(3, 4 * b // max(1, a))}")
        if size[k]:
            share = 4 * size[k] // max(1, size[0])
            f.append(f"where={where} share={share} links={min(3, 4 * links[k] // size[k])}")
        out.append([*f, *{f"name={w}" for w in page.names[k]}])
    return out


def _shares(a: float, b: float) -> list[float]:
    """Both over their sum, neither quite nothing."""
    total = a + b
    if not total:
        return [0.5, 0.5]
    return [max(a / total, 1e-12), max(b / total, 1e-12)]


class Model:
    """Counted potentials; ``marginals`` runs sum-product over a page's elements."""

    def __init__(self, pages: list[str]):
        seen: dict[str, list[float]] = {}
        total = [1.0, 1.0]
        count: dict[str, list[list[float]]] = {"": [[1.0, 1.0], [1.0, 1.0]]}
        for html in pages:
            page = Page(html)
            y = [0] * len(page.tag)
            for k in range(1, len(y)):
                mark = page.label[k]
                y[k] = y[page.parent[k]] if mark is None else int(mark)
                for tag in ("", page.tag[k]):
                    count.setdefault(tag, [[0.0, 0.0], [0.0, 0.0]])[y[page.parent[k]]][y[k]] += 1
            for k, names in enumerate(features(page)):
                total[y[k]] += 1
                for f in names:
                    seen.setdefault(f, [0.0, 0.0])[y[k]] += 1
        self.odds = {f: math.log((b + 0.5) / (total[1] + 1)) - math.log((a + 0.5) / (total[0] + 1)) for f, (a, b) in seen.items()}
        usual = [[x / sum(row) for x in row] for row in count[""]]
        #: Of each kind of element: how likely it is content under a parent that is not, and under one that is.
        self.step = {t: [[(x + 2 * u) / (sum(row) + 2) for x, u in zip(row, usual[p])] for p, row in enumerate(rows)] for t, rows in count.items()}

    def marginals(self, page: Page) -> list[float]:
        """Probability that each element is content."""
        n, parent = len(page.tag), page.parent
        steps = [self.step.get(t, self.step[""]) for t in page.tag]
        odds = self.odds
        up = []  # a node's evidence times its children's messages, kept to sum one
        for names in features(page):
            x = sum(TEMPER[f.split("=", 1)[0]] * odds.get(f, 0.0) for f in names)
            p = 1 / (1 + math.exp(-max(-20.0, min(20.0, x))))
            up.append([1 - p, p])
        sent: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            a, b = up[k] = _shares(*up[k])
            (s00, s01), (s10, s11) = steps[k]
            m0, m1 = sent[k] = _shares(s00 * a + s01 * b, s10 * a + s11 * b)
            u = up[parent[k]]
            u[0] *= m0
            u[1] *= m1
            if u[0] + u[1] < 1e-100:
                u[:] = _shares(*u)
        down = [(1.0, 0.0)] * n  # the root is not content
        out = [0.0] * n
        up[0] = _shares(*up[0])
        for k in range(1, n):
            p = parent[k]
            b0, b1 = down[p][0] * up[p][0] / sent[k][0], down[p][1] * up[p][1] / sent[k][1]
            (s00, s01), (s10, s11) = steps[k]
            down[k] = _shares(b0 * s00 + b1 * s10, b0 * s01 + b1 * s11)
            out[k] = _shares(down[k][0] * up[k][0], down[k][1] * up[k][1])[1]
        return out

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        page = Page(html)
        content = self.marginals(page)
        bound = 0.5
        if not any(content[element] > bound for element, _, _ in page.blocks):
            own: dict[int, tuple[int, int]] = {}
            for element, text, linked in page.blocks:
                a, b = own.get(element, (0, 0))
                own[element] = (a + len(text), b + linked)
            bound = max((content[k] for k, (a, b) in own.items() if a >= FLOOR and 2 * b < a), default=2.0) / 2
        return "\n".join(text for element, text, _ in page.blocks if content[element] > bound)


# ---------------------------------------------------------------- labelled pages


_MAIN_NAMES = ("content", "main", "article", "post", "entry-content", "story", "article-body", "text", "post-body")
_OTHER = {
    "nav": ("nav", "menu", "navbar", "breadcrumb", "topnav"),
    "aside": ("sidebar", "related", "widget", "toc", "aside"),
    "footer": ("footer", "copyright", "bottom"),
    "header": ("header", "masthead", "banner", "top"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo"),
    "notice": ("cookie", "notice", "consent", "alert", "gdpr", "popup", "modal", "newsletter"),
    "comments": ("comments", "comment", "replies", "discussion", "disqus", "respond"),
    "share": ("share", "social", "tags", "meta"),
}


def labelled_pages(n: int = 1500, seed: int = 11) -> list[str]:
    """Pages of varied layout; data-main="1" or "0" marks where main text begins and ends (inherited by children)."""
    r = random.Random(seed)
    words = ["".join(r.choice(["ba", "ko", "ri", "tu", "len", "as", "mo", "ver", "in", "ta"]) for _ in range(r.randint(1, 4))) for _ in range(900)]

    def say(a: int, b: int) -> str:
        return " ".join(r.choice(words) for _ in range(r.randint(a, b))).capitalize()

    def para() -> str:
        shape = r.random()
        if shape < 0.25:  # a word or two
            return f"<p>{say(1, 3)}{r.choice(['.', '', ','])}</p>"
        if shape < 0.3:  # one long run
            return f"<p>{say(1, 2)} " + " ".join([say(1, 2)] * r.randint(40, 400)) + "</p>"
        text = " ".join(say(3, 18) + r.choice([".", ".", ".", "!", "?"]) for _ in range(r.choice([1, 1, 2, 4, 9])))
        if r.random() < 0.15:
            text = f'{text} <a href="/x">{say(1, 3)}</a> {say(2, 9)}.'
        if r.random() < 0.2:
            text = f"<{(t := r.choice(['b', 'em', 'i', 'span']))}>{text}" + ("" if r.random() < 0.4 else f"</{t}>")
        return f"<p>{text}" + ("<br>" if r.random() < 0.1 else "") + ("" if r.random() < 0.15 else "</p>")

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(k)) + "</ul>"

    def named(kind: str) -> str:
        tag = kind if kind in ("nav", "aside", "footer", "header") and r.random() < 0.6 else r.choice(["div", "section", "div"])
        name = r.choice(_OTHER[kind])
        mark = "" if tag == kind and r.random() < 0.5 else f' {r.choice(["class", "id"])}="{name}"'
        if kind == "comments":
            body = "".join(f'<div class="comment"><p>{say(4, 25)}.</p></div>' for _ in range(r.randint(1, 4)))
        elif kind in ("nav", "share"):
            body = links(r.randint(2, 8))
        elif kind == "header":
            body = r.choice([f"<h1>{say(1, 3)}</h1>", f'<a href="/">{say(1, 2)}</a>', f"<p>{say(2, 6)}</p>"]) + (links(4) if r.random() < 0.5 else "")
        elif kind == "aside":
            body = f"<h3>{say(1, 3)}</h3>" + r.choice([links(4), f"<p>{say(5, 30)}.</p>"])
        elif kind == "notice":
            body = r.choice([f"<p>{say(6, 25)}.</p>", say(6, 25) + "."]) + "<button>OK</button>"
        else:
            body = r.choice(["&copy; " + say(2, 12) + ".", f"<p>{say(3, 22)}.</p>", say(3, 16) + ".", f"<p>{say(1, 3)}</p>" * r.randint(1, 5)])
        return f'<{tag}{mark} data-main="0">{body}</{tag}>'

    def form() -> str:
        return f'<form data-main="0"><label>{say(1, 3)}</label><input name="q">{f"<p>{say(1, r.choice((5, 25)))}</p>" * r.randint(1, 4)}<button>{say(1, 2)}</button></form>'

    def line() -> str:
        return " ".join(say(3, 18) + r.choice([".", ".", "!", "?"]) for _ in range(r.choice([1, 2, 4])))

    def written(shape: str) -> list[str]:
        """The text of a page: paragraphs, plain blocks, or lines parted by breaks."""
        count = r.choice([1, 2, 4, 8, 15, 40])
        if shape == "p":
            return [para() for _ in range(count)]
        if shape == "blocks":
            tag = r.choice(["div", "div", "section", "span"])
            inner = ("<div>", "</div>") if tag == "span" else ("", "")
            return [f"{inner[0]}<{tag}>{line()}</{tag}>{inner[1]}" for _ in range(max(2, count))]
        return ["<br>".join(line() + r.choice(["", "<br>"]) for _ in range(max(2, count)))]

    def contained(body: str, style: str) -> str:
        if style == "article":
            return f'<article data-main="1">{body}</article>'
        if style == "main":
            return f'<main data-main="1">{body}</main>'
        if style == "both":
            return f'<main><article data-main="1">{body}</article></main>'
        if style == "named":
            return f'<div {r.choice(["class", "id"])}="{r.choice(_MAIN_NAMES)}" data-main="1">{body}</div>'
        if style == "plain":
            made = f'<{(t := r.choice(["div", "div", "section", "center"]))} data-main="1">{body}</{t}>'
            if r.random() < 0.4:
                made = made.replace("<", "<div><", 1).replace("data-main", f'class="{say(1, 1).lower()}" data-main', 1) + "</div>"
            return made
        if style == "table":  # a layout table: a menu beside the text
            menu = r.choice([links(r.randint(3, 8)), "<br>".join(f'<a href="/{i}">{say(1, 3)}</a>' for i in range(r.randint(3, 8)))])
            cells = [f'<td data-main="0">{menu}</td>', f'<td data-main="1">{body}</td>']
            if r.random() < 0.3:
                cells.append(f'<td data-main="0">{links(r.randint(2, 5))}</td>')
            rows = "".join(cells)
            if r.random() < 0.3:
                rows = f'<td colspan="2" data-main="0"><a href="/">{say(1, 3)}</a></td></tr><tr>{rows}'
            return f"<table><tr>{rows}</tr></table>"
        return body  # bare: right in the body element

    pages = []
    for _ in range(n):
        x = r.random()
        parts = written("p" if x < 0.76 else "blocks" if x < 0.88 else "lines")
        if r.random() < 0.05:
            parts += [f"<p>{say(1, 3)}.</p>"] * r.randint(10, 40)
        for k in range(len(parts)):
            x = r.random()
            if x < 0.06:
                parts[k] += f"<h2>{say(1, 6)}</h2>"
            elif x < 0.09:
                parts[k] += "<ul>" + "".join(f"<li>{say(2, 12)}</li>" for _ in range(3)) + "</ul>"
            elif x < 0.12:
                parts[k] += f"<blockquote><p>{say(6, 20)}.</p></blockquote>"
            elif x < 0.14:
                parts[k] += f"<pre>{say(3, 9)}</pre><table><tr><td>{say(1, 3)}</td><td>{say(1, 3)}</td></tr></table>"
            elif x < 0.18:
                parts[k] += named(r.choice(["ad", "aside", "share", "notice"]))
            elif x < 0.20:
                parts[k] += form()
        if r.random() < 0.25:
            parts.append(named("comments"))
        title = f"<h1>{say(2, 9)}{r.choice(['', '.', ''])}</h1>" if r.random() < 0.85 else ""
        style = r.choices(("article", "main", "both", "named", "plain", "table", "bare"), (40, 12, 8, 16, 10, 6, 8))[0]
        main = contained(title + "".join(parts), style)
        if style != "bare" and r.random() < 0.3:
            main = f'<div class="{r.choice(["wrapper", "container", "page", "row"])}">{main}{named("aside") if r.random() < 0.5 else ""}</div>'
        before = [named(k) for k in ("header", "nav", "ad", "notice") if r.random() < 0.5] + ([form()] if r.random() < 0.2 else [])
        after = [named(k) for k in ("comments", "aside", "ad", "share", "footer") if r.random() < 0.45] + ([form()] if r.random() < 0.2 else [])
        r.shuffle(before)
        mark = ' data-main="1"' if style == "bare" else ""
        pages.append(f"<!DOCTYPE html><html><head><title>{say(2, 6)}</title></head><body{mark}>{''.join(before)}{main}{''.join(after)}</body></html>")
    return pages


@lru_cache(1)
def trained() -> Model:
    return Model(labelled_pages())


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [m.extract(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
