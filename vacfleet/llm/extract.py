"""Operator 9: main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: the text between two block-level tags, with the tags and the
class, id and role names above it. Each block is main text or not; a linear-chain CRF scores
features of its ancestors, names and text, and the step from one block to the next. It is
trained by stochastic gradient descent on labelled pages that ``labelled_pages`` lays out
(many layouts with known main text), and decoded by Viterbi.

Text is what a reader sees: comments, scripts, styles, form text, the head's title and closed
``noscript``, ``template`` and ``svg`` elements are no blocks, ``math`` is text, character references are decoded, white space inside a block becomes one space. Inline tags
and line breaks do not end a block. Tags may be unclosed, crossed, in any case.

A null or empty page has no text. Pages of any length are read whole. Repeated rows are
pages of their own. Extra columns pass through; columns named like an added one are
replaced. An empty table stays empty.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from vacfleet.llm.common import enrich

# Names of the HTML language.
BLOCK_TAGS = frozenset("""address article aside blockquote body button center dd details dialog
div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html
iframe label legend li main menu nav ol optgroup option p pre search section select summary
table tbody td tfoot th thead tr ul video audio canvas object map""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"},
                 "tr": {"tr", "td", "th"}, "option": {"option"}}
KEEPS_P_OPEN = frozenset({"button", "label", "option", "select", "iframe", "video", "audio", "canvas", "object", "map"})

#: Elements whose content is characters, not tags, up to their end tag or the page's end.
RAW = ("script", "style", "textarea", "title")
#: Elements whose content a reader does not see; without an end tag they hide nothing.
HIDDEN = frozenset({"noscript", "template", "svg"})
#: Elements that may close themselves by a slash, as all inside them may.
FOREIGN = frozenset({"svg", "math"})

# A tag ends at its ">", or before the next "<", or at the page's end: no text is scanned twice for a
# tag that is never closed. A quote without its pair is a character like others.
_END = r"(?:>|(?=<)|\Z)"
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<({"|".join(RAW)})(?=[\s/>])[^<>]*+{_END}"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:._-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+'|["'])*+)""" + _END + rf"|<[!?/][^<>]*+{_END}", re.S | re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^<>]*+{_END}", re.I) for t in RAW}
_RAW_END_IN_FOREIGN = {t: re.compile(rf"</{t}(?=[\s/>])[^<>]*+{_END}|(?=</(?:svg|math)[\s/>])", re.I) for t in RAW}
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


class Block:
    """A leaf block: its text, the telling tags and the names above it, the innermost block tag, and
    how much of it is linked."""

    __slots__ = ("text", "tags", "names", "leaf", "linked")

    def __init__(self, text: str, tags: set[str], names: set[str], leaf: str, linked: int):
        self.text, self.tags, self.names, self.leaf, self.linked = text, tags, names, leaf, linked


class Ahead:
    """The next match of a pattern at or after a place; places only grow, so each stretch of the
    page is searched once, also where no match follows."""

    def __init__(self, pattern: re.Pattern, page: str):
        self.pattern, self.page, self.found, self.looked = pattern, page, None, False

    def after(self, at: int) -> re.Match | None:
        if not self.looked or (self.found and self.found.start() < at):
            self.looked, self.found = True, self.pattern.search(self.page, at)
        return self.found


def tokens(page: str) -> list[tuple[int, int, re.Match | None]]:
    """Start and end of each tag (with its match), comment and raw-text element (without)."""
    out, at, foreign = [], 0, 0
    raw_end = {t: Ahead(p, page) for t, p in _RAW_END.items()}
    foreign_end = {t: Ahead(p, page) for t, p in _RAW_END_IN_FOREIGN.items()}
    while m := _TOKEN.search(page, at):
        at, tag = m.end(), (m[3] or "").lower()
        if m[1] and foreign:
            end = None if m[0].endswith("/>") else foreign_end[m[1].lower()].after(at)
            at = end.end() if end else at
        elif m[1]:
            end = raw_end[m[1].lower()].after(at)
            at = end.end() if end else len(page)
        elif tag in FOREIGN and not m[4].endswith("/"):
            foreign = max(0, foreign - 1) if m[2] else foreign + 1
        elif tag in BLOCK_TAGS:  # ends unclosed foreign elements
            foreign = 0
        out.append((m.start(), at, m if tag else None))
    return out


def hidden(found: list[tuple[int, int, re.Match | None]]) -> dict[int, int]:
    """Where each hidden element that has an end tag starts and ends."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = defaultdict(list)
    for start, end, m in found:
        tag = m[3].lower() if m else ""
        if tag not in HIDDEN:
            continue
        if not m[2]:
            if not (tag in FOREIGN and m[4].endswith("/")):
                opened[tag].append(start)
        elif opened[tag]:
            out[opened[tag].pop()] = end
    return out


_TELLING = frozenset("""article main nav header footer aside form section ul ol li table td th h1 h2 h3
h4 h5 h6 p blockquote pre figure figcaption button label select option dl dd dt details dialog menu
fieldset legend search address summary div""".split())


class Above:
    """The open elements: their stack, where each tag stands in it, and running counts of the telling
    tags and of the names, so that no tag costs more than the elements it closes."""

    def __init__(self, known: frozenset[str] | None):
        self.known = known
        self.stack: list[tuple[str, frozenset[str]]] = []
        self.at: dict[str, list[int]] = defaultdict(list)
        self.block_tags: list[str] = []
        self.tags: Counter[str] = Counter()
        self.names: Counter[str] = Counter()

    def open(self, tag: str, attributes: str) -> None:
        names = frozenset(w for v in _NAMES.findall(attributes) for w in _PART.findall("".join(v).lower())) if attributes else frozenset()
        if self.known is not None:
            names &= self.known
        self.at[tag].append(len(self.stack))
        self.stack.append((tag, names))
        if tag in BLOCK_TAGS:
            self.block_tags.append(tag)
        if tag in _TELLING:
            self.tags[tag] += 1
        self.names.update(names)

    def last(self, tags) -> int:
        """Place of the innermost open element of these tags (-1: none)."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def close(self, k: int) -> None:
        """Close the elements from place ``k`` on."""
        while len(self.stack) > k:
            tag, names = self.stack.pop()
            self.at[tag].pop()
            if tag in BLOCK_TAGS:
                self.block_tags.pop()
            for count, keys in ((self.tags, (tag,) if tag in _TELLING else ()), (self.names, names)):
                for key in keys:
                    count[key] -= 1
                    if not count[key]:
                        del count[key]


_LISTS = ("ul", "ol", "dl", "table", "select")


def blocks(page: str, known: frozenset[str] | None = None) -> list[Block]:
    """The leaf blocks of a page that hold text, in page order. Of the names above a block, only
    those in ``known`` are kept, if it is given: they are what a fitted field weighs."""
    out: list[Block] = []
    above = Above(known)
    run: list[str] = []
    linked, at = 0, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                leaf = above.block_tags[-1] if above.block_tags else ""
                out.append(Block(text, set(above.tags), set(above.names), leaf, linked))
            run.clear()
            linked = 0

    found = tokens(page)
    unseen = hidden(found)
    for start, end, m in found:
        if start < at:
            continue
        if start > at:
            piece = page[at:start]
            run.append(piece)
            if above.at.get("a"):
                linked += len(piece)
        at = unseen.get(start, end)
        if m is None or start in unseen:
            continue
        tag = m[3].lower()
        is_block = tag in BLOCK_TAGS
        if is_block:
            flush()
        elif tag == "br":
            run.append(" ")
        if m[2]:
            if (k := above.last((tag,))) >= 0:
                above.close(k)
            continue
        if tag in VOID_TAGS or (tag in FOREIGN and m[4].endswith("/")):
            continue
        if is_block and tag not in KEEPS_P_OPEN and (k := above.last(("p",))) >= 0:
            above.close(k)
        if tag in CLOSES_ITSELF and (k := above.last(CLOSES_ITSELF[tag])) > above.last(_LISTS):
            above.close(k)
        above.open(tag, m[4])
    if at < len(page):
        run.append(page[at:])
    flush()
    return out


def features(b: Block, place: int, n: int) -> list[str]:
    """Names of the features that the block has."""
    out = ["all", f"leaf={b.leaf}"]
    out += [f"in={t}" for t in b.tags]
    out += [f"name={w}" for w in b.names]
    size = len(b.text)
    out.append(f"long={min(9, size.bit_length())}")
    share = b.linked / max(size, 1)
    out.append("links=all" if share > 0.8 else "links=many" if share > 0.3 else "links=few")
    last = b.text[-1]
    out.append("ends=stop" if last in ".!?…。\"”»" else "ends=other")
    if "©" in b.text or "®" in b.text:
        out.append("has=copyright")
    if place == 0:
        out.append("first")
    if place == n - 1:
        out.append("last")
    return out


class Field:
    """A CRF with two labels (1: main text): feature weights and steps between labels."""

    def __init__(self) -> None:
        self.weight: dict[str, float] = defaultdict(float)
        self.step = [[0.0, 0.0], [0.0, 0.0]]
        #: Names that have a weight; None while the field is fitted.
        self.known: frozenset[str] | None = None

    def scores(self, page: list[list[str]]) -> list[float]:
        w = self.weight
        return [sum(w[f] for f in fs if f in w) for fs in page]

    def viterbi(self, page: list[list[str]]) -> list[int]:
        """The best labels."""
        s, back, t = (0.0, 0.0), [], self.step
        for k, x in enumerate(self.scores(page)):
            if k == 0:
                s = (0.0, x)
                continue
            zero, one = (s[0] + t[0][0], s[1] + t[1][0]), (s[0] + t[0][1], s[1] + t[1][1])
            back.append((int(zero[1] > zero[0]), int(one[1] > one[0])))
            s = (max(zero), max(one) + x)
        out = [int(s[1] > s[0])] if page else []
        for b in reversed(back):
            out.append(b[out[-1]])
        return out[::-1]

    def learn(self, page: list[list[str]], labels: list[int], rate: float, decay: float) -> None:
        """One step up the gradient of the labels' log probability (forward and backward sums)."""
        x, n, t = self.scores(page), len(page), self.step

        def add(a: float, b: float) -> float:
            m = max(a, b)
            return m + math.log1p(math.exp(min(a, b) - m))

        fore, hind = [(0.0, x[0])], [(0.0, 0.0)] * n
        for k in range(1, n):
            a, b = fore[-1]
            fore.append((add(a + t[0][0], b + t[1][0]), add(a + t[0][1], b + t[1][1]) + x[k]))
        for k in range(n - 2, -1, -1):
            a, b = hind[k + 1][0], hind[k + 1][1] + x[k + 1]
            hind[k] = (add(t[0][0] + a, t[0][1] + b), add(t[1][0] + a, t[1][1] + b))
        total = add(*fore[-1])
        grad = [[0.0, 0.0], [0.0, 0.0]]
        for k in range(n - 1):
            for i in (0, 1):
                for j in (0, 1):
                    p = math.exp(fore[k][i] + t[i][j] + (x[k + 1] if j else 0.0) + hind[k + 1][j] - total)
                    grad[i][j] += (labels[k] == i and labels[k + 1] == j) - p
        for k in range(n):
            wrong = labels[k] - math.exp(fore[k][1] + hind[k][1] - total)
            for f in page[k]:
                self.weight[f] += rate * (wrong - decay * self.weight[f])
        for i in (0, 1):
            for j in (0, 1):
                t[i][j] += rate * grad[i][j]


# Names that pages give to their parts.
MAIN_NAMES = "article content post entry body main text story page news blog single markup prose".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar links pagination pager".split(),
    "header": "header masthead banner branding logo site head top".split(),
    "footer": "footer foot bottom copyright legal colophon sitemap credits".split(),
    "aside": "sidebar aside widget related recommended trending popular tags rail secondary".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay message warning disclaimer".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted adsense commercial".split(),
    "form": "form login search subscribe newsletter signup contact register".split(),
    "comments": "comments comment reply replies discussion thread disqus respond reviews review".split(),
    "share": "share social sharing buttons follow byline meta author date".split(),
}


def labelled_pages(n: int, seed: int = 3) -> list[tuple[str, list[int]]]:
    """Pages in random layouts, each with the labels of its leaf blocks."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbg"

    def words(k: int) -> str:
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(k)).capitalize()

    def named(kind: str) -> str:
        w = rng.choice(MAIN_NAMES if kind == "main" else OTHER_NAMES[kind])
        other = rng.choice(["", "", "-box", "-wrap", " block", "_1"])
        return f' {rng.choice(["class", "class", "id"])}="{w}{other}"'

    def page() -> tuple[str, dict[str, int]]:
        truth: dict[str, int] = {}

        def say(label: int, k: int, end: str = "") -> str:
            text = words(k) + end
            truth[" ".join(html.unescape(text).split())] = label
            return text

        def sentences(label: int) -> str:
            return say(label, rng.choice([1, 3, 8, 20, 60, 150]), rng.choice([".", ".", ".", ".", "!", "?", "", " &amp;", "|", "***"]))

        def other(kind: str) -> str:
            tag = {"nav": ["nav", "div", "ul", "menu"], "header": ["header", "div"], "footer": ["footer", "div"],
                   "aside": ["aside", "div", "section"], "form": ["form"], "comments": ["section", "div", "ol"],
                   }.get(kind, ["div", "section", "aside", "p"])
            tag = rng.choice(tag)
            plain = tag in ("nav", "header", "footer", "aside", "form", "menu")
            attr = named(kind) if not plain or rng.random() < 0.4 else ""
            if kind in ("nav", "aside", "footer") and rng.random() < 0.7:
                item = lambda: f'<li><a href="/x">{say(0, rng.randint(1, 4))}</a></li>'
                inner = "<ul>" + "".join(item() for _ in range(rng.randint(2, 7))) + "</ul>"
            elif kind == "form":
                inner = f"<label>{say(0, 2)}</label><input name=q><button>{say(0, 1)}</button>"
            elif kind == "comments":
                inner = "".join(f'<div{named("comments")}><p>{sentences(0)}</p></div>' for _ in range(rng.randint(1, 4)))
                inner = (f"<h3>{say(0, 2)}</h3>" if rng.random() < 0.5 else "") + inner
            else:
                wrap = "{}" if tag == "p" else rng.choice(["{}", "<p>{}</p>", "<div>{}</div>", "<span>{}</span>"])
                inner = "".join(wrap.format(sentences(0)) for _ in range(1 if wrap == "{}" else rng.randint(1, 3)))
            if kind == "footer" and rng.random() < 0.5:
                inner += f"<p>&copy; {say(0, 4)}</p>"
                truth["© " + list(truth)[-1]] = 0
            return f"<{tag}{attr}>{inner}</{tag}>"

        def main() -> str:
            parts = []
            if rng.random() < 0.8:
                parts.append(f"<h1>{say(1, rng.randint(2, 10))}</h1>")
            if rng.random() < 0.2:
                parts.append(other("share"))
            for _ in range(rng.randint(1, 9)):
                r = rng.random()
                if r < 0.62:
                    parts.append(f"<p>{sentences(1)}" + rng.choice(["</p>", "</p>", "</p>", "", "<br>"]))
                elif r < 0.70:
                    parts.append(f"<h{(k := rng.randint(2, 4))}>{say(1, rng.randint(1, 6))}</h{k}>")
                elif r < 0.78:
                    parts.append("<ul>" + "".join(f"<li>{sentences(1)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>")
                elif r < 0.84:
                    parts.append(f"<blockquote><p>{sentences(1)}</p></blockquote>")
                elif r < 0.88:
                    parts.append(f"<table><tr><td>{sentences(1)}</td><td>{say(1, 2)}</td></tr></table>")
                elif r < 0.92:
                    parts.append(f"<pre>{sentences(1)}</pre>")
                else:
                    parts.append(other(rng.choice(["ad", "aside", "share", "notice", "form", "nav"])))
            if rng.random() < 0.25:
                parts.append(other("comments"))
            inner = "".join(parts)
            r = rng.random()
            if r < 0.4:
                return f"<article>{inner}</article>"
            if r < 0.55:
                return f"<main>{inner}</main>"
            if r < 0.7:
                return f"<main><article{named('main')}>{inner}</article></main>"
            if r < 0.95:
                return f"<div{named('main')}>{inner}</div>"
            return f"<div>{inner}</div>"

        top = [other(rng.choice(["nav", "header", "notice", "ad", "form"])) for _ in range(rng.randint(0, 4))]
        end = [other(rng.choice(["footer", "aside", "comments", "nav", "ad", "notice", "form"])) for _ in range(rng.randint(0, 4))]
        return "<html><body>" + "".join([*top, main(), *end]) + "</body></html>", truth

    out = []
    for _ in range(n):
        text, truth = page()
        out.append((text, [truth.get(b.text, 0) for b in blocks(text)]))
    return out


def train(pages: list[tuple[str, list[int]]], rounds: int = 6, seed: int = 3) -> Field:
    """Fit the field to labelled pages."""
    field, rng = Field(), random.Random(seed)
    data = []
    for text, labels in pages:
        own = blocks(text)
        if own:
            data.append(([features(b, k, len(own)) for k, b in enumerate(own)], labels))
    for r in range(rounds):
        rng.shuffle(data)
        for page, labels in data:
            field.learn(page, labels, 0.1 / (1 + r), 1e-4)
    field.weight = dict(field.weight)
    field.known = frozenset(f.removeprefix("name=") for f in field.weight if f.startswith("name="))
    return field


def main_text(page: str, field: Field) -> str:
    """The blocks that the field labels as main text, one a line."""
    own = blocks(page, field.known)
    marks = field.viterbi([features(b, k, len(own)) for k, b in enumerate(own)])
    return "\n".join(b.text for b, m in zip(own, marks) if m)


def extract(pages: DataFrame, field: Field, html_col: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points) to each page."""
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def start():
        field = shared.value

        def make(column: pa.Array) -> list:
            texts = [main_text(p, field) if p else "" for p in column.to_pylist()]
            return [texts, [len(t) for t in texts]]
        return make

    added = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])
    return enrich(pages, html_col, added, start)
