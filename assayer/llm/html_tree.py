"""Main text of web pages by a graphical model on the element tree.

Every block element of a page is a node with a hidden label: content, beside it, or a frame
around both. Potentials are a table of parent and child labels, and for each node the evidence
of its tag, of the words in the class, id and role of itself and of what is named above it,
and of its own text (its length, links and ending as one piece). The model is a tree, so
passing sums of products upward and then downward gives the exact probability of content at
each node; text of nodes at one half or more is the main text. All tables are counted, with a
little added to every count, on labelled pages.

Inline elements belong to the block around them. A block's text between two block borders is
one block of the output: its white space becomes single spaces. Scripts, styles, templates,
the head and embedded objects have no text.

Labelled pages are made by ``labelled_pages`` from layouts with random parts, ``PAGES`` of
them by default: a fixed, small number, so the model is trained where the query is planned.
``train`` takes any others whose block elements carry ``data-content`` (1, 0 or frame).

Pages are parsed one at a time and nothing is shuffled. Defined results: NULL and empty pages
have an empty text; markup that breaks off or is never closed is read as browsers do, to its
end; repeated rows get the same text each; other columns pass through, and a column named like
an output is replaced.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

PAGES = 1500
LABEL = "data-content"
# Labels of nodes: beside the content, content, and frames that hold both.
LABELS = ("0", "1", "frame")
CONTENT, FRAME = 1, 2

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q s samp "
    "small span strike strong sub sup time tt u var".split())
HIDDEN = frozenset("script style template noscript head title svg iframe canvas audio video "
                   "object math".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
# An open paragraph does not reach out of these.
SCOPE = frozenset("table td th caption button object template html".split())
CLOSES = {
    "li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}),
    "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}),
    "th": ("td th", {"tr", "table"}), "option": ("option", {"select"}),
}
_NAME = re.compile(r"[a-z]+")
_BREAKS = re.compile(r"([a-z])([A-Z])")


@dataclass
class Node:
    tag: str
    parent: int
    hidden: bool
    names: tuple[str, ...] = ()
    above: tuple[str, ...] = ()
    label: int | None = None
    words: int = 0
    linked: int = 0
    ending: str = ""


@dataclass
class Page(HTMLParser):
    """The block elements of a page, parents first, and its texts in order."""
    nodes: list[Node] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes.append(Node("#page", -1, False))
        self.open = [0]
        # Where in ``open`` the elements of each tag are.
        self.places: dict[str, list[int]] = {"#page": [0]}
        self.held: list[str] = []
        self.held_links: list[str] = []
        self.in_link = False

    def _border(self) -> None:
        """Ends the text at hand, which belongs to the innermost open block."""
        if not self.held:
            return
        words = "".join(self.held).split()
        if words:
            node = self.nodes[self.open[-1]]
            node.words += len(words)
            node.linked += len("".join(self.held_links).split())
            node.ending = words[-1][-1]
            self.texts.append((self.open[-1], " ".join(words)))
        self.held, self.held_links = [], []

    def _close(self, tags: set[str] | frozenset[str], scope) -> None:
        """Closes the innermost open element of ``tags``, unless ``scope`` comes first."""
        found = self._innermost(tags)
        if found > self._innermost(scope):
            self._cut(found)

    def _innermost(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _cut(self, place: int) -> None:
        for node in self.open[place:]:
            self.places[self.nodes[node].tag].pop()
        del self.open[place:]

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Declarations that are none, such as conditional ones, are comments to browsers."""
        return self.parse_bogus_comment(i, 0)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in INLINE:
            if tag == "a":
                self.in_link = True
            return
        if tag == "br" or tag == "wbr":
            if tag == "br" and self.held:
                self.held.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self._border()
                self._close({"p"}, SCOPE)
            return
        self._border()
        if tag not in IN_HEAD and self.nodes[self.open[-1]].tag == "head":
            self._cut(len(self.open) - 1)
        self._close({"p"}, SCOPE)
        if tag in CLOSES:
            several, scope = CLOSES[tag]
            for _ in several.split():
                self._close(set(several.split()), scope)
        parent = self.open[-1]
        found = dict(attrs)
        names = " ".join(found.get(n) or "" for n in ("class", "id", "role"))
        label = found.get(LABEL)
        self.nodes.append(Node(
            tag, parent, self.nodes[parent].hidden or tag in HIDDEN,
            tuple(_NAME.findall(_BREAKS.sub(r"\1 \2", names).lower())) if names.strip() else (),
            self.nodes[parent].names or self.nodes[parent].above,
            LABELS.index(label) if label in LABELS else None))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs) -> None:
        # A slash does not close anything but in void elements.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag in INLINE or tag in VOID:
            return
        self._border()
        self._close({tag}, ())

    def handle_data(self, data: str) -> None:
        if not self.nodes[self.open[-1]].hidden:
            self.held.append(data)
            if self.in_link:
                self.held_links.append(data)

    def unknown_decl(self, data: str) -> None:
        pass

    @classmethod
    def of(cls, html: str) -> Page:
        page = cls()
        page.feed(html)
        page.close()
        page._border()
        return page


def evidence(node: Node) -> list[str]:
    """What is seen of a node; what describes its text is one piece, as it goes together."""
    seen = [f"tag {node.tag}", *[f"name {n}" for n in node.names],
            *[f"under {n}" for n in node.above]]
    if not node.words:
        return [*seen, "text none"]
    size = 1 if node.words < 4 else 2 if node.words < 12 else 3 if node.words < 40 else 4
    links = 0 if not node.linked else 1 if 3 * node.linked < node.words else 2
    return [*seen, f"text {size} {links} {int(node.ending in '.!?:…。')}"]


def _shares(values: list[float]) -> list[float]:
    whole = sum(values)
    return [x / whole or 1e-300 for x in values]


@dataclass
class Model:
    """Potentials as probabilities: of labels below labels, and of evidence below labels."""
    first: list[float]
    below: list[list[float]]
    seen: dict[str, tuple[float, ...]]

    def marginals(self, page: Page) -> list[float]:
        """Probability of content at each node."""
        nodes, below = page.nodes, self.below
        count = len(nodes)
        nothing = (0.0,) * len(LABELS)
        belief = []
        for node in nodes:
            logs = [sum(x) for x in zip(*(self.seen.get(e, nothing) for e in evidence(node)),
                                        strict=True)]
            top = max(logs)
            belief.append([math.exp(max(x - top, -300.0)) for x in logs])
        message: list[list[float]] = [[]] * count
        for k in range(count - 1, 0, -1):  # upward: children come after their parents
            own = belief[k]
            sent = message[k] = _shares(
                [sum(p * x for p, x in zip(row, own, strict=True)) for row in below])
            up = nodes[k].parent
            belief[up] = _shares([x * y for x, y in zip(belief[up], sent, strict=True)])
        whole = [_shares([p * x for p, x in zip(self.first, belief[0], strict=True)])] * count
        for k in range(1, count):  # downward: what the rest of the tree says of the parent
            rest = _shares([x / y for x, y in zip(whole[nodes[k].parent], message[k],
                                                  strict=True)])
            whole[k] = _shares([
                belief[k][y] * sum(below[x][y] * rest[x] for x in range(len(rest)))
                for y in range(len(rest))])
        return [w[CONTENT] for w in whole]

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        page = Page.of(html)
        content = self.marginals(page)
        return "\n".join(t for k, t in page.texts if content[k] >= 0.5)


def train(pages: Iterable[str], added: float = 0.5) -> Model:
    """The model of labelled pages; elements without a label have the one above them."""
    several = range(len(LABELS))
    pairs = [[added] * len(LABELS) for _ in several]
    counts: list[Counter] = [Counter() for _ in several]
    totals: list[Counter] = [Counter() for _ in several]
    for html in pages:
        nodes = Page.of(html).nodes
        nodes[0].label = FRAME
        for node in nodes[1:]:
            if node.label is None:
                node.label = nodes[node.parent].label
            pairs[nodes[node.parent].label][node.label] += 1
            for e in evidence(node):
                counts[node.label][e] += 1
                totals[node.label][e.split()[0]] += 1
    known = set().union(*counts)
    kinds = Counter(e.split()[0] for e in known)
    seen = {}
    for e in known:
        kind = e.split()[0]
        seen[e] = tuple(math.log((counts[y][e] + added)
                                 / (totals[y][kind] + added * (kinds[kind] + 1)))
                        for y in several)
    return Model([float(y == FRAME) or 1e-300 for y in several],
                 [[n / sum(row) for n in row] for row in pairs], seen)


# Names that builders of pages give to what is not content, and to what is.
_BESIDE = {
    "nav": ("nav navigation menu navbar", "ul"), "header": ("header masthead banner top", "mix"),
    "footer": ("footer bottom copyright colophon", "mix"),
    "aside": ("sidebar aside related widget", "ul"),
    "ad": ("ad ads advert sponsor promo banner", "short"),
    "notice": ("cookie notice consent alert newsletter", "short"),
    "comments": ("comments comment respond discussion replies", "comments"),
    "form": ("search login subscribe form", "form"),
    "share": ("share social breadcrumbs tags", "ul"),
}
_CONTENT = "content article post entry story main body text"


def labelled_pages(count: int = PAGES, seed: int = 1) -> Iterator[str]:
    """Pages of many layouts; every block element says whether it is content."""
    pick = random.Random(seed)

    def words(low: int, high: int, stop: bool = True) -> str:
        n = pick.randint(low, high)
        text = " ".join("".join(pick.choices("aeinorstlu", k=pick.randint(1, 9)))
                        for _ in range(n))
        if pick.random() < 0.1:
            text = text.upper()
        return text + (pick.choice(".!?") if stop and pick.random() < 0.9 else "")

    def element(tag: str, label: int | str, inner: str, name: str = "") -> str:
        how = f' {pick.choice(("class", "id"))}="{name}"' if name else ""
        end = "" if tag in ("p", "li") and pick.random() < 0.2 else f"</{tag}>"
        return f'<{tag}{how} {LABEL}="{label}">{inner}{end}'

    def links(label: int, n: int) -> str:
        return element("ul", label, "".join(element(
            "li", label, f'<a href="/x">{words(1, 4, False)}</a>') for _ in range(n)))

    def beside(kind: str) -> str:
        names, what = _BESIDE[kind]
        name = pick.choice(names.split()) if pick.random() < 0.7 else ""
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") else "div"
        if tag != kind and not name:
            name = names.split()[0]
        if tag == kind and pick.random() < 0.25:
            tag, name = "div", pick.choice(names.split())
        inner = {
            "ul": lambda: links(0, pick.randint(2, 9)),
            "mix": lambda: words(2, 14) + (links(0, 3) if pick.random() < 0.4 else ""),
            "short": lambda: words(2, 25) if pick.random() < 0.5 else element(
                "p", 0, words(3, 25)),
            "comments": lambda: element("h3", 0, words(1, 2, False)) + "".join(element(
                pick.choice(("div", "p", "li")), 0, words(3, 50),
                pick.choice(("", "comment", "reply"))) for _ in range(pick.randint(1, 6))),
            "form": lambda: element("label", 0, words(1, 3, False)) + "<input>" + element(
                "button", 0, words(1, 2, False)),
        }[what]()
        return element(tag, 0, inner, name)

    def paragraph() -> str:
        n = pick.choice((2, 8, 30, 90))
        text = words(1, n)
        if pick.random() < 0.3:
            text = f"<b>{text}" + ("</b>" if pick.random() < 0.5 else "<br>")
        if pick.random() < 0.2:
            text += f' <a href="/y">{words(1, 3, False)}</a> {words(3, 12)}'
        return element("p", 1, text)

    def parts_of_article() -> str:
        parts = [element("h1", 1, words(2, 14, False))] if pick.random() < 0.8 else []
        for _ in range(pick.randint(1, 9)):
            roll = pick.random()
            if roll < 0.72:
                parts.append(paragraph())
            elif roll < 0.8:
                parts.append(element(pick.choice(("h2", "h3")), 1, words(1, 8, False)))
            elif roll < 0.86:
                parts.append(element(pick.choice(("ul", "ol")), 1, "".join(
                    element("li", 1, words(2, 20)) for _ in range(pick.randint(2, 5)))))
            elif roll < 0.9:
                parts.append(element("blockquote", 1, paragraph()))
            elif roll < 0.93:
                parts.append(element("pre", 1, words(3, 30)))
            elif roll < 0.96:
                parts.append(element("table", 1, element("tr", 1, "".join(
                    element("td", 1, words(1, 4, False)) for _ in range(3)))))
            else:
                parts.append(beside(pick.choice(("ad", "share", "notice"))))
        return "".join(parts)

    def article() -> str:
        if pick.random() < 0.6:
            return element("article", 1, parts_of_article(),
                           pick.choice(("", *_CONTENT.split())))
        tag = pick.choice(("div", "main", "section"))
        return element(tag, 1, parts_of_article(), pick.choice(_CONTENT.split()))

    for _ in range(count):
        before = [beside(k) for k in pick.sample(
            ("nav", "header", "ad", "notice", "form", "share"), pick.randint(0, 4))]
        after = [beside(k) for k in pick.sample(
            ("footer", "aside", "comments", "ad", "form", "share"), pick.randint(0, 5))]
        middle = article() if pick.random() < 0.9 else parts_of_article()
        whole = "".join([*before, middle, *after])
        if pick.random() < 0.4:
            whole = element("div", "frame", whole,
                            pick.choice(("page", "wrapper", "container")))
        end = "</body></html>" if pick.random() < 0.8 else ""
        yield (f'<!DOCTYPE html><html {LABEL}="frame"><head {LABEL}="0"><title>x</title></head>'
               f'<body {LABEL}="frame">{whole}{end}')


def extract(pages: DataFrame, html: str = "html", text: str = "text",
            model: Model | None = None) -> DataFrame:
    """The pages with their main text and ``n_chars``, its number of code points."""
    model = model or train(labelled_pages())
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in pages.schema.fields if f.name not in (text, "n_chars")]
    schema = T.StructType([*kept, T.StructField(text, T.StringType(), False),
                           T.StructField("n_chars", T.LongType(), False)])
    names = schema.names

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            texts = [own.text(h) for h in batch.column(at[html]).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(at[f.name]) for f in kept]
                + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    return pages.mapInArrow(each, schema)
