"""Main text of web pages by a conditional random field over leaf blocks.

A page is read into blocks: runs of text between block-level tags. Each block has
features of its ancestors (tags, words of class, id and role) and of its text
(length, share of linked text, closing mark, capitals, place). A linear chain of two
labels, article or not, is trained on labelled pages by gradient ascent on the
conditional likelihood and decoded by Viterbi; the article's blocks, in page order, are the text.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringweave.llm.bpe import groups
from ringweave.llm.common import table

# fixed values: element kinds of HTML
RAW = "script style textarea title noscript iframe xmp noembed noframes template select canvas object audio video"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul button label".split()
)
CLOSES = {  # an opening tag ends these open ones, up to the nearest of its bounds
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, set()),
}

SECTIONS = set("article main nav header footer aside form section dialog fieldset".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW.replace(' ', '|')})(?=[\s/>])(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>"
    r"|<[!?/][^>]*+>|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
ATTR = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s\"'>]++)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# a tag or comment of svg and math content, whose elements may close themselves
FOREIGN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/a-zA-Z][^>]*+(?:>|\Z)",
    re.S,
)
UNQUOTED = re.compile(r"=\s*[^\s\"'>]*/\Z")
# fixed values: HTML elements that end svg and math content, and elements of it that may hold HTML
LEAVES = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong "
    "strike sub sup table tt u ul var".split()
)
HOLDS = set("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
CLOSING = tuple(".!?:;。！？…\"'”»)")


@dataclass(slots=True)
class Block:
    text: str
    features: list[str]


@dataclass(slots=True)
class Open:
    name: str
    start: int  # how many features of open elements come before its own
    parts: tuple[str, ...] = ()  # the last two sectioning elements from the root to this one
    names: tuple[str, ...] = ()  # the nearest element that sections, hides or has class, id or role


def named(attrs: str) -> tuple[str, ...]:
    """What counts among the attributes: "hidden", and the values of class, id and role, in their order."""
    out = []
    for key, *values in ATTR.findall(attrs):
        key, value = key.lower(), values[0] or values[1] or values[2]
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and UNSEEN.search(value):
            out.append("hidden")
        elif key in ("class", "id", "role"):
            out.append(f"={value}")
    return tuple(out)


def element_features(name: str, attrs: str) -> tuple[str, ...]:
    values = named(attrs) if attrs else ()
    # the memo holds short keys only, so it stays small
    return (known_features if len(name) + sum(map(len, values)) < 500 else features_of)(name, values)


def features_of(name: str, values: tuple[str, ...]) -> tuple[str, ...]:
    out = [f"in {name}"]
    for value in values:
        out += [f"name {w.lower()}" for w in PART.findall(value) if len(w) > 1] if value[0] == "=" else [value]
    return tuple(out)


known_features = lru_cache(1 << 14)(features_of)


def closes_itself(attrs: str) -> bool:
    return attrs.endswith("/") and not UNQUOTED.search(attrs)


def after_foreign(page: str, name: str, at: int) -> int:
    """Where the content of a svg or math element that opened before ``at`` ends: after its closing tag,
    or before the HTML element that ends it where it was never closed."""
    depth, held = 1, 0
    for m in FOREIGN.finditer(page, at):
        if not m["name"]:
            continue
        own = m["name"].lower()
        if own == name:
            depth += -1 if m["end"] else not closes_itself(m["attrs"])
            if not depth:
                return m.end()
        elif own in HOLDS:
            held = max(0, held - 1) if m["end"] else held + (not closes_itself(m["attrs"]))
        elif own in LEAVES and not held and (not m["end"] or own in ("p", "br")):
            return m.start()
    return len(page)


def blocks_of(page: str, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks with text, in page order; elements at any depth have their features, those in ``known`` if it is given."""
    out: list[Block] = []
    stack = [Open("", 0)]
    active: dict[str, None] = {}  # features of the open elements, from the root on
    opened: Counter[str] = Counter()  # open elements by name
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        raw = "".join(parts)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            top = stack[-1]
            path = ("", *top.parts)[-2:]
            places = [f"under {' > '.join(path)}", f"nearest {path[-1]} {top.name}", f"nearest {path[-1]}"]
            out.append(Block(text, [*active, *places, *top.names, f"tag {top.name}", *text_features(text, linked / max(len(raw), 1))]))
        parts.clear()
        linked = 0

    def close(place: int) -> None:
        for _ in range(len(active) - stack[place].start):
            active.popitem()
        opened.subtract(e.name for e in stack[place:])
        del stack[place:]

    while m := TOKEN.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, closing, attrs = name.lower(), m["end"] or m["end2"], m["attrs"] or m["attrs2"] or ""
        if name in ("svg", "math"):
            if not closing and not closes_itself(attrs):
                at = after_foreign(page, name, at)
        elif name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        elif name in BLOCK:
            flush()
            if closing:
                in_link = False
                if opened[name]:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            elif name not in VOID:
                if name in BLOCK - {"button", "label", "option"}:
                    place = next((i for i in range(len(stack) - 1, max(0, len(stack) - 3), -1) if stack[i].name == "p"), 0)
                    if place:
                        close(place)
                ends, bounds = CLOSES.get(name, ((), ()))
                i = len(stack) - 1
                while i > 0 and stack[i].name not in bounds and any(opened[e] for e in ends):
                    if stack[i].name in ends:
                        close(i)
                    i -= 1
                above, features = stack[-1], element_features(name, attrs)
                own = tuple([f"own {f}" for f in features if f[:2] != "in" or name in SECTIONS])
                stack.append(Open(name, len(active), (*above.parts, name)[-2:] if name in SECTIONS else above.parts, own or above.names))
                opened[name] += 1
                for f in features:
                    if known is None or f in known:
                        active.setdefault(f)
    parts.append(page[at:])
    flush()
    for i, b in enumerate(out):
        b.features += [f"from start {min(i, 4)}", f"from end {min(len(out) - 1 - i, 4)}"]
    return out


def text_features(text: str, linked: float) -> list[str]:
    words = text.count(" ") + 1
    letters = [c for c in text if c.isalpha()]
    return [
        f"words {min(words, 64).bit_length()}",
        f"linked {min(4, int(linked * 5))}",
        "closed" if text.endswith(CLOSING) else "open",
        "capitals" if letters and sum(c.isupper() for c in letters) > 0.8 * len(letters) else "mixed",
        "signed" if text.startswith(("©", "(c)", "Copyright")) else "unsigned",
        "long" if words > 12 else "short",
        f"long {'closed' if text.endswith(CLOSING) else 'open'} {words > 12} {linked > 0.4}",
    ]


class Crf:
    """Two labels (1: article) in a chain; ``weights[f, label]``, ``moves[before, after]``, ``first[label]``."""

    def __init__(self, names: dict[str, int]) -> None:
        self.names = names
        self.weights, self.moves, self.first = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)

    def rows(self, features: list[str]) -> list[int]:
        return [self.names[f] for f in features if f in self.names]

    def emissions(self, rows: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((i for r in rows for i in r), np.int64, int(sizes.sum()))
        sums = np.concatenate([np.zeros((1, 2)), np.cumsum(self.weights[flat], axis=0)])
        ends = np.cumsum(sizes)
        return sums[ends] - sums[ends - sizes]

    def decode(self, pages: list[list[list[int]]]) -> list[np.ndarray]:
        """Viterbi labels of each page; pages of like length go side by side."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        for lo in range(0, len(order), 64):
            some = order[lo : lo + 64]
            sizes = [len(pages[i]) for i in some]
            score = np.zeros((len(some), max(sizes), 2))
            for k, e in enumerate(np.split(self.emissions([r for i in some for r in pages[i]]), np.cumsum(sizes)[:-1])):
                score[k, : len(e)] = e
            best, back = score[:, 0] + self.first, np.zeros((len(some), max(sizes), 2), np.int8)
            ends = np.zeros((len(some), 2))
            for t in range(max(sizes)):
                if t:
                    both = best[:, :, None] + self.moves
                    back[:, t] = both.argmax(1)
                    best = both.max(1) + score[:, t]
                last = np.array(sizes) == t + 1
                ends[last] = best[last]
            for k, i in enumerate(some):
                label = int(ends[k].argmax())
                path = np.zeros(sizes[k], np.int8)
                for t in range(sizes[k] - 1, -1, -1):
                    path[t] = label
                    label = int(back[k, t, label])
                out[i] = path
        return out

    def fit(self, pages: list[list[list[int]]], labels: list[list[int]], rounds: int = 80, rate: float = 0.5, ridge: float = 0.001) -> None:
        """Adaptive gradient ascent on the conditional likelihood of all pages together."""
        n, width = len(pages), max(map(len, pages))
        flat_rows = [r for p in pages for r in p]
        sizes = np.fromiter(map(len, flat_rows), np.int64, len(flat_rows))
        flat = np.fromiter((i for r in flat_rows for i in r), np.int64, int(sizes.sum()))
        held = np.arange(width) < np.array([len(p) for p in pages])[:, None]
        gold = np.zeros((n, width), np.int64)
        gold[held] = [y for ys in labels for y in ys]
        step = {k: np.full_like(getattr(self, k), 1e-8) for k in ("weights", "moves", "first")}
        last = held.sum(1) - 1
        for _ in range(rounds):
            e = np.zeros((n, width, 2))
            e[held] = self.emissions(flat_rows)
            ahead, behind = np.zeros((n, width, 2)), np.zeros((n, width, 2))
            ahead[:, 0] = e[:, 0] + self.first
            for t in range(1, width):
                ahead[:, t] = np.logaddexp.reduce(ahead[:, t - 1, :, None] + self.moves, axis=1) + e[:, t]
            for t in range(width - 2, -1, -1):
                step_back = np.logaddexp.reduce(self.moves + (e[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
                behind[:, t] = np.where((t < last)[:, None], step_back, 0)
            total = np.logaddexp.reduce(ahead[np.arange(n), last], axis=1)
            node = np.exp(ahead + behind - total[:, None, None])
            pair = np.exp(ahead[:, :-1, :, None] + self.moves + (e + behind)[:, 1:, None, :] - total[:, None, None, None]) * held[:, 1:, None, None]
            wrong = np.eye(2)[gold] - node
            slope = {"weights": np.zeros_like(self.weights), "first": wrong[:, 0].sum(0)}
            per_block = np.repeat(wrong[held], sizes, axis=0)
            for k in (0, 1):
                slope["weights"][:, k] = np.bincount(flat, per_block[:, k], len(self.names))
            seen = np.zeros((2, 2))
            np.add.at(seen, (gold[:, :-1][held[:, 1:]], gold[:, 1:][held[:, 1:]]), 1)
            slope["moves"] = seen - pair.sum((0, 1))
            for k, g in slope.items():
                g = g / n - ridge * getattr(self, k)
                step[k] += g * g
                setattr(self, k, getattr(self, k) + rate * g / np.sqrt(step[k]))


# labelled pages: words that name parts of pages, by the part they name
PARTS = {
    "nav": "nav navigation navbar menu menubar topnav breadcrumb breadcrumbs toc links skip tabs",
    "header": "header masthead banner top topbar logo branding site",
    "footer": "footer bottom copyright colophon legal imprint credits",
    "aside": "sidebar aside side rail widget widgets tags tagcloud categories archive popular trending",
    "notice": "cookie cookies consent gdpr notice alert warning message popup modal overlay dialog toast privacy announcement paywall",
    "ad": "ad ads advert advertisement advertising sponsor sponsored promo promotion adsense banner dfp teaser",
    "form": "form search login signup subscribe newsletter register contact field poll survey",
    "comments": "comment comments commentlist respond replies reply discussion disqus reviews thread feedback",
    "share": "share sharing social follow facebook twitter related recommended more next prev pagination pager author bio byline meta",
}
HOMES = "content main article post entry story body text page prose copy articlebody"
HIDDEN = (" hidden", ' aria-hidden="true"', ' style="display:none"', ' style="color:red; display: none;"')
INSIDE = ("ad", "ad", "ad", "share", "aside", "form", "notice", "nav", "comments", "comments", "hidden")  # what articles hold that is not theirs
NEUTRAL = "wrapper container row col inner outer box block clearfix grid section left right module item view region"
MARKS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section", "ad": "aside", "notice": "div", "share": "div"}


class PageMaker:
    """Labelled pages of random layout; lines of text name their label."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        syllables = "ta re in lo mi ne su ka el or an is tu ve do pa chi que sch str".split()
        return " ".join("".join(self.r.choices(syllables, k=self.r.randint(1, 4))) for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        return self.words(6, 60).capitalize() + self.r.choice([".", ".", ".", "!", "?", ""])

    def named(self, words: str, extra: float = 0.4) -> str:
        word = self.r.choice(words.split())
        if self.r.random() < extra:
            word += self.r.choice(["-", "_", " "]) + self.r.choice(NEUTRAL.split())
        return f' {self.r.choice(["class", "class", "id"])}="{word}"'

    def article(self) -> Iterator[tuple[int, str]]:
        r = self.r
        title = r.random()
        if title < 0.65:
            yield 1, f"<h1>{self.words(2, 10)}</h1>"
        elif title < 0.8:
            yield -1, "<header>"
            yield 1, f"<h1>{self.words(2, 10)}</h1>"
            if r.random() < 0.6:
                yield 0, f'<p class="{r.choice(["byline", "meta", "author"])}">{self.words(1, 6)}</p>'
            yield -1, "</header>"
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.6:
                text = self.sentence() if r.random() < 0.75 else self.words(1, 6).capitalize() + r.choice([".", "", "!"])
                if r.random() < 0.2:
                    text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(1, 8)}.'
                if r.random() < 0.1:
                    text = text.upper()
                box = r.choice(["p"] * 9 + ["div"])
                yield 1, f"<{box}>{text}" + (r.choice(["</p>", "</p>", "</p>", "<br>", ""]) if box == "p" else "</div>")
            elif kind < 0.67:
                yield 1, f"<h{(h := r.randint(2, 4))}>{self.words(1, 7)}</h{h}>"
            elif kind < 0.74:
                for _ in range(r.randint(2, 5)):
                    yield 1, f"<li>{self.words(2, 14)}</li>"
            elif kind < 0.79:
                yield 1, f"<blockquote>{self.sentence()}</blockquote>"
            elif kind < 0.82:
                yield 1, f"<pre>{self.words(3, 20)}</pre>"
            elif kind < 0.85:
                for _ in range(r.randint(2, 6)):
                    yield 1, f"<td>{self.words(1, 4)}</td>"
            else:
                yield from self.part(r.choice(INSIDE))
        if r.random() < 0.1:
            yield from self.part(r.choice(["footer", "comments", "share"]))

    def part(self, kind: str) -> Iterator[tuple[int, str]]:
        """Something that is no article; its text may look like one."""
        r = self.r
        if kind == "hidden":  # looks like the article
            tag = r.choice(["div", "div", "section", "p"])
            count = 1 if tag == "p" else r.randint(1, 4)
            yield -1, f"<{tag}{r.choice(HIDDEN)}>"
            for _ in range(count):
                yield 0, self.sentence() if tag == "p" else f"<p>{self.sentence()}</p>"
            yield -1, f"</{tag}>"
            return
        semantic = r.random() < (0.7 if kind in ("header", "nav", "footer") else 0.2 if kind == "ad" else 0.4)
        tag = MARKS[kind] if semantic else "div"
        if kind in ("comments", "ad") and not semantic:
            tag = r.choice({"comments": ["div", "div", "ol", "ul"], "ad": ["div", "div", "p", "ins"]}[kind])
        name = "" if semantic and MARKS[kind] not in ("div", "section") and r.random() < 0.5 else self.named(PARTS[kind])
        yield -1, f"<{tag}{name}>"
        if r.random() < (0.5 if kind == "header" else 0.2):
            yield 0, f"<h{(h := 1 if kind == 'header' else r.randint(2, 4))}>{self.words(1, 5)}</h{h}>"
        for _ in range(r.randint(1, 6)):
            shape = r.random()
            if kind == "nav" or shape < 0.25:
                yield 0, f'<li><a href="/{r.randint(0, 99)}">{self.words(1, 3)}</a></li>'
            elif kind == "comments" or shape < 0.6:
                text = f"<p>{self.sentence()}</p>"
                yield 0, f"<li>{text}</li>" if tag in ("ol", "ul") else text if tag != "p" else self.sentence() + "<br><br>"
            elif kind == "footer" and shape < 0.8:
                yield 0, f"<p>&copy; {self.words(1, 9)}</p>"
            elif kind == "form":
                yield 0, f"<label>{self.words(1, 4)}</label><input name=q>"
            elif shape < 0.8:
                yield 0, f"<div>{self.words(1, 25)}</div>"
            else:
                yield 0, f"{self.words(1, 25)}" + r.choice([".", ""])
        yield -1, f"</{tag}>"

    def page(self) -> list[tuple[int, str]]:
        """Pieces of one page: label 1 or 0 of the block each holds, -1 where it holds none."""
        r = self.r
        if r.random() < 0.05:  # a bare text
            return [(1, self.sentence())] if r.random() < 0.4 else [(1, f"<p>{self.sentence()}</p>") for _ in range(r.randint(1, 5))]
        before = [k for k in ("header", "nav", "notice", "ad", "share", "form", "aside", "hidden") if r.random() < (0.15 if k == "hidden" else 0.45)]
        after = [k for k in ("share", "comments", "aside", "ad", "nav", "form", "notice", "footer", "hidden") if r.random() < (0.15 if k == "hidden" else 0.45)]
        r.shuffle(before)
        home = r.choice(["article", "article", "article", "main", "main", "named", "named", "both", "both", "plain", "none", "section", "cell"])
        opens = {"article": "<article>", "main": "<main>", "named": f"<div{self.named(HOMES)}>", "both": f"<main><article{self.named(HOMES)}>", "plain": "<div>", "none": "", "section": f"<section{self.named(HOMES)}>", "cell": "<table><tr><td>"}[home]
        closes = {"article": "</article>", "main": "</main>", "named": "</div>", "both": "</article></main>", "plain": "</div>", "none": "", "section": "</section>", "cell": "</td></tr></table>"}[home]
        out: list[tuple[int, str]] = [(-1, "<html><head><title>x</title></head><body>")]
        if wrapped := r.random() < 0.4:
            out.append((-1, f"<div{self.named(NEUTRAL)}>"))
        for k in before:
            out += self.part(k)
        out += [(-1, opens), *self.article(), (-1, closes)]
        for k in after:
            out += self.part(k)
        if wrapped:
            out.append((-1, "</div>"))
        return out


def labelled_pages(n: int, seed: int) -> Iterator[tuple[list[Block], list[int]]]:
    maker = PageMaker(seed)
    while n:
        pieces = maker.page()
        found, labels = blocks_of("".join(p for _, p in pieces)), [y for y, _ in pieces if y >= 0]
        if found and len(found) == len(labels):
            n -= 1
            yield found, labels


@cache
def trained(pages: int = 1200, seed: int = 1) -> Crf:
    """The field, fitted on ``pages`` labelled pages; a feature must occur in three of them."""
    found = list(labelled_pages(pages, seed))
    seen: dict[str, int] = {}
    for blocks, _ in found:
        for f in {f for b in blocks for f in b.features}:
            seen[f] = seen.get(f, 0) + 1
    crf = Crf({f: i for i, f in enumerate(sorted(f for f, k in seen.items() if k >= 3))})
    crf.fit([[crf.rows(b.features) for b in blocks] for blocks, _ in found], [labels for _, labels in found])
    return crf


def main_texts(crf: Crf, pages: list[str | None]) -> list[str]:
    found = [blocks_of(p or "", crf.names) for p in pages]
    labels = crf.decode([[crf.rows(b.features) for b in blocks] for blocks in found])
    return ["\n".join(b.text for b, y in zip(blocks, ys, strict=True) if y) for blocks, ys in zip(found, labels, strict=True)]


def main_text(df: DataFrame, crf: Crf | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of ``keep`` with ``text`` and ``n_chars`` (code points).

    A page that is null, empty or without article has an empty text. Repeated rows
    stay; other columns are left out.
    """
    crf = crf or trained()
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            texts = [t for some in groups(batch.column(0).to_pylist()) for t in main_texts(crf, some)]
            sizes = pa.array(list(map(len, texts)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(texts, pa.string()), sizes], [*keep, "text", "n_chars"])

    return df.select(F.col(html_col).cast("string").alias("_html"), *keep).mapInArrow(run, f"{fields}, text string, n_chars bigint")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
