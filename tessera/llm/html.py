"""Main text of HTML pages: the maximum-scoring contiguous run of words and tags, with weights from labelled pages.

A page is read once into texts and tags with the elements that they stand in. Elements have
features (names of sections, parts of class and id names, roles, whether hidden), blocks of text
have others (kind, length, share of links). A logistic model over both, learned from
labelled_pages.py, gives each word the log odds of main text, 0 at least; tags score negative, by
their names' odds. One scan finds the best run. Within it, elements whose own features make them
unlikely (the weight of an element's surroundings halves with each element that has features)
are left out, as menus, adverts or comments within an article are.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, table
from tessera.llm.labelled_pages import labelled_pages

TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|([!?/]))")
#: The end of a tag, or the beginning of a quoted value in it.
TAG_STOP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
CLASS = re.compile(r"\bclass\s*=\s*[\"']?([^\"'>]*)", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SECTIONS = frozenset("address article aside button dialog fieldset footer form header label legend main menu nav noscript option section select".split())
CONTROLS = ("button", "label", "legend", "option", "select")
KINDS = {"p": "p", "blockquote": "p", "pre": "p", "li": "li", "dd": "li", "dt": "li", "td": "cell", "th": "cell", "figcaption": "caption", "caption": "caption"} | {"h1": "title"} | {f"h{k}": "heading" for k in range(2, 7)}
#: What a start tag ends: names, and the names beyond which it doesn't look.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "table")), "dt": (("dt", "dd"), ("dl", "table")), "dd": (("dt", "dd"), ("dl", "table")), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "tbody": (("thead", "tbody"), ("table",)), "tfoot": (("thead", "tbody"), ("table",)), "a": (("a",), ("p", "div", "li", "td", "section", "article", "table")), "option": (("option",), ("select",)),
}
#: Elements that entries of a discussion may be.
ENTRIES = frozenset("article blockquote div li p section".split())
HOLDS_P = ("table", "td", "th", "caption", "object")

#: How much of an element's log odds is left below an element that has features of its own.
FADE = 0.5
#: Elements with log odds below this are left out.
ASIDE = -1.0
#: An element with this share of the page's words has a feature for it.
BIG = 0.5
#: Words of the line above an entry of a discussion at most, and of the entry at least.
BYLINE, LEAST_POST = 6, 4
#: Attributes of more characters are read anew each time.
LONG_TAG = 512
#: What the tags of elements that are left out cost at most, one after another, until a word of main text stands between them.
ASIDE_MOST = 8.0
RIDGE = 0.1
LEAST_COST, MOST_COST = 0.2, 1.0

TEXT, OPEN, CLOSE = 0, 1, 2


@dataclass
class Page:
    """Events (kind, place, text or name, element) in page order, and for each element its parent, name, tag and features of its texts."""

    events: list[tuple[int, int, str, int]] = field(default_factory=list)
    parent: list[int] = field(default_factory=lambda: [0])
    name: list[str] = field(default_factory=lambda: [""])
    attributes: list[str] = field(default_factory=lambda: [""])
    kind: list[str] = field(default_factory=lambda: ["other"])
    link: list[bool] = field(default_factory=lambda: [False])
    section: list[str] = field(default_factory=lambda: [""])
    words: list[int] = field(default_factory=lambda: [0])


def _tag_end(page: str, at: int, gone: dict[str, bool]) -> int:
    """Where the tag whose name ends at at ends; a quote that is never closed is a character like others (gone says that none is left)."""
    while m := TAG_STOP.search(page, at):
        at = m.end()
        if (quote := m.group(1)) is None:
            return at
        if not gone.get(quote):
            close = page.find(quote, at)
            if close < 0:
                gone[quote] = True
            else:
                at = close + 1
    return len(page)


def read_page(page: str) -> Page:
    """Texts and tags with their elements; tags that are missing, crossed or cut off are taken as browsers take them. Time grows with the page's length alone."""
    out = Page()
    events, stack = out.events, [0]
    opened: dict[str, list[int]] = {}
    blocks = [0]
    gone: dict[str, bool] = {}
    at, end = 0, len(page)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[out.name[stack.pop()]].pop()
        while blocks[-1] >= depth:
            blocks.pop()

    def deepest(names) -> int:
        return max((opened[n][-1] for n in names if opened.get(n)), default=0)

    def end_open(names, barrier) -> None:
        if (found := deepest(names)) and found > deepest(barrier):
            pop_to(found)

    while at < end:
        m = TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            text = html.unescape(page[at:stop])
            events.append((TEXT, at, text, stack[-1]))
            out.words[stack[-1]] += len(text.split())
        if not m:
            break
        at = m.end()
        if m.group(3):
            if page.startswith("!--", m.start() + 1):
                a = m.start() + 4
                short = next((s for s in (">", "->") if page.startswith(s, a)), None)
                close = a if short else page.find("-->", a)
                at = a + len(short) if short else (close + 3 if close >= 0 else end)
            else:
                close = page.find(">", at)
                at = close + 1 if close >= 0 else end
            continue
        name, closing, begin = m.group(2).lower(), bool(m.group(1)), at
        at = _tag_end(page, at, gone)
        if at == end and page[end - 1 : end] != ">":
            break
        if closing:
            places = opened.get(name)
            if places and (name in BLOCKS or blocks[-1] <= places[-1]):
                pop_to(places[-1])
            events.append((CLOSE, m.start(), name, stack[-1]))
            continue
        attributes = page[begin : at - 1]
        if name in RAW:
            events.append((OPEN, m.start(), name, stack[-1]))
            if not gone.get(name):
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if close:
                    after = page.find(">", close.end())
                    at = after + 1 if after >= 0 else end
                elif name in ("script", "style"):
                    at = end
                else:
                    gone[name] = True
            continue
        if name in BLOCKS and name != "br":
            end_open(("p", *CONTROLS), HOLDS_P)
        if name in ENDS:
            end_open(*ENDS[name])
        events.append((OPEN, m.start(), name, stack[-1]))
        if name in VOID:
            continue
        up = stack[-1]
        opened.setdefault(name, []).append(len(stack))
        if name in BLOCKS:
            blocks.append(len(stack))
        stack.append(len(out.name))
        out.parent.append(up)
        out.name.append(name)
        out.attributes.append(attributes)
        out.kind.append(KINDS.get(name, "other" if name in BLOCKS else out.kind[up]))
        out.link.append(out.link[up] or name == "a")
        out.section.append(name if name in SECTIONS else out.section[up])
        out.words.append(0)
    for e in range(len(out.name) - 1, 0, -1):
        out.words[out.parent[e]] += out.words[e]
    return out


def _own_features(name: str, attributes: str) -> tuple[str, ...]:
    """Features that an element's tag says: its section name, parts of class and id names, role, hidden. Those of short tags are kept."""
    return _kept_features(name, attributes) if len(attributes) <= LONG_TAG else _tag_features(name, attributes)


@lru_cache(maxsize=20_000)
def _kept_features(name: str, attributes: str) -> tuple[str, ...]:
    return _tag_features(name, attributes)


def _tag_features(name: str, attributes: str) -> tuple[str, ...]:
    found = {f"section {name}"} if name in SECTIONS else set()
    if attributes and name not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if key in ("class", "id"):
                for token in value.split():
                    parts = [p.lower() for p in NAME_PART.findall(token)]
                    found.update(f"name {p}" for p in parts)
                    if len(parts) > 1:
                        found.add("whole " + " ".join(parts))
            elif key == "role":
                found.add(f"role {value.lower()}")
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDING.search(value)):
                found.add("hidden")
    return tuple(sorted(found))


def posts(page: Page) -> set[int]:
    """Elements that look like entries of a discussion: three siblings or more of the same tag and class, each a short line that is no heading, then a longer text."""
    first: dict[int, tuple[int, str]] = {}
    for words, _, held in blocks_of(page):
        e = page.events[held[0]][3]
        kind = page.kind[e]
        while e and e not in first:
            first[e] = (words, kind)
            e = page.parent[e]
    alike: dict[tuple[int, str, str], list[int]] = {}
    for e in range(1, len(page.name)):
        if page.name[e] in ENTRIES:
            m = CLASS.search(page.attributes[e])
            alike.setdefault((page.parent[e], page.name[e], m.group(1).lower() if m else ""), []).append(e)
    fits = lambda e: e in first and first[e][0] <= BYLINE and first[e][1] not in ("heading", "title", "caption", "cell") and page.words[e] >= first[e][0] + LEAST_POST
    return {e for some in alike.values() if len(some) >= 3 and 3 * sum(map(fits, some)) >= 2 * len(some) for e in some}


def element_features(page: Page, known=None) -> list[tuple[str, ...]]:
    """The features of each element, of those known (all, if None); () for an element without any."""
    total = max(1, page.words[0])
    out: list[tuple[str, ...]] = [()]
    entries = posts(page)
    for e in range(1, len(page.name)):
        name = page.name[e]
        found = _own_features(name, page.attributes[e])
        if e in entries:
            found = (*found, "post")
        if found:
            if name in SECTIONS and (around := page.section[page.parent[e]]):
                found = (*found, f"section {name} in {around}")
            if known is not None:
                found = tuple(f for f in found if f in known)
            if found:
                found = (*found, f"kind {KINDS[name]}") if name in KINDS else found
                if page.words[e] >= BIG * total:
                    found = (*found, "big")
        out.append(found)
    return out


def blocks_of(page: Page) -> list[tuple[int, int, list[int]]]:
    """(words, words in links, events) of each block: the texts between two tags that break blocks."""
    out, words, linked, held = [], 0, 0, []
    for k, (kind, _, text, e) in enumerate(page.events):
        if kind == TEXT:
            if n := len(text.split()):
                words, linked = words + n, linked + n * page.link[e]
                held.append(k)
        elif text in BLOCKS and held:
            out.append((words, linked, held))
            words, linked, held = 0, 0, []
    return [*out, (words, linked, held)] if held else out


def _block_features(kind: str, words: int, linked: int) -> tuple[str, ...]:
    length = 0 if words < 4 else 1 if words < 10 else 2 if words < 25 else 3
    links = 0 if not linked else 1 if 2 * linked < words else 2
    return ("", f"text {kind}", f"length {length}", f"links {links}", f"text {kind} links {links}", f"text {kind} length {length}")


@dataclass(frozen=True)
class Weights:
    """Log odds of main text: of features of elements and of blocks, and (negative) of tags by name."""

    elements: dict[str, float]
    blocks: dict[str, float]
    tags: dict[str, float]

    def odds(self, page: Page) -> list[float]:
        """Log odds of each element from its and its surroundings' features."""
        get, out = self.elements.get, [0.0]
        for e, found in enumerate(element_features(page, self.elements)):
            if e:
                up = out[page.parent[e]]
                out.append(FADE * up + sum(get(f, 0.0) for f in found) if found else up)
        return out

    def scores(self, page: Page, odds: list[float]) -> list[float]:
        """The score of each event: words of a block have its log odds, 0 at least and 0 in elements left out; tags are negative, in elements left out up to a bound."""
        out = [0.0] * len(page.events)
        for words, linked, held in blocks_of(page):
            local = sum(self.blocks.get(f, 0.0) for f in _block_features(page.kind[page.events[held[0]][3]], words, linked))
            for k in held:
                _, _, text, e = page.events[k]
                if odds[e] >= ASIDE:
                    out[k] = len(text.split()) * max(0.0, local + odds[e])
        spent = 0.0
        for k, (kind, _, name, e) in enumerate(page.events):
            if kind == TEXT:
                spent = 0.0 if out[k] > 0 else spent
            elif odds[e] >= ASIDE:
                out[k] = self.tags.get(name, -0.5)
            elif spent < ASIDE_MOST:
                out[k] = self.tags["aside"]
                spent -= out[k]
        return out


def _logistic(rows: list[dict[str, float]], y: np.ndarray, n: np.ndarray, offset: np.ndarray) -> dict[str, float]:
    """Weights of features by ridge logistic regression (Newton's steps) over rows with weights n and log odds known so far."""
    names = sorted({f for r in rows for f in r})
    place = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for k, r in enumerate(rows):
        for f, v in r.items():
            x[k, place[f]] = v
    w = np.zeros(len(names))
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(offset + x @ w, -30, 30)))
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(names))
        w = w + np.linalg.solve(hess, x.T @ (n * (y - p)) - RIDGE * w)
    return {f: float(v) for f, v in zip(names, w)}


def learn(pages: list[list[tuple[int, str]]]) -> Weights:
    """Weights from pages given as runs (1: main text, HTML): first of elements by themselves, then of blocks given their elements' odds."""
    around, local, y, n, seen = [], [], [], [], {}
    for runs in pages:
        page = read_page("".join(x for _, x in runs))
        bounds, at = [], 0
        for main, x in runs:
            at += len(x)
            bounds.append((at, main))
        main_at = lambda place: next((m for to, m in bounds if place < to), 0)  # noqa: E731, B023
        paths: list[dict[str, float]] = [{}]
        for e, found in enumerate(element_features(page)):
            if e:
                path = {f: FADE * v for f, v in paths[page.parent[e]].items()} if found else paths[page.parent[e]]
                paths.append(path | {f: path.get(f, 0.0) + 1.0 for f in found} if found else path)
        for words, linked, held in blocks_of(page):
            _, place, text, e = page.events[held[0]]
            around.append(paths[e])
            local.append({f: 1.0 for f in _block_features(page.kind[e], words, linked)})
            y.append(main_at(place + text.find("w")))
            n.append(math.sqrt(words))
        for kind, place, name, _ in page.events:
            if kind != TEXT:
                seen.setdefault(name, [1, 1])[main_at(place)] += 1
    y, n = np.array(y, float), np.array(n, float)
    elements = _logistic(around, y, np.ones(len(y)), np.zeros(len(y)))
    odds = np.array([sum(elements[f] * v for f, v in r.items()) for r in around])
    blocks = _logistic(local, y, n, odds)
    total = [sum(c[k] for c in seen.values()) for k in (0, 1)]
    tags = {t: -min(MOST_COST, max(LEAST_COST, math.log(c[0] / total[0] * total[1] / c[1]))) for t, c in seen.items()}
    return Weights(elements, blocks, tags | {"aside": -MOST_COST})


@lru_cache(maxsize=1)
def weights() -> Weights:
    """The weights of the labelled pages."""
    return learn(labelled_pages())


def best_run(scores: list[float]) -> tuple[int, int]:
    """(from, to) of the run with the greatest sum: of equals the first to end, and of these the shortest; (0, 0) if none is above 0."""
    best, best_from, best_to = 0.0, 0, 0
    score, begin = 0.0, 0
    for k, s in enumerate(scores):
        if score <= 0:
            score, begin = 0.0, k
        score += s
        if score > best:
            best, best_from, best_to = score, begin, k + 1
    return best_from, best_to


def main_text(page: str | None, by: Weights | None = None) -> str:
    """The blocks of the best run, one to a line; '' if no run of words and tags scores above nothing."""
    if not page:
        return ""
    by = by or weights()
    read = read_page(page)
    odds = by.odds(read)
    begin, end = best_run(by.scores(read, odds))
    blocks, held = [], []
    for kind, _, text, e in read.events[begin:end]:
        if kind == TEXT:
            if odds[e] >= ASIDE:
                held.append(text)
        elif text in BLOCKS:
            blocks.append(" ".join("".join(held).split()))
            held = []
    blocks.append(" ".join("".join(held).split()))
    return "\n".join(b for b in blocks if b)


_TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    text is the main text of the whole page: character references decoded, white space inside a
    block one blank, blocks one to a line; elements that the learned weights take for menus,
    headers, footers, sidebars, notices, adverts, forms or comments are left out. Null and empty
    pages, and pages without main text, give ''. Rows come out as often as they went in, ids and
    urls may be null, an empty table gives an empty one; further columns are ignored. Malformed
    markup is read as browsers read it, in time in proportion to the page's length; a tag, comment
    or script that is cut off by the end of the page goes with it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    learned = weights()

    def run(batches):
        for whole in batches:
            for b in small_batches(whole, "html", 8 << 20):
                found = [main_text(p, learned) for p in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], schema=_TEXTS)

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_max_subsequence_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page of the table pages."""
    return extract_pages(table(spark, sf_dir, "pages"))
