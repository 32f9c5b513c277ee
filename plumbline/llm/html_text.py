"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks: runs of text between block-level tags, each with its place in the element tree. A linear
classifier gives every block a score for being content; the score is the capacity of its edge to the source (content) or to
the sink (boilerplate). Blocks that follow each other, and blocks next to each other among the children of an element, are
tied by edges whose capacity falls with their distance in the tree. The minimum cut is the labelling of least total cost:
a short paragraph follows its neighbours, a long link list does not. Blocks whose own score outweighs all their ties are
decided first, which changes no minimum; a maximum flow settles the rest.

Pages are independent, so nothing is shuffled. Defined cases: a null or empty page, and one without content, has the empty
text; an unfinished tag at the end is dropped; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose text is no text of the page.
SILENT = frozenset("script style template noscript textarea select option button svg iframe object audio video canvas head title datalist".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset("td th".split())
# Start tags that end an open paragraph, and which open siblings an element ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol menu dl table article section aside nav main header footer div form blockquote td th body html".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_TAGS = frozenset("nav footer aside menu dialog".split())
CONTENT_ROLES = frozenset("main article".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status note".split())
# Words of class and id attributes that mark boilerplate.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "notification popup modal overlay newsletter subscribe subscription signup login register share sharing social related recommend "
    "recommended recommendations sidebar aside widget widgets breadcrumb breadcrumbs pagination pager menu nav navbar navigation footer "
    "masthead topbar toolbar comment comments commentlist disqus reply replies respond copyright legal skip alert form search tags tagcloud "
    "byline-links rail teaser outbrain taboola header".split()
)
# Names of parts that are never the page's own text, however long, with all articles and entries in them.
FOREIGN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion related recommend recommended recommendations comment "
    "comments commentlist disqus reply replies respond teaser outbrain taboola footer cookie cookies consent gdpr notice notices notification "
    "popup modal newsletter subscribe subscription signup login register copyright legal alert search breadcrumb breadcrumbs pagination pager "
    "tags tagcloud share sharing social".split()
)
# In a class such as "has-sidebar" or "no-header" the words after these do not name the element itself.
MODIFIERS = frozenset("has have with without no hide show".split())
CONTENT_WORDS = frozenset("article content entry post story text main body prose".split())

CLOSED_PLACES = frozenset("boilerplate foreign".split())
BOILERPLATE_PLACES = CLOSED_PLACES | {"layout"}
# Classifier weights (log-odds of content) and tie capacities.
IN_BOILERPLATE, IN_CONTENT, CONTENT_NAME, OUTSIDE = -10.0, 4.0, 1.0, -1.0
# A layout element is a wrapper around the page's text if it holds more than this share of all linkless text, and what stands
# outside of all boilerplate is no more than this share of it.
WRAPPED, BESIDE = 0.5, 0.1
PER_WORD, MOST_BY_WORDS, SENTENCE, LINKS, HEADING, ITEM, COPYRIGHT = 0.15, 3.0, 1.0, -5.0, 0.5, -0.5, -2.0
FOLLOWS, SIBLINGS, APART, BORDER = 1.0, 0.8, 0.6, 0.1


class Block:
    """A run of text: its words' text, share of characters in links, element path, place, and the layout element it stands in."""

    __slots__ = ("text", "linked", "path", "tag", "place", "layout")

    def __init__(self, text: str, linked: int, path: tuple[int, ...], tag: str, place: str, layout: int):
        self.text, self.linked, self.path, self.tag, self.place, self.layout = text, linked, path, tag, place, layout

    def score(self) -> float:
        if self.place in BOILERPLATE_PLACES:
            return IN_BOILERPLATE
        words = len(self.text.split())
        score = IN_CONTENT if self.place == "content" else OUTSIDE + CONTENT_NAME * (self.place == "named")
        score += min(MOST_BY_WORDS, PER_WORD * words)
        score += SENTENCE * (words >= 5 and self.text[-1] in ".!?…:;\"'”»)")
        score += LINKS * min(1.0, self.linked / len(self.text))
        score += HEADING * (self.tag[:1] == "h" and self.tag[1:].isdigit()) + ITEM * (self.tag == "li")
        return score + COPYRIGHT * ("©" in self.text and self.place != "content")


def _unwrap(found: list[Block]) -> list[Block]:
    """``found``, where blocks of a layout element that is a wrapper around the page's text stand in no layout.

    A name alone makes a layout, so a wrapper called "sidebar" must not lose the article. Next to an article, a layout
    element stays boilerplate at any length.
    """
    if any(b.place == "content" for b in found):
        return found
    held: dict[int, int] = {}
    beside = total = 0
    for block in found:
        size = max(0, len(block.text) - block.linked)
        total += size
        if block.place == "layout":
            held[block.layout] = held.get(block.layout, 0) + size
        elif block.place not in BOILERPLATE_PLACES:
            beside += size
    wrappers = {k for k, size in held.items() if size > WRAPPED * total and beside <= BESIDE * size}
    for block in found:
        if block.place == "layout" and block.layout in wrappers:
            block.place = ""
    return found


def _named(value: str) -> set[str]:
    """Words of a class or id attribute that name the element."""
    words: set[str] = set()
    for token in value.split():
        for word in _TOKEN.findall(_CAMEL.sub(" ", token).lower()):
            if word in MODIFIERS:
                break
            words.add(word)
    return words


def _place(outer: str, name: str, attributes: str) -> str:
    """Where an element's text stands: the innermost element that says so counts.

    "boilerplate" is said by tags, roles and hiding, "layout" and "foreign" by names alone. Content tags, roles and names end
    a layout; only main ends the others.
    """
    words: set[str] = set()
    role = ""
    if attributes and name not in ("html", "body"):
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next((v for v in values if v), "")
            if key in ("class", "id"):
                words |= _named(value)
            elif key == "role":
                role = value.lower()
                if role in BOILERPLATE_ROLES - {"form"}:
                    return "boilerplate"
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                return "boilerplate"
    closed = outer in CLOSED_PLACES
    if role == "main" and outer != "boilerplate" or role == "article" and not closed:
        return "content"
    marks = words & BOILERPLATE_WORDS
    # A wrapper that names both ("content with-sidebar") says nothing.
    if marks and not (outer == "content" and marks == {"header"}) and (not words & CONTENT_WORDS or words & FOREIGN_WORDS):
        return outer if closed else "foreign" if words & FOREIGN_WORDS else "layout"
    if name in BOILERPLATE_TAGS:
        return "boilerplate"
    if name == "main" or name == "article" and not closed:
        return "content"
    if name == "header" and outer != "content":
        return "boilerplate"
    if name == "form" or role == "form":
        return outer if closed else "layout"
    if outer == "content" or closed:
        return outer
    return "named" if words & CONTENT_WORDS else outer


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order."""
    found: list[Block] = []
    # Open elements: name, number, place, silent, layout element, and the place and layout element of the innermost block.
    stack: list[tuple[str, int, str, bool, int, str, int]] = [("", 0, "", False, 0, "", 0)]
    parts: list[str] = []
    linked, links, number = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                at = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in BLOCKS or stack[k][0] in CELLS), 0)
                found.append(Block(text, linked, tuple(e[1] for e in stack[: at + 1]), stack[at][0], stack[-1][5], stack[-1][6]))
            parts.clear()
        linked = 0

    def close(at: int) -> None:
        nonlocal links
        links -= sum(1 for e in stack[at:] if e[0] == "a")
        del stack[at:]

    def say(text: str) -> None:
        nonlocal linked
        # Text of an inline element that is hidden, or an advert, is no part of the block around it.
        aside = stack[-1][2] in CLOSED_PLACES and stack[-1][5] not in BOILERPLATE_PLACES
        if text and not stack[-1][3] and not aside:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(" ".join(text.split()))

    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        if tag is None:
            say(page[at:])
            break
        say(page[at : tag.start()])
        at = tag.end()
        name = tag["name"]
        if name is None:
            continue
        if page[at - 1] != ">":  # the page ends inside a tag
            break
        name = name.lower()
        if name in BLOCKS:
            flush()
        elif name == "br" or name in CELLS:
            parts.append(" ")
        if tag["end"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    close(k)
                    break
                if name not in SCOPES and stack[k][0] in SCOPES:
                    break
            continue
        rest = tag["rest"]
        if name in BLOCKS or name in CLOSES:
            ended = CLOSES.get(name, set()) | ({"p"} if name in BLOCKS else set())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ended:
                    close(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
        if rest.endswith("/") and name in RAW:
            continue
        number += 1
        outer = stack[-1]
        place = _place(outer[2], name, rest)
        layout = (outer[4] if outer[2] == "layout" else number) if place == "layout" else 0
        block = (place, layout) if name in BLOCKS or name in CELLS else outer[5:]
        stack.append((name, number, place, outer[3] or name in SILENT, layout, *block))
        links += name == "a"
    flush()
    return _unwrap(found)


def ties(found: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between blocks that follow each other and between neighbours among the children of an element."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[tuple, int] = {}
    for k, block in enumerate(found):
        aside = block.place in BOILERPLATE_PLACES
        if k:
            shared = sum(1 for x, y in zip(block.path, found[k - 1].path, strict=False) if x == y)
            apart = len(block.path) + len(found[k - 1].path) - 2 * shared
            # The border of an element that is named as boilerplate is where the text does change.
            border = BORDER if aside != (found[k - 1].place in BOILERPLATE_PLACES) else 1.0
            edges[k - 1, k] = border * FOLLOWS * APART ** max(0, apart - 2)
        parent = (block.path[:-1], aside)
        if parent in last:
            pair = (last[parent], k)
            edges[pair] = edges.get(pair, 0.0) + SIBLINGS
        last[parent] = k
    return [(a, b, w) for (a, b), w in edges.items()]


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) of least cost: |score| for each node against its score, capacity for each cut edge.

    A node on which both labels cost the same gets the sink's.
    """
    n = len(scores)
    score, label = list(scores), [None] * n
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    bound = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        v = queue.popleft()
        if label[v] is not None or not (score[v] > bound[v] or -score[v] >= bound[v]):
            continue
        label[v] = score[v] > bound[v]
        for u, w in near[v].items():
            if label[u] is None:
                score[u] += w if label[v] else -w
                bound[u] -= w
                queue.append(u)
    rest = [v for v in range(n) if label[v] is None]
    if rest:
        open_ = {v: {u: w for u, w in near[v].items() if label[u] is None} for v in rest}
        side = _flow(score, open_)
        for v in rest:
            label[v] = v in side
    return [bool(x) for x in label]


def _flow(score: list[float], near: dict[int, dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow (level graphs and blocking flows)."""
    source, sink = -1, -2
    capacity: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for v, others in near.items():
        capacity[v] = dict(others)
    for v in near:
        capacity[source][v], capacity[v][source] = max(score[v], 0.0), 0.0
        capacity[v][sink], capacity[sink][v] = max(-score[v], 0.0), 0.0
    tiny = 1e-9
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            v = queue.popleft()
            for u, c in capacity[v].items():
                if c > tiny and u not in level:
                    level[u] = level[v] + 1
                    queue.append(u)
        if sink not in level:
            return set(level) - {source}
        todo = {v: iter(list(capacity[v])) for v in level}
        path = [source]
        while path:
            v = path[-1]
            if v == sink:
                flow = min(capacity[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    capacity[a][b] -= flow
                    capacity[b][a] += flow
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if capacity[a][b] <= tiny)
                del path[cut + 1 :]
                continue
            for u in todo[v]:
                if capacity[v][u] > tiny and level.get(u) == level[v] + 1:
                    path.append(u)
                    break
            else:
                path.pop()
                if path:
                    level[v] = -1


def labelled(page: str | None) -> list[tuple[str, bool]]:
    """Text of every block and whether it is content."""
    found = blocks(page or "")
    return [(b.text, keep) for b, keep in zip(found, minimum_cut([b.score() for b in found], ties(found)), strict=True)]


def main_text(page: str | None) -> str:
    return "\n".join(text for text, keep in labelled(page) if keep)


def extract(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """Per page: key, url, text and n_chars (code points of the text)."""
    schema = f"{key} long, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=[key, "url", "text", "n_chars"])

    return pages.select(F.col(key).cast("long").alias(key), F.col("url").cast("string").alias("url"), F.col(page).alias("page")).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Registered query op4: the main text of all pages."""
    from plumbline.llm.common import table

    return extract(table(spark, sf_dir, "pages"))
