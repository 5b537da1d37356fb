"""Operator 2: main text of web pages by minimum-cut labelling of their blocks.

A page becomes a row of text blocks. A logistic model over a block's own
figures and over what its containers are and are called says what each label
would cost; these costs are the capacities between the block and the two
terminals. Neighbouring blocks, and blocks of one container, are tied by edges
that cost something to cut. The maximum flow gives the cheapest labelling;
blocks on the content side, in page order, are the text. A block's own cost is
bounded, and where its containers say nothing its neighbours can outweigh it.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import map_arrow, materialise

TEXTS = "page_id long, url string, text string, n_chars long"
TRAIN_PAGES = 1000
TRAIN_BLOCKS = 64

_MARK = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_TAG_STOP = re.compile(r">|=\s*[\"']")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW = frozenset("""script style noscript template textarea title svg iframe xmp noembed noframes annotation
annotation-xml""".split())
MARKUP = frozenset("noscript template svg annotation annotation-xml".split())  # of RAW: hold elements, not raw text
DROPPED = frozenset("form button select option fieldset label input dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s
samp small span strike strong sub sup time tt u var wbr math semantics mi mn mo ms mtext mrow msup msub msubsup mfrac
msqrt mroot mover munder munderover mmultiscripts mstyle mspace mpadded menclose mfenced mtable mtr mtd""".split())
BOILERPLATE_TAGS = frozenset("nav footer aside header".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_NAMES = frozenset("""ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline captcha
comment comments commentlist complementary consent contentinfo cookie cookies disclaimer discussion disqus footer form gdpr
header hidden login masthead menu modal nav navbar navigation newsletter notice notification notifications overlay
pager pagination paywall popup privacy promo promoted recommended related replies reply respond search share sharing
sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget""".split())
CONTENT_NAMES = frozenset("article articlebody body content entry main maincontent post story text".split())
#: Words that beside a boilerplate word leave a name boilerplate: "share-buttons" and "cookie-box", not "social-history".
PLAIN_WORDS = frozenset("""area articles aside bar block bottom box button buttons col column container count desktop fixed
float global group icon icons inner item items left link links list lists message mobile outer page panel posts primary
right row secondary section site slot sticky stories thread title toggle top unit user wrap wrapper""".split())
#: Words that open a modifier's name, which tells of the page or the topic and not of the element: "with-sidebar", "tag-privacy".
MODIFIERS = frozenset("category has is no not tag topic with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {  # an opening tag ends an open element of these names
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
    "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_LISTS = frozenset("ul ol dl table".split())
_P_ENDERS = frozenset("""address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol
pre section table ul figure details""".split())


class Open(NamedTuple):
    """An open element and what its blocks inherit."""

    tag: str
    number: int
    hint: int  # 1 content, -1 boilerplate, 0 unknown: that of the innermost container with a hint
    named: bool  # the hint comes from a name, not from a tag
    doubtful: bool  # a container's name has a boilerplate word among others
    in_content: bool
    inside: bool  # an article or main


class Block(NamedTuple):
    text: str
    tag: str
    parent: int
    container: int
    hint: int
    linked: int
    named: bool
    doubtful: bool
    inside: bool


def _names(attributes: str, tag: str) -> tuple[int, bool, bool]:
    """What class, id and role say (1, 0, -1 as a hint), whether a word is doubtful, and whether the element is hidden.

    A name is boilerplate if it is a boilerplate word as a whole, if all its
    words are such or plain ones, or, in a class, if its last word is such; a name
    with a boilerplate word elsewhere is doubtful only. Ids of headings name
    places in the text and are not read.
    """
    hint, doubtful, hidden = 0, False, False
    for kind, value in _ATTRIBUTE.findall(attributes):
        kind = kind.lower()
        if len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]:
            value = value[1:-1]
        if kind == "style":
            hidden |= "display:none" in value.replace(" ", "").lower()
        elif kind not in ("class", "id", "role"):
            hidden |= kind == "hidden" or value.lower() == "true"
        elif kind != "id" or tag not in HEADINGS:
            for name in value.split():
                words = [w.lower() for w in _NAME.findall(name)]
                bad = [w in BOILERPLATE_NAMES for w in words]
                whole = re.sub("[-_]", "", name.lower())
                if whole in BOILERPLATE_NAMES or any(bad) and words[0] not in MODIFIERS and (
                        all(b or w in PLAIN_WORDS or w.isdigit() for b, w in zip(bad, words)) or kind == "class" and bad[-1]):
                    hint = -1
                elif any(bad):
                    doubtful = True
                elif hint >= 0 and (whole in CONTENT_NAMES or CONTENT_NAMES & set(words)):
                    hint = 1
    return hint, doubtful and hint >= 0, hidden


def _closed(page: str, tag: str, upto: int) -> dict[int, int]:
    """Where each closed element of the name ends, by the end of its opening tag; ``upto``: past the page's last ``>``."""
    ends, waiting = {}, []
    for found in re.compile(rf"<(/?){re.escape(tag)}(?![\w-])[^>]*>", re.I).finditer(page, 0, upto):
        if not found[1]:
            if not found[0].endswith("/>"):
                waiting.append(found.end())
        elif waiting:
            ends[waiting.pop()] = found.end()
    return ends


class Tags:
    """The marks of a page, one after the other, in time linear in the page.

    A quote that follows ``=`` opens a value up to the next such quote; other
    quotes are letters. Where a tag would not end for its quotes, quotes are
    letters from there on. After the page's last ``>`` nothing is a mark.
    """

    def __init__(self, page: str):
        self.page, self.upto, self.quoted = page, page.rfind(">") + 1, True
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.unclosed: set[str] = set()

    def next(self, at: int) -> tuple[int, int, str, str | None, str]:
        """(start, end, closing slash, tag or None, attributes) of the next mark; start -1: there is none."""
        page, upto = self.page, self.upto
        found = _MARK.search(page, at, upto)
        if not found:
            return -1, -1, "", None, ""
        if found[1]:
            end = page.find("-->", found.end())
            return found.start(), len(page) if end < 0 else end + 3, "", None, ""
        if found[3] is None:
            return found.start(), page.find(">", found.end()) + 1, "", None, ""
        end = self._end(found.end())
        return found.start(), end + 1, found[2], found[3].lower(), page[found.end():end]

    def _end(self, at: int) -> int:
        """The ``>`` that ends the tag whose name ends at ``at``; there is one, as all marks lie before the last."""
        first = self.page.find(">", at)
        while self.quoted:
            stop = _TAG_STOP.search(self.page, at, self.upto)
            if not stop:
                self.quoted = False
            elif stop[0] == ">":
                return stop.start()
            else:
                quote = stop[0][-1]
                at = self.page.find(quote, stop.end()) + 1 if stop.end() <= self.last[quote] else stop.end()
        return first

    def past_closing(self, tag: str, at: int) -> int:
        """Where the next closing tag of the name ends, or -1; a name that is not closed is not searched again."""
        if tag in self.unclosed:
            return -1
        found = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(self.page, at, self.upto)
        if not found:
            self.unclosed.add(tag)
            return -1
        return found.end()


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order; markup that is never text is left out.

    A tag that is not inline ends a block. An unclosed comment, script or other
    element of raw text takes the rest of the page, as browsers do; one of
    ``MARKUP`` ends where a block begins or its parent ends. A closing tag
    without an open element is skipped. Work grows with the page's length alone,
    however broken its markup.
    """
    out: list[Block] = []
    stack = [Open("", 0, 0, False, False, False, False)]
    marks = Tags(page)
    parts: list[str] = []
    linked = 0
    in_link = False
    number = 0
    at = 0
    dropped = 0  # depth of the outermost dropped element, or 0
    closed: dict[str, dict[int, int]] = {}

    def close() -> None:
        nonlocal linked
        text = "".join(parts)
        parts.clear()
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.split())
        if text:
            top = stack[-1]
            out.append(Block(text, top.tag, stack[-2].number if len(stack) > 1 else 0, top.number, top.hint,
                             min(linked, len(text)), top.named, top.doubtful, top.inside))
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal dropped
        del stack[depth:]
        if dropped and len(stack) <= dropped:
            dropped = 0

    end = len(page)
    while at < end:
        start, past, closing, tag, attributes = marks.next(at)
        upto = start if start >= 0 else end
        if upto > at and not dropped:
            run = page[at:upto]
            parts.append(run)
            if in_link:
                linked += len(run)
        if start < 0:
            break
        at = past
        if tag is None:
            continue
        if tag in RAW and not closing:
            if attributes.endswith("/"):
                continue
            if tag not in MARKUP:
                past = marks.past_closing(tag, at)
                at = past if past >= 0 else end
                continue
            if tag not in closed:
                closed[tag] = _closed(page, tag, marks.upto)
            if at in closed[tag]:
                at = closed[tag][at]
                continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ") if not dropped else None
            elif tag == "a":
                in_link = not closing
            elif not closing and "hidden" in attributes.lower() and _names(attributes, tag)[2]:
                past = marks.past_closing(tag, at)
                at = past if past >= 0 else at
            continue
        if not dropped:
            close()
        in_link = False
        if closing:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    pop_to(depth)
                    break
            continue
        if tag in VOID:
            continue
        if dropped and stack[dropped].tag in MARKUP and (tag in _P_ENDERS or tag in CLOSED_BY):
            pop_to(dropped)
        ends = CLOSED_BY.get(tag)
        if ends:
            depth = len(stack)
            for d in range(len(stack) - 1, 0, -1):
                if stack[d].tag in ends:
                    depth = d
                elif tag != "p" and stack[d].tag in _LISTS or stack[d].tag in _P_ENDERS:
                    break
            pop_to(depth)
        elif tag in _P_ENDERS and stack[-1].tag == "p":
            pop_to(len(stack) - 1)
        if attributes.endswith("/") and tag not in ("p", "div"):
            continue
        top = stack[-1]
        hint, named, doubtful, in_content = top.hint, top.named, top.doubtful, top.in_content
        said, doubt, hidden = _names(attributes, tag) if attributes else (0, False, False)
        if tag in CONTENT_TAGS:
            hint, named, doubtful, in_content = 1, False, False, True
        elif tag in BOILERPLATE_TAGS and not (tag == "header" and in_content):
            hint, named = -1, False
        if tag not in ("body", "html") and not (tag == "header" and in_content and said < 0):
            doubtful |= doubt
            if said < 0:
                hint, named = -1, True
            elif said > 0 and hint >= 0:
                named = named if hint else True
                hint, in_content = 1, True
        number += 1
        stack.append(Open(tag, number, hint, named, doubtful, in_content, top.inside or tag in CONTENT_TAGS))
        if not dropped and (tag in DROPPED or tag in MARKUP or hidden):
            dropped = len(stack) - 1
    if not dropped:
        close()
    return out


def figures(blocks: list[Block]) -> np.ndarray:
    """Figures of the blocks' own text and place, then of what their containers' names and tags say."""
    rows = []
    for k, b in enumerate(blocks):
        n = len(b.text)
        near = [len(blocks[j].text) for j in (k - 1, k + 1) if 0 <= j < len(blocks)]
        rows.append((1.0, math.log1p(n) / 5, b.linked / n, min(1.0, sum(map(b.text.count, ".,;!?")) / (n / 40 + 1)),
                     float(b.tag in ("p", "pre", "blockquote")), float(b.tag in ("li", "td", "th", "option")),
                     float(b.tag in ("h1", "h2", "h3")), math.log1p(sum(near) / max(1, len(near))) / 5,
                     float("\N{COPYRIGHT SIGN}" in b.text),
                     float(b.named and b.hint < 0), float(b.named and b.hint > 0), float(b.doubtful),
                     float(b.hint < 0 and not b.named), float(b.hint > 0 and not b.named)))
    return np.asarray(rows, float).reshape(len(rows), FIGURES)


#: Figures of the text, of the names, and of the tags. The labels of the fit come from the tags, so their weights are not fitted.
TEXT_FIGURES, NAME_FIGURES, TAG_FIGURES = 9, 3, 2
FIGURES = TEXT_FIGURES + NAME_FIGURES + TAG_FIGURES
PRIOR = np.asarray([-1.0, 1.0, -3.0, 0.5, 1.0, -1.0, 0.5, 0.3, -2.0, -2.5, 1.5, -0.7, -2.5, 2.5])
#: What a block's text can say at most, and all its figures together.
TEXT_COST, OWN_COST = 1.5, 4.0


def signals(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """How far each block's own figures speak for content (above 0) or boilerplate, bounded."""
    text = np.clip(x[:, :TEXT_FIGURES] @ weights[:TEXT_FIGURES], -TEXT_COST, TEXT_COST)
    return np.clip(text + x[:, TEXT_FIGURES:] @ weights[TEXT_FIGURES:], -OWN_COST, OWN_COST)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.5, pull: float = 0.02) -> np.ndarray:
    """Weights of the logistic model, pulled towards ``PRIOR``, which it is where there is nothing to learn from."""
    weights = PRIOR.copy()
    for _ in range(rounds if len(y) else 0):
        error = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30))) - y
        step = x.T @ error / len(y) + pull * (weights - PRIOR)
        weights[:-TAG_FIGURES] -= rate * step[:-TAG_FIGURES]
    return weights


NEXT_COST = 0.4
SIBLING_COST = 0.8


def cut(costs: list[tuple[float, float]], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks lie on the content side of the minimum cut.

    ``costs[k]``: the price of calling block k boilerplate (edge from the
    source) and content (edge to the sink). Flow is pushed along shortest
    paths, level by level, until the sink can't be reached.
    """
    n = len(costs)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for k, (as_boilerplate, as_content) in enumerate(costs):
        both = min(as_boilerplate, as_content)  # what flows straight through needs no edge
        if as_boilerplate > both:
            tie(source, k, as_boilerplate - both, 0.0)
        if as_content > both:
            tie(k, sink, as_content - both, 0.0)
    for a, b, price in edges:
        tie(a, b, price, price)

    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[k] >= 0 for k in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                full = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[full] ^ 1]
                del path[full:]
                continue
            while nxt[a] < len(out[a]):
                e = out[a][nxt[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(out[a]):
                path.append(out[a][nxt[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                nxt[a] += 1
            else:
                break


def main_text(page: str, weights: np.ndarray) -> str:
    """The content blocks of a page, one line each."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    signal = signals(figures(blocks), weights).tolist()
    return "\n".join(b.text for b, keep in zip(blocks, cut([(max(s, 0.0), max(-s, 0.0)) for s in signal], ties(blocks))) if keep)


def ties(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbouring blocks, and between neighbours of one container; cheap where the containers disagree."""
    edges = []
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if k:
            edges.append((k - 1, k, NEXT_COST if b.hint == blocks[k - 1].hint else NEXT_COST / 4))
        if b.parent in last and blocks[last[b.parent]].hint == b.hint:
            edges.append((last[b.parent], k, SIBLING_COST))
        last[b.parent] = k
    return edges


def learn(pages: DataFrame, train_pages: int = TRAIN_PAGES, train_blocks: int = TRAIN_BLOCKS) -> np.ndarray:
    """Weights from at most ``train_pages`` pages, those with the smallest hash of page_id.

    The labels come from tags: blocks of article or main are content; outside,
    those of nav, footer, aside and header, and on pages that have an article all,
    are not. Blocks inside whose names or tags speak against it are not learnt from. The weights of text and names are fitted, those of the tags are
    not, so the model carries over to pages whose tags say nothing. Of the rows with
    one page_id the one whose html has the smallest SHA-256 is read. The fit's bound:
    ``train_pages`` rows and the first ``train_blocks`` labelled blocks of each, a few MB of figures.
    """
    chosen = materialise(pages.select("page_id").where("page_id is not null").distinct()
                         .orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages), "extraction-pages")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for page in batch.column(0).to_pylist():
                blocks = blocks_of(page or "")
                article = any(b.inside for b in blocks)
                told = np.asarray([not b.doubtful and (b.hint > 0 if b.inside else article or b.hint < 0 and not b.named)
                                   for b in blocks], bool)
                x = np.column_stack([figures(blocks), [float(b.inside) for b in blocks]])[told] if blocks else []
                got.append(np.asarray(x, float).ravel()[:(FIGURES + 1) * train_blocks].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64()))], ["x"])

    mine = pages.select("page_id", F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html")) \
        .join(F.broadcast(chosen), "page_id", "left_semi").withColumn("mark", F.sha2("html", 256))
    marks = materialise(mine.groupBy("page_id").agg(F.min("mark").alias("mark")), "extraction-rows")
    # Rows equal in page_id and html are one; at most as many groups as chosen pages.
    texts = mine.join(F.broadcast(marks), ["page_id", "mark"], "left_semi") \
        .groupBy("page_id", "mark").agg(F.any_value("html").alias("html")).select("html")
    found = map_arrow(texts, rows, "x array<double>").collect()
    flat = [np.asarray(r.x).reshape(-1, FIGURES + 1) for r in found if r.x]
    data = np.concatenate(flat) if flat else np.zeros((0, FIGURES + 1))
    return train(data[:, :FIGURES], data[:, FIGURES])


def extract(pages: DataFrame, weights: np.ndarray | None = None, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """``TEXTS`` of each page row: the content blocks joined by line breaks.

    A null or empty html, and a page without content, has the empty text.
    Repeated rows are read each; an empty table gives no rows; other columns
    are not read. Pages are labelled one at a time, whole, however long.
    """
    weights = learn(pages, train_pages) if weights is None else weights

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(page, weights) if page else "" for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(got, pa.string()),
                 pa.array(list(map(len, got)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
                          pages["html"].cast("string").alias("html"))
    return map_arrow(source, texts, TEXTS)
