"""Main text of HTML pages by minimum-cut labelling of their blocks.

A page falls into blocks of text at its block-level tags. Each block has a cost of calling it
boilerplate (evidence for content) and one of calling it content (evidence against), from its words,
its links and what its ancestors are; they are the capacities of its edges to the source and to the
sink. A mark of an outer part (its tag, or a word in its class, id or role) is such a cost too: it is
less the more of the page's main part lies below the marked element. Neighbouring blocks are joined by smoothness edges, stronger the nearer they are in the tree,
and so are successive blocks of one parent. A maximum flow then gives the labelling of the least
total cost: blocks still reachable from the source are content.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# --- fixed values ----------------------------------------------------------------------------

#: Elements that start and end a block of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol p pre search section summary table tbody tfoot thead tr ul "
    "button label option select".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements with no content, so nothing to close.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no main text, unless they enclose the page's main part.
OUTER_TAGS = frozenset("nav aside footer form menu dialog fieldset search button label option select legend".split())
#: Words in class, id or role that mark such parts.
OUTER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert alertdialog banner breadcrumb breadcrumbs comment comments commentlist "
    "complementary consent contentinfo cookie cookies copyright dialog discussion disqus footer form gdpr header login masthead menu "
    "menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion "
    "recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Of these, words of parts that are never the page's frame, however much of it they hold.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising comment comments commentlist consent cookie cookies discussion disqus gdpr promo "
    "promoted promotion replies respond sponsor sponsored".split()
)
#: Words that name a part's shape or place. Within an article, a name with any other word beside an outer one is a subject: `related-work`.
SHAPE_WORDS = frozenset(
    "area bar block bottom box button buttons column container content footer global group header holder icon icons inner item items left "
    "link links list main minor nav outer page panel posts primary region right row secondary section site small top wrap wrapper".split()
)
#: Words in class, id or role that mark the main part.
INNER_WORDS = frozenset("article articlebody body content entry main post story text".split())
#: First words of names that say what stands beside an element, not what it is: `has-sidebar`.
BESIDE_WORDS = frozenset("has no with without".split())
#: Plain words from which a form without an article can be the page's frame.
FRAME_WORDS = 50
#: Kinds of outer marks: never lifted; a tag or a word of APART_WORDS, lifted by an article or the like below it; a form; another word.
HIDDEN, PART, FORM, WORD = 4, 3, 2, 1
#: A marked part is the page's frame if the main part has less than this share of its words.
FRAME_SHARE = 0.2
#: Ranks of inner elements: an article, a main, a word.
ARTICLE, MAIN, OTHER = 3, 2, 1

# As browsers read attributes: a quote counts only after `=`, its value ends at the next such quote, however long.
_VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+')?+"
_TOKENS = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|svg|textarea|iframe|object|canvas|title)(?=[\s/>])(?:[^>=]++|" + _VALUE + r")*+>(?:(?<=/>)|.*?(?:</\1\s*>|\Z))"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>=]++|" + _VALUE + r")*+)>",
    re.S | re.I,
)
# Values that can hold anything, so that nothing in them is taken for an attribute.
_OTHER_VALUES = re.compile(r"(?<![^\s\"'/])(?!(?:class|id|role|style|aria-hidden)\s*=)[^\s\"'>/=]+\s*=\s*(?:\"[^\"]*\"|'[^']*')", re.I)
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class Costs:
    """Weights of the block classifier and of the smoothness edges."""

    outer: float = 8.0  # in a marked outer part, times the share of the main part that isn't below the mark
    inner: float = 2.0  # in the main part
    word: float = 1 / 12  # for each word outside links, up to `most_words`
    most_words: float = 2.5
    heading: float = 0.8  # for a heading, beside what its words are worth
    link: float = 2.5  # for the share of characters in links
    plain: float = 0.7  # against any block, as far as the page has a better one
    short: float = 0.6  # the same, against a block of under eight words outside the main part
    rights: float = 1.5  # against a copyright line outside the main part
    neighbour: float = 0.8
    sibling: float = 0.5


@dataclass
class Block:
    text: str
    link_chars: int
    parent: int
    inner: bool
    outer: float = 0.0  # strength of the outer marks above it, from 0 to 1
    heading: bool = False


# --- blocks ------------------------------------------------------------------------------------


def _marks(tag: str, attributes: str, within: bool = False) -> tuple[int, bool]:
    """The kind of outer mark that a tag with its attributes has (0: none), and whether it begins an inner part. `within`: it is in one."""
    kind, inner = FORM if tag in ("form", "fieldset") else PART if tag in OUTER_TAGS else 0, tag in ("article", "main")
    if attributes and tag not in ("html", "body"):
        # `hidden` is kept as a name when it has a value
        attributes = _OTHER_VALUES.sub(lambda m: " hidden " if m[0][:6].lower() == "hidden" else " ", attributes)
        words: set[str] = set()
        outer: set[str] = set()
        for m in _MARKS.finditer(attributes):
            for name in (m[2] or m[3] or m[4] or "").split():
                found = [w.lower() for w in _WORDS.findall(name)]
                if found and found[0] not in BESIDE_WORDS:
                    words.update(found)
                    if not within or all(w in OUTER_WORDS or w in SHAPE_WORDS for w in found) or not APART_WORDS.isdisjoint(found):
                        outer.update(found)
        found = outer & OUTER_WORDS
        if words & INNER_WORDS:
            inner = inner or not found
            found -= {"header"}  # an entry's own header has its title
        if kind == FORM:
            found -= {"form"}
        if _HIDDEN.search(attributes):
            kind = HIDDEN
        elif found and kind != PART:
            kind = PART if found & APART_WORDS else max(kind, WORD)
    return kind, inner


def weigh_marks(blocks: Sequence[Block], parents: Sequence[int], tags: Sequence[str], kinds: Sequence[int], inners: Sequence[int]) -> None:
    """Sets each block's `outer`: the strongest of the marks above it.

    A mark has the share of the main part's words that aren't below it. The main part's words are
    those outside links under an article, main or other inner element (the outermost article counts,
    else the outermost main, else the outermost other) and those under no mark. A form or a word's mark with no such element below may still be the frame of the
    page: if it has a first heading, or in a form enough words, or if the main part is small beside it,
    all its words count. One pass down the tree and one up, so time grows with the page alone.
    """
    if not any(kinds):
        return
    n = len(parents)
    hidden, part, marked = [False] * n, [False] * n, [False] * n  # of each node and what is above it
    main = [-1] * n  # of its inner ancestors and itself without a mark, the outermost of the highest rank
    for k, parent in enumerate(parents):
        up = parent if parent >= 0 else k
        hidden[k], part[k], marked[k] = kinds[k] == HIDDEN or hidden[up], kinds[k] == PART or part[up], bool(kinds[k]) or marked[up]
        best = main[up]
        main[k] = k if inners[k] and not kinds[k] and (best < 0 or inners[k] > inners[best]) else best
    # words at the nodes, then summed up the tree: a node's number is larger than its parent's
    inside, framed, below, headed = [0.0] * n, [0.0] * n, [0.0] * n, [False] * n
    everything = 0.0
    for b in blocks:
        at = b.parent
        if hidden[at]:
            continue
        words = (b.text.count(" ") + 1) * (1 - b.link_chars / len(b.text))
        headed[at] |= tags[at] == "h1"
        if main[at] >= 0:
            inside[main[at]] += words
        if not part[at]:
            framed[at] += words
        if main[at] >= 0 or not marked[at]:
            everything += words
            below[at] += words
    for k in range(n - 1, 0, -1):
        up = parents[k]
        inside[up] += inside[k]
        framed[up] += framed[k]
        below[up] += below[k]
        headed[up] |= headed[k]
    strength = [0.0] * n
    for k in range(n):
        if kinds[k]:
            mine = inside[k]
            if not mine and (
                kinds[k] in (FORM, WORD) and headed[k] or kinds[k] == FORM and framed[k] >= FRAME_WORDS or kinds[k] == WORD and everything < FRAME_SHARE * framed[k]
            ):
                mine = 0.0 if main[k] >= 0 and inners[main[k]] == ARTICLE and everything >= FRAME_SHARE * framed[k] else framed[k]
            others = everything - below[k]
            strength[k] = 1.0 if kinds[k] == HIDDEN or not mine else others / (others + mine)
        if parents[k] >= 0:
            strength[k] = max(strength[k], strength[parents[k]])
    for b in blocks:
        b.outer = strength[b.parent]


def blocks_of(page: str) -> tuple[list[Block], list[int], list[int]]:
    """The page's blocks in order; each node's parent and depth (nodes are open block-level elements)."""
    parents, depths = [-1], [0]
    tags, kinds, inners = [""], [0], [0]
    stack = [("", 0, False)]  # tag, node, inner
    out: list[Block] = []
    parts: list[str] = []
    links, in_link = 0, False

    def flush() -> None:
        nonlocal links
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                _, node, inner = stack[-1]
                out.append(Block(text, min(links, len(text)), node, inner, heading=tags[node] in HEADINGS))
            parts.clear()
        links = 0

    def close(k: int) -> None:
        flush()
        del stack[k:]

    at = 0
    for m in _TOKENS.finditer(page):
        if m.start() > at:
            text = page[at : m.start()]
            parts.append(text)
            if in_link:
                links += len(text)
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        closing = m[2]
        if tag == "a":
            in_link = not closing
        elif tag in ("br", "td", "th", "img"):
            parts.append(" ")
        elif tag in BLOCK_TAGS or tag == "head":
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        close(k)
                        break
                else:
                    flush()
            else:
                flush()
                if stack[-1][0] == "p" or tag == "li" and stack[-1][0] == "li" or tag == "body" and stack[-1][0] == "head":
                    close(len(stack) - 1)
                if tag not in VOID_TAGS:
                    _, node, inner = stack[-1]
                    kind, starts_inner = _marks(tag, m[4], inner)
                    # a page's header is outer, an article's isn't
                    if tag == "head":
                        kind = HIDDEN
                    elif tag == "header" and not inner:
                        kind = max(kind, PART)
                    parents.append(node)
                    depths.append(len(stack))
                    tags.append(tag)
                    kinds.append(kind)
                    inners.append(starts_inner and {"article": ARTICLE, "main": MAIN}.get(tag, OTHER))
                    stack.append((tag, len(parents) - 1, inner or starts_inner))
    if at < len(page):
        parts.append(page[at:])
    flush()
    weigh_marks(out, parents, tags, kinds, inners)
    return out, parents, depths


def _distance(a: int, b: int, parents: Sequence[int], depths: Sequence[int]) -> int:
    steps = 0
    while a != b:
        if depths[a] >= depths[b]:
            a = parents[a]
        else:
            b = parents[b]
        steps += 1
    return steps


# --- the cut -------------------------------------------------------------------------------------


def minimum_cut(source: Sequence[float], sink: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut (the least such side), by augmenting paths.

    Each node's surplus goes to the nearest nodes that need it. Where no such node can be reached, none
    ever will be from anything that was reached, so that region is never searched again.
    """
    n = len(source)
    give = [max(0.0, a - b) for a, b in zip(source, sink, strict=True)]
    need = [max(0.0, b - a) for a, b in zip(source, sink, strict=True)]
    left: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        left[i][j] = left[i].get(j, 0.0) + w
        left[j][i] = left[j].get(i, 0.0) + w
    tiny = 1e-9
    closed = [False] * n
    for s in range(n):
        while give[s] > tiny and not closed[s]:
            via, queue, end = {s: -1}, deque([s]), -1
            while queue and end < 0:
                i = queue.popleft()
                for j, w in left[i].items():
                    if w > tiny and j not in via and not closed[j]:
                        via[j] = i
                        if need[j] > tiny:
                            end = j
                            break
                        queue.append(j)
            if end < 0:
                for i in via:
                    closed[i] = True
                break
            flow, i = min(give[s], need[end]), end
            while via[i] >= 0:
                flow = min(flow, left[via[i]][i])
                i = via[i]
            give[s] -= flow
            need[end] -= flow
            i = end
            while via[i] >= 0:
                left[via[i]][i] -= flow
                left[i][via[i]] += flow
                i = via[i]
    # what surplus is left, and all that it reaches
    side = [g > tiny for g in give]
    queue = deque(i for i in range(n) if side[i])
    while queue:
        for j, w in left[queue.popleft()].items():
            if w > tiny and not side[j]:
                side[j] = True
                queue.append(j)
    return side


def labelled(blocks: Sequence[Block], parents: Sequence[int], depths: Sequence[int], costs: Costs) -> list[bool]:
    """Which blocks are content."""
    source, sink = [], []
    worth = [min(costs.most_words, costs.word * (b.text.count(" ") + 1)) * (1 - b.link_chars / len(b.text)) for b in blocks]
    # what speaks against a short block counts as far as the page has a longer one
    beside = min(1.0, max((w for b, w in zip(blocks, worth, strict=True) if b.outer < 0.5), default=0.0) / costs.most_words)
    for b, mine in zip(blocks, worth, strict=True):
        words = b.text.count(" ") + 1
        linked = b.link_chars / len(b.text)
        source.append(costs.inner * b.inner + mine + costs.heading * b.heading * (1 - linked))
        against = costs.plain * beside + costs.link * linked + costs.outer * b.outer
        if not b.inner:
            against += costs.short * beside * (words < 8) + costs.rights * (b.text[:1] == "©" or b.text[:9].lower() == "copyright")
        sink.append(against)
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        joins = {}
        if k:
            joins[k - 1] = costs.neighbour * 0.5 ** _distance(blocks[k - 1].parent, b.parent, parents, depths)
        group = parents[b.parent] if b.parent else 0
        if group in last:
            joins[last[group]] = joins.get(last[group], 0.0) + costs.sibling
        last[group] = k
        for j, w in joins.items():
            if b.inner == blocks[j].inner or (b.outer < 0.5) == (blocks[j].outer < 0.5):
                edges.append((j, k, w))
    # A block that would stay boilerplate even if all its neighbours were content is on the sink's side of every
    # minimum cut with the least source side, so it needs no node.
    pull = [0.0] * len(blocks)
    for j, k, w in edges:
        pull[j] += w
        pull[k] += w
    nodes = [k for k in range(len(blocks)) if sink[k] - source[k] < pull[k]]
    place = {k: i for i, k in enumerate(nodes)}
    kept = []
    for j, k, w in edges:
        if j in place and k in place:
            kept.append((place[j], place[k], w))
        elif j in place or k in place:
            sink[j if j in place else k] += w
    side = minimum_cut([source[k] for k in nodes], [sink[k] for k in nodes], kept)
    return [k in place and side[place[k]] for k in range(len(blocks))]


def main_text(page: str | None, costs: Costs = Costs()) -> str:
    """The page's content blocks joined by two line feeds; empty if there are none."""
    if not page:
        return ""
    blocks, parents, depths = blocks_of(page)
    return "\n\n".join(b.text for b, content in zip(blocks, labelled(blocks, parents, depths, costs), strict=True) if content)


def extract_text(pages: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html).

    Character references are decoded, white space within a block becomes one space, blocks are
    joined by two line feeds in page order. A null or empty page, and one of boilerplate alone, has
    an empty text; null ids and urls stay; repeated rows give theirs each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, costs) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    frame = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    return frame.mapInArrow(run, "page_id long, url string, text string, n_chars long")
