"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks: stretches of text between block-level tags, with
character references decoded and white space turned into single spaces. Markup,
comments, scripts, styles, form controls and the head never make blocks.

Each block gets a log-odds score for content from its containers (article and
main against nav, aside, footer, form, ..., also by role, id and class words)
and its own text (length, share of link text, closing marks). A container adds
a finite cost of the size of a long text's score, the inner one counts most,
and a frame that holds more than half of the page's text loses its cost by the
part above. The score's size is the capacity of an edge to the content or the
boilerplate terminal. Blocks next to
each other, and blocks that follow each other under one parent, are joined by
smoothness edges. The minimum cut then separates content from boilerplate: a
doubtful block goes with its neighbours, a clear one stays what it is.

Before the flow, blocks whose terminal edge outweighs all their smoothness
edges are settled (no minimum cut can put them on the other side) and folded
into the terminals, which leaves few undecided blocks on most pages.

Defined cases: a null or empty page, or one without content blocks, gives an
empty text; cut-off pages are read to their end (a tag cut off at the end is
dropped); repeated rows are extracted row by row; an empty table gives an empty
result; only the columns named below are returned.
"""

from __future__ import annotations

import re
from collections import deque
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import map_batches, small_batches

# Fixed values of HTML: elements that break a line of text, have no content, or hold no text of the page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre search section summary table "
    "tbody td tfoot th thead tr ul caption".split())
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset(
    "script style head title template noscript svg math iframe object audio video canvas map select option button textarea "
    "datalist noframes noembed".split())
ENDS_PARAGRAPH = BLOCK_TAGS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
ENDS_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
               "option": ("option",)}
SCOPES = frozenset("ul ol dl menu table".split())

CONTENT_TAGS = frozenset(["article", "main"])
FRAME_TAGS = frozenset(["nav", "aside", "footer", "header", "form", "menu", "dialog", "search"])
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
FRAME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar aside widget footer header masthead topbar cookie cookies consent gdpr notice alert "
    "popup modal overlay subscribe subscription newsletter signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond reply replies pagination pager toolbar copyright legal disclaimer skip tags".split())
CONTENT_WORDS = frozenset("article post entry content story main body text".split())

NEXT_EDGE, NEXT_EDGE_APART, SIBLING_EDGE = 0.6, 0.2, 0.5
# Log-odds of containers; a block's own text gives about -5 to 3 and its smoothness edges at most 1.4.
CONTENT_TAG, CONTENT_WORD, FRAME_TAG, FRAME_WORD = 3.0, 2.0, -4.0, -3.5
BOTH_WORDS = -1.0     # a content and a frame word on one element ("post no-sidebar")
FRAMED_CONTENT = 1.0  # an article or main element with a frame word
OUTER = 0.25          # what a container leaves of the log-odds around it
_CUT_OFF = re.compile(r"<(?:[a-zA-Z/!?][^<>]*)?$")
_NAME = re.compile(r"[a-z]+")


class Block:
    """A stretch of text with what its containers and markup say about it."""

    __slots__ = ("text", "links", "parent", "container", "around", "heading")

    def __init__(self, text: str, links: int, parent: int, container: int, heading: bool):
        self.text, self.links, self.parent, self.container, self.heading = text, links, parent, container, heading
        self.around = 0.0  # log-odds from its containers, known when the page has been read


class BlockReader(HTMLParser):
    """Reads a page into blocks."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # Open elements: tag, number, silent, inside content, the innermost container.
        self.open: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
        # Containers that say something: the one around it, log-odds.
        self.containers: list[tuple[int, float]] = [(0, 0.0)]
        self.number = 0
        self.blocks: list[Block] = []
        self.pieces: list[str] = []
        self.links = 0
        self.in_link = 0

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                around = [e for e in self.open if e[0] in BLOCK_TAGS or not e[0]]
                tag, _, _, _, container = around[-1]
                parent = around[max(len(around) - 2, 0)][1]
                self.blocks.append(Block(text, self.links, parent, container, tag in ("h1", "h2", "h3", "h4", "h5", "h6")))
            self.pieces, self.links = [], 0

    def _close(self, depth: int) -> None:
        """Close the open elements from ``depth`` on."""
        if any(e[0] in BLOCK_TAGS for e in self.open[depth:]):
            self.flush()
        self.in_link -= sum(e[0] == "a" for e in self.open[depth:])
        del self.open[depth:]

    def _close_one_of(self, tags: tuple[str, ...]) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] in tags:
                return self._close(depth)
            if self.open[depth][0] in SCOPES:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth][0] == "p":
                    self._close(depth)
                    break
                if self.open[depth][0] in BLOCK_TAGS:
                    break
        if tag in ENDS_ITSELF:
            self._close_one_of(ENDS_ITSELF[tag])
        if tag in BLOCK_TAGS:
            self.flush()
        if tag in VOID_TAGS:
            if tag == "br":
                self.pieces.append(" ")
            return
        self.number += 1
        _, _, silent, content, container = self.open[-1]
        if tag == "body":  # an unclosed head ends here
            silent = False
        words, hidden, odds = set(), False, 0.0
        for name, value in attrs:
            value = (value or "").lower()
            if name in ("class", "id"):
                words.update(_NAME.findall(value))
            elif name == "role" and value.strip() in FRAME_ROLES:
                odds = FRAME_TAG
            elif name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
        framed = bool(words & FRAME_WORDS) and tag not in ("html", "body")
        if tag in CONTENT_TAGS:
            odds += FRAMED_CONTENT if framed else CONTENT_TAG
            content = True
        elif tag in FRAME_TAGS:
            # An article's own header mostly holds its title.
            odds += 0.0 if tag == "header" and content and not framed else FRAME_TAG
        elif words & CONTENT_WORDS and tag in ("div", "section"):
            odds += BOTH_WORDS if framed else CONTENT_WORD
            content = content or not framed
        elif framed:
            odds += FRAME_WORD
        if odds:
            self.containers.append((container, max(odds, FRAME_TAG)))
            container = len(self.containers) - 1
        if tag == "a":
            self.in_link += 1
        self.open.append((tag, self.number, silent or hidden or tag in SILENT_TAGS, content, container))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID_TAGS or tag not in ("script", "style"):
            self.handle_starttag(tag, attrs)
            if tag not in VOID_TAGS and tag not in BLOCK_TAGS:
                self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self.pieces.append(" ")
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth][0] == tag:
                return self._close(depth)
        return None

    def handle_data(self, data):
        if not self.open[-1][2]:
            self.pieces.append(data)
            if self.in_link:
                self.links += len(data.strip())


def read_blocks(html: str | None) -> list[Block]:
    if not html:
        return []
    reader = BlockReader()
    reader.feed(_CUT_OFF.sub("", html[-2000:]) if len(html) <= 2000 else html[:-2000] + _CUT_OFF.sub("", html[-2000:]))
    reader.close()
    reader.flush()
    set_containers(reader.blocks, reader.containers)
    return reader.blocks


def set_containers(blocks: list[Block], containers: list[tuple[int, float]]) -> None:
    """Give every block the log-odds of its containers."""
    held = [0] * len(containers)  # text outside links
    for b in blocks:
        held[b.container] += max(len(b.text) - b.links, 0)
    for i in range(len(containers) - 1, 0, -1):
        held[containers[i][0]] += held[i]
    odds = [0.0] * len(containers)
    for i, (outer, own) in enumerate(containers):
        if i:
            # Boilerplate seldom holds most of a page: a form or a div named "no-sidebar" around all of it says nothing.
            weight = min(1.0, 2.0 - 2.0 * held[i] / max(held[0], 1)) if own < 0 else 1.0
            odds[i] = weight * own + (1.0 - weight * (1.0 - OUTER)) * odds[outer]
    for b in blocks:
        b.around = odds[b.container]


def log_odds(block: Block) -> float:
    """The classifier: log-odds of content from containers and text."""
    n_words = block.text.count(" ") + 1
    score = -1.0 + min(n_words, 40) / 12.0 - 4.0 * min(block.links / max(len(block.text), 1), 1.0)
    if block.text[-1] in ".!?:;\"'…»”。":
        score += 0.7
    if block.heading:
        score += 0.8
    return (max(score, -2.0) if block.around > 0 else score) + block.around


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order and under one parent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT_EDGE if blocks[i - 1].parent == b.parent else NEXT_EDGE_APART))
        if b.parent in last and last[b.parent] != i - 1:
            edges.append((last[b.parent], i, SIBLING_EDGE))
        last[b.parent] = i
    return edges


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the cut: True is the source side.

    ``unary`` > 0 is the capacity from the source, < 0 that to the sink.
    """
    n = len(unary)
    around = [0.0] * n
    for i, j, c in edges:
        around[i] += c
        around[j] += c
    settled = [abs(u) > w for u, w in zip(unary, around)]
    side = [u > 0 for u in unary]
    free = [i for i in range(n) if not settled[i]]
    if not free:
        return side
    number = {i: k for k, i in enumerate(free)}
    source, sink = len(free), len(free) + 1
    graph: list[dict[int, float]] = [{} for _ in range(len(free) + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        graph[a][b] = graph[a].get(b, 0.0) + there
        graph[b][a] = graph[b].get(a, 0.0) + back

    for i in free:
        if unary[i] > 0:
            join(source, number[i], unary[i], 0.0)
        elif unary[i] < 0:
            join(number[i], sink, -unary[i], 0.0)
    for i, j, c in edges:
        a, b = (number[x] if x in number else source if side[x] else sink for x in (i, j))
        if a != b:
            join(a, b, c, c)
    while True:  # Dinic: level graph, then blocking flow along it
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for b, c in graph[a].items():
                if c > 1e-12 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if sink not in level:
            break
        trail, ways = [source], {a: iter(list(graph[a])) for a in level}
        while trail:
            a = trail[-1]
            if a == sink:
                flow = min(graph[x][y] for x, y in zip(trail, trail[1:]))
                for x, y in zip(trail, trail[1:]):
                    graph[x][y] -= flow
                    graph[y][x] += flow
                cut = next(k for k, (x, y) in enumerate(zip(trail, trail[1:])) if graph[x][y] <= 1e-12)
                del trail[cut + 1:]
                continue
            for b in ways[a]:
                if graph[a][b] > 1e-12 and level.get(b) == level[a] + 1:
                    trail.append(b)
                    break
            else:
                trail.pop()
    for i in free:
        side[i] = number[i] in level
    return side


def main_text(html: str | None) -> str:
    """Content blocks of a page in page order, joined by line feeds."""
    blocks = read_blocks(html)
    keep = minimum_cut([log_odds(b) for b in blocks], smoothness(blocks))
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars (code points) of every page."""
    small_batches(df.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                           pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    thin = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_batches(thin, run, f"id {thin.schema['id'].dataType.simpleString()}, url string, text string, n_chars bigint").select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
