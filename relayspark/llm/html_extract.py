"""Main text of web pages by tag-path ratios.

A page is a sequence of blocks, each with a tag path from the root to its leaf. For each path the length of
its text and its punctuation, both without links, are summed and put in proportion to its number of blocks (the
items of a list or table count as one). The
ratios are smoothed over the paths of one container (the innermost element that is no paragraph, list, table or
the like), fused (text times punctuation), and paths above a threshold give the content, in page order. An article
or main element around a path raises its score, no more. A heading goes with the text that follows it.
Elements that by their kind are never main text (menus, forms, scripts, ...) score nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayspark.llm.common import python_ready

#: HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
NEVER = frozenset(
    "script style noscript template head title nav header footer aside form button select option textarea input iframe object svg canvas menu dialog audio video map fieldset".split()
)
CLOSES = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: Elements of running text: their paths are smoothed with those beside them.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption".split())
#: Elements whose items in a row count as one block, and the items.
LISTS = frozenset("ul ol dl table".split())
ITEMS = frozenset("li dt dd td th".split())
#: Words of class, id or role that name what is not main text: whole, or followed by "-" or "_" (but for switches
#: of a whole page, such as comments-open).
NOISE = re.compile(
    r"(?:^|\s)(ads?|advert\w*|adbox|adslot|sponsor\w*|promo\w*|banner\w*|sidebar\w*|side|comments?|commentlists?|comment(?:er|form|box|area|section)s?|replies|respond|discussion|disqus\w*"
    r"|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w*|signup|login|share|sharing|social\w*|related"
    r"|recommend\w*|breadcrumbs?|menus?|nav\w*|footer\w*|header|masthead|toolbar|pagination|pager|widget\w*|search\w*|skip|tags?|toc"
    r"|complementary|contentinfo|dialog|form|hidden)(?:$|\s|[_-](?!(?:open|closed|enabled|disabled|on|off)(?:$|\s)))",
    re.I,
)
#: Only the main text's own element may bear one of these and still be read.
MAIN = frozenset(["article", "main", "body", "html"])
PUNCTUATION = re.compile(r"[.,;:!?…。，！？¡¿]")
SPACE = re.compile(r"\s+")
UNENDED = re.compile(r"<[!?/A-Za-z]")
#: A path is content if its fused score reaches this share of the best path's.
THRESHOLD = 0.2
#: The part of a path's ratios that is its container's mean, and how an article or main element weighs.
SMOOTH = 0.25
PRIOR = 2.0


class _Blocks(HTMLParser):
    """Blocks of a page, (path, text, text outside links) in page order, without the elements that are never text.

    A path is a number; ``paths`` has its container (the path but for its last step) and that step, so deep
    pages cost no long tuples.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool, bool, int, bool]] = []  # (tag, path down to it, noise, link, hint, main)
        # Places in the stack: of the open elements of each tag, and of all that are not inline.
        self.places: dict[str, list[int]] = {}
        self.outer: list[int] = []
        self.numbers: dict[tuple[int, str], int] = {}
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self.buffer: list[str] = []
        self.unlinked: list[str] = []
        self.blocks: list[tuple[int, str, str]] = []
        self.noise = 0
        self.links = 0
        # Elements whose names tell noise: the one around each, and whether a main element is in it. 0 is none.
        self.hints: list[int] = [0]
        self.holds: list[bool] = [False]
        self.owners: list[int] = []  # of each block: its innermost such element
        self.open_mains = 0  # open article and main elements whose names do not tell noise
        self.main_text = False  # whether one had text

    def flush(self):
        text = SPACE.sub(" ", "".join(self.buffer)).strip()
        own = SPACE.sub(" ", "".join(self.unlinked)).strip()
        self.buffer, self.unlinked = [], []
        if text and not self.noise:
            self.blocks.append((self.stack[-1][1] if self.stack else 0, text, own))
            self.owners.append(self.stack[-1][4] if self.stack else 0)
            self.main_text |= self.open_mains > 0

    def _pop(self, to: int):
        while len(self.stack) > to:
            tag, _, noise, link, _, main = self.stack.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.outer.pop()
            self.open_mains -= main
            self.noise -= noise
            self.links -= link

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data("\n")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            for i in reversed(self.outer):
                open_tag = self.stack[i][0]
                if tag in CLOSES.get(open_tag, ()):
                    self._pop(i)
                    break
                if open_tag not in CLOSES:
                    break
        named = dict(attrs)
        words = " ".join(filter(None, (named.get("class"), named.get("id"), named.get("role"))))
        noise = tag in NEVER or "hidden" in named or named.get("aria-hidden") == "true"
        told = bool(words and NOISE.search(words))
        hint = self.stack[-1][4] if self.stack else 0
        main = tag in ("article", "main") and not told and not self.noise and not noise
        if main:
            self.open_mains += 1
            at = hint
            while not self.holds[at]:
                self.holds[at] = True
                at = self.hints[at]
        if told and tag not in MAIN and not noise and not self.noise:
            if tag in INLINE:
                self.flush()
            self.hints.append(hint)
            self.holds.append(False)
            hint = len(self.hints) - 1
        if noise and tag in INLINE and not self.noise:
            self.flush()
        path = self.stack[-1][1] if self.stack else 0
        if tag not in INLINE:
            step = (path, tag + "".join(sorted("." + w for w in (named.get("class") or "").split())))
            path = self.numbers.get(step, len(self.paths))
            if path == len(self.paths):
                self.numbers[step] = path
                self.paths.append(step)
        link = tag == "a" and "href" in named
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.outer.append(len(self.stack))
        self.stack.append((tag, path, noise, link, hint, main))
        self.noise += noise
        self.links += link

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_data("\n")
            return
        if not self.places.get(tag) or (tag in INLINE and self.outer and self.outer[-1] > self.places[tag][-1]):
            return  # nothing that it could end
        i = self.places[tag][-1]
        if tag not in INLINE or self.stack[i][2] or self.stack[i][4] != (self.stack[i - 1][4] if i else 0):
            self.flush()
        self._pop(i)

    def close(self):
        if UNENDED.match(self.rawdata):
            self.rawdata = ""  # a tag or comment that nothing ends goes on to the end of the page
        super().close()

    def handle_data(self, data):
        if self.noise:
            return
        self.buffer.append(data)
        if not self.links:
            self.unlinked.append(data)


def _read(html: str) -> _Blocks:
    """The page without the blocks of elements whose names tell noise. Such a name does not count if a main element
    is inside, or, on a page whose main elements have no text, most of the page's text; nor if nothing were left."""
    page = _Blocks()
    page.feed(html)
    page.close()
    page.flush()
    size = [0] * len(page.hints)
    for owner, (_, text, _) in zip(page.owners, page.blocks, strict=True):
        size[owner] += len(text)
    # An element is numbered after those around it.
    for hint in range(len(size) - 1, 0, -1):
        size[page.hints[hint]] += size[hint]
    dropped = [False]
    for hint in range(1, len(size)):
        most = not page.main_text and 2 * size[hint] > size[0]
        dropped.append(dropped[page.hints[hint]] or not (page.holds[hint] or most))
    left = [block for owner, block in zip(page.owners, page.blocks, strict=True) if not dropped[owner]]
    page.blocks = left or page.blocks
    return page


def extract(html: str | None) -> str:
    """The main text of a page, blocks joined by a line end; empty if there is none."""
    page = _read(html or "")
    if not page.blocks:
        return ""
    # Paths are numbered after the elements around them, so one pass tells what those are.
    level, container, within, listed, item = [0], [0], [False], [0], [0]
    for path, (above, step) in enumerate(page.paths[1:], 1):
        tag = step.split(".")[0]
        level.append(HEADINGS.get(tag, 0))
        container.append(container[above] if tag in FLOW else path)
        within.append(within[above] or tag in ("article", "main"))
        listed.append(path if tag in LISTS else listed[above])
        item.append(listed[path] if tag in ITEMS else 0)
    blocks = [b for b in page.blocks if not level[b[0]]]
    if not blocks:
        return "\n".join(text for _, text, _ in page.blocks)
    # A page of nothing but links is judged by those.
    blocks = [(p, own) for p, _, own in blocks] if any(own for _, _, own in blocks) else [(p, text) for p, text, _ in blocks]
    count: Counter = Counter()
    chars: Counter = Counter()
    marks: Counter = Counter()
    around: dict[int, list[int]] = {}  # of each container: blocks, characters, marks
    last, seen = 0, set()
    for path, text in blocks:
        size, n = len(text), len(PUNCTUATION.findall(text))
        if item[path] != last:
            last, seen = item[path], set()
        fresh = not last or path not in seen
        seen.add(path)
        count[path] += fresh
        chars[path] += size
        marks[path] += n
        sums = around.setdefault(container[path], [0, 0, 0])
        sums[0], sums[1], sums[2] = sums[0] + fresh, sums[1] + size, sums[2] + n
    fused = {}
    for path, n in count.items():
        blocks_in, chars_in, marks_in = around[container[path]]
        text = (1 - SMOOTH) * chars[path] / n + SMOOTH * chars_in / blocks_in
        points = (1 - SMOOTH) * (1 + marks[path]) / n + SMOOTH * (1 + marks_in) / blocks_in
        fused[path] = text * points * (PRIOR if within[path] else 1)
    # The best path has much text besides high ratios.
    top = fused[max(fused, key=lambda p: fused[p] * chars[p])]
    chosen = {path for path, score in fused.items() if score >= THRESHOLD * top}
    # A heading is content if some is below it, before the next heading of its level or a higher one.
    out, below, bounded = [], [False] * 7, any(within[p] for p in chosen)
    for path, text, _ in reversed(page.blocks):
        at = level[path]
        if at:
            if below[at] and (within[path] or not bounded):
                out.append(text)
            below[at:] = [False] * (7 - at)
        elif path in chosen:
            out.append(text)
            below = [True] * 7
    return "\n".join(reversed(out))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages`` (page_id, url, html; others ignored).

    A null or empty page has an empty text. Rows are read each on its own, so repeated rows give repeated
    results; an empty table gives no rows.
    """
    python_ready(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
