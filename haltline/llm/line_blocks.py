"""Main text of web pages by the distribution of text over line blocks (operator 9).

Markup is stripped into lines, one for each block element. A line that belongs to a menu, header, footer,
side column, notice, advert, form or to reader comments counts as empty. Text lengths are summed over
windows of a few lines; where the sum surges from nothing and where it dives back bound a region of text.
All lines between are kept, short ones too. The region with most text decides, on every page; text in an article
or main element counts `MAIN_WEIGHT` times for that. If most of that region stands in such elements, they are the
article and keep all their lines, while lines outside go. Otherwise, as on pages without or with nearly empty ones,
the element around the region keeps all its lines, whatever stands between them, and regions elsewhere that hold
little text beside the largest one are dropped.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltline.llm.blocks import text_blocks, whole_text

#: Lines of one block; so many empty lines in a row end a region.
WINDOW = 3
#: Outside its main element a page keeps regions with this share of its largest region's text.
SHARE = 0.25
#: A character inside an article or main element counts so many times where the largest region is looked for.
MAIN_WEIGHT = 4

# Fixed values of the HTML standard.
RAW = frozenset(("script", "style", "title", "textarea", "iframe", "noembed", "noframes", "xmp"))
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
# Elements and names that pages give to what is not the article.
DROPPED = frozenset(
    "head nav header footer aside form button select input noscript template svg canvas object audio video "
    "dialog menu".split()
)
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent notice "
    "notices gdpr comment comments disqus respond share sharing social related newsletter subscribe popup "
    "modal overlay widget login signup toolbar pagination pager skip".split()
)
# Beside one of the names these say what a wrapper has, lacks or shows: it is not that part itself.
STATES = frozenset("no has have with without non not free less is open closed enabled disabled layout".split())
LISTS = frozenset("ul ol dl dir".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
    "toolbar".split()
)
KEPT = frozenset(("html", "body", "main", "article"))
# Around the largest region these are the whole page, not an element that holds its main text.
PAGE = frozenset(("html", "body"))

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*|[^>]*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z0-9]+")
_LETTER = re.compile(r"\w")


def main_text(page: str) -> str:
    """The article of a page; empty if there is none."""
    lines, inside, around = page_lines(page)
    sizes = np.array([len(line) for line in lines], dtype=np.int64)
    regions = text_regions(sizes)
    if not regions:
        return ""
    totals = [int(sizes[a:b].sum()) for a, b in regions]
    weighted = sizes * np.where(inside, MAIN_WEIGHT, 1)
    first, last = max(regions, key=lambda region: int(weighted[region[0] : region[1]].sum()))
    own = [at for at in range(first, last) if lines[at]]
    if 2 * int(weighted[first:last][inside[first:last]].sum()) >= int(weighted[first:last].sum()):
        # The region is that of an article: all of it is kept, and no line that stands outside.
        kept = [lines[at] for a, b in regions for at in range(a, b) if inside[at]]
    else:
        holder = around[own[0]][: _shared_depth([around[at] for at in own])]
        least = SHARE * max(totals)
        kept = [
            lines[at]
            for (a, b), size in zip(regions, totals, strict=True)
            for at in range(a, b)
            if size >= least or _holds(holder, around[at])
        ]
    return " ".join(line for line in kept if line)


def _shared_depth(paths: list[tuple[tuple[str, int], ...]]) -> int:
    """How many elements, from the page's root on, are around all lines."""
    low, high = min(paths, default=()), max(paths, default=())
    return next((n for n, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))


def _holds(holder: tuple[tuple[str, int], ...], path: tuple[tuple[str, int], ...]) -> bool:
    """Whether a line stands in the holder; if that is the whole page, right in it."""
    if not holder or holder[-1][0] in PAGE:
        return path == holder
    return path[: len(holder)] == holder


def text_regions(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Where sums over `WINDOW` lines surge from 0 and dive to 0, as ranges of lines."""
    if not sizes.any():
        return []
    sums = np.convolve(sizes, np.ones(WINDOW, dtype=np.int64))
    full = np.concatenate(([0], (sums > 0).astype(np.int8), [0]))
    surges, dives = np.flatnonzero(np.diff(full) == 1), np.flatnonzero(np.diff(full) == -1)
    # sums[i] covers lines i - WINDOW + 1 to i, so a region's last lines are empty ones.
    return [(int(a), int(b) - WINDOW + 1) for a, b in zip(surges, dives, strict=True)]


def page_lines(page: str) -> tuple[list[str], np.ndarray, list[tuple[tuple[str, int], ...]]]:
    """Text lines in page order, dropped parts outside articles as `WINDOW` empty lines; which lines stand
    inside an article or main element; and the elements around each line's own block, from the root on."""
    lines: list[str] = []
    around: list[tuple[tuple[str, int], ...]] = []
    linking: list[bool] = []  # lines of which half or more is link text
    menus: list[bool] = []  # those of them that are a menu wherever they stand
    inside: list[bool] = []
    parts: list[str] = []
    linked: list[str] = []
    plain: list[str] = []
    n_links = 0
    stack: list[str] = []
    numbers: list[int] = []  # of the open elements
    holding: set[int] = set()  # elements with a block in them
    opened = 0
    hidden: int | None = None  # depth of the element that hides what follows
    place, end = 0, len(page)

    def flush() -> None:
        nonlocal n_links
        text = " ".join(html.unescape("".join(parts)).split())
        within = "article" in stack or "main" in stack
        if text:
            # Outside an article, links in a list, or one after the other, are a menu.
            own = not within and 2 * sum(map(len, linked)) >= len("".join(parts).strip())
            bare = n_links > 1 and not _LETTER.search(html.unescape("".join(plain)))
            lines.append(text)
            inside.append(within)
            linking.append(own)
            menus.append(own and (bare or not LISTS.isdisjoint(stack)))
            blocks = [
                (name, number)
                for name, number in zip(stack, numbers, strict=True)
                if name not in INLINE
            ]
            # A block that holds no other one is the line itself.
            if blocks and blocks[-1][0] not in PAGE and blocks[-1][1] not in holding:
                blocks.pop()
            around.append(tuple(blocks))
        parts.clear()
        linked.clear()
        plain.clear()
        n_links = 0

    def gap() -> None:
        if not ("article" in stack or "main" in stack):
            lines.extend([""] * WINDOW)
            inside.extend([False] * WINDOW)
            linking.extend([False] * WINDOW)
            menus.extend([False] * WINDOW)
            around.extend([()] * WINDOW)

    def close_to(depth: int) -> None:
        nonlocal hidden
        if any(name not in INLINE for name in stack[depth:]) and hidden is None:
            flush()
        leaving = any(name in ("article", "main") for name in stack[depth:])
        del stack[depth:]
        del numbers[depth:]
        if hidden is not None and len(stack) <= hidden:
            hidden = None
            gap()
        elif leaving:
            gap()

    def text(piece: str) -> None:
        if hidden is None and piece:
            parts.append(piece)
            (linked if "a" in stack else plain).append(piece.strip())

    while place < end:
        found = _MARKUP.search(page, place)
        if found is None:
            text(page[place:])
            break
        text(page[place : found.start()])
        place = found.end()
        name = found["name"]
        if name is None:
            continue
        name = name.lower()
        if found["end"]:
            if name in stack:
                close_to(len(stack) - 1 - stack[::-1].index(name))
            continue
        if name == "br":
            text(" ")
            continue
        if name not in INLINE:
            _imply_ends(name, stack, close_to)
            if hidden is None:
                flush()
        if name in RAW:
            closing = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE)
            stop = closing.search(page, place)
            place = stop.end() if stop else end
            continue
        if name in VOID or found["rest"].endswith("/") and name in ("svg", "path"):
            continue
        if name in ("article", "main") and not ("article" in stack or "main" in stack):
            gap()
        if hidden is None and _is_dropped(name, found["rest"]):
            if name in INLINE:
                parts.append(" ")
            hidden = len(stack)
        if name == "a" and hidden is None:
            n_links += 1
        if name not in INLINE and numbers:
            holding.add(numbers[-1])
        opened += 1
        stack.append(name)
        numbers.append(opened)
    if hidden is None:
        flush()
    for at, own in enumerate(linking):
        if own and (menus[at] or at and linking[at - 1] or at + 1 < len(linking) and linking[at + 1]):
            lines[at] = ""
    return lines, np.array(inside, dtype=bool), around


def _imply_ends(name: str, stack: list[str], close_to) -> None:
    """A block ends an open paragraph; an item ends the item before it."""
    for depth in range(len(stack) - 1, -1, -1):
        open_name = stack[depth]
        if open_name == "p" or open_name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            close_to(depth)
            return
        if open_name not in INLINE:
            return


def _is_dropped(name: str, rest: str) -> bool:
    if name in KEPT:
        return False
    if name in DROPPED:
        return True
    if not rest:
        return False
    values = {
        key.lower(): (a or b or c).lower() for key, a, b, c in _ATTRIBUTE.findall(rest)
    }
    tokens = f"{values.get('class', '')} {values.get('id', '')}".split()
    return (
        any(map(_is_named, tokens))
        or values.get("role") in ROLES
        or values.get("aria-hidden") == "true"
        or "display:none" in values.get("style", "").replace(" ", "")
        or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", rest) is not None
    )


def _is_named(token: str) -> bool:
    """Whether a class or id begins or ends with one of the names, and not with what it has or lacks."""
    words = _WORD.findall(token)
    return bool(words) and not NAMES.isdisjoint((words[0], words[-1])) and STATES.isdisjoint(words)


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from its whole html; nothing is shuffled.

    A null or empty page and one without an article have the empty text. Repeated rows stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "html"):
            texts = [main_text(page) for page in block.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("page_id"),
                    block.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                names,
            )

    names = ["page_id", "url", "text", "n_chars"]
    return pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        whole_text(F.col(html_col)).alias("html"),
    ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
