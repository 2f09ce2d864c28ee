"""Reading order of scanned pages, for whole Arrow batches at once.

A page is a text with one line per box.  Lines that a scanner read straight
across several columns are cut at wide gaps; pieces are put into columns by
where they begin, columns are read from left to right, and indented pieces
(adverts set into an article) form a flow of their own.  Everything works on
flat arrays over all lines of a batch; no page is handled by itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Width of a character where a page does not tell, in pixels.
CHARACTER = 10.85
#: A column begins where the next start is farther to the right than this.
COLUMN_GAP = 60
#: Pieces this much to the right of their column's edge are set in.
INDENT = 18
# What ends a line whose last word goes on in the next.
HYPHENS = "-‐¬\u00ad"


@dataclass
class Pieces:
    """Pieces of lines in reading order: page of each, its text, flow (0 the articles, 1 what is set in), and box."""

    page: np.ndarray
    text: pa.Array
    flow: np.ndarray
    pages: int


#: Bytes of text that are worked on at once.
BATCH_BYTES = 48 << 20


def bounded(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none has much more text than ``limit``; a single longer text stays whole."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def _flat(values: pa.ChunkedArray | pa.Array) -> pa.Array:
    return values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values


def normalised(texts: pa.Array) -> pa.Array:
    """Texts in Unicode's composed compatibility form (Arrow's own function leaves accents decomposed)."""
    return pa.array([t if t is None or t.isascii() or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def pieces(texts: pa.Array, boxes: pa.Array) -> Pieces:
    """Pieces of all pages; NULL and empty texts have none.  Lines without a box follow the page's last box, at the left edge."""
    texts = normalised(pc.replace_substring_regex(_flat(texts).fill_null(""), "\r\n?|\u2028|\u0085", "\n"))
    boxes = _flat(boxes)
    lines = pc.split_pattern(texts, "\n")
    per_page = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(lines)
    page = np.repeat(np.arange(len(texts)), per_page)
    within = np.arange(len(page)) - np.repeat(np.cumsum(per_page) - per_page, per_page)
    n_boxes = pc.fill_null(pc.list_value_length(boxes), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    box = pc.list_flatten(boxes)
    first_box = np.cumsum(n_boxes) - n_boxes
    has = within < n_boxes[page]
    at = np.where(has, first_box[page] + within, 0)
    side = {}
    for name in ("x0", "y0", "x1"):
        values = pc.fill_null(pc.struct_field(box, name).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) if len(box) else np.zeros(1)
        side[name] = np.where(has, values[at], 0.0)
    side["y0"] = np.where(has, side["y0"], 1e7 + within)
    left_edge = np.full(len(texts), np.inf)
    np.minimum.at(left_edge, page[has], side["x0"][has])
    side["x0"] = np.where(has, side["x0"], np.where(np.isfinite(left_edge), left_edge, 0.0)[page])

    cut = pc.split_pattern(flat, "   ")
    count = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    text = pc.utf8_trim_whitespace(pc.list_flatten(cut))
    line = np.repeat(np.arange(len(flat)), count)
    order = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    length = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.float64)
    width = side["x1"] - side["x0"]
    # Width of a character: the median over the lines of a page that were not read across.
    single = has & (count == 1) & (width > 0)
    own = np.full(len(flat), np.nan)
    own[single] = width[single] / np.maximum(length[np.cumsum(count) - count][single], 1)
    character = np.full(len(texts), CHARACTER)
    if single.any():
        s = np.flatnonzero(single & (length[np.cumsum(count) - count] >= 8))
        s = s[np.lexsort((own[s], page[s]))]
        known, first, number = np.unique(page[s], return_index=True, return_counts=True)
        character[known] = own[s][first + number // 2]
    total = np.bincount(line, weights=length, minlength=len(flat))
    gap = np.maximum(width - total * character[page], 0) / np.maximum(count - 1, 1)
    before = np.cumsum(length) - length
    before = before - before[np.repeat(np.cumsum(count) - count, count)]
    x = side["x0"][line] + before * character[page[line]] + order * gap[line]
    x = np.where(has[line], x, side["x0"][line])
    last = (order == count[line] - 1) & (order > 0) & has[line]
    x = np.where(last, side["x1"][line] - length * character[page[line]], x)
    keep = length > 0
    x, y, owner, line_no = x[keep], side["y0"][line][keep], page[line][keep], line[keep]
    text = text.filter(pa.array(keep))

    by_x = np.lexsort((x, owner))
    sx, so = x[by_x], owner[by_x]
    start = np.ones(len(sx), bool)
    start[1:] = (so[1:] != so[:-1]) | (sx[1:] - sx[:-1] > COLUMN_GAP)
    column = np.empty(len(sx), np.int64)
    column[by_x] = np.cumsum(start)
    edge = np.empty(len(sx))
    edge[by_x] = sx[start][np.cumsum(start) - 1] if len(sx) else sx
    flow = (x - edge > INDENT).astype(np.int8)
    reading = np.lexsort((line_no, y, column, flow, owner))
    return Pieces(owner[reading], text.take(pa.array(reading)), flow[reading], len(texts))


def joined(p: Pieces, keep: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """Each piece's text with what separates it from the next: nothing after a hyphen (which goes), else a blank.

    Together with the pieces' pages; the values, one after the other, are the
    running text.
    """
    text, page, flow = p.text, p.page, p.flow
    if keep is not None:
        text, page, flow = text.filter(pa.array(keep)), page[keep], flow[keep]
    follows = np.zeros(len(page), bool)
    follows[:-1] = (page[1:] == page[:-1]) & (flow[1:] == flow[:-1])
    broken = pc.match_substring_regex(text, rf"\pL[{HYPHENS}]$").to_numpy(zero_copy_only=False).astype(bool) & follows
    bare = pc.utf8_rtrim(text, characters=HYPHENS)
    text = pc.if_else(pa.array(broken), bare, pc.binary_join_element_wise(text, " ", ""))
    return text, page
