"""Problem 5: cut oversized page texts and tables into overlapping pieces at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Sentences (or rows) on each side of a gap whose words are compared.
BLOCK = 4
_SENTENCE = re.compile(r"(?:[.!?][\"'”’)\]]*\s+|[。！？]\s*|\n\s*\n\s*)")
_WORD = re.compile(r"[^\W\d_]{3,}")
_GAP = re.compile(r"\s+")
CELL, ROW = " | ", "\n"


def gap_depths(units: list[str], block: int = BLOCK) -> list[float]:
    """Depth of the cohesion valley after each unit but the last.

    The words of ``block`` units before a gap and after it are compared by cosine; the depth is how far the
    similarity rises to the next peak on either side.
    """
    bags = [Counter(w.lower() for w in _WORD.findall(u)) for u in units]
    n = len(bags)
    if n < 2:
        return []
    left, right = Counter(), Counter()
    for b in bags[1 : 1 + block]:
        right.update(b)
    left.update(bags[0])
    scores = []
    for g in range(1, n):
        small, large = (left, right) if len(left) < len(right) else (right, left)
        dot = sum(c * large[w] for w, c in small.items() if w in large)
        norm = (sum(c * c for c in left.values()) * sum(c * c for c in right.values())) ** 0.5
        scores.append(dot / norm if norm else 0.0)
        if g < n - 1:
            left.update(bags[g])
            if g >= block:
                left.subtract(bags[g - block])
                left = +left
            right.subtract(bags[g])
            right = +right
            if g + block < n:
                right.update(bags[g + block])
    rise_left, rise_right = scores[:], scores[:]
    for i in range(1, len(scores)):
        rise_left[i] = max(scores[i], rise_left[i - 1]) if scores[i - 1] >= scores[i] else scores[i]
    for i in range(len(scores) - 2, -1, -1):
        rise_right[i] = max(scores[i], rise_right[i + 1]) if scores[i + 1] >= scores[i] else scores[i]
    return [a + b - 2 * s for a, b, s in zip(rise_left, rise_right, scores)]


def text_boundaries(text: str) -> dict[int, float]:
    """Starts of sentences and paragraphs and how good a cut before each is: the valley's depth, plus one before a paragraph."""
    cuts = [m.end() for m in _SENTENCE.finditer(text) if 0 < m.end() < len(text)]
    edges = [0, *cuts, len(text)]
    depths = gap_depths([text[a:b] for a, b in zip(edges, edges[1:])])
    return {p: d + ("\n\n" in text[max(0, p - 4) : p]) for p, d in zip(cuts, depths)}


def _best(text: str, cuts: list[int], worth: dict[int, float], lo: int, hi: int) -> int:
    """The deepest valley in [lo, hi]; without any the last line end, the last word end, at worst hi."""
    inside = cuts[bisect_left(cuts, lo) : bisect_right(cuts, hi)]
    if inside:
        return max(inside, key=lambda p: (worth[p], p))
    if (p := text.rfind("\n", lo, hi)) >= 0:
        return p + 1
    spaces = [m.end() for m in _GAP.finditer(text, lo, hi)]
    return spaces[-1] if spaces else hi


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of at most ``limit`` characters that cover ``text``; each begins exactly ``overlap`` characters before the end of the one before it.

    An overlap that leaves no room for new text is an error.
    """
    if not 0 <= overlap < limit:
        raise ValueError(f"an overlap of {overlap} doesn't fit a limit of {limit}")
    if len(text) <= limit:
        return [(0, len(text))]
    worth = text_boundaries(text)
    cuts, spans, start = sorted(worth), [], 0
    while len(text) - start > limit:
        end = _best(text, cuts, worth, start + max(overlap + 1, limit // 2), start + limit)
        spans.append((start, end))
        start = end - overlap
    spans.append((start, len(text)))
    return spans


def split_rows(text: str, lengths: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of a rendered table that begin and end at rows; neighbours share exactly ``overlap`` rows.

    Only where ``overlap`` + 1 rows in succession are too long for one piece, the long ones among them are cut into parts at natural boundaries; the parts
    then count as rows.  An overlap that leaves no room for rows of a character is an error.
    """
    room = (limit + 1) // (overlap + 1) - 1  # so many characters to each of overlap + 1 rows, with their line breaks, always fit
    if overlap < 0 or room < 1:
        raise ValueError(f"an overlap of {overlap} rows doesn't fit a limit of {limit}")
    if len(text) <= limit:
        return [(0, len(text))]
    starts = [0]
    for n in lengths:
        starts.append(starts[-1] + n + len(ROW))
    long_rows = {k for i in range(max(1, len(lengths) - overlap)) if starts[min(i + overlap + 1, len(lengths))] - 1 - starts[i] > limit for k in range(i, min(i + overlap + 1, len(lengths))) if lengths[k] > room}
    units = []
    for k, n in enumerate(lengths):
        at = starts[k]
        units += [(at + a, at + b) for a, b in (split_text(text[at : at + n], room, 0) if k in long_rows else [(0, n)])]
    depths = gap_depths([text[a:b] for a, b in units])
    spans, first = [], 0
    while True:
        begin = units[first][0]
        last = first
        while last + 1 < len(units) and units[last + 1][1] - begin <= limit:
            last += 1
        if last == len(units) - 1:
            spans.append((begin, units[last][1]))
            return spans
        least = next((k for k in range(first, last + 1) if units[k][1] - begin >= limit // 2), last)
        end = max(range(max(least, first + overlap), last + 1), key=lambda k: (depths[k], k), default=last)
        spans.append((begin, units[end][1]))
        first = max(end + 1 - overlap, first + 1)


def oversized_items(pages: DataFrame, tables: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, item_id, text, row_lengths, max_chars, overlap) of the items longer than their limit, found on the JVM.

    A null page text, null rows or an item kind without limits isn't oversized; a null row or cell is empty.
    """
    small = F.broadcast(limits.select("item_kind", "max_chars", "overlap_chars", "overlap_rows"))  # one row for each kind of item
    cells = F.transform("rows", lambda r: F.coalesce(F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), CELL), F.lit("")))
    page = pages.select(F.lit("page").alias("item_kind"), F.col("page_id").alias("item_id"), F.col("full_text").alias("text"), F.lit(None).cast("array<int>").alias("row_lengths"))
    grid = tables.select(F.lit("table").alias("item_kind"), F.col("table_id").alias("item_id"), cells.alias("_rows"))
    grid = grid.select("item_kind", "item_id", F.array_join("_rows", ROW).alias("text"), F.transform("_rows", lambda r: F.length(r)).alias("row_lengths"))
    both = page.unionByName(grid).join(small, "item_kind").where(F.length("text") > F.col("max_chars"))
    overlap = F.when(F.col("item_kind") == "table", F.col("overlap_rows")).otherwise(F.col("overlap_chars"))
    return both.select("item_kind", "item_id", "text", "row_lengths", "max_chars", F.coalesce(overlap, F.lit(0)).alias("overlap"))


def pieces(pages: DataFrame, tables: DataFrame, limits: DataFrame) -> DataFrame:
    """One row per piece of an oversized item: (item_kind, item_id, piece_no, n_pieces, start, end, piece).

    ``start`` and ``end`` are code points of the page text or of the table rendered with " | " and line breaks.
    Every piece is within the limit, the pieces cover the item in order, and neighbours share exactly the stated
    overlap (characters for pages, rows for tables).  Only oversized items leave the JVM; nothing is shuffled.
    """
    schema = "item_kind string, item_id bigint, piece_no int, n_pieces int, start int, end int, piece string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                limit, overlap = int(r.max_chars), int(r.overlap)
                spans = split_text(r.text, limit, overlap) if r.row_lengths is None else split_rows(r.text, [int(n) for n in r.row_lengths], limit, overlap)
                out += [(r.item_kind, r.item_id, k + 1, len(spans), a, b, r.text[a:b]) for k, (a, b) in enumerate(spans)]
            yield pd.DataFrame(out, columns=["item_kind", "item_id", "piece_no", "n_pieces", "start", "end", "piece"])

    return oversized_items(pages, tables, limits).mapInPandas(run, schema)


def oversized(pages: DataFrame, tables: DataFrame, limits: DataFrame) -> DataFrame:
    """(item_kind, item_id) of the items that :func:`pieces` cuts."""
    return pieces(pages, tables, limits).where("piece_no = 1 AND n_pieces > 1").select("item_kind", "item_id").distinct()
