"""Cutting oversized items at natural boundaries (problem 4).

Method: recursive bisection. A text over the limit is cut at the strongest boundary in the middle half of
its span, nearest the midpoint among equals; each half that is still over the limit minus the overlap is cut
again. The overlaps are attached afterwards, beginning at a natural boundary too where one is near.

Only oversized rows reach Python; Spark finds them by length in the scan. Of them repeated rows are dropped first, by
key, text and breadcrumb, which shuffles the oversized rows and no others.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1600, 120
#: Boundaries from the strongest down; a cut comes right after a match. Fixed values.
BOUNDARIES = (
    re.compile(r"\n[ \t]*\n+"),
    re.compile(r"\n"),
    re.compile(r"[。！？!?…]+[”’\"')）】]*\s*|\.[”’\"')]*\s+"),
    re.compile(r"[;；:：]\s*"),
    re.compile(r"[,，、]\s*"),
    re.compile(r"\s+"),
)


def total_length(text: str = "text", breadcrumb: str = "breadcrumb") -> Column:
    """Code points of the text, plus those of the breadcrumb and 1 where that is neither null nor empty."""
    crumb = F.coalesce(F.length(breadcrumb), F.lit(0))
    return F.coalesce(F.length(text), F.lit(0)) + F.when(crumb > 0, crumb + 1).otherwise(0)


def _breaks_character(text: str, i: int) -> bool:
    """Whether a cut before ``text[i]`` parts a character from its combining marks or joiners."""
    c = text[i]
    return bool(unicodedata.combining(c)) or c in "\u200d\ufe0e\ufe0f" or text[i - 1] == "\u200d"


def cut_points(text: str, most: int) -> list[int]:
    """Ends of consecutive parts of at most ``most`` code points that together are the text."""
    if len(text) <= most:
        return [len(text)]
    ladder = [[m.end() for m in b.finditer(text)] for b in BOUNDARIES]

    def best(a: int, b: int) -> int:
        mid = (a + b) // 2
        lo, hi = max(a + 1, mid - (b - a) // 4), min(b - 1, mid + (b - a) // 4)
        for ends in ladder:
            i, j = bisect_left(ends, lo), bisect_right(ends, hi)
            if i < j:
                k = bisect_left(ends, mid, i, j)
                return min(ends[max(i, k - 1) : min(j, k + 1)], key=lambda e: abs(e - mid))
        cut = mid
        while cut > lo and _breaks_character(text, cut):
            cut -= 1
        return mid if cut == lo else cut

    done, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            done.append(b)
        else:
            c = best(a, b)
            todo += [(c, b), (a, c)]
    return done


def overlap_start(text: str, begin: int, overlap: int) -> int:
    """Where the repeat before ``begin`` starts: at most ``overlap`` code points back, at the strongest
    boundary within the last fifth of that stretch, else exactly there."""
    first = max(0, begin - overlap)
    window = text[first : first + overlap // 5 + 1]
    if first == 0:
        return 0
    for b in BOUNDARIES:
        if m := b.search(window):
            return min(first + m.end(), begin)
    return first


def split_item(text: str, breadcrumb: str | None, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, end, overlap_start, piece) of each piece; ``text[start:end]`` over all pieces is the text.

    A piece is the breadcrumb, a newline and its stretch of text from ``overlap_start`` to ``end``. A breadcrumb that
    would leave less room than two overlaps cannot stand before every piece: breadcrumb, newline and text are then cut
    as one, and places are counted from the beginning of the text, so that those in the breadcrumb are negative.
    """
    crumb = breadcrumb or ""
    head = crumb + "\n" if crumb else ""
    before = 0
    if limit - len(head) <= 2 * overlap:
        text, head, before = head + text, "", len(head)
    most = limit - len(head)
    ends = [len(text)] if len(text) <= most else cut_points(text, most - overlap)
    out, begin = [], 0
    for end in ends:
        back = overlap_start(text, begin, overlap) if begin else 0
        out.append((begin - before, end - before, back - before, head + text[back:end]))
        begin = end
    return out


def pieces(df: DataFrame, key: str = "parent_id", text: str = "text", breadcrumb: str = "breadcrumb", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, start, end, overlap_start, piece) of every item over the limit; others give no row.

    Lengths are counted, no length column is trusted. Null text counts as empty: it is over the limit only
    by its breadcrumb, and then is one empty piece. A repeated row gives its pieces once: rows are equal if
    key, text and breadcrumb are. Items under one key with different texts are all cut.
    """
    kind = df.schema[key].dataType.simpleString()
    long = df.select(df[key].alias("key"), df[text].alias("text"), df[breadcrumb].alias("crumb"))
    long = long.filter(total_length("text", "crumb") > limit).dropDuplicates(["key", "text", "crumb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "piece_no", "start", "end", "overlap_start", "piece"]
        for batch in batches:
            rows = []
            for k, t, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                rows += [(k, i, *p) for i, p in enumerate(split_item(t or "", c, limit, overlap))]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    out = long.mapInArrow(run, f"key {kind}, piece_no int, start int, end int, overlap_start int, piece string")
    return out.withColumnRenamed("key", key)
