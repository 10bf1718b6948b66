"""Oversized texts to overlapping pieces under a byte limit, cut at natural boundaries.

Balanced targets: the least number of pieces is computed from the limit and
the overlap, that many equal-length targets are placed, each is snapped to the
strongest boundary near it, and a piece is added whenever a limit fails.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliospark.functions.arrow import map_rows

LIMIT, OVERLAP = 6000, 300

_SPACE = rb"(?:[ \t\n\r\x0b\x0c]|\xe3\x80\x80|\xc2\xa0|\xe2\x80[\x80-\x8a])"
#: Boundary patterns from strongest to weakest, on UTF-8 bytes; a cut is at the match's end.
_BOUNDARIES = (
    ("section", re.compile(rb"\n(?==|#{1,6} |\\(?:sub)*section|&lt;h[1-6])")),
    ("paragraph", re.compile(rb"\n[ \t\r]*\n+")),
    ("line", re.compile(rb"\n")),
    ("sentence", re.compile(rb"[.!?][\"')\]]*" + _SPACE + rb"+|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")),
    ("word", re.compile(_SPACE + rb"+")),
)


def _char_start(b: bytes, at: int) -> int:
    while 0 < at < len(b) and b[at] & 0xC0 == 0x80:
        at -= 1
    return at


def _nearest(places: list[int], low: int, target: int, high: int) -> int:
    """The place in (low, high] nearest to the target, -1 if there is none."""
    i = bisect_left(places, target)
    near = [x for x in places[max(0, i - 1) : i + 1] if low < x <= high]
    return min(near, key=lambda x: (abs(x - target), x), default=-1)


def _snap(kinds: list[tuple[str, list[int]]], low: int, target: int, high: int) -> tuple[int, str]:
    """The cut in (low, high] of the strongest kind, nearest to the target."""
    for kind, places in kinds:
        at = _nearest(places, low, target, high)
        if at >= 0:
            return at, kind
    return -1, "character"


def _overlap_start(b: bytes, kinds: list[tuple[str, list[int]]], low: int, cut: int, overlap: int) -> int:
    """Where the repeated end of the piece before begins: a sentence or word start where there is one."""
    at = max(low, cut - overlap)
    if at <= low:
        return low
    while at < cut and b[at] & 0xC0 == 0x80:
        at += 1
    for _, places in kinds[3:]:
        i = bisect_left(places, at)
        if i < len(places) and places[i] < cut:
            return places[i]
    return at


def balanced_cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, new content from, end, kind of cut at the end) in bytes, in order; one piece if the text fits.

    Every piece has at most `limit` bytes and repeats at most `overlap` bytes
    of the end of the one before; new contents joined give the text. The rest
    of the text is shared evenly among the pieces still planned; whenever a
    snap leaves more than they can hold, a piece is added. Time is linear in
    the text. Needs limit >= overlap + 8.
    """
    b = text.encode("utf-8", "surrogatepass")
    n = len(b)
    if n <= limit:
        return [(0, 0, n, "end")]
    kinds = [(kind, [m.end() for m in pattern.finditer(b)]) for kind, pattern in _BOUNDARIES]
    room = limit - overlap
    left = 1 + -(-(n - limit) // room)
    out: list[tuple[int, int, int, str]] = []
    fresh = start = 0
    while n - start > limit:
        left = max(left, 1 + -(-(n - start - limit) // room))
        size = (n - fresh) / left
        high = min(start + limit, n - 1)
        target = min(round(fresh + size), high)
        slack = max(8, int(size / 4))
        cut, kind = _snap(kinds, max(fresh, target - slack), target, min(high, target + slack))
        if cut < 0:  # no boundary near the target: the whole room of the piece
            cut, kind = _snap(kinds, fresh, target, high)
        if cut < 0:
            cut = _char_start(b, target)
            if cut <= fresh:
                cut = _char_start(b, high)
        out.append((start, fresh, cut, kind))
        start, fresh = _overlap_start(b, kinds, fresh, cut, overlap), cut
        left -= 1
    out.append((start, fresh, n, "end"))
    return out


_STRETCH = re.compile(r"[^\s.!?。！？]+")


def unbroken(text: str, limit: int = LIMIT) -> int:
    """Stretches over `limit` bytes without white space or sentence end."""
    return sum(1 for m in _STRETCH.finditer(text) if 4 * (m.end() - m.start()) > limit and len(m[0].encode("utf-8", "surrogatepass")) > limit)


def _pieces(pages: DataFrame, limit: int, overlap: int, with_text: bool) -> DataFrame:
    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in b.column("text").to_pylist():
            raw = text.encode("utf-8", "surrogatepass")
            cuts = balanced_cuts(text, limit, overlap)
            rows.append(
                [
                    {"piece_no": i, "start_at": s, "new_from": f, "end_at": e, "cut": k, "piece": raw[s:e].decode("utf-8", "surrogatepass") if with_text else None}
                    for i, (s, f, e, k) in enumerate(cuts, 1)
                ]
            )
        kind = pa.list_(
            pa.struct([("piece_no", pa.int32()), ("start_at", pa.int64()), ("new_from", pa.int64()), ("end_at", pa.int64()), ("cut", pa.string()), ("piece", pa.string())])
        )
        found = [unbroken(t, limit) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("rev_id"), pa.array(found, pa.int32()), pa.array(rows, kind)], ["rev_id", "unbroken", "pieces"])

    schema = "rev_id BIGINT, unbroken INT, pieces ARRAY<STRUCT<piece_no INT, start_at BIGINT, new_from BIGINT, end_at BIGINT, cut STRING, piece STRING>>"
    return map_rows(pages.select("rev_id", "text").where(F.octet_length("text") > limit), batch, schema)


def split_pages(pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """rev_id, piece_no, start_at, new_from, end_at (bytes), cut, piece of every text over the limit.

    Null, empty and fitting texts give no rows. A repeated revision is split
    once per distinct text. Other columns are ignored.
    """
    large = pages.where(F.octet_length("text") > limit).select("rev_id", "text", F.sha2("text", 256).alias("digest"))
    once = large.groupBy("rev_id", "digest").agg(F.first("text").alias("text"))
    return _pieces(once, limit, overlap, True).select("rev_id", F.inline("pieces"))


def oversized(pages: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """rev_id, unbroken of every revision that had to be split (more than one piece), once each."""
    p = _pieces(pages, limit, overlap, False).where(F.size("pieces") > 1)
    return p.groupBy("rev_id").agg(F.max("unbroken").alias("unbroken"))
