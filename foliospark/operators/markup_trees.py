"""HTML and XML pages: tolerant parsing to node tables, repair with diagnostics, and accessibility audits."""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions.arrow import slices, spread

# Fixed values of HTML's content model.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {  # an opening tag ends these open elements
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "p": ("p",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "h1": ("p",), "h2": ("p",), "h3": ("p",), "ul": ("p",), "ol": ("p",), "table": ("p",), "div": ("p",), "thead": ("tr",), "tbody": ("thead", "tbody", "tr"),
}
SCOPES = frozenset(("table", "ul", "ol", "dl", "select", "body", "html", "div"))
CONTAINERS = frozenset("html head body div section article main table thead tbody tr ul ol dl form".split())  # too large to keep their text beside them
RENAMED = {"center": "div", "dir": "ul", "menu": "ul"}
DEPRECATED = ("font", "center", "basefont", "applet", "isindex", "menu", "dir", "strike", "u", "s", "blink", "marquee")


class _Builder(HTMLParser):
    """One pass over a page: a repaired serialisation, node rows and counts of what had to be mended."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.rows: list[dict] = []
        self.open: list[tuple[str, int]] = []
        self.warnings = self.errors = 0

    def _row(self, name: str, text: str | None, attrs: list) -> int:
        parent = self.open[-1][1] if self.open else -1
        path = (self.rows[parent]["path"] if parent >= 0 else "") + "/" + name
        self.rows.append({"node_id": len(self.rows), "parent_id": parent, "depth": len(self.open), "name": name, "text": text, "attrs": attrs, "subtree_end": len(self.rows) + 1, "path": path, "value": None})
        return len(self.rows) - 1

    def _close(self, to: int) -> None:
        while len(self.open) > to:
            name, at = self.open.pop()
            self.out.append(f"</{name}>")
            self.rows[at]["subtree_end"] = len(self.rows)

    def handle_starttag(self, tag, attrs):
        tag = RENAMED.get(tag, tag)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in CLOSES.get(tag, ()):
                self.warnings += 1
                self._close(k)
                break
            if self.open[k][0] in SCOPES:
                break
        seen: dict[str, str] = {}
        for k, v in attrs:
            if k in seen:
                self.warnings += 1
            else:
                seen[k] = v or ""
        at = self._row(tag, None, sorted(seen.items()))
        inner = "".join(f' {k}="{v.replace("&", "&amp;").replace(chr(34), "&quot;").replace("<", "&lt;")}"' for k, v in seen.items())
        if tag in VOID:
            self.out.append(f"<{tag}{inner}/>")
        else:
            self.out.append(f"<{tag}{inner}>")
            self.open.append((tag, at))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == RENAMED.get(tag, tag):
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        tag = RENAMED.get(tag, tag)
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.warnings += len(self.open) - 1 - k
                self._close(k)
                return
        if tag not in VOID:
            self.errors += 1

    def _text(self, raw: str):
        if self.rows and self.rows[-1]["name"] == "#text" and self.rows[-1]["parent_id"] == (self.open[-1][1] if self.open else -1):
            self.rows[-1]["text"] += unescape(raw)
        else:
            self._row("#text", unescape(raw), [])
        self.out.append(raw if raw.startswith("&") and raw.endswith(";") else raw.replace("<", "&lt;").replace(">", "&gt;"))

    def handle_data(self, data):
        self._text(data.replace("&", "&amp;") if self.open and self.open[-1][0] in ("script", "style") else re.sub(r"&(?!#?\w+;)", "&amp;", data))

    def handle_entityref(self, name):
        self._text(f"&{name};" if f"{name};" in html5 else f"&amp;{name}")

    def handle_charref(self, name):
        self._text(f"&#{name};")

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self._text(data[6:].replace("&", "&amp;"))

    def done(self):
        self.close()
        self.errors += sum(1 for name, _ in self.open if name not in ("p", "li", "td", "tr", "th", "dt", "dd", "option", "html", "body"))
        self._close(0)
        for r in self.rows:
            if r["name"] != "#text" and r["name"] not in CONTAINERS:
                r["value"] = "".join(x["text"] for x in self.rows[r["node_id"] : r["subtree_end"]] if x["text"])
        return "".join(self.out), self.rows, self.warnings, self.errors


def repair(html: str) -> tuple[str, list[dict], int, int]:
    """Repaired text, node rows, warnings and errors of one page. Comments go."""
    b = _Builder()
    b.feed(html)
    return b.done()


_NODE = "struct<node_id:int,parent_id:int,depth:int,name:string,text:string,attrs:map<string,string>,subtree_end:int,path:string,value:string>"


def repaired(pages: DataFrame, keys: list[str], column: str = "html") -> DataFrame:
    """keys, clean, nodes, warnings, errors of every page; null pages give no row. One Arrow pass, no shuffle."""
    picked = pages.where(F.col(column).isNotNull()).select(*keys, F.col(column).alias("_html"))
    schema = ", ".join(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys) + f", clean string, nodes array<{_NODE}>, warnings int, errors int"
    nodes = pa.list_(pa.struct([("node_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("text", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("subtree_end", pa.int32()), ("path", pa.string()), ("value", pa.string())]))

    def run(batches):
        for b in (part for whole in batches for part in slices(whole)):
            done = [repair(h) for h in b.column("_html").to_pylist()]
            cols = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), nodes, pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), *cols], [*keys, "clean", "nodes", "warnings", "errors"])

    return spread(picked).mapInArrow(run, schema)


# ---------------------------------------------------------- Catalyst expressions on pages


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*?href=\"([^\"]*)\""), F.lit(1))


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; white space runs become one blank."""
    bare = F.regexp_replace(without_comments(html), r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?s)<[^>]*>", " "), r"\s+", " "))


def plain_typography(s: Column) -> Column:
    """Typographic quotes, dashes and blanks as ASCII."""
    return F.translate(s, "“”„‘’–— ", "\"\"\"''-- ")


def heading_levels(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])\b"), F.lit(1)), lambda x: x.cast("int"))


def skipped_headings(html: Column) -> Column:
    """How often a heading is more than one level below the one before (the first counts from 0)."""
    levels = heading_levels(html)
    before = F.concat(F.array(F.lit(0)), levels)
    return F.size(F.filter(F.arrays_zip(levels.alias("h"), F.slice(before, F.lit(1), F.size(levels)).alias("b")), lambda p: p["h"] > p["b"] + 1)).cast("bigint")


def tag_count(html: Column, tag: str, having: str | None = None, lacking: str | None = None) -> Column:
    """Tags of a name, with or without an attribute."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?i)(<{tag}\b[^>]*>)"), F.lit(1))
    if having:
        tags = F.filter(tags, lambda t: t.rlike(rf"(?i)\s{having}\s*="))
    if lacking:
        tags = F.filter(tags, lambda t: ~t.rlike(rf"(?i)\s{lacking}\s*="))
    return F.size(tags).cast("bigint")


def contrast(foreground: str, background: str) -> tuple[int, int]:
    """Brightness and colour difference of two #rrggbb colours."""
    (a, b, c), (x, y, z) = ([int(h[i : i + 2], 16) for i in (1, 3, 5)] for h in (foreground, background))
    bright = lambda r, g, b: (r * 299 + g * 587 + b * 114) // 1000
    return abs(bright(a, b, c) - bright(x, y, z)), abs(a - x) + abs(b - y) + abs(c - z)


def audit(pages: DataFrame, keys: list[str], column: str = "html") -> DataFrame:
    """keys and one count per accessibility finding of each page."""
    h = F.col(column)
    return pages.select(
        *keys, tag_count(h, "img", lacking="alt").alias("img_no_alt"), tag_count(h, "area", lacking="alt").alias("area_no_alt"), tag_count(h, "table", lacking="summary").alias("table_no_summary"), tag_count(h, "html", lacking="lang").alias("html_no_lang"),
        tag_count(h, "input", lacking="id").alias("input_no_id"), tag_count(h, "frame", lacking="title").alias("frame_no_title"), tag_count(h, "script").alias("scripts"), tag_count(h, "a", lacking="href").alias("anchor_no_href"),
        F.aggregate(F.array(*(tag_count(h, t) for t in DEPRECATED)), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("deprecated"), skipped_headings(h).alias("skipped_headings"), (~h.rlike(r"(?i)\A\s*<!doctype")).alias("no_doctype"),
    )
