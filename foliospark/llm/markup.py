"""Markup residue to clean text, keeping headings, list items, code and formulas.

Pages mix wikitext, HTML, Markdown and LaTeX, and one line sign can mean two
things: `# x` is a list item in wikitext and a heading in Markdown. What a
marker means is not written down here but inferred from all pages: the blocks
of one host dialect become token streams (one token per line sign or tag, a
slot for text), which are folded (tandem repeats become groups), counted, and
aligned one after the other into a union-free expression with text slots,
optional groups and repeated groups: the host's wrapper. A marker that stands in
repeated groups more often than alone opens items, one that stands alone before
a slot opens headings. `#` blocks in regions without the signs of a dialect are
read by the host whose wrapper accepts their stream.

Code blocks and formulas are opaque spans (see the lexer) and no part of it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliospark.functions.arrow import map_rows
from foliospark.functions.stage import written
from foliospark.wikitext.lexer import calls, headings, masked, opaque_spans, unescape_once

# ---------------------------------------------------------------- wrappers


def fold(stream: str) -> tuple[str, ...]:
    """Tandem repeats of one token become a repeated group: 'hhT' -> ('(h)+', 'T')."""
    out: list[str] = []
    for m in re.finditer(r"(.)\1*", stream):
        out.append(f"({m[1]})+" if len(m[0]) > 1 else m[1])
    return tuple(out)


def _core(node: str) -> str:
    return node.strip("()+?")


def align(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    """Merge two union-free expressions; what only one of them has becomes optional."""
    ka, kb = [_core(x) for x in a], [_core(x) for x in b]
    out: list[str] = []
    for op, i, j, k, m in SequenceMatcher(None, ka, kb, autojunk=False).get_opcodes():
        if op == "equal":
            for x, y in zip(a[i:j], b[k:m]):
                repeated, optional = "+" in x or "+" in y, x.endswith("?") or y.endswith("?")
                core = f"({_core(x)})+" if repeated else _core(x)
                out.append(f"({core})?" if optional else core)
        else:
            out.extend(x if x.endswith("?") else f"({x})?" for x in (*a[i:j], *b[k:m]))
    return tuple(out)


def induce(counts: dict[tuple[str, ...], int]) -> tuple[str, ...]:
    """The wrapper of a host: all its folded streams aligned one by one, commonest first."""
    wrapper: tuple[str, ...] = ()
    for s in sorted(counts, key=lambda s: (-counts[s], s)):
        wrapper = align(wrapper, s) if wrapper else s
    return wrapper


def accepts(wrapper: tuple[str, ...], stream: str) -> bool:
    """Whether a wrapper covers a stream whole; time grows as their product, however many groups are optional."""
    at = {0}
    for node in wrapper:
        core, after = _core(node), set(at) if node.endswith("?") else set()
        for p in at:
            while p < len(stream) and stream[p] == core:
                p += 1
                after.add(p)
                if "+" not in node:
                    break
        at = after
    return len(stream) in at


_FOREIGN = re.compile(r"\]\(\w+:|\*\*[^\s*][^*\n]*\*\*|(?<!\w)_[^\s_][^_\n]*_(?!\w)|^(?:```|~~~|> |[-+] \S|\d{1,3}[.)] )", re.M)
_NATIVE = re.compile(r"\[\[|'''|\{\{|<ref\b")
_HASH = re.compile(r"^\x01*#+(?!redirect\b)", re.M | re.I)


def dialect(region: str) -> str:
    """wiki, markdown or unknown, by signs that only one of them has."""
    foreign, native = bool(_FOREIGN.search(region)), bool(_NATIVE.search(region))
    return "unknown" if foreign == native else "markdown" if foreign else "wiki"


def _blocks(region: str) -> list[tuple[int, str]]:
    return [(m.start(), m[0]) for m in re.finditer(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*", region)]


#: One token per line: e = headed =, s star, h hash, d definition signs, m dash, n number, I and S LaTeX, L and H tags, T text.
_TOKEN = re.compile(
    r"^\x01*(?P<e>={2,}[^\n]*[^=\s\x01][^\n]*={2,}[ \t\r\x01]*$)|^\x01*(?P<s>\*+)|^\x01*(?P<h>#+)(?!redirect\b)|^\x01*(?P<d>[:;]+)"
    r"|^[ \t]*(?:> ?)*[ \t]*(?:(?P<m>[-+])|(?P<n>\d{1,3}[.)]))[ \t]+(?=\S)"
    r"|(?:^[ \t]*)?(?:(?P<L><li\b)|(?P<H><h[1-6]\b)|(?P<I>\\item\b)|(?P<S>\\(?:part|chapter|section|subsection|subsubsection|paragraph)\b))"
    r"|^(?P<T>(?=[^\n]*\S)(?:(?!<li\b|<h[1-6]\b|\\item\b|\\(?:sub)*section\b)[^\n])+)",
    re.M | re.I,
)
#: What a marker usually opens counts as so many pages that show it; more pages outvote it, at any size of the corpus.
PRIOR = 4
_USUAL = {**dict.fromkeys("sdmnLI", "item"), **dict.fromkeys("eHSu", "heading")}


def _stream(block: str) -> str:
    return "".join(m.lastgroup for m in _TOKEN.finditer(block))


def _regions(mask: str, heads: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    cuts = [0, *(end for _, end, _ in heads), len(mask)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def _host(stream: str, region: str) -> str:
    """The dialect of a block: by tags and commands, else by the signs of its region."""
    return "html" if "L" in stream or "H" in stream else "latex" if "I" in stream or "S" in stream else dialect(region)


def shapes(mask: str, heads: list[tuple[int, int, int]]) -> set[tuple[str, str]]:
    """(host dialect, block stream with runs cut to two) of the blocks with markers in masked text."""
    out: set[tuple[str, str]] = set()
    for a, b in [(s, e) for s, e, _ in heads] + _regions(mask, heads):
        region = mask[a:b]
        for _, block in _blocks(region):
            stream = _stream(block)
            if stream.strip("T"):
                host = _host(stream, region)
                if host != "unknown" or "h" not in stream:
                    out.add((host, re.sub(r"(.)\1+", r"\1\1", stream)))
    return out


class Wrappers:
    """The wrapper of each host dialect, how often its pages show each shape, and what its markers open. Dialects without a page keep their usual form."""

    def __init__(self, counts: dict[str, dict[tuple[str, ...], int]]):
        usual = {"wiki": {("(h)+",): 1}, "markdown": {("h",): 1}}
        self.counts = {host: counts.get(host) or usual[host] for host in usual} | {h: c for h, c in counts.items() if h not in usual}
        self.wrapper = {host: induce({k: n for k, n in c.items() if host not in usual or "h" in map(_core, k)} or usual.get(host, {})) for host, c in self.counts.items()}
        self.total = {host: max(1, sum(n for k, n in c.items() if "h" in map(_core, k))) for host, c in self.counts.items()}
        self.role = dict(_USUAL)
        repeated: dict[str, int] = {x: PRIOR if kind == "item" else -PRIOR for x, kind in _USUAL.items()} | {"h wiki": PRIOR, "h markdown": -PRIOR}
        for host, c in self.counts.items():
            for shape, n in c.items():
                for node in shape:
                    key = _core(node) if _core(node) != "h" else f"h {host}"
                    repeated[key] = repeated.get(key, 0) + (n if "+" in node else -n)
        for key, n in repeated.items():
            if key != "T":
                self.role[key] = "item" if n > 0 else "heading"

    def host(self, stream: str) -> str | None:
        """The host whose wrapper covers a stream; of two, the one that shows its shape more often, for its size."""
        fits = [h for h in ("markdown", "wiki") if accepts(self.wrapper[h], stream)]
        shape = fold(stream)
        return max(fits, key=lambda h: self.counts[h].get(shape, 0) / self.total[h], default=None)

    def kind(self, letter: str, stream: str | None) -> str:
        """What a marker opens; for hash lines `stream` is their block's, and `letter` says the region's dialect (w, k or q for none)."""
        if letter in "wkq":
            host = {"w": "wiki", "k": "markdown"}.get(letter) or self.host(stream)
            return self.role.get(f"h {host}", "item")
        return _KIND_OF.get(letter) or self.role[letter]


_KIND_OF = {"c": "code", "f": "formula", "i": "item"}


# ---------------------------------------------------------------- units

_ITEM = re.compile(
    r"^\x01*(?:\*(?!\*?[^\s*][^*\n]*\*\*)(?!\*\*[^\s*])|[:;]+)[*#:;]*(?=[^*#:;\n])"
    r"|^\x01*\*\*+[#*:;]*(?![^\s*][^*\n]*\*\*)(?=[^*#:;\n])"
    r"|^[ \t]*(?:> ?)*[ \t]*(?:[-+*]|\d{1,3}[.)])[ \t]+\S"
    r"|\\item\b|<li\b[^>]*>",
    re.M | re.I,
)
_TAG_HEADING = re.compile(r"<h[1-6]\b[^>]*>|\\(?:part|chapter|section|subsection|subsubsection|paragraph)\*?\s*(?:\[[^\]\n]*\])?\{", re.I)
_SETEXT = re.compile(r"(?:\A|\n[ \t]*\n|\A\n)[ ]{0,3}(?=[^\s\-=|#>*])([^\n]+)\n[ ]{0,3}(?:={2,}|-{2,})[ \t]*(?=\n|\Z)")


_LETTERS = {"*": "s", ":": "d", ";": "d", "-": "m", "+": "m", "\\": "I", "<": "L"}


def marks(mask: str, spans: list[tuple[int, int, str]], heads: list[tuple[int, int, int]]) -> list[tuple[int, str, str | None]]:
    """(start, marker letter, block stream of an undecided hash line) in order of the first character."""
    out: list[tuple[int, str, str | None]] = [(start, kind[0], None) for start, _, kind in spans if kind == "code" or kind == "formula"]
    out += [(start, "e", None) for start, _, _ in heads]
    if "<" in mask or "\\" in mask:
        out += [(m.start(), "H" if m[0][0] == "<" else "S", None) for m in _TAG_HEADING.finditer(mask)]
    if "\n==" in mask or "\n--" in mask:
        out += [(m.start(1), "u", None) for m in _SETEXT.finditer(mask)]
    for m in _ITEM.finditer(mask):
        sign = m[0].lstrip("\x01 \t>")[:1]
        out.append((m.start(), _LETTERS.get(sign, "n"), None))
    if "#" in mask and _HASH.search(mask):
        for a, b in _regions(mask, heads):
            region = mask[a:b]
            if "#" not in region:
                continue
            host = {"wiki": "w", "markdown": "k"}.get(dialect(region), "q")
            for at, block in _blocks(region):
                if "#" not in block or "h" not in (stream := _stream(block)):
                    continue
                for m in _HASH.finditer(block):
                    rest = block[m.end() : m.end() + 1]
                    if rest not in ("", "\n"):
                        out.append((a + at + m.start(), host if rest in " \t" else "i", stream if host == "q" else None))
    out.sort(key=lambda x: x[0])
    return out


def units(text: str, wrappers: Wrappers) -> list[tuple[int, str]]:
    """(start, kind) of the structural units of unescaped text in order of their first character."""
    spans = opaque_spans(text)
    mask = masked(text, spans)
    return [(start, wrappers.kind(letter, stream)) for start, letter, stream in marks(mask, spans, headings(mask))]


def _mark_batch(b: pa.RecordBatch) -> pa.RecordBatch:
    letters, streams, seen = [], [], []
    for text in b.column("text").to_pylist():
        text = unescape_once(text)
        spans = opaque_spans(text)
        mask = masked(text, spans)
        heads = headings(mask)
        found = marks(mask, spans, heads)
        letters.append("".join(x for _, x, _ in found))
        streams.append([s for _, x, s in found if x == "q"])
        seen.append([f"{h} {x}" for h, x in sorted(shapes(mask, heads))] if found else [])
    cols = [b.column("rev_id"), pa.array(letters, pa.string()), pa.array(streams, pa.list_(pa.string())), pa.array(seen, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cols, ["rev_id", "letters", "streams", "shapes"])


def marked_pages(pages: DataFrame) -> DataFrame:
    """rev_id, letters (one per marker), streams (of undecided hash lines), shapes: all texts lexed once, written to the shared folder."""
    texts = pages.where(F.length("text") > 0).select(F.col("rev_id").cast("long").alias("rev_id"), "text")
    return written(map_rows(texts, _mark_batch, "rev_id BIGINT, letters STRING, streams ARRAY<STRING>, shapes ARRAY<STRING>"), "markers")


def inferred(marked: DataFrame) -> Wrappers:
    """Wrappers from all pages; each shape counts once per revision. Only distinct shapes and their counts reach the driver."""
    counts: dict[str, dict[tuple[str, ...], int]] = {}
    for row in marked.select("rev_id", F.explode("shapes").alias("shape")).distinct().groupBy("shape").count().collect():
        host, shape = row["shape"].split(" ")
        folded = fold(shape)
        of = counts.setdefault(host, {})
        of[folded] = of.get(folded, 0) + row["count"]
    return Wrappers(counts)


_KINDS = ("heading", "item", "code", "formula")


def structural_units(pages: DataFrame) -> DataFrame:
    """rev_id, unit_no, kind of every structural unit of every page revision.

    `pages` needs rev_id and text (escaped). Null, empty and unit-free texts
    give no rows. A revision that occurs twice counts once. Wrappers are
    inferred from all pages and decide what every marker opens. Other columns
    are ignored. One shuffle of short unit strings, by rev_id.
    """
    marked = marked_pages(pages)
    wrappers = inferred(marked)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for letters, streams in zip(b.column("letters").to_pylist(), b.column("streams").to_pylist()):
            undecided = iter(streams)
            found.append("".join(wrappers.kind(x, next(undecided) if x == "q" else None)[0] for x in letters))
        return pa.RecordBatch.from_arrays([b.column("rev_id"), pa.array(found, pa.string())], ["rev_id", "units"])

    found = map_rows(marked.where("letters <> ''").select("rev_id", "letters", "streams"), batch, "rev_id BIGINT, units STRING")
    once = found.groupBy("rev_id").agg(F.min("units").alias("units"))
    names = F.create_map(*(x for k in _KINDS for x in (F.lit(k[0]), F.lit(k))))
    return once.select("rev_id", F.posexplode(F.split("units", "(?<=.)(?=.)")).alias("at", "u")).select(
        "rev_id", (F.col("at") + 1).alias("unit_no"), names[F.col("u")].alias("kind")
    )


# ---------------------------------------------------------------- clean text

_DROP = re.compile(
    r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref\s*>|<(?P<t>style|script)\b.*?</(?P=t)\s*>|<!--.*?-->|<!--.*\Z"
    r"|\[\[(?:category|file|image|media):(?:[^\[\]]|\[\[[^\[\]]*\]\])*\]\]",
    re.S | re.I,
)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_EXT = re.compile(r"\[\w+://\S+[ ]?([^\]\n]*)\]|!?\[([^\]\n]*)\]\([^)\n]*\)")
_TAGS = re.compile(r"</?[a-zA-Z][^<>]*>|'{2,}|\*\*|__(?:NO)?TOC__|~?\\cite\{[^}]*\}|\\(?:footnote|label)\{[^}]*\}|\\(?:begin|end)\{[^}]*\}|\\documentclass\{[^}]*\}")
_CMD = re.compile(r"\\(?:emph|textbf|textit|texttt|section|subsection|subsubsection)\*?\{([^{}]*)\}")
_NAMED = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"))


def _inline(piece: str) -> str:
    piece = _CMD.sub(r"\1", _EXT.sub(lambda m: m[1] or m[2] or "", _LINK.sub(r"\1", piece)))
    piece = _TAGS.sub("", piece)
    for name, sign in _NAMED:
        piece = piece.replace(name, sign)
    return piece


_VARIABLE_OR_LINK = re.compile(r"\{\{\{[^{}]*\}\}\}|\[\[[^\[\]]*\]\]")
_KEY = re.compile(r"[ \t]*[\w .\-]*=[ \t]*|")
_ROW = re.compile(r"\n?[ \t]*\|-[^\n]*|\n[ \t]*\|\}|\n[ \t]*(?:\|\+?|!)(?:[^|!\n\[{}]*=[^|!\n\[{}]*\|(?!\|))?|(?:\|\||!!)(?:[^|!\n\[{}]*=[^|!\n\[{}]*\|(?!\|))?")


def _call_signs(mask: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of the signs, names and keys of calls; the values stay."""
    found = calls(mask)
    inner: dict[int, list[list[int]]] = {}
    for c in found:
        inner.setdefault(c[2], []).append(c)
    out = []
    for i, (start, end, _, _) in enumerate(found):
        body, at = [], start + 2
        for a, b, _, _ in inner.get(i, []):
            body += [mask[at:a], "\x00" * (b - a)]
            at = b
        body = _VARIABLE_OR_LINK.sub(lambda m: "\x00" * len(m[0]), "".join(body) + mask[at : end - 2])
        bars = [start + 2 + m.start() for m in re.finditer(r"\|", body)]
        out.append((start, bars[0] if bars else end - 2, ""))
        out += [(x, start + 2 + _KEY.match(body, x - start - 1).end(), " " if n else "") for n, x in enumerate(bars)]
        out.append((end - 2, end, ""))
    return out


def _table_signs(mask: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of the signs and attributes of tables; rows become lines, cells stand side by side."""
    out = []
    for t in re.finditer(r"^[ \t:]*(\{\|[^\n]*)(.*?)\n[ \t]*\|\}", mask, re.M | re.S):
        out.append((*t.span(1), ""))
        fresh = True
        for m in _ROW.finditer(mask, t.end(1), t.end()):
            sign = m[0].strip()
            row = sign.startswith(("|-", "|}"))
            out.append((*m.span(), "\n" if row else "" if fresh else " "))
            fresh = row
    return out


def _around(text: str, cuts: list[tuple[int, int, str]], marks: list[tuple[int, str]], keep: dict) -> list[tuple[int, int, str]]:
    """The cuts without the units inside them; a heading or item reaches to the end of its line."""
    starts = [s for s, _ in marks]
    out = []
    for start, end, put in cuts:
        for k in range(bisect_left(starts, start), bisect_left(starts, end)):
            at, kind = marks[k]
            if at < start:
                continue
            if at > start:
                out.append((start, at, put))
            line = text.find("\n", at)
            stop = keep[at][0] if kind in ("code", "formula") else line if line >= 0 else len(text)
            start = max(start, min(stop, end))
        if start < end:
            out.append((start, end, put))
    return out


def clean(text: str, wrappers: Wrappers) -> str:
    """Clean text of one page: one block per line group; units are marked `[kind] `, in order.

    Code and formulas are kept as written. Calls give the values of their
    parameters, tables one line per row. Comments, references, files and
    categories go, but not a unit that lies inside them.
    """
    spans = opaque_spans(text)
    mask = masked(text, spans)
    found = units(text, wrappers)
    keep = {s: (e, k) for s, e, k in spans}
    cut = _around(text, [(*m.span(), "") for m in _DROP.finditer(mask)] + _call_signs(mask) + _table_signs(mask), found, keep)
    out: list[str] = []
    at = 0
    events = sorted([(s, 0, e, put) for s, e, put in cut] + [(s, 1, s, k) for s, k in found] + [(s, 2, e, k) for s, (e, k) in keep.items()])
    for start, what, end, kind in events:
        if start < at:
            continue
        out.append(_inline(text[at:start]))
        at = max(at, start)
        if what == 0:
            out.append(kind)
            at = end
        elif what == 1:
            if kind in ("code", "formula"):
                stop = keep[start][0]
                out.append(f"\n[{kind}] {text[start:stop]}\n" if kind == "code" else f"[formula] {text[start:stop]}")
                at = stop
            else:
                out.append(f"\n[{kind}] ")
                line = re.compile(r"[ \t]*(?:<(?:li|h[1-6])\b[^>]*>|\\item\b|={2,}|[*#:;]+|[-+]|\d{1,3}[.)])?[ \t]*", re.I).match(text, start)
                at = max(at, line.end())
        elif kind == "other" and not text[start:end].lower().startswith(("<style", "<script")):
            out.append(re.sub(r"</?(?:nowiki|code)\b[^>]*>|`", "", text[start:end]))
            at = end
        else:
            at = end
    out.append(_inline(text[at:]))
    lines = (re.sub(r"[ \t]*=+[ \t]*$", "", x).rstrip() if x.startswith("[heading] ") else x.rstrip() for x in "".join(out).split("\n"))
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def clean_pages(pages: DataFrame) -> DataFrame:
    """rev_id, clean: the clean text of every revision row (null and empty texts stay as they are). A repeated row stays one."""
    wrappers = inferred(marked_pages(pages))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        done = [clean(unescape_once(t), wrappers) if t else t for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("rev_id"), pa.array(done, pa.string())], ["rev_id", "clean"])

    return map_rows(pages.select("rev_id", "text"), batch, "rev_id BIGINT, clean STRING")
