"""Page text to a tree: sections, paragraphs, lists, links, templates, and its rendering.

Quirks of the format that other tools rely on are kept: unbalanced brackets
discard their section alone, an odd set of apostrophe runs removes every
apostrophe of the section, line feeds inside paragraphs go without a blank,
the last piece of a template is not trimmed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# Fixed values of the page vocabulary.
STRIPPED = ("ref", "references", "math", "code", "syntaxhighlight", "nowiki", "noinclude", "pre")
RETAINED = frozenset(("main", "see also", "aircontent"))
DROPPED_SECTIONS = frozenset(("References", "External links", "Bibliography", "Footnotes", "Further reading", "Notes"))
DROPPED = frozenset(("interwiki", "category", "wTable", "div"))
NOT_RENDERED = frozenset(("template", "interwiki", "wTable", "media", "category", "style", "url", "title", "target", "tSection", "param", "curlyThree"))
INTERWIKI = frozenset(("Wikt", "de", "fr", "es", "it", "nl", "pl", "ru", "ja", "zh", "pt", "sv"))
CAPTION_WORDS = frozenset(("left", "right", "center", "centre", "upright", "thumb"))
UNITS = {"km": "km", "m": "m", "cm": "cm", "mm": "mm", "mi": "mi", "ft": "ft", "in": "in", "kg": "kg", "lb": "lb", "ha": "ha", "acre": "acres", "km2": "km²", "sqmi": "sq mi", "c": "°C", "f": "°F"}


class Discarded(ValueError):
    """A section that cannot be read; the message says why."""


class Node:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, children: list | None = None, **attrs: str):
        self.name, self.children, self.attrs = name, children or [], attrs

    def first(self, name: str) -> Node | None:
        return next((c for c in self.children if isinstance(c, Node) and c.name == name), None)

    def all(self, name: str) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and c.name == name]

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def walk(self) -> Iterator[Node]:
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()


# ---------------------------------------------------------- cleaning


def without_nested(text: str, left: str, right: str) -> str:
    """Text without spans between two strings, nested or not; unbalanced text stays as it is."""
    out, depth, at = [], 0, 0
    for m in re.finditer(re.escape(left) + "|" + re.escape(right), text):
        if m[0] == left:
            if depth == 0:
                out.append(text[at : m.start()])
            depth += 1
        elif depth == 0:
            return text
        else:
            depth -= 1
            at = m.end()
    return text if depth else "".join(out) + text[at:]


_STRIP = re.compile(r"<(" + "|".join(STRIPPED) + r")\b[^>]*?(?:/>|>.*?</\1\s*>)|<br\s*/?>|</?center>", re.S | re.I)


def cleaned(text: str) -> str:
    text = without_nested(text, "<!--", "-->")
    return _STRIP.sub("", text) if "<" in text else text


# ---------------------------------------------------------- brackets


def _sets(text: str, left: str, right: str) -> list[tuple[int, int, int]]:
    """(start, end, size) of bracket sets: pairs that lie directly inside one another form one."""
    stack, pairs = [], {}
    for m in re.finditer(re.escape(left) + "|" + re.escape(right), text):
        if m[0] == left:
            stack.append(m.start())
        elif not stack:
            raise Discarded(f"unmatched {right}")
        else:
            pairs[stack.pop()] = m.start()
    if stack:
        raise Discarded(f"unmatched {left}")
    out = []
    for start in sorted(pairs):
        if pairs.get(start - 1) == pairs[start] + 1:
            continue
        size = 1
        while pairs.get(start + size) == pairs[start] - size:
            size += 1
        out.append((start, pairs[start] + 1, size))
    return out


_APOSTROPHES = re.compile("'+")


def _emphasis(text: str) -> tuple[str, list[tuple[int, int, int, str]]]:
    """The text without emphasis marks and (start, end, order, name) of b and i in it."""
    runs = [m for m in _APOSTROPHES.finditer(text) if len(m[0]) > 1]
    odd = len(runs) % 2 or any(len(m[0]) not in (2, 3, 5) for m in runs) or any(len(a[0]) != len(b[0]) for a, b in zip(runs[::2], runs[1::2]))
    if odd:
        return text.replace("'", ""), []
    out, spans, at, shift = [], [], 0, 0
    for a, b in zip(runs[::2], runs[1::2]):
        start, end = a.start() - shift, b.start() - shift - len(a[0])
        for name in {2: "i", 3: "b", 5: "bi"}[len(a[0])]:
            spans.append((start, end, len(spans), name))
        out += [text[at : a.start()], text[a.end() : b.start()]]
        at = b.end()
        shift += len(a[0]) + len(b[0])
    return "".join(out) + text[at:], spans


def parse_inline(text: str) -> list:
    """Children of a section: text and nodes for templates, variables, tables, links and emphasis."""
    text, emphasis = _emphasis(text)
    spans = []
    for start, end, size in _sets(text, "{", "}"):
        if size > 3:
            raise Discarded("more than three braces")
        if size == 1 and not (text[start + 1] == "|" and text[end - 2] == "|" and end - start > 3):
            continue
        spans.append((start, end, size, ("wTable", "template", "curlyThree")[size - 1]))
    for start, end, size in _sets(text, "[", "]"):
        if size > 2:
            raise Discarded("more than two brackets")
        spans.append((start, end, size, ("extLink", "link")[size - 1]))
    spans += [(s, e, 0, name) for s, e, _, name in emphasis if e > s]
    spans.sort(key=lambda x: (x[0], -x[1], x[2]))
    root = Node("")
    stack = [(root, len(text), 0)]
    at = 0
    for start, end, size, name in spans:
        while start >= stack[-1][1]:
            node, stop, cut = stack.pop()
            node.children.append(text[at : stop - cut])
            at = max(at, stop)
        if end > stack[-1][1] - (stack[-1][2] if size else 0):
            if not size:
                continue  # emphasis across a bracket is dropped
            raise Discarded("brackets cross")
        stack[-1][0].children.append(text[at:start])
        node = Node(name)
        stack[-1][0].children.append(node)
        stack.append((node, end, size))
        at = start + size
    while stack:
        node, stop, cut = stack.pop()
        node.children.append(text[at : stop - cut])
        at = max(at, stop)
    _without_blanks(root)
    _finish(root)
    return root.children


def _without_blanks(node: Node) -> None:
    node.children = [c for c in node.children if c != ""]
    for c in node.children:
        if isinstance(c, Node):
            _without_blanks(c)


def _pieces(children: list) -> list[list]:
    out: list[list] = [[]]
    for c in children:
        if isinstance(c, str):
            first, *rest = c.split("|")
            out[-1].append(first)
            out.extend([r] for r in rest)
        else:
            out[-1].append(c)
    return out


def _strip(piece: list) -> list:
    if piece and isinstance(piece[0], str):
        piece[0] = piece[0].lstrip(" \n\t\r")
    if piece and isinstance(piece[-1], str):
        piece[-1] = piece[-1].rstrip(" \n\t\r")
    return [c for c in piece if c != ""]


_PARAM = re.compile(r"\s*([^=]*?)\s*=(.*)\Z", re.S)


def _template(node: Node) -> None:
    pieces = _pieces(node.children)
    pieces = [_strip(p) for p in pieces[:-1]] + [[c for c in pieces[-1] if c != ""]]
    node.children = [Node("target", pieces[0])]
    for p in pieces[1:]:
        param = Node("param", p)
        m = _PARAM.match(p[0]) if p and isinstance(p[0], str) else None
        if m and re.fullmatch(r"[a-z0-9_ -]+", m[1].lower()):
            param.attrs["pn"] = m[1].lower()
            param.children = _strip([m[2], *p[1:]])
        node.children.append(param)


def capitalized(s: str) -> str:
    return s[:1].upper() + s[1:] if s[:1].isascii() else s


def _is_caption(s: str) -> bool:
    low = s.strip().lower()
    return bool(low) and not (low.startswith(("alt=", "link=")) or low in CAPTION_WORDS or re.search(r"\dpx\Z", low))


def _link(node: Node) -> None:
    pieces = _pieces(node.children)
    raw = "".join(c if isinstance(c, str) else c.text() for c in pieces[0]).strip()
    colon = raw.startswith(":")
    raw = raw.lstrip(":").strip()
    target, _, section = capitalized(raw.replace("_", " ")).partition("#")
    low = target.lower()
    kind = "link"
    if not colon:
        if low.startswith(("file:", "image:")):
            kind, target = "file", "File:" + capitalized(target.split(":", 1)[1].strip())
        elif low.startswith("media:"):
            kind = "media"
        elif low.startswith("category:"):
            kind = "category"
        elif ":" in target and target.split(":", 1)[0] in INTERWIKI:
            kind = "interwiki"
    node.name = kind
    node.children = [Node("target", [target])]
    params = [[c for c in p if c != ""] for p in pieces[1:]]
    if kind == "file":
        caption = params.pop() if params and _is_caption("".join(c if isinstance(c, str) else c.text() for c in params[-1])) else []
        node.children += [Node("param", p) for p in params] + [Node("caption", caption)]
        return
    if section:
        node.children.append(Node("tSection", [section.strip()]))
    node.children.append(Node("anchor", params[0] if params and params[0] else [raw]))
    node.children += [Node("param", p) for p in params[1:]]


def _external(node: Node) -> None:
    whole = "".join(c if isinstance(c, str) else c.text() for c in node.children)
    target, _, anchor = whole.partition(" ")
    node.children = [Node("target", [target]), Node("anchor", [anchor or target])]


def _finish(node: Node) -> None:
    """Types of templates and links, link trails and texts of templates, from the inside out."""
    for c in node.children:
        if isinstance(c, Node):
            _finish(c)
    out: list = []
    for c in node.children:
        if isinstance(c, Node):
            if c.name == "template":
                _template(c)
                out.extend(expansion(c))
            elif c.name == "link" and c.first("target") is None:
                _link(c)
            elif c.name == "extLink" and c.first("target") is None:
                _external(c)
            out.append(c)
        elif out and isinstance(out[-1], Node) and out[-1].name == "link" and (m := re.match("[A-Za-z]+", c)):
            out[-1].first("anchor").children.append(m[0])
            out.append(c[m.end() :])
        else:
            out.append(c)
    node.children = [c for c in out if c != ""]


# ---------------------------------------------------------- templates that leave text or files


def _named(params: list[Node], *names: str) -> Node | None:
    for n in names:
        for p in params:
            if p.attrs.get("pn") == n:
                return p
    return None


def _plain(params: list[Node]) -> list[Node]:
    return [p for p in params if "pn" not in p.attrs]


def _quote(text: Node | None, source: Node | None) -> list:
    if text is None:
        return []
    return [" ", *text.children, " ", *([*source.children, " "] if source is not None else [])]


def _file(target: str, caption: list | None = None) -> Node:
    name = re.sub(r"^\s*(?:file|image):\s*", "", target.strip(), flags=re.I)
    return Node("file", [Node("target", ["File:" + capitalized(name)]), Node("caption", caption or [])])


_IMAGE_PARAM, _CAPTION_PARAM = re.compile(r"(?:.*[ _])?(?:image|img|photo|picture|logo|map|flag)\d*"), re.compile(r".*caption\d*|alt[ _]?text")


def expansion(node: Node) -> list:
    """What a template puts before itself: converted measures, quotations, plain wraps, files."""
    name = node.first("target").text().strip().lower()
    params = node.all("param")
    bare = _plain(params)
    at = lambda i: bare[i] if i < len(bare) else None
    if name in ("convert", "convert/2", "convert/3", "convert/4"):
        words = []
        for p in bare:
            w = p.text().strip()
            if w.lower() in UNITS:
                return [" ".join([*words, UNITS[w.lower()]])]
            words.append(w)
        return []
    if name == "nowrap" or name.startswith("lang-"):
        return list(bare[0].children) if bare else []
    if name == "nihongo":
        return [*bare[0].children, *([" (", *bare[-1].children, ")"] if len(bare) > 1 else [])] if bare else []
    if name == "quote":
        return _quote(_named(params, "text", "1") or at(0), _named(params, "sign", "2") or at(1))
    if name == "quotation":
        return _quote(_named(params, "1") or at(0), _named(params, "2") or at(1))
    if name == "rquote":
        return _quote(at(1), at(2))
    if name == "bq":
        return _quote(_named(params, "text", "quote", "1") or at(0), _named(params, "2", "sign", "cite", "author", "by") or at(1))
    if name == "centered pull quote":
        return _quote(_named(params, "1") or at(0), _named(params, "author"))
    if name == "quote box":
        return _quote(_named(params, "quote"), _named(params, "source"))
    if name in ("double image", "triple image"):
        pairs = ((1, 5), (3, 6)) if name[0] == "d" else ((1, 7), (3, 8), (5, 9))
        return [_file(bare[i].text(), list(bare[c].children) if c < len(bare) else None) for i, c in pairs if i < len(bare)]
    if name == "multiple image":
        out, n = [], 1
        while (image := _named(params, f"image{n}")) is not None:
            caption = _named(params, f"caption{n}")
            out.append(_file(image.text(), list(caption.children) if caption else None))
            n += 1
        return out
    if name == "gallery":
        out = []
        for p in bare:
            if re.match(r"(?i)\s*(?:file|image):", p.text()):
                out.append(_file(p.text()))
            elif out and not out[-1].first("caption").children:
                out[-1].first("caption").children = list(p.children)
        return out
    if name.startswith("infobox") and params:
        image = next((p for p in params if _IMAGE_PARAM.fullmatch(p.attrs.get("pn", "")) and p.text().strip()), None)
        caption = next((p for p in params if _CAPTION_PARAM.fullmatch(p.attrs.get("pn", ""))), None)
        if image is not None:
            inner = next((f for f in image.walk() if f.name == "file"), None)
            return [_file(inner.first("target").text() if inner else image.text(), list(caption.children) if caption else None)]
    return []


_GALLERY = re.compile(r"<gallery\b[^>]*>(.*?)</gallery>", re.S | re.I)


def galleries(text: str) -> str:
    """Gallery tags as templates, one parameter per file and caption."""

    def one(m: re.Match) -> str:
        lines = [x.strip() for x in m[1].split("\n")]
        return "{{gallery|" + "|".join(x for x in lines if x) + "}}"

    return re.sub(r"</?gallery\b[^>]*>", "", _GALLERY.sub(one, text))


# ---------------------------------------------------------- paragraphs, lists, sections


def _drop_line_feeds(node: Node) -> None:
    for i, c in enumerate(node.children):
        if isinstance(c, str):
            node.children[i] = c.replace("\n", "")
        else:
            _drop_line_feeds(c)


_LINE = re.compile(r"\n([*#:;]+)")


def blocks(children: list) -> list[Node]:
    """Paragraphs and lists of a section: blank lines part paragraphs, lines with list signs become elements of lists."""
    for c in children:
        if isinstance(c, Node):
            _drop_line_feeds(c)
    out: list[Node] = []
    current: Node | None = None

    def to(kind: str) -> Node:
        nonlocal current
        if kind == "listEl":
            if not out or out[-1].name != "list":
                out.append(Node("list"))
            current = Node("listEl")
            out[-1].children.append(current)
        else:
            current = Node("par")
            out.append(current)
        return current

    first = True
    for c in children:
        if isinstance(c, Node):
            (current or to("par")).children.append(c)
        else:
            c = "\n" + c if first and c[:1] in "*#:;" else c
            for k, line in enumerate(c.split("\n")):
                m = re.match(r"[*#:;]+", line) if k else None
                if m:
                    to("listEl")
                    line = line[m.end() :]
                elif k and line == "" and current is not None:
                    current = None  # a second line feed in a row ends the block
                    continue
                elif k and current is not None and current.name == "listEl":
                    current = None
                if line:
                    (current or to("par")).children.append(line)
        first = False
    return [b for b in out if b.children]



def headings(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, level, title) of headings alone on their line; the level is that of the shorter side, the rest stays in the title."""
    out = []
    for m in re.finditer(r"(?<=\n)(=[^\n]*=)(?=\n|\Z)", text):
        line = m[1]
        left, right = len(line) - len(line.lstrip("=")), len(line) - len(line.rstrip("="))
        level = min(left, right, 6)
        if level >= 2 and len(line) > 2 * level:
            out.append((m.start(), m.end(), level, line[level : len(line) - level].strip()))
    return out


def _content(text: str, errors: list) -> list[Node]:
    try:
        return blocks(parse_inline(galleries(text)))
    except (Discarded, RecursionError) as e:
        errors.append(("section", str(e)))
        return []


def parse(text: str, errors: list | None = None) -> Node:
    """The tree of a page's unescaped text: text > firstPara, section(level) > secTitle, secContent > ..."""
    errors = [] if errors is None else errors
    text = "\n" + re.sub("\n{3,}", "\n\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    text = cleaned(text)
    heads = headings(text)
    root = Node("text")
    stops = [h[0] for h in heads] + [len(text)]
    first = Node("firstPara", _content(text[: stops[0]].lstrip("\n") if not text[: stops[0]].lstrip("\n").startswith(("*", "#", ":", ";")) else text[: stops[0]], errors))
    root.children.append(first)
    stack: list[tuple[int, Node]] = [(0, root)]
    for (_, end, level, title), stop in zip(heads, stops[1:]):
        try:
            name = parse_inline(title)
        except Discarded as e:
            errors.append(("section title", str(e)))
            continue
        section = Node("section", level=str(level))
        content = Node("secContent", _content(text[end:stop], errors))
        section.children = [Node("secTitle", name), content]
        while stack[-1][0] >= level:
            stack.pop()
        above = stack[-1][1]
        above.children.append(section)
        stack.append((level, content))
    return root


# ---------------------------------------------------------- after parsing


def _prune(node: Node, keep_all: bool = False) -> None:
    kept = []
    for c in node.children:
        if isinstance(c, Node):
            if c.name in DROPPED:
                continue
            if c.name == "template":
                name = c.first("target").text().strip().lower()
                if name not in RETAINED and not name.startswith("infobox"):
                    continue
            if c.name == "section" and c.first("secTitle").text().strip() in DROPPED_SECTIONS:
                continue
            _prune(c)
        kept.append(c)
    node.children = kept


def _files_last(content: Node) -> None:
    """Files of paragraphs and lists move to a paragraph of their own at the section's end."""
    found: list[Node] = []

    def take(node: Node) -> None:
        kept = []
        for c in node.children:
            if isinstance(c, Node):
                if c.name == "file":
                    found.append(c)
                    continue
                if c.name not in ("section", "template"):
                    take(c)
            kept.append(c)
        node.children = kept

    take(content)
    at = next((i for i, c in enumerate(content.children) if isinstance(c, Node) and c.name == "section"), len(content.children))
    if found:
        content.children.insert(at, Node("par", found))


def _drop_empty(node: Node) -> None:
    for c in node.children:
        if isinstance(c, Node):
            _drop_empty(c)
    node.children = [c for c in node.children if not (isinstance(c, Node) and c.name in ("par", "listEl", "list") and not any(not isinstance(x, str) or x.strip() for x in c.children))]


def _leading_lists(first: Node) -> None:
    """Lists before the first paragraph with text go."""
    at = next((i for i, c in enumerate(first.children) if isinstance(c, Node) and c.name == "par" and flat(c).strip()), len(first.children))
    first.children = [c for i, c in enumerate(first.children) if i >= at or not (isinstance(c, Node) and c.name == "list")]


def processed(root: Node) -> Node:
    """The tree of an article: pruned, files at section ends, no empty blocks, no leading lists."""
    _prune(root)
    for node in root.walk():
        if node.name in ("firstPara", "secContent"):
            _files_last(node)
    _drop_empty(root)
    _leading_lists(root.children[0])
    return root


def shortened(node: Node) -> Node:
    """The tree with rendered text in paragraphs, list elements and titles; those without text go."""
    kept = []
    for c in node.children:
        if isinstance(c, Node) and c.name in ("par", "listEl", "secTitle"):
            t = flat(c, captions=False).strip()
            if t:
                kept.append(Node(c.name, [t]))
        else:
            kept.append(shortened(c) if isinstance(c, Node) else c)
    return Node(node.name, kept, **node.attrs)


# ---------------------------------------------------------- rendering


def flat(node: Node, captions: bool = True) -> str:
    """One line of text: a blank after paragraphs, list elements and titles."""
    out: list[str] = []

    def write(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                out.append(c)
            elif c.name in NOT_RENDERED and not (c.name == "title"):
                continue
            elif c.name == "caption" and not captions:
                continue
            else:
                write(c)
                if c.name in ("par", "listEl", "title", "secTitle"):
                    out.append(" ")

    write(node)
    return entities("".join(out))


def entities(s: str) -> str:
    if "&" in s:
        s = re.sub("&(?:amp;)+", "&", s)
        for name, sign in (("&gt;", ">"), ("&lt;", "<"), ("&nbsp;", " "), ("&quot;", '"'), ("&mdash;", " - "), ("&ndash;", " - ")):
            s = s.replace(name, sign)
    return s.replace("–", "-")


def document(root: Node, title: str, kind: str, captions: bool = True, marks: bool = True) -> str:
    """The page as marked plain text."""
    out = [f"\n\n#Article: {title}\n#Type: {kind}\n\n"] if marks else []

    def write(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                out.append(c)
            elif c.name in NOT_RENDERED:
                continue
            elif c.name == "section":
                name = flat(c.first("secTitle"))
                out.append(f"\n\n#Subtitle level {c.attrs['level']}: {name}\n\n" if marks else f"\n\n{name}\n\n")
                write(c.first("secContent"))
            elif c.name == "caption":
                t = flat(c)
                if captions and t.strip():
                    out.append(f"\n\n#Caption: {t}\n\n" if marks else f"\n\n{t}\n\n")
            elif c.name in ("par", "listEl"):
                size = len(out)
                if c.name == "listEl":
                    out.append("\t")
                write(c)
                if len(out) > size:
                    out.append("\n\n")
            else:
                write(c)

    write(root)
    return re.sub("\n{3,}", "\n\n", entities("".join(out)).replace("\t\n", "\n"))


def xml(node: Node | str) -> str:
    """The tree as escaped XML."""
    if isinstance(node, str):
        return node.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    attrs = "".join(f' {k}="{xml(v).replace(chr(34), "&quot;")}"' for k, v in node.attrs.items())
    inner = "".join(map(xml, node.children))
    return f"<{node.name}{attrs}>{inner}</{node.name}>" if inner else f"<{node.name}{attrs}/>"
