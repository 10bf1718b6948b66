"""Opaque spans of page text: comments, nowiki, code and formulas in any markup.

Everything that looks for structure (headings, calls, links, list items) does
so on `masked(text)`, a copy of equal length in which the opaque spans are
filled with characters that can start nothing.
"""

from __future__ import annotations

import re

OPAQUE = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<tag>nowiki|pre|code|syntaxhighlight|source|math|script|style)\b(?:[^>]*/>|[^>]*>.*?</(?P=tag)\s*>)"
    r"|^[ ]{0,3}(?P<fence>```+|~~~+)[^\n]*\n(?:.*?\n)?[ ]{0,3}(?P=fence)[`~]*[ \t]*(?=\n|\Z)"
    r"|\\begin\{(?P<env>verbatim\*?|lstlisting|equation\*?|align\*?|gather\*?|multline\*?|displaymath|math)\}.*?\\end\{(?P=env)\}"
    r"|\\\(.+?\\\)|\\\[.+?\\\]"
    r"|\\[\\$%&#_{}]"
    r"|\$\$[^$]+\$\$"
    r"|\$(?![\s$])[^$\n]*?(?<![\s\\])\$(?!\d)"
    r"|^%[ \t][^\n]*"
    r"|`[^`\n]+`",
    re.S | re.M | re.I,
)

COMMENT_FILL, OPAQUE_FILL = "\x01", "\x00"
CODE_TAGS = frozenset(("pre", "syntaxhighlight", "source"))
_CODE_ENVS = ("verbatim", "verbatim*", "lstlisting")


def unescape_once(text: str) -> str:
    """Undo one level of the dump's XML escape (`&amp;` last)."""
    if "&" not in text:
        return text
    return (
        text.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&#39;", "'").replace("&amp;", "&")
    )


_START = re.compile(
    r"<!--|<(?P<tag>nowiki|pre|code|syntaxhighlight|source|math|script|style)\b|^[ ]{0,3}(?P<fence>```+|~~~+)|\\begin\{(?P<env>[a-z]+\*?)\}|\\(?P<math>[(\[])|\\[\\$%&#_{}]|\$|^%[ \t]|`",
    re.M | re.I,
)
_EMPTY_TAG = re.compile(r"<(?P<tag>\w+)\b[^>]*/>(?P<fence>)?(?P<env>)?", re.I)


def _opaque(text: str):
    """Matches of OPAQUE from left to right. An opener that has no closer is looked for once per kind, so time is linear in the text."""
    at, dead, last = 0, set(), text.rfind(">")
    while m := _START.search(text, at):
        start = m.start()
        key = (m["tag"] or m["env"] or m["math"] or m["fence"] or "").lower()
        if m["tag"] and start > last:
            found = None
        elif key in dead:
            found = _EMPTY_TAG.match(text, start) if m["tag"] else None
        else:
            found = OPAQUE.match(text, start)
            if found is None and key:
                dead.add(key)
        if found is None:
            at = start + 1
        else:
            yield found
            at = max(found.end(), start + 1)


def opaque_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the opaque spans; kind is comment, code, formula or other."""
    out = []
    for m in _opaque(text):
        start, end = m.span()
        tag, env = m["tag"], m["env"]
        if tag:
            tag = tag.lower()
            if tag == "math":
                kind = "formula" if text[end - 2] != "/" else "other"
            elif tag in CODE_TAGS:
                head = text[start : text.find(">", start) + 1]
                kind = "other" if head.endswith("/>") or " inline" in head else "code"
            elif tag == "code":
                kind = "code" if "\n" in text[start:end] else "other"
            else:
                kind = "other"
        elif m["fence"]:
            kind = "code"
        elif env:
            kind = "code" if env.lower() in _CODE_ENVS else "formula"
        else:
            c = text[start]
            if c == "<" or c == "%":
                kind = "comment"
            elif c == "$" or (c == "\\" and end - start > 2):
                kind = "formula"
            elif c == "\\":
                continue
            else:
                kind = "other"
        out.append((start, end, kind))
    return out


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """`text` with opaque spans filled: comments by one sign, the rest by another."""
    if not spans:
        return text
    parts, at = [], 0
    for start, end, kind in spans:
        parts.append(text[at:start])
        parts.append((COMMENT_FILL if kind == "comment" else OPAQUE_FILL) * (end - start))
        at = end
    parts.append(text[at:])
    return "".join(parts)


_HEADING = re.compile(r"^\x01*(={2,})([^\n]*?[^=\s\x01][^\n]*?)(={2,})[ \t\r\x01]*$", re.M)


def headings(mask: str) -> list[tuple[int, int, int]]:
    """(start, end, level) of wikitext headings in masked text, alone on their line."""
    if "==" not in mask:
        return []
    return [
        (m.start(1), m.end(3), min(len(m[1]), len(m[3]), 6))
        for m in _HEADING.finditer(mask)
    ]


_BRACKETS = re.compile(r"\{\{+|\}\}+|\[\[|\]\]|\|")


def calls(mask: str) -> list[list[int]]:
    """Template calls of masked text as [start, end, parent, param]; parent -1 for outer calls.

    A run of braces is paired from its inner end: three signs make a variable,
    two make a call. Bars count for the innermost open call only, not inside
    links or variables. Calls come in order of their first character.
    """
    if "{{" not in mask:
        return []
    stack: list[list] = []  # [kind, position, signs left, bars, calls held with the bars before them]
    done: list[tuple[int, int, list]] = []
    for m in _BRACKETS.finditer(mask):
        sign = m[0][0]
        if sign == "|":
            if stack:
                stack[-1][3] += 1
        elif sign == "[":
            stack.append(["[", m.start(), 0, 0, []])
        elif sign == "]":
            if stack and stack[-1][0] == "[":
                frame = stack.pop()
                if stack:
                    stack[-1][4].extend((c, stack[-1][3]) for c, _ in frame[4])
        elif sign == "{":
            stack.append(["{", m.start(), m.end() - m.start(), 0, []])
        else:
            left, at = m.end() - m.start(), m.start()
            while left >= 2:
                k = len(stack) - 1
                while k >= 0 and stack[k][0] == "[":
                    k -= 1
                if k < 0:
                    break
                while len(stack) - 1 > k:  # links that never close are plain signs
                    frame = stack.pop()
                    above = stack[-1]
                    above[4].extend((c, above[3] + bars) for c, bars in frame[4])
                    above[3] += frame[3]
                frame = stack.pop()
                take = min(3, frame[2], left)
                at += take
                left -= take
                frame[2] -= take
                start = frame[1] + frame[2]
                if take == 2:
                    number = len(done)
                    done.append((start, at, frame[4]))
                    held = [number]
                else:
                    held = [c for c, _ in frame[4]]
                if frame[2] >= 2:
                    stack.append(["{", frame[1], frame[2], 0, [(c, 0) for c in held]])
                elif stack:
                    stack[-1][4].extend((c, stack[-1][3]) for c in held)
    order = sorted(range(len(done)), key=lambda i: done[i][0])
    place = {i: n for n, i in enumerate(order)}
    out = [[done[i][0], done[i][1], -1, 0] for i in order]
    for i, (_, _, held) in enumerate(done):
        for c, bars in held:
            out[place[c]][2] = place[i]
            out[place[c]][3] = bars
    return out
