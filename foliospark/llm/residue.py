"""Template residue, filler, error pages and script notices standing in for content.

Lines of article pages are cut into sentences. Sentences of one template are
aligned over all pages, token by token: positions that vary are its slots,
positions that do not are its constant text. A slot that still holds a variable
name, a default or a blank, in a sentence with no slot filled by a real value,
is unfilled residue; a variable at a constant position beside filled slots is
an article that mentions one. Whole lines of error, notice and filler templates
are recognised by cue patterns alone, however often they repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as _re, _parser as _re_parser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliospark.functions.arrow import map_rows
from foliospark.functions.stage import written
from foliospark.wikitext.lexer import calls, opaque_spans, unescape_once

# ------------------------------------------------------- cue patterns

PLACEHOLDER = re.compile(
    r"\{\{\{[^{}\n]*\}\}\}|\{\{\s*\w+\.\w+\s*\}\}|\{%[^%\n]*%\}|\$\{[\w.]+\}|@@\w+@@|%%\w+%%|%[A-Za-z]\w*%|<<\w+>>|(?<!\w)__[A-Za-z]+__(?!\w)"
    r"|\[(?:YOUR|ENTER|INSERT|ADD|FILL)?[A-Z ]+\]|\{\w+_\d+\}|\(\w[\w ]* to be filled in\)|(?:(?<=[ :])|^)_{3,}(?=[ .,;]|$)|\[(?:your|enter|insert|add) [\w ]+\]",
)

_CORE = re.compile(
    r"\b(?:error|status)[ :]*[1-5]\d\d\b|\bnot found\b|\bdoes not exist\b|\b(?:session|token|link) (?:has )?expired\b"
    r"|^access denied\W*$|^forbidden\W*$|\btoo many requests\b|\bservice (?:is )?(?:temporarily )?unavailable\W*$|\bgateway time(?:d |-)?out\b|\btimed out\W*$"
    r"|\bconnection\b.*\b(?:refused|reset|failed)\b|\bsomething went wrong\b|\b(?:could|can)(?:not| not) (?:process|complete|load|handle|serve)\b"
    r"|\b(?:query|database|internal|server) error\b|\bdown for maintenance\b|\boffline for maintenance\b|\bunder maintenance\W*$"
    r"|\b(?:wiki|page|site|database) is (?:currently )?(?:locked|read-only|unavailable|closed|down)\b|\bbad (?:gateway|request)\b|^redirecting\b"
    r"|\b(?:enable|turn on|activate|allow|switch on|requires?|without|not support|needs?|works? only when)\b.*\b(?:javascript|scripts?|scripting|cookies)\b"
    r"|\bchecking your browser\b|\bverify (?:that )?you are (?:a )?human\b|\b(?:javascript|scripts?|cookies) (?:is|are) (?:disabled|required|needed|switched off)\b"
    r"|\blorem ipsum\b|\bcoming soon\W*$|\bto follow\W*$|\badded (?:later|soon)\b|\bdummy (?:copy|text)\b|\b(?:own|your) (?:words|text)\b.*|\bgoes here\b"
    r"|\bfirst section here\b|\bonly fills? the space\b|\bin place of this line\b|^\(no \w+ yet\)\W*$|\bplaceholder\b|^sample \w+\W*$|\bsample text\W*$"
    r"|^(\w+) one, \1 two, \1 three\W*$|^just an? \w+\W*$|^here be \w+\W*$|\bcannot reach\b|\bbackend node\b|^(?:TODO|TBD|TBA|FIXME)(?:\W+(?:TODO|TBD|TBA|FIXME))*\W*$|^oops\b|\bunexpected error\b|\bplease wait\W*$",
    re.I,
)
_STATUS = re.compile(r"^[1-5]\d\d(?: [A-Z][a-z]+)+\W*$", re.I)
_TRAIL = re.compile(
    r"^(?:request id|reference #|ray [0-9a-f]+|served by|error id|incident)\b|^(?:return|go back) to\b|\btry again\b|^please\b|^contact the\b"
    r"|\bmay be broken\b|\bfunctions of this page\b|\btakes a few seconds\b|^loading\b|\bnothing happens\b|^another \w+ \d+\W*$|^\w+ again\W*$"
    r"|\bwill supply the real\b|^back to\b|\bsorry\b|^untitled\b|^title\W*$",
    re.I,
)
_STRONG = re.compile(r"\bonly fills? the space\b|\bwe're sorry\b|\bwill supply the real\b|\bcannot reach\b|\bbackend node\b", re.I)
_NARRATIVE = re.compile(
    r"\b(?:[Ii]n|[Ss]ince|[Uu]ntil|[Bb]y|[Oo]f|as|[Ww]hen|before|after|to|from|for|with|that) (?:the )?(?:\d{4}\b|[A-Z][a-z]{2,}(?![-/\w]))|\(born\b|\bwrote\b|\bphrase\b|\bwords\b.*\bmargin\b"
)
_LATIN = re.compile(r"(?:lor|dol|sit|elit|cons|magn|temp|ull|ven|nost|adip|aliq|ips|amet|eius|labor)[a-z]{0,6}", re.I)
_LONE = re.compile(r"[A-Z]\w+\W*")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[a-z][.!?…])(?=[A-Z])")
_TAG = re.compile(r"(?<!<)</?(?:div|b|i|p|span|noscript|html|head|body|title|center|hr|br|strong|em|font|h[1-6]|small|section|article|main)\b[^<>]*>", re.I)


def _literals(parsed) -> set[str] | None:
    """Literals of which every match of a parsed pattern holds at least one; None if there are none."""
    options: list[set[str]] = []
    run = ""
    for op, av in [*parsed, (None, None)]:
        if op is _re.LITERAL:
            run += chr(av).lower()
            continue
        if op in (_re.AT, _re.ASSERT, _re.ASSERT_NOT):
            continue
        if run:
            options.append({run})
            run = ""
        inner = None
        if op is _re.SUBPATTERN:
            inner = _literals(av[3])
        elif op in (_re.MAX_REPEAT, _re.MIN_REPEAT) and av[0]:
            inner = _literals(av[2])
        elif op is _re.IN and all(kind is _re.LITERAL for kind, _ in av):
            inner = {chr(x).lower() for _, x in av}
        elif op is _re.BRANCH:
            each = [_literals(x) for x in av[1]]
            inner = None if None in each else set().union(*each)
        if inner:
            options.append(inner)
    return max(options, key=lambda x: min(map(len, x)), default=None)


def _cues(*patterns: re.Pattern) -> tuple[str, ...]:
    found = [_literals(_re_parser.parse(p.pattern, p.flags & ~re.U)) for p in patterns]
    assert None not in found, "a pattern has an alternative without a literal"
    return tuple(sorted(set().union(*found), key=lambda x: (len(x), x)))


#: A sentence without any of these matches none of the patterns; signs that ignored case takes for i and s are made plain before.
CUES = _cues(PLACEHOLDER, _CORE, _STRONG, _TRAIL)
_PLAIN = str.maketrans("\u0130\u0131\u017f", "iis")


def may_match(s: str) -> bool:
    low = (s if s.isascii() else s.translate(_PLAIN)).lower()
    return s[:1].isdigit() or any(x in low for x in CUES)


def _latin(words: list[str]) -> bool:
    return len(words) >= 4 and sum(1 for w in words if _LATIN.fullmatch(w)) >= 0.7 * len(words)


def sentence_kind(s: str) -> str:
    """core, trail, slot (holds placeholders) or none. A lone word, such as a name that signs a line, decides nothing."""
    if not may_match(s):
        if _LONE.fullmatch(s):
            return "trail"
        return "core" if _latin(re.findall(r"[A-Za-z]+", s)) and not _NARRATIVE.search(s) else "none"
    if PLACEHOLDER.search(s) and re.search(r"[A-Za-z]{2}", s):
        return "slot"
    if _STRONG.search(s):
        return "core"
    if _NARRATIVE.search(s):
        return "none"
    if _CORE.search(s) or _STATUS.search(s) or _latin(re.findall(r"[A-Za-z]+", s)):
        return "core"
    return "trail" if _TRAIL.search(s) or _LONE.fullmatch(s) else "none"


def content_lines(text: str) -> list[str]:
    """Lines of unescaped page text without comments, nowiki, code, calls, tags, headings, list and table lines."""
    cut = [(s, e) for s, e, kind in opaque_spans(text) if kind != "formula" and not (kind == "other" and text[s] == "`")]
    if "{{" in text:
        parts = list(text)
        for s, e in cut:
            parts[s:e] = "\x00" * (e - s)
        mask = "".join(parts)
        cut += [(c[0], c[1]) for c in calls(mask) if c[2] < 0 and not PLACEHOLDER.fullmatch(text[c[0] : c[1]])]
        cut.sort()
    if cut:
        parts, at = [], 0
        for s, e in cut:
            if s >= at:
                parts.append(text[at:s])
            at = max(at, e)
        parts.append(text[at:])
        text = "".join(parts)
    return [x for line in text.split("\n") if (x := line.strip()) and x[0] not in "=*#|!;:"]


def _sentences_of(line: str) -> Iterator[str]:
    at = 0
    for m in _SENTENCE.finditer(line):
        yield line[at : m.start()]
        at = m.end()
    yield line[at:]


def residue_lines(text: str | None) -> list[list[tuple[str, str]]]:
    """Per line that consists of residue sentences only: its (kind, sentence) list."""
    if not text:
        return []
    out = []
    for line in content_lines(text):
        if "<" in line:
            line = _TAG.sub(" ", line).strip()
        kinds = []
        for s in _sentences_of(line):
            s = s.strip()
            if not re.search(r"\w", s):
                continue
            kind = sentence_kind(s)
            if kind == "none":
                kinds = []
                break
            kinds.append((kind, s))
        if any(k != "trail" for k, _ in kinds):
            out.append(kinds)
    return out


_REAL = re.compile(r"\d|[A-Z][a-z]+")


def tokens(s: str) -> tuple[list[str], list[int], list[int]]:
    """Tokens of a sentence, positions of placeholders, positions of real values (names, numbers)."""
    out: list[str] = []
    held: list[int] = []
    at = 0
    for m in PLACEHOLDER.finditer(s):
        out += s[at : m.start()].split()
        held.append(len(out))
        out.append(m[0].replace(" ", "_"))
        at = m.end()
    out += s[at:].split()
    real = [i for i, x in enumerate(out) if i and i not in held and _REAL.match(x.lstrip("(\"'“"))]
    return out, held, real


def _skeleton(words: list[str], held: list[int], real: list[int]) -> str:
    slots = {*held, *real}
    return " ".join("_" if i in slots else re.sub(r"\d+", "0", w.lower()) for i, w in enumerate(words))


def wholly_residue(text: str | None) -> bool:
    """True if unescaped text has content lines and all of them are residue (no corpus needed)."""
    if not text:
        return False
    lines = [x for x in content_lines(text) if re.search(r"\w", _TAG.sub("", x))]
    return bool(lines) and sum(map(_unfilled, residue_lines(text))) >= sum(1 for x in lines if not _trail_only(x))


def _trail_only(line: str) -> bool:
    return all(_TRAIL.search(s.strip()) or not s.strip() for s in _SENTENCE.split(_TAG.sub(" ", line).strip()))


def _unfilled(line: list[tuple[str, str]]) -> bool:
    return all(k != "slot" or not tokens(s)[2] for k, s in line)


def has_residue(text: str | None) -> bool:
    """The decision for one page alone, without alignment over the corpus."""
    return any(map(_unfilled, residue_lines(text)))


def _batch(b: pa.RecordBatch) -> pa.RecordBatch:
    cols: list[list] = [[] for _ in range(8)]
    for rev, text in zip(b.column("rev_id").to_pylist(), b.column("text").to_pylist()):
        for n, line in enumerate(residue_lines(unescape_once(text))):
            for kind, s in line:
                words, held, real = tokens(s)
                for col, x in zip(cols, (rev, n, len(line), kind, _skeleton(words, held, real), words, held, real)):
                    col.append(x)
    types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))
    names = ["rev_id", "line", "of", "kind", "template", "words", "held", "real"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


_SCHEMA = "rev_id BIGINT, line INT, of INT, kind STRING, template STRING, words ARRAY<STRING>, held ARRAY<INT>, real ARRAY<INT>"


def _sentences(pages: DataFrame) -> DataFrame:
    return written(map_rows(pages.where("ns = 0 AND length(text) > 0").select("rev_id", "text"), _batch, _SCHEMA), "residue-sentences")


def templates(sentences: DataFrame) -> DataFrame:
    """Alignment of all distinct sentences of one template: n_sentences, slots and constants.

    A slot is a position where values differ or where every sentence holds a
    placeholder; a constant is any other position that at least two distinct
    sentences agree on. Repeated rows, revisions and copies of one sentence
    count once, so a template that fills a third of the corpus costs no more
    than its distinct values.
    """
    once = sentences.select("template", "words", "held").dropDuplicates(["template", "words"])
    values = once.select("template", "held", F.posexplode("words").alias("pos", "word")).groupBy("template", "pos", "word")
    values = values.agg(F.count("*").alias("n"), F.count_if(F.expr("array_contains(held, pos)")).alias("n_held"))
    at = values.groupBy("template", "pos").agg(F.count("*").alias("values"), F.sum("n").alias("n"), F.sum("n_held").alias("n_held"))
    slot = F.expr("values > 1 OR n_held = n")
    return at.groupBy("template").agg(
        F.max("n").alias("n_sentences"),
        F.array_sort(F.collect_list(F.when(slot, F.col("pos")))).alias("slots"),
        F.array_sort(F.collect_list(F.when(~slot & (F.col("n") > 1), F.col("pos")))).alias("constants"),
    )


def residue_pages(pages: DataFrame) -> DataFrame:
    """rev_id of article revisions (ns = 0) with residue in place of their content or of a section or paragraph.

    `pages` needs rev_id, ns, text. Null and empty texts and null ns give no
    row; a repeated revision gives one. A sentence with placeholders is
    unfilled if each of its names and numbers is a constant of its template;
    one without any is, however often it repeats. Other columns are ignored.
    """
    s = _sentences(pages)
    aligned = templates(s.where("kind = 'slot'"))
    judged = s.join(aligned, "template", "left").withColumn("ok", F.expr("kind <> 'slot' OR size(array_except(real, constants)) = 0"))
    lines = judged.groupBy("rev_id", "line").agg(F.bool_and("ok").alias("ok"))
    return lines.where("ok").select("rev_id").distinct()


def residue_templates(pages: DataFrame) -> DataFrame:
    """template, n_sentences, n_slots of every residue template, with how often it repeats."""
    t = templates(_sentences(pages))
    return t.select("template", "n_sentences", F.size("slots").alias("n_slots"))
