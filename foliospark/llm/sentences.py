"""Sentence units in any language and script by a semi-Markov dynamic programme.

A paragraph (text between blank lines) is cut into whole sentence spans. Every
place after an end mark, and every blank of Thai text, may close a span. A span
is scored as a whole: by the word or mark that closes it, the word that opens
the next one, its length, and by whether its quotes and brackets balance (a
span that quotes first goes on to the clause that reports the quote). The
programme takes the sequence of spans with the highest sum. No language label
is used; scripts are read off the characters.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliospark.functions.arrow import map_rows

# Abbreviations that a sentence runs past, in the languages of the corpus.
RUNS_PAST = frozenset(
    "mr mrs ms dr prof st mt ft lt col gen capt sgt rev hon gov sen rep no nos vol vols fig figs p pp cf ca c approx vs ed eds ch sec art yr op viz resp dept messrs "
    "jan feb mar apr jun jul aug sep sept oct nov dec e.g i.e "
    "sog vgl abb nr bd hr fr abs s bzw ggf evtl inkl str z u d b a z.b d.h u.a jh "
    "m mm mme mlle env chap av éd "
    "sr sra srta dra dña ud uds núm pág págs v ej ee uu nn "
    "см рис ок акад ул д т е им проф стр гл ст тов гр тыс млн руб п "
    "κ κα κος βλ σελ δηλ αρ "
    "د أ ص م ج ق هـ".split()
)
# Abbreviations that may close a sentence, if the span is long enough to be one.
MAY_CLOSE = frozenset("etc inc co ltd corp bros jr al g h km г в гг вв чел км м с.г p.m a.m т.д т.п др κ.λπ κλπ χλμ μ.χ π.χ b.c a.d b.e".split())
# Month names that follow a day's ordinal with a full stop.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner jh jahrhundert jhd jhdt".split())
# Pairs of quotes and brackets.
PAIRS = {"«": "»", "„": "“”", "“": "”", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "(": ")", "[": "]", "【": "】", "{": "}"}

_BRACKETS = frozenset("([（【{")
_CLOSERS = frozenset("".join(PAIRS.values()) + '"')
_MARKS = re.compile("(\\.(?:[ \xa0]?\\.)+|[.!?…。！？．｡।॥؟۔։።])[.!?…。！？．｡।॥؟]*|(?<=[Ͱ-Ͽἀ-῿»\\d]);|;")
_THAI_BLANK = re.compile(r"(?<=[฀-๿»”\")])[ \t 　]+(?=[^\s\d])")
_PAIR_SIGN = re.compile("[" + re.escape("".join(PAIRS) + "".join(PAIRS.values())) + '"]')
_BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+")
_WORD_BEFORE = re.compile(r"[^\W_](?:[^\W_]|[ऀ-ःऺ-ॏ]|[.'’](?=[^\W_]))*\Z")
_URL = re.compile(r"www|://|@|/")
_NO_BLANK = re.compile("[。！？．｡।॥؟۔։።]")
_SPACE = re.compile(r"\S")
_GREEK_LAST = re.compile(r"[Ͱ-Ͽἀ-῿][\W\d_]*\Z")
_NEXT_WORD = re.compile(r"[^\W\d_]+")

#: A span may hold at most so many plausible inner boundaries; the longest real ones hold a handful.
REACH = 64
NO = -100.0


def _pairs(text: str) -> tuple[dict[int, int], list[int], list[int]]:
    """Matched quotes and brackets: closer -> opener, and the outermost pairs as sorted starts and ends. Unmatched signs count for nothing."""
    stack: list[tuple[str, int]] = []
    opener: dict[int, int] = {}
    for m in _PAIR_SIGN.finditer(text):
        sign, at = m[0], m.start()
        k = len(stack) - 1
        while k >= 0 and sign not in ('"' if stack[k][0] == '"' else PAIRS[stack[k][0]]):
            k -= 1
        if k >= 0 and not (sign == '"' and at + 1 < len(text) and text[at + 1].isalnum() and text[at - 1].isspace()):
            opener[at] = stack[k][1]
            del stack[k:]
        elif sign in PAIRS:
            stack.append((sign, at))
        elif sign == '"' and at + 1 < len(text) and not text[at + 1].isspace() and (not at or not text[at - 1].isalnum()):
            stack.append((sign, at))
    starts, ends, last = [], [], -1
    for start, end in sorted((o, c) for c, o in opener.items()):
        if start > last:
            starts.append(start)
            ends.append(end)
            last = end
    return opener, starts, ends


def _case(text: str, at: int) -> str:
    """What opens at a place, after opening signs: upper, lower, digit, other (letters without case), sign or end."""
    n = len(text)
    quoted = False
    while at < n and (text[at] in PAIRS or text[at] in '"¿¡' or text[at].isspace()):
        quoted = quoted or text[at] in PAIRS or text[at] in '"¿¡'
        at += 1
    if at >= n:
        return "end"
    c = text[at]
    if c.isdigit():
        return "digit"
    if c.islower():
        return "upper" if at + 1 < n and text[at + 1].isupper() else "quoted" if quoted else "lower"
    if c.isupper() or c.istitle():
        return "upper"
    return "other" if c.isalpha() else "sign"


def _candidates(text: str) -> list[tuple[int, int, float, int, int]]:
    """(end, next start, score, least words, opener) of the places where a span may close; opener is that of a quote closed there, or -1."""
    opener, pair_start, pair_end = _pairs(text)
    n = len(text)
    out = []
    places = [(m.start(), m.end(), m[0]) for m in _MARKS.finditer(text)]
    if re.search("[฀-๿]", text):
        places += [(m.start(), m.start(), " ") for m in _THAI_BLANK.finditer(text)]
        places.sort()
    for at, end, mark in places:
        closed = -1
        while end < n:  # closing quotes and brackets belong to the span
            k = end
            if mark != " " and text[k] in " \xa0 " and k + 1 < n and text[k + 1] == "»":
                k += 1
            if k in opener:
                closed = opener[k]
                end = k + 1
                while end < n and text[end] in ".!?…" and mark != " ":
                    end += 1
            else:
                break
        m = _SPACE.search(text, end)
        if not m:
            continue
        follow = m.start()
        k = bisect_left(pair_start, end) - 1
        if k >= 0 and pair_end[k] >= end:  # inside an outer pair
            continue
        c = text[follow]
        glued = follow == end
        case = _case(text, follow)
        if case in ("lower", "end") or (case == "sign" and c not in PAIRS and c not in "-–—*#•") or c in "—–-,;:":
            continue
        if mark[0] == ";" and not _GREEK_LAST.search(text[max(0, at - 30) : at]):
            continue
        least = 0
        if mark == " ":
            if not ("฀" <= text[follow] <= "๿" or c in PAIRS or c == '"'):
                continue
            out.append((end, follow, 2.0, 0, closed))
            continue
        score = 3.0 if case == "upper" else 2.5
        if mark == "." and closed < 0:
            head = text[max(0, at - 40) : at]
            w = _WORD_BEFORE.search(head)
            word = w[0] if w else ""
            low = word.lower()
            if word and "ऀ" <= word[-1] <= "ॿ":
                continue
            token = head.rsplit(None, 1)[-1] if head and not head[-1].isspace() else ""
            if glued:
                if case != "upper" or not word or len(word) < 2 or "." in word or _URL.search(token) or low in RUNS_PAST:
                    continue
                nw = _NEXT_WORD.match(text, follow)
                if nw and (len(nw[0]) > 1 and not nw[0][1:].islower() or re.match(r"[.@/]\w", text[nw.end() : nw.end() + 2])):
                    continue
            if low in RUNS_PAST:
                score -= 8
            elif low in MAY_CLOSE or "." in word:
                least = 5
                score -= 1
            elif len(word) == 1 and word.isalpha():
                score -= 8
            elif len(word) == 2 and word.isupper():
                score -= 4
            elif word.isdigit() and len(word) <= 2 and case == "upper":
                nw = _NEXT_WORD.match(text, follow)
                if nw and nw[0].lower() in MONTHS:
                    continue
                least = 2
        elif glued and not _NO_BLANK.search(text[at:end]) and closed < 0:
            before = text[at - 1 : at]
            if case == "digit" and not (before.isalpha() and not before.isupper() and not before.islower()):
                continue
        if score > 0:
            out.append((end, follow, score, least, closed))
    return out


def _words(text: str) -> list[int]:
    return [m.start() for m in re.finditer(r"\S+", text)]


def spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sentences of one paragraph without outer white space: the best sequence of whole spans."""
    cand = _candidates(text)
    if not cand:
        return [(0, len(text))]
    word_at = _words(text)
    starts = [0, *(c[1] for c in cand)]
    rank = [bisect_left(word_at, s) for s in starts]
    n = len(starts)
    best = [0.0] + [NO * n] * (n - 1)
    back = [0] * n
    for j in range(1, n):
        end, follow, score, least, closed = cand[j - 1]
        own = not (text[follow].isupper() or text[follow].isdigit() or (text[follow] in PAIRS or text[follow] in '"¿¡') and _case(text, follow) in ("upper", "quoted"))
        for i in range(max(0, j - REACH), j):
            s = starts[i]
            worth = score
            count = rank[j] - rank[i]
            if count < least:
                worth -= 6
            if closed >= 0:
                if text[closed] in _BRACKETS:
                    worth += 0 if closed == s else NO
                elif closed == s:  # quoted first: what reports it follows
                    worth += NO if own else 0
                elif own and text[:closed].rstrip()[-1:] not in (":", "：", ",", "，", "،", "、"):
                    worth += NO
            if count > 80:
                worth -= 0.02 * (count - 80)
            if best[i] + worth > best[j]:
                best[j], back[j] = best[i] + worth, i
    # the last span ends with the paragraph, whatever closes it
    at = max(range(max(0, n - REACH), n), key=lambda i: (best[i], -i))
    cuts = []
    while at:
        cuts.append(at)
        at = back[at]
    out, begin = [], 0
    for j in reversed(cuts):
        out.append((begin, cand[j - 1][0]))
        begin = cand[j - 1][1]
    out.append((begin, len(text)))
    return out


def units(text: str | None) -> list[tuple[int, int]]:
    """(start, end) in code points of every sentence or heading of a text, in order."""
    if not text:
        return []
    out = []
    at = 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        stop = m.start() if m else len(text)
        part = text[at:stop]
        body = part.strip()
        if body:
            base = at + len(part) - len(part.lstrip())
            out.extend((base + a, base + b) for a, b in spans(body))
        at = m.end() if m else stop
    return out


def _batch(b: pa.RecordBatch) -> pa.RecordBatch:
    docs, number, start, end = [], [], [], []
    for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
        found = units(text)
        docs += [doc] * len(found)
        number += range(1, len(found) + 1)
        start += [s for s, _ in found]
        end += [e for _, e in found]
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(pa.array(x, pa.int32()) for x in (number, start, end))], ["doc_id", "sent_no", "start_at", "end_at"])


def sentence_units(documents: DataFrame) -> DataFrame:
    """doc_id, sent_no, start_at, end_at of every sentence or heading of every document row.

    `documents` needs doc_id and text. Null, empty and blank texts have no
    units; a repeated row repeats its units; other columns are ignored.
    Positions count code points from 0, the end is exclusive. No shuffle.
    """
    return map_rows(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _batch, "doc_id BIGINT, sent_no INT, start_at INT, end_at INT")
