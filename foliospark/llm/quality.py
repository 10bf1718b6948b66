"""Text quality statistics per revision, exact ranks and outlier scores, and the shapes they tell apart.

1. One Arrow pass computes whole-number statistics of each text, template calls
   and comments left aside, and how many of its characters stand in list lines,
   table rows and strings that are no language.
2. Exact ranks per language group: equal values are counted first, the distinct
   values are sorted by range partitioning, and a partition's offset is the sum
   of the counts of the partitions before it. Ranks need no window over a whole
   group and no single task.
3. The tail probabilities of a text's statistics in its group are combined into
   an outlier score (the sum of their negative logarithms). Texts that are no
   more unusual than an average text are prose; of the others the shape that
   holds more than half of the characters is reported.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from foliospark.functions.arrow import map_rows
from foliospark.functions.stage import written
from foliospark.llm.residue import has_residue
from foliospark.wikitext.lexer import calls, opaque_spans, unescape_once

# Common words of the languages told apart.
COMMON = {
    "en": "the of and in to a is was for on as by with that it from at his an are were which be this or had not but has its their also one first who after into have been than two other when there all would no more between during over only some about most such".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch".split(),
    "fr": "le la les de des et en un une du dans est que pour qui par sur au avec il ne se pas plus ce sont aux son mais ou comme sa ses cette été fut elle entre nous être on était deux leur après sans".split(),
    "es": "el la los las de y en un una que del se por con es para su al lo como más fue o sus sobre entre este era pero ha también desde no hasta dos muy años esta ser son cuando sin hay".split(),
}
ALL_COMMON = frozenset().union(*COMMON.values())
# Templates of disambiguation pages.
DISAMBIGUATION = frozenset(("disambiguation", "disambiguation cleanup", "dab", "disamb", "disambig", "surname", "school disambiguation", "hndis", "geodis", "hospital disambiguation"))
# First code points of scripts by which texts are grouped.
SCRIPTS = ((0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "devanagari"), (0xE00, "thai"), (0x3040, "kana"), (0x3400, "han"), (0xAC00, "hangul"), (0xD7B0, "other"))

STATS = ("words", "word_length", "symbols", "ended_lines", "common")
#: Which tail of a statistic is unusual: both, or only high or low values.
TAILS = {"words": "low", "word_length": "both", "symbols": "high", "ended_lines": "low", "common": "low"}
SHAPES = ("list", "table", "junk")

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_ENDED = re.compile(r"[.!?…。！？।؟:;][\"'”’»)\]*_]*\s*\Z")
_TABLE = re.compile(r"^[ \t:]*\{\|.*?^[ \t]*\|\}|<table\b.*?</table\s*>|\\begin\{tabular\}.*?\\end\{tabular\}", re.S | re.M | re.I)
_LIST_BLOCK = re.compile(r"<(ul|ol|dl)\b.*?</\1\s*>", re.S | re.I)
_ITEM = re.compile(r"[*;:]+ *[^*;: ]|#+ *[^# ]|[-+•·–] +\S|\d{1,3}[.)] +\S|<li\b|\\item\b", re.I)
_PIPED = re.compile(r"\|.*\|\s*\Z|[|+ :-]*-{3,}[|+ :-]*\Z")
_STRANGE = re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}|[aeiou]{3,}|q[^u]|[a-z][A-Z][a-z]*[A-Z]|\d[a-zA-Z]|[a-zA-Z]\d")
#: Signs inside a word that no script writes there: currency, fractions, trade marks and the like.
_BROKEN = re.compile("[¢-©«-´¶-¿×÷€™‰†‡�]\\w|\\w[¢-©¬-¶¼-¾×÷€™‰†‡�]")
_SEPARATORS = ("\t", " · ", " • ", ";", " | ", "|", ", ", ",", " / ")


def _fields(line: str, separator: str) -> list[str]:
    return [x.strip() for x in line.split(separator)]


def no_language(line: str) -> bool:
    """Whether a line is made of strings that no language has: noise words, digit runs, encoded bytes."""
    tokens = line.split()
    if not tokens:
        return False
    if len(tokens) == 1 and len(line) < 24:
        return False
    letters = sum(c.isalpha() for c in line)
    if letters * 5 < len(line) * 2 and len(line) >= 12:  # digits and signs
        return not any(t.lower().strip(".,;") in ALL_COMMON for t in tokens)
    if len(tokens) >= 8 and len(set(tokens)) <= 4:
        return True
    if not line.isascii():
        if sum(1 for t in tokens if _BROKEN.search(t)) * 3 >= len(tokens) >= 3:
            return True
        if sum(c.isalpha() and not c.isascii() for c in line) * 4 > letters:
            return False
    if len(line) / len(tokens) > 22:
        return True
    if len(tokens) < 3:
        return False
    known = sum(1 for t in tokens if t.lower().strip(".,;:\"'()") in ALL_COMMON)
    if known * 8 >= len(tokens):
        return False
    return sum(1 for t in tokens if _STRANGE.search(t)) * 4 >= len(tokens)


def _row_kind(line: str) -> tuple[str, int]:
    """The separator and number of fields of a line that may be a table row; ('', 0) for others."""
    for s in ("\t", ";", "|", ","):
        n = line.count(s)
        if n >= 2 and (s != "," or ", " not in line or n >= 3):
            return s, n
    return "", 0


def _in_a_row(line: str) -> bool:
    """Names in a row: many short fields with one separator and no sentence."""
    for s in _SEPARATORS:
        if line.count(s) >= 5:
            fields = _fields(line, s)
            if max(len(x.split()) for x in fields) <= 7 and sum(len(x.split()) for x in fields) <= 4.5 * len(fields) and len(re.findall(r"[.!?](?:\s|\Z)", line)) <= 1:
                return True
    return False


def shape_counts(body: str) -> tuple[int, int, int, int]:
    """Characters in list, table, junk and all lines of a text without calls and comments."""
    total = len(re.sub(r"\s+", " ", body).strip())
    table = listed = junk = 0
    for m in _TABLE.finditer(body):
        table += len(re.sub(r"\s+", " ", m[0]))
    rest = _TABLE.sub("\n\n", body) if table else body
    if "<" in rest:
        for m in _LIST_BLOCK.finditer(rest):
            listed += len(re.sub(r"\s+", " ", m[0]))
        rest = _LIST_BLOCK.sub("\n\n", rest)
    lines = [x.strip() for x in rest.split("\n")]
    n = len(lines)
    i = 0
    while i < n:
        line = lines[i]
        if not line or line.startswith("=") and line.endswith("="):
            i += 1
            continue
        size = len(line) + 1
        if len(line) > 60 and line[-1] in ".!?" and not line.startswith(("*", "#", ":", ";", "-", "+", "|")) and (line.count(". ") or line.count(" ") > 6) and not no_language(line):
            i += 1
            continue
        if _ITEM.match(line):
            j = i
            while j < n and lines[j] and _ITEM.match(lines[j]):
                j += 1
            block = lines[i:j]
            if j - i > 1 or not line.startswith("#"):
                listed += sum(len(x) + 1 for x in block)
                i = j
                continue
        if _PIPED.match(line):
            table += size
            i += 1
            continue
        separator, count = _row_kind(line)
        if separator:
            j = i
            while j < n and lines[j] and _row_kind(lines[j]) == (separator, count):
                j += 1
            if j - i >= 3:
                table += sum(len(x) + 1 for x in lines[i:j])
                i = j
                continue
        if no_language(line):
            junk += size
        elif _in_a_row(line):
            listed += size
        elif len(line) <= 60 and not _ENDED.search(line) and line[-1] not in ",-" and len(line.split()) <= 7:
            j = i
            while j < n and lines[j] and len(lines[j]) <= 60 and not _ENDED.search(lines[j]) and len(lines[j].split()) <= 7 and not no_language(lines[j]):
                j += 1
            if j - i >= 3 and not any(re.match(r"[=-]{3,}\Z|\\\w+|<|[{%$@_\[]", x) for x in lines[i:j]):
                listed += sum(len(x) + 1 for x in lines[i:j])
            i = max(j, i + 1)
            continue
        i += 1
    return listed, table, junk, total


def body_of(text: str) -> tuple[str, bool]:
    """Unescaped text without comments and outer template calls, and whether a call marks a disambiguation page."""
    cut = [(s, e) for s, e, kind in opaque_spans(text) if kind == "comment"] if "<!--" in text or "%" in text else []
    disambiguation = False
    if "{{" in text:
        hidden = list(text)
        for s, e in cut:
            hidden[s:e] = "\x00" * (e - s)
        mask = "".join(hidden)
        for s, e, parent, _ in calls(mask):
            if parent < 0:
                cut.append((s, e))
                name = mask[s + 2 : e - 2].split("|", 1)[0].strip().lower()
                disambiguation = disambiguation or name in DISAMBIGUATION
    if cut:
        cut.sort()
        parts, at = [], 0
        for s, e in cut:
            if s >= at:
                parts.append(text[at:s])
            at = max(at, e)
        parts.append(text[at:])
        text = "".join(parts)
    return text, disambiguation


def _script(words: list[str]) -> str:
    """The script of the first word; texts without a word are ranked with the dump's own script."""
    for w in words:
        c = ord(w[0])
        if c >= 0x41:
            return next(name for start, name in reversed(SCRIPTS) if c >= start)
    return "latin"


_REDIRECT = re.compile(r"\s*#\s*redirect", re.I)


def statistics(text: str) -> tuple[str, list[int], str | None]:
    """Language group, the STATS as whole numbers (ratios per 10,000) and the shape that holds more than half of the characters."""
    text = unescape_once(text)
    body, disambiguation = body_of(text)
    words = _WORD.findall(body)
    n = len(words)
    size = max(1, len(body))
    lines = [x for x in body.split("\n") if x.strip()]
    stats = [
        n,
        sum(map(len, words)) * 1000 // n if n else 0,
        len(_SYMBOL.findall(body)) * 10000 // size,
        sum(1 for x in lines if _ENDED.search(x[-12:])) * 10000 // max(1, len(lines)),
        sum(1 for w in words if w.lower() in ALL_COMMON) * 10000 // n if n else 0,
    ]
    shape = None
    if not _REDIRECT.match(text) and body.strip():
        listed, table, junk, total = shape_counts(body)
        most, name = max((listed, "list"), (table, "table"), (junk, "junk"))
        if disambiguation:
            shape = "list"
        elif 2 * most > total:
            shape = name
        if shape and not disambiguation and has_residue(text):
            shape = None
    return _script(words), stats, shape


def _batch(b: pa.RecordBatch) -> pa.RecordBatch:
    found = [statistics(t) for t in b.column("text").to_pylist()]
    cols = [b.column("rev_id"), pa.array([g for g, _, _ in found], pa.string())]
    cols += [pa.array([s[i] for _, s, _ in found], pa.int32()) for i in range(len(STATS))]
    return pa.RecordBatch.from_arrays([*cols, pa.array([x for _, _, x in found], pa.string())], ["rev_id", "lang_group", *STATS, "shape"])


def text_statistics(pages: DataFrame) -> DataFrame:
    """rev_id, lang_group, STATS, shape of each revision with a text, written to the shared folder.

    Ratios are whole ten-thousandths, word_length thousandths of a letter. Null
    and empty texts and null rev_ids give no row; a repeated revision gives one
    (of differing texts the smallest row). Other columns are ignored.
    """
    schema = "rev_id BIGINT, lang_group STRING, " + "".join(f"{s} INT, " for s in STATS) + "shape STRING"
    texts = pages.where("length(text) > 0 AND rev_id IS NOT NULL").select(F.col("rev_id").cast("long").alias("rev_id"), "text")
    every = map_rows(texts, _batch, schema)
    columns = ["lang_group", *STATS, "shape"]
    once = every.groupBy("rev_id").agg(F.min(F.struct(*columns)).alias("s"))
    return written(once.select("rev_id", *(F.col(f"s.{c}").alias(c) for c in columns)), "text-statistics")


def exact_ranks(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value, n, at_most, total: for each distinct value how many rows of its group have it or a smaller one.

    Equal values are counted before the sort, so a value that a third of all
    rows share is one row. The sort is by range partitions; offsets come from
    one sum per partition and group, joined back to it.
    """
    counts = values.groupBy(*group, value).agg(F.count("*").alias("n"))
    placed = counts.repartitionByRange(*group, value).withColumn("part", F.spark_partition_id())
    placed = written(placed, "distinct-values")
    inside = Window.partitionBy("part", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.groupBy("part", *group).agg(F.sum("n").alias("in_part"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = sums.select("part", *group, F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"), F.sum("in_part").over(whole).alias("total"))
    ranked = placed.withColumn("inner", F.sum("n").over(inside)).join(offsets, ["part", *group])
    return ranked.select(*group, value, "n", (F.col("inner") + F.col("offset")).alias("at_most"), "total")


def outliers(stats: DataFrame) -> DataFrame:
    """rev_id, lang_group, STATS, shape, score: the sum of -ln(tail probability) of the STATS in the language group."""
    long = stats.select("lang_group", F.explode(F.array(*(F.struct(F.lit(s).alias("stat"), F.col(s).alias("x")) for s in STATS))).alias("e")).select("lang_group", "e.stat", "e.x")
    r = exact_ranks(long, ["lang_group", "stat"], "x")
    tail = F.expr(" ".join(["CASE stat", *(f"WHEN '{s}' THEN " + {"low": "at_most / total", "high": "(total - at_most + n) / total", "both": "least(1D, 2 * least(at_most, total - at_most + n) / total)"}[t] for s, t in TAILS.items()), "END"]))
    weights = written(r.select("lang_group", "stat", "x", (-F.log(tail)).alias("w")), "tail-probabilities")
    out = stats.withColumn("score", F.lit(0.0))
    for s in STATS:
        w = weights.where(F.col("stat") == s).select("lang_group", F.col("x").alias(s), F.col("w").alias("_w"))
        out = out.join(w, ["lang_group", s], "left").withColumn("score", F.col("score") + F.col("_w")).drop("_w")
    return out.select("rev_id", "lang_group", *STATS, "shape", F.round("score", 6).alias("score"))


#: A text with all statistics in the middle of its group has a score of about len(STATS); less than this is no outlier.
USUAL = 3.0


def shapes(pages: DataFrame) -> DataFrame:
    """rev_id, shape (list, table or junk) of article revisions (ns = 0) that are no prose. Defined as in `text_statistics`."""
    found = outliers(text_statistics(pages.where("ns = 0")))
    return found.where(F.col("shape").isNotNull() & (F.col("score") >= USUAL)).select("rev_id", "shape")
