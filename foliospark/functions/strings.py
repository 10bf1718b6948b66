"""String functions of the text library as Catalyst expressions.

Positions count from 0 and are -1 where nothing is found; case is changed for
ASCII letters only; null in, null out. None of these leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The alphabet, the default trim set and the vowels of the word functions.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRIM_SET = " \n\r\t\x0b\x0c"
VOWELS = "aeiouy"
# Characters that a section anchor writes as .XX, and image types.
ANCHOR_ESCAPED = "%!\"#$&'()*+,/;<=>?@[]"
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "svg": "image/png", "tif": "image/tiff", "tiff": "image/tiff"}


def _set(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\[]^-&" else c for c in chars) + "]"


def lower_ascii(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def upper_ascii(s: Column) -> Column:
    return F.translate(s, LOWER, UPPER)


def mid(s: Column, start: int, n: int | None = None) -> Column:
    """From `start`, clamped to the string; at most n characters."""
    return F.substring(s, start + 1, n if n is not None else 0x7FFFFFFF)


def find(s: Column, what: str, start: int = 0) -> Column:
    return (F.locate(what, s, start + 1) - 1).cast("bigint")


def find_one_of(s: Column, chars: str) -> Column:
    return (F.regexp_instr(s, F.lit("(" + _set(chars) + ")")) - 1).cast("bigint")


def reverse_find(s: Column, char: str) -> Column:
    at = F.locate(char, F.reverse(s))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(s) - at).cast("bigint")


def delete(s: Column, at: int, n: int) -> Column:
    return F.concat(F.substring(s, 1, at), mid(s, at + n))


def insert(s: Column, at: int, what: str) -> Column:
    return F.concat(F.substring(s, 1, at), F.lit(what), mid(s, at))


def count_of(s: Column, what: str) -> Column:
    """Occurrences that do not overlap, from the left."""
    return ((F.length(s) - F.length(F.replace(s, F.lit(what), F.lit("")))) / len(what)).cast("bigint")


def keep_only(s: Column, chars: str) -> Column:
    return F.regexp_replace(s, "[^" + _set(chars)[1:], "")


def keep_except(s: Column, chars: str) -> Column:
    return F.regexp_replace(s, _set(chars), "")


def tokenize(s: Column, delimiters: str) -> Column:
    return F.filter(F.split(s, _set(delimiters)), lambda t: t != "")


def trim_left(s: Column, chars: str = TRIM_SET) -> Column:
    return F.regexp_replace(s, "^" + _set(chars) + "+", "")


def trim_right(s: Column, chars: str = TRIM_SET) -> Column:
    return F.regexp_replace(s, _set(chars) + r"+\z", "")


def trim(s: Column, chars: str = TRIM_SET) -> Column:
    return trim_right(trim_left(s, chars), chars)


def compare(a: Column, b: Column) -> Column:
    """1 if a sorts before b, -1 after, 0 if equal: the sign is the library's, not that of C."""
    return F.when(a < b, 1).when(a > b, -1).when(a == b, 0).cast("bigint")


def capitalize(s: Column) -> Column:
    return F.concat(upper_ascii(F.substring(s, 1, 1)), mid(s, 1))


def bracketed(s: Column, left: str, right: str) -> Column:
    """Every innermost span between two signs, each followed by ' | '."""
    inner = F.regexp_extract_all(s, F.lit(f"\\{left}([^\\{left}\\{right}]*)\\{right}"), F.lit(1))
    return F.aggregate(inner, F.lit(""), lambda a, x: F.concat(a, x, F.lit(" | ")))


def remove_bracketed(s: Column, left: str, right: str, depth: int = 8) -> Column:
    """Without spans between two signs, nested up to `depth`: the innermost ones go first."""
    for _ in range(depth):
        s = F.regexp_replace(s, f"\\{left}[^\\{left}\\{right}]*\\{right}", "")
    return s


def before(s: Column, label: str) -> Column:
    return F.substring_index(s, label, 1)


def hex_lower(s: Column) -> Column:
    return lower_ascii(F.hex(F.encode(s, "utf-8")))


def extension(s: Column) -> Column:
    return F.regexp_extract(s, r"\.([^.]*)\z", 1)


def ip_number(s: Column) -> Column:
    return F.aggregate(F.split(s, "\\."), F.lit(0).cast("bigint"), lambda a, x: a * 256 + x.cast("bigint"))


def loose_long(s: Column) -> Column:
    """The digits as a number, whatever stands between them; each minus turns the sign."""
    n = F.expr("0")
    digits = F.regexp_replace(s, "[^0-9]", "")
    value = F.when(digits == "", n.cast("bigint")).otherwise(digits.try_cast("bigint"))
    return F.when(F.length(F.regexp_replace(s, "[^-]", "")) % 2 == 1, -value).otherwise(value)


def is_number(s: Column) -> Column:
    return s.rlike(r"\A[0-9]+\z")


def _ends(w: Column, pattern: str) -> Column:
    return w.rlike("(?:" + pattern + r")\z")


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def plural(w: Column) -> Column:
    """men for man, -sis and -xis to -ses and -xes, -ies after a consonant, -es after a sibilant, else -s."""
    return (
        F.when(_ends(w, "man"), F.concat(_cut(w, 2), F.lit("en")))
        .when(_ends(w, "sis|xis"), F.concat(_cut(w, 2), F.lit("es")))
        .when(_ends(w, "[^aeiouy]y"), F.concat(_cut(w, 1), F.lit("ies")))
        .when(_ends(w, "s|x|z|ch|sh"), F.concat(w, F.lit("es")))
        .otherwise(F.concat(w, F.lit("s")))
    )


def adverb(w: Column) -> Column:
    return (
        F.when(_ends(w, "[^aeiouy]y"), F.concat(_cut(w, 1), F.lit("ily")))
        .when(_ends(w, "ic"), F.concat(w, F.lit("ally")))
        .when(_ends(w, "ble"), F.concat(_cut(w, 1), F.lit("y")))
        .otherwise(F.concat(w, F.lit("ly")))
    )


def vowels(w: Column) -> Column:
    return F.length(F.regexp_replace(w, f"[^{VOWELS}]", "")).cast("bigint")


def _degree(w: Column, suffix: str) -> Column:
    """An adjective with -er or -est: y to i after a consonant, one final e, a doubled consonant after a single vowel."""
    doubled = (vowels(w) == 1) & _ends(w, "[^aeiouy][aeiou][bdgklmnprt]")
    return (
        F.when(_ends(w, "[^aeiouy]y"), F.concat(_cut(w, 1), F.lit("i" + suffix)))
        .when(_ends(w, "e"), F.concat(w, F.lit(suffix[1:])))
        .when(doubled, F.concat(w, F.right(w, F.lit(1)), F.lit(suffix)))
        .otherwise(F.concat(w, F.lit(suffix)))
    )


def comparative(w: Column) -> Column:
    return _degree(w, "er")


def superlative(w: Column) -> Column:
    return _degree(w, "est")


def ness(w: Column) -> Column:
    return F.when(_ends(w, "[^aeiouy]y"), F.concat(_cut(w, 1), F.lit("iness"))).otherwise(F.concat(w, F.lit("ness")))


def less(w: Column) -> Column:
    return F.when(_ends(w, "[^aeiouy]y"), F.concat(_cut(w, 1), F.lit("iless"))).otherwise(F.concat(w, F.lit("less")))


def all_letters(s: Column) -> Column:
    return s.rlike(r"\A[A-Za-z]*\z")


def all_digits(s: Column) -> Column:
    return s.rlike(r"\A[0-9]*\z")


def plain_name(s: Column) -> Column:
    """Letters, digits, underscores, minus signs and blanks only."""
    return s.rlike(r"\A[A-Za-z0-9_ -]*\z")


def parameter_name(s: Column) -> Column:
    return s.rlike(r"\A[a-z0-9_ -]+\z")


def all_lowercase(s: Column) -> Column:
    return s.rlike(r"\A[a-z]*\z")


def starts_with_letter(s: Column) -> Column:
    return s.rlike(r"\A[A-Za-z]")


def hms(seconds: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", (seconds / 3600).cast("bigint"), (seconds % 3600 / 60).cast("bigint"), seconds % 60)


def dollars(cents: Column) -> Column:
    return F.format_string("$%d.%02d", (cents / 100).cast("bigint"), cents % 100)


def luhn(s: Column) -> Column:
    """Luhn's check of a digit string; the empty one passes."""
    digits = F.filter(F.split(F.reverse(s), ""), lambda c: c != "")
    doubled = F.transform(digits, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def title_url(s: Column) -> Column:
    return capitalize(F.translate(trim(s), " ", "_"))


def anchor_url(s: Column) -> Column:
    """A section's address part: blanks to underscores, punctuation to .XX."""
    s = F.translate(s, " ", "_")
    for c in ANCHOR_ESCAPED:
        s = F.replace(s, F.lit(c), F.lit(f".{ord(c):02X}"))
    return s


def page_url(s: Column) -> Column:
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), title_url(s))


def url_root(s: Column) -> Column:
    return F.regexp_extract(s, r"\A(?:(?i)https?://)?([^#?/]*)", 1)


def is_url(s: Column) -> Column:
    return s.rlike(r"\A(?i)(?:https?://)?[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:[/?#]\S*)?\z")


def mime_type(s: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return F.coalesce(F.element_at(table, lower_ascii(extension(s))), F.lit(""))


def word_end_after(s: Column, at: int) -> Column:
    """The end of the first word that ends after a position; the string's length if none does."""
    rest = mid(s, at)
    head = F.regexp_extract(rest, r"\A(\W*\w+)", 1)
    return F.when(head == "", F.length(s)).otherwise(at + F.length(head)).cast("bigint")


def truncated(s: Column, n: int) -> Column:
    """Cut at the first word end from n on, with a mark; shorter strings stay."""
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.substring(s, F.lit(1), word_end_after(s, n).cast("int")), F.lit(" <b>...</b>")))


def bold_terms(s: Column, terms: list[str]) -> Column:
    """Whole words of `terms`, whatever their case, in <b>; ampersands escaped."""
    import re

    pattern = "(?i)\\b(" + "|".join(re.escape(t) for t in sorted(terms, key=lambda t: (-len(t), t))) + ")\\b"
    return F.replace(F.regexp_replace(s, pattern, "<b>$1</b>"), F.lit("&"), F.lit("&amp;"))


def limit_runs(s: Column, char: str, n: int) -> Column:
    return F.regexp_replace(s, f"{char}{{{n},}}", char * n)


def plain_entities(s: Column) -> Column:
    """Named entities of rendered text as signs; repeated escapes of the ampersand first."""
    s = F.regexp_replace(s, "&(?:amp;)+", "&")
    for name, sign in (("&gt;", ">"), ("&lt;", "<"), ("&nbsp;", " "), ("&quot;", '"'), ("&mdash;", " - "), ("&ndash;", " - ")):
        s = F.replace(s, F.lit(name), F.lit(sign))
    return s


def plain_dash(s: Column) -> Column:
    return F.translate(s, "–", "-")
