"""Queries of the string functions with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import strings as S
from foliospark.plans.registry import columns

UP, LOW = S.UPPER, S.LOWER


def _NAME():
    return F.col("p_name")


def _TITLE():
    return F.col("title")


def _WORD():
    return F.col("w")


def _words(df):
    return df.withColumn("w", F.lower(F.substring_index("p_name", " ", 1)))


columns("f_substrings", "part", ["p_partkey"], {
    "l": (lambda: F.left(_NAME(), F.lit(3)), "left(p_name, 3)"), "r": (lambda: F.right(_NAME(), F.lit(4)), "right(p_name, 4)"),
    "m": (lambda: S.mid(_NAME(), 2), "substr(p_name, 3)"), "m5": (lambda: S.mid(_NAME(), 2, 5), "substr(p_name, 3, 5)"), "far": (lambda: S.mid(_NAME(), 900), "substr(p_name, 901)"),
})
columns("f_find", "dump_pages", ["rev_id"], {
    "at": (lambda: S.find(_TITLE(), "a"), "strpos(title, 'a') - 1"),
    "later": (lambda: S.find(_TITLE(), "a", 3), "CASE WHEN strpos(substr(title, 4), 'a') = 0 THEN -1 ELSE strpos(substr(title, 4), 'a') + 2 END"),
    "one_of": (lambda: S.find_one_of(_TITLE(), "_ (:"), "length(regexp_extract(title, '^[^_ (:]*')) - CASE WHEN title ~ '.*[_ (:].*' THEN 0 ELSE length(title) + 1 END"),
    "last_at": (lambda: S.reverse_find(_TITLE(), "e"), "CASE WHEN strpos(reverse(title), 'e') = 0 THEN -1 ELSE length(title) - strpos(reverse(title), 'e') END"),
})
columns("f_edit", "dump_pages", ["rev_id"], {
    "deleted": (lambda: S.delete(_TITLE(), 2, 3), "left(title, 2) || substr(title, 6)"), "inserted": (lambda: S.insert(_TITLE(), 4, "<>"), "left(title, 4) || '<>' || substr(title, 5)"),
    "removed": (lambda: F.replace(_TITLE(), F.lit("a"), F.lit("")), "replace(title, 'a', '')"), "n_removed": (lambda: S.count_of(_TITLE(), "a"), "length(title) - length(replace(title, 'a', ''))"),
    "replaced": (lambda: F.replace(_TITLE(), F.lit("or"), F.lit("[or]")), "replace(title, 'or', '[or]')"), "n_replaced": (lambda: S.count_of(_TITLE(), "or"), "(length(title) - length(replace(title, 'or', ''))) // 2"),
})
columns("f_span", "dump_pages", ["rev_id"], {
    "excluding": (lambda: S.keep_except(_TITLE(), "aeiou _"), "regexp_replace(title, '[aeiou _]', '', 'g')"), "including": (lambda: S.keep_only(_TITLE(), "aeiou _"), "regexp_replace(title, '[^aeiou _]', '', 'g')"),
})
columns("f_tokenize", "dump_pages", ["rev_id"], {
    "tokens": (lambda: F.array_join(S.tokenize(_TITLE(), " _()"), "|"), "array_to_string(list_filter(string_split_regex(title, '[ _()]'), lambda x: x <> ''), '|')"),
    "n": (lambda: F.size(S.tokenize(_TITLE(), " _()")).cast("bigint"), "len(list_filter(string_split_regex(title, '[ _()]'), lambda x: x <> ''))"),
}, where="title IS NOT NULL")
columns("trim_set", "dump_pages", ["rev_id"], {
    "both": (lambda: S.trim(_TITLE()), "regexp_replace(regexp_replace(title, '^[ \\n\\r\\t\\v\\f]+', ''), '[ \\n\\r\\t\\v\\f]+$', '')"),
    "l": (lambda: S.trim_left(_TITLE(), " _"), "ltrim(title, ' _')"), "r": (lambda: S.trim_right(_TITLE(), " _)"), "rtrim(title, ' _)')"),
})
columns("string_case_ascii", "documents", ["doc_id"], {
    "u": (lambda: S.upper_ascii(F.col("text")), f"translate(text, '{LOW}', '{UP}')"), "l": (lambda: S.lower_ascii(F.col("text")), f"translate(text, '{UP}', '{LOW}')"),
})
columns("f_reverse_format", "part", ["p_partkey"], {
    "back": (lambda: F.reverse(_NAME()), "reverse(p_name)"), "line": (lambda: F.format_string("%05d:%s:%.2f", F.col("p_size"), F.col("p_brand"), F.col("p_retailprice")), "format('{:05d}:{}:{:.2f}', p_size, p_brand, p_retailprice)"),
    "glued": (lambda: F.concat(F.col("p_brand"), F.lit("/"), F.col("p_type")), "p_brand || '/' || p_type"), "char_at": (lambda: F.substring(_NAME(), 2, 1), "substr(p_name, 2, 1)"),
})
columns("f_compare", "part", ["p_partkey"], {"sign": (lambda: S.compare(_NAME(), F.col("p_type")), "CASE WHEN p_name < p_type THEN 1 WHEN p_name > p_type THEN -1 ELSE 0 END::BIGINT")})
columns("f_bracketed", "dump_pages", ["rev_id"], {
    "inner": (lambda: S.bracketed(_TITLE(), "(", ")"), "CASE WHEN title IS NULL THEN NULL ELSE coalesce(nullif(array_to_string(regexp_extract_all(title, '\\(([^()]*)\\)', 1), ' | ') || ' | ', ' | '), '') END"),
    "outer_text": (lambda: S.remove_bracketed(_TITLE(), "(", ")", 2), "regexp_replace(regexp_replace(title, '\\([^()]*\\)', '', 'g'), '\\([^()]*\\)', '', 'g')"),
    "head": (lambda: S.before(_TITLE(), " ("), "split_part(title, ' (', 1)"),
})
columns("f_hex_extension", "dump_pages", ["rev_id"], {
    "hexed": (lambda: S.hex_lower(_TITLE()), "lower(hex(encode(title)))"), "ext": (lambda: S.extension(F.concat_ws(".", _TITLE(), F.lit("x.Png"))), "CASE WHEN title IS NULL THEN 'Png' ELSE regexp_extract(title || '.x.Png', '\\.([^.]*)$', 1) END"),
})
columns("f_numbers", "part", ["p_partkey"], {
    "ip": (lambda: S.ip_number(F.concat_ws(".", F.lit("10"), F.col("p_size"), F.col("p_partkey") % 256, F.lit("7"))), "10 * 16777216 + p_size * 65536 + (p_partkey % 256) * 256 + 7"),
    "loose": (lambda: S.loose_long(F.concat(F.lit("a-"), F.col("p_brand"), F.lit("x"), F.col("p_size"))), "-1 * (regexp_replace(p_brand, '[^0-9]', '', 'g') || p_size)::BIGINT"),
    "number": (lambda: S.is_number(F.col("p_size").cast("string")), "regexp_full_match(p_size::VARCHAR, '[0-9]+')"), "no_number": (lambda: S.is_number(F.col("p_brand")), "regexp_full_match(p_brand, '[0-9]+')"),
})
_W = "lower(split_part(p_name, ' ', 1))"
_END = "regexp_matches(w, '({})$')".format
_Y = _END("[^aeiouy]y")
_DOUBLE = "length(regexp_replace(w, '[^aeiouy]', '', 'g')) = 1 AND " + _END("[^aeiouy][aeiou][bdgklmnprt]")


def _degree(s):
    return f"CASE WHEN {_Y} THEN left(w, length(w) - 1) || 'i{s}' WHEN {_END('e')} THEN w || '{s[1:]}' WHEN {_DOUBLE} THEN w || right(w, 1) || '{s}' ELSE w || '{s}' END"


def _word_query(name, cols):
    columns(name, "part", ["p_partkey"], cols, base=_words, base_sql=f"(SELECT *, {_W} AS w FROM part)")


_word_query("plural", {"form": (lambda: S.plural(_WORD()), f"CASE WHEN {_END('man')} THEN left(w, length(w) - 2) || 'en' WHEN {_END('sis|xis')} THEN left(w, length(w) - 2) || 'es' WHEN {_Y} THEN left(w, length(w) - 1) || 'ies' WHEN {_END('s|x|z|ch|sh')} THEN w || 'es' ELSE w || 's' END")})
_word_query("adverb", {"form": (lambda: S.adverb(_WORD()), f"CASE WHEN {_Y} THEN left(w, length(w) - 1) || 'ily' WHEN {_END('ic')} THEN w || 'ally' WHEN {_END('ble')} THEN left(w, length(w) - 1) || 'y' ELSE w || 'ly' END")})
_word_query("comparative", {"form": (lambda: S.comparative(_WORD()), _degree("er"))})
_word_query("superlative", {"form": (lambda: S.superlative(_WORD()), _degree("est"))})
_word_query("f_ness_less", {"ness": (lambda: S.ness(_WORD()), f"CASE WHEN {_Y} THEN left(w, length(w) - 1) || 'iness' ELSE w || 'ness' END"), "less": (lambda: S.less(_WORD()), f"CASE WHEN {_Y} THEN left(w, length(w) - 1) || 'iless' ELSE w || 'less' END")})
_word_query("vowels", {"n": (lambda: S.vowels(_WORD()), "length(regexp_replace(w, '[^aeiouy]', '', 'g'))"), "sibilant": (lambda: _WORD().rlike(r"(?:s|x|z|ch|sh)\z"), _END("s|x|z|ch|sh")), "hard_end": (lambda: _WORD().rlike(r"[bdgklmnprt]\z"), _END("[bdgklmnprt]"))})
columns("f_word_classes", "dump_pages", ["rev_id"], {
    "letters": (lambda: S.all_letters(_TITLE()), "regexp_full_match(title, '[A-Za-z]*')"), "digits": (lambda: S.all_digits(_TITLE()), "regexp_full_match(title, '[0-9]*')"), "plain": (lambda: S.plain_name(_TITLE()), "regexp_full_match(title, '[A-Za-z0-9_ -]*')"),
    "parameter": (lambda: S.parameter_name(_TITLE()), "regexp_full_match(title, '[a-z0-9_ -]+')"), "lowercase": (lambda: S.all_lowercase(_TITLE()), "regexp_full_match(title, '[a-z]*')"), "letter_first": (lambda: S.starts_with_letter(_TITLE()), "regexp_matches(title, '^[A-Za-z]')"),
})
columns("f_time_money", "part", ["p_partkey"], {
    "hms": (lambda: S.hms(F.col("p_partkey") * 37), "printf('%02d:%02d:%02d', p_partkey * 37 // 3600, p_partkey * 37 % 3600 // 60, p_partkey * 37 % 60)"),
    "dollars": (lambda: S.dollars(F.col("p_partkey") * 13), "printf('$%d.%02d', p_partkey * 13 // 100, p_partkey * 13 % 100)"),
})
_DIGITS = "regexp_replace(contributor, '[^0-9]', '', 'g')"
columns("luhn", "part", ["p_partkey"], {"ok": (lambda: S.luhn((F.col("p_partkey") * 7919).cast("string")), "list_sum(list_transform(range(1, length((p_partkey * 7919)::VARCHAR) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse((p_partkey * 7919)::VARCHAR), i, 1)::INT WHEN substr(reverse((p_partkey * 7919)::VARCHAR), i, 1)::INT > 4 THEN substr(reverse((p_partkey * 7919)::VARCHAR), i, 1)::INT * 2 - 9 ELSE substr(reverse((p_partkey * 7919)::VARCHAR), i, 1)::INT * 2 END)) % 10 = 0")})
columns("digits", "documents", ["doc_id"], {"d": (lambda: S.digits(F.col("text")), "regexp_replace(text, '[^0-9]', '', 'g')")})


def _anchor_sql(x):
    x = f"replace({x}, ' ', '_')"
    for c in S.ANCHOR_ESCAPED:
        x = f"replace({x}, '{c if c != chr(39) else chr(39) * 2}', '.{ord(c):02X}')"
    return x


_CAP = "upper(left(t, 1)) || substr(t, 2)"
_TRIMMED = "regexp_replace(regexp_replace(title, '^[ \\n\\r\\t\\v\\f]+', ''), '[ \\n\\r\\t\\v\\f]+$', '')"
_URL_BASE = f"(SELECT *, replace({_TRIMMED}, ' ', '_') AS t FROM dump_pages)"
columns("url_section_encode", "dump_pages", ["rev_id"], {
    "anchor": (lambda: S.anchor_url(_TITLE()), _anchor_sql("title")), "title_part": (lambda: S.title_url(_TITLE()), f"translate(left(t, 1), '{LOW}', '{UP}') || substr(t, 2)"),
    "url": (lambda: S.page_url(_TITLE()), f"'https://en.wikipedia.org/wiki/' || translate(left(t, 1), '{LOW}', '{UP}') || substr(t, 2)"),
}, base_sql=_URL_BASE)
def _LINKS():
    return F.explode(F.regexp_extract_all("text", F.lit(r"(https?://[^\s\]|)<&]+)"), F.lit(1)))
columns("url_root", "dump_pages", ["rev_id"], {
    "root": (lambda: S.url_root(F.col("u")), "regexp_extract(u, '^(?:(?i:https?://))?([^#?/]*)', 1)"), "valid": (lambda: S.is_url(F.col("u")), "regexp_full_match(u, '(?i:(?:https?://)?[a-z0-9-]+(?:\\.[a-z0-9-]+)+(?:[/?#]\\S*)?)')"),
}, base=lambda df: df.select("rev_id", _LINKS().alias("u")), base_sql="(SELECT rev_id, unnest(regexp_extract_all(text, 'https?://[^\\s\\]|)<&]+')) AS u FROM dump_pages)")
columns("f_mime", "infobox_params", ["param"], {"mime": (lambda: S.mime_type(F.concat(F.col("param"), F.lit(".SVG"))), "CASE WHEN param IS NOT NULL THEN 'image/png' ELSE '' END"), "none": (lambda: S.mime_type(F.col("param")), "CASE WHEN TRUE THEN '' END")})
columns("truncate_wordbreak", "part", ["p_partkey"], {
    "cut": (lambda: S.truncated(_NAME(), 7), "CASE WHEN length(p_name) <= 7 THEN p_name WHEN regexp_extract(substr(p_name, 8), '^(\\W*\\w+)', 1) = '' THEN p_name || ' <b>...</b>' ELSE left(p_name, 7 + length(regexp_extract(substr(p_name, 8), '^(\\W*\\w+)', 1))) || ' <b>...</b>' END"),
    "word_end": (lambda: S.word_end_after(_NAME(), 3), "CASE WHEN regexp_extract(substr(p_name, 4), '^(\\W*\\w+)', 1) = '' THEN length(p_name) ELSE 3 + length(regexp_extract(substr(p_name, 4), '^(\\W*\\w+)', 1)) END"),
})
columns("mark_bold", "part", ["p_partkey"], {"marked": (lambda: S.bold_terms(_NAME(), ["part", "1", "12"]), "replace(regexp_replace(p_name, '(?i)\\b(part|12|1)\\b', '<b>\\1</b>', 'g'), '&', '&amp;')"), "n": (lambda: F.regexp_count(_NAME(), F.lit("(?i)\\b(?:part|12|1)\\b")).cast("bigint"), "len(regexp_extract_all(p_name, '(?i)\\b(?:part|12|1)\\b'))")})
columns("r_entities", "dump_pages", ["rev_id"], {
    "plain": (lambda: S.plain_entities(F.col("text")), "replace(replace(replace(replace(replace(replace(regexp_replace(text, '&(amp;)+', '&', 'g'), '&gt;', '>'), '&lt;', '<'), '&nbsp;', ' '), '&quot;', '\"'), '&mdash;', ' - '), '&ndash;', ' - ')"),
    "dashes": (lambda: S.plain_dash(F.col("text")), "replace(text, '–', '-')"), "runs": (lambda: S.limit_runs(F.col("text"), "\n", 2), "regexp_replace(text, '\\n{2,}', chr(10) || chr(10), 'g')"),
})
