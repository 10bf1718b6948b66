"""Page records, types, redirects and reports, as Catalyst expressions before any parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions.strings import lower_ascii

# Templates that mark disambiguation and list pages.
DISAMBIGUATION = ("disambiguation", "disambiguation cleanup", "dab", "disamb", "disambig", "surname", "school disambiguation", "hndis", "geodis", "hospital disambiguation")
LIST_TEMPLATES = ("set index", "sia", "set index article", "months", "yearbox", "events by month links")
# Whole titles of list pages.
LIST_TITLES = (
    r"List of .*", r"Lists of .*", r"Index of .*", r"[0-9]{1,4}", r"[0-9]{1,4}s", r"[0-9]{2}th century in .*", r"[0-9]{1,4} in .*", r"[A-Z][a-z]+ [0-9]{1,4} in .*", r".* at the [0-9]{4} .* Olympics", r".*-related articles", r"Timeline of .*",
)
#: Namespace of a page that names none.
NO_NAMESPACE = -10


def title(raw: Column) -> Column:
    """Between the first <title> and the next </title>; null if either is missing."""
    t = F.regexp_extract(raw, "(?s)<title>(.*?)</title>", 1)
    return F.when(raw.rlike("(?s)<title>.*?</title>"), t)


def namespace(raw: Column) -> Column:
    """The number in <ns>; junk is 0, none is NO_NAMESPACE."""
    body = F.regexp_extract(raw, "(?s)<ns>(.*?)</ns>", 1)
    return F.when(body == "", F.lit(NO_NAMESPACE)).otherwise(F.coalesce(F.regexp_extract(body, r"\A\s*(-?[0-9]+)", 1).try_cast("int"), F.lit(0)))


def body(raw: Column) -> Column:
    """The text behind a line feed; null without a closing tag."""
    t = F.regexp_extract(raw, "(?s)<text[^>]*>(.*?)</text>", 1)
    return F.when(raw.rlike("(?s)<text[^>]*>.*?</text>"), F.concat(F.lit("\n"), t))


def records(raw: DataFrame) -> DataFrame:
    """title, ns, text of page strings in a column `raw`."""
    r = F.col("raw")
    return raw.select(title(r).alias("title"), namespace(r).alias("ns"), body(r).alias("text"))


def substituted(text: Column) -> Column:
    """Twice-escaped blanks and ampersands, and the table-of-contents words."""
    for a, b in (("&amp;nbsp;", " "), ("&amp;", "&"), ("__NOTOC__", ""), ("__TOC__", "")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def line_feeds(text: Column) -> Column:
    """Any line end as one line feed, at most two in a row."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n{3,}", "\n\n")


def without_comments(text: Column) -> Column:
    """Escaped comments that do not nest; an unclosed one stays."""
    return F.regexp_replace(text, "(?s)&lt;!--.*?--&gt;", "")


def is_redirect(text: Column) -> Column:
    return F.contains(lower_ascii(text), F.lit("#redirect"))


def _calls(text: Column, names: tuple[str, ...]) -> Column:
    return lower_ascii(text).rlike(r"\{\{\s*(?:" + "|".join(names) + r")\s*[|}]")


def is_disambiguation(text: Column) -> Column:
    return F.coalesce(_calls(text, DISAMBIGUATION), F.lit(False))


def is_list(title: Column, text: Column) -> Column:
    return F.coalesce(title.rlike(r"\A(?:" + "|".join(LIST_TITLES) + r")\z"), F.lit(False)) | F.coalesce(_calls(text, (*LIST_TEMPLATES, r"years in [^|}]*")), F.lit(False))


def page_type(title: Column, ns: Column, text: Column) -> Column:
    """article, disambiguation, redirect, template (infoboxes) or other."""
    return (
        F.when((ns == 0) & is_redirect(text), "redirect")
        .when((ns == 0) & is_disambiguation(text), "disambiguation")
        .when(ns == 0, "article")
        .when((ns == 10) & title.startswith("Template:Infobox"), "template")
        .otherwise("other")
    )


def fixed_target(target: Column) -> Column:
    """Underscores to blanks, first letter upper, without the section; outer blanks go."""
    t = F.trim(F.translate(F.substring_index(target, "#", 1), "_", " "))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 0x7FFFFFFF))


def redirect_target(text: Column) -> Column:
    """The first link's target; the signs of the redirect word and of sections are taken out first, so sections fuse with the target."""
    inner = F.regexp_extract(F.replace(text, F.lit("#"), F.lit("")), r"\[\[([^\]|]+)", 1)
    return F.nullif(fixed_target(inner), F.lit(""))


def redirect_chains(redirects: DataFrame, hops: int = 8) -> DataFrame:
    """from_title, to_title with chains followed up to `hops` times; a circle ends where it began.

    Titles are compared as `fixed_target`; of several targets the smallest
    counts. Each hop is one equi-join on the title.
    """
    one = redirects.where("from_title IS NOT NULL AND to_title IS NOT NULL").select(fixed_target(F.col("from_title")).alias("from_title"), fixed_target(F.col("to_title")).alias("to_title"))
    one = one.where("to_title <> ''").groupBy("from_title").agg(F.min("to_title").alias("to_title"))
    step = one.select(F.col("from_title").alias("_f"), F.col("to_title").alias("_t"))
    out = one
    for _ in range(hops):
        out = out.join(step, out["to_title"] == step["_f"], "left").select("from_title", F.when(F.col("_t").isNull() | (F.col("_t") == F.col("from_title")), F.col("to_title")).otherwise(F.col("_t")).alias("to_title"))
    return out


def type_counts(pages: DataFrame) -> DataFrame:
    """One row of counters over pages with page_type and list flag."""
    count = lambda c: F.count_if(F.expr(c))
    return pages.agg(
        F.count("*").alias("pages"), count("page_type = 'article' AND NOT is_list").alias("articles"), count("is_list").alias("lists"), count("page_type = 'redirect'").alias("redirects"),
        count("page_type = 'disambiguation'").alias("disambiguations"), count("page_type = 'template'").alias("templates"), count("page_type = 'other'").alias("others"),
    )


def routed(pages: DataFrame, discard_lists: bool = True, discard_disambiguations: bool = True) -> DataFrame:
    """The pages that go into the corpus: no others, lists and disambiguation pages as asked."""
    out = pages.where("page_type <> 'other'")
    if discard_lists:
        out = out.where("NOT (page_type = 'article' AND is_list)")
    return out.where("page_type <> 'disambiguation'") if discard_disambiguations else out


def error_report(errors: DataFrame) -> DataFrame:
    """category, message, n: error rows of all partitions counted, most frequent first."""
    return errors.groupBy("category", "message").agg(F.sum("n").alias("n")).orderBy("category", F.desc("n"), "message")
