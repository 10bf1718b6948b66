"""Corpus-level tables: links, anchors, citations, the inverted word index and noun links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions.strings import lower_ascii, tokenize
from foliospark.operators.pages import fixed_target

# Fixed value: the separators of the word index (line feeds and tabs are none).
SEPARATORS = " .,;:\"?'!-()/&+=|"

_LINK = r"\[\[([^\[\]|]+)(?:\|([^\[\]|]*))?\]\]([A-Za-z]*)"
_EXTERNAL = r"\[(https?://[^\s\]]+)(?: ([^\]]*))?\]"


def _upper_first(s: Column) -> Column:
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 0x7FFFFFFF))


def simple_links(pages: DataFrame) -> DataFrame:
    """rev_id, to_title, t_section, anchor, trail of links with at most one bar, wherever they stand in `text`.

    The letters behind a link belong to its anchor. Null texts have no links.
    """
    whole = pages.select("rev_id", F.explode(F.regexp_extract_all("text", F.lit(f"({_LINK})"), F.lit(1))).alias("m"))
    parts = whole.select("rev_id", F.contains("m", F.lit("|")).alias("piped"), *(F.regexp_extract("m", _LINK, i).alias(n) for i, n in ((1, "target"), (2, "label"), (3, "trail"))))
    section = F.when(F.contains("target", F.lit("#")), F.trim(F.translate(F.expr("substring(target, instr(target, '#') + 1)"), "_", " ")))
    return parts.select("rev_id", fixed_target(F.col("target")).alias("to_title"), section.alias("t_section"), F.concat(F.when(F.col("piped"), F.col("label")).otherwise(F.col("target")), "trail").alias("anchor"), "trail")


def external_links(pages: DataFrame) -> DataFrame:
    """rev_id, target, anchor of bracketed web addresses; without a label the address is the anchor."""
    m = pages.select("rev_id", F.explode(F.regexp_extract_all("text", F.lit(f"({_EXTERNAL})"), F.lit(1))).alias("m"))
    target, label = F.regexp_extract("m", _EXTERNAL, 1), F.regexp_extract("m", _EXTERNAL, 2)
    return m.select("rev_id", target.alias("target"), F.when(label == "", target).otherwise(label).alias("anchor"))


def _title(c: str) -> Column:
    return _upper_first(F.trim(F.translate(F.col(c), "_", " ")))


def anchors(links: DataFrame) -> DataFrame:
    """to_title, anchor, n: how often each anchor (ASCII lower case) points to a title; repeated link rows count once."""
    once = links.where("to_title IS NOT NULL AND anchor IS NOT NULL").select("link_id", _title("to_title").alias("to_title"), lower_ascii(F.col("anchor")).alias("anchor")).distinct()
    return once.groupBy("to_title", "anchor").agg(F.count("*").alias("n"))


def _edges(links: DataFrame) -> DataFrame:
    return links.where("to_title IS NOT NULL AND from_id IS NOT NULL").select("from_id", _title("to_title").alias("title")).distinct()


def link_counts(pages: DataFrame, links: DataFrame) -> DataFrame:
    """id, title, n_in, n_out of every page with a title. Counts are taken before they are joined, so a title with a tenth of all links is one row."""
    e = _edges(links)
    p = pages.where("title IS NOT NULL").groupBy("id").agg(F.min(_title("title")).alias("title"))
    n_in = e.groupBy("title").agg(F.count("*").alias("n_in"))
    n_out = e.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n_out"))
    zero = F.lit(0).cast("bigint")
    return p.join(n_in, "title", "left").join(n_out, "id", "left").select("id", "title", F.coalesce("n_in", zero).alias("n_in"), F.coalesce("n_out", zero).alias("n_out"))


def citations(articles: DataFrame, links: DataFrame) -> DataFrame:
    """title, cited: from how many articles each article is linked."""
    p = articles.select("id", _title("title").alias("title")).distinct()
    inside = _edges(links).join(p.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi")
    return inside.groupBy("title").agg(F.count("*").alias("cited")).join(p.select("title").distinct(), "title", "left_semi")


def words(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, w of every word in ASCII lower case, split at SEPARATORS only."""
    return texts.select(key, F.explode(tokenize(lower_ascii(F.col(text)), SEPARATORS)).alias("w"))


def inverted_index(pairs: DataFrame, primary: str, secondary: str) -> DataFrame:
    """primary, secondary, n: the postings as rows, so that no list of a frequent key is ever one value."""
    return pairs.groupBy(primary, secondary).agg(F.count("*").alias("n"))


def noun_links(pages: DataFrame, links: DataFrame, redirects: DataFrame) -> DataFrame:
    """from_id, noun, page_id: nouns that a page may be indexed under, because it links to a page of that title, to a redirect of that title, or is that page."""
    p = pages.where("title IS NOT NULL").select(lower_ascii(_title("title")).alias("noun"), F.col("id").alias("page_id")).distinct()
    l = links.where("to_title IS NOT NULL").select("from_id", lower_ascii(_title("to_title")).alias("noun")).distinct()
    r = redirects.where("from_title IS NOT NULL AND to_title IS NOT NULL").select(lower_ascii(fixed_target(F.col("from_title"))).alias("noun"), lower_ascii(fixed_target(F.col("to_title"))).alias("target")).distinct()
    direct = l.join(p, "noun").select("from_id", "noun", "page_id")
    through = l.join(r, "noun").join(p.withColumnRenamed("noun", "target"), "target").select("from_id", "noun", "page_id")
    own = p.select(F.col("page_id").alias("from_id"), "noun", "page_id")
    return direct.unionByName(through).unionByName(own).distinct()


def noun_index(pages: DataFrame, nouns: DataFrame) -> DataFrame:
    """id, noun, page_id, n: how often a page's text names a noun that the page may be indexed under, at word boundaries.

    `nouns` is from_id, noun, page_id (see `noun_links`). A page's nouns are
    bounded by its links; they are gathered per page and looked up in its text,
    so no phrase of the text is shuffled. Null texts name nothing.
    """
    per_page = nouns.groupBy(F.col("from_id").alias("id")).agg(F.collect_set(F.struct("noun", "page_id")).alias("nouns"))
    blank = F.translate(lower_ascii(F.col("text")), SEPARATORS + "\n", " " * (len(SEPARATORS) + 1))
    padded = F.concat(F.lit(" "), F.replace(blank, F.lit(" "), F.lit("  ")), F.lit(" "))
    texts = pages.where("text IS NOT NULL AND id IS NOT NULL").select("id", padded.alias("padded"))
    at = texts.join(per_page, "id").select("id", "padded", F.inline("nouns"))
    sought = F.concat(F.lit(" "), F.replace("noun", F.lit(" "), F.lit("  ")), F.lit(" "))
    n = ((F.length("padded") - F.length(F.replace(F.col("padded"), sought, F.lit("")))) / F.length(sought)).cast("bigint")
    return at.where("noun <> ''").select("id", "noun", "page_id", n.alias("n")).where("n > 0").groupBy("id", "noun", "page_id").agg(F.max("n").alias("n"))
