"""Queries of page records, links and indexes with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import strings as S
from foliospark.operators import corpus, dictionary, pages as P
from foliospark.plans.registry import ORACLES, columns, query
from foliospark.sources import dumps
from foliospark.sources.tables import table

UP, LOW = S.UPPER, S.LOWER


def T():
    return F.col("title")


def X():
    return F.col("text")


def N():
    return F.col("ns")


_RAW_SQL = "'<page>' || chr(10) || '<title>' || coalesce(title, '') || '</title><ns>' || coalesce(ns::VARCHAR, '') || '</ns><revision><text xml:space=\"preserve\">' || coalesce(text, '') || '</text></revision></page>'"


def _raw(df):
    return df.withColumn("raw", F.concat(F.lit("<page>\n<title>"), F.coalesce(T(), F.lit("")), F.lit("</title><ns>"), F.coalesce(N().cast("string"), F.lit("")), F.lit('</ns><revision><text xml:space="preserve">'), F.coalesce(X(), F.lit("")), F.lit("</text></revision></page>")))


_L = f"translate(text, '{UP}', '{LOW}')"
_DIS = "(" + "|".join(P.DISAMBIGUATION) + ")"
_LIST = "(" + "|".join((*P.LIST_TEMPLATES, "years in [^|}]*")) + ")"
_REDIRECT = f"contains({_L}, '#redirect')"
_IS_DIS = f"coalesce(regexp_matches({_L}, '\\{{\\{{\\s*{_DIS}\\s*[|}}]'), FALSE)"
_IS_LIST = "(coalesce(regexp_full_match(title, '(" + "|".join(P.LIST_TITLES) + f")'), FALSE) OR coalesce(regexp_matches({_L}, '\\{{\\{{\\s*{_LIST}\\s*[|}}]'), FALSE))"
_TYPE = f"CASE WHEN ns = 0 AND {_REDIRECT} THEN 'redirect' WHEN ns = 0 AND {_IS_DIS} THEN 'disambiguation' WHEN ns = 0 THEN 'article' WHEN ns = 10 AND starts_with(title, 'Template:Infobox') THEN 'template' ELSE 'other' END"
_FIX = "upper(left({0}, 1)) || substr({0}, 2)".format
_TARGET = "trim(replace(regexp_extract(replace(text, '#', ''), '\\[\\[([^\\]|]+)', 1), '_', ' '), ' ')"

columns("page_records", "dump_pages", ["rev_id"], {
    "t": (lambda: P.title(F.col("raw")), "coalesce(title, '')"), "n": (lambda: P.namespace(F.col("raw")), "coalesce(ns, -10)"), "x": (lambda: P.body(F.col("raw")), "chr(10) || coalesce(text, '')"),
}, base=_raw)
columns("namespace_extract", "dump_pages", ["rev_id"], {"n": (lambda: P.namespace(F.col("raw")), "coalesce(ns, -10)")}, base=_raw)
columns("page_classify", "dump_pages", ["rev_id"], {"page_type": (lambda: P.page_type(T(), N(), X()), _TYPE)})
columns("disambig_flag", "dump_pages", ["rev_id"], {"flag": (lambda: P.is_disambiguation(X()), _IS_DIS)})
columns("listpage_titles", "dump_pages", ["rev_id"], {"flag": (lambda: P.is_list(T(), X()), _IS_LIST)})
columns("crlf_normalise", "dump_pages", ["rev_id"], {"x": (lambda: P.line_feeds(X()), "regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")})
columns("presubstitute", "dump_pages", ["rev_id"], {"x": (lambda: P.substituted(X()), "replace(replace(replace(replace(text, '&amp;nbsp;', ' '), '&amp;', '&'), '__NOTOC__', ''), '__TOC__', '')")})
columns("comment_strip", "dump_pages", ["rev_id"], {"x": (lambda: P.without_comments(X()), "regexp_replace(text, '&lt;!--(.|\\n)*?--&gt;', '', 'g')")})
columns("redirect_resolve", "dump_pages", ["rev_id", "title"], {"target": (lambda: P.redirect_target(X()), f"nullif({_FIX(_TARGET)}, '')")}, where="ns = 0 AND text IS NOT NULL", base=lambda df: df.where(P.is_redirect(X())), base_sql=f"(SELECT * FROM dump_pages WHERE {_REDIRECT})")


@query("page_split", f"SELECT rev_id, {_RAW_SQL} AS raw FROM dump_pages UNION ALL SELECT rev_id, {_RAW_SQL} FROM dump_pages")
def page_split(spark, d):
    """Two pages in one text, with other text around them, come apart again."""
    both = F.concat(F.lit("<mediawiki>"), "raw", F.lit("\n"), "raw", F.lit("</mediawiki>"))
    return _raw(table(spark, d, "dump_pages")).select("rev_id", F.explode(dumps.split_pages(both)).alias("raw"))


def _typed(spark, d):
    return table(spark, d, "dump_pages").withColumn("page_type", P.page_type(T(), N(), X())).withColumn("is_list", P.is_list(T(), X()))


_TYPED = f"(SELECT *, {_TYPE} AS page_type, {_IS_LIST} AS is_list FROM dump_pages)"


@query("type_counts", f"SELECT count(*) AS pages, count(*) FILTER (page_type = 'article' AND NOT is_list) AS articles, count(*) FILTER (is_list) AS lists, count(*) FILTER (page_type = 'redirect') AS redirects, count(*) FILTER (page_type = 'disambiguation') AS disambiguations, count(*) FILTER (page_type = 'template') AS templates, count(*) FILTER (page_type = 'other') AS others FROM {_TYPED}")
def type_counts(spark, d):
    return P.type_counts(_typed(spark, d))


@query("page_route", f"SELECT rev_id, page_type FROM {_TYPED} WHERE page_type NOT IN ('other', 'disambiguation') AND NOT (page_type = 'article' AND is_list)")
def page_route(spark, d):
    return P.routed(_typed(spark, d)).select("rev_id", "page_type")


@query("title_list", f"SELECT DISTINCT title FROM {_TYPED} WHERE page_type IN ('article', 'disambiguation') AND title IS NOT NULL")
def title_list(spark, d):
    return _typed(spark, d).where("page_type IN ('article', 'disambiguation') AND title IS NOT NULL").select("title").distinct()


@query("redirect_list", f"SELECT DISTINCT title || chr(9) || chr(9) || '-->' || chr(9) || chr(9) || {_FIX(_TARGET)} AS line FROM {_TYPED} WHERE page_type = 'redirect' AND title IS NOT NULL AND {_TARGET} <> ''")
def redirect_list(spark, d):
    r = _typed(spark, d).where("page_type = 'redirect' AND title IS NOT NULL").select("title", P.redirect_target(X()).alias("to"))
    return r.where("to IS NOT NULL").select(F.concat("title", F.lit("\t\t-->\t\t"), "to").alias("line")).distinct()


@query("page_limit", "SELECT title, rev_id FROM (SELECT DISTINCT title, rev_id FROM dump_pages) ORDER BY rev_id LIMIT 100")
def page_limit(spark, d):
    """A test run of exactly 100 pages; the limit is the operator."""
    return dumps.limited(table(spark, d, "dump_pages").select("title", "rev_id").distinct(), "rev_id", 100)


@query("error_report", f"SELECT coalesce(model, 'none') AS category, page_type AS message, count(*) AS n FROM {_TYPED} GROUP BY 1, 2")
def error_report(spark, d):
    e = _typed(spark, d).select(F.coalesce("model", F.lit("none")).alias("category"), F.col("page_type").alias("message"), F.lit(1).cast("bigint").alias("n"))
    return P.error_report(e)


_NORM = "upper(left(trim(replace(split_part({0}, '#', 1), '_', ' '), ' '), 1)) || substr(trim(replace(split_part({0}, '#', 1), '_', ' '), ' '), 2)".format


@query(
    "redirect_chains",
    f"""WITH RECURSIVE one AS (SELECT f, min(t) AS t FROM (SELECT {_NORM('from_title')} AS f, {_NORM('to_title')} AS t FROM page_redirects WHERE from_title IS NOT NULL AND to_title IS NOT NULL) WHERE t <> '' GROUP BY f),
 hop(f, t, n) AS (SELECT f, t, 0 FROM one UNION ALL SELECT hop.f, CASE WHEN one.t IS NULL OR one.t = hop.f THEN hop.t ELSE one.t END, n + 1 FROM hop LEFT JOIN one ON hop.t = one.f WHERE n < 8)
 SELECT f AS from_title, t AS to_title FROM hop WHERE n = 8""",
)
def redirect_chains(spark, d):
    return P.redirect_chains(table(spark, d, "page_redirects"))


# ---------------------------------------------------------- links

_LINK = r"\[\[([^\[\]|]+)(?:\|([^\[\]|]*))?\]\]([A-Za-z]*)"


def _links(spark, d):
    return corpus.simple_links(table(spark, d, "dump_pages").select("rev_id", "text").distinct())


_LINK_SQL = f"(SELECT rev_id, regexp_extract(m, '{_LINK}', 1) AS target, m AS whole, regexp_extract(m, '{_LINK}', 2) AS label, regexp_extract(m, '{_LINK}', 3) AS trail, contains(m, '|') AS piped FROM (SELECT rev_id, unnest(regexp_extract_all(text, '{_LINK}')) AS m FROM (SELECT DISTINCT rev_id, text FROM dump_pages)))"
_LT = "trim(replace(split_part(target, '#', 1), '_', ' '), ' ')"


@query("link_extract", f"SELECT rev_id, upper(left({_LT}, 1)) || substr({_LT}, 2) AS to_title, count(*) AS n FROM {_LINK_SQL} GROUP BY 1, 2")
def link_extract(spark, d):
    return _links(spark, d).groupBy("rev_id", "to_title").agg(F.count("*").alias("n"))


@query("link_trail", f"SELECT rev_id, (CASE WHEN piped THEN label ELSE target END) || trail AS anchor, trail FROM {_LINK_SQL} WHERE trail <> ''")
def link_trail(spark, d):
    return _links(spark, d).where("trail <> ''").select("rev_id", "anchor", "trail")


@query("link_target_section", f"SELECT rev_id, upper(left({_LT}, 1)) || substr({_LT}, 2) AS to_title, trim(replace(substr(target, strpos(target, '#') + 1), '_', ' '), ' ') AS t_section FROM {_LINK_SQL} WHERE contains(target, '#')")
def link_target_section(spark, d):
    return _links(spark, d).where("t_section IS NOT NULL").select("rev_id", "to_title", "t_section")


_EXT = r"\[(https?://[^\s\]]+)(?: ([^\]]*))?\]"


@query("external_links", f"SELECT rev_id, regexp_extract(m, '{_EXT}', 1) AS target, CASE WHEN regexp_extract(m, '{_EXT}', 2) = '' THEN regexp_extract(m, '{_EXT}', 1) ELSE regexp_extract(m, '{_EXT}', 2) END AS anchor FROM (SELECT rev_id, unnest(regexp_extract_all(text, '{_EXT}')) AS m FROM dump_pages)")
def external_links(spark, d):
    return corpus.external_links(table(spark, d, "dump_pages"))


_PL = "upper(left(trim(replace(to_title, '_', ' '), ' '), 1)) || substr(trim(replace(to_title, '_', ' '), ' '), 2)"
_PT = "upper(left(trim(replace(title, '_', ' '), ' '), 1)) || substr(trim(replace(title, '_', ' '), ' '), 2)"


@query("anchor_stats", f"SELECT {_PL} AS to_title, translate(anchor, '{UP}', '{LOW}') AS anchor, count(DISTINCT link_id) AS n FROM page_links WHERE to_title IS NOT NULL AND anchor IS NOT NULL GROUP BY 1, 2")
def anchor_stats(spark, d):
    return corpus.anchors(table(spark, d, "page_links"))


@query("inlinks_outlinks", f"WITH e AS (SELECT DISTINCT from_id, {_PL} AS t FROM page_links WHERE to_title IS NOT NULL AND from_id IS NOT NULL), i AS (SELECT t, count(*) AS n_in FROM e GROUP BY t), p AS (SELECT id, min({_PT}) AS t FROM dump_pages WHERE title IS NOT NULL GROUP BY id), o AS (SELECT from_id, count(*) AS n_out FROM e GROUP BY 1) SELECT p.id, p.t AS title, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out FROM p LEFT JOIN i USING (t) LEFT JOIN o ON o.from_id = p.id")
def inlinks_outlinks(spark, d):
    return corpus.link_counts(table(spark, d, "dump_pages"), table(spark, d, "page_links"))


@query("citation_counts", f"WITH p AS (SELECT DISTINCT id, {_PT} AS t FROM {_TYPED} WHERE page_type = 'article' AND title IS NOT NULL) SELECT t.t AS title, count(DISTINCT e.from_id) AS cited FROM (SELECT DISTINCT t FROM p) t JOIN (SELECT DISTINCT from_id, {_PL} AS t FROM page_links WHERE to_title IS NOT NULL) e USING (t) WHERE e.from_id IN (SELECT id FROM p) GROUP BY 1")
def citation_counts(spark, d):
    typed = _typed(spark, d).where("page_type = 'article' AND title IS NOT NULL")
    return corpus.citations(typed, table(spark, d, "page_links"))


# ---------------------------------------------------------- dictionaries and the word index

_SEP = corpus.SEPARATORS
_SPLIT = "[" + "".join("\\" + c if c in "-[]\\^|" else c for c in _SEP).replace("'", "''") + "]"
_WORDS_SQL = f"(SELECT doc_id, lower(w) AS w FROM (SELECT doc_id, unnest(string_split_regex(translate(text, '{UP}', '{LOW}'), '{_SPLIT}')) AS w FROM documents) WHERE w <> '')"
_WORDS_SQL = f"(SELECT doc_id, w FROM (SELECT doc_id, unnest(string_split_regex(translate(text, '{UP}', '{LOW}'), '{_SPLIT}')) AS w FROM documents) WHERE w <> '')"
_STOP = "('the', 'of', 'and', 'in', 'a', 'to', 'is')"


def _words(spark, d):
    return corpus.words(table(spark, d, "documents"), "doc_id", "text")


def _stop(spark):
    return spark.createDataFrame([(w,) for w in ("the", "of", "and", "in", "a", "to", "is")], "w STRING")


@query("word_index", f"SELECT w, doc_id, count(*) AS n FROM {_WORDS_SQL} WHERE w NOT IN {_STOP} GROUP BY 1, 2")
def word_index(spark, d):
    return corpus.inverted_index(dictionary.without(_words(spark, d), _stop(spark), "w"), "w", "doc_id")


@query("word_index_postings", f"SELECT w, count(*) AS n_docs, sum(n) AS n_words, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM (SELECT w, doc_id, count(*) AS n FROM {_WORDS_SQL} GROUP BY 1, 2) GROUP BY 1")
def word_index_postings(spark, d):
    index = corpus.inverted_index(_words(spark, d), "w", "doc_id")
    return index.groupBy("w").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_words"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@query("stopword_antijoin", f"SELECT w, count(*) AS freq FROM {_WORDS_SQL} WHERE w NOT IN {_STOP} GROUP BY 1")
def stopword_antijoin(spark, d):
    return dictionary.without(dictionary.frequencies(_words(spark, d), "w"), _stop(spark), "w")


@query("stopword_semijoin", f"SELECT w, count(*) AS freq FROM {_WORDS_SQL} WHERE w IN {_STOP} GROUP BY 1")
def stopword_semijoin(spark, d):
    return dictionary.only(dictionary.frequencies(_words(spark, d), "w"), _stop(spark), "w")


@query("freq_map_merge", "SELECT k, sum(freq) AS freq FROM (SELECT l_returnflag AS k, count(*) AS freq FROM lineitem GROUP BY 1 UNION ALL SELECT l_linestatus, count(*) FROM lineitem GROUP BY 1) GROUP BY 1")
def freq_map_merge(spark, d):
    l = table(spark, d, "lineitem")
    a, b = (dictionary.frequencies(l.select(F.col(c).alias("k")), "k") for c in ("l_returnflag", "l_linestatus"))
    return dictionary.merged(a, b, "k")


@query("dense_word_ids", "SELECT p_type AS k, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS id FROM part GROUP BY 1")
def dense_word_ids(spark, d):
    return dictionary.first_seen_ids(table(spark, d, "part").select(F.col("p_type").alias("k"), "p_partkey"), "k", "p_partkey")


@query("dictionary_lookup", "WITH i AS (SELECT p_type AS k, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS id FROM part WHERE p_size < 10 GROUP BY 1) SELECT p_partkey, p_type AS k, coalesce(id, -1) AS id FROM part LEFT JOIN i ON p_type = k")
def dictionary_lookup(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("k"), "p_size")
    return dictionary.lookup(p.select("p_partkey", "k"), dictionary.first_seen_ids(p.where("p_size < 10"), "k", "p_partkey"), "k")


@query("token_topk", f"SELECT w, count(*) AS freq FROM {_WORDS_SQL} GROUP BY 1 ORDER BY freq DESC, w LIMIT 50")
def token_topk(spark, d):
    """The 50 most frequent words; the limit is the operator."""
    return dictionary.frequencies(_words(spark, d), "w").orderBy(F.desc("freq"), "w").limit(50)


@query("noun_link", f"WITH p AS (SELECT DISTINCT translate({_PT}, '{UP}', '{LOW}') AS noun, id FROM dump_pages WHERE title IS NOT NULL), l AS (SELECT DISTINCT from_id, translate({_PL}, '{UP}', '{LOW}') AS noun FROM page_links WHERE to_title IS NOT NULL), r AS (SELECT DISTINCT translate({_NORM('from_title')}, '{UP}', '{LOW}') AS noun, translate({_NORM('to_title')}, '{UP}', '{LOW}') AS target FROM page_redirects WHERE from_title IS NOT NULL AND to_title IS NOT NULL) SELECT DISTINCT l.from_id, l.noun, p.id AS page_id FROM l JOIN p USING (noun) UNION SELECT l.from_id, l.noun, p.id FROM l JOIN r ON l.noun = r.noun JOIN p ON p.noun = r.target UNION SELECT DISTINCT id, noun, id FROM p")
def noun_link(spark, d):
    return corpus.noun_links(table(spark, d, "dump_pages"), table(spark, d, "page_links"), table(spark, d, "page_redirects"))


_NOUNS = ORACLES["noun_link"]
_SEP_SQL = (_SEP + "\n").replace("'", "''")
_PADDED = f"' ' || replace(translate(translate(text, '{UP}', '{LOW}'), '{_SEP_SQL}', '{' ' * (len(_SEP) + 1)}'), ' ', '  ') || ' '"
_SOUGHT = "' ' || replace(noun, ' ', '  ') || ' '"


@query("noun_index", f"SELECT id, noun, page_id, max(n) AS n FROM (SELECT p.id, noun, page_id, (length(padded) - length(replace(padded, {_SOUGHT}, ''))) // length({_SOUGHT}) AS n FROM (SELECT id, {_PADDED} AS padded FROM dump_pages WHERE text IS NOT NULL) p JOIN ({_NOUNS}) k ON k.from_id = p.id WHERE noun <> '') WHERE n > 0 GROUP BY 1, 2, 3")
def noun_index(spark, d):
    pages = table(spark, d, "dump_pages")
    return corpus.noun_index(pages, corpus.noun_links(pages, table(spark, d, "page_links"), table(spark, d, "page_redirects")))


@query("page_fetch", "SELECT rev_id, title, text FROM dump_pages WHERE rev_id = (SELECT min(rev_id) FROM dump_pages)")
def page_fetch(spark, d):
    """Access to one page: the key reaches the scan."""
    p = table(spark, d, "dump_pages")
    return p.where(F.col("rev_id") == p.agg(F.min("rev_id")).head()[0]).select("rev_id", "title", "text")
