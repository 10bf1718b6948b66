"""Subject areas of pages by one-versus-rest linear classifiers on hashed word n-grams.

1. Weak labels: a bounded sample of the pages that raters labelled. Counted over
   pages with one subject, words and word pairs say which subjects they speak
   for; a passage gets the one its words speak for, of the page's own subjects
   if they do, and none if no word speaks. So neutral passages train nothing.
2. One logistic classifier per subject on hashed words and word pairs of single
   passages (sentences, list lines, table rows), of those that stand on several
   labelled pages; names, which hardly come back, cannot be taken for others.
3. A passage belongs to its best subject if that is over one half. Headings and
   the line that names the title count half, as they often speak of something
   else than the text; code, formulas, references and link targets do not count.
   A page's share of a subject is the part of its subject-bearing passages that
   belong to it; the least share that counts is calibrated on labelled pages
   kept out of the training. A single passage is a mention, unless no subject
   has more.
4. All pages are classified in one Arrow pass; the model (a matrix of fixed
   size) goes to the workers.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from foliospark.functions.arrow import map_rows
from foliospark.llm.quality import _REDIRECT, _in_a_row, body_of, no_language
from foliospark.llm.residue import wholly_residue
from foliospark.wikitext.lexer import opaque_spans, unescape_once

# The ten subjects.
SUBJECTS = ("cuisine", "finance", "history", "law", "medicine", "music", "science", "software", "sport", "transport")
#: Most labelled pages to train on (those with the smallest id hash) and the most hashed features kept.
SAMPLE, DIMENSIONS = 2400, 1 << 16
ROUNDS, RATE, DECAY = 25, 0.5, 1e-6
#: One labelled page in so many is kept for calibration.
KEPT = 4
LEAST_SHARES = tuple(x / 100 for x in range(12, 42, 2))
#: Labelled pages a feature stands on at least, and the share of a subject from which it speaks for any, and for this one.
LEAST_PAGES, SPEAKS, SPEAKS_TOO = 5, 0.4, 0.2
#: What a passage, a heading or opening line, and a category or caption count. Passages that count less than MENTION together are a mention.
BODY, HALF, SLIGHT, MENTION = 1.0, 0.5, 0.01, 2.0

_WORD = re.compile(r"[^\W\d_]+")
_BREAK = re.compile(r"(?<=[.!?])\s+|\n+|<br\s*/?>|</(?:p|li|td|h\d)>|\\item|\|\|| [·•] ", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|\\[a-zA-Z]+|https?://\S+|\[\[[^\[\]|]*\|")
_HEADING = re.compile(r"^(?:={2,}.*={2,}|#{1,6} .*|<h\d.*|\\(?:sub)*section.*)\s*$", re.I)
_SETEXT = re.compile(r"^([^\s{|!].{0,80}[^.!?\n])\n(?:={3,}|-{3,})[ \t]*$", re.M)
_REFERENCE = re.compile(r"<ref\b[^<>]*/>|<ref\b.*?</ref\s*>", re.S | re.I)
_REFERENCE_END = re.compile(r"</ref\s*>", re.I)
_BOLD = re.compile(r"'''.*?'''")
_TARGET = re.compile(r"\[\[(?!\s*(?:Category|File|Image)\s*:)[^\[\]|]*\]\]", re.I)
_SLIGHT = re.compile(r"\[\[\s*(?:Category|File|Image)\s*:([^\[\]]*)\]\]", re.I)


class _Words(dict):
    """Hashed words of one worker, kept up to a fixed number."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh32_intdigest(word)
        return h


_words = _Words()


def _readable(text: str) -> str:
    """The text without code, formulas, comments and references."""
    parts, at = [], 0
    for start, end, kind in opaque_spans(text):
        if kind != "other" and start >= at:
            parts += (text[at:start], " ")
            at = end
    text = "".join((*parts, text[at:]))
    end = max((m.end() for m in _REFERENCE_END.finditer(text)), default=0)  # beyond it no reference is closed
    return _REFERENCE.sub(" ", text[:end]) + text[end:] if end else text


def passages(text: str) -> list[tuple[float, str]]:
    """(what it counts, passage) of a page's unescaped text; none for redirects and disambiguation pages."""
    if _REDIRECT.match(text):
        return []
    body, disambiguation = body_of(_readable(text))
    if disambiguation:
        return []
    out = [(SLIGHT, x) for x in _SLIGHT.findall(body)]
    body = _SETEXT.sub(r"# \1", _TARGET.sub(" ", _SLIGHT.sub(" ", body)))
    for part in _BREAK.split(body):
        part = part.strip()
        if not part or no_language(part):
            continue
        counts = HALF if part.startswith("'''") or _HEADING.match(part) else BODY
        part = _TAG.sub(" ", _BOLD.sub(" ", part))
        if part.count(",") + part.count(";") + part.count("·") >= 5 and _in_a_row(part):
            out.extend((counts, x) for x in re.split("[,;·|\t]", part) if x.strip())
        else:
            out.append((counts, part))
    return out


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs of passages as one array, and the number of the passage of each."""
    lists = [[_words[w] for w in _WORD.findall(t.lower())] for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(x) for x in lists])
    flat = np.array([h for x in lists for h in x], np.int64)
    inner = row[1:] == row[:-1]
    pairs = flat[:-1] * 31 + flat[1:] * 17 + 7
    return np.concatenate([flat, pairs[inner]]), np.concatenate([row, row[1:][inner]])


class Model:
    """Features kept (sorted hashes), their weights (features x subjects), biases and the least share that counts."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: np.ndarray, least: float):
        self.keys, self.weights, self.bias, self.least = keys, weights, bias, least
        self.slots = np.zeros(DIMENSIONS, bool)
        self.slots[keys % DIMENSIONS] = True

    def scores(self, texts: list[str]) -> np.ndarray:
        values, row = features(texts)
        at, row = _kept(self.keys, self.slots, values, row)
        return np.stack([np.bincount(row, w[at], len(texts)) for w in self.weights.T], axis=1) + self.bias

    def counts(self, pages: list[list[tuple[float, str]]]) -> np.ndarray:
        """Per page what its passages of each subject count; the best one of the whole page counts once if no passage is over one half."""
        out = np.zeros((len(pages), len(SUBJECTS)))
        texts = [t for p in pages for _, t in p]
        if not texts:
            return out
        page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        weight = np.array([w for p in pages for w, _ in p])
        scores = self.scores(texts)
        best, high = scores.argmax(axis=1), scores.max(axis=1)
        np.add.at(out, (page[high > 0], best[high > 0]), weight[high > 0])
        top = np.full(len(pages), -np.inf)
        np.maximum.at(top, page, high)
        for at in np.flatnonzero((high > self.FAINT) & (high == top[page]) & (out.sum(axis=1) == 0)[page]):
            if not out[page[at]].any():
                out[page[at], best[at]] = 1
        return out

    #: Log-odds from which a page without a clear passage still gets the subject of its best one.
    FAINT = -1.5

    def decide(self, counts: np.ndarray) -> np.ndarray:
        """Which subjects a page has, from its passage counts."""
        total = np.maximum(1, counts.sum(axis=1, keepdims=True))
        enough = (counts / total >= self.least) & (counts >= MENTION)
        first = np.zeros_like(enough)
        some = counts.any(axis=1)
        first[np.flatnonzero(some), counts[some].argmax(axis=1)] = True
        return enough | first


def _kept(keys: np.ndarray, slots: np.ndarray, values: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in `keys` of the values found there, and their passages."""
    some = slots[values % DIMENSIONS]
    values, row = values[some], row[some]
    at = np.searchsorted(keys, values)
    found = np.append(keys, -1)[at] == values
    return at[found], row[found]


def _weak_labels(at: np.ndarray, row: np.ndarray, page: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Weak labels of passages (passages x subjects) from features `at` of passages `row`, the page of each passage and the subjects `own` of each page."""
    k = len(SUBJECTS)
    single = own.sum(axis=1) == 1
    pairs = np.unique(np.stack([at, page[row]]), axis=1)
    pairs = pairs[:, single[pairs[1]]]
    votes = np.bincount(pairs[0] * k + own[pairs[1]].argmax(axis=1), minlength=n * k).reshape(n, k)
    share = votes / np.maximum(1, own[single].sum(axis=0)) * max(1, single.sum()) / k + 0.2
    share /= share.sum(axis=1, keepdims=True)
    share[(share < SPEAKS_TOO) | (share.max(axis=1, keepdims=True) <= SPEAKS)] = 0
    tally = np.stack([np.bincount(row, s[at], len(page)) for s in share.T], axis=1)
    of_page = np.where(own[page], tally, 0)
    by_page = of_page.max(axis=1) * 2 >= tally.max(axis=1)
    best = np.where(by_page, of_page.argmax(axis=1), tally.argmax(axis=1))
    labels = (np.arange(k) == best[:, None]) & tally.any(axis=1, keepdims=True)
    return labels if labels.any() else own[page]  # a handful of pages lets no word speak


def train(pages: list[tuple[str, set[int]]]) -> Model:
    """One logistic classifier per subject by full-batch gradient steps of adaptive size, then the calibrated share; (unescaped text, subjects) in. Without labels nothing is found."""
    k = len(SUBJECTS)
    none = Model(np.zeros(0, np.int64), np.zeros((0, k)), np.full(k, -9.0), 0.3)
    if not pages:
        return none
    cut = [passages(x) for x, _ in pages]
    truth = np.array([[j in s for j in range(k)] for _, s in pages])
    chosen = [i for i in range(len(pages)) if i % KEPT] or list(range(len(pages)))
    texts = [t for i in chosen for _, t in cut[i]]
    if not texts:
        return none
    page = np.repeat(np.arange(len(chosen)), [len(cut[i]) for i in chosen])
    values, row = features(texts)
    each, on = np.unique(np.unique(np.stack([values, page[row]]), axis=1)[0], return_counts=True)
    often = np.flatnonzero(on >= min(LEAST_PAGES, 2 + len(chosen) // 100))
    keys = np.sort(each[often[np.argsort(-on[often], kind="stable")[:DIMENSIONS]]])
    model = Model(keys, np.zeros((len(keys), k)), np.full(k, -2.0), 0.25)
    at, row = _kept(keys, model.slots, values, row)
    labels = _weak_labels(at, row, page, truth[chosen], len(keys))
    for j in range(k):
        weights, bias = np.zeros(len(keys)), -2.0
        seen, seen_bias = np.full(len(keys), 1e-8), 1e-8
        for _ in range(ROUNDS):
            margin = np.clip(np.bincount(row, weights[at], len(texts)) + bias, -30, 30)
            error = (1 / (1 + np.exp(-margin)) - labels[:, j]) / 100
            gradient = np.bincount(at, error[row], len(keys)) + DECAY * weights
            seen += gradient**2
            weights -= RATE * gradient / np.sqrt(seen)
            step = error.sum()
            seen_bias += step**2
            bias -= RATE * step / np.sqrt(seen_bias)
        model.weights[:, j], model.bias[j] = weights, bias
    counts, right = model.counts(cut[::KEPT]), truth[::KEPT]
    scores = []
    for model.least in LEAST_SHARES:
        got = model.decide(counts)
        scores.append((got & right).sum() / max(1, got.sum() + right.sum()))
    model.least = LEAST_SHARES[int(np.argmax(scores))]
    return model


def labelled_sample(pages: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[tuple[str, set[int]]]:
    """At most `most` labelled article pages: unescaped text and subjects. Spelling of subjects is evened out, unknown and null ones are left out."""
    clean = labels.select("id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(*SUBJECTS))
    chosen = clean.groupBy("id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = pages.where("ns = 0 AND length(text) > 0").select("id", "text", "rev_id")
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.max_by(F.struct("text", "subjects"), F.struct("rev_id", "text")).alias("r")).orderBy("id").collect()
    number = {s: i for i, s in enumerate(SUBJECTS)}
    return [(unescape_once(r["r"]["text"]), {number[s] for s in r["r"]["subjects"]}) for r in rows]


def page_subjects(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """id, subject of every article page (ns = 0) and each subject that a fair part of its latest revision treats.

    `pages` needs id, ns, text, rev_id, rev_ts; `labels` id and subject.
    Redirects, disambiguation pages, null and empty texts, pages that are wholly
    residue and texts without any subject-bearing passage have none; a page with several revisions counts by
    the latest (rev_ts, then rev_id; a null rev_ts comes first); null ids give
    no row; other columns are ignored. Only short rows are shuffled.
    """
    model = train(labelled_sample(pages, labels))

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [unescape_once(t) if t else "" for t in b.column("text").to_pylist()]
        counts = model.counts([passages(t) for t in texts])
        total = counts.sum(axis=1)
        for i in np.flatnonzero((total > 0) & (total <= 2 * MENTION)):  # residue hardly speaks of a subject
            if wholly_residue(texts[i]):
                counts[i] = 0
        found = [[SUBJECTS[i] for i in np.flatnonzero(r)] for r in model.decide(counts)]
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("rev_ts"), b.column("rev_id"), pa.array(found, pa.list_(pa.string()))], ["id", "rev_ts", "rev_id", "subjects"])

    articles = pages.where("ns = 0 AND id IS NOT NULL").select("id", F.unix_micros(F.col("rev_ts").cast("timestamp")).alias("rev_ts"), "rev_id", "text")
    each = map_rows(articles, batch, "id BIGINT, rev_ts BIGINT, rev_id BIGINT, subjects ARRAY<STRING>")
    latest = each.groupBy("id").agg(F.max(F.struct("rev_ts", "rev_id", "subjects")).alias("r"))
    return latest.select("id", F.explode("r.subjects").alias("subject"))
