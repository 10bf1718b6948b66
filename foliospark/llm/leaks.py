"""Held-out test items inside documents by a distributed positional inverted index.

1. Index: every Arrow batch of documents becomes one segment, an inverted index
   in itself: term -> postings (document, position), for the terms of the
   query vocabulary. Segments are written to the shared folder; documents are
   read and tokenised once and never shuffled.
2. Term frequencies over the whole index come from the postings' lengths.
3. Queries: the items are a table of fixed size and go to every segment. Any
   RUN consecutive words of an item hold its rarest term there, so postings of
   those terms, shifted back by their offset in the item, give all candidate
   diagonals; the offset-adjusted lists of the other terms are intersected with
   them, and a phrase match is RUN offsets in a row. Proximity matches count
   the distinct item terms within a window, whatever their order.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from foliospark.functions.arrow import spread
from foliospark.functions.stage import written

RUN = 12
#: Proximity: so many distinct words of the item within so many words of the document.
NEAR_TERMS, NEAR_SPAN = 10, 20
_WORD = re.compile(r"[^\W_]+")
_DROPPED = ("Mn", "Me", "Cf")


def words(text: str | None) -> list[str]:
    """Runs of letters or digits without case, accents and invisible characters."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
        if not text.isascii():
            text = "".join(c for c in text if c.isascii() or unicodedata.category(c) not in _DROPPED)
    return _WORD.findall(text.lower())


def index_segments(documents: DataFrame, vocabulary: dict[str, int] | None) -> DataFrame:
    """segment, docs, terms, starts, doc_at, pos: an inverted index per batch of documents, written to the shared folder.

    `vocabulary` numbers the terms to index. Term terms[i] has the postings
    starts[i]..starts[i+1]: doc_at (place in docs) and pos, ascending. Null and
    empty texts have no postings; null doc_ids are kept as keys.
    """

    def build(batches):
        task = TaskContext.get()
        at = (task.partitionId() if task else 0) << 32
        for b in batches:
            number = vocabulary.get
            docs = b.column("doc_id").to_pylist()
            found = [np.array([number(w, -1) for w in words(t)], np.int32) for t in b.column("text").to_pylist()]
            lens = np.array([len(x) for x in found])
            term = np.concatenate(found) if found else np.zeros(0, np.int32)
            doc_at = np.repeat(np.arange(len(docs), dtype=np.int32), lens)
            pos = (np.arange(len(term)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
            keep = np.flatnonzero(term >= 0)
            order = keep[np.argsort(term[keep], kind="stable")]
            terms, starts = np.unique(term[order], return_index=True)
            lists = (terms.astype(np.int32), np.append(starts, len(order)).astype(np.int32), doc_at[order], pos[order])
            yield pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int64()), pa.array([docs], pa.list_(pa.int64())), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in lists)],
                ["segment", "docs", "terms", "starts", "doc_at", "pos"],
            )
            at += 1

    schema = "segment BIGINT, docs ARRAY<BIGINT>, terms ARRAY<INT>, starts ARRAY<INT>, doc_at ARRAY<INT>, pos ARRAY<INT>"
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(spread(texts).mapInArrow(build, schema), "postings")


def term_frequencies(segments: DataFrame) -> DataFrame:
    """term, n: postings of each indexed term over all segments; at most one row per query term."""
    each = segments.select(F.explode(F.expr("transform(terms, (t, i) -> struct(t AS term, starts[i + 1] - starts[i] AS n))")).alias("x"))
    return each.groupBy("x.term").agg(F.sum("x.n").alias("n"))


class _Queries:
    """The distinct item texts as term numbers, with the anchors of every RUN-word stretch."""

    def __init__(self, rows):
        self.vocabulary: dict[str, int] = {}
        by_text: dict[tuple[int, ...], list[int]] = {}
        for item, text in rows:
            terms = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text))
            if terms:
                by_text.setdefault(terms, []).append(item)
        self.items = list(by_text.values())
        self.terms = [np.array(t, np.int32) for t in by_text]

    def anchors(self, frequency: dict[int, int], run: int) -> list[list[int]]:
        """Per item, offsets of the rarest term of each stretch of `run` words."""
        out = []
        for terms in self.terms:
            rank = [(frequency.get(int(t), 0), i) for i, t in enumerate(terms)]
            out.append(sorted({min(rank[i : i + run])[1] for i in range(len(terms) - run + 1)}))
        return out


class _Segment:
    """Postings of one segment as sorted keys document * SPREAD + position."""

    SPREAD = 1 << 32

    def __init__(self, row):
        self.docs, self.terms, self.starts = row["docs"], row["terms"], row["starts"]
        self.keys = row["doc_at"].astype(np.int64) * self.SPREAD + row["pos"]
        self.place = {int(t): i for i, t in enumerate(self.terms)}

    def list(self, term: int) -> np.ndarray:
        i = self.place.get(int(term))
        return self.keys[self.starts[i] : self.starts[i + 1]] if i is not None else self.keys[:0]


def _holds(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return keys[at] == wanted


def _phrase(seg: _Segment, terms: np.ndarray, anchors: list[int], run: int) -> set[int]:
    """Places in docs that hold `run` consecutive words of an item."""
    shifted = [seg.list(terms[o]) - o for o in anchors]
    starts = np.unique(np.concatenate(shifted)) if shifted else np.zeros(0, np.int64)
    if not len(starts):
        return set()
    row = np.zeros(len(starts), np.int32)
    best = row.copy()
    for o, t in enumerate(terms):
        row = np.where(_holds(seg.list(t), starts + o), row + 1, 0)
        best = np.maximum(best, row)
    hit = starts[best >= run]
    return set(((hit + len(terms) + seg.SPREAD // 2) // seg.SPREAD).tolist()) if len(hit) else set()


def _near(seg: _Segment, terms: np.ndarray, least: int, span: int) -> set[int]:
    """Places in docs with `least` distinct terms of an item within `span` words."""
    distinct = np.unique(terms)
    lists = [seg.list(t) for t in distinct]
    keys = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    if len(keys) < least:
        return set()
    which = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.argsort(keys, kind="stable")
    keys, which = keys[order], which[order]
    # a window that starts at a posting and holds too few postings at all cannot hold enough distinct ones
    reach = np.searchsorted(keys, keys + span)
    return {int(keys[i] // seg.SPREAD) for i in np.flatnonzero(reach - np.arange(len(keys)) >= least) if len(np.unique(which[i : reach[i]])) >= least}


def _search(documents: DataFrame, items: DataFrame, find) -> DataFrame:
    queries = _Queries([(r.item_id, r.text) for r in items.select("item_id", "text").collect()])
    segments = index_segments(documents, queries.vocabulary)
    frequency = {r.term: r.n for r in term_frequencies(segments).collect()}
    anchors = queries.anchors(frequency, RUN)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].values.to_numpy() for n in ("terms", "starts", "doc_at", "pos")}
                row["docs"] = b.column("docs")[r].as_py()
                seg = _Segment(row)
                docs, found = [], []
                for ids, terms, at in zip(queries.items, queries.terms, anchors):
                    for d in find(seg, terms, at):
                        docs += [seg.docs[d]] * len(ids)
                        found += ids
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

    return segments.select("docs", "terms", "starts", "doc_at", "pos").mapInArrow(run, "doc_id BIGINT, item_id BIGINT")


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id of every document that holds RUN consecutive words of an item, once each.

    `items` (item_id, text) is a table of fixed size: its words are the query
    vocabulary. Items under RUN words, null and empty texts match nothing; an
    item filed twice gives two rows. doc_id is unique; repeated document rows
    give repeated rows. Other columns are ignored. No shuffle but of term
    frequencies.
    """
    return _search(documents, items, lambda seg, terms, at: _phrase(seg, terms, at, RUN))


def near_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id with NEAR_TERMS distinct words of the item within NEAR_SPAN words, in any order; defined as in `leaked_items`."""
    return _search(documents, items, lambda seg, terms, at: _near(seg, terms, NEAR_TERMS, NEAR_SPAN))
