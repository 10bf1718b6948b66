"""Near-duplicate revisions by Golay-code fuzzy hashing.

1. Fingerprint: SEGMENTS segments. A segment has 23 one-bit minhashes of the
   set of three-word sequences and one whole minhash, its anchor.
2. Keys: the 23 bits are a word near the perfect (23, 12) Golay code. All
   codewords within distance 4 (5.3 on average, the nearest one first) give
   their 12-bit index; index, segment number and anchor make one key each. Two
   words that differ in up to 3 bits mostly share an index.
3. Pigeonhole: E differing bits over all segments leave a segment with at most
   E / SEGMENTS; at similarity 0.7 a segment differs in 3.45 bits on average,
   shares an index with probability 0.62 and its anchor with 0.7, so a pair
   meets in one of 8 segments with probability 0.99 (and 0.9997 at 0.8).
4. Pairs that share a key are compared on 64 of their bits at once, then on all
   184, and those that these do not rule out are verified on the exact sets.

A Golay index alone would put a 4,096th of the corpus under one key, whatever
its size; the anchor keeps a key's group small. Exact copies (equal sets) are
one class from the start; only classes are compared.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from foliospark.functions.arrow import map_rows
from foliospark.functions.stage import checkpointed, written
from foliospark.wikitext.lexer import unescape_once

LEAST_WORDS, SHINGLE = 50, 3
#: Similarity as a fraction of whole numbers: common * OF >= PART * united.
PART, OF = 7, 10
SEGMENTS, BITS = 8, 23
#: Bits that may differ, of the first 64 and of all: at similarity 0.7 on average 9.6 and 27.6, standard deviations 2.9 and 4.8.
CHECK_APART, ALL_APART = 23, 52
#: Fixed value: generator polynomial of the Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101

_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """Word hashes of one worker, kept up to a fixed number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def shingle_set(text: str | None) -> np.ndarray | None:
    """Sorted distinct 64-bit hashes of the three-word sequences of escaped text; None under LEAST_WORDS words."""
    if not text:
        return None
    words = _WORD.findall(unescape_once(text).lower())
    if len(words) < LEAST_WORDS:
        return None
    h = np.array([_hashes[w] for w in words], np.uint64)
    x = h[:-2] * _M1 + np.roll(h, -1)[:-2] * _M2 + np.roll(h, -2)[:-2] * _M3
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return np.unique(x)


def _class(shingles: np.ndarray) -> int:
    """The id of all texts with this set."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)


# ---------------------------------------------------------------- Golay code


def _syndromes(words: np.ndarray) -> np.ndarray:
    """The 11-bit remainders of 23-bit words by the generator."""
    rest = words.copy()
    for bit in range(BITS - 1, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


class _Golay:
    """Decoding by table: each of the 2,048 remainders belongs to one error pattern of at most 3 bits."""

    def __init__(self):
        patterns = np.array([sum(1 << i for i in c) for k in range(4) for c in combinations(range(BITS), k)], np.int64)
        self.error = np.zeros(2048, np.int64)
        self.error[_syndromes(patterns)] = patterns
        self.flips = np.array([0, *(1 << i for i in range(BITS))], np.int64)
        self.flip_syndromes = _syndromes(self.flips)
        self.weight = np.array([int(x).bit_count() for x in range(4096)], np.int8)

    def near(self, words: np.ndarray) -> np.ndarray:
        """Per word the 12-bit indices of all codewords within distance 4, -1 in unused places."""
        s = _syndromes(words)[:, None] ^ self.flip_syndromes
        pattern = self.flips ^ self.error[s]
        distance = self.weight[pattern & 4095] + self.weight[pattern >> 12]
        index = np.where(distance <= 4, (words[:, None] ^ pattern) >> 11, -1)
        index.sort(axis=1)
        index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
        return index


_golay: _Golay | None = None
_seeds = np.random.default_rng(20231).integers(0, 1 << 32, (2, SEGMENTS * (BITS + 1)), np.uint32)
_seeds[1] |= np.uint32(1)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """One 32-bit minimum per hash function; memory is bounded for sets of any size."""
    h = (shingles >> np.uint64(32)).astype(np.uint32)
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    h ^= low * np.uint32(2654435761)
    best = np.full(_seeds.shape[1], 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 2048):
        np.minimum(best, ((h[at : at + 2048, None] ^ _seeds[0]) * _seeds[1]).min(axis=0), out=best)
    return best


def _fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, list[list[int]]]:
    """Check bits and keys of each set."""
    global _golay
    _golay = _golay or _Golay()
    low = np.array([minhashes(s) for s in sets])
    bits = (low[:, SEGMENTS:] & 1).astype(np.int64).reshape(len(sets), SEGMENTS, BITS)
    words = (bits << np.arange(BITS)).sum(axis=2)
    flat = np.zeros((len(sets), 192), np.uint64)
    flat[:, : SEGMENTS * BITS] = bits.reshape(len(sets), -1)
    check = (flat.reshape(len(sets), 3, 64) << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).view(np.int64)
    index = _golay.near(words.reshape(-1)).reshape(len(sets), SEGMENTS, -1)
    anchors = low[:, :SEGMENTS].astype(np.int64)
    keys = anchors[:, :, None] << 16 | np.arange(SEGMENTS)[:, None] << 12 | index
    return check, [k[i >= 0].tolist() for k, i in zip(keys, index)]


def _sets_of(b: pa.RecordBatch) -> tuple[list[int], list[np.ndarray]]:
    revs, sets = [], []
    for rev, text in zip(b.column("rev_id").to_pylist(), b.column("text").to_pylist()):
        s = shingle_set(text)
        if s is not None:
            revs.append(rev)
            sets.append(s)
    return revs, sets


def _key_batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
    revs, sets = _sets_of(b)
    if not sets:
        return None
    check, keys = _fingerprints(sets)
    cols = [pa.array(revs, pa.int64()), pa.array(map(_class, sets), pa.int64()), *map(pa.array, np.ascontiguousarray(check.T)), pa.array(keys, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, ["rev_id", "class", "bits0", "bits1", "bits2", "keys"])


def _set_batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
    _, sets = _sets_of(b)
    if not sets:
        return None
    short = [np.unique((s & np.uint64(0xFFFFFFFF)).astype(np.uint32)).view(np.int32) for s in sets]
    ends = np.cumsum([0] + [len(s) for s in short]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(map(_class, sets), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(short)))], ["class", "words"]
    )


class Links:
    """members: rev_id, class. pairs: class_a < class_b of different sets that are similar enough."""

    def __init__(self, members: DataFrame, pairs: DataFrame):
        self.members, self.pairs = members, pairs


def link(pages: DataFrame) -> Links:
    """The classes of equal sets of all revisions with LEAST_WORDS words and the pairs of similar classes.

    `pages` needs rev_id and text (escaped). Null, empty and short texts and
    null rev_ids have no class; a repeated revision has one (of differing texts
    the smallest class); other columns are ignored. Every class is indexed under
    all its keys and every shared key is followed, with no cap on groups.
    """
    texts = pages.where("length(text) > 0 AND rev_id IS NOT NULL").select(F.col("rev_id").cast("long").alias("rev_id"), "text")
    features = written(map_rows(texts, _key_batch, "rev_id BIGINT, class BIGINT, bits0 BIGINT, bits1 BIGINT, bits2 BIGINT, keys ARRAY<BIGINT>"), "fingerprints")
    members = features.groupBy("rev_id").agg(F.min("class").alias("class"))
    keyed = features.groupBy("class").agg(F.first("bits0").alias("bits0"), F.first("keys").alias("keys")).select("class", "bits0", F.explode("keys").alias("key"))
    a, b = (keyed.select("key", F.col("class").alias(f"class_{x}"), F.col("bits0").alias(f"bits0_{x}")) for x in "ab")
    met = a.join(b, "key").where(f"class_a < class_b AND bit_count(bits0_a ^ bits0_b) <= {CHECK_APART}").select("class_a", "class_b").distinct()
    prints = features.select("class", "bits0", "bits1", "bits2").distinct()
    for x in "ab":
        met = met.join(prints.select(*(F.col(c).alias(f"{c}_{x}") for c in prints.columns)), f"class_{x}")
    apart = " + ".join(f"bit_count(bits{i}_a ^ bits{i}_b)" for i in range(3))
    met = met.where(f"{apart} <= {ALL_APART}").select("class_a", "class_b")
    sets = map_rows(texts, _set_batch, "class BIGINT, words ARRAY<INT>").groupBy("class").agg(F.first("words").alias("words"))
    with_a = met.join(sets.select(F.col("class").alias("class_a"), F.col("words").alias("words_a")), "class_a")
    with_b = with_a.join(sets.select(F.col("class").alias("class_b"), F.col("words").alias("words_b")), "class_b")
    common = with_b.withColumn("both", F.size(F.array_intersect("words_a", "words_b")))
    pairs = common.where(F.expr(f"both * {OF} >= {PART} * (size(words_a) + size(words_b) - both)")).select("class_a", "class_b")
    return Links(members, written(pairs, "similar-classes"))


def similar_pairs(pages: DataFrame) -> DataFrame:
    """rev_id_a < rev_id_b of all pairs of revisions that share at least PART / OF of their three-word sequences.

    Defined for odd input as in `link`. Equal texts are pairs too: members of
    one class are joined with each other, members of linked classes across.
    """
    links = link(pages)
    m = links.members
    both = links.pairs.unionByName(links.pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    many = m.groupBy("class").count().where("count > 1")
    both = both.unionByName(many.select(F.col("class").alias("class_a"), F.col("class").alias("class_b")))
    left = both.join(m.select(F.col("class").alias("class_a"), F.col("rev_id").alias("rev_id_a")), "class_a")
    right = left.join(m.select(F.col("class").alias("class_b"), F.col("rev_id").alias("rev_id_b")), "class_b")
    return right.where("rev_id_a < rev_id_b").select("rev_id_a", "rev_id_b")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node is connected with.

    `edges` has a, b; `nodes` has node. Each round gives a node the smallest
    label among its own, its neighbours' and its label's (pointer jumping);
    rounds are cut by checkpoint. Labels never leave the executors.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = checkpointed(nodes.select("node", F.col("node").alias("root")))
    while True:
        around = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("near"))
        step = label.join(around, label["node"] == around["a"], "left").select("node", "root", F.least("root", F.coalesce("near", "root")).alias("new"))
        up = label.select(F.col("node").alias("at"), F.col("root").alias("above"))
        jumped = step.join(up, step["new"] == up["at"], "left").select("node", F.col("root").alias("old"), F.least("new", F.coalesce("above", "new")).alias("root"))
        jumped = checkpointed(jumped)
        changed = not jumped.where("root <> old").isEmpty()
        label = jumped.select("node", "root")
        if not changed:
            return label


def groups(pages: DataFrame) -> DataFrame:
    """rev_id, group_id, n_links: the group of each revision and how many other classes its text is linked with.

    A group is a connected set of similar classes; its id is the smallest
    rev_id in it. Copies are members of one class and are not expanded.
    """
    links = link(pages)
    degree = links.pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    roots = components(links.pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")), links.members.select(F.col("class").alias("node")).distinct())
    placed = links.members.join(roots, F.col("class") == F.col("node")).join(degree, "class", "left")
    named = placed.groupBy("root").agg(F.min("rev_id").alias("group_id"))
    return placed.join(named, "root").select("rev_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
