"""Token ids of documents by a public byte-level tokenizer, through a table of distinct words.

1. Texts are cut into the tokenizer's words in Spark (a JVM regular expression).
2. Documents are gathered into blocks of a bounded number of words; a block
   stores each of its distinct words once and a code (position in that list)
   per running word. So only distinct words per block are shuffled, never all
   running words, and a word as common as "the" costs one row per block.
3. Each distinct word of the corpus is encoded once.
4. The ids are joined back to the blocks' lists and placed by position.

Decoding joins ids to the vocabulary's pieces.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from foliospark.functions.arrow import map_rows, spread
from foliospark.functions.stage import written

#: Fixed value: the word pattern of the byte-level tokenizers, with Unicode white space.
WORD = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Running words of a block; bounds the memory of a task, not the result.
BLOCK_WORDS = 200_000


@cache
def _ranks(name: str) -> dict[bytes, int]:
    import public_tokenizers as P

    with open(P.path(f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def encoding(name: str = "byte_bpe_50k"):
    """The tokenizer of one Python worker; special tokens are ordinary text to it."""
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=_ranks(name), special_tokens={})


@cache
def _splitter():
    import public_tokenizers as P
    import regex

    return regex.compile(P.PATTERN)


def _cut_rare(batches):
    """Batches with their words; texts with signs newer than the JVM's tables are cut here."""
    for b in batches:
        words, rare = b.column("words"), b.column("rare")
        if rare.null_count < len(rare):
            words = pa.array([w if r is None else _splitter().findall(r) for w, r in zip(words.to_pylist(), rare.to_pylist())], pa.list_(pa.string()))
        yield b.column("doc_id"), words


def _blocks(columns, most: int, kind: pa.DataType):
    """One row per block of whole documents with about `most` values: docs, lens, packed codes, and the distinct values that the codes count."""
    task = TaskContext.get()
    at = (task.partitionId() if task else 0) << 32
    for docs, lists in columns:
        lens = np.array([x or 0 for x in lists.value_lengths().to_pylist()], np.int64)
        ends = np.cumsum(lens)
        start = 0
        while start < len(lens):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            coded = lists.slice(start, stop - start).flatten().dictionary_encode()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([at], pa.int64()),
                    pa.array([docs.slice(start, stop - start).to_pylist()], pa.list_(pa.int64())),
                    _one_list(lens[start:stop].astype(np.int32)),
                    pa.array([_packed(coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary))], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary.cast(kind)),
                ],
                ["block", "docs", "lens", "codes", "distinct"],
            )
            at += 1
            start = stop


def _packed(codes: np.ndarray, distinct: int) -> bytes:
    """Codes in 2 bytes each where the block's distinct words allow it, else in 4 (first byte), compressed: they are most of what is shuffled."""
    kind = np.uint16 if distinct <= 1 << 16 else np.uint32
    return bytes([kind().itemsize]) + pa.compress(codes.astype(kind).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    width = packed[0]
    raw = pa.decompress(packed[1:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint16 if width == 2 else np.uint32).astype(np.int64)


def _one_list(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def word_blocks(documents: DataFrame, most: int = BLOCK_WORDS) -> DataFrame:
    """block, docs, lens, codes, distinct: the documents as blocks of coded words, written to the shared folder."""
    text = F.col("text")
    cut = spread(documents.select("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.expr(f"CASE WHEN text IS NULL THEN array() ELSE regexp_extract_all(text, r\"{WORD}\", 0) END").alias("words"),
        F.when(text.rlike(r"\p{Cn}"), text).alias("rare"),
    )
    schema = "block BIGINT, docs ARRAY<BIGINT>, lens ARRAY<INT>, codes BINARY, distinct ARRAY<STRING>"
    return written(cut.mapInArrow(lambda batches: _blocks(_cut_rare(batches), most, pa.string()), schema), "word-blocks")


def word_table(blocks: DataFrame, name: str) -> DataFrame:
    """word, piece_ids: each distinct word of the corpus, encoded once."""

    def encode(b: pa.RecordBatch) -> pa.RecordBatch:
        words = b.column("word")
        ids = encoding(name).encode_ordinary_batch(words.to_pylist(), num_threads=1)
        return pa.RecordBatch.from_arrays([words, pa.array(ids, pa.list_(pa.int32()))], ["word", "piece_ids"])

    return map_rows(blocks.select(F.explode("distinct").alias("word")).distinct(), encode, "word STRING, piece_ids ARRAY<INT>")


def _place(b: pa.RecordBatch) -> pa.RecordBatch:
    docs, counts, values = [], [], []
    col = {n: b.column(n) for n in b.schema.names}
    for r in range(b.num_rows):
        pieces = col["pieces"][r].values
        lens = col["lens"][r].values.to_numpy()
        codes = _unpacked(col["codes"][r].as_py(), int(lens.sum()))
        docs.append(col["docs"][r].values)
        if len(codes) == 0:
            counts.append(np.zeros(len(lens), np.int64))
            continue
        off = pieces.offsets.to_numpy().astype(np.int64)
        flat = pieces.values.to_numpy()
        n = (off[1:] - off[:-1])[codes]
        ends = np.cumsum(n)
        values.append(flat[np.repeat(off[codes] - (ends - n), n) + np.arange(ends[-1])])
        upto = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(lens)))]
        counts.append(np.diff(upto))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
    flat = np.concatenate(values).astype(np.int32) if values else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(docs).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["doc_id", "ids"])


def token_ids(documents: DataFrame, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, ids of every document row; a null or empty text gives an empty list.

    `documents` needs doc_id and text; rows with a null or repeated doc_id are
    encoded like any other, other columns are ignored. Special tokens that a
    text spells out are ordinary text.
    """
    blocks = word_blocks(documents)
    refs = blocks.select("block", F.posexplode("distinct").alias("code", "word")).join(word_table(blocks, name), "word")
    lists = refs.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("code", "piece_ids"))).alias("p"))
    joined = blocks.select("block", "docs", "lens", "codes").join(lists, "block", "left")
    placed = joined.select("docs", "lens", "codes", F.coalesce("p.piece_ids", F.expr("cast(array() as array<array<int>>)")).alias("pieces"))

    def place(batches):
        for b in batches:
            for r in range(b.num_rows):
                yield _place(b.slice(r, 1))

    return placed.mapInArrow(place, "doc_id BIGINT, ids ARRAY<INT>")


def pieces(spark: SparkSession, name: str = "byte_bpe_50k") -> DataFrame:
    """id, piece (hex) of a public vocabulary: a table of fixed size (50,256 rows)."""
    return spark.createDataFrame([(i, b.hex()) for b, i in _ranks(name).items()], "id INT, piece STRING")


def _spell(batches):
    for b in batches:
        for r in range(b.num_rows):
            part = b.slice(r, 1)
            lens = part.column("lens")[0].values.to_numpy()
            codes = _unpacked(part.column("codes")[0].as_py(), int(lens.sum()))
            spelled = [bytes.fromhex(p or "") for p in part.column("pieces")[0].as_py()]
            ends = np.cumsum(lens)
            texts = [b"".join([spelled[c] for c in codes[e - n : e]]).decode("utf-8", "replace") for e, n in zip(ends, lens)]
            yield pa.RecordBatch.from_arrays([part.column("docs")[0].values.cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])


def decoded(ids: DataFrame, name: str = "byte_bpe_50k", most: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text back from doc_id, ids by a join with the vocabulary's pieces; an empty or null list gives ''.

    As in encoding, rows are gathered into blocks and only a block's distinct
    ids are joined. The vocabulary has a fixed size and is broadcast. Bytes
    that are no UTF-8 decode to replacement signs, unknown ids to nothing;
    repeated and null doc_ids keep their own rows.
    """
    schema = "block BIGINT, docs ARRAY<BIGINT>, lens ARRAY<INT>, codes BINARY, distinct ARRAY<INT>"
    lists = ids.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    blocks = written(spread(lists).mapInArrow(lambda batches: _blocks(((b.column("doc_id"), b.column("ids")) for b in batches), most, pa.int32()), schema), "id-blocks")
    refs = blocks.select("block", F.posexplode("distinct").alias("code", "id")).join(F.broadcast(pieces(ids.sparkSession, name)), "id", "left")
    spelled = refs.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("code", "piece"))).alias("p"))
    joined = blocks.select("block", "docs", "lens", "codes").join(spelled, "block", "left")
    return joined.select("docs", "lens", "codes", F.coalesce("p.piece", F.expr("cast(array() as array<string>)")).alias("pieces")).mapInArrow(_spell, "doc_id BIGINT, text STRING")
