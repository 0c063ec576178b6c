"""Problem 8: encoding a corpus with a public byte-level BPE tokenizer.

The text is split into words in Spark. Within blocks of documents the words are replaced by their places in a list of
the block's distinct words; only those lists are shuffled. Every distinct word of the corpus is encoded once, its ids
are joined back to the lists, and each block's documents are read off by position. No word is a hot key: a frequent
word comes once per block, however often the corpus holds it.

Defined results: null and empty texts give an empty list; a special token's name is ordinary text; a repeated row
gives a repeated row; other columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from fathom.session import spread, write_table

#: Folder of the public vocabulary files; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"

#: White space as Unicode has it (Java's \s is ASCII only).
_WS = r"\u0009-\u000D \u0085   -     　"

#: The published split of byte-level BPE: contractions, letters, digits, other, white space. Fixed values.
SPLIT = (
    r"'(?:[stmd]|re|ve|ll)"
    rf"| ?(?:\p{{L}}++|\p{{N}}++|[^{_WS}\p{{L}}\p{{N}}]++)"
    rf"|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
)

#: A block of documents is closed at so many words (or one document, if that alone has more).
BLOCK_WORDS = 500_000


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    """A tiktoken encoder of a rank file, without special tokens."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    split = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("corpus", pat_str=split, mergeable_ranks=ranks, special_tokens={})


def split_words(text) -> F.Column:
    """The words of a text column, whose concatenation is the text; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(SPLIT), F.lit(0)), F.array().cast("array<string>"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, words) become rows (block, doc_id, places), and one row (block, distinct) per block."""
    block = TaskContext.get().partitionId() << 32
    ids, lists, held = [], [], 0

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal block, ids, lists, held
        docs = pa.concat_arrays(ids)
        words = pa.concat_arrays([x.flatten() for x in lists])
        lengths = pa.concat_arrays([x.value_lengths() for x in lists]).to_numpy(zero_copy_only=False)
        coded = words.dictionary_encode()
        offsets = pa.array([0, *lengths.cumsum()], pa.int32())
        n = len(docs)
        block_ids = pa.array([block] * n, pa.int64())
        nothing = pa.nulls(n, pa.list_(pa.string()))
        places = pa.ListArray.from_arrays(offsets, coded.indices.cast(pa.int32()))
        yield pa.RecordBatch.from_arrays([block_ids, docs, places, nothing], _NAMES)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.nulls(1, docs.type),
                pa.nulls(1, pa.list_(pa.int32())),
                pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())),
            ],
            _NAMES,
        )
        block, ids, lists, held = block + 1, [], [], 0

    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            ids.append(part.column(0))
            lists.append(part.column(1))
            held += len(part.column(1).flatten())
            if held >= BLOCK_WORDS:
                yield from close()
    if ids:
        yield from close()


_NAMES = ["block", "doc_id", "places", "distinct"]


def word_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The blocks of ``docs``, written to the shared folder."""
    texts = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    split = texts.select("doc_id", split_words(F.col("text")).alias("words"))
    schema = T.StructType(
        [
            T.StructField("block", T.LongType()),
            T.StructField("doc_id", split.schema["doc_id"].dataType),
            T.StructField("places", T.ArrayType(T.IntegerType())),
            T.StructField("distinct", T.ArrayType(T.StringType())),
        ]
    )
    return write_table(split.mapInArrow(_blocks, schema), "blocks")


def _encode_words(vocabulary: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            ids = enc.encode_ordinary_batch(batch.column(0).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["word", "ids"])

    return encode


def block_dictionaries(blocks: DataFrame, vocabulary: str) -> DataFrame:
    """(of_block, place, ids) of every block's distinct words; each distinct word of the corpus is encoded once."""
    words = blocks.filter(F.col("distinct").isNotNull()).select(
        F.col("block").alias("of_block"), F.posexplode("distinct").alias("place", "word")
    )
    table = words.select("word").distinct().mapInArrow(_encode_words(vocabulary), "word string, ids array<int>")
    return words.join(table.hint("shuffle_hash"), "word").select("of_block", "place", "ids")


def _read_off(docs: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of a block's documents, by position."""
    doc_ids = docs.column("doc_id").combine_chunks()
    places = docs.column("places").combine_chunks()
    ids = words.sort_by("place").column("ids").combine_chunks() if words.num_rows else None
    flat = places.flatten()
    if ids is None or not len(flat):
        return pa.table({"doc_id": doc_ids, "ids": pa.array([[]] * len(doc_ids), pa.list_(pa.int32()))})
    taken = ids.take(flat)
    starts = pa.array([0, *places.value_lengths().to_numpy(zero_copy_only=False).cumsum()], pa.int32())
    ends = pa.array([0, *taken.value_lengths().to_numpy(zero_copy_only=False).cumsum()], pa.int32())
    return pa.table({"doc_id": doc_ids, "ids": pa.ListArray.from_arrays(ends.take(starts), taken.flatten())})


def _encoded_blocks(docs: DataFrame, id_col: str, text_col: str, vocabulary: str | None, read_off, result):
    vocabulary = vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    blocks = word_blocks(docs, id_col, text_col)
    texts = blocks.filter(F.col("distinct").isNull()).select("block", "doc_id", "places")
    words = block_dictionaries(blocks, vocabulary)
    schema = T.StructType([T.StructField("doc_id", blocks.schema["doc_id"].dataType), result])
    return texts.groupBy("block").cogroup(words.groupBy("of_block")).applyInArrow(read_off, schema)


def encode_corpus(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``, without special tokens."""
    result = T.StructField("ids", T.ArrayType(T.IntegerType()))
    return _encoded_blocks(docs, id_col, text_col, vocabulary, _read_off, result)


def _count_off(docs: pa.Table, words: pa.Table) -> pa.Table:
    table = _read_off(docs, words)
    sizes = table.column("ids").combine_chunks().value_lengths().cast(pa.int64())
    return pa.table({"doc_id": table.column("doc_id"), "n_tokens": sizes})


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """(doc_id, n_tokens) of every row of ``docs``."""
    return _encoded_blocks(docs, id_col, text_col, vocabulary, _count_off, T.StructField("n_tokens", T.LongType()))


def decode_corpus(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of ``encoded(doc_id, ids)``, by a join with the id-to-piece table (bounded by the vocabulary)."""
    vocabulary = vocabulary or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    spark = encoded.sparkSession
    with open(vocabulary, "rb") as f:
        rows = [(int(i), base64.b64decode(piece)) for piece, i in (line.split() for line in f)]
    pieces = spark.createDataFrame(rows, "id int, piece binary")
    spread = encoded.select("doc_id", F.posexplode_outer("ids").alias("pos", "id"))
    return (
        spread.join(F.broadcast(pieces), "id", "left")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))).alias("parts"))
        .select("doc_id", F.decode(F.unhex(F.array_join(F.col("parts.h"), "")), "UTF-8").alias("text"))
    )
