"""Encoding of a whole corpus with a public byte-level tokenizer, and its inverse.

A byte-level tokenizer cuts a text into pre-tokens before it merges bytes, and it always cuts where white space follows
a character that is none. So a text is a sequence of *words* (a run of white space with the run of other characters
after it), each of which can be encoded on its own. Three steps follow from that:

1. Each task numbers the distinct words of a block of texts and keeps every text as the list of its word numbers, in
   order: the positions are the indices of that list, so no row per word occurrence is ever made.
2. The distinct words of all blocks are shuffled by word; each word meets its copies from the other blocks in one
   task and is encoded once.
3. The ids go back to the blocks by block number, where the texts are put together by position.

Only the words of each block travel, once, and the lists of numbers; blocks are bounded in bytes of text, so no task
holds more than one block at a time, however skewed the ids, sources or words are.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavel.sources.staging import stage

#: Bytes of text in a block. The words of a block and its lists of numbers are in memory at once.
BLOCK_BYTES = 4_000_000
#: Words that a task remembers with their ids. Beyond that it forgets all and goes on.
CACHE_WORDS = 500_000

#: White space of the tokenizer's pattern (fixed values): a blank after one of these belongs to a longer run.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_run = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
_run_re2 = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPACES) + "] "
_encoders: dict[str, object] = {}


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed vocabulary file `name` lies."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_ranks(path: str) -> dict[bytes, int]:
    """The bytes of every token and its id."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def encoder(path: str):
    """The tokenizer of a vocabulary file, kept for the life of the Python worker."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        _encoders[path] = tiktoken.Encoding(
            "vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={}
        )
    return _encoders[path]


def _number_words(texts: pa.Array) -> tuple[pa.Array, list[str]]:
    """Every text as a list of numbers of the returned distinct words. Null and empty texts become empty lists."""
    texts = pc.fill_null(texts, "")
    odd = pc.match_substring_regex(texts, _run_re2).to_numpy(zero_copy_only=False)
    pieces = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
    coded = pc.dictionary_encode(pieces.values)
    numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    starts = pieces.offsets.to_numpy()[:-1] - pieces.offsets[0].as_py()
    lengths = np.diff(pieces.offsets.to_numpy())
    # The first piece of a text has no blank before it, so it is another word than the same piece elsewhere.
    words = [" " + w for w in coded.dictionary.to_pylist()]
    known: dict[str, int] = {}

    def number(word: str) -> int:
        if word not in known:
            known[word] = len(words)
            words.append(word)
        return known[word]

    plain = coded.dictionary.to_pylist()
    for at in starts:
        numbers[at] = number(plain[numbers[at]])
    if odd.any():
        parts, at = [], 0
        for k in np.flatnonzero(odd):
            parts.append(numbers[at : starts[k]])
            own = np.fromiter((number(w) for w in _run.findall(texts[int(k)].as_py())), np.int32)
            parts.append(own)
            lengths[k] = len(own)
            at = starts[k] + 1
        numbers = np.concatenate([*parts, numbers[at:]])
    used, numbers = np.unique(numbers, return_inverse=True)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(numbers.astype(np.int32))), [words[u] for u in used]


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most `most` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for k, n in enumerate(sizes):
        if total + n > most and k > at:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def _blocks(block_bytes: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in _slices(batch, 1, block_bytes):
                lists, words = _number_words(part.column(1))
                n, w = part.num_rows, len(words)
                names = ["block", "id", "codes", "no", "word", "kind"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), part.column(0), lists, pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.array(["text"] * n, pa.string())], names
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * w, pa.int64()), pa.nulls(w, id_type), pa.nulls(w, pa.list_(pa.int32())), pa.array(np.arange(w, dtype=np.int32)), pa.array(words, pa.string()), pa.array(["word"] * w, pa.string())], names
                )
                block += 1

    return run


def _encode_words(path: str, lengths: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, cache = encoder(path).encode_ordinary, {}
        for batch in batches:
            coded = pc.dictionary_encode(batch.column(2))
            ids = []
            for word in coded.dictionary.to_pylist():
                got = cache.get(word)
                if got is None:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    got = cache[word] = encode(word)
                ids.append(got)
            if lengths:
                out = pa.array([len(x) for x in ids], pa.int32())
            else:
                out = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), out.take(coded.indices)], ["block", "no", "ids"]
            )

    return run


def _assemble(lengths: bool, id_field: pa.Field, out: str):
    def run(words: pa.Table, texts: pa.Table) -> pa.Table:
        order = pc.sort_indices(words["no"])
        ids = words["ids"].combine_chunks().take(order)
        lists = texts["codes"].combine_chunks()
        codes, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        if lengths:
            each = ids.to_numpy(zero_copy_only=False)[codes.to_numpy(zero_copy_only=False)] if len(codes) else np.zeros(0)
            sums = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
            values = pa.array(sums[ends[1:]] - sums[ends[:-1]], pa.int64())
        else:
            each = ids.take(codes)
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(each).to_numpy(zero_copy_only=False), dtype=np.int64)])
            values = pa.ListArray.from_arrays(pa.array(bounds[ends].astype(np.int32)), each.flatten())
        return pa.table([texts["id"], values], schema=pa.schema([id_field, pa.field(out, values.type)]))

    return run


def _through_words(df: DataFrame, id_col: str, text_col: str, path: str | None, lengths: bool, out: str) -> DataFrame:
    path = path or vocabulary_path()
    id_type = df.schema[id_col].dataType
    arrow_id = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}[id_type]
    sql_id = id_type.simpleString()
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    numbered = stage(
        base.mapInArrow(
            _blocks(BLOCK_BYTES, arrow_id),
            f"block bigint, id {sql_id}, codes array<int>, no int, word string, kind string",
        ),
        "words",
        by=["kind"],
    )
    ids_type = "int" if lengths else "array<int>"
    words = (
        numbered.where("kind = 'word'")
        .select("block", "no", "word")
        .repartition(F.col("word"))
        .mapInArrow(_encode_words(path, lengths), f"block bigint, no int, ids {ids_type}")
    )
    texts = numbered.where("kind = 'text'").select("block", "id", "codes")
    kind = "bigint" if lengths else "array<int>"
    return (
        words.groupBy("block")
        .cogroup(texts.groupBy("block"))
        .applyInArrow(_assemble(lengths, pa.field("id", arrow_id), out), f"id {sql_id}, {out} {kind}")
        .withColumnRenamed("id", id_col)
    )


def encode_corpus(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """`id_col` and `ids`, the token ids of each row's text, without special tokens.

    Null and empty texts give the empty list; blank text is encoded as it is; the strings of special tokens in a text
    are ordinary text. Every input row gives one row, repeated ids too. `path`: the vocabulary file, by default the
    installed byte_bpe_50k.
    """
    return _through_words(df, id_col, text_col, path, False, "ids")


def count_tokens(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """`id_col` and `n_tokens`, the number of tokens of each row's text, 0 for null and empty texts."""
    return _through_words(df, id_col, text_col, path, True, "n_tokens")


def decode_corpus(df: DataFrame, id_col: str, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """`id_col` and `text`: the ids joined with the table of token bytes, in order, read as UTF-8.

    The table has as many rows as the vocabulary (50,256 here), so each task joins against a copy of it. Bytes that
    are no UTF-8, which only ids that no text gives can make, become U+FFFD. A null list gives a null text.
    """
    path = path or vocabulary_path()
    sql_id = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sorted(read_ranks(path).items(), key=lambda x: x[1])
        tokens = pa.array([token for token, _ in table], pa.binary())
        for batch in batches:
            lists = batch.column(1)
            joined = tokens.take(lists.flatten())
            grouped = pa.ListArray.from_arrays(
                pc.subtract(lists.offsets, lists.offsets[0]), joined, mask=lists.is_null()
            )
            texts = [None if b is None else b.decode("utf-8", "replace") for b in pc.binary_join(grouped, b"").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    return (
        df.select(F.col(id_col).alias("id"), F.col(ids_col))
        .mapInArrow(run, f"id {sql_id}, text string")
        .withColumnRenamed("id", id_col)
    )
