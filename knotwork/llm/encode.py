"""Encoding a corpus with a public tokenizer (problem 7).

The encoder is in ``bpe``.  It runs in Python workers over Arrow batches; every
worker loads the vocabulary once and remembers the pieces it has met, within a
fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from knotwork.llm import bpe

#: where the vocabulary files of public tokenizers lie
TOKENIZERS = "/opt/tokenizers"
BYTE_BPE_50K = f"{TOKENIZERS}/byte_bpe_50k.json"
#: fixed value: the pattern of that vocabulary that cuts a text into pieces
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: texts that one Arrow batch of results may hold, in characters
BATCH_CHARS = 4_000_000


def _batches(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most BATCH_CHARS characters each (one text at least)."""
    start = size = 0
    column = batch.column(batch.schema.get_field_index(text))
    for i, value in enumerate(column):
        n = len(value.as_py() or "")
        if i > start and size + n > BATCH_CHARS:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def encode(docs: DataFrame, doc_id: str, text: str, vocabulary: str = BYTE_BPE_50K, pattern: str = PIECES, ids: bool = True) -> DataFrame:
    """``doc_id, ids`` (or ``doc_id, n_tokens``) of every row.

    The list is empty (the count 0) for a null and for an empty text; a blank
    text is text.  Spellings of special tokens are ordinary text.  Rows are
    kept as they are, repeated ids and null ids too; other columns are left
    out.  Texts of any length are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocabulary, pattern)
        for batch in batches:
            if not batch.num_rows:
                continue
            for part in _batches(batch, text):
                lists = [coder.encode(t.as_py()) for t in part.column(1)]
                second = pa.array(lists, pa.list_(pa.int32())) if ids else pa.array([len(x) for x in lists], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), second], names=[doc_id, name])

    name = "ids" if ids else "n_tokens"
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"`{doc_id}` {kind}, {name} {'array<int>' if ids else 'int'}")


def decode(encoded: DataFrame, doc_id: str, ids: str = "ids", vocabulary: str = BYTE_BPE_50K, pattern: str = PIECES) -> DataFrame:
    """``doc_id, text`` of every row; an empty or null list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.load(vocabulary, pattern)
        for batch in batches:
            texts = [coder.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[doc_id, "text"])

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(doc_id, ids).mapInArrow(run, f"`{doc_id}` {kind}, text string")
