"""Token ids and counts of whole corpora."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metaquarry.llm.bpe import DEFAULT, TOKENIZERS, encoder, vocabulary

BATCH_CHARS = 1_000_000


def by_size(texts: list[str], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Slices (from, to) of texts with about `most` characters each; a longer text is one slice."""
    at = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield at, i
            at, held = i, 0
        held += len(t)
    if at < len(texts):
        yield at, len(texts)


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def token_ids(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the ids of each text by a byte-level BPE vocabulary, without special tokens.

    Null and empty texts have an empty list; special tokens written in a text are ordinary text.
    Texts are encoded whole, however long. Repeated rows and rows with a null key are kept as they
    are, further columns are not. Nothing is shuffled."""

    held = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for batch in batches:
            texts = _texts(batch.column(1))
            for a, b in by_size(texts):
                flat, counts = enc.encode(texts[a:b])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(encode, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def token_counts(docs: DataFrame, *keep: str, text: str = "text", tokenizer: str = DEFAULT, folder: str = TOKENIZERS) -> DataFrame:
    """The columns `keep` and n_tokens of each row; null and empty texts have 0."""

    held = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for batch in batches:
            texts = _texts(batch.column(0))
            n = [enc.count(texts[a:b]) for a, b in by_size(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(n) if n else np.zeros(0), pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens long"
    return docs.select(text, *keep).mapInArrow(count, schema)
