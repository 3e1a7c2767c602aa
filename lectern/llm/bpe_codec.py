"""BPE encoding and decoding: the backtracking encoder over Arrow batches.

Defined results: a null text is an empty one (no tokens, the digests of the
empty string); repeated rows each get a row; extra columns are ignored; an
empty table gives an empty result. A text is encoded whole, in one piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from lectern.llm.arrow import chunks, documents, over_arrow
from lectern.llm.bpe import load

VOCABULARY = "byte_bpe_50k.json"


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: every text's token ids."""
    path = tokenizer or public_tokenizers.path(VOCABULARY)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in chunks(batch):
                ids, ends = bpe.encode_texts(part.column(1))
                at = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return over_arrow(documents(docs), kernel, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text: the texts of (doc_id, ids); special tokens keep their strings. Null ids are none."""
    path = tokenizer or public_tokenizers.path(VOCABULARY)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(np.asarray(ids or [], dtype=np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return over_arrow(encoded.select("doc_id", "ids"), kernel, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and decoded again in one pass,
    so that no token ids travel between processes."""
    path = tokenizer or public_tokenizers.path(VOCABULARY)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in chunks(batch):
                ids, last = bpe.encode_texts(part.column(1))
                ids = ids.astype(np.int64)
                digits, digit_ends = bpe.digits(ids)
                data, data_ends = bpe.decode_bytes(ids)
                at = lambda ends: np.concatenate([[0], np.concatenate([[0], ends])[last]])
                d, t = at(digit_ends), at(data_ends)
                digits, data = digits.tobytes(), data.tobytes()
                listed = [hashlib.sha256(digits[a : max(a, b - 1)]).hexdigest() for a, b in zip(d[:-1], d[1:], strict=True)]
                decoded = [hashlib.sha256(data[a:b].decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(t[:-1], t[1:], strict=True)]
                counts = np.diff(last, prepend=0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts.astype(np.int64)), pa.array(listed), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return over_arrow(documents(docs), kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
