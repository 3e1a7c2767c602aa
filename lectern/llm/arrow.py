"""Arrow batch plumbing shared by the Python-side operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lectern.session import ship

#: Rows and bytes of one Arrow batch, so that a worker's memory doesn't follow the texts' lengths.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
#: Bytes of text that a kernel takes at once (a longer text is taken alone).
CHUNK_BYTES = 1 << 20


def over_arrow(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow with bounded batches."""
    spark = df.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(kernel, schema)


def documents(df: DataFrame) -> DataFrame:
    """The two columns that text operators read, whatever else the table holds."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def filtered(docs: DataFrame, judge: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows of docs, with all their columns, whose text passes; judge() makes the function from texts to a mask
    on a worker. Nothing is shuffled and no id is needed, so repeated and null ids are safe."""
    at = docs.columns.index("text")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = judge()
        for batch in batches:
            for part in chunks(batch, text=at):
                kept = part.filter(pa.array(passes(part.column(at)), pa.bool_()))
                if kept.num_rows:
                    yield kept

    return over_arrow(docs, kernel, docs.schema)


def chunks(batch: pa.RecordBatch, most: int = CHUNK_BYTES, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, such as (doc_id, text), of about `most` bytes of text each."""
    text = batch.column(text)
    sizes = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def raw_bytes(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes as one array, and n + 1 offsets; null texts are empty."""
    text = pc.fill_null(text, "").cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    every = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def ragged_take(table: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated table[offsets[i]:offsets[i + 1]] for i in ids, and the ends of each piece."""
    lengths = (offsets[1:] - offsets[:-1])[ids]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(offsets[:-1][ids] - (ends - lengths), lengths)
    index += np.arange(total, dtype=index.dtype)
    return table[index], ends
