"""Token counts through a digest cache.

The cache holds (tokenizer digest, content digest, count). A call digests
every text in the JVM, joins the distinct digests to the cache, encodes one
text of each digest that is missing, appends those counts, and joins the
counts to the rows. Texts are shuffled once, to meet the ids of the misses
(which grow with the data and so aren't broadcast); all else that moves is
digests and ids. A digest that very many rows share is joined by broadcast, since at most
1 / HOT_SHARE digests can be that frequent; all others by a shuffled join.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated
rows each get a row; extra columns are ignored; an empty table gives an empty
result and writes nothing to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from lectern.llm.arrow import chunks, over_arrow
from lectern.llm.bpe import load
from lectern.session import shared_dir

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: A digest with more than this share of all rows is joined by broadcast: at most 200 of them.
HOT_SHARE = 0.005
CACHE_SCHEMA = "version string, digest binary, n_tokens long"


def version_of(path: str) -> str:
    """The tokenizer's version: a digest of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def token_counter(path: str):
    """A function from texts to token counts, for one worker."""
    if path.endswith(".json"):
        bpe = load(path)
        return lambda texts: np.diff(bpe.encode_texts(texts)[1], prepend=0)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts.to_pylist(), num_threads=1)]


def read_cache(spark, cache: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException:
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row.

    cache: a Parquet folder that all executors reach; a new one under the shared folder if not given.
    """
    spark = docs.sparkSession
    path = tokenizer or public_tokenizers.path(VOCABULARY)
    version, cache = version_of(path), cache or f"{shared_dir(spark)}/token_cache"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest"))
    known = read_cache(spark, cache).where(F.col("version") == version).select("digest", "n_tokens")

    # One row a digest; the text to encode is that of the smallest id that has it.
    classes = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_rows"))
    misses = classes.join(known, "digest", "left_anti").select("doc_id", F.col("digest").alias("wanted")).hint("merge")
    wanted = (
        base.join(misses, base["doc_id"].eqNullSafe(misses["doc_id"]))
        .where(F.unhex(F.sha2("text", 256)) == F.col("wanted"))
        .select(F.col("wanted").alias("digest"), "text")
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(path)
        for batch in batches:
            for part in chunks(batch):
                counts = count(part.column(1))
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(counts), pa.string()), part.column(0).cast(pa.binary()), pa.array(np.asarray(counts, dtype=np.int64))], ["version", "digest", "n_tokens"])

    # Repeated rows of one id give their digest more than once.
    over_arrow(wanted, kernel, CACHE_SCHEMA).dropDuplicates(["digest"]).write.mode("append").parquet(cache)
    # Appends of two runs may hold a digest twice, with the same count.
    counts = read_cache(spark, cache).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    # The number of rows comes from the files' footers.
    most = max(docs.count() * HOT_SHARE, 100.0)
    frequent = classes.where(F.col("n_rows") > most).select("digest")
    hot = F.broadcast(counts.join(frequent, "digest").select("digest", F.col("n_tokens").alias("hot_tokens")))
    marked = keyed.join(hot, "digest", "left")
    many = marked.where(F.col("hot_tokens").isNotNull()).select("doc_id", "n_bytes", F.col("hot_tokens").alias("n_tokens"))
    rest = marked.where(F.col("hot_tokens").isNull()).drop("hot_tokens").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
    return many.unionByName(rest).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
