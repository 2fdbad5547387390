"""Token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens) that any number of
runs share and only ever append to:

1. every text is normalised (null is empty) and digested; the tokenizer's file is digested too,
   so that another vocabulary never meets this one's counts;
2. digests are made distinct before and after the shuffle, and those with a stored count go;
3. only one text of each missing digest is encoded, and its count is appended;
4. the documents join their digest to the counts.

Within a task, texts are cut where no vocabulary piece can span: before a space that follows
another character.  That holds because no piece has a space inside (checked when the model is
loaded; otherwise whole texts are encoded), and it lets a task encode each distinct word once.

Nulls: a null text counts as empty.  Empty tables give empty results.  Repeated rows each get
their count.  Very long words skip the memo.  Other columns do not matter.
"""

from __future__ import annotations

import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import work_dir

SEGMENT = re.compile(r" +[^ ]*")
MEMO_WORDS = 400_000
MEMO_LENGTH = 48


@functools.lru_cache(4)
def _model(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    # Words may be encoded apart only if pieces never hold a space mark after another character
    # and spaces are kept as they are.
    apart = not any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size())) and len(sp.encode(" ")) > 0
    return sp, apart, {}


def _count(path: str, text: str) -> int:
    sp, apart, memo = _model(path)
    if not text:
        return 0
    if not apart or "▁" in text or "\0" in text:
        return len(sp.encode(text))
    total = 0
    for word in SEGMENT.findall(" " + text):
        n = memo.get(word)
        if n is None:
            n = len(sp.encode(word[1:])) if len(word) > 1 else 1
            if len(word) <= MEMO_LENGTH and len(memo) < MEMO_WORDS:
                memo[word] = n
        total += n
    return total


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counts(spark: SparkSession, docs: DataFrame, model_path: str, cache_path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_bytes and n_tokens; missing counts are appended to the cache.

    ``cache_path``: the cache's folder; None: a new one in the shared folder.
    """
    version = tokenizer_digest(model_path)
    cache_path = cache_path or work_dir(spark, "token-cache")
    schema = "content_digest binary, tokenizer_digest string, n_tokens long"
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest = F.unhex(F.sha2(t, 256))
    texts = docs.select(digest.alias("content_digest"), t.alias("_text"))

    cached = _cache(spark, cache_path, schema)
    if cached is not None:
        known = cached.where(F.col("tokenizer_digest") == version).select("content_digest")
        texts = texts.join(known, "content_digest", "left_anti")

    def encode(batches):
        for batch in batches:
            counts = [_count(model_path, x) for x in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("content_digest"), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())],
                names=["content_digest", "tokenizer_digest", "n_tokens"],
            )

    texts.dropDuplicates(["content_digest"]).mapInArrow(encode, schema).write.mode("append").parquet(cache_path)

    names = ("n_bytes", "n_tokens", "content_digest")
    rest = [c for c in docs.columns if c not in (*names, text)]
    left = docs.select(*[F.col(f"`{c}`") for c in rest], F.octet_length(t).cast("long").alias("n_bytes"), digest.alias("content_digest"))
    counts = spark.read.schema(schema).parquet(cache_path).where(F.col("tokenizer_digest") == version)
    counts = counts.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may have met the same text
    return left.join(counts, "content_digest", "left").drop("content_digest")


def _cache(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(schema).parquet(path)
