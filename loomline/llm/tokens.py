"""Token counts through a digest cache.

Each text is normalised, and its digest, with the digest of the tokenizer's file, is looked up in a cache table. Only
distinct texts that the cache lacks are encoded; their counts are appended, and all rows take their counts from the cache.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytesgrams as bg
from .common import ARROW_BYTES, SPACES, bound_batches, placed, small, spread_join, stage

#: Bytes of text handed to the tokenizer at a time, and words whose counts a task remembers.
BATCH_BYTES, REMEMBERED = 128 << 10, 400_000

#: Fixed value: the split pattern of this vocabulary family, none of whose matches holds white space.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def drops_white_space(tokenizer_json: str) -> bool:
    """Whether runs of white space count as one space and no token crosses one, so that a text's tokens are its words' tokens."""
    parts = json.loads(tokenizer_json)
    steps = parts.get("normalizer") or {}
    one_space = any(s.get("type") == "Replace" and s.get("pattern") == {"Regex": r"\s+"} and s.get("content") == " " for s in steps.get("normalizers", [steps]))
    first = ((parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    splits = first.get("type") == "Split" and first.get("pattern") == {"Regex": SPLIT_PATTERN} and first.get("behavior") == "Removed" and first.get("invert")
    return one_space and bool(splits)


def word_token_counts(tokenizer, held: list[bytes]) -> np.ndarray:
    """Tokens of each word. Words are encoded side by side; a token's first character tells its word."""
    texts = [w.decode() for w in held]
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    starts = np.array([o[0] for o in tokenizer.encode(" ".join(texts), add_special_tokens=False).offsets], np.int64)
    return np.bincount(np.searchsorted(first, starts, "right") - 1, minlength=len(held)) if len(starts) else np.zeros(len(held), np.int64)


def _by_words(tokenizer, column, known: dict[bytes, int]) -> list[int]:
    """Token counts of texts as sums over their words; known holds words met before."""
    counts: list[int] = []
    for a, b, data, offsets in bg.chunks(column, ARROW_BYTES):
        w = bg.words(data, offsets, lower=False)
        _, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        raw = data.tobytes()
        own = [raw[s:e] for s, e in zip(w.start[first].tolist(), (w.start + w.length)[first].tolist(), strict=True)]
        new = [x for x in own if x not in known]
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = own
        at = size = 0
        for k, x in enumerate(new):
            size += len(x) + 1
            if size >= BATCH_BYTES or k == len(new) - 1:
                known.update(zip(new[at : k + 1], word_token_counts(tokenizer, new[at : k + 1]).tolist(), strict=True))
                at, size = k + 1, 0
        tokens = np.array([known[x] for x in own], np.int64)
        counts += np.bincount(w.doc, weights=tokens[which], minlength=b - a).astype(np.int64).tolist() if len(own) else [0] * (b - a)
    return counts


def _encoder(tokenizer_json: str, by_words: bool):
    """Counts of (digest, norm) batches. The tokenizer is built once a task, from its text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer, known = None, {}
        for batch in batches:
            if tokenizer is None:
                tokenizer = Tokenizer.from_str(tokenizer_json)
                tokenizer.no_truncation()
                tokenizer.no_padding()
            if by_words:
                counts = _by_words(tokenizer, batch.column("norm"), known)
            else:
                counts = [len(tokenizer.encode_batch_fast([t], add_special_tokens=False)[0]) for t in batch.column("norm").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return count


def _exists(df: DataFrame, path: str) -> bool:
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(at)


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 2048) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    Null text counts as empty: 0 bytes, 0 tokens. Whole texts are encoded, without added special tokens, truncation or
    padding. Null ids and repeated rows are kept as they are. No rows give no rows. Other columns are not read. The cache
    at cache_path (on storage that all executors see) is made if absent and is shared by all tokenizers.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    tokenizer_json = Path(tokenizer_path).read_text(encoding="utf-8")
    version = hashlib.sha256(tokenizer_json.encode()).hexdigest()[:32]
    text = F.coalesce(F.col("text"), F.lit(""))
    by_words = drops_white_space(tokenizer_json)
    norm: Column = F.regexp_replace(text, SPACES, " ") if by_words else text
    docs = docs if placed(docs) else stage(docs.select("doc_id", "text"), "rows")
    place = F.xxhash64(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row")
    keyed = stage(docs.select("doc_id", *place, F.octet_length(text).cast("bigint").alias("n_bytes"), F.unhex(F.sha2(norm.cast("binary"), 256)).alias("digest")), "digests")
    held = stage(keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_file", "_row")).alias("first")), "distinct")
    schema = "digest binary, n_tokens bigint, tokenizer string"

    def cached() -> DataFrame:
        return spark.read.schema(schema).parquet(cache_path).filter(F.col("tokenizer") == version).select("digest", "n_tokens")

    misses = held
    if _exists(docs, cache_path):
        misses = stage(misses.join(cached(), "digest", "left_anti"), "misses")
    # one row of each missing digest is read again; texts are shuffled only if such rows are too many to be sent about
    wanted = small(misses.select("digest", "first._file", "first._row"), 64)
    found = docs.select(*place, norm.alias("norm")).join(wanted, ["_file", "_row"]).select("digest", "norm").mapInArrow(_encoder(tokenizer_json, by_words), "digest binary, n_tokens bigint")
    found.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    if not _exists(docs, f"{cache_path}/tokenizer={version}"):  # no text at all
        return keyed.select("doc_id", "n_bytes", F.lit(0).cast("bigint").alias("n_tokens"), F.lit(False).alias("over_limit"))
    counts = stage(held.select("digest", "n").join(cached().dropDuplicates(["digest"]), "digest"), "counts")
    return spread_join(keyed, counts, ["digest"], "n").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
