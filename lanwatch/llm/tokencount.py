"""Token counts from a digest cache.

The cache holds (content digest, tokenizer digest) -> count. Texts are joined with it by digest; only distinct
contents that it lacks are encoded, and their counts are appended.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.lineage import work_folder
from .common import exists, read, text_slices

LIMIT = 512
SLICE_BYTES = 8 << 20
CACHE = "content binary, tokenizer string, n_tokens long"


def content_digest(text: Column) -> Column:
    """Digest of the normalised content. Null becomes the empty text; nothing else may change, for any further
    folding (case, space, Unicode forms) would change the count of this tokenizer."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: digest of its file (a few MB) and of the options that change counts."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"|no added tokens, special strings by default").hexdigest()


def _byte_names() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the
    others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _byte_level(spec: dict) -> Callable[[str], int] | None:
    """A counter by tiktoken for a plain byte-level BPE, several times as fast as the general library."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
             and pre.get("use_regex", True) and model.get("type") == "BPE" and not model.get("dropout")
             and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
             and not model.get("end_of_word_suffix") and not model.get("byte_fallback"))
    added = spec.get("added_tokens") or []
    if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        return None
    import public_tokenizers
    import tiktoken
    names, specials = _byte_names(), {t["content"]: t["id"] for t in added}
    ranks = {bytes(names[c] for c in word): i for word, i in model["vocab"].items() if word not in specials}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(ids) or len(set(ids)) != len(ids):
        return None  # ranks would not be the order of merges
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=specials)
    return lambda text: len(encoding.encode(text, allowed_special="all"))


@lru_cache(maxsize=2)
def counter(path: str) -> Callable[[str], int]:
    """Tokens of a text by the library for the file: tokenizers for .json, sentencepiece for .model."""
    if path.endswith(".model"):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(model.encode(text))
    with open(path, encoding="utf-8") as f:
        fast = _byte_level(json.load(f))
    if fast:
        return fast
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """Cache rows of (content, text). `path` must be the same file on every executor."""
    version = tokenizer_digest(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for part in text_slices(batches, SLICE_BYTES):
            counts = [count(t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("content"), pa.array([version] * len(counts), pa.string()),
                                              pa.array(counts, pa.int64())], ["content", "tokenizer", "n_tokens"])

    return misses.select("content", "text").mapInArrow(run, CACHE)


def count_tokens(docs: DataFrame, path: str, cache: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of `docs`; misses are appended to the table at `cache`.

    Null and empty texts have no tokens. Repeated texts are encoded once. An empty table appends nothing. A
    run that dies while appending leaves no visible rows behind, and the next one encodes them again; a
    content stored twice by two runs at a time has equal counts and is read once. Other columns are ignored.
    """
    spark, version = docs.sparkSession, tokenizer_digest(path)
    texts = docs.select(content_digest(F.col("text")).alias("content"), "text").dropDuplicates(["content"])
    if exists(spark, f"{cache}/_SUCCESS"):
        texts = texts.join(spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version), "content", "left_anti")
    encode_misses(texts, path).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))
    rows = docs.select("doc_id", content_digest(F.col("text")).alias("content"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.join(stored, "content").select("doc_id", "n_bytes", "n_tokens")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    counts = count_tokens(read(spark, sf_dir, "documents"), path, work_folder(spark))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
