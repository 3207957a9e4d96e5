"""Language identification by compression.

One zstandard raw-content dictionary per language is filled with training text. A text is encoded with each
dictionary; the language whose dictionary gives the smallest output wins. Case is folded first. Long texts are encoded in blocks,
since a long stream would learn from itself and forget the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .common import cut, fresh, read, text_slices

DICT_DOCS = 200        # training documents per language that fill its dictionary: those with the least hash
DICT_EXCERPT = 512     # code points of each, from its middle, so that no long text fills a dictionary alone
DICT_BYTES = 96 << 10  # at most so many bytes a dictionary, and
ALL_BYTES = 64 << 20   # so many all together, in equal shares: every language is learned, however many there are
SPARE = 4              # times DICT_DOCS rows are ranked, so that no task ranks all rows of a language
BLOCK_BYTES = 4096     # encoded at once
MARGIN = 0.01          # smaller relative gaps between the best two languages are rejected
SLICE_BYTES = 8 << 20
#: Matches of four bytes count, as words of one language share short syllables; the default levels of this speed need five.
ENCODER = zstandard.ZstdCompressionParameters(window_log=19, chain_log=16, hash_log=17, search_log=3, min_match=4,
                                              strategy=zstandard.STRATEGY_GREEDY)

LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3 (a null id: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary bytes per language, from labelled documents that are not held out.

    The sample is bounded by the parameters above, whatever the size of `docs`: DICT_DOCS excerpts a language (fewer
    where so many languages share ALL_BYTES that these would not fit), of every language there is,
    chosen by a hash of the text, so that equal tables give equal dictionaries. Copies of a text count once.
    Texts that are null or empty and rows without a language teach nothing. No labelled row: an empty result.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id"))) \
        .select("lang", F.xxhash64("text").alias("h"), "text")
    texts = known.select("lang", "h").distinct()
    many = cut(texts.groupBy("lang").agg(F.count("*").alias("n")))
    languages = many.count()
    room = min(DICT_BYTES, ALL_BYTES // max(1, languages))
    docs_each = max(1, min(DICT_DOCS, -(-room // (DICT_EXCERPT // 2))))
    # the least hashes of a language lie below a limit that follows from its number of texts
    low = (F.col("h") / F.lit(2.0 ** 64) + 0.5) * F.col("n") < SPARE * docs_each + 64
    by_hash = Window.partitionBy("lang").orderBy("h")
    chosen = cut(texts.join(many, "lang").where(low).withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= docs_each).select("lang", "h", "r"))
    start = F.greatest(F.lit(1), F.floor((F.length("text") - DICT_EXCERPT) / 2).cast("int") + 1)
    piece = F.substring(F.col("text"), start, F.lit(DICT_EXCERPT))
    pieces = known.join(chosen, ["lang", "h"]).groupBy("lang", "r").agg(F.min(piece).alias("piece"))
    out: dict[str, list[str]] = {}
    for row in pieces.orderBy("lang", F.desc("r")).collect():  # ALL_BYTES and one excerpt a language at most
        out.setdefault(row.lang, []).append(row.piece)
    return {lang: "\n".join(p).lower().encode()[-room:] for lang, p in out.items()}


def compressors(dictionaries: dict[str, bytes]) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for lang, raw in sorted(dictionaries.items()):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=ENCODER)
    return out


def classify(text: str | None, encoders: dict[str, zstandard.ZstdCompressor]) -> tuple[str, float]:
    """(language, score) of one whole text.

    With m the relative gap between the two smallest outputs, the score is m / (m + MARGIN): 0 at a tie, 0.5
    where rejection begins, towards 1 for clear cases. Null, no letter or nothing learned: ('und', 0). A
    single learned language has no rival and gets score 1. Equal sizes: the first language by name.
    """
    if not text or not encoders or not LETTER.search(text):
        return "und", 0.0
    raw = text.lower().encode()
    blocks = [raw[i:i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
    sizes = sorted((sum(len(c.compress(b)) for b in blocks), lang) for lang, c in encoders.items())
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    gap = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], gap / (gap + MARGIN)


def identify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """`docs` with lang_pred, lang_score and lang_rejected appended (underscores added on clashing names).

    Only `text` is read for a prediction; every other column is passed on, and every row is kept. Rejected:
    'und', or a score below 0.5 (a gap between the best two languages narrower than MARGIN).
    """
    names = [fresh(docs, n) for n in ("lang_pred", "lang_score", "lang_rejected")]
    schema = T.StructType([*docs.schema, *(T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.DoubleType(), T.BooleanType())))])
    payload = dict(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = compressors(payload)
        for part in text_slices(batches, SLICE_BYTES):
            found = [classify(t, encoders) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.float64()),
                                              pa.array([f[1] < 0.5 for f in found], pa.bool_())],
                                             [*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
                      F.col("lang_rejected").alias("rejected"))
