"""Document fingerprints as threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range. Its size follows the document, so
sketches of very unequal documents can be compared (containment), and the sketch of a union is the union of
sketches. Shingles are runs of code points, so that a sentence has enough of them.

A short text may have no hash below the threshold. Its least hash, kept apart from the sketch, then stands for it in
fingerprints and likeness; it is no part of what is merged, but the least of several least hashes is that of the union.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, read, text_slices

LOG_SHINGLE = 4       # shingles of 2 ** 4 = 16 code points
SCALE = 16            # hashes below 2 ** 64 / SCALE are kept
BLOCK = 1 << 18       # code points hashed at once
SLICE_BYTES = 8 << 20

_BASE = 0x9E3779B97F4A7C15  # odd; the polynomial's base


def _hashes(points: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of all shingles: polynomials over 1, 2, 4 ... code points, each from two halves."""
    h, power = points.astype(np.uint64) + np.uint64(1), _BASE
    for step in range(LOG_SHINGLE):
        half = 1 << step
        h = h[:-half] * np.uint64(power) + h[half:]
        power = power * power % 2**64
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def sketch_of(text: str | None) -> tuple[np.ndarray, int | None]:
    """Sorted distinct hashes below the threshold, and the least hash of all. A text shorter than a shingle is padded
    to one. Null and empty: no hashes."""
    if not text:
        return np.empty(0, np.uint64), None
    width = 1 << LOG_SHINGLE
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(points) < width:
        points = np.concatenate((points, np.full(width - len(points), 0x110000, np.uint32)))
    kept, least = [], 2**64
    for i in range(0, len(points) - width + 1, BLOCK):
        h = _hashes(points[i:i + BLOCK + width - 1])
        kept.append(h[h < np.uint64(2**64 // SCALE)])
        least = min(least, int(h.min()))
    return np.unique(np.concatenate(kept)), least


def marks_of(text: str | None) -> np.ndarray:
    """The sketch, or the least hash alone where the sketch is empty: every text with a character has a mark."""
    sketch, least = sketch_of(text)
    return sketch if len(sketch) or least is None else np.array([least], np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller set of marks that the larger one holds; two empty ones are alike, an empty and another not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, sketch array<long>, least long) of every whole text; the unsigned hashes are stored as signed ones.

    `least` is the least hash, null where there is none: the mark of a text whose sketch is empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, SLICE_BYTES):
            found = [sketch_of(t) for t in part.column("text").to_pylist()]
            least = [None if v is None else v - 2**64 if v >= 2**63 else v for _, v in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array([h.view(np.int64) for h, _ in found], pa.list_(pa.int64())),
                                              pa.array(least, pa.int64())], ["doc_id", "sketch", "least"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, sketch array<long>, least long")


def merged(sketched: DataFrame, *by: str) -> DataFrame:
    """(by, hash): the sketch of the union of each group, as rows, so that no group is gathered.

    It equals the sketch of all shingles of the group's texts, whatever their lengths; a group without a hash below the
    threshold has no rows.
    """
    return sketched.select(*by, F.explode("sketch").alias("hash")).distinct()


def containment(part: Column, whole: Column) -> Column:
    """Estimated share of the shingles of `part` that are in `whole`, from two sketch columns. Empty sketch of the part: null."""
    return F.try_divide(F.size(F.array_intersect(part, whole)), F.size(part))


def fingerprint(marks: np.ndarray) -> str:
    return hashlib.sha256(marks.astype("<u8").tobytes()).hexdigest()


_OUT = "part int, edge string, doc_id long, n_chars long, text string, edited_sha256 string, fingerprint string, " \
       "edited_fingerprint string, near_edited double, near_next double"


def _compared(doc_id, text: str, marks: np.ndarray, following: str, following_marks: np.ndarray) -> tuple:
    n = len(text)
    edited = text[:n - n // 4] + following[:n // 4]
    other = marks_of(edited)
    return (doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), fingerprint(marks), fingerprint(other),
            likeness(marks, other), likeness(marks, following_marks))


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of a sorted partition with the next one. The first and the last row go out with their
    texts, to be compared across partitions."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("part", pa.int32()), ("edge", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("text", pa.string()),
                        ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                        ("near_edited", pa.float64()), ("near_next", pa.float64())])
    before, first = None, True
    for piece in text_slices(batches, SLICE_BYTES):
        rows = []
        for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
            text = text or ""
            now = (doc_id, text, marks_of(text))
            if first:
                rows.append((part, "first", doc_id, len(text), text, None, None, None, None, None))
                first = False
            if before:
                d, n, *rest = _compared(*before, now[1], now[2])
                rows.append((part, None, d, n, None, *rest))
            before = now
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    if before:
        row = (part, "last", before[0], len(before[1]), before[1], None, None, None, None, None)
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last quarter (code points, rounded down) replaced by the start of the next
    document, in ascending doc_id; the first follows the last. Null ids come first; equal ids are ordered by
    a hash of their texts. Null texts are empty. A single row follows itself; an empty table gives none.

    Rows are dealt by ranges of doc_id and streamed in order, so a task holds two texts at a time. The last
    row of a partition and the first of the next meet afterwards: two rows a partition.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    done = cut(ordered.mapInArrow(_stream, _OUT))
    edges = done.where("edge is not null").select("part", "edge", "doc_id", "text")
    firsts = edges.where("edge = 'first'").select("part", F.struct("part", F.col("text").alias("following")).alias("f"))
    order = Window.orderBy("part")  # one row for each partition of this table
    nexts = firsts.select("part", F.coalesce(F.lead("f").over(order), F.first("f").over(order))["following"].alias("following"))
    pairs = edges.where("edge = 'last'").join(nexts, "part").select("doc_id", "text", "following")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_compared(r["doc_id"], r["text"], marks_of(r["text"]), r["following"], marks_of(r["following"])) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])))
    last = pairs.mapInArrow(meet, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done.where("edge is null").select(*names).unionByName(last)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read(spark, sf_dir, "documents"))
