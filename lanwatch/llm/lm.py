"""Scoring texts with a gated recurrent language model trained on the corpus.

Word counts cover all training documents. The network's vocabulary are the most frequent words; it learns from
all spans of the training texts, in tasks of bounded size whose weights are averaged round by round. Every whole text is scored, its state carried from window to window. Words outside the vocabulary cost
the network's probability of such a word times the word's own share among them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import gru
from .common import cut, read, text_slices

VOCABULARY = 2048      # words of the network, the end among them
COMMON = 1 << 16       # words whose counts travel to the tasks, at most; the others are joined. A word outside
                       # has less than 1 / COMMON of all tokens, so no key of that join is large
SPAN = 128             # tokens of a training span
ROUNDS = 3             # of training, with averaging after each; each span teaches in one of them
TASK_SPANS = 16384     # spans of a training task and round, on average; more spans make more tasks
AVERAGE_ROWS = 64      # weight vectors averaged in one group, level by level
SLICE_BYTES = 4 << 20


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 5 (a null id: not)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one after another, A-Z in lower case, and how many each text has. Null: none."""
    own = pa.array([t or "" for t in texts.to_pylist()], pa.large_string())  # a slice would be misread
    lists = pc.ascii_split_whitespace(pc.ascii_lower(own))
    words = lists.flatten()
    there = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return words.filter(pa.array(there)), np.bincount(owner[there], minlength=len(lists))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return text_slices(batches, SLICE_BYTES)


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, c) over all whole texts of `docs`; the end of a text is the empty token."""
    def run(batches):
        for part in _slices(batches):
            words, _ = tokens_of(part.column("text"))
            got = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([got.field("values").cast(pa.string()), pa.array([""])]),
                 pa.concat_arrays([got.field("counts"), pa.array([part.num_rows], pa.int64())])], ["token", "c"])

    return docs.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Lexicon:
    """The common words with their counts, and the totals. Index 0 is the end; the first `size` are the network's."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("c"), F.count("*")).first()
        self.n, self.v = int(total[0] or 0), int(total[1])
        # Counts by size, in steps of a sixteenth of an octave: a few hundred rows, whatever the corpus.
        step = F.floor(F.log2("c") * 16)
        sizes = counts.where("token <> ''").groupBy(step.alias("s")).count().orderBy(F.desc("s")).collect()
        least, taken = math.inf, 0
        for row in sizes:
            taken += row["count"]
            if taken >= COMMON:
                break
            least = row["s"]
        rows = counts.where((F.col("token") != "") & (step >= F.lit(least))).collect() if least < math.inf else []
        rows.sort(key=lambda r: (-r.c, r.token))
        end = counts.where("token = ''").first()
        self.words = [""] + [r.token for r in rows]
        self.counts = np.array([end.c if end else 0] + [r.c for r in rows], np.float64)
        self.size = min(VOCABULARY, len(self.words))
        inside = self.counts[:self.size]
        self.divisor = self.n + 0.5 * (self.v + 1)
        self.other = self.n - inside.sum()
        self.other_divisor = self.other + 0.5 * (self.v - int((inside > 0).sum()) + 1)

    def ids(self, words: pa.Array) -> np.ndarray:
        found = pc.index_in(words, value_set=pa.array(self.words, words.type))
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _with_ends(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts with an end after each, and the borders of the texts."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    borders = np.concatenate(([0], np.cumsum(sizes + 1)))
    out = np.zeros(borders[-1], np.int64)
    out[np.arange(len(ids)) + owner] = ids
    return out, borders


def training_spans(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(key, round, ids): all spans of all texts; the first id is what stands before the span.

    The key is a hash of doc_id, text and place, so neither files nor their order decide what is learned when, and
    equal texts have different keys and rounds. Rows without an id, and those that repeat an earlier row of their
    task, are told apart by their number in the table's layout, so that no crowd of them shares a key.
    """
    def run(batches):
        met: set[bytes] = set()
        for part in _slices(batches):
            words, sizes = tokens_of(part.column("text"))
            ids = lexicon.ids(words)
            ids, borders = _with_ends(np.where((ids < 0) | (ids >= lexicon.size), lexicon.size, ids), sizes)
            keys, rounds, spans = [], [], []
            for i, (text, doc_id, row) in enumerate(zip(*(part.column(c).to_pylist() for c in ("text", "doc_id", "row")))):
                name = xxhash.xxh64_digest((text or "").encode(), 0 if doc_id is None else doc_id % (1 << 64))
                name, again = name + bytes(8), doc_id is None or name in met
                met.add(name[:8])
                if again:
                    name = name[:8] + (row + 1).to_bytes(8, "big")
                for place in range(0, int(borders[i + 1] - borders[i]), SPAN):
                    key = xxhash.xxh64_intdigest(name + place.to_bytes(8, "big"))
                    at = int(borders[i]) + place
                    before = gru.END if place == 0 else ids[at - 1]
                    keys.append(key >> 1)
                    rounds.append(key % ROUNDS)
                    spans.append(np.append(before, ids[at:min(at + SPAN, int(borders[i + 1]))]).astype(np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rounds, pa.int32()), pa.array(spans, pa.list_(pa.int32()))],
                                                 ["key", "round", "ids"])

    return docs.select("text", F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row")).mapInArrow(run, "key long, round int, ids array<int>")


def _average(rows: DataFrame, tasks: int) -> DataFrame:
    """Weighted mean of (slot, name, weight, value) by name, AVERAGE_ROWS rows to a group, level by level."""
    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")  # one order of adding
        weights = np.array(table.column("weight").to_pylist(), np.float64)
        total = sum(w * np.frombuffer(v.as_py(), np.float32).astype(np.float64) for w, v in zip(weights, table.column("value")))
        return pa.table({"slot": pa.array([table.column("slot")[0].as_py() // AVERAGE_ROWS], pa.int64()),
                         "name": table.column("name").slice(0, 1), "weight": pa.array([weights.sum()]),
                         "value": pa.array([(total / weights.sum()).astype(np.float32).tobytes()], pa.binary())})

    while True:
        rows = rows.groupBy("name", F.floor(F.col("slot") / AVERAGE_ROWS)).applyInArrow(mean, "slot long, name string, weight double, value binary")
        if tasks <= AVERAGE_ROWS:
            return rows
        tasks = -(-tasks // AVERAGE_ROWS)


def train(docs: DataFrame, lexicon: Lexicon) -> gru.Model:
    """The network after ROUNDS rounds over the spans of `docs`; without spans it stays a unigram model."""
    model = gru.Model.new(lexicon.counts[:lexicon.size], lexicon.other)
    spans = cut(training_spans(docs, lexicon))
    per_round = {r["round"]: r["count"] for r in spans.groupBy("round").count().collect()}
    for number in range(ROUNDS):
        if not per_round.get(number):
            continue
        tasks = -(-per_round[number] // TASK_SPANS)
        start, size = model.w, model.size

        def run(batches, start=start, size=size):
            local = gru.Model(size, {k: v.copy() for k, v in start.items()})
            seen = local.train(ids for batch in batches for ids in batch.column("ids").to_pylist())
            if seen:
                slot, n = TaskContext.get().partitionId(), len(local.w)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot] * n, pa.int64()), pa.array(list(local.w), pa.string()), pa.array([float(seen)] * n),
                     pa.array([v.astype(np.float32).tobytes() for v in local.w.values()], pa.binary())], ["slot", "name", "weight", "value"])

        dealt = spans.where(F.col("round") == number).repartition(tasks, "key").sortWithinPartitions("key")
        weights = _average(dealt.mapInArrow(run, "slot long, name string, weight double, value binary"), tasks).collect()
        model = gru.Model(size, {r.name: np.frombuffer(r.value, np.float32).reshape(start[r.name].shape).copy() for r in weights})
    return model


def score(docs: DataFrame, counts: DataFrame, lexicon: Lexicon, model: gru.Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of `docs`, scores in log10.

    Null and empty texts consist of their end. Repeated rows are scored each. Words of the lexicon are settled
    in the task; each other word of a text is joined with its count, spread over all words.
    """
    size = model.size
    weights = model.w
    with np.errstate(divide="ignore"):
        base = np.log10((lexicon.counts + 0.5) / lexicon.divisor)
        other = np.log10((lexicon.counts + 0.5) / lexicon.other_divisor)
    other[:size] = 0.0
    lexicon_, known = lexicon, lexicon.counts > 0

    def run(batches):
        net, row = gru.Model(size, weights), TaskContext.get().partitionId() << 40
        for part in _slices(batches):
            words, sizes = tokens_of(part.column("text"))
            n = part.num_rows
            found = lexicon_.ids(words)
            ids, borders = _with_ends(found, sizes)
            owner = np.repeat(np.arange(n), sizes + 1)
            network = np.where((ids < 0) | (ids >= size), size, ids)
            logp = net.score([network[a:b] for a, b in zip(borders, borders[1:])]) / math.log(10)
            common = ids >= 0
            at, by = ids[common], owner[common]
            parts = [np.bincount(by, weights=v[at], minlength=n) for v in (base, other, known.astype(np.float64))]
            rows = np.arange(row, row + n)
            row += n
            rare = found < 0
            tail = pc.dictionary_encode(words.filter(pa.array(rare)))
            pair, count = np.unique(np.repeat(np.arange(n), sizes)[rare] * (len(tail.dictionary) + 1) + tail.indices.to_numpy(zero_copy_only=False), return_counts=True)
            whose, word = pair // (len(tail.dictionary) + 1), pair % (len(tail.dictionary) + 1)
            none, zeros = pa.nulls(len(pair), pa.int64()), np.zeros(len(pair))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((rows, rows[whose]))),
                pa.concat_arrays([pa.array([f" {r}" for r in rows.tolist()], pa.string()), tail.dictionary.take(pa.array(word)).cast(pa.string())]),
                pa.array(np.concatenate((np.zeros(n, np.int64), count))),
                pa.concat_arrays([part.column("doc_id").cast(pa.int64()), none]),
                pa.array(np.concatenate((sizes + 1, np.zeros(len(pair), np.int64)))),
                pa.array(np.concatenate((parts[2], zeros)).astype(np.int64)),
                pa.array(np.concatenate((parts[0], zeros))),
                pa.array(np.concatenate((parts[1] + logp, zeros)))],
                ["row", "token", "n", "doc_id", "n_tokens", "n_known", "base", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(
        run, "row long, token string, n long, doc_id long, n_tokens long, n_known long, base double, score double")
    c = F.coalesce("c", F.lit(0))
    joined = rows.join(counts, "token", "left").select(
        "row", "doc_id", "n_tokens", (F.col("n_known") + F.when(c > 0, F.col("n")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("n") * F.log10((c + 0.5) / F.lit(lexicon.divisor))).alias("base"),
        (F.col("score") + F.col("n") * F.log10((c + 0.5) / F.lit(lexicon.other_divisor))).alias("score"))
    return joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
                                     F.sum("base").alias("base_score"), F.sum("score").alias("score")).drop("row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    taught = docs.where(~held_out(F.col("doc_id")))
    counts = cut(word_counts(taught))
    lexicon = Lexicon(counts)
    scored = score(docs, counts, lexicon, train(taught, lexicon))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
                         F.lit(lexicon.n).cast("long").alias("train_tokens"), "base_score", "score")
