"""Spelling variant grouping: search schemes over a bidirectional FM-index of the delimited vocabulary.

Two words are near if one code point is inserted, deleted or replaced. Cut a word in two halves: a near word shares
the left half, the right half, or both. The first scheme matches the delimiter and the left half exactly and goes on
to the right with one error; the second matches the right half and the delimiter exactly and goes on to the left.
Both directions keep a pair of suffix-rank intervals in step.

Words are routed by their first three code points for the first scheme and by their last three for the second (no
half is shorter), so an index never holds the whole vocabulary. A crowded bucket is cut into parts: every slice of
its words searches every part of its index.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, read

RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # of UTF-8 in lower case: a-z and U+00C0 to U+00FF
HELD = 300_000            # counted words a task holds before it passes them on
INDEX_CHARS = 1 << 17     # code points of an index, on average
TABLE = 8 << 20           # entries of a table of counts; long texts get samples of it
SLIPS = 199
SHORTEST, RAREST, TIMES = 6, 5, 5
ROUTE = 3                 # code points that route a word; half of the shortest word


def tally(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of SHORTEST code points or more, slips applied. Null texts have no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                start = zlib.crc32(key.encode() + b":")
                for word, n in Counter(RUN.findall(text.as_buffer().to_pybytes().lower())).items():
                    h = zlib.crc32(word, start)
                    if h % SLIPS == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        word = (letters[:at] + letters[at + 1:]).encode()
                    if len(word) >= SHORTEST:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    rows = docs.where(F.col(text_col).isNotNull()).select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).cast("binary").alias("text"))
    return (rows.mapInArrow(run, "word string, n bigint").where(F.length("word") >= SHORTEST)
            .groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of all words that occur RAREST times or more."""
    return tally(docs).where(F.col("n") >= RAREST)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of `text` (codes; the last is the least and unique) in order, by doubling of their prefixes."""
    n = len(text)
    rank, k = text.astype(np.int64), 1
    while True:
        after = np.full(n, -1, np.int64)
        after[:n - k] = rank[k:] if k < n else 0
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.cumsum(np.append(0, ordered[1:] != ordered[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class _Ranks:
    """How many codes below c stand before place i of a Burrows-Wheeler text: full table, or samples and a count."""

    def __init__(self, bwt: np.ndarray, sigma: int):
        n = len(bwt)
        self.step = max(1, -(-n * sigma // TABLE))
        self.bwt, self.sigma = np.concatenate((bwt, np.zeros(self.step, bwt.dtype))), sigma
        blocks = n // self.step + 1
        counts = np.zeros((blocks + 1, sigma), np.int64)
        np.add.at(counts, (np.arange(n) // self.step + 1, bwt), 1)
        self.table = np.zeros((blocks, sigma + 1), np.int32)
        np.cumsum(np.cumsum(counts[:blocks], axis=0), axis=1, out=self.table[:, 1:])

    def below(self, i: np.ndarray) -> np.ndarray:
        """One row per place: for each c in 0..sigma the codes below c before the place."""
        rows = self.table[i // self.step]
        if self.step > 1 and len(i):
            offset = np.arange(self.step)
            inside = offset < (i % self.step)[:, None]
            state, at = np.nonzero(inside)
            codes = self.bwt[(i // self.step * self.step)[state] + at]
            extra = np.bincount(state * self.sigma + codes, minlength=len(i) * self.sigma).reshape(len(i), self.sigma)
            rows = rows.copy()
            rows[:, 1:] += np.cumsum(extra, axis=1).astype(np.int32)
        return rows


class Index:
    """Bidirectional FM-index of words, each between delimiters.

    A match is (lo, back, width): its suffixes' interval in the text's order begins at lo, that of the reversed match in
    the reversed text's order at back; both are `width` long.
    """

    END, MARK = 0, 1  # codes: end of text, delimiter; letters from 2

    def __init__(self, words: list[str]):
        joined = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.letters = np.unique(joined)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes + 1) - sizes  # of each word behind its delimiter
        text = np.full(int(sizes.sum()) + len(words) + 2, self.MARK, np.int64)
        inside = np.arange(len(joined)) + np.repeat(np.arange(len(words)) + 1, sizes)
        text[inside] = np.searchsorted(self.letters, joined) + 2
        text[-1] = self.END
        self.sigma = len(self.letters) + 2
        self.order = suffix_array(text)
        self.forward = _Ranks(text[self.order - 1], self.sigma)
        mirror = np.append(text[-2::-1], self.END)
        self.mirrored = _Ranks(mirror[suffix_array(mirror) - 1], self.sigma)
        self.less = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma))))
        self.starts, self.n = starts, len(text)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' codes one after another and their borders. A letter that the index lacks has code -1."""
        joined = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, joined), max(0, len(self.letters) - 1))
        codes = np.where(self.letters[at] == joined, at + 2, -1) if len(self.letters) else np.full(len(joined), -1)
        return codes, np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))

    def _children(self, left: bool, lo, back, width):
        """Below-counts at both ends of the interval on the side that grows."""
        ranks, base = (self.forward, lo) if left else (self.mirrored, back)
        return ranks.below(base), ranks.below(base + width)

    def extend(self, left: bool, lo, back, width, c):
        """Matches with code c (-1: none) put before (left) or behind them."""
        first, last = self._children(left, lo, back, width)
        row, known = np.arange(len(c)), c >= 0
        c = np.maximum(c, 0)
        low, high = first[row, c], last[row, c]
        occ = first[row, c + 1] - low
        size = np.where(known, last[row, c + 1] - high - occ, 0)
        moved, other = self.less[c] + occ, (back if left else lo) + high - low
        return (moved, other, size) if left else (other, moved, size)

    def branch(self, left: bool, lo, back, width):
        """All matches one letter longer: (state they came from, code, lo, back, width)."""
        first, last = self._children(left, lo, back, width)
        occ, size = np.diff(first, axis=1), np.diff(last, axis=1) - np.diff(first, axis=1)
        size[:, :2] = 0  # neither end nor delimiter
        state, c = np.nonzero(size)
        moved, other = self.less[c] + occ[state, c], (back if left else lo)[state] + last[state, c] - first[state, c]
        return (state, c, *((moved, other) if left else (other, moved)), size[state, c])

    def near(self, words: list[str], left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of every indexed word near a query that shares its right half (left: errors go there) or,
        with `left` false, its left half. Each once."""
        codes, borders = self.codes(words)
        sizes = np.diff(borders)
        half = sizes // 2  # code points of the left half
        ids = np.arange(len(words))
        exact, rest = (sizes - half, half) if left else (half, sizes - half)
        begin = borders[:-1]

        def letter(q, j):
            """Code j of the query in search order: from the delimiter over the exact half into the other."""
            return codes[begin[q] + (sizes[q] - 1 - j if left else j)]

        zero = np.zeros(len(words), np.int64)
        state = self.extend(left, zero, zero, np.full(len(words), self.n), np.full(len(words), self.MARK))
        q = ids
        for j in range(int(exact.max(initial=0))):
            more = np.flatnonzero(exact[q] > j)
            grown = self.extend(left, *(x[more] for x in state), letter(q[more], j))
            state = tuple(np.concatenate((np.delete(x, more), y)) for x, y in zip(state, grown))
            q = np.concatenate((np.delete(q, more), q[more]))
            q, state = self._alive(q, state)
        # clean: no error yet, before code `at` of the search order; slipped: one error made
        at = exact[q]
        slipped = (np.empty(0, np.int64), tuple(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.int64))
        done_q, done_lo = [], []
        clean = (q, state, at)
        while len(clean[0]) or len(slipped[0]):
            q, state, at = clean
            if len(q):
                came, c, *grown = self.branch(left, *state)
                open_ = at < sizes[q]
                own = np.where(open_, letter(q, np.minimum(at, sizes[q] - 1)), -1)
                other = c != own[came]
                replaced = other & open_[came]
                new = [(q[came], tuple(grown), at[came]),                                                # inserted
                       (q[came[replaced]], tuple(x[replaced] for x in grown), at[came[replaced]] + 1),  # replaced
                       (q[open_], tuple(x[open_] for x in state), at[open_] + 1)]                         # left out
                slipped = tuple(np.concatenate(x) if not isinstance(x[0], tuple) else tuple(map(np.concatenate, zip(*x)))
                                for x in zip(slipped, *new))
                same = np.flatnonzero(~other & open_[came])
                clean = (q[came[same]], tuple(x[same] for x in grown), at[came[same]] + 1)
            q, state, at = slipped
            if len(q):
                ready = at >= sizes[q]
                closed = self.extend(left, *(x[ready] for x in state), np.full(int(ready.sum()), self.MARK))
                found = closed[2] > 0
                done_q.append(q[ready][found])
                done_lo.append(closed[0][found])
                q, state, at = q[~ready], tuple(x[~ready] for x in state), at[~ready]
                state = self.extend(left, *state, letter(q, at)) if len(q) else state
                live = state[2] > 0
                slipped = (q[live], tuple(x[live] for x in state), at[live] + 1)
                slipped = self._once(*slipped)
        if not done_q:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        q, lo = np.concatenate(done_q), np.concatenate(done_lo)
        word = np.searchsorted(self.starts, self.order[lo] + 1)  # a match begins at the delimiter before its word
        pairs = np.unique(q * len(self.starts) + word)
        return pairs // len(self.starts), pairs % len(self.starts)

    @staticmethod
    def _alive(q, state):
        live = state[2] > 0
        return q[live], tuple(x[live] for x in state)

    def _once(self, q, state, at):
        """Equal states come about by different errors (a doubled letter); one of them goes on. Matches of different
        length may share one interval, but not both."""
        keys = (q, *state, at)
        order = np.lexsort(keys)
        keys = [x[order] for x in keys]
        new = np.ones(len(q), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in keys])
        q, *state, at = (x[new] for x in keys)
        return q, tuple(state), at


def _search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One part of an index against one slice of queries: per query its near words' number and the most frequent one."""
    side = table["asks"].to_numpy(zero_copy_only=False)
    left = key[0].as_py() == "tail"
    words = np.array(table["word"].to_pylist(), object)
    n = table["n"].to_numpy()
    asked, held = np.flatnonzero(side), np.flatnonzero(~side)
    q = w = np.empty(0, np.int64)
    if len(asked) and len(held):
        q, w = Index(words[held].tolist()).near(words[asked].tolist(), left)
    q, w = asked[q], held[w]
    if left:  # those that share the left half too are the first scheme's
        own = np.array([not b.startswith(a[:len(a) // 2]) for a, b in zip(words[q], words[w])], bool)
        q, w = q[own], w[own]
    place = np.empty(len(words), np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))  # code-point order
    order = np.lexsort((place[w], -n[w], q))
    q, w = q[order], w[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    return pa.Table.from_arrays([pa.array(words[q[first]], pa.string()), pa.array(np.diff(np.append(first, len(q))), pa.int64()),
                                 pa.array(words[w[first]], pa.string()), pa.array(n[w[first]], pa.int64())], ["word", "near", "best", "best_n"])


def near_words(words: DataFrame, index_chars: int = INDEX_CHARS) -> DataFrame:
    """(word, n_near, best, best_n): words with near ones, how many, and the most frequent (ties: least in code-point order).

    `words`: distinct (word, n), SHORTEST code points or more. Every word is sent to one bucket by its first and one by
    its last ROUTE code points; a bucket of more than `index_chars` is cut into parts, all of which its words search.
    """
    chars = words.agg(F.sum(F.length("word"))).first()[0] or 0
    buckets = max(1, math.ceil(chars / index_chars))
    ends = F.array(*(F.struct(F.lit(name).alias("scheme"), F.pmod(F.xxhash64(part), F.lit(buckets)).cast("int").alias("bucket"))
                     for name, part in (("head", F.left("word", F.lit(ROUTE))), ("tail", F.right("word", F.lit(ROUTE))))))
    routed = words.select("word", "n", F.explode(ends).alias("_at")).select("word", "n", "_at.*")
    sizes = routed.groupBy("scheme", "bucket").agg(F.ceil(F.sum(F.length("word")) / index_chars).cast("int").alias("parts"))
    sizes = cut(sizes)  # one row per bucket; as a table it has a size by which Spark joins it
    part, every = F.pmod(F.xxhash64("word"), "parts").cast("int"), F.sequence(F.lit(0), F.col("parts") - 1)

    def role(asks):
        return F.transform(every, lambda i: F.struct(F.lit(asks).alias("asks"), (i if asks else part).alias("part"), (part if asks else i).alias("slice")))
    dealt = routed.join(sizes, ["scheme", "bucket"]).select(
        "scheme", "bucket", "word", "n", F.explode(F.concat(role(False), role(True))).alias("_r")).select("scheme", "bucket", "word", "n", "_r.*")
    found = dealt.groupBy("scheme", "bucket", "part", "slice").applyInArrow(_search, "word string, near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best")))
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.minus")).alias("best_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by doubling of the steps.

    A form occurs at least TIMES as often as its word, so chains are short and have no cycle.
    """
    step = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut(step.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return step


def group(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of `docs` (doc_id, text).

    Null texts have no words and a null doc_id counts as empty text; repeated rows count again; other columns play no
    part; an empty table gives no rows. Runs of any length are handled whole.
    """
    words = cut(vocabulary(docs))
    near = cut(near_words(words))
    taken = F.col("best_n") >= TIMES * F.col("n")
    rows = cut(words.join(near, "word", "left").select(
        "word", F.when(taken, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(taken, F.col("best_n")).alias("form_n")))
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(read(spark, sf_dir, "documents"))
