"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

The distinct words of a batch are concatenated and indexed by a suffix array. Every piece of the vocabulary is
searched in it, which gives all its occurrences: the edges. Sorted by position they form a table (start,
length) -> piece, over which the words are relaxed: the adjacent pair that is the best edge is merged first, the
leftmost of equals, until no edge spans a pair. Words are runs of spaces with what follows them; no piece of such
a vocabulary reaches past a word, which is checked.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import fresh, read, text_slices

SPACE = "▁"
INDEX_BYTES = 256 << 10   # words indexed at once. One longer word is not indexed: its pieces are looked up
SHORT = 64                # bytes; longer words are relaxed with a queue instead of in rounds over all words
CACHE_WORDS = 200_000     # encoded words kept by a task, and
CACHE_BYTES = 4 << 20     # their bytes; the cache starts anew beyond either
SLICE_BYTES = 1 << 20     # of text, encoded and decoded at once; a longer text is encoded in parts
SLICE_IDS = 1 << 19       # decoded at once
NONE = np.int32(2**31 - 1)
WORD = re.compile(rb" *[^ ]+| +")
CUT = re.compile(rb"[^ ](?= )")


class Vocabulary:
    """The pieces of a model file, as bytes with plain spaces."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of = [b""] * n
        byte_ids, plain = {}, []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                byte_ids[value], self.bytes_of[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                plain.append(i)
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        if any(b" " in self.bytes_of[i].lstrip(b" ") for i in plain):
            raise ValueError("a piece holds a space after other characters")
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int32)
        self.ids = np.array(plain, np.int32)
        raw = [self.bytes_of[i] for i in plain]
        self.sizes = np.array([len(b) for b in raw], np.int64)
        self.longest = int(self.sizes.max())
        self.width = -(-self.longest // 8) * 8
        self.low = np.array(raw, f"S{self.width}")
        self.high = np.array([b + b"\xff" * (self.width - len(b)) for b in raw], f"S{self.width}")
        order = sorted({sp.get_score(i) for i in plain}, reverse=True)
        place = {score: k for k, score in enumerate(order)}
        self.rank = np.full(n + 1, NONE, np.int32)  # the last: no piece
        for i in plain:
            self.rank[i] = place[sp.get_score(i)]
        self.none = n
        self.id_of = {self.bytes_of[i]: i for i in plain}
        sizes = np.fromiter(map(len, self.bytes_of), np.int64, n)
        self.piece_size, self.piece_start = sizes, np.cumsum(sizes) - sizes
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def edges(self, text: np.ndarray) -> np.ndarray:
        """Table (position, length) -> piece id, or `none`, of all occurrences of pieces in `text` (bytes)."""
        n = len(text)
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((text, np.zeros(self.width, np.uint8))), self.width)[:n]
        keys = np.ascontiguousarray(windows).view(">u8").astype(np.uint64)
        suffixes = np.argsort(keys[:, 0], kind="stable")
        head = keys[suffixes, 0]
        tied = np.append(False, head[1:] == head[:-1])
        tied |= np.append(tied[1:], False)
        again = suffixes[tied]  # equal in eight bytes: the rest decides, group by group
        suffixes[tied] = again[np.lexsort((*keys[again, 1:].T[::-1], keys[again, 0]))]
        ordered = np.ascontiguousarray(windows[suffixes]).view(f"S{self.width}").ravel()
        first = np.searchsorted(ordered, self.low, "left")
        count = np.searchsorted(ordered, self.high, "right") - first
        piece = np.repeat(np.arange(len(count)), count)
        inside = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        start = suffixes[first[piece] + inside]
        table = np.full((n, self.longest + 1), self.none, np.int32)  # a counting sort by position and length
        table.ravel()[start * (self.longest + 1) + self.sizes[piece]] = self.ids[piece]
        return table

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all words one after another, and how many each has."""
        found, first, size = [], 0, 0
        for k, word in enumerate(words):
            if size + len(word) > INDEX_BYTES and k > first:
                found.append(self._encode(words[first:k]))
                first, size = k, 0
            size += len(word)
        if words:
            found.append(self._encode(words[first:]))
        return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in ([f[0] for f in found], [f[1] for f in found]))

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(words) == 1 and len(words[0]) > INDEX_BYTES:
            ids = self._long(words[0])
            return ids, np.array([len(ids)])
        text = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        table = self.edges(text)
        starts = np.flatnonzero((text & 0xC0) != 0x80)
        owner = np.searchsorted(ends, starts, "right")
        short = sizes[owner] <= SHORT
        s, e = self._rounds(table, starts[short], owner[short], ends)
        got = [(s, e)]
        for k in np.flatnonzero(sizes > SHORT):
            got.append(self._heap(table, starts[owner == k], int(ends[k])))
        s = np.concatenate([g[0] for g in got])
        e = np.concatenate([g[1] for g in got])
        order = np.argsort(s, kind="stable")
        s, e = s[order], e[order]
        length = e - s
        ids = np.where(length <= self.longest, table[s, np.minimum(length, self.longest)], self.none)
        unknown = ids == self.none
        if unknown.any():  # characters without a piece: their bytes
            reps = np.where(unknown, length, 1)
            at = np.repeat(s, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            ids = np.where(np.repeat(unknown, reps), self.byte_ids[text[at]], np.repeat(ids, reps)).astype(np.int32)
            s = at
        return ids, np.diff(np.append(np.searchsorted(s, ends - sizes), len(ids)))

    def _rounds(self, table, starts, owner, ends):
        """Relax all short words together: a round merges the best pair of each word that has one."""
        done_s, done_e = [], []
        s, g = starts, owner
        e = np.append(s[1:], 0)
        if len(s):
            last = np.append(g[1:] != g[:-1], True)
            e[last] = ends[g[last]]

        def ranks(i):
            length = e[i + 1] - s[i]
            known = (g[i] == g[i + 1]) & (length <= self.longest)
            return np.where(known, self.rank[table[s[i], np.where(known, length, 0)]], NONE)

        pair = np.append(ranks(np.arange(len(s) - 1)), NONE).astype(np.int32) if len(s) else np.empty(0, np.int32)
        while len(s):
            heads = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
            best = np.minimum.reduceat(pair, heads)
            sizes = np.diff(np.append(heads, len(s)))
            live = np.repeat(best != NONE, sizes)
            if not live.all():
                done_s.append(s[~live])
                done_e.append(e[~live])
                s, e, g, pair, best = s[live], e[live], g[live], pair[live], best[best != NONE]
                if not len(s):
                    break
                heads = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                sizes = np.diff(np.append(heads, len(s)))
            at = np.flatnonzero(pair == np.repeat(best, sizes))
            at = at[np.append(True, g[at[1:]] != g[at[:-1]])]  # the leftmost of equals
            e[at] = e[at + 1]
            keep = np.ones(len(s), bool)
            keep[at + 1] = False
            s, e, g, pair = s[keep], e[keep], g[keep], pair[keep]
            at = at - np.arange(len(at))
            change = np.concatenate((at, at[at > 0] - 1))
            inner = change[change < len(s) - 1]
            pair[inner] = ranks(inner)
            pair[-1] = NONE
        return (np.concatenate(done_s), np.concatenate(done_e)) if done_s else (np.empty(0, np.int64), np.empty(0, np.int64))

    def _heap(self, table, starts, end):
        """Relax one long word with a queue of pairs."""
        def rank(i, j):
            return int(self.rank[table[i, j - i]])

        begin = int(starts[0])
        s, e = self._relax(starts - begin, int(end) - begin, lambda i, j: rank(begin + i, begin + j))
        return s + begin, e + begin

    def _relax(self, starts: np.ndarray, end: int, rank) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the pieces of one word whose code points begin at `starts` (from 0).

        A node is the place where it begins; a queue entry packs rank, place and length of a pair into one number, so
        that a word takes some 60 bytes a byte.
        """
        stop, before = array("l", bytes(8 * (end + 1))), array("l", bytes(8 * (end + 1)))  # stop 0: no node (any more)
        places = starts.tolist()
        for i, j in zip(places, [*places[1:], end]):
            stop[i], before[j] = j, i
        del places

        def entry(i: int) -> int:
            """The pair of the node at i and the next one, or -1."""
            j = stop[i]
            if j == end:
                return -1
            k = stop[j]
            if k - i > self.longest:
                return -1
            r = rank(i, k)
            return -1 if r == NONE else (r << 48) | (i << 8) | (k - i)

        if self.longest > 255 or end >= 1 << 40:
            raise ValueError("pieces of over 255 bytes")
        queue = [x for x in map(entry, starts.tolist()) if x >= 0]
        heapq.heapify(queue)
        while queue:
            x = heapq.heappop(queue)
            i, k = (x >> 8) & ((1 << 40) - 1), x & 255
            k += i
            j = stop[i]
            if not j or j == end or stop[j] != k:
                continue  # one of the two is part of a longer piece by now
            stop[i], stop[j] = k, 0
            before[k] = i
            for node in ((i, before[i]) if i else (i,)):
                x = entry(node)
                if x >= 0:
                    heapq.heappush(queue, x)
        ends = np.frombuffer(stop, np.int64)[:end]
        s = np.flatnonzero(ends)
        return s, ends[s]

    def _long(self, word: bytes) -> np.ndarray:
        """Ids of one very long word. A table of its edges would take 100 bytes a byte, so each is looked up."""
        text = np.frombuffer(word, np.uint8)

        def rank(i, j):
            return int(self.rank[self.id_of.get(word[i:j], self.none)])

        s, e = self._relax(np.flatnonzero((text & 0xC0) != 0x80), len(word), rank)
        ids: list[np.ndarray] = []
        for at in range(0, len(s), SLICE_IDS):
            part = []
            for i, j in zip(s[at:at + SLICE_IDS].tolist(), e[at:at + SLICE_IDS].tolist()):
                known = self.id_of.get(word[i:j])
                part.extend(self.byte_ids[text[i:j]].tolist() if known is None else (known,))
            ids.append(np.array(part, np.int32))
        return np.concatenate(ids)

    def raw(self, ids: np.ndarray, borders: np.ndarray) -> list[bytes]:
        """Bytes of the pieces of each list of ids; unknown ids give nothing."""
        ids = np.asarray(ids, np.int64)
        known = (ids >= 0) & (ids < self.none)
        ids = np.where(known, ids, 0)
        sizes = np.where(known, self.piece_size[ids], 0)
        ends = np.cumsum(sizes)
        at = np.repeat(self.piece_start[ids] - (ends - sizes), sizes)
        at += np.arange(len(at))
        data, cuts = self.all_bytes[at].tobytes(), np.append(0, ends)[borders]
        return [data[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts, keeping the ids of words it has met."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0  # bytes
        self.ids, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts one after another, and where each text's begin (with the end of the last)."""
        if len(texts) == 1 and texts[0] and len(texts[0]) > SLICE_BYTES:
            ids = np.concatenate([self._encode([WORD.findall(part)])[0] for part in _parts((" " + texts[0].replace(SPACE, " ")).encode())])
            return ids, np.array([0, len(ids)])
        return self._encode([WORD.findall((" " + t.replace(SPACE, " ")).encode()) if t else [] for t in texts])

    def _encode(self, split: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        words = list(chain.from_iterable(split))
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self._forget()
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.held += sum(map(len, new))
            ids, count = self.vocab.encode_words(new)
            self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(count) - count))
            self.count = np.concatenate((self.count, count))
            self.ids = np.concatenate((self.ids, ids))
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        count = self.count[at]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.start[at] - (ends - count), count) + np.arange(count.sum())]
        borders = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)))
        return ids, np.concatenate(([0], np.append(0, ends)[borders]))


def _parts(data: bytes) -> Iterator[bytes]:
    """`data` in parts of about SLICE_BYTES, cut where a word (spaces and what follows) begins."""
    start = 0
    while start < len(data):
        found = CUT.search(data, start + SLICE_BYTES)
        stop = found.end() if found else len(data)
        yield data[start:stop]
        start = stop


def decode_ids(vocab: Vocabulary, ids) -> str:
    """The text of piece ids; broken byte sequences become U+FFFD, unknown and control ids nothing."""
    return _text(vocab.raw(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0])


def _text(raw: bytes) -> str:
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, model: str, name: str = "piece_ids", check: str | None = None) -> DataFrame:
    """`docs` with the piece ids of every whole text appended as array<int>; all rows and columns are kept.

    Null and empty texts have no ids. U+2581 counts as a space, as in the library. Ids are those of the
    library, without begin or end. `model`: path of a BPE model file, at the same place on every executor.
    With `check`, a boolean column of that name follows: whether decoding the ids gives the text back (null: as empty),
    found in the same pass. Ties between equal pieces go to the left; repeated rows are encoded each; an empty table
    stays empty; where `docs` has a column of a new name already, underscores are added to the new one. Texts of any
    length pass, in parts; a word of any length too, at some 60 bytes of memory a byte.
    """
    name = fresh(docs, name)
    fields = [T.StructField(name, T.ArrayType(T.IntegerType()))]
    if check:
        fields.append(T.StructField(fresh(docs, check), T.BooleanType()))
    schema = T.StructType([*docs.schema, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        encoder = Encoder(vocab)
        for part in text_slices(batches, SLICE_BYTES):
            texts = part.column("text").to_pylist()
            ids, borders = encoder.encode(texts)
            new = [pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(ids, pa.int32()))]
            if check:
                new.append(pa.array([_text(raw) == (t or "").replace(SPACE, " ") for raw, t in zip(vocab.raw(ids, borders), texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str, ids: str = "piece_ids", name: str = "decoded") -> DataFrame:
    """`encoded` with the text of column `ids` appended. Null ids give null; no ids the empty text. SLICE_IDS ids are
    decoded at once (one longer list alone); empty tables and clashing names as in `encode`."""
    name = fresh(encoded, name)
    schema = T.StructType([*encoded.schema, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model)
        for batch in batches:
            lists = batch.column(ids)
            sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.empty(0, np.int64)
            start = 0
            while start < len(lists):
                stop = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), SLICE_IDS, "right")))
                part = lists.slice(start, stop - start)
                flat = part.flatten()  # without those of null lists
                borders = np.concatenate(([0], np.cumsum(np.where(part.is_valid().to_numpy(zero_copy_only=False), sizes[start:stop], 0))))
                raw = vocab.raw(flat.fill_null(-1).to_numpy(zero_copy_only=False), borders)
                texts = pa.array([_text(r) if there.as_py() else None for r, there in zip(raw, part.is_valid())], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.slice(start, stop - start).columns, texts], [*batch.schema.names, name])
                start = stop

    return encoded.mapInArrow(run, schema)


def summary(checked: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids, comma-joined) and whether decoding gave the text back."""
    return checked.select("doc_id", F.size("piece_ids").cast("long").alias("n_pieces"),
                          F.sha2(F.array_join(F.col("piece_ids").cast("array<string>"), ","), 256).alias("ids_sha256"), "round_trip")


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    model = model or default_model()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return summary(encode(docs, model, check="round_trip"))
