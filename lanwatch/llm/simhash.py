"""SimHash near-duplicates by multi-index hashing.

A fingerprint is split into segments. Two fingerprints that differ in few bits must be very near in one
segment, so every fingerprint asks the segment tables for all values in a small Hamming ball around its own
and the complete distance of each match is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, fresh, read, small, text_slices
from .components import components

SHINGLE = 3          # words in a shingle
SEED = 42            # of XXH64
RADIUS = 2           # differing bits of a link
CROWDED = 64         # fingerprints with one segment value; beyond it, links are found by ball keys instead
SLICE_BYTES = 8 << 20
BLOCK = 1 << 16      # shingles hashed at once, which bounds the bit matrix of a very long text


def fingerprint_of(text: str | None, words: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one text, as an unsigned number; no words: zero."""
    tokens = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    lo, hi = starts[:n].tolist(), ends[len(ends) - n:].tolist()
    counts = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        digests = b"".join([xxhash.xxh64_digest(joined[s:e], SEED) for s, e in zip(lo[i:i + BLOCK], hi[i:i + BLOCK])])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for part in text_slices(batches, SLICE_BYTES):
        prints = np.array([fingerprint_of(t, words) for t in part.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("h"), pa.array(prints.view(np.int64))],
                                         ["doc_id", "h", "fp"])


def fingerprints(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, h, fp): a hash of the text to tell rows apart, and a 64-bit SimHash of the lower-cased word shingles of every whole text, repeats counted.

    Null and empty texts have fingerprint zero; a text shorter than a shingle is one shingle. Other columns
    of `docs` are not read. Repeated rows give repeated rows.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(lambda it: _fingerprints(it, words), "doc_id long, h long, fp long")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _segments(fp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(value: Column, bits: int) -> Column:
    """The value itself and all values that differ from it in one of the lowest `bits` bits."""
    flips = F.array(*[F.lit(0).cast("long")], *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(bits)])
    return F.transform(flips, lambda flip: value.bitwiseXOR(flip))


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column fp, such that fingerprints within RADIUS bits of
    each other are connected.

    Two segments of 32 bits. If two bits at most differ, then either the high segments differ in one bit at
    most or the low segments are equal; so 33 values of the high segment and one of the low are looked up,
    34 probes a fingerprint, and matches are verified over all 64 bits.

    Segment values of more than CROWDED fingerprints would give all pairs of a large group. Fingerprints that
    probe one are linked by ball keys instead, exactly: two fingerprints are within two bits if and only if
    some 64-bit value lies within one bit of both. Each hands its 65 such values out, and all with a value
    are linked to the least of them (they are within two bits of each other, at most 65 to a value).
    """
    high, low = _segments(F.col("fp"))
    table = prints.select("fp").distinct().select("fp", F.explode(F.array(
        F.struct(F.lit(0).alias("seg"), high.alias("val")), F.struct(F.lit(1).alias("seg"), low.alias("val")))).alias("s")) \
        .select("fp", "s.seg", "s.val")
    table = cut(table)
    crowded = cut(table.groupBy("seg", "val").count().where(F.col("count") > CROWDED).select("seg", "val"))
    probes = table.where("seg = 0").select(F.col("fp").alias("p"), "seg", F.explode(_ball(F.col("val"), 32)).alias("val")) \
        .unionByName(table.where("seg = 1").select(F.col("fp").alias("p"), "seg", "val"))
    sparse = table.join(crowded, ["seg", "val"], "left_anti")
    matches = probes.join(sparse, ["seg", "val"]).where((F.col("p") < F.col("fp")) & (_distance(F.col("p"), F.col("fp")) <= RADIUS)) \
        .select(F.col("p").alias("a"), F.col("fp").alias("b"))
    dense = probes.join(crowded, ["seg", "val"], "left_semi").select("p").distinct()
    keys = dense.select(F.col("p").alias("b"), F.explode(_ball(F.col("p"), 64)).alias("key"))
    least = keys.groupBy("key").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("a <> z").select("key", "a")
    near = keys.join(least, "key").where((F.col("a") != F.col("b")) & (_distance(F.col("a"), F.col("b")) <= RADIUS)).select("a", "b")
    return matches.unionByName(near).distinct()


def near_duplicates(prints: DataFrame) -> DataFrame:
    """(doc_id, h, fp, component_id, root) of every row of fingerprints(): the least doc_id reachable over links of RADIUS bits.

    Equal fingerprints are one node, so a group of copies costs a map-side reduced minimum and no pairs.
    Null doc_ids take part in linking; a component that has no other id has component_id null. An empty
    table gives an empty table.
    """
    prints = cut(prints)
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    groups = components(links(prints)).withColumnRenamed("node", "fp")
    rooted = nodes.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id", "root")
    return prints.join(classes, "fp").select("doc_id", "h", "fp", "component_id", "root")


# Near copies: texts whose sets of SIMILAR_WORDS-word shingles have a similarity of SIMILAR / WHOLE or more.
SIMILAR_WORDS = 5
SIMILAR, WHOLE = 4, 5
ORDER_EVERY, ORDER_LEAST = 8, 4  # shingles met so often in one node of so many count as common; see _common()
COMMON = 1 << 17                 # common shingles that travel to the tasks, at most
WORD_CACHE = 200_000
IDS = 1 << 21       # rows of ids (some 50 bytes) that travel to the executors, so that texts need no shuffle to be picked; more are joined
SLOT = 32           # texts of either side that a comparing task holds at once
SEEN = 1 << 20      # ids that a task remembers, to hand out the shingles of copies once
SHINGLES = 1 << 20  # the same for shingles that several sets have
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def similar_shingles(tokens: list[bytes]) -> set[bytes]:
    n = max(1, len(tokens) - SIMILAR_WORDS + 1) if tokens else 0
    return {b" ".join(tokens[i:i + SIMILAR_WORDS]) for i in range(n)}


def shingle_hashes(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of similar_shingles(), put together from hashes of the words."""
    tokens = (text or "").encode().lower().split()
    for t in set(tokens).difference(known):
        known[t] = xxhash.xxh64_intdigest(t, SEED)
    words = np.array([known[t] for t in tokens], np.uint64)
    n = max(1, len(words) - SIMILAR_WORDS + 1) if len(words) else 0
    out = np.zeros(n, np.uint64)
    for k in range(min(SIMILAR_WORDS, len(words))):
        out = (out ^ (out >> np.uint64(31))) * _MIX[0] + words[k:k + n] * _MIX[k]
    out = (out ^ (out >> np.uint64(29))) * _MIX[2]
    return np.unique((out ^ (out >> np.uint64(32))).view(np.int64))


_MARKS = [f"m{k}" for k in range(8)]  # bits of the hashes in a set


def _bits(hashes: np.ndarray) -> bytes:
    """A bit for each value that the low bits of the hashes take, two to four bits a hash (64 at least).

    Half the size are both halves laid upon each other, so sets of different sizes can be compared.
    """
    out = np.zeros(max(64, 1 << (2 * len(hashes)).bit_length()), np.uint8)
    out[hashes & (len(out) - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _may_be_similar(a: tuple[int, bytes], b: tuple[int, bytes]) -> bool:
    """Whether two sets, given by sizes and _bits(), can be similar: each bit that only one has is a shingle that only it has."""
    x, y = (np.frombuffer(bits, np.uint64) for _, bits in (a, b))
    while len(x) > len(y):
        x = x[:len(x) // 2] | x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] | y[len(y) // 2:]
    shared = min(a[0] - int(np.bitwise_count(x & ~y).sum()), b[0] - int(np.bitwise_count(y & ~x).sum()))
    return shared * (SIMILAR + WHOLE) >= (a[0] + b[0]) * SIMILAR


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray]]:
    """Slices of batches with a column `text`, the sets of their texts, and the ids of the sets."""
    known: dict[bytes, int] = {}
    for batch in batches:
        for part in text_slices([batch], SLICE_BYTES):
            if len(known) > WORD_CACHE:
                known = {}
            sets = [shingle_hashes(t, known) for t in part.column("text").to_pylist()]
            yield part, sets, np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, sets, ids in _sets(batches):
        marks = np.zeros((len(sets), 64 * len(_MARKS)), np.uint8)
        marks[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets) & (marks.shape[1] - 1)] = 1
        marks = np.packbits(marks, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").cast(pa.int64()), part.column("h"), part.column("k"), pa.array(ids),
             pa.array([len(s) for s in sets], pa.int32()), *(pa.array(marks[:, k].copy()) for k in range(len(_MARKS))),
             pa.array(map(_bits, sets), pa.binary())],
            ["doc_id", "h", "k", "id", "n", *_MARKS, "bits"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, sets, _ in _sets(batches):
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], ["sh"])


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of common shingles, counted in one text of ORDER_EVERY; the most common ones, COMMON at most.

    They only order the shingles of a set. Any order that is the same for all sets gives all pairs; a good one
    puts the shingles that many sets share last, so that few sets meet for nothing.
    """
    counts = cut(texts.where(F.pmod("h", F.lit(ORDER_EVERY)) == 0).select("text").mapInArrow(_shingles, "sh long").groupBy("sh").count()
                 .where(F.col("count") >= ORDER_LEAST))
    step = F.floor(F.log2("count") * 16)
    least, taken = None, 0
    for row in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect():
        taken += row.n
        if taken > COMMON:
            break
        least = row.s
    rows = [] if least is None else sorted((r.sh, r["count"]) for r in counts.where(step >= least).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _prefixes(texts: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(sh, id, n, pos): the rarest shingles of each set, so many that similar sets share one of them.

    Sets of n and more shingles that are similar to one of n have at least ceil(n * SIMILAR / WHOLE) shingles in
    common with it, so not all the others and one more can be missing. Copies in one task come once.
    """
    hashes, counts = common

    def run(batches):
        seen: set[int] = set()
        for _, sets, ids in _sets(batches):
            if len(seen) > SEEN:
                seen = set()
            new = []
            for i, id_ in enumerate(ids.tolist()):
                if id_ not in seen and len(sets[i]):
                    seen.add(id_)
                    new.append(i)
            if not new:
                continue
            sizes, flat = np.array([len(sets[i]) for i in new]), np.concatenate([sets[i] for i in new])
            weight = np.zeros(len(flat), np.int64)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
                weight = np.where(hashes[at] == flat, counts[at], 0)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((flat, weight, owner))
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            first = pos < (sizes + (-sizes * SIMILAR) // WHOLE + 1)[owner]  # - ceil(x) is floor(- x)
            by = owner[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[order][first]), pa.array(ids[new][by]), pa.array(sizes[by].astype(np.int32)), pa.array(pos[first].astype(np.int32))],
                ["sh", "id", "n", "pos"])

    return texts.select("text").mapInArrow(run, "sh long, id long, n int, pos int")


def _possible() -> Column:
    """Whether sets a and b can be similar that share the shingle at places pos_a and pos_b of their orders."""
    shared = F.least("pos_a", "pos_b") + 1 + F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) - 1
    return shared.cast("long") * (SIMILAR + WHOLE) >= (F.col("n_a").cast("long") + F.col("n_b")) * SIMILAR


def _first() -> Column:
    """Whether sets a and b can be similar if the shingle at places pos_a and pos_b is the first of those they share.

    Then all they share is at that place or behind. Similar sets pass at the first one, so a pair needs no other.
    """
    behind = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    return behind.cast("long") * (SIMILAR + WHOLE) >= (F.col("n_a").cast("long") + F.col("n_b")) * SIMILAR


def _unlike() -> Column:
    """Whether the marks prove that a and b are not similar: each mark that only one has is a shingle that only it has."""
    def alone(x, y):
        return sum((F.bit_count(F.col(f"{m}_{x}").bitwiseAND(F.bitwise_not(F.col(f"{m}_{y}")))) for m in _MARKS), F.lit(0))

    shared = F.least(F.col("n_a") - alone("a", "b"), F.col("n_b") - alone("b", "a"))
    return shared.cast("long") * (SIMILAR + WHOLE) < (F.col("n_a").cast("long") + F.col("n_b")) * SIMILAR


def _pairs(rows: Iterator[tuple], alike) -> Iterator[pa.RecordBatch]:
    """(slot, id, what is compared, ids to compare it with) in order of the slots -> the pairs (sh, a, b) that are alike."""
    current, held, asked = None, {}, {}

    def found():
        out = [(current[0], a, b) for b, partners in asked.items() for a in partners if a in held and b in held and alike(held[a], held[b])]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in range(3)], ["sh", "a", "b"])

    for slot, id_, what, partners in rows:
        if slot != current:
            if asked:
                yield found()
            current, held, asked = slot, {}, {}
        held[id_] = what
        if partners:
            asked[id_] = partners
    if asked:
        yield found()


_SLOT = ["sh", "p", "q"]


def _by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for part in batches:
            sh, p, q, *rest, n, bits = (part.column(c).to_pylist() for c in (*_SLOT, "id", "partners", "n", "bits"))
            yield from zip(zip(sh, p, q), rest[0], zip(n, bits), rest[1])

    return _pairs(rows(), _may_be_similar)


def _by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for part, sets, ids in _sets(batches):
            slots = zip(*(part.column(c).to_pylist() for c in _SLOT))
            for slot, want, id_, words, partners in zip(slots, part.column("id").to_pylist(), ids.tolist(), sets, part.column("partners").to_pylist()):
                if want == id_:  # else another text with the same hash
                    yield slot, id_, words, partners

    def similar(x, y):
        return len(np.intersect1d(x, y, assume_unique=True)) * (SIMILAR + WHOLE) >= (len(x) + len(y)) * SIMILAR

    return _pairs(rows(), similar)


def _meeting(pairs: DataFrame) -> DataFrame:
    """(slot, id, partners): the ids of pairs (sh, a, b) in slots of some SLOT ids of either side of a shingle."""
    sides = pairs.groupBy("sh").agg(F.ceil(F.countDistinct("a") / SLOT).alias("p"), F.ceil(F.countDistinct("b") / SLOT).alias("q"))
    pairs = pairs.join(sides, "sh").withColumn("p", F.pmod(F.xxhash64("a"), "p")).withColumn("q", F.pmod(F.xxhash64("b"), "q"))
    asked = pairs.select(*_SLOT, F.col("b").alias("id"), F.col("a").alias("partner")).unionByName(
        pairs.select(*_SLOT, F.col("a").alias("id"), F.lit(None).cast("long").alias("partner")))
    return asked.groupBy(*_SLOT, "id").agg(F.collect_set("partner").alias("partners"))


def _met(rows: DataFrame, compare) -> DataFrame:
    return rows.repartition(*_SLOT).sortWithinPartitions(*_SLOT).mapInArrow(compare, "sh long, a long, b long")


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by the sets; those that the bits of the sets rule out need none.

    `pairs` has a shingle `sh` that both share. The bits, then the texts, of a shingle meet in slots, so that they
    travel once for a few of their pairs and a shingle of many sets is many small groups. Bits take some tenth
    of the texts' bytes and grow with the sets, so few texts travel besides those of similar pairs.
    """
    pairs = cut(_met(_meeting(cut(pairs)).join(nodes.select("id", "n", "bits"), "id"), _by_bits))
    wanted = small(cut(_meeting(pairs).join(nodes.select("id", "k"), "id")), IDS)
    return _met(texts.join(wanted, "k").select(*_SLOT, "id", "partners", "text"), _by_sets).select("a", "b")


def similar_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, h, root) of every row of `docs`: rows have one root if and only if a chain of similar texts joins them.

    Texts with equal sets of shingles (copies, case and spacing apart) are one node. Of each set the rarest
    shingles are handed out (_prefixes); similar sets share one of them. First all sets with a shingle are compared
    with the least of them, which joins large groups of near copies without their pairs. Then, under every
    shingle that can be the first they share, all pairs that are not in one group yet are compared. Nothing is
    capped: a shingle of many sets that are no near copies costs their pairs, less those that sizes, places of the
    shingle or marks rule out. Sets are made anew from the texts where they are needed; only their bits are written. All null and empty texts are one node. An
    empty table gives an empty table.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.xxhash64("doc_id", "text").alias("k"))
    rows = cut(texts.mapInArrow(_nodes, "doc_id long, h long, k long, id long, n int, " + ", ".join(f"{m} long" for m in _MARKS) + ", bits binary"))
    nodes = cut(rows.groupBy("id").agg(F.min(F.struct("k", "n", *_MARKS, "bits")).alias("r")).select("id", "r.*"))
    spread = _prefixes(texts, _common(texts))
    many = spread.groupBy("sh").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("sh")
    lists = cut(spread.join(small(cut(many), SHINGLES), "sh", "left_semi").distinct())
    lists = lists.join(lists.groupBy("sh").agg(F.min(F.struct("id", "n", "pos")).alias("l")), "sh")
    stars = lists.select("sh", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("l.id").alias("a"),
                         F.col("l.n").alias("n_a"), F.col("l.pos").alias("pos_a")).where("a <> b").where(_possible())
    links = cut(_similar(stars.groupBy("a", "b").agg(F.min("sh").alias("sh")), nodes, texts))
    groups = components(links).select(F.col("node").alias("id"), F.col("root"))
    named = lists.drop("l").join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    split = named.groupBy("sh").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("sh")
    open_ = cut(named.join(split, "sh", "left_semi")).join(nodes.select("id", *_MARKS), "id")
    a = open_.select("sh", F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("root").alias("ra"), *(F.col(m).alias(f"{m}_a") for m in _MARKS))
    b = open_.select("sh", F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("root").alias("rb"), *(F.col(m).alias(f"{m}_b") for m in _MARKS))
    rest = a.join(b, "sh").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _first() & ~_unlike())
    links = links.unionByName(_similar(rest.groupBy("a", "b").agg(F.min("sh").alias("sh")), nodes, texts))
    groups = components(links).withColumnRenamed("node", "id")
    return rows.select("doc_id", "h", "id").join(groups, "id", "left").select("doc_id", "h", F.coalesce("root", "id").alias("root"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that with the least doc_id, or one without id where there is none.

    Of several rows with that id, the one with the least hash of its text stays. All columns are kept. The
    texts are shuffled once at most: by the columns of the join, which are those of the window as well.
    """
    groups = cut(similar_groups(docs))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h")))
    no, id_, h, row = (fresh(docs, c) for c in ("no_id", "id_or_0", "hash", "row"))
    key = [no, id_, h]
    kept = groups.groupBy("root").agg(first.alias("k")).select(
        F.col("k.doc_id").isNull().alias(no), F.coalesce("k.doc_id", F.lit(0)).alias(id_), F.col("k.h").alias(h))
    found = docs.withColumns({no: F.col("doc_id").isNull(), id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), h: F.xxhash64("text")}) \
        .join(kept, key, "left_semi")
    if not groups.groupBy("doc_id", "h").count().where("count > 1").isEmpty():  # rows that occur several times
        found = found.withColumn(row, F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))).where(F.col(row) == 1)
    return found.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(fingerprints(read(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
