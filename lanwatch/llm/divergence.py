"""Source divergence audit: count-level bitmaps.

Within a language every kept term gets a place in a block. A block holds, per (source, count), the set of places of
the terms that occur so often there, as a bitmap. AND and popcount of two bitmaps give the number of terms with that
pair of counts, zeros follow by complement, and each number is multiplied by the pair's divergence. So a term costs
a bit per source, not a row per pair of sources. Blocks are cut to a number of (source, term) cells; their sums add up.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import LOWER, UPPER, cut, read

TERM = re.compile(rb"[a-z\x80-\xff]+")  # of UTF-8 in lower case: letters A-Z and all other code points from U+0080
CELLS = 1 << 15       # (source, term) cells of a block, on average
HELD = 500_000        # counted terms a task holds before it passes them on
DOC = 1 << 40         # one document, in a number that counts occurrences below it (a task holds less text than that)
SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
SALTS = 32


def tally(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): how often a term occurs in a group, and in how many of its documents.

    Counted in the tasks that read the texts, HELD terms at a time, then summed.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), held in groups.items():
                both = np.fromiter(held.values(), np.int64, len(held))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(held), pa.string()), pa.array([source] * len(held), pa.string()), pa.array(held.keys(), pa.binary()).cast(pa.string()),
                     pa.array(both & (DOC - 1)), pa.array(both >> 40)], ["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            langs, sources, texts = (batch.column(c) for c in ("lang", "source", "text"))
            for i in range(batch.num_rows):
                held = groups.setdefault((langs[i].as_py(), sources[i].as_py()), {})
                size -= len(held)
                for term, n in Counter(TERM.findall(texts[i].as_buffer().to_pybytes().lower())).items():
                    held[term] = held.get(term, 0) + n + DOC
                size += len(held)
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    plain = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")),
                        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    counted = plain.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exactly."""
    up = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(11,0)")
    return F.call_function("div", up, (total + terms).cast("decimal(20,0)")) + 1


def _f(p, q):
    return (p - q) ** 2 // q


def _pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Divergence of all ordered pairs of sources over the terms of one (lang, block).

    Rows without a place tell a source and the share `p` of its absent terms.
    """
    placed = table["place"].is_valid().to_numpy()
    names = table["source"].to_pylist()
    sources = sorted({names[i] for i in np.flatnonzero(~placed)})
    index = {s: i for i, s in enumerate(sources)}
    of = np.array([index[s] for s in names], np.int64)
    p = table["p"].to_numpy()
    zero = np.zeros(len(sources), np.int64)
    zero[of[~placed]] = p[~placed]
    of, n, p, place = of[placed], table["n"].to_numpy()[placed], p[placed], table["place"].fill_null(0).to_numpy()[placed]
    terms = int(place.max()) + 1 if len(place) else 0
    order = np.lexsort((n, of))
    of, n, p, place = of[order], n[order], p[order], place[order]
    head = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (n[1:] != n[:-1]))) if len(of) else np.empty(0, np.int64)
    level = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(of))))
    bits = np.zeros((len(head), -(-terms // 64)), np.uint64)  # a bitmap per (source, count)
    np.bitwise_or.at(bits, (level, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    owner, value = of[head], p[head]
    size = np.diff(np.append(head, len(of)))
    total = np.zeros((len(sources), len(sources)), np.int64)
    borders = np.searchsorted(owner, np.arange(len(sources) + 1))
    for a in range(len(sources)):
        seen = np.zeros(len(head), np.int64)  # of each bitmap, the terms that occur in a
        sums = total[a]
        for i in range(borders[a], borders[a + 1]):
            words = np.flatnonzero(bits[i])
            low, high = words[0], words[-1] + 1
            joint = np.bitwise_count(bits[:, low:high] & bits[i, low:high]).sum(1, dtype=np.int64)
            seen += joint
            np.add.at(sums, owner, joint * _f(value[i], value))
            present = np.zeros(len(sources), np.int64)
            np.add.at(present, owner, joint)
            sums += (size[i] - present) * _f(value[i], zero)
        absent = size - seen
        np.add.at(sums, owner, absent * _f(zero[a], value))
        neither = np.full(len(sources), terms - size[borders[a]:borders[a + 1]].sum())
        np.subtract.at(neither, owner, absent)
        sums += neither * _f(zero[a], zero)
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    name = np.array(sources, object)
    return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(a), pa.string()), pa.array(name[a], pa.string()), pa.array(name[b], pa.string()),
                                 pa.array(total[a, b], pa.int64())], ["lang", "source", "item", "value"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of the parts `pair` and `term`.

    Null texts, languages and sources count as empty text; a group without a kept term still is a group; repeated
    rows are documents of their own; ties in value go to the smaller item in UTF-8 order. An empty table gives no
    rows. Other columns play no part. A language with k sources gives k * (k - 1) pairs.
    """
    cells = cut(tally(docs))
    kept = cut(cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("everywhere"), F.count("*").alias("cells"))
               .where(F.col("docs") >= least_docs).drop("docs"))
    langs = cut(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("everywhere").alias("all"),
                                         F.greatest(F.lit(1), F.ceil(F.sum("cells") / CELLS)).alias("blocks")))
    inside = Window.partitionBy("lang", "block").orderBy(F.desc("everywhere"), "term")
    places = (kept.drop("cells").join(langs, "lang")
              .select("lang", "term", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "everywhere",
                      share(F.col("everywhere"), F.col("all"), F.col("terms")).alias("q"))
              .withColumn("place", F.row_number().over(inside) - 1).drop("everywhere"))
    rows = cut(cells.drop("docs").join(places, ["lang", "term"]))
    groups = (docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
              .join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
              .join(langs.drop("all"), "lang", "left"))
    groups = cut(groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"),
                               F.coalesce("blocks", F.lit(1)).alias("blocks")))
    valued = rows.join(groups.drop("blocks"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))

    nothing = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1)
    everyone = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source",
                             F.lit(None).cast("int").alias("place"), F.lit(0).cast("long").alias("n"), nothing.alias("p"))
    blocks = valued.select("lang", "block", "source", "place", "n", "p").unionByName(everyone)
    pairs = (blocks.groupBy("lang", "block").applyInArrow(_pairs, "lang string, source string, item string, value bigint")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value")))
    best = [F.desc("value"), "item"]
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best)))

    q, p = F.col("q"), F.col("p")
    terms = valued.where(p > q).select("lang", "source", F.col("term").alias("item"), F.call_function("div", (p - q) * (p - q), q).alias("value"))
    # the first places of a large group are found in parts, then among the parts' first
    salted = Window.partitionBy("lang", "source", F.pmod(F.xxhash64("item"), F.lit(SALTS))).orderBy(*best)
    terms = (terms.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top_terms).drop("rank")
             .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best))).where(F.col("rank") <= top_terms))

    def part(df, name):
        return df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(pairs, "pair").unionByName(part(terms, "term"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), '{UPPER}', '{LOWER}') AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
             1 + ({SCALE}::HUGEINT * (coalesce(c.c, 0) + 1)) // (g.n + v.v)::HUGEINT AS p, 1 + ({SCALE}::HUGEINT * (k.c + 1)) // (v.n + v.v)::HUGEINT AS q
      FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q),
x AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM y WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"))
