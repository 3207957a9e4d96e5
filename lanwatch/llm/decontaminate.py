"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

Items are cut into windows of WINDOW words. A window is the set of its shingles at their positions; full
containment needs every one of them, so the necessary prefix is one shingle: the rarest in the corpus. Only
that one is joined with the documents. A match at its offset fixes where the window must begin; positions
outside the document are dropped, and the rest is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, lower_ascii, read

WINDOW = 13           # words of an item window
SHINGLE = 3           # words of a shingle; a shorter window is one shingle
SHARE = 20            # contaminated if SHARE * hit words >= words
BROADCAST_ROWS = 400_000  # item shingles or windows up to this count are broadcast (some 60 MB); beyond, the join shuffles

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """ASCII letters and digits and all other characters form words; A-Z in lower case. Null: no words."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), SEPARATORS), ""), F.array().cast("array<string>"))


def _bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, len, win): the distinct windows of each item; items without words have none."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0") \
        .withColumn("len", F.least(F.size("w"), F.lit(window)))
    starts = items.select("item_id", "len", "w", F.explode(F.sequence(F.lit(1), F.expr("size(w) - len + 1"))).alias("i"))
    return starts.select("item_id", "len", F.concat_ws(" ", F.slice("w", F.col("i"), F.col("len"))).alias("win")).distinct()


def _shingles(wins: DataFrame) -> DataFrame:
    """(win, len, k, offset, key): every shingle of k words of each distinct window."""
    w = wins.select("win", "len").distinct().withColumn("k", F.least("len", F.lit(SHINGLE))).withColumn("w", F.split("win", " "))
    at = w.select("win", "len", "k", "w", F.explode(F.sequence(F.lit(0), F.expr("len - k"))).alias("offset"))
    return at.select("win", "len", "k", "offset", _key(F.col("w"), F.col("offset"), F.col("k")).alias("key"))


def _key(words: Column, pos: Column, k: Column) -> Column:
    """Hash of k words from pos on; k takes part, so that shingles of different sizes stay apart. Null: cut off."""
    ends = [F.get(words, pos + i) for i in range(SHINGLE)]
    key = F.lit(None).cast("long")
    for size in range(1, SHINGLE + 1):
        key = F.when(k == size, F.when(ends[size - 1].isNotNull(), F.xxhash64(F.lit(size), *ends[:size]))).otherwise(key)
    return key


def _positions(docs: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """(keep, w, pos, key) of every shingle of the wanted sizes in the documents' words `w`."""
    at = docs.select(*keep, "w", F.posexplode("w").alias("pos", "_")).drop("_")
    keys = [_key(F.col("w"), F.col("pos"), F.lit(k)) for k in sizes]
    return at.withColumn("key", keys[0] if len(keys) == 1 else F.explode(F.array(*keys))).where("key is not null")


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, h, start, len, win): each occurrence of an item window in a document.

    h is a hash of the text; equal rows of `docs` give one set of occurrences. Both tables are read whole.
    """
    wins = cut(windows(benchmark, window))
    shingles = cut(_shingles(wins))
    sizes = sorted(r.k for r in shingles.select("k").distinct().collect())  # at most SHINGLE numbers
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("w"))
    if not sizes:
        return docs.select("doc_id", F.lit(0).cast("long").alias("h"), F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit("").alias("win")).limit(0)
    rarity = cut(_positions(texts, sizes).join(_bounded(shingles.select("key").distinct()), "key").groupBy("key").count())
    ranked = shingles.join(rarity, "key").withColumn(
        "n", F.row_number().over(Window.partitionBy("win").orderBy("count", "offset")))
    # an inner join: a window with a shingle that no document has cannot occur
    whole = shingles.groupBy("win").agg(F.count("*").alias("all"))
    seen = ranked.groupBy("win").agg(F.count("*").alias("found"))
    prefix = cut(ranked.where("n = 1").join(whole.join(seen, "win").where("all = found"), "win").select("key", "offset", "len", "win"))
    start = F.col("pos") - F.col("offset")
    there = (start >= 0) & (start + F.col("len") <= F.size("w")) & (
        F.concat_ws(" ", F.slice("w", F.greatest(start + 1, F.lit(1)), F.col("len"))) == F.col("win"))
    found = _positions(texts, sizes, "doc_id", "h").join(_bounded(prefix), "key").where(there)
    return found.select("doc_id", "h", start.alias("start"), "len", "win").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of `docs`: doc_id, h, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word inside any occurrence of an item window is hit. Null and empty texts have no words and
    are clean; null doc_ids are kept; repeated rows get equal answers; an empty benchmark leaves all clean.
    Columns other than doc_id and text (item_id and text of `benchmark`) are not read.
    """
    found = cut(occurrences(docs, benchmark, window))
    key = ["doc_id", "h"]
    spans = found.select(*key, "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    before = Window.partitionBy(*key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh_words = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = spans.select(*key, fresh_words.alias("n")).groupBy(*key).agg(F.sum("n").alias("n_hit"))
    per_item = found.select(*key, "win").distinct().join(windows(benchmark, window).select("win", "item_id"), "win") \
        .select(*key, "item_id").distinct()
    items = per_item.groupBy(*key).agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    facts = hit.join(items, (hit.doc_id.eqNullSafe(items.doc_id)) & (hit.h == items.h)).select(
        hit.doc_id.alias("d"), hit.h.alias("t"), "n_hit", "n_items", F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"))
    base = docs.select("doc_id", F.xxhash64("text").alias("h"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return base.join(facts, base.doc_id.eqNullSafe(F.col("d")) & (base.h == F.col("t")), "left").select(
        base.doc_id, "h", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of `docs` that are not contaminated; all columns are kept, extra ones too."""
    bad = contamination(docs, benchmark, window).where("contaminated").select(F.col("doc_id").alias("d"), F.col("h").alias("t")).distinct()
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.d) & (F.xxhash64(docs.text) == bad.t), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("h")


SQL = r"""
with d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
b as (select item_id, w, least(len(w), 13) l from (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w
        from benchmark) where len(w) > 0),
win as (select distinct item_id, l, array_to_string(w[i:i + l - 1], ' ') t
        from (select item_id, w, l, unnest(range(1, len(w) - l + 2)) i from b)),
dw as (select doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') t from (
        select doc_id, w, l, unnest(range(1, len(w) - l + 2)) i from d, (select distinct l from win))),
hit as (select doc_id, i, dw.l l, item_id from dw join win on dw.l = win.l and dw.t = win.t),
n as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + l)) p from hit) group by doc_id),
it as (select doc_id, count(*) n_items, sha256(string_agg(s, ',' order by s)) h
       from (select distinct doc_id, cast(item_id as varchar) s from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       coalesce(h, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join n on d.doc_id = n.doc_id left join it on d.doc_id = it.doc_id
"""
