"""Exact top-k search: tiled matrix products of queries and shards, partial selection, tree merging.

Vectors become integers. Candidates are dealt to shards, queries to blocks, and every (shard, block) tile is one
bounded group: its matrix product is taken in pieces, each query keeps the best of each piece, and the tiles' short
lists are merged in a tree of small groups. Nothing is broadcast and no task sees more than a tile or FAN lists.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read

SHARD_CELLS = 2 << 20    # components of a shard of candidates: 16 MB as doubles
BLOCK_CELLS = 256 << 10  # components of a block of queries
PIECE = 4 << 20          # scores held at once
FAN = 16                 # lists merged by one group of the tree
EXACT = 2.0 ** 53
TOP = 2 ** 63 - 1


def integers(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(id, v, copies): floor(scale * x) of each component x as array<bigint>, equal rows once with their number.

    Vectors that are null or hold a null or non-finite component are left out. A component beyond a long is the
    nearest long. A null id stays (it is no query, and comes last among ties).
    """
    whole = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return (df.where(F.col(vector).isNotNull() & whole)
            .select(F.col(id_col).cast("long").alias("id"),
                    F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"))
            .groupBy("id", "v").agg(F.count("*").alias("copies")))


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exactly: in doubles where no sum can pass 2**53, in Python's integers else, held within a long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = a.shape[1] * float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max())
    if bound < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound < float(TOP) / 2:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -TOP, TOP).astype(np.int64)


def _matrix(column: pa.ChunkedArray, rows: np.ndarray, dim: int) -> np.ndarray:
    flat = column.take(pa.array(rows)).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(rows), dim)


def _best(scores: np.ndarray, ids: np.ndarray, known: np.ndarray, keep: int) -> np.ndarray:
    """Places of the `keep` best of one row of scores: highest first, then least id, then rows without id."""
    if len(scores) > keep:  # partial selection; all ties of the last place stay until ids decide
        edge = np.partition(scores, len(scores) - keep)[len(scores) - keep]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], ~known[at], -scores[at]))][:keep]


def _tile(k: int):
    """Function for one tile: the best k + 1 of its candidates for each of its queries, in one list."""
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        side, dims = table["side"].to_numpy(), table["dim"].to_numpy()
        ids, known = table["id"].fill_null(0).to_numpy(), table["id"].is_valid().to_numpy()
        copies, marks = table["copies"].to_numpy(), table["mark"].to_numpy()
        asked, own, ends, minus, at = [], [], [0], [], []
        for dim in np.unique(dims[side == 1]):  # vectors of different lengths have no product
            q, c = (np.flatnonzero((side == s) & (dims == dim)) for s in (1, 0))
            if not len(c):
                continue
            queries, shard = _matrix(table["v"], q, dim), _matrix(table["v"], c, dim)
            step = max(1, PIECE // len(c))
            for i in range(0, len(q), step):
                part = queries[i:i + step]
                for j, row in enumerate(_scores(part, shard)):
                    best = _best(row, ids[c], known[c], k + 1)
                    minus.append(-row[best])
                    at.append(c[best])
                    ends.append(ends[-1] + len(best))
            asked.append(q)
            own += [int(_scores(queries[i:i + 1], queries[i:i + 1])[0, 0]) for i in range(len(q))]
        rows = np.concatenate(asked) if asked else np.empty(0, np.int64)
        picked = np.concatenate(at) if at else np.empty(0, np.int64)
        entries = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(minus) if minus else [], pa.int64()), pa.array(~known[picked], pa.bool_()),
             pa.array(ids[picked], pa.int64(), mask=~known[picked]), pa.array(copies[picked], pa.int64())], ["minus", "void", "id", "copies"])
        return pa.Table.from_arrays(
            [pa.array(ids[rows], pa.int64()), pa.array(marks[rows], pa.int64()), pa.array(copies[rows], pa.int64()), pa.array(own, pa.int64()),
             pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)],
            ["qid", "mark", "n", "own", "shard", "best"])
    return run


def tile_counts(cells: int, query_cells: int) -> tuple[int, int]:
    """Numbers of shards and of query blocks for so many components."""
    return max(1, -(-cells // SHARD_CELLS)), max(1, -(-query_cells // BLOCK_CELLS))


def top_k(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest inner product for each query row.

    `vectors`: (id, v, copies) of `integers`; `is_query`: a condition on `id` that holds for no null. A query's own
    row is no candidate, its equals are: n rows of one id and vector are n queries with equal lists, in which n - 1
    of them may stand. Ties go to the smaller id, rows without id last. Vectors are compared with those of their
    length only. Fewer than k candidates: all of them. A score beyond a long is the nearest one. An empty table gives
    no rows.

    Shuffled once for the tiles: every row to one shard per block of queries, every query to each shard.
    """
    size = F.size("v")
    dim = F.greatest(size, F.lit(1)).cast("long")
    row = vectors.agg(F.sum(dim), F.sum(F.when(is_query, dim))).first()
    shards, blocks = tile_counts(row[0] or 0, row[1] or 0)
    hashed = F.xxhash64("id", "v")
    shard, block = F.pmod(hashed, F.lit(shards)).cast("int"), F.pmod(F.xxhash64(hashed), F.lit(blocks)).cast("int")

    def places(shard, block, side):
        return F.struct(shard.alias("shard"), block.alias("block"), F.lit(side).alias("side"))

    as_candidate = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: places(shard, b, 0))
    as_query = F.when(is_query, F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: places(s, block, 1)))
    dealt = vectors.select("id", "v", "copies", size.alias("dim"), hashed.alias("mark"),
                           F.explode(F.concat(as_candidate, F.coalesce(as_query, F.array().cast("array<struct<shard:int,block:int,side:int>>")))).alias("_at"))
    lists = dealt.select("id", "v", "copies", "dim", "mark", "_at.*").groupBy("shard", "block").applyInArrow(
        _tile(k), "qid bigint, mark bigint, n bigint, own bigint, shard int, "
                  "best array<struct<minus:bigint,void:boolean,id:bigint,copies:bigint>>")
    while shards > 1:  # a tree: FAN lists of a query at a time, until one is left
        shards = -(-shards // FAN)
        lists = (lists.groupBy("qid", "mark", "n", "own", F.floor(F.col("shard") / FAN).cast("int").alias("shard"))
                 .agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best")))
    # one row less of (own id, own score): rows of that id and score cannot be told apart in the result
    me = F.expr("array_position(transform(best, e -> struct(e.minus as m, e.id as i)), struct(-own as m, qid as i))")
    rows = F.expr(f"transform(best, (e, i) -> array_repeat(struct(e.minus as minus, e.id as id), "
                  f"cast(least(e.copies - if(i + 1 = me, 1, 0), {k}) as int)))")
    return (lists.withColumn("me", me).select("qid", F.slice(F.flatten(rows), 1, k).alias("top"), F.explode(F.sequence(F.lit(1), F.col("n"))))
            .select(F.col("qid").alias("query_id"), F.posexplode("top").alias("place", "e"))
            .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.minus")).alias("score")))


#: Exact in DuckDB too; every row is told apart by its number.
SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id,
             CAST(coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(q.e, c.e)]), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 10
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best rows for every row whose vec_id is divisible by 100, against all other rows."""
    return top_k(integers(read(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0, 10)
