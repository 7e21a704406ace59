"""Exact top-k search by inner product over integer vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BLOCK_ROWS, SHARD_ROWS = 2048, 8192
#: Shards under one key, which meet copies of all blocks there.
SHARDS_PER_KEY = 8


def quantized(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def _pack(ids, rows) -> dict:
    """Vectors of one dimension as one row, in order of id."""
    import numpy as np

    order = np.argsort(ids, kind="stable")
    data = np.stack([rows[i] for i in order]).astype("<i8") if len(order) else np.zeros((0, 0), "<i8")
    small = data.size == 0 or np.abs(data).max() < 2**31 and data.min() >= -(2**31)
    return {"ids": ids[order].astype("<i8").tobytes(), "n": len(order), "wide": not small, "data": (data if not small else data.astype("<i4")).tobytes()}


def _shards(batches):
    import numpy as np
    import pandas as pd

    for pdf in batches:
        if not len(pdf):
            continue
        dims = pdf["v"].map(len).to_numpy()
        for d in np.unique(dims):
            own = pdf[dims == d]
            for i in range(0, len(own), SHARD_ROWS):
                part = own.iloc[i : i + SHARD_ROWS]
                yield pd.DataFrame([{"dim": int(d), **_pack(part["id"].to_numpy(), part["v"].to_numpy())}])


def _block(key, pdf):
    import pandas as pd

    return pd.DataFrame([{"dim": key[0], "block": key[1], **_pack(pdf["id"].to_numpy(), pdf["v"].to_numpy())}])


def _tiles(k):
    def run(batches):
        """One tile a row: the product of a block of queries and a shard, and of each query its k best."""
        import numpy as np
        import pandas as pd

        def read(ids, data, n, dim, wide):
            return np.frombuffer(ids, "<i8"), np.frombuffer(data, "<i8" if wide else "<i4").reshape(n, dim).astype(np.int64)

        for pdf in batches:
            for t in pdf.itertuples(index=False):
                q_ids, q = read(t.q_ids, t.q_data, t.q_n, t.dim, t.q_wide)
                c_ids, c = read(t.ids, t.data, t.n, t.dim, t.wide)
                exact = t.dim * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2**53
                for i in range(0, len(q), 256):
                    # doubles hold such sums exactly; larger ones are summed as integers
                    s = q[i : i + 256].astype(float) @ c.astype(float).T if exact else q[i : i + 256] @ c.T
                    own = q_ids[i : i + 256, None] == c_ids[None, :]
                    if exact:
                        s[own] = -np.inf
                    else:
                        s = np.where(own, np.iinfo(np.int64).min, s)
                    m = min(k, s.shape[1])
                    least = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                    row, col = np.nonzero((s >= least[:, None]) & ~own)
                    value = s[row, col]
                    order = np.lexsort((c_ids[col], -value, row))
                    row, col, value = row[order], col[order], value[order]
                    first = np.searchsorted(row, row)
                    keep = np.arange(len(row)) - first < k
                    yield pd.DataFrame({"query_id": q_ids[i + row[keep]], "vec_id": c_ids[col[keep]], "score": value[keep].astype(np.int64)})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", merge_ways: int = 32) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query, ties to the smaller id.

    Components become floor(scale * x). Shards of rows are packed where they are read;
    queries are packed into blocks of about BLOCK_ROWS. A tile is the matrix product of
    a block and a shard, and keeps k entries a query, so what tiles send on is small; the
    lists are merged as a tree, first in merge_ways groups, then all of a query. Blocks
    of queries are broadcast while Spark finds their table small, else copied to keys of
    about SHARDS_PER_KEY shards each.

    Vectors that are null or hold a null, NaN or infinite component take no part, nor
    do rows with a null id; a query meets only vectors of its own length. No row is a
    candidate for the query of its own id. Of several query rows with one id the smallest
    vector asks; repeated candidates count each. Without other rows a query has no
    result; an empty table gives an empty one. Scores beyond 64 bits wrap.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), quantized(F.col(vector_col), scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    asked = pick(queries).groupBy("id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    packed = "ids binary, n long, wide boolean, data binary"
    blocks = (
        asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("dim", F.size("v"))
        .groupBy("dim", "block").applyInPandas(_block, f"dim int, block int, {packed}")
    )
    blocks = materialize(blocks.withColumnsRenamed({c: f"q_{c}" for c in ("ids", "n", "wide", "data")}), "query-blocks")
    shards = pick(vectors).mapInPandas(_shards, f"dim int, {packed}")
    # a shard is sent once, and each block to all keys; so no task gets more than a key's shards
    copies = max(1, -(-vectors.count() // (SHARD_ROWS * SHARDS_PER_KEY)))
    blocks = blocks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    tiles = shards.withColumn("copy", F.pmod(F.xxhash64("ids"), F.lit(copies)).cast("int")).join(blocks, ["dim", "copy"])
    lists = tiles.mapInPandas(_tiles(k), "query_id long, vec_id long, score long")
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    first = best(lists.withColumn("way", F.pmod(F.xxhash64("vec_id"), F.lit(merge_ways))), "query_id", "way").drop("rank")
    return best(first, "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
