"""Exact mining of hard negatives with an inverted multi-index."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .topk import quantized

#: Vectors that the codebooks are fitted on, at most; and codewords a half, at most.
SAMPLE_ROWS, MAX_CODEWORDS = 4096, 64
#: Rows a cell, about; rows a shard of a cell, and queries a block, at most.
CELL_ROWS, SHARD_ROWS, BLOCK_QUERIES = 1024, 4096, 512
#: Rows in the cells that a query visits first, about, to learn from which score on it must see all.
PROBE_ROWS = 2048
NONE = -(2**63)


def codebook(points, k: int, rounds: int = 8):
    """k centres or fewer of a sample's points, by Lloyd's rounds from points that lie evenly in the sample."""
    import numpy as np

    distinct = np.unique(points, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)].astype(float)
    for _ in range(rounds if points.shape[1] else 0):
        own = nearest(points, centres)[0]
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(points, centres):
    """(nearest centre, distance to it) of each point."""
    import numpy as np

    own = ((centres**2).sum(1)[None] - 2 * points @ centres.T).argmin(1)
    return own, np.sqrt(((points - centres[own]) ** 2).sum(1))


def fit(rows: DataFrame, n: int) -> dict:
    """Two codebooks for each length of vectors that the sample has; a length that it lacks has one cell.

    The sample has the SAMPLE_ROWS rows whose ids hash lowest; cells grow in number with
    the table until a half has MAX_CODEWORDS.
    """
    import numpy as np

    k = max(4, min(MAX_CODEWORDS, round((n / CELL_ROWS) ** 0.5)))
    by_length: dict = {}
    for r in rows.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).collect():
        by_length.setdefault(len(r.v), []).append(r.v)
    halves = lambda x: (x[:, : x.shape[1] // 2], x[:, x.shape[1] // 2 :])
    return {d: tuple(codebook(h, k) for h in halves(np.array(x, float))) for d, x in by_length.items()}


def books_of(books: dict, d: int):
    import numpy as np

    return books.get(d) or (np.zeros((1, d // 2)), np.zeros((1, d - d // 2)))


def _assign(books):
    """Each row's codewords and its distances to them."""

    def run(batches):
        import numpy as np
        import pandas as pd

        seq = 0
        for pdf in batches:
            dims = pdf["v"].map(len).to_numpy()
            for d in np.unique(dims):
                own = pdf[dims == d]
                x = np.stack(own["v"].to_list()).astype(float)
                (a, p), (b, q) = (nearest(h, c) for h, c in zip((x[:, : d // 2], x[:, d // 2 :]), books_of(books, int(d))))
                yield pd.DataFrame({"id": own["id"], "label": own["label"], "v": own["v"], "dim": d, "c1": a, "c2": b, "r1": p, "r2": q, "seq": seq + np.arange(len(own))})
                seq += len(own)

    return run


def _shard(key, pdf):
    import numpy as np
    import pandas as pd

    order = np.argsort(pdf["id"].to_numpy(), kind="stable")
    x = np.stack(pdf["v"].to_list())[order].astype("<i8")
    return pd.DataFrame([{"dim": key[0], "c1": key[1], "c2": key[2], "part": key[3], "n": len(x), "ids": pdf["id"].to_numpy()[order].astype("<i8").tobytes(), "labels": pdf["label"].to_numpy()[order].astype("<i8").tobytes(), "data": x.tobytes()}])


def cells_in_order(first, second):
    """(bound, i, j) of all cells by first[i] + second[j], largest first: a heap of the cells next to those that were visited."""
    import numpy as np

    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap = [(-(first[a[0]] + second[b[0]]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, int(a[i]), int(b[j])
        if j + 1 < len(b):
            heapq.heappush(heap, (-(first[a[i]] + second[b[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(first[a[i + 1]] + second[b[0]]), i + 1, 0))


def half_bounds(x, books, radii):
    """The most that a half of each query can score in each codeword: its product with the centre and its length times the radius, and a little for rounding."""
    import numpy as np

    h = len(books[0][0])
    out = []
    for part, centres, radius in ((x[:, :h], books[0], radii[0]), (x[:, h:], books[1], radii[1])):
        size = np.sqrt((part**2).sum(1))[:, None] * (np.sqrt((centres**2).sum(1)) + radius)[None]
        bound = part @ centres.T + np.sqrt((part**2).sum(1))[:, None] * radius[None]
        out.append(bound + 1 + 1e-9 * size)
    return out


def _routes(books, radii, cells, again: bool):
    """Blocks of queries for each shard that they must visit: first the best cells with PROBE_ROWS rows; again: the others that can reach a query's floor."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            dims = pdf["v"].map(len).to_numpy()
            for d in np.unique(dims):
                own_cells = cells.get(int(d))
                whole = pdf[dims == d]
                for lo in range(0, len(whole) if own_cells else 0, BLOCK_QUERIES):
                    own = whole.iloc[lo : lo + BLOCK_QUERIES].reset_index(drop=True)
                    x = np.stack(own["v"].to_list()).astype("<i8")
                    first, second = half_bounds(x.astype(float), books_of(books, int(d)), radii[int(d)])
                    visits: dict = {}
                    for q, asks in enumerate(own["asks"]):
                        seen, floor = 0, min(a["floor"] for a in asks)
                        for bound, i, j in cells_in_order(first[q], second[q]):
                            if bound < floor or not again and seen >= PROBE_ROWS:
                                break
                            n = own_cells.get((i, j), 0)
                            if n and again == (seen >= PROBE_ROWS):
                                visits.setdefault((i, j), []).append(q)
                            seen += n
                    out = []
                    for (i, j), qs in visits.items():
                        asks = [(at, a["ask"], a["floor"], a["hi"]) for at, q in enumerate(qs) for a in own["asks"][q]]
                        packed = {"q_ids": own["id"].to_numpy()[qs].astype("<i8").tobytes(), "q_labels": own["label"].to_numpy()[qs].astype("<i8").tobytes(), "q_data": x[qs].tobytes(), "asks": np.array(asks, "<i8").tobytes()}
                        out += [{"dim": int(d), "c1": i, "c2": j, "part": p} | packed for p in range(-(-own_cells[i, j] // SHARD_ROWS))]
                    if out:
                        yield pd.DataFrame(out)

    return run


def _tiles(k: int, same: bool):
    """The k best rows of a shard for each ask of a block: with the query's label or with another, and a score from the floor to hi."""

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for t in pdf.itertuples(index=False):
                ids, labels = np.frombuffer(t.ids, "<i8"), np.frombuffer(t.labels, "<i8")
                q_ids, q_labels, asks = np.frombuffer(t.q_ids, "<i8"), np.frombuffer(t.q_labels, "<i8"), np.frombuffer(t.asks, "<i8").reshape(-1, 4)
                c, q = np.frombuffer(t.data, "<i8").reshape(len(ids), -1), np.frombuffer(t.q_data, "<i8").reshape(len(q_ids), -1)
                exact = t.dim * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2**53
                scores = (q.astype(float) @ c.astype(float).T).astype(np.int64) if exact else q @ c.T
                for lo in range(0, len(asks), 128):
                    at, ask, floor, hi = asks[lo : lo + 128].T
                    s = scores[at]
                    fits = ((labels[None] == q_labels[at, None]) == same) & (ids[None] != q_ids[at, None]) & (s >= floor[:, None]) & (s <= hi[:, None])
                    s = np.where(fits, s, NONE)
                    m = min(k, s.shape[1])
                    least = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                    row, col = np.nonzero(fits & (s >= least[:, None]))
                    value = s[row, col]
                    order = np.lexsort((ids[col], -value, row))
                    row, col, value = row[order], col[order], value[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                    yield pd.DataFrame({"query_id": q_ids[at[row[keep]]], "ask": ask[row[keep]], "id": ids[col[keep]], "score": value[keep]})

    return run


class MultiIndex:
    """Rows (id, label, v) dealt to the cells of two codebooks, one for each half of the vectors.

    What all tasks hold is the codebooks, their radii and the cells' sizes: at most
    MAX_CODEWORDS centres a half and MAX_CODEWORDS^2 numbers for a length of vectors.
    """

    def __init__(self, rows: DataFrame):
        import numpy as np

        n = rows.count()
        self.books = fit(rows, n)
        schema = "id long, label long, v array<long>, dim int, c1 int, c2 int, r1 double, r2 double, seq long"
        dealt = materialize(rows.mapInPandas(_assign(self.books), schema), "cells")
        found = dealt.groupBy("dim", "c1", "c2").agg(F.count("*").alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).collect()  # MAX_CODEWORDS^2 a length
        self.cells: dict = {}
        self.radii: dict = {}
        for r in found:
            self.cells.setdefault(r.dim, {})[r.c1, r.c2] = r.n
            radii = self.radii.setdefault(r.dim, tuple(np.zeros(len(b)) for b in books_of(self.books, r.dim)))
            radii[0][r.c1], radii[1][r.c2] = max(radii[0][r.c1], r.r1), max(radii[1][r.c2], r.r2)
        counts = rows.sparkSession.createDataFrame([(r.dim, r.c1, r.c2, -(-r.n // SHARD_ROWS)) for r in found], "dim int, c1 int, c2 int, parts long")
        # seq numbers a task's rows, so a cell's rows are dealt evenly, whatever they hold
        sharded = dealt.join(F.broadcast(counts), ["dim", "c1", "c2"]).withColumn("part", F.pmod("seq", "parts").cast("int"))
        packed = "dim int, c1 int, c2 int, part int, n long, ids binary, labels binary, data binary"
        self.shards = materialize(sharded.select("dim", "c1", "c2", "part", "id", "label", "v").groupBy("dim", "c1", "c2", "part").applyInPandas(_shard, packed), "shards")

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """query_id, ask, rank, id, score: the k best of each ask of queries(id, label, v, asks: array of (ask, floor, hi)).

        A query visits cells by the most that they can score. After those with PROBE_ROWS
        rows an ask with k rows has the k-th's score as its new floor; then all other
        cells are visited that can reach the least floor of the query's asks. So what is
        not visited is certified to hold none of the k best.
        """
        block = "dim int, c1 int, c2 int, part int, q_ids binary, q_labels binary, q_data binary, asks binary"

        def visited(asking, again):
            routes = asking.mapInPandas(_routes(self.books, self.radii, self.cells, again), block)
            tiles = routes.join(self.shards.hint("merge"), ["dim", "c1", "c2", "part"])
            return tiles.mapInPandas(_tiles(k, same), "query_id long, ask long, id long, score long")

        first = materialize(best(visited(queries, False), k), "probed")
        floors = first.where(F.col("rank") == k).select("query_id", F.struct(F.col("ask"), F.col("score").alias("least")).alias("f")).groupBy("query_id").agg(F.collect_list("f").alias("floors"))  # one an ask
        raised = queries.join(floors, queries["id"] == floors["query_id"], "left").withColumn(
            "asks", F.transform("asks", lambda a: F.struct(a.ask.alias("ask"), F.greatest(a.floor, F.coalesce(F.get(F.filter("floors", lambda f: f.ask == a.ask), F.lit(0)).least, a.floor)).alias("floor"), a.hi.alias("hi")))
        )
        rest = visited(raised.select("id", "label", "v", "asks"), True)
        return best(first.drop("rank").unionByName(rest), k)


def best(lists: DataFrame, k: int, ways: int = 32) -> DataFrame:
    """The k best of each ask, ties to the smaller id, first in ways groups."""
    top = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "ask", *by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return top(top(lists.withColumn("way", F.pmod(F.xxhash64("id"), F.lit(ways))), "way").drop("rank", "way"))


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, share: int = 80, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(scale * x), and a score is the integer inner product with
    the anchor; higher scores come first, ties by the smaller id. An anchor's positives
    are its first other rows of its label; a positive's negatives are the first rows of
    other labels whose scores are from share % of the positive's up to the positive's,
    so a positive with a negative score has none.

    Rows with a null id, label or vector, an empty vector, or a null, NaN or infinite
    component take no part; rows meet only those with vectors of their length. An
    anchor with several rows is the one of the smallest vector, and none of its rows is
    its positive or negative; other repeated rows count each, and a positive that
    stands twice has its negatives twice. An empty table, an anchor without positives
    and a positive without negatives give no rows. Other columns play no part. Scores
    must stay below 10^16.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), quantized(F.col(vector_col), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = materialize(rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0"), "vectors")
    anchors = rows.where("anchor").groupBy("id").agg(F.min(F.struct("v", "label")).alias("m")).select("id", "m.label", "m.v")
    index = MultiIndex(rows.select("id", "label", "v"))
    ask = lambda number, floor, hi: F.struct(number.cast("long").alias("ask"), floor.cast("long").alias("floor"), hi.cast("long").alias("hi"))
    any_score = F.array(ask(F.lit(0), F.lit(NONE + 1), F.lit(2**63 - 1)))
    found = materialize(index.search(anchors.withColumn("asks", any_score), positives, True).select("query_id", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least = F.expr(f"({share} * positive_score + 99) div 100")
    asks = found.where("positive_score >= 0").groupBy("query_id").agg(F.collect_list(ask(F.col("rank"), least, F.col("positive_score"))).alias("asks"))  # `positives` of them
    mined = index.search(anchors.join(asks, anchors["id"] == asks["query_id"]).select("id", "label", "v", "asks"), negatives, False)
    named = mined.select("query_id", "ask", F.col("rank").cast("int").alias("place"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(found.withColumn("ask", F.col("rank").cast("long")).drop("rank"), ["query_id", "ask"]).select(
        F.col("query_id").alias("anchor_id"), "positive_id", F.col("place").alias("rank"), "negative_id", "positive_score", "negative_score"
    )


def op13_hard_negatives(vectors: DataFrame) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
