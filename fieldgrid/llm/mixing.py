"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialize, running_total, small_batches, tidy

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of the tables of draws that one partial sum covers.
DRAWS_PER_GROUP = 4096


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: dict, weights: tuple = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> dict:
    """The words to take from each source.

    Sources in order of code point, null last, get the weights in turn and share
    share * the sum of sizes; none gets over cap times its size, and what is over goes
    to the others by weight, again and again until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out = share * sum(sizes.values()), {}
    open_ = list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > cap * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def _draws(probabilities, slots_per_shard, seed):
    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for shard in pdf["id"]:
                n = np.random.default_rng([seed, int(shard)]).multinomial(slots_per_shard, probabilities)
                ix = np.nonzero(n)[0]
                yield pd.DataFrame({"shard": int(shard), "source_ix": ix.astype("int32"), "n": n[ix].astype("int64")})

    return run


def permuted(k, n, key):
    """Where a pseudorandom permutation of 0..n-1, told by key, maps the numbers k: a Feistel network, walked until below n."""
    import numpy as np

    half = np.uint64(max(1, (max(int(n) - 1, 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    rng = np.random.default_rng(key)
    keys = rng.integers(1, 2**63, size=6, dtype=np.uint64) | np.uint64(1)
    x = np.asarray(k, dtype=np.uint64).copy()
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        left, right = x[todo] >> half, x[todo] & mask
        for q in keys:
            mixed = (right + q) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * q
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        x[todo] = (left << half) | right
        todo[todo] = x[todo] >= n
    return x.astype("int64")


def _slots(blocks_of, quota_of, seed):
    def run(batches):
        import numpy as np
        import pandas as pd

        blocks, quotas = np.array(blocks_of), np.array(quota_of)
        for pdf in batches:
            source, k0 = pdf["source_ix"].to_numpy(), pdf["k0"].to_numpy()
            n = np.clip(quotas[source] - k0, 0, pdf["n"].to_numpy())
            if not n.sum():
                continue
            k = np.repeat(k0 - np.cumsum(n) + n, n) + np.arange(n.sum())
            out = pd.DataFrame({"source_ix": np.repeat(source, n), "block": 0, "shard": np.repeat(pdf["shard"].to_numpy(), n), "slot": k})
            out["epoch"] = out["slot"] // blocks[out["source_ix"]]
            for (s, epoch), own in out.groupby(["source_ix", "epoch"], sort=False):
                out.loc[own.index, "block"] = permuted(own["slot"].to_numpy() % blocks[s], blocks[s], [seed, int(s), int(epoch)])
            yield out.drop(columns="epoch")

    return run


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, cap: int = 2, block_words: int = 256, slots_per_shard: int = 256, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Which words of which documents the mixed corpus takes.

    docs: doc_id, source, size (its words); further columns are ignored. Returns (spans,
    pieces). spans: doc_id, source, source_ix, size, first (the document's place in its
    source's stream of words), source_size, target. pieces: shard, slot, source_ix,
    first, doc_id, start, length (words of the document), a row for each document in each
    block that a slot of an output shard takes.

    The words of a source, documents in an order fixed by their ids, are packed into
    blocks of block_words (fewer where the source has under 64 of them). Each output
    shard draws its slots' sources from a multinomial distribution, seeded by the shard's
    number; the k-th slot of a source takes block p(k mod n) of its n, where p is the
    pseudorandom permutation of that source and epoch, and blocks are joined by that
    index. Slots beyond a source's quota stay out, and last shards make up for what it
    lacks, so that a source gives its target to within a block and no block is taken
    more than cap times. Reruns agree.

    Null sources are a source of their own, after the others. Null or no words: no
    pieces. Rows that repeat are documents of their own. Any number of sources will do;
    their sizes, a number each, are all that reaches the driver.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    docs = materialize(docs, "sizes")
    sizes = {r["source"]: r["size"] for r in docs.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    targets = source_targets(sizes, weights, share, cap)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    length = [max(1, min(block_words, sizes[s] // 64)) for s in order]
    blocks = [-(-sizes[s] // x) for s, x in zip(order, length)]
    quota = [min(cap * n, round(targets[s] * n / sizes[s])) if n else 0 for s, n in zip(order, blocks)]

    facts = spark.createDataFrame(
        [(s, i, sizes[s], float(targets[s]), length[i]) for i, s in enumerate(order)], "of string, source_ix int, source_size long, target double, block_words long"
    )
    # a row for each source; Spark broadcasts it while it is small
    known = docs.join(facts, docs["source"].eqNullSafe(facts["of"])).drop("of")
    spans = materialize(running_total(known, ["source_ix"], ["doc_id", "size"], "size", "first"), "spans")

    total = sum(quota)
    if not total:
        nothing = spark.createDataFrame([], "source_ix int, block long, shard long, slot long")
    n_shards = -(-total // slots_per_shard)
    if total:
        drawn = materialize(spark.range(n_shards).mapInPandas(_draws([q / total for q in quota], slots_per_shard, seed), "shard long, source_ix int, n long"), "draws")
        got = {r["source_ix"]: r["n"] for r in drawn.groupBy("source_ix").agg(F.sum("n").alias("n")).collect()}
        lack = [(n_shards, i, q - got.get(i, 0), got.get(i, 0)) for i, q in enumerate(quota) if q > got.get(i, 0)]
        drawn = running_total(drawn.withColumn("part", F.floor(F.col("shard") / DRAWS_PER_GROUP)), ["source_ix"], ["shard"], "n", "k0", DRAWS_PER_GROUP, "part").drop("part")
        drawn = drawn.unionByName(spark.createDataFrame(lack, "shard long, source_ix int, n long, k0 long"))
        slots = drawn.mapInPandas(_slots(blocks, quota, seed), "source_ix int, block long, shard long, slot long")
    else:
        slots = nothing
    words = F.col("block_words")
    inside = (
        spans.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.expr("first div block_words"), F.expr("(first + size - 1) div block_words"))))
        .withColumn("start", F.greatest(F.col("block") * words - F.col("first"), F.lit(0)))
        .withColumn("length", F.least((F.col("block") + 1) * words - F.col("first"), F.col("size")) - F.col("start"))
        .select("source_ix", "block", "first", "doc_id", "start", "length")
    )
    return spans, inside.join(slots, ["source_ix", "block"]).drop("block")


def taken_words(spans: DataFrame, pieces: DataFrame) -> DataFrame:
    """spans with taken: the words that the mix takes of each document, repeats counted."""
    sums = pieces.groupBy("source_ix", "first", "doc_id").agg(F.sum("length").alias("_taken")).alias("t")
    s = spans.alias("s")
    on = (F.col("s.source_ix") == F.col("t.source_ix")) & (F.col("s.first") == F.col("t.first")) & F.col("s.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("s.size") > 0)
    return s.join(sums, on, "left").select("s.*", F.coalesce("t._taken", F.lit(0)).cast("long").alias("taken"))


def op9_mixing(docs: DataFrame) -> DataFrame:
    spans, pieces = mix(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")))
    return taken_words(spans, pieces).select("doc_id", "size", "source_size", "target", "taken")


#: Copies of a row that are numbered, and whose words are taken, in one go.
COPIES = 4096


def _cut(batches):
    """A row for each time that a document's words are taken: with those of the first, of the second, and so on."""
    import re
    from collections import Counter

    import pyarrow as pa

    word = re.compile(WORD)
    for batch in (part for whole in batches for part in byte_slices(whole, "_text", 1 << 20)):
        names = batch.schema.names
        rows, texts = [], []
        for i, (text, pieces) in enumerate(zip(*[batch.column(names.index(c)).to_pylist() for c in ("_text", "_pieces")])):
            times = Counter((p["start"], p["length"]) for p in pieces)
            spans = None
            for epoch in range(max(times.values())):
                runs: list[list[int]] = []
                for (start, length), n in sorted(times.items()):
                    if n > epoch and runs and runs[-1][1] == start:
                        runs[-1][1] = start + length
                    elif n > epoch:
                        runs.append([start, start + length])
                if spans is None:
                    spans = [m.span() for m in word.finditer(text)]
                # a document that is taken whole keeps its blanks, at its ends too
                parts = [text[0 if a == 0 else spans[a][0] : len(text) if b == len(spans) else spans[b - 1][1]] for a, b in runs]
                rows.append(i)
                texts.append("\n".join(parts))
        at = pa.array(rows, pa.int64())
        kept = [c for c in names if not c.startswith("_")]
        yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)).take(at) for c in kept], pa.array(texts, pa.string())], names=[*kept, "_taken"])


def mixed_documents(docs: DataFrame, text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus with docs' columns: a row for each time that words of a document are taken.

    The first row of a document has the words that the mix takes at least once, the
    second those that it takes twice, runs apart by a line end. Documents of which
    nothing is taken have no row. Options are mix()'s. Names that start with _ are reserved.
    """
    small_batches(docs.sparkSession)
    whole = F.md5(F.to_json(F.struct(*[F.col(c) for c in docs.columns]), {"ignoreNullFields": "false"}).cast("binary"))
    keyed = docs.withColumn("_key", whole)
    # equal rows are counted, and numbered as so many copies of one: they may be any share of all
    copies = keyed.select("_key", F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size")).groupBy("_key", "source", "size").agg(F.count("*").alias("n"))
    copies = materialize(copies, "copies")
    parts = F.explode(F.sequence(F.lit(0), F.expr(f"int((n - 1) div {COPIES})")))
    each = F.explode(F.sequence(F.col("_part") * COPIES, F.least(F.col("n"), (F.col("_part") + 1) * COPIES).cast("int") - 1))
    sizes = copies.withColumn("_part", parts).repartition("_key", "_part").select("_key", "source", "size", each.alias("_copy"))
    sizes = sizes.select(F.concat_ws("-", "_key", "_copy").alias("doc_id"), "source", "size")
    _, pieces = mix(sizes, **options)
    plan = pieces.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("_pieces"))
    plan = plan.select(F.substring_index("doc_id", "-", 1).alias("_of"), F.expr(f"int(int(substring_index(doc_id, '-', -1)) div {COPIES})").alias("_at"), "_pieces")
    # a row of each text, for each so many of its copies; texts are sent once where none has more
    most = copies.agg(F.max("n")).collect()[0][0] or 0
    texts = keyed.groupBy("_key").agg(F.first(F.struct(*docs.columns)).alias("_row"), F.count("*").alias("n"))
    on = F.col("_key") == F.col("_of")
    if most > COPIES:
        texts, on = texts.withColumn("_part", parts), on & (F.col("_part") == F.col("_at"))
    joined = texts.join(materialize(plan, "plans").hint("merge"), on).select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != text_col], F.col(f"_row.`{text_col}`").alias("_text"), "_pieces")
    schema = docs.drop(text_col).schema.add("_taken", "string")
    return joined.mapInArrow(tidy(_cut), schema).withColumnRenamed("_taken", text_col).select(*docs.columns)
