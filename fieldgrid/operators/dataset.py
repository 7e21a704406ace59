"""Splits, batches and metrics over samples."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .assemble import dense_ordinal


def split(samples: DataFrame, share: float = 0.75, by: str = "sample_ix") -> DataFrame:
    """part = train for the first int(n * share) of n samples in order, test for the rest; the count is a one-row table."""
    n = samples.agg(F.floor(F.count("*") * F.lit(share)).alias("_cut"))
    return samples.crossJoin(F.broadcast(n)).withColumn("part", F.when(F.col(by) < F.col("_cut"), "train").otherwise("test")).drop("_cut")


def minibatches(samples: DataFrame, seed: int, epoch: int, size: int = 32, by: str = "sample_ix") -> DataFrame:
    """batch_id of each sample: order by a hash of seed, epoch and sample; the last batch may be short."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(by).cast("string")))
    d = dense_ordinal(samples.withColumn("_key", key), ["_key", by], "_at")
    return d.withColumn("batch_id", F.floor(F.col("_at") / size)).drop("_key", "_at")


#: A prime; rounds that a permutation takes.
PRIME, ROUNDS = 2**31 - 1, 32


def round_keys(seed: int, epoch: int, rounds: int = ROUNDS) -> list[dict[str, int]]:
    """k, a, b of each round: k below 2^40, a and b below PRIME, a not 0."""
    out = []
    for r in range(rounds):
        x = hashlib.md5(f"{seed}:{epoch}:{r}".encode()).digest()
        k, a, b = (int.from_bytes(x[i : i + 5], "big") for i in (0, 5, 10))
        out.append({"k": k, "a": 1 + a % (PRIME - 1), "b": b % PRIME})
    return out


def permuted(ix: Column, n: int, seed: int, epoch: int) -> Column:
    """The place of row ix (0 to n - 1) in an order of the n rows that the seed and the epoch give: arithmetic of the row alone, so no sort and no shuffle.

    In each round a row may change places with the one that mirrors it about the round's
    key; both see the same bit, of a hash of the larger of them, so each round is a
    permutation, and so are all, for any n below 2^62.
    """
    keys = F.from_json(F.lit(json.dumps(round_keys(seed, epoch))), "array<struct<k: long, a: long, b: long>>")

    def turn(x, r):
        y = F.pmod(r["k"] - x, F.lit(n).cast("long"))
        return F.when((F.greatest(x, y) % PRIME * r["a"] + r["b"]) % PRIME < PRIME // 2, y).otherwise(x)

    return F.aggregate(keys, ix.cast("long"), turn)


def permuted_batches(samples: DataFrame, n: int, seed: int, epoch: int, size: int = 32, by: str = "sample_ix") -> DataFrame:
    """batch_id of each of n samples numbered from 0, as minibatches gives it but by permuted: an epoch's batches are a column, not a sort of all samples. The last batch may be short."""
    return samples.withColumn("batch_id", F.floor(permuted(F.col(by), n, seed, epoch) / size))


def squared_error(out: Column, y: Column) -> Column:
    return (out - y) * (out - y)


def mse(rows: DataFrame, out: str = "out", y: str = "y") -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg(squared_error(F.col(out), F.col(y))).alias("mse"))


def epoch_loss(rows: DataFrame, out: str = "out", y: str = "y") -> DataFrame:
    """The mean of the batches' means, so that a short batch weighs as much as a full one."""
    each = rows.groupBy("batch_id").agg(F.avg(squared_error(F.col(out), F.col(y))).alias("loss"))
    return each.agg(F.count("*").alias("n_batches"), F.avg("loss").alias("epoch_loss"))


def shape(samples: DataFrame) -> DataFrame:
    return samples.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("c_x"), F.max(F.size("y")).alias("c_y"), F.max("n_r").alias("n_r"), F.max("n_a").alias("n_a"))


def parameter_count(shapes: DataFrame) -> DataFrame:
    """The sum of the products of weight shapes, for each of the other columns' values."""
    return shapes.groupBy(*[c for c in shapes.columns if c not in ("name", "shape")]).agg(F.sum(F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)).alias("n_params"))


def operator_shapes(c_in: int, c_out: int, n_r, n_a, width: int = 3, layers: int = 4, mlp_width: int = 64, mlp_layers: int = 3, modes: tuple[int, int] = (80, 240)) -> list[tuple[str, list]]:
    """(name, shape) of the weights of lift, spectral blocks and projection; modes are cut to what the grid has, whose size may be columns."""
    if isinstance(n_r, Column):
        m1, m2 = F.least(F.lit(modes[0]), n_r), F.least(F.lit(modes[1]), F.floor(n_a / 2).cast("int") + 1)
    else:
        m1, m2 = min(modes[0], n_r), min(modes[1], n_a // 2 + 1)

    def dense(name, sizes):
        return [x for i, (a, b) in enumerate(zip(sizes, sizes[1:])) for x in ((f"{name}.{i}.weight", [b, a]), (f"{name}.{i}.bias", [b]))]

    def mlp(name, a, b, n):
        return dense(name, [a, b] if n == 1 else [a, *[mlp_width] * (n - 1), b])

    out = mlp("lift", c_in, width, mlp_layers)
    for k in range(layers):
        out += [(f"spectral.{k}.w{i}", [width, width, m1, m2]) for i in (1, 2)] + mlp(f"bypass.{k}", width, width, 1)
    return out + mlp("project", width, c_out, mlp_layers)


def grid_shapes(grids: DataFrame, c_in: int, c_out: int) -> DataFrame:
    """n_r, n_a, name, shape: the weights of an operator for each size of grid in grids(n_r, n_a)."""
    own = [F.struct(F.lit(name).alias("name"), F.array(*[x if isinstance(x, Column) else F.lit(x) for x in shape]).alias("shape")) for name, shape in operator_shapes(c_in, c_out, F.col("n_r"), F.col("n_a"))]
    return grids.select("n_r", "n_a").distinct().select("n_r", "n_a", F.inline(F.array(*own)))
