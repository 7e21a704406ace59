"""Random draws that depend on a seed, a row's id and the draw's number alone, not on partitions or order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform01(seed: int, row_id: Column, draw) -> Column:
    """In [0, 1): the first 32 bits of the md5 of seed:id:draw."""
    draw = draw if isinstance(draw, Column) else F.lit(draw)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string"), draw.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform(u: Column, low: Column, high: Column) -> Column:
    return low + (high - low) * u


def triangular(u: Column, low: Column, high: Column, mode: Column) -> Column:
    """Inverse distribution function of the triangular distribution."""
    cut = (mode - low) / (high - low)
    left = low + F.sqrt(u * (high - low) * (mode - low))
    right = high - F.sqrt((1 - u) * (high - low) * (high - mode))
    return F.when(u < cut, left).otherwise(right)
