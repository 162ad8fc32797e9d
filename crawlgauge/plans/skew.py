"""A join that keeps whole results when one key holds a large share of the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Left rows of one key that a single task is asked to take.
ROWS_PER_SLICE = 200_000


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "left",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Join ``left`` to a ``right`` that is unique on ``key``, splitting hot left keys.

    Left rows of each key are counted (partial aggregation, so a hot key costs one
    row per map task). Every key with more rows than ``rows_per_slice`` is cut into
    slices, and its single right row is repeated once per slice; every other key joins
    as usual. How the table of slice counts is joined is left to the optimizer, which knows its size.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"unsupported join type: {how}")
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    hot = counts.filter(F.col("_n") > rows_per_slice).select(
        key, F.ceil(F.col("_n") / rows_per_slice).cast("int").alias("_slices")
    )
    slices = F.coalesce("_slices", F.lit(1))
    sliced_right = (
        right.join(hot, key, "left")
        .withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        .drop("_slices")
    )
    plain = [f.name for f in left.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    sliced_left = (
        left.join(hot, key, "left")
        .withColumn("_slice", F.pmod(F.xxhash64(*plain), slices.cast("bigint")).cast("int"))
        .drop("_slices")
    )
    return sliced_left.join(sliced_right, [key, "_slice"], how).drop("_slice")
