"""Joins that keep their balance when a few keys hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key is hot when it holds more than total/HOT_SHARE rows. Fewer than HOT_SHARE
#: keys can do so, whatever the data: that bounds the broadcast set of hot keys.
HOT_SHARE = 1000
SALTS = 32


def skew_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    count: str,
    spread_by: Column,
    how: str = "inner",
    hot_share: int = HOT_SHARE,
    salts: int = SALTS,
) -> DataFrame:
    """Join rows to a lookup holding one row per key, splitting the hot keys.

    ``lookup[count]`` states how many rows each key has. Keys above
    ``total / hot_share`` are hot; there are fewer than ``hot_share`` of them, so the
    set is broadcast to mark the rows. A hot row gets a salt from ``spread_by`` and
    the lookup row is repeated once per salt; all other rows join on salt 0. The
    count column is dropped from the result. Null keys match nothing.
    """
    # At least one row a key: a bound also for an empty or a tiny lookup.
    floor = lookup.agg((F.sum(count) / F.lit(hot_share)).alias("t")).scalar()
    hot = lookup.where((F.col(count) > floor) & (F.col(count) > salts)).select(
        *keys, F.lit(1).alias("__hot")
    )
    marked = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt",
        F.when(F.col("__hot") == 1, F.pmod(F.xxhash64(spread_by), F.lit(salts))).otherwise(F.lit(0).cast("bigint")),
    ).drop("__hot")
    repeated = (
        lookup.join(F.broadcast(hot), keys, "left")
        .withColumn(
            "__salt",
            F.explode(
                F.when(F.col("__hot") == 1, F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
                .otherwise(F.array(F.lit(0).cast("bigint")))
            ),
        )
        .drop("__hot", count)
    )
    return marked.join(repeated, [*keys, "__salt"], how).drop("__salt")
