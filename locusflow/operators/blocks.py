"""Blocks of rows, and their pairs.

Rows are packed once, a row a block, and stored. Blocks meet in a nested loop over the stored table, so
no row is copied for each block that it meets: what is shuffled and written follows the input, though
pairs are its square. A task holds two blocks and some PAIRS at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise

#: Pairs that are made at once.
PAIRS = 65_536
#: Parquet packs so many values together: columns that are repeated in multiples of it are the same bytes each time, which compress.
EIGHT = 8


def packed(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], block: int, label: str) -> DataFrame:
    """A stored row for each block (keys, and its number at) of about as many rows, cut from the rows in the order of keys and order.

    It has an array for each column; rows stand in it by the columns, the first one first, and values that
    are arrays stand one after another.
    """
    kinds, partitions = dict(rows.dtypes), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = lambda c: F.flatten(f"rows.{c}") if kinds[c].startswith("array") else F.col(f"rows.{c}")
    dealt = rows.repartitionByRange(max(1, math.ceil(rows.count() / block)), *keys, *order).withColumn("at", F.spark_partition_id())
    held = dealt.groupBy(*keys, "at").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("rows"))
    # blocks are few and wide: dealt out, for the tasks of a meeting are those of one side times those of the other
    return materialise(held.select(*keys, "at", *[values(c).alias(c) for c in columns]).repartition(partitions), label)


def meetings(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """left and right (structs) for each pair of blocks under the condition; nothing is shuffled or broadcast."""
    side = lambda blocks, name: blocks.select(F.struct(*blocks.columns).alias(name))
    return side(left, "left").hint("shuffle_replicate_nl").join(side(right, "right"), condition)


def slices(rows: int, columns: int) -> list[slice]:
    """Stretches of rows that make up to PAIRS with the columns."""
    step = max(1, math.ceil(PAIRS / max(1, columns)))
    return [slice(k, k + step) for k in range(0, rows, step)]


def of_block(side, at: int, column: str) -> np.ndarray:
    """The values of a block's column; side is a batch's array of structs."""
    return side.field(column)[at].values.to_numpy(zero_copy_only=False)


def by_value(values: np.ndarray) -> Iterator[np.ndarray]:
    """Places of values that aren't negative, some PAIRS at a time: the least first, NaN last.

    A number's leading bits decide, the rest of its 64 has its place. Rows written in this order take less disk, as
    values that are equal when rounded stand together.
    """
    room = max(1, (len(values) - 1).bit_length())
    keys = values.view(np.uint64) >> np.uint64(room)
    keys <<= np.uint64(room)
    cuts = slices(len(values), 1)
    for cut in cuts:
        keys[cut] |= np.arange(cut.start, min(cut.stop, len(values)), dtype=np.uint64)
    keys.sort()
    for cut in cuts:
        yield (keys[cut] & np.uint64((1 << room) - 1)).astype(np.int64)
