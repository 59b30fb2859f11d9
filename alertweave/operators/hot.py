"""A join that leaves the rows of hot keys where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A hot key has more rows than this and than one in HOT_KEYS of all; so there are fewer than HOT_KEYS of them.
HOT_ROWS = 10_000
HOT_KEYS = 1_000


def join_in_place(rows: DataFrame, facts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """`rows` with what `facts` says about their keys: one row per key, with _n, how many of `rows` have it. Keys are never null.

    `total` is at least the number of rows. The few hot keys are broadcast, fewer than HOT_KEYS by their definition, and only the
    other rows are shuffled; they are merged at any size, so that `facts` never pass through the driver. Where `total` is so small that no key can be hot there is nothing to broadcast.
    """
    limit = max(HOT_ROWS, total / HOT_KEYS)
    if total <= limit:
        return rows.join(facts.drop("_n").hint("merge"), keys)
    hot = F.broadcast(facts.where(F.col("_n") > limit).drop("_n"))
    held = rows.join(hot, keys)
    others = rows.join(hot.select(*keys), keys, "left_anti").join(facts.where(F.col("_n") <= limit).drop("_n").hint("merge"), keys)
    return held.unionByName(others)
