"""Connected components of the link graph: hooks onto smallest neighbours, then alternating star contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from alertweave.operators.hot import join_in_place
from alertweave.session import Scratch, cut_lineage


def _stored(stars: DataFrame) -> tuple[DataFrame, dict]:
    """The star table written once, with its row count and content hash taken on the way."""
    seen = Observation()
    digest = F.sum(F.xxhash64("v", "to").cast("decimal(38,0)")).alias("digest")
    stored = cut_lineage(stars.observe(seen, F.count(F.lit(1)).alias("rows"), digest))
    return stored, seen.get


def _large_star(pairs: DataFrame, total: int) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it knows."""
    both = pairs.unionByName(pairs.select(F.col("to").alias("v"), F.col("v").alias("to")))
    least = both.groupBy("v").agg(F.least(F.min("to"), F.col("v")).alias("_least"), F.count(F.lit(1)).alias("_n"))
    return join_in_place(both, least, ["v"], 2 * total).where("to > v").select(F.col("to").alias("v"), F.col("_least").alias("to")).distinct()


def _small_star(pairs: DataFrame, total: int) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them."""
    least = pairs.groupBy("v").agg(F.min("to").alias("_least"), F.count(F.lit(1)).alias("_n"))
    moved = join_in_place(pairs, least, ["v"], total).where("to <> _least").select(F.col("to").alias("v"), F.col("_least").alias("to"))
    own = least.select("v", F.col("_least").alias("to"))
    return moved.unionByName(own).distinct()


def _contracted(pairs: DataFrame) -> DataFrame:
    """Pairs (v, to), v larger than to, as stars: every vertex but the smallest of its component with that smallest one.

    A round's table is deleted when that of the next round is stored.
    """
    with Scratch() as held:
        stars, state = _stored(pairs.distinct())
    while state["rows"]:
        with Scratch() as fresh:
            # The large star has at most twice as many rows as before; the exact number is not known yet.
            stars, after = _stored(_small_star(_large_star(stars, state["rows"]), 2 * state["rows"]))
        held.drop(pairs.sparkSession)
        held = fresh
        if after == state:
            break
        state = after
    held.pass_on()
    return stars


def connected_components(edges: DataFrame, src: str = "left_signal_id", dst: str = "right_signal_id",
                         keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """(signal_id, component): component is the smallest signal id it holds.

    `keep` stores the links, which are read twice; links that are stored already need no copy (`keep=lambda df: df`).

    First every vertex hooks onto its smallest neighbour. These trees have a row per vertex, however many links there are, and
    are contracted to stars; links then lead between trees, and the few different ones are contracted likewise. So all links
    are read twice only, not once a round. Neighbour lists are never gathered: each step is a minimum (combined before the
    shuffle) and, in the rounds, a join for which the rows of hubs are not moved; the two joins that name the links' trees move
    them, and leave it to adaptive execution to split them. Lineage is cut after every round; the number of rounds grows with
    the logarithm of the component size.
    """
    pairs = keep(edges.where(F.col(src) != F.col(dst)).select(F.greatest(src, dst).alias("v"), F.least(src, dst).alias("to")))
    trees = _contracted(pairs.groupBy("v").agg(F.min("to").alias("to")))
    # The larger end of a link has hooked, so it is no root; the smaller one may be.
    root = trees.select("v", F.col("to").alias("_root"))
    other = trees.select(F.col("v").alias("to"), F.col("to").alias("_other"))
    ends = pairs.join(root.hint("merge"), "v").join(other.hint("merge"), "to", "left").select("_root", F.coalesce("_other", "to").alias("_other"))
    between = ends.where("_root <> _other").select(F.greatest("_root", "_other").alias("v"), F.least("_root", "_other").alias("to"))
    tops = _contracted(between)
    above = tops.select(F.col("v").alias("_root"), F.col("to").alias("_top"))
    stars = root.join(above.hint("merge"), "_root", "left").select("v", F.coalesce("_top", "_root").alias("to")).unionByName(tops)
    stars = cut_lineage(stars)
    roots = stars.select(F.col("to").alias("signal_id"), F.col("to").alias("component")).distinct()
    return cut_lineage(stars.select(F.col("v").alias("signal_id"), F.col("to").alias("component")).unionByName(roots))
