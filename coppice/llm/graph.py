"""Connected components of a table of links, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import shared_root


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every id in the links (a, b): component is the smallest id reachable.

    Alternates large-star and small-star steps until nothing changes. Each step is an aggregation with map-side
    partial minima and an equi-join, whose large partitions Spark may split; rounds are checkpointed. Links to itself
    and nulls are ignored, so ids that have only such do not appear.
    """
    shared_root(links.sparkSession)
    e = (
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    )
    state = _state(e)
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = rest.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        before, state = state, _state(e)
        if before == state:
            break
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
