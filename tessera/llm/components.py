"""Connected components of a link table, by alternating star operations (Kiveris et al., 2014).

Each round is two aggregations and joins over links; what a node links to is summed to a minimum before it
is shuffled, and links of a hub are joined, not gathered, so no node's links meet in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize

MAX_ROUNDS = 60


def _ordered(links: DataFrame) -> DataFrame:
    """Distinct links with the larger end first."""
    return links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))


def _mark(links: DataFrame):
    return links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of ``links`` (``u``, ``v`` long, in any order).

    Nodes without links don't appear. Repeated links, both directions and self-links are allowed; links with a
    null end are left out.
    """
    now = materialize(_ordered(links.where("u is not null and v is not null")))
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        if mark[0] == 0:
            break
        nxt = materialize(_ordered(_small_star(_ordered(_large_star(now)))))
        old, mark = mark, _mark(nxt)
        now = nxt
        if mark == old:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
