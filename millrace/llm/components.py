"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import saved


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row.n, row.h


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links(a, b)`` that is not the smallest of
    its component; component is the smallest id reachable. Ids left out are their
    own component. Null ends and loops are ignored.

    Rounds of large-star and small-star: each id's smallest neighbour is a
    partial minimum, then its links move over to that neighbour, until the links
    are stars. Minima are written before they are joined, so a hub's links stay
    a plain join side that can be split or met by a broadcast. Links live in the
    shared folder between rounds; nothing but two numbers reaches the driver.
    """
    edges = saved(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(
            both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "minima"
        )
        large = saved(
            both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "large",
        )
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        edges = saved(
            large.join(least, "a")
            .filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct(),
            "links",
        )
        now = _signature(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
