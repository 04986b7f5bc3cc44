"""Connected components of a large graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .exchange import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and the smallest ``component`` member for every node of the links (columns ``a`` and ``b``).

    Large stars hang a node's larger neighbours, small stars its smaller ones, below the
    smallest neighbour, until all links are stars. Each round is two map-side combined minima
    and two joins on a key; a hub's links are split by the skew handling of those joins. A round's
    links are written to the shared folder.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    last = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == last:
            return links.selectExpr("a AS node", "b AS component").unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last = state
        both = links.select("a", "b").unionAll(links.selectExpr("b AS a", "a AS b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        links = stored(small.select("a", F.col("m").alias("b")).unionAll(small.where("b <> m").selectExpr("b AS a", "m AS b")).distinct(), "links")
