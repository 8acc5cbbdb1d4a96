"""Connected components by random contraction, in a number of rounds that grows like a logarithm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lingualoom.session import discard, stage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, label`` for every node of ``edges`` (64-bit ids): equal labels are one component.

    In each round every node takes the smallest hash among itself and its neighbours as its new
    name, and the edges are renamed; a constant share of the nodes disappears.  ``xxhash64`` of one
    64-bit number is a bijection, so distinct nodes never fall together by chance.  Only minima are
    aggregated (with map-side combine) and joins have one unique side, so a node with very many
    neighbours is never gathered in one task.  Each round is written to the shared folder.
    Edges with a null end are ignored; an empty input has no nodes.
    """
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    live = stage(
        edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(low.alias("a"), high.alias("b"))
        .distinct(),
        "edges",
    )
    both = live.select(F.col("a").alias("node")).union(live.select("b")).distinct()
    names = stage(both.withColumn("label", F.col("node")), "labels")
    live, spent, turn = live.filter("a <> b"), live, 0
    while not live.isEmpty():
        turn += 1

        def renamed(c: Column, turn: int = turn) -> Column:
            return F.xxhash64(c.bitwiseXOR(F.lit(turn).cast("long")))

        directed = live.select("a", "b").union(live.select("b", "a"))
        chosen = stage(
            directed.groupBy("a")
            .agg(F.min(renamed(F.col("b"))).alias("best"))
            .select("a", F.least("best", renamed(F.col("a"))).alias("best")),
            "contraction",
        )
        step = chosen.select(F.col("a").alias("label"), "best")
        new_names = stage(
            names.join(step, "label", "left").select(
                "node", F.coalesce("best", renamed(F.col("label"))).alias("label")
            ),
            "labels",
        )
        new_live = stage(
            live.join(chosen.withColumnRenamed("best", "x"), "a")
            .join(chosen.select(F.col("a").alias("b"), F.col("best").alias("y")), "b")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .filter("a <> b")
            .distinct(),
            "edges",
        )
        discard(names, chosen, spent)
        names, live, spent = new_names, new_live, new_live
    discard(spent)
    return names
