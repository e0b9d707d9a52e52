"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewise.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``links`` (x, y: bigint) to (node, root): root is one node per component.

    Each round every node takes its least neighbour (itself included) as label, the links
    are contracted to links between labels, and the maps of the rounds are composed. Links
    shrink geometrically; minima combine map-side, so a hub with very many links is no
    more than any other node to the task that owns it. Nodes without links do not appear.
    """
    links = cut(links.where("x <> y").select(F.least("x", "y").alias("x"),
                                             F.greatest("x", "y").alias("y")).distinct(), "cc-links")
    roots = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        label = cut(both.groupBy(F.col("x").alias("node")).agg(
            F.least(F.col("x"), F.min("y")).alias("root")), "cc-labels")
        roots = label if roots is None else cut(
            roots.join(label.select(F.col("node").alias("root"), F.col("root").alias("next")),
                       "root", "left")
            .select("node", F.coalesce("next", "root").alias("root")), "cc-roots")
        ends = (links.join(label.select(F.col("node").alias("x"), F.col("root").alias("a")), "x")
                .join(label.select(F.col("node").alias("y"), F.col("root").alias("b")), "y"))
        links = cut(ends.where("a <> b").select(F.least("a", "b").alias("x"),
                                                F.greatest("a", "b").alias("y")).distinct(), "cc-links")
    if roots is None:
        return links.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots
