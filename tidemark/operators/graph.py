"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.common import release, written


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root): the least node that each node of ``edges`` (a, b) is connected to.

    Labels spread along edges and then jump to their label's label, so rounds
    grow with the logarithm of a component's width; each round is written.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        spread = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        roots = labels.select(F.col("node").alias("via"), F.col("root").alias("onward"))
        jumped = written(spread.join(roots, F.col("root") == F.col("via"), "left").select("node", "old", F.least("root", F.coalesce("onward", "root")).alias("root")))
        before, labels = labels, jumped.select("node", "root")
        labels._tidemark_path = jumped._tidemark_path
        release(before)
        if jumped.where("root <> old").isEmpty():
            release(both)
            return labels
