"""Connected components of an undirected graph, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import cut, few, release


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a, b): the smallest node that it reaches.

    Labels go to the smallest label among neighbours, then to that label's own label, until none changes: the
    number of rounds follows the logarithm of the longest path rather than its length. Every round is written to
    the shared checkpoint folder, and removed when the next one stands. Loops and repeated edges do no harm; null
    ends are left out; no edges, no rows. Both joins of a round are plain equality joins, which Spark splits where
    one node has very many edges.
    """
    clean = edges.select("a", "b").dropna().filter("a <> b")
    both = cut(clean.union(clean.select("b", "a")))
    rows = both.count()
    done = cut(few(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), rows))
    while True:
        labels = done.select("node", "label")
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("_node")).agg(F.min("label").alias("_near"))
        hooked = labels.join(near, labels["node"] == near["_node"]).select("node", F.col("label").alias("old"), F.least("label", "_near").alias("label"))
        up = labels.select(F.col("node").alias("_up"), F.col("label").alias("_higher"))
        jumped = hooked.join(up, hooked["label"] == up["_up"], "left").select("node", "old", F.least("label", "_higher").alias("label"))
        before, done = done, cut(few(jumped, rows))
        release(before)
        if done.filter("old <> label").isEmpty():
            release(both)
            out = done.select("node", "label")
            out._groundwork_path = done._groundwork_path
            return out
