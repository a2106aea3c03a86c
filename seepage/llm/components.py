"""Connected components of an edge table as joins and aggregations.

Every vertex carries a label, at first itself. A round gives each vertex the
smallest label among itself and its neighbours, then follows labels once
(label of the label), and writes the result to the shared folder. It ends when a
round changes nothing. Both steps aggregate before they shuffle, so a vertex
with very many neighbours costs a row for each task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(v, comp) for all vertices of edges (a, b); comp is the smallest vertex reachable."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels["v"] == near["a"], "left").select("v", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("v").alias("u"), F.col("comp").alias("up"))
        step = written(step.join(up, step["comp"] == up["u"], "left").select("v", "old", F.least("comp", "up").alias("comp")), "labels")
        changed = step.where("old <> comp").limit(1).count()
        labels = step.select("v", "comp")
        if not changed:
            return labels
