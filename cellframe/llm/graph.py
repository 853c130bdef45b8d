"""Connected components on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import to_many, written

#: Edges from which on joins are salted: of fewer, all that one node or label has are one task's work.
MANY = 1_000_000


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): the smallest node it is connected with.

    Each round takes the smallest label among neighbours and then that label's own label,
    so paths shorten as by pointer jumping; it ends when a round changes nothing. Rounds
    are written to the shared folder, by as many tasks as the number of edges asks for; ``edges``
    should be a written table, as they are counted first. Loops and repeated edges do no harm; no edges give
    no rows. A node with many neighbours and the label of a large component are salted keys.
    """
    most = 2 * edges.count()
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", most)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("comp")), "labels", most)
    join = to_many if both.count() > MANY else lambda rows, facts, key, by: rows.join(facts, key)
    while True:
        far = labels.select(F.col("node").alias("b"), F.col("comp").alias("theirs"))
        near = join(both, far, "b", "a").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("comp").alias("end"))
        after = join(step, jump, "mid", "node").select("node", F.least("mid", "end").alias("comp"), (F.least("mid", "end") != F.col("old")).alias("changed"))
        after = written(after, "labels", most)
        if after.filter("changed").isEmpty():
            return after.select("node", "comp")
        labels = after.select("node", "comp")
