"""Connected components of links, by the smallest node that can be reached."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rows of links or labels to one task and its file. For each file an executor on a mounted folder may have to start processes
#: (Hadoop without its native library runs chmod), so a few rows aren't dealt out over as many files as there are tasks.
FILE_ROWS = 250_000


def files(rows: int) -> int:
    """Files for a table of so many links or labels."""
    return 1 + rows // FILE_ROWS


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node of ``links`` (a, b).

    Each round a node takes the least label around it, and then the label of that label, so chains shorten by half; links
    to a frequent node are joined, never gathered. Labels are a table in the shared folder after each round.
    ``links`` is read more than once and should be a table itself.
    """
    both = links.select("a", "b").where("a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    n = files(2 * links.count())
    both = written(both.coalesce(n), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    labels = written(labels.coalesce(n), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(both["a"].alias("node")).agg(F.min("component").alias("around"))
        low = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "around").alias("low"))
        of = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        new = low.join(of, "low", "left").select("node", "was", F.least("low", "lower").alias("component"))
        new = written(new.coalesce(n), "labels")
        labels = new.select("node", "component")
        if new.where("was <> component").isEmpty():
            return labels
