"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import release, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every end of ``edges`` (a, b): the smallest id reachable.

    Each round every node learns the smallest label among its neighbours, hands it to the node that its
    own label names, and then follows its label once (pointer jumping), so chains halve each round.  A star
    of any size is summed up before the shuffle.  Rounds stop when no label changes.
    """
    pairs = edges.select("a", "b").filter("a <> b").distinct()
    both = stored(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    latest = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    labels = latest
    while True:
        told = (
            both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("told"))
        )
        seen = labels.join(told, labels.id == told.a).select(
            "id", "label", F.least("label", "told").alias("best")
        )
        # A node's label is itself a node: it learns what those that name it have learnt.
        handed = seen.groupBy(F.col("label").alias("h")).agg(F.min("best").alias("handed"))
        hooked = seen.join(handed, seen.id == handed.h, "left").select(
            "id", "label", F.least("best", "handed").alias("new")
        )
        hooked = stored(hooked)
        up = hooked.select(F.col("id").alias("u"), F.col("new").alias("above"))
        jumped = stored(
            hooked.join(up, hooked.new == up.u, "left").select(
                "id", F.least("new", "above").alias("next"), F.col("label").alias("old")
            )
        )
        release(latest, hooked)
        latest = jumped
        labels = jumped.select("id", F.col("next").alias("label"))
        if not jumped.filter("next <> old").limit(1).count():
            release(both)
            return labels
