"""Connected components of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.plans.durable import materialise

# Stars need one round, and groups of a few of them some more; beyond that labels take shortcuts.
PLAIN_ROUNDS = 3


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): the smallest node it is connected with.

    Each round every node takes the smallest label among itself and its neighbours.
    Minima are aggregated before the shuffle, so a node with very many links is no hot
    group; each round is written down and the next one reads it.  From some round on every
    label is replaced by its own label too, which doubles the way labels travel, so that
    long chains take few rounds.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other"))).where("node <> other")
    both = materialise(both.distinct(), name="neighbours")
    labels = materialise(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), name="labels")
    rounds = 0
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), "label"), "other").select(
            "node", "label", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        moved = heard.unionByName(labels.select("node", "label", F.col("label").alias("old"))).groupBy("node").agg(
            F.min("label").alias("label"), F.min("old").alias("old"))
        if rounds >= PLAIN_ROUNDS:
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
            moved = moved.join(jump, "label", "left").select(
                "node", F.least("label", F.coalesce("further", "label")).alias("label"), "old")
        moved = materialise(moved, name="labels")
        labels, rounds = moved.select("node", "label"), rounds + 1
        if moved.where("label <> old").isEmpty():
            return labels
