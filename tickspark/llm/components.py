"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickspark.llm.common import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, comp) for each node of ``edges``; comp is the smallest node of its component.

    Every round each node takes the smallest label among its neighbours and then the label of that label, so a
    path of n nodes needs about log n rounds. Rounds are written to the shared folder.
    """
    both = materialise(
        edges.select(F.col(a).alias("node"), F.col(b).alias("peer"))
        .union(edges.select(F.col(b), F.col(a)))
        .where("node != peer")
        .distinct(),
        "component-edges",
    )
    labels = materialise(
        both.groupBy("node").agg(F.least(F.col("node"), F.min("peer")).alias("comp")), "component-labels"
    )
    for _ in range(max_rounds):
        of_peer = labels.select(F.col("node").alias("peer"), F.col("comp").alias("seen"))
        near = both.join(of_peer, "peer").groupBy("node").agg(F.min("seen").alias("seen"))
        stepped = labels.join(near, "node").select("node", "comp", F.least("comp", "seen").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("beyond"))
        moved = materialise(
            stepped.join(jump, "next", "left").select(
                "node", F.least("next", "beyond").alias("comp"), (F.col("comp") != F.least("next", "beyond")).alias("new")
            ),
            "component-labels",
        )
        labels = moved.select("node", "comp")
        if moved.where("new").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
