"""Connected components of an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``root`` for every end of an edge (a, b); a component shares one root.

    Each round hooks every node to its smallest neighbour, shortens the chains
    and contracts the edges; the rounds grow with the logarithm of the longest
    chain. Only counts come to the driver, and each round is written out.
    """
    now = stored(edges.select("a", "b").where("a != b").distinct(), f"{name}-edges")
    label = None
    while not now.isEmpty():
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")).select("node", F.least("node", "up").alias("up"))
        hook = stored(hook, f"{name}-hooks")
        for _ in range(2):
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(above, "up").select("node", F.col("top").alias("up"))
        hook = stored(hook, f"{name}-roots")
        if label is None:
            label = hook.withColumnRenamed("up", "root")
        else:
            onward = hook.select(F.col("node").alias("root"), "up")
            label = stored(label.join(onward, "root", "left").select("node", F.coalesce("up", "root").alias("root")), f"{name}-labels")
        a, b = hook.select(F.col("node").alias("a"), F.col("up").alias("ra")), hook.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        now = stored(now.join(a, "a").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a != b").distinct(), f"{name}-edges")
    return label if label is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
