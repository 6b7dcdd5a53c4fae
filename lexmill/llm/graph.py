"""Connected components of a graph whose links stay on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, save


def components(links: DataFrame) -> DataFrame:
    """links: long columns a, b. Rows (node, component) for each node of a link; component: its smallest node.

    Each round hooks every node to the smallest of itself and its neighbours, follows those pointers to
    their ends by doubling, and contracts the links to what still joins two different ends. A round at least
    halves what is left of a path, and the contracted links are rewritten to the shared folder, so lineage
    stays short and an executor's loss costs one round.
    """
    spark = links.sparkSession
    links, path = save(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels, label_path = None, None
    while True:
        if links.isEmpty():
            break
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook, hook_path = save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "hooks")
        while True:
            after = hook.alias("x").join(hook.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left")
            after, after_path = save(after.select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")), "hooks")
            still = not after.where("moved").isEmpty()
            drop(spark, hook_path)
            hook, hook_path = after.select("node", "root"), after_path
            if not still:
                break
        if labels is None:
            new = hook.select("node", F.col("root").alias("component"))
        else:
            new = labels.join(hook.select(F.col("node").alias("component"), "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            # the nodes of later rounds are ends of earlier ones, so all of them have a label already
        new, new_path = save(new, "labels")
        ends = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        ends_b = hook.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        less = links.join(ends, "a").join(ends_b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        less, less_path = save(less, "links")
        drop(spark, path, hook_path, *([label_path] if label_path else []))
        links, path, labels, label_path = less, less_path, new, new_path
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("component"))
