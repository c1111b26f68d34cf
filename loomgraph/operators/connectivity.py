"""Connected components of an undirected graph by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.runtime import cut_to, drop_path


def components(edges: DataFrame, scope: str = "doc_id", max_rounds: int = 100) -> DataFrame:
    """(scope, v, root) of every vertex of ``edges`` (scope, a, b): the root is the component's least vertex.

    Each round takes the least label among a vertex and its neighbours (a partial minimum before the
    shuffle), then the label of that label, so labels travel twice as far every round. Null ends are ignored.
    """
    usable = edges.where(F.col(scope).isNotNull() & F.col("a").isNotNull() & F.col("b").isNotNull())
    both = usable.select(scope, F.col("a").alias("u"), F.col("b").alias("w")).union(usable.select(scope, F.col("b").alias("u"), F.col("a").alias("w"))).distinct()
    links, links_path = cut_to(both, "cc-links")
    labels, path = cut_to(links.groupBy(scope, F.col("u").alias("v")).agg(F.min(F.least("u", "w")).alias("root")), "cc-labels")
    spark = edges.sparkSession
    for _ in range(max_rounds):
        near = links.join(labels.select(scope, F.col("v").alias("w"), F.col("root").alias("offer")), [scope, "w"]).groupBy(scope, F.col("u").alias("v")).agg(F.min("offer").alias("offer"))
        better = labels.join(near, [scope, "v"]).select(scope, "v", F.col("root").alias("was"), F.least("root", "offer").alias("root"))
        jump = better.select(scope, F.col("v").alias("root"), F.col("root").alias("next"))
        after, after_path = cut_to(better.join(jump, [scope, "root"], "left").select(scope, "v", "was", F.least("root", F.coalesce("next", "root")).alias("root")), "cc-labels")
        drop_path(spark, path)
        labels, path = after.drop("was"), after_path
        if after.where("was <> root").isEmpty():
            drop_path(spark, links_path)
            return labels
    raise RuntimeError(f"labels still move after {max_rounds} rounds")


def label_groups(edges: DataFrame, scope: str = "doc_id") -> DataFrame:
    """(scope, root, members) of the components with more than one vertex, members sorted."""
    return components(edges, scope).groupBy(scope, "root").agg(F.array_sort(F.collect_list("v")).alias("members")).where("size(members) > 1")
