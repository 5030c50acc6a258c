"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import quoted
from ..sources.scratch import BROADCAST_ROWS, small_tasks, stored


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (u, v): label is the smallest node reachable.

    Alternates large-star and small-star, each a minimum per node and a join back, never a list of neighbours, so that a
    hub with many links is summed in parts.  Joins go by a struct of the node, so that both sides are fresh exchanges,
    which adaptive execution can split.  Rounds and labels are written to the shared folder, in small tasks.  Self loops
    and repeated edges are allowed; rows with a null end are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    with small_tasks(spark):
        e = edges.where("u IS NOT NULL AND v IS NOT NULL").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        e = stored(e.distinct(), "edges")
    with small_tasks(spark, e.count()):
        nodes = e.select(F.col("u").alias("node")).union(e.select(F.col("v").alias("node"))).distinct()
        label = _stars(e.where("u <> v"), most_rounds).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
        return stored(nodes.join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")


def _stars(e: DataFrame, most_rounds: int) -> DataFrame:
    """Edges (u, v) from each node to the smallest of its component, itself left out."""
    mark = None
    key = F.struct("u").alias("k")
    for _ in range(most_rounds):
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark or now[0] == 0:
            break
        mark = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").select(key, F.col("v").alias("w")).join(least.select(key, "m"), "k").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = stored(large.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.select(key, F.col("v").alias("w")).join(least.select(key, "m"), "k").select(F.col("w").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v")
        e = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e


def label_edges(df: DataFrame, f: str, g: str, name: str) -> DataFrame:
    """df with a column `name`: the smallest vertex of each row's component; rows with a null end take the other end."""
    labels = connected_components(df.select(quoted(f).alias("u"), quoted(g).alias("v")))
    end = F.coalesce(quoted(f), quoted(g))
    rest = [quoted(c) for c in df.columns if c != name]
    node, label = (next(n for i in range(len(df.columns) + 1) if (n := base + "_" * i) not in {c.lower() for c in df.columns}) for base in ("_node", "_label"))
    labels = labels.select(F.struct("node").alias(node), F.col("label").alias(label))
    if labels.count() > BROADCAST_ROWS:
        labels = labels.hint("merge")  # a file of few MB may hold millions of labels
    joined = df.join(labels, F.struct(end.alias("node")) == F.col(node), "left")
    return joined.select(*rest, F.coalesce(F.col(label), end).alias(name))
