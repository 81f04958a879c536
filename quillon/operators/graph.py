"""Connected components over an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.storage import fresh_path, remove


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that has an edge, as ``(node, component)``; component is the smallest node.

    ``edges`` has columns ``a`` and ``b`` (same orderable type). Nulls, loops and repeated edges are ignored.
    Each round hooks every node to the smallest neighbour (large star) and then every larger neighbour of a
    node to the smallest (small star); both are an aggregate and a join on the node, so a node with very many
    neighbours is never gathered into one row, and the join can be split by adaptive execution. Every round is
    a written table in the shared folder. Empty input gives an empty result.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType
    current = (
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").cast(kind).alias("a"), F.least("a", "b").cast(kind).alias("b"))
        .distinct()
    )
    path, now = _save(current)
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        # Large star: every neighbour above a node goes to the smallest of the node and its neighbours.
        large = (
            both.filter("b > a")
            .join(low, F.col("a") == F.col("n"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        # Small star: the neighbours below a node, and the node, go to the smallest of them.
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = (
            large.join(least, F.col("a") == F.col("n"))
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .filter("a <> b")
            .distinct()
        )
        new_path, new = _save(small)
        mark = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove(spark, path)
        path, now = new_path, new
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _save(df: DataFrame) -> tuple[str, DataFrame]:
    path = fresh_path(df.sparkSession, "edges")
    df.write.parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)
