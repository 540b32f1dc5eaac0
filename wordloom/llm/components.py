"""Connected components of a large graph by alternating star operations."""

from pyspark.sql import DataFrame, functions as F

from wordloom.plans.storage import drop_path, written

def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest, to see whether a round changed anything."""
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(hash(b, a))")).first())


def _least_neighbour(edges: DataFrame, by: str, to: str) -> DataFrame:
    """Map-side partial minima, so a hub costs one row per task."""
    return edges.groupBy(F.col(by).alias("hub")).agg(F.min(to).alias("least"))


def _large_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """Link every larger neighbour of a node to the least node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least, path = written(_least_neighbour(both, "a", "b").withColumn("least", F.least("hub", "least")), "least")
    star = (both.filter("b > a").join(least, F.col("a") == F.col("hub"))
            .select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b"))
    return star.distinct(), path


def _small_star(edges: DataFrame) -> tuple[DataFrame, str]:
    """Link a node and its smaller neighbours to the least of them; edges point from a to a smaller b."""
    least, path = written(_least_neighbour(edges, "a", "b"), "least")
    joined = edges.join(least, F.col("a") == F.col("hub"))
    star = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")
    return star.union(least.select(F.col("hub").alias("a"), F.col("least").alias("b"))).distinct(), path


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node reachable, for every node that is the larger end of a link.

    Nodes that are their component's least, or have no links, are left out: callers use their own id.
    Rounds grow with the logarithm of the longest path. Each round is written to the shared folder,
    minima are stored before the join so that Spark can split the links of a hub among tasks, and
    nothing but a count and a digest comes to the driver. Links with a null end are ignored.
    """
    ends = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).cast("bigint").alias("a"), F.least(a, b).cast("bigint").alias("b"))
    current, old = written(ends.filter(F.col("a") > F.col("b")).distinct(), "links")
    state = _state(current)
    while state[0]:
        large, p1 = _large_star(current)
        middle, p2 = written(large, "links")
        small, p3 = _small_star(middle)
        current, path = written(small, "links")
        for done in (old, p1, p2, p3):
            drop_path(edges.sparkSession, done)
        before, old, state = state, path, _state(current)
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
