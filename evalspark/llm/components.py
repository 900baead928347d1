"""Connected components of a link table, by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.staging import stage


def _large_star(both: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node of the neighbourhood."""
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(down: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    moved = down.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))


def _links(df: DataFrame) -> DataFrame:
    return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Nodes of links (a, b), each with the least node of its component: (node, root). Nodes without links are absent.

    Each round is written to the shared folder, so lineage stays short; only a count and a checksum reach the driver.
    The rounds end when the links are stars, that is when a round changes nothing. Nulls and self links are ignored.
    """
    current = stage(_links(links.select("a", "b").dropna()), name="links")
    state = None
    while True:
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or seen[0] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = seen
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        current = stage(_links(_small_star(_links(_large_star(both)))), name="links")
