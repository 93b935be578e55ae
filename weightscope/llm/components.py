"""Connected components of a graph that no machine holds as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weightscope.llm.common import stored

#: Edges that one file of a round holds.
ROWS_A_FILE = 500_000


def components(edges: DataFrame) -> DataFrame:
    """Components from edges (a long, b long), as (node, root): root is the least node.

    Alternates two contractions until nothing changes: each node hangs its
    larger neighbours on its least neighbour, then its smaller ones. A round is
    joins and aggregates on node ids, so that a node of very many edges is
    pre-aggregated and its join split; the number of rounds grows with the
    logarithm of the component sizes. Each round is written to the shared
    folder. Nodes without edges don't appear.
    """
    now, mark = _keep(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), None)
    while mark["n"]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()
        before = mark
        now, mark = _keep(small, mark["n"])
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct()).distinct()


def _keep(edges: DataFrame, about: int | None) -> tuple[DataFrame, dict]:
    """Write edges; with them two numbers that any change of them changes.

    ``about`` is how many there were: few edges go to few files.
    """
    seen = Observation()
    if about is not None:
        edges = edges.coalesce(about // ROWS_A_FILE + 1)
    hashed = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
    kept = stored(edges.observe(seen, F.count(F.lit(1)).alias("n"), hashed.alias("hash")), "edges")
    return kept, dict(seen.get)
