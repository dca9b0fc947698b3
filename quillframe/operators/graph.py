"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.plans.tables import discard, lookup, written

#: The steps need about the logarithm of the longest path; this is only a guard against a loop without end.
MAX_ROUNDS = 60


def _star(edges: DataFrame, n: int, large: bool) -> DataFrame:
    """One step over n edges. large: larger neighbours of a node go to the least node near it; small: all smaller ones and itself do."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("rows"))
    joined = lookup(both, least, "a", 2 * n if large else n)
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
    return out.filter("a != b").distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number and sum of hashes of the edges."""
    n, total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return n, int(total or 0)


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b long) to (node, component), the component being its least node; nodes without a link don't appear."""
    now = written(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        middle = written(_star(now, mark[0], True), "edges")
        then = written(_star(middle, _mark(middle)[0], False), "edges")
        seen = _mark(then)
        discard(now)
        discard(middle)
        now = then
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        mark = seen
    raise ArithmeticError(f"the components didn't settle in {MAX_ROUNDS} rounds")
