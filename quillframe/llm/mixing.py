"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source with share s of the rows and target weight w is repeated w / s times in the mean. Each row's uniform number
comes from a seeded hash of its doc_id and source; the Poisson distribution with that mean is inverted at it, the
row is emitted so many times, and a hashed key deals all copies out over partitions and orders them there.

By default a source's weight grows with the square root of its rows. The distributions are one row per source with the
cumulative probabilities, summed as ratios to the first term, so that no mean is too large. Up to BROADCAST_CELLS of them in all
are broadcast, so that texts are shuffled once, by the key that deals them out; beyond that only the distributions of hot
sources are, and rows of the others are joined by a shuffle.

Nulls and edge cases: a null source is a source of its own; a source without a target weight in a given table gets 0
copies; a null doc_id or source hashes as a fixed mark; equal rows get equal counts; an empty table stays empty. All columns are
kept, whatever their names, but for input columns named like the operator's own, mix_copy and mix_key; plain=True adds none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._base import free_names, lookup, written

SEED = "mix-1"
#: Exponent of a source's rows in its default weight.
FLATTEN = 0.5
#: Copies of a row made from one array; rows of more are dealt out in such blocks first.
BLOCK = 10_000
#: Cumulative probabilities broadcast at most, 8 bytes each.
BROADCAST_CELLS = 2_000_000


def hashed(*parts: Column) -> Column:
    """What is hashed: the parts with bars between, null as a fixed mark."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("~")) for p in parts))


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 over the parts, as a double in [0, 1)."""
    return F.conv(F.substring(F.md5(hashed(*parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _rated(docs: DataFrame, weights: DataFrame | None, flatten: float) -> tuple[DataFrame, int, float, float]:
    """(source, n, mean) for every source, the number of rows, the largest mean, and the number of probabilities needed."""
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(flatten)))
    else:
        given = weights.groupBy(F.col("source").alias("__s")).agg(F.sum("weight").alias("weight"))
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "n", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"))
    weighed = written(weighed, "sources")
    rows, weight = weighed.agg(F.sum("n"), F.sum("weight")).first()
    mean = F.col("weight") / F.lit(float(weight)) * F.lit(float(rows)) / F.col("n") if weight else F.lit(0.0)
    rated = weighed.select("source", "n", mean.alias("mean"))
    top, cells = rated.agg(F.max("mean"), F.sum(24 * F.sqrt("mean") + 64)).first()
    return rated, rows or 0, top or 0.0, cells or 0.0


def rates(docs: DataFrame, weights: DataFrame | None = None, flatten: float = FLATTEN) -> DataFrame:
    """(source, rows, mean) for every source; weights: a table (source, weight)."""
    return _rated(docs, weights, flatten)[0]


def distributions(means: DataFrame) -> DataFrame:
    """(source, mean, first, cdf): cumulative probabilities of first, first + 1, ...; what lies outside is under exp(-60)."""
    spread = F.ceil(12 * F.sqrt("mean") + 30)
    first, last = F.greatest(F.floor("mean") - spread, F.lit(0)).cast("long"), (F.ceil("mean") + spread).cast("long")
    start = F.struct(F.lit(1.0).alias("p"), F.array(F.lit(1.0)).alias("sums"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + p)).alias("sums"))

    sums = means.select("source", "mean", first.alias("first"), F.aggregate(F.sequence(first + 1, last), start, step, lambda s: s["sums"]).alias("sums"))
    return sums.select("source", "mean", "first", "sums", F.element_at("sums", -1).alias("whole")).select("source", "mean", "first", F.transform("sums", lambda x: x / F.col("whole")).alias("cdf"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, seed: str = SEED, plain: bool = False) -> DataFrame:
    """docs, each row as often as drawn, dealt out and ordered by a hashed key."""
    names = [c for c in docs.columns if c.lower() not in ("mix_copy", "mix_key")]
    columns = [F.col(f"`{c}`") for c in names]
    docs = docs.select(*columns)
    of, begin, table, u, count, block, copy, key = free_names(docs, "of", "first", "cdf", "u", "count", "block", "mix_copy", "mix_key")
    means, total, top, cells = _rated(docs.select("source"), weights, FLATTEN)
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("~"))
    cdf = distributions(means).select(source.alias(of), F.col("first").alias(begin), F.col("cdf").alias(table))
    drawn = docs.withColumn(u, uniform(F.lit(seed), F.col("doc_id"), F.col("source"))).withColumn(of, source)
    if cells <= BROADCAST_CELLS:
        drawn = drawn.join(F.broadcast(cdf), of)
    else:
        sizes = means.select(source.alias(of), F.col("n").alias(count))
        drawn = lookup(drawn, cdf.join(sizes, of), of, total, count)
    drawn = drawn.withColumn(count, (F.col(begin) + F.size(F.filter(table, lambda c: c <= F.col(u)))).cast("int")).filter(F.col(count) > 0).drop(table)
    low, high = F.lit(1), F.col(count)
    if top > BLOCK / 2:
        last = F.floor((F.col(count) - 1) / BLOCK).cast("int")
        drawn = drawn.withColumn(block, F.explode(F.sequence(F.lit(0), last))).repartition("doc_id", block)
        low, high = F.col(block) * BLOCK + 1, F.least(F.col(count), (F.col(block) + 1) * BLOCK)
    copies = drawn.withColumn(copy, F.explode(F.sequence(low, high)))
    keyed = copies.withColumn(key, F.conv(F.substring(F.md5(hashed(F.lit(seed), F.col("doc_id"), F.col("source"), F.col(copy))), 1, 15), 16, 10).cast("bigint"))
    dealt = keyed.repartition(key).sortWithinPartitions(key, "doc_id", copy)
    return dealt.select(*columns, *([] if plain else [copy, key]))
