"""Distances, order statistics and ranks, as column expressions and grouped plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.plans.tables import sums_before

# Fixed value: scales the median absolute deviation to a normal's standard deviation.
MAD_NORMAL = 1.482602218505602


def absolute(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def symmetric_proportional(a: Column, b: Column) -> Column:
    """2|a-b| / (|a|+|b|), 0 if both are."""
    total = F.abs(a) + F.abs(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(F.abs(a - b) * 2 / total)


def _total(table: Column) -> Column:
    return F.aggregate(F.map_values(table), F.lit(0).cast("bigint"), lambda s, n: s + n)


def _share(table: Column, key: Column, total: Column) -> Column:
    return F.coalesce(table[key], F.lit(0)).cast("double") / total


def jensen_shannon(p: Column, q: Column) -> Column:
    """Square root of the base-2 Jensen-Shannon divergence of two count maps, over the sorted union of their keys."""
    n, m = _total(p), _total(q)

    def part(x: Column, mid: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / mid)).otherwise(0.0)

    def step(acc: Column, key: Column) -> Column:
        a, b = _share(p, key, n), _share(q, key, m)
        return acc + (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2

    keys = F.array_sort(F.array_union(F.map_keys(p), F.map_keys(q)))
    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(F.aggregate(keys, F.lit(0.0), step), F.lit(0.0))))


def wasserstein(p: Column, q: Column) -> Column:
    """First Wasserstein distance of two histograms (maps of integer points to counts)."""
    n, m = _total(p), _total(q)
    points = F.array_sort(F.array_union(F.map_keys(p), F.map_keys(q)))
    start = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0.0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        gap = F.coalesce(x - s["last"], F.lit(0)).cast("double")
        area = s["sum"] + F.abs(s["a"].cast("double") / n - s["b"].cast("double") / m) * gap
        return F.struct(x.alias("last"), (s["a"] + F.coalesce(p[x], F.lit(0))).alias("a"), (s["b"] + F.coalesce(q[x], F.lit(0))).alias("b"), area.alias("sum"))

    return F.when((n > 0) & (m > 0), F.aggregate(points, start, step, lambda s: s["sum"]))


def sample_wasserstein(samples: DataFrame, keys: list[str], side: str, value: str) -> DataFrame:
    """Distance of two samples per group: rows (keys, side, value) with side 'left' or 'right'.

    Values are counted per group first. With D the difference of the two distributions after a value and C that before it, the
    distance is the sum of value (|C| - |D|), so that no row needs the next one.
    """
    both = {"left": F.col(side) == "left", "right": F.col(side) == "right"}
    sizes = samples.groupBy(*keys).agg(*[F.count_if(c).alias(f"all_{s}") for s, c in both.items()])
    steps = samples.groupBy(*keys, value).agg(*[F.count_if(c).alias(s) for s, c in both.items()])
    run = sums_before(steps, keys, [value], before_left="left", before_right="right").join(sizes, keys)
    share = lambda s: F.col(f"before_{s}") / F.col(f"all_{s}")
    after = lambda s: (F.col(f"before_{s}") + F.col(s)) / F.col(f"all_{s}")
    area = F.sum(F.col(value) * (F.abs(share("left") - share("right")) - F.abs(after("left") - after("right"))))
    return run.groupBy(*keys).agg(F.coalesce(area, F.lit(0.0)).alias("distance"))


def quantiles(counted: DataFrame, keys: list[str], value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """(keys, units, name ...): type-7 quantiles of counted values, one row for each value of a group; exact, without a group in one task."""
    sizes = counted.groupBy(*keys).agg(F.sum(weight).alias("units"))
    run = sums_before(counted.filter(F.col(value).isNotNull()), keys, [value], below=weight)
    run = run.join(sizes, keys) if keys else run.crossJoin(F.broadcast(sizes))
    found = []
    for name, p in shares.items():
        at = (F.col("units") - 1) * F.lit(p)
        for end, k in (("low", F.floor(at)), ("high", F.ceil(at))):
            found.append(F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col(weight)), F.col(value))).alias(f"{name}_{end}"))
    ends = run.groupBy(*keys).agg(F.first("units").alias("units"), *found)
    part = lambda p: (F.col("units") - 1) * F.lit(p) - F.floor((F.col("units") - 1) * F.lit(p))
    return ends.select(*keys, "units", *[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * part(p)).alias(n) for n, p in shares.items()])


def midrank_percentile(values: Column, x: Column) -> Column:
    """100 (below + equal / 2) / n of a value in an array."""
    below, same = F.size(F.filter(values, lambda v: v < x)), F.size(F.filter(values, lambda v: v == x))
    return (below + same / 2) * 100 / F.size(values)


def quantile(values: Column, p: float) -> Column:
    """Type-7 quantile of an ascending array."""
    at = (F.size(values) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    a, b = F.element_at(values, low + 1), F.element_at(values, F.least(low + 2, F.size(values)))
    return a + (b - a) * (at - low)


def median_deviation(values: Column) -> Column:
    """Median absolute deviation of an ascending array."""
    middle = quantile(values, 0.5)
    return quantile(F.array_sort(F.transform(values, lambda v: F.abs(v - middle))), 0.5)


def rank_auc(rows: DataFrame, keys: list[str], score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve per group, by midranks; null unless both classes are there.

    Scores are counted per distinct value first, so that ties shrink, and ranks are sums over ranges of scores.
    """
    ties = rows.groupBy(*keys, score).agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    below = sums_before(ties, keys, [score], below="neg")
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return below.groupBy(*keys).agg(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))
