"""Pooling of observations over evidence sets, and comparison of pools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions import stats
from quillframe.operators.compare import METRICS
from quillframe.operators.text import summarized_at_scale
from quillframe.plans.registry import FEATURES


def _ids(reducer: str) -> list[str]:
    return [f.feature_id for f in FEATURES.values() if f.reducer == reducer]


def _members(members: DataFrame, observations: DataFrame) -> DataFrame:
    return observations.join(members.select("set_id", "artifact_id"), "artifact_id")


def pooled_status(members: DataFrame, observations: DataFrame) -> DataFrame:
    """Members of each set by feature and status; an artifact without the feature counts as unavailable."""
    found = _members(members, observations).groupBy("set_id", "feature_id", "status").agg(F.count(F.lit(1)).alias("n"))
    sizes = members.groupBy("set_id").agg(F.count(F.lit(1)).alias("members"))
    seen = found.groupBy("set_id", "feature_id").agg(F.sum("n").alias("seen")).join(sizes, "set_id").filter("seen < members")
    absent = seen.select("set_id", "feature_id", F.lit("unavailable").alias("status"), (F.col("members") - F.col("seen")).alias("n"))
    return found.unionByName(absent).groupBy("set_id", "feature_id", "status").agg(F.sum("n").alias("n"))


def pooled_counts(members: DataFrame, observations: DataFrame) -> DataFrame:
    """Features that don't pool: (set_id, feature_id, samples, missing)."""
    rows = pooled_status(members, observations).filter(F.col("feature_id").isin(_ids("NONE")))
    ok = F.col("status") == "ok"
    return rows.groupBy("set_id", "feature_id").agg(F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("samples"), F.coalesce(F.sum(F.when(~ok, F.col("n"))), F.lit(0)).alias("missing"))


def pooled_sums(members: DataFrame, observations: DataFrame) -> DataFrame:
    """Exact sums of counts."""
    rows = _members(members, observations).filter(F.col("feature_id").isin(_ids("SUM")) & (F.col("status") == "ok"))
    return rows.groupBy("set_id", "feature_id").agg(F.sum("int_value").alias("value"), F.count(F.lit(1)).alias("samples"))


def pooled_ratios(members: DataFrame, observations: DataFrame) -> DataFrame:
    """Ratios of summed numerators and denominators."""
    rows = _members(members, observations).filter(F.col("feature_id").isin(_ids("RATIO")) & (F.col("status") == "ok"))
    sums = rows.groupBy("set_id", "feature_id").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.count(F.lit(1)).alias("samples"))
    return sums.withColumn("value", F.try_divide("numerator", "denominator"))


def pooled_keys(members: DataFrame, observations: DataFrame, reducer: str) -> DataFrame:
    """Sums per key of distributions (CAT) or per point of histograms (HIST): (set_id, feature_id, key, n).

    A member's entries are summed before the shuffle, so that a set with most members is in no one task.
    """
    column = "cat" if reducer == "CAT" else "hist"
    rows = _members(members, observations).filter(F.col("feature_id").isin(_ids(reducer)) & (F.col("status") == "ok"))
    return rows.select("set_id", "feature_id", F.explode(column).alias("key", "n")).groupBy("set_id", "feature_id", "key").agg(F.sum("n").alias("n"))


def pooled_samples(members: DataFrame, observations: DataFrame) -> DataFrame:
    """Summary statistics of scalars that don't add up."""
    rows = _members(members, observations).filter(F.col("feature_id").isin(_ids("SAMPLE")) & (F.col("status") == "ok"))
    return summarized_at_scale(rows, ["set_id", "feature_id"], "scalar")


def compared_pools(pairs: DataFrame, members: DataFrame, observations: DataFrame) -> DataFrame:
    """pairs(pair_id, left, right) of sets to (pair_id, feature_id, metric, value)."""
    sides = [pairs.select("pair_id", F.col(s).alias("set_id"), F.lit(s).alias("side")) for s in ("left", "right")]
    ends = sides[0].unionByName(sides[1])
    out = []
    for reducer, column, kernel, metric in (("CAT", "cat", stats.jensen_shannon, "JSD2"), ("HIST", "hist", stats.wasserstein, "W1")):
        keys = pooled_keys(members, observations, reducer).filter(F.col("feature_id").isin(list(METRICS)))
        maps = keys.groupBy("set_id", "feature_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(column))
        both = maps.join(ends, "set_id").groupBy("pair_id", "feature_id").agg(*[F.first(F.when(F.col("side") == s, F.col(column)), ignorenulls=True).alias(s) for s in ("left", "right")])
        out.append(both.filter("left is not null and right is not null").select("pair_id", "feature_id", F.lit(metric).alias("metric"), kernel(F.col("left"), F.col("right")).alias("value")))
    ratios = pooled_ratios(members, observations).join(ends, "set_id").groupBy("pair_id", "feature_id").agg(*[F.first(F.when(F.col("side") == s, F.col("value")), ignorenulls=True).alias(s) for s in ("left", "right")])
    out.append(ratios.filter("left is not null and right is not null").select("pair_id", "feature_id", F.lit("ABS").alias("metric"), F.abs(F.col("left") - F.col("right")).alias("value")))
    comparable = [f for f in _ids("SAMPLE") if f in METRICS]
    rows = _members(members, observations).filter(F.col("feature_id").isin(comparable) & (F.col("status") == "ok")).join(ends, "set_id")
    whole = rows.groupBy("pair_id", "feature_id").agg(F.countDistinct("side").alias("sides")).filter("sides = 2").drop("sides")
    samples = stats.sample_wasserstein(rows.join(whole, ["pair_id", "feature_id"], "left_semi"), ["pair_id", "feature_id"], "side", "scalar")
    out.append(samples.select("pair_id", "feature_id", F.lit("sample_wasserstein_1").alias("metric"), F.col("distance").alias("value")))
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])
