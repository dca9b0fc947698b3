"""Comparison of two artifacts feature by feature, for any number of pairs in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import stats
from quillframe.operators import gates
from quillframe.plans.registry import FEATURES
from quillframe.plans.tables import sums_before, written

METRICS = {f.feature_id: f.metric for f in FEATURES.values() if f.metric != "NONE"}
UNITS = {"ABS": "proportion points on [0,1]", "JSD2": "distance on [0,1]"}


def _side(pairs: DataFrame, observations: DataFrame, side: str) -> DataFrame:
    fields = [c for c in ("status", "scalar", "cat", "hist", "support_count", "compat_sha256", *gates.SIGNATURE) if c in observations.columns]
    own = observations.filter(F.col("feature_id").isin(list(METRICS))).select(F.col("artifact_id").alias(side), "feature_id", *[F.col(c).alias(f"{side}_{c}") for c in fields])
    return pairs.join(own, side).select("pair_id", "feature_id", *[f"{side}_{c}" for c in fields])


def distance(metric: Column) -> Column:
    """The distance of a feature's metric between the left and right values."""
    return (
        F.when(metric == "ABS", stats.absolute(F.col("left_scalar"), F.col("right_scalar")))
        .when(metric == "SPD", stats.symmetric_proportional(F.col("left_scalar"), F.col("right_scalar")))
        .when(metric == "JSD2", stats.jensen_shannon(F.col("left_cat"), F.col("right_cat")))
        .when(metric == "W1", stats.wasserstein(F.col("left_hist"), F.col("right_hist")))
    )


def compared(pairs: DataFrame, observations: DataFrame) -> DataFrame:
    """pairs(pair_id, left, right) to one row per pair and comparable feature of either side.

    value is null and reason is given where the feature isn't ok on both sides, or, of observations that gates.signed()
    signed, where the two aren't compatible: the first condition that fails. Equal hashes are compatible.
    """
    both = _side(pairs, observations, "left").join(_side(pairs, observations, "right"), ["pair_id", "feature_id"], "full")
    ok = (F.col("left_status") == "ok") & (F.col("right_status") == "ok")
    parted = F.lit(None).cast("string")
    if "left_compat_sha256" in both.columns:
        sides = [{c: F.col(f"{side}_{c}") for c in gates.SIGNATURE} for side in ("left", "right")]
        equal = F.coalesce(F.col("left_compat_sha256") == F.col("right_compat_sha256"), F.lit(False))
        parted = F.when(~equal, gates.mismatch(F.col("feature_id"), *sides))
    metric = F.create_map(*[F.lit(x) for kv in METRICS.items() for x in kv])[F.col("feature_id")]
    reason = F.when(~F.coalesce(ok, F.lit(False)), "FEATURE_NOT_COMPARABLE").otherwise(parted)
    rows = both.withColumn("metric", metric).withColumn("reason", reason)
    return rows.select(
        "pair_id", "feature_id", "metric", F.when(F.col("reason").isNull(), distance(F.col("metric"))).alias("value"), F.col("left_support_count").alias("left_support"), F.col("right_support_count").alias("right_support"),
        "reason", F.coalesce("left_status", F.lit("unavailable")).alias("left_status"), F.coalesce("right_status", F.lit("unavailable")).alias("right_status"),
    )


def neighbours(artifacts: DataFrame, group: str, order: str) -> DataFrame:
    """(pair_id, left, right): each artifact with the next one of its group, for tests and examples; ranks are taken by ranges."""
    rows = sums_before(artifacts.select("artifact_id", group, F.col(order).alias("by"), F.lit(1).alias("one")), [group], ["by"], at="one")
    left, right = rows.select(group, F.col("artifact_id").alias("left"), (F.col("at") + 1).alias("at")), rows.select(group, "at", F.col("artifact_id").alias("right"))
    return left.join(right, [group, "at"]).select(F.concat_ws("-", F.col("left").cast("string"), F.col("right").cast("string")).alias("pair_id"), "left", "right")


#: Sections of what stands in a source, and the kinds of text in each.
SECTIONS = {"embedded.comments": ("comment_block", "inline_comment"), "embedded.docstrings": ("docstring",)}


def compared_bundles(pairs: DataFrame, observations: DataFrame, embedded: DataFrame, measured) -> DataFrame:
    """(pair_id, feature_id, metric, value) of sources and of the prose in them: embedded(artifact_id, ordinal, kind, text).

    The texts of a source's section are measured by measured(artifacts), pooled and compared as a set; features of a section
    carry its name in front. A section that one side hasn't is skipped.
    """
    from quillframe.operators import aggregate

    fields = ["pair_id", "feature_id", "metric", "value"]
    out = compared(pairs, observations).filter("value is not null").select(*fields)
    key = F.concat_ws(":", F.col("artifact_id").cast("string"), F.col("ordinal").cast("string"))
    texts = embedded.select(key.alias("artifact_id"), F.col("artifact_id").alias("parent"), "kind", "text", F.lit("und").alias("language"))
    found = written(measured(texts.drop("parent", "kind")), "embedded-observations")
    for name, kinds in SECTIONS.items():
        members = texts.filter(F.col("kind").isin(*kinds)).select(F.col("parent").alias("set_id"), "artifact_id")
        pools = aggregate.compared_pools(pairs, members, found)
        out = out.unionByName(pools.withColumn("feature_id", F.concat_ws(".", F.lit(name), "feature_id")).select(*fields))
    return out


def endpoints(pairs: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs whose ends exist, and (pair_id, unknown) for the others."""
    ids = artifacts.select(F.col("artifact_id").alias("known")).distinct()
    ends = pairs.select("pair_id", F.explode(F.array("left", "right")).alias("end"))
    unknown = ends.join(ids, ends.end == ids.known, "left_anti").select("pair_id", F.col("end").alias("unknown"))
    return pairs.join(unknown.select("pair_id").distinct(), "pair_id", "left_anti"), unknown
