"""Population baselines and profiles against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.functions import stats
from quillframe.functions.stats import MAD_NORMAL
from quillframe.plans.tables import written

SCALARS = ("int", "float", "ratio")


def baseline(observations: DataFrame) -> DataFrame:
    """(feature_id, value, n): how often each ok scalar occurs; features without any are left out.

    A feature's values are kept as counted rows, not as one list, so that a population of any size stays distributed.
    """
    rows = observations.filter(F.col("geometry").isin(*SCALARS) & (F.col("status") == "ok") & F.col("scalar").isNotNull())
    return rows.groupBy("feature_id", F.col("scalar").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(base: DataFrame) -> DataFrame:
    """Size, type-7 quartiles and median absolute deviation per feature; one row for each, 90 at most."""
    q = stats.quantiles(base, ["feature_id"], "value", "n", {"q25": 0.25, "median": 0.5, "q75": 0.75}).withColumnRenamed("units", "baseline_n")
    q = written(q, "quantiles")
    away = base.join(F.broadcast(q.select("feature_id", "median")), "feature_id").groupBy("feature_id", F.abs(F.col("value") - F.col("median")).alias("away")).agg(F.sum("n").alias("n"))
    return q.join(F.broadcast(stats.quantiles(away, ["feature_id"], "away", "n", {"mad_raw": 0.5}).drop("units")), "feature_id")


def profiled(observations: DataFrame, base: DataFrame) -> DataFrame:
    """Each ok scalar of the subjects against the baseline; robust_z is null where the deviation is 0.

    A value's midrank comes from running counts over the union of both tables' distinct values, taken by ranges of values.
    """
    subjects = observations.filter(F.col("geometry").isin(*SCALARS) & (F.col("status") == "ok") & F.col("scalar").isNotNull()).select("artifact_id", "feature_id", F.col("scalar").alias("observed_value"))
    points = base.unionByName(subjects.select("feature_id", F.col("observed_value").alias("value")).distinct().withColumn("n", F.lit(0).cast("bigint")))
    points = points.groupBy("feature_id", "value").agg(F.sum("n").alias("n"))
    ranks = stats.sums_before(points, ["feature_id"], ["value"], below="n").withColumnRenamed("value", "observed_value")
    joined = subjects.join(ranks, ["feature_id", "observed_value"]).join(F.broadcast(quantiles(base)), "feature_id")
    scaled = F.col("mad_raw") * F.lit(MAD_NORMAL)
    return joined.select(
        "artifact_id", "feature_id", "baseline_n", "observed_value", ((F.col("below") + F.col("n") / 2) * 100 / F.col("baseline_n")).alias("percentile_midrank"), "q25", "median", "q75", (F.col("q75") - F.col("q25")).alias("iqr"),
        "mad_raw", scaled.alias("mad_normal_scaled"), F.when(F.col("mad_raw") > 0, (F.col("observed_value") - F.col("median")) / scaled).alias("robust_z"),
    )
