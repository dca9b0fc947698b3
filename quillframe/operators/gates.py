"""Compatibility of measurements: signatures of analyzers, resources and runtimes, and what parts two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.plans.registry import FEATURES, SEMANTIC_VERSION

#: Features by prefix that rest on a resource, and its id.
RESOURCES = {"text.function_words.en.": "function-words-en", "code.parser.": "grammar"}
SEMANTIC, RESOURCE, RUNTIME = "FEATURE_SEMANTIC_MISMATCH", "RESOURCE_SIGNATURE_MISMATCH", "RUNTIME_SIGNATURE_MISMATCH"
SIGNATURE = {"semantic_version": "string", "backend": "string", "resources": "array<struct<id:string,sha256:string,version:string>>", "runtime": "string"}


def needed(feature: Column) -> Column:
    """The id of the resource that a feature rests on, or null."""
    out = F.lit(None).cast("string")
    for prefix, resource in RESOURCES.items():
        out = F.when(feature.startswith(prefix), resource).otherwise(out)
    return out


def sensitive(feature: Column) -> Column:
    return feature.isin([f.feature_id for f in FEATURES.values() if f.runtime_sensitive])


def _own(resources: Column, resource: Column) -> Column:
    return F.filter(resources, lambda r: r["id"] == resource)


def compatibility(feature: Column, semantic: Column, backend: Column, resources: Column, runtime: Column) -> Column:
    """SHA-256 of the canonical JSON of all that a measurement of the feature rests on; null where the analyzer or a needed resource is missing."""
    used = F.when(needed(feature).isNull(), F.array().cast(SIGNATURE["resources"])).otherwise(_own(resources, needed(feature)))
    tree = F.struct(backend.alias("backend_compatibility_id"), feature.alias("feature_id"), used.alias("resources"), F.when(sensitive(feature), runtime).alias("runtime"), semantic.alias("semantic_version"))
    whole = backend.isNotNull() & (needed(feature).isNull() | (F.size(used) > 0))
    return F.when(whole, F.sha2(F.to_json(tree), 256))


def signed(observations: DataFrame, signatures: DataFrame | None = None, backend: str = "quillframe/1", runtime: str = "", resources: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """observations with their signature and compat_sha256: signatures(artifact_id, ...) by artifact, or the same for all; resources: id to (version, sha256)."""
    if signatures is None:
        known = [F.struct(F.lit(k).alias("id"), F.lit(sha).alias("sha256"), F.lit(v).alias("version")) for k, (v, sha) in sorted((resources or {}).items())]
        rows = observations.withColumns({"semantic_version": F.lit(SEMANTIC_VERSION), "backend": F.lit(backend), "resources": F.array(*known).cast(SIGNATURE["resources"]), "runtime": F.lit(runtime)})
    else:
        rows = observations.join(signatures.select("artifact_id", *SIGNATURE), "artifact_id", "left")
    return rows.withColumn("compat_sha256", compatibility(F.col("feature_id"), *(F.col(c) for c in SIGNATURE)))


def mismatch(feature: Column, left: dict[str, Column], right: dict[str, Column]) -> Column:
    """The first condition that parts two measurements of a feature, or null: version, resources, runtime, analyzer, backend."""
    both = lambda name: (left[name], right[name])
    resource, (lr, rr) = needed(feature), [_own(side["resources"], needed(feature)) for side in (left, right)]
    held = F.coalesce((F.size(lr) > 0) & (F.size(rr) > 0) & (lr == rr), F.lit(False))
    equal = lambda name: F.coalesce(both(name)[0] == both(name)[1], F.lit(False))
    return (
        F.when(~equal("semantic_version"), SEMANTIC)
        .when(resource.isNotNull() & ~held, RESOURCE)
        .when(sensitive(feature) & ~both("runtime")[0].eqNullSafe(both("runtime")[1]), RUNTIME)
        .when(~equal("backend"), SEMANTIC)
    )


def gated(members: DataFrame, observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signed observations of members(set_id, artifact_id, ordinal) that may be pooled, and (set_id, feature_id, reason) of features dropped.

    The first member that carries a feature is the one that the others are held against; one row of each set and feature
    is joined back.
    """
    rows = members.join(observations, "artifact_id")
    one = F.struct(*SIGNATURE)
    first = rows.groupBy("set_id", "feature_id").agg(F.min_by(one, "ordinal").alias("first"))
    sides = [{c: F.col(c) for c in SIGNATURE}, {c: F.col("first")[c] for c in SIGNATURE}]
    held = rows.join(first, ["set_id", "feature_id"]).withColumn("reason", mismatch(F.col("feature_id"), sides[1], sides[0]))
    dropped = held.filter("reason is not null").groupBy("set_id", "feature_id").agg(F.min_by("reason", "ordinal").alias("reason"))
    return held.drop("reason", "first").join(dropped, ["set_id", "feature_id"], "left_anti"), dropped
