"""What is kept between runs: measured artifacts by cache key, fitted vocabularies by content, baselines by id."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.operators.represent import Spec
from quillframe.plans.tables import written


def cache_key(content: Column, kind: Column, language: Column, config_sha256: str, version: str, signatures: dict[str, str]) -> Column:
    """SHA-256 over all that a measurement depends on: content, kind, language, configuration, schema and analyzers, resources and runtime."""
    tail = "\0".join([config_sha256, version, *(f"{k}\0{v}" for k, v in sorted(signatures.items()))])
    return F.sha2(F.concat_ws("\0", content, kind, language, F.lit(tail)), 256)


def reused(artifacts: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of artifacts(artifact_id, cache_key): the stored observations under their new ids, and the artifacts the store doesn't know."""
    rows = store.drop("artifact_id").join(artifacts.select("artifact_id", "cache_key"), "cache_key")
    return rows, artifacts.join(store.select("cache_key").distinct(), "cache_key", "left_anti")


def measured(artifacts: DataFrame, store: DataFrame | None, measure) -> tuple[DataFrame, DataFrame]:
    """Observations of all artifacts, with cache_key, only unknown ones being measured, and the new rows for the store.

    Equal artifacts are measured once. Keys are computed and written first, so that what artifacts hold is shuffled once, by cache_key, to be measured.
    """
    keys = written(artifacts.select("artifact_id", "cache_key"), "keys")
    hits, misses = (None, keys) if store is None else reused(keys, store)
    first = misses.groupBy("cache_key").agg(F.min("artifact_id").alias("artifact_id"))
    lone = artifacts.join(first.withColumnRenamed("artifact_id", "__first"), "cache_key").filter(F.col("artifact_id") == F.col("__first")).select(*artifacts.columns).dropDuplicates(["cache_key"])
    fresh = written(measure(lone).join(first, "artifact_id"), "measured")
    own = fresh.drop("artifact_id").join(misses.select("artifact_id", "cache_key"), "cache_key")
    return own if hits is None else hits.unionByName(own, allowMissingColumns=True), fresh


def _content(df: DataFrame, columns: list[str], head: str) -> str:
    """A hash of rows in any order: of the head, their number and the sums of three parts of their hashes."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")) for i in range(5)]
    found = df.agg(F.count(F.lit(1)), *parts).first()
    import hashlib

    return hashlib.sha256("|".join([head, *(str(int(x or 0)) for x in found)]).encode()).hexdigest()


def save_state(terms: DataFrame, spec: Spec, documents: int, root: str) -> str:
    """A vocabulary (term, index, df, idf) as Parquet under its own hash; the path."""
    head = json.dumps({"spec": asdict(spec), "documents": documents}, sort_keys=True)
    rows = written(terms.select("term", "index", "df", "idf"), "state")
    path = f"{root.rstrip('/')}/{_content(rows, ['term', 'index', 'df', 'idf'], head)}"
    rows.withColumn("head", F.lit(head)).write.mode("ignore").parquet(path)
    return path


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, Spec, int]:
    """The vocabulary, its spec and number of documents; a state that doesn't have the hash it is named by is refused."""
    rows = spark.read.parquet(path)
    head = rows.select("head").first()
    if head is None or _content(rows, ["term", "index", "df", "idf"], head[0]) != path.rstrip("/").rpartition("/")[2]:
        raise ValueError(f"{path}: the state doesn't have its hash")
    known = json.loads(head[0])
    return rows.drop("head"), Spec(**known["spec"]), known["documents"]


def save_baseline(base: DataFrame, baseline_id: str, root: str) -> str:
    """profile.baseline() as Parquet, values ascending doubles that aren't null, with its id and hash; the path. An existing one is refused."""
    rows = written(base.filter("value is not null").select("feature_id", F.col("value").cast("double").alias("value"), "n"), "baseline")
    sha = _content(rows, ["feature_id", "value", "n"], baseline_id)
    path = f"{root.rstrip('/')}/{baseline_id}"
    rows.sort("feature_id", "value").withColumns({"baseline_id": F.lit(baseline_id), "sha256": F.lit(sha)}).write.option("compression", "zstd").mode("errorifexists").parquet(path)
    return path


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    """A stored baseline (feature_id, value, n, baseline_id, sha256); one whose values don't have its hash is refused."""
    rows = spark.read.parquet(path)
    mark = rows.select("baseline_id", "sha256").distinct().collect()
    if len(mark) != 1 or _content(rows, ["feature_id", "value", "n"], mark[0][0]) != mark[0][1]:
        raise ValueError(f"{path}: BASELINE_INVALID")
    return rows


def resolve_baseline(spark: SparkSession, ref: str, roots: tuple[str, ...] = ()) -> DataFrame:
    """A baseline by its path, or by its id among the baselines under the roots; different ones with one id are refused."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = lambda path: hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if "/" in ref or "\\" in ref:
        if not folder(ref).exists(hadoop(ref)):
            raise ValueError(f"BASELINE_NOT_FOUND: {ref}")
        return load_baseline(spark, ref)
    found: dict[str, str] = {}
    for root in roots:
        if folder(root).exists(hadoop(root)):
            for status in folder(root).listStatus(hadoop(root)):
                path = status.getPath().toString()
                try:
                    head = load_baseline(spark, path).select("baseline_id", "sha256").first()
                except Exception:  # noqa: BLE001  # what isn't a baseline doesn't count
                    continue
                if head["baseline_id"] == ref:
                    found.setdefault(head["sha256"], path)
    if not found:
        raise ValueError(f"BASELINE_NOT_FOUND: {ref}")
    if len(found) > 1:
        raise ValueError(f"BASELINE_INVALID: several baselines with the id {ref}")
    return load_baseline(spark, next(iter(found.values())))
