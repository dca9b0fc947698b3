"""The stored corpus: canonical JSON, Parquet, SQL and incremental reuse."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.plans.tables import sums_before, written

ROW_SCHEMA = "schema string, schema_version string, scientific_sha256 string, canonical_json string, artifact_id string, kind string, language string, byte_count bigint, character_count bigint, ok_feature_count bigint"


_COLUMNS = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
SCHEMA, SCHEMA_VERSION = "fingerprint", "1.0.0"


def _number(x: float) -> str:
    """A finite number as ECMAScript writes it."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        raise ValueError("numbers must be finite")
    if x == 0:
        return "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        return mantissa if 1e-6 <= abs(x) < 1e21 else _number_from(x)
    return _number_from(x)


def _number_from(x: float) -> str:
    sign, (digits, exponent) = "-" if x < 0 else "", _digits(abs(x))
    point = exponent + 1
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    if 0 < point <= 21:
        return sign + (digits.ljust(point, "0") if len(digits) <= point else f"{digits[:point]}.{digits[point:]}")
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'+' if exponent > 0 else '-'}{abs(exponent)}"


def _digits(x: float) -> tuple[str, int]:
    mantissa, _, exponent = f"{x!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    digits, shift = (whole + part).lstrip("0"), int(exponent or 0)
    first = len(whole) - 1 if whole.strip("0") else -(len(part) - len(part.lstrip("0"))) - 1
    return digits.rstrip("0") or "0", first + shift


def canonical(value: object) -> str:
    """JSON with sorted keys (by UTF-16), no blanks, numbers as ECMAScript writes them; null is refused."""
    if value is None:
        raise ValueError("null is not portable")
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return _number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(v)}" for k, v in sorted(value.items(), key=lambda kv: kv[0].encode("utf-16-be")) if v is not None) + "}"
    if isinstance(value, Iterable):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    raise TypeError(type(value).__name__)


def corpus_rows(artifacts: DataFrame, observations: DataFrame) -> DataFrame:
    """One row per artifact: its observations as canonical JSON with their SHA-256, and flattened columns."""
    entries = observations.withColumn("value", F.to_json(F.struct("int_value", "numerator", "denominator", "scalar", "cat", "hist", "summary", "support_count")))
    lists = entries.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("feature_id", "status", "value"))).alias("features"), F.count_if(F.col("status") == "ok").alias("ok_feature_count"))
    rows = artifacts.select(F.col("artifact_id"), "kind", "language", F.octet_length("text").cast("bigint").alias("byte_count"), F.length("text").cast("bigint").alias("character_count")).join(lists, "artifact_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                features = [{"feature_id": f["feature_id"], "status": f["status"], **json.loads(f["value"])} for f in r["features"]]
                text = canonical({"artifact_id": str(r["artifact_id"]), "kind": r["kind"], "language": r["language"], "features": features})
                out.append({"schema": SCHEMA, "schema_version": SCHEMA_VERSION, "scientific_sha256": hashlib.sha256(text.encode()).hexdigest(), "canonical_json": text, "artifact_id": str(r["artifact_id"]), **{c: r[c] for c in ("kind", "language", "byte_count", "character_count", "ok_feature_count")}})
            yield pa.RecordBatch.from_pylist(out, pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in ROW_SCHEMA.split(", ")]))

    return rows.mapInArrow(run, ROW_SCHEMA)


def _fault(r: dict) -> str | None:
    """What is wrong with a row, if anything."""
    import hashlib

    text = r["canonical_json"]
    if text is None or r["schema"] != SCHEMA or r["schema_version"] != SCHEMA_VERSION:
        return "IDENTITY"
    try:
        value = json.loads(text)
        if canonical(value) != text:
            return "NOT_CANONICAL"
    except (ValueError, TypeError):
        return "NOT_JSON"
    if hashlib.sha256(text.encode()).hexdigest() != r["scientific_sha256"]:
        return "HASH"
    if not isinstance(value, dict) or any(value.get(c) != r[c] for c in ("artifact_id", "kind", "language")):
        return "COLUMNS"
    features = value.get("features")
    if not isinstance(features, list) or sum(f.get("status") == "ok" for f in features) != r["ok_feature_count"]:
        return "COLUMNS"
    return None


def validated(rows: DataFrame) -> DataFrame:
    """rows with fault: null, or IDENTITY, NOT_JSON, NOT_CANONICAL, HASH or COLUMNS (those that differ from the JSON)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("fault", pa.array([_fault(r) for r in batch.to_pylist()], pa.string()))

    return rows.select(*_COLUMNS).mapInArrow(run, f"{ROW_SCHEMA}, fault string")


def checked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are as they should be, and the others with their fault."""
    every = validated(rows)
    return every.filter("fault is null").drop("fault"), every.filter("fault is not null")


def write_json(rows: DataFrame, path: str) -> None:
    """The canonical JSON of each row, one to a line; existing files are refused."""
    rows.select("canonical_json").write.mode("errorifexists").text(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Lines of write_json() as corpus rows with fault; sizes aren't part of the JSON and null."""
    text, count = F.col("value"), F.expr("size(filter(from_json(value, 'features array<struct<status:string>>').features, f -> f.status = 'ok'))")
    part = lambda c: F.get_json_object(text, f"$.{c}")
    rows = spark.read.text(path).select(
        F.lit(SCHEMA).alias("schema"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.sha2(text, 256).alias("scientific_sha256"), text.alias("canonical_json"), *[part(c).alias(c) for c in ("artifact_id", "kind", "language")],
        F.lit(None).cast("bigint").alias("byte_count"), F.lit(None).cast("bigint").alias("character_count"), F.coalesce(count, F.lit(0)).cast("bigint").alias("ok_feature_count"),
    )
    return validated(rows)


def frame(rows: DataFrame, kind: str = "arrow"):
    """Rows on the driver as an Arrow table or a pandas frame, for results that are small."""
    if kind not in ("arrow", "pandas"):
        raise ValueError(f"{kind!r} is no kind of frame")
    return rows.toArrow() if kind == "arrow" else rows.toPandas()


def write_corpus(rows: DataFrame, path: str) -> None:
    """Zstandard Parquet; an existing corpus is refused."""
    rows.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def scan_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows of corpus files, every one checked again, with fault."""
    return validated(spark.read.schema(ROW_SCHEMA).parquet(*paths))


def open_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """Corpus files as the view `corpus`; remote schemes are refused."""
    for p in paths:
        if "://" in p:
            raise ValueError(f"{p}: only local files are opened by name")
    df = spark.read.schema(ROW_SCHEMA).parquet(*paths)
    df.createOrReplaceTempView("corpus")
    return df


def query_corpus(spark: SparkSession, sql: str, *paths: str) -> DataFrame:
    """Any SQL over the view `corpus`."""
    if paths:
        open_corpus(spark, *paths)
    return spark.sql(sql)


def ahead(rows: DataFrame, by: str, value: str, width: float) -> DataFrame:
    """rows with n: how many rows with the same by have a value in (value, value + width]; none if null.

    Distinct values and their ends are counted over ranges, and n is a difference of two counts, so that no rows are paired.
    """
    known = rows.filter(F.col(by).isNotNull() & F.col(value).isNotNull())
    counts = known.groupBy(by, value).agg(F.count(F.lit(1)).alias("__n"))
    ends = counts.select(by, (F.col(value) + F.lit(width)).alias(value), F.lit(0).cast("bigint").alias("__n"))
    points = counts.unionByName(ends).groupBy(by, value).agg(F.sum("__n").alias("__n"))
    upto = written(sums_before(points, [by], [value], __below="__n").select(by, value, (F.col("__below") + F.col("__n")).alias("__upto")), "upto")
    here = counts.select(by, value, (F.col(value) + F.lit(width)).alias("__end")).join(upto, [by, value])
    found = here.join(upto.select(by, F.col(value).alias("__end"), F.col("__upto").alias("__far")), [by, "__end"]).select(by, value, (F.col("__far") - F.col("__upto")).alias("n"))
    return rows.join(found, [by, value], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def catalog(rows: DataFrame) -> DataFrame:
    """Rows and schema versions of each file."""
    return rows.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("schema_version")).alias("versions"))


def unseen(artifacts: DataFrame, store: DataFrame, key: str = "content_sha256") -> DataFrame:
    """Artifacts that the store has no row for."""
    return artifacts.join(store.select(key).distinct(), key, "left_anti")
