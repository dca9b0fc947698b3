"""Artifacts from text, bytes and folders; what can't be read becomes a row with a reason, not an exception."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File name endings with their kind and language; limits.
EXTENSIONS = {
    ".py": ("code", "python"), ".js": ("code", "javascript"), ".mjs": ("code", "javascript"), ".cjs": ("code", "javascript"), ".jsx": ("code", "javascript"), ".ts": ("code", "typescript"),
    ".tsx": ("code", "typescript"), ".c": ("code", "c"), ".rs": ("code", "rust"), ".txt": ("text", "und"), ".md": ("text", "und"), ".rst": ("text", "und"),
}
MAX_BYTES, MAX_FILES, MAX_TOTAL = 8_388_608, 10_000, 536_870_912


def from_text(rows: DataFrame, text: str = "text", artifact_id: str = "artifact_id", language: str | None = None) -> DataFrame:
    """(artifact_id, kind, language, text, content_sha256, reason); a text that is null or holds a NUL is null and has a reason."""
    chosen, t = F.col(language) if language else F.lit("und"), F.col(text)
    reason = F.when(t.isNull(), "NULL").when(F.contains(t, F.lit("\0")), "NUL")
    out = rows.select(F.col(artifact_id).alias("artifact_id"), F.lit("text").alias("kind"), chosen.alias("language"), F.when(reason.isNull(), t).alias("text"), reason.alias("reason"))
    return out.withColumn("content_sha256", F.sha2("text", 256)).select("artifact_id", "kind", "language", "text", "content_sha256", "reason")


def decoded(rows: DataFrame, content: str = "content", encoding: str = "utf-8") -> DataFrame:
    """rows with text and reason: content decoded strictly by any codec that Python knows (a UTF-8 mark at the beginning is no text), in Arrow batches."""
    import codecs

    name = codecs.lookup(encoding).name
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]

    def one(raw: bytes | None) -> tuple[str | None, str | None]:
        if raw is None:
            return None, "NULL"
        try:
            text = raw.decode("utf-8-sig" if name == "utf-8" else name)
        except (UnicodeDecodeError, ValueError):
            return None, "UNDECODABLE"
        return (None, "NUL") if "\0" in text else (text, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(raw) for raw in batch.column(batch.schema.get_field_index(content)).to_pylist()]
            yield batch.append_column("text", pa.array([t for t, _ in found], pa.string())).append_column("reason", pa.array([r for _, r in found], pa.string()))

    return rows.mapInArrow(run, ", ".join([*fields, "text string", "reason string"]))


def from_files(spark: SparkSession, paths: list[str], stdin: bytes | None = None, **options) -> DataFrame:
    """(path, content, reason) of files, at most one folder, and what came by standard input (path `-`); a file that is missing or a link has a reason."""
    import os

    folders = [p for p in paths if os.path.isdir(p) and not os.path.islink(p)]
    if len(folders) > 1:
        raise ValueError("one folder at most")
    bad = [(p, "LINK" if os.path.islink(p) else "MISSING") for p in paths if p not in folders and (os.path.islink(p) or not os.path.isfile(p))]
    good = [p for p in paths if p not in folders and p not in dict(bad)]
    out = spark.createDataFrame([(p, None, r) for p, r in bad] + ([("-", bytearray(stdin), None)] if stdin is not None else []), "path string, content binary, reason string")
    if good:
        files = spark.read.format("binaryFile").load(good).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content", F.lit(None).cast("string").alias("reason"))
        out = out.unionByName(files)
    for folder in folders:
        out = out.unionByName(scan_folder(spark, folder, **options).withColumn("reason", F.lit(None).cast("string")))
    return out


def glob_pattern(pattern: str) -> str:
    """A portable glob as an expression: *, ? and [..] stay within a segment, ** is any number of segments."""
    out, segments = [], pattern.split("/")
    for i, segment in enumerate(segments):
        last = i == len(segments) - 1
        if segment == "**":
            out.append("(?:[^/]+/)*" + ("[^/]*" if last else ""))
            continue
        body = re.sub(r"\*|\?|\[[^\]]*\]|[^*?\[]+|\[", lambda m: {"*": "[^/]*", "?": "[^/]"}.get(m[0]) or (m[0].replace("[!", "[^", 1) if m[0][0] == "[" and len(m[0]) > 1 else re.escape(m[0])), segment)
        out.append(body + ("" if last else "/"))
    return "^" + "".join(out) + r"\z"


def kind_language(path: Column) -> tuple[Column, Column]:
    """Kind and language by file name ending."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]+)\z", 1))
    table = [F.create_map(*[F.lit(x) for k, v in EXTENSIONS.items() for x in (k, v[i])])[ending] for i in (0, 1)]
    return table[0], table[1]


def from_bytes(rows: DataFrame, path: str = "path", content: str = "content", max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files as artifacts with a reason where they can't be used: TOO_LARGE, UNKNOWN_KIND, INVALID_UTF8 or NUL."""
    kind, language = kind_language(F.col(path))
    bom = F.startswith(F.col(content), F.lit(b"\xef\xbb\xbf"))
    body = F.when(bom, F.expr(f"substring({content}, 4)")).otherwise(F.col(content))
    text = F.try_validate_utf8(body.cast("string"))
    reason = F.when(F.length(content) > max_bytes, "TOO_LARGE").when(kind.isNull(), "UNKNOWN_KIND").when(text.isNull(), "INVALID_UTF8").when(F.contains(text, F.lit("\0")), "NUL")
    out = rows.select(F.col(path).alias("artifact_id"), kind.alias("kind"), language.alias("language"), F.when(bom, "utf-8-sig").otherwise("utf-8").alias("encoding"), F.length(content).cast("bigint").alias("byte_count"), text.alias("text"), F.sha2(F.col(content), 256).alias("content_sha256"), reason.alias("reason"))
    return out.withColumn("text", F.when(F.col("reason").isNull(), F.col("text")))


def scan_folder(spark: SparkSession, root: str, include: tuple[str, ...] = ("**",), exclude: tuple[str, ...] = (), hidden: bool = False, max_files: int = MAX_FILES, max_total: int = MAX_TOTAL) -> DataFrame:
    """Files below root as (path, content), path being relative; too many files or bytes are an error."""
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace("path", "^.*?" + re.escape(base.split(":", 1)[-1]), "")
    rows = files.select(relative.alias("path"), "length", "content")
    if not hidden:
        rows = rows.filter(~F.col("path").rlike(r"(^|/)\."))
    for patterns, keep in ((include, True), (exclude, False)):
        if patterns:
            hit = F.col("path").rlike("|".join(map(glob_pattern, patterns)))
            rows = rows.filter(hit if keep else ~hit)
    n, total = rows.agg(F.count(F.lit(1)), F.sum("length")).first()
    if n > max_files:
        raise ValueError(f"{n} files are more than {max_files}")
    if (total or 0) > max_total:
        raise ValueError(f"{total} bytes are more than {max_total}")
    return rows.select("path", "content")


def validated(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """manifest(id, path, sha256) with state: ok, missing or changed."""
    have = files.select(F.col("path").alias("p"), F.sha2("content", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") == F.col("sha256"), "ok").otherwise("changed")
    return manifest.join(have, F.col("path") == F.col("p"), "left").select(*manifest.columns, state.alias("state"))
