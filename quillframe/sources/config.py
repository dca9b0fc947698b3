"""Configuration and manifests in TOML: read on the driver, strict about what they hold."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import get_type_hints

from pyspark.sql import DataFrame, SparkSession

from quillframe.sources.ingest import EXTENSIONS, MAX_BYTES, MAX_FILES, MAX_TOTAL


@dataclass(frozen=True)
class Input:
    text_encoding: str = "utf-8"
    include_hidden: bool = False
    include: tuple = tuple(f"**/*{e}" for e in EXTENSIONS)
    exclude: tuple = ("**/__pycache__/**", "**/node_modules/**", "**/venv/**", "**/dist/**", "**/build/**")
    max_file_bytes: int = MAX_BYTES
    max_files: int = MAX_FILES
    max_total_bytes: int = MAX_TOTAL


@dataclass(frozen=True)
class TextAnalysis:
    enabled: bool = True
    function_words_en: bool = True
    window_ttr_100: bool = True


@dataclass(frozen=True)
class EmbeddedLanguage:
    language: str = "und"


@dataclass(frozen=True)
class PythonAnalysis:
    enabled: bool = True
    max_ast_bytes: int = 2_097_152
    max_ast_nesting: int = 200
    embedded_text: bool = True
    max_embedded_artifacts: int = 5_000
    embedded_text_language: EmbeddedLanguage = EmbeddedLanguage()


@dataclass(frozen=True)
class Switch:
    enabled: bool = True


@dataclass(frozen=True)
class CodeAnalysis:
    enabled: bool = True
    python: PythonAnalysis = PythonAnalysis()
    tree_sitter: Switch = Switch()


@dataclass(frozen=True)
class Analysis:
    language: str = "und"
    export_content_hashes: bool = True
    text: TextAnalysis = TextAnalysis()
    code: CodeAnalysis = CodeAnalysis()


@dataclass(frozen=True)
class Baselines:
    search_paths: tuple = ()


@dataclass(frozen=True)
class Data:
    parquet_compression: str = "zstd"
    row_group_size: int = 65_536


@dataclass(frozen=True)
class Config:
    """How to read and measure. Workers and their number are the cluster's own matter and not part of it."""

    version: int = 1
    input: Input = field(default_factory=Input)
    analysis: Analysis = field(default_factory=Analysis)
    cache: Switch = Switch()
    baseline: Baselines = Baselines()
    data: Data = Data()

    def disabled(self) -> tuple[str, ...]:
        """Prefixes of the features that are switched off."""
        a = self.analysis
        rules = {
            "text.": a.text.enabled, "text.function_words.en.": a.text.function_words_en, "text.lexical.window_ttr_100": a.text.window_ttr_100,
            "code.": a.code.enabled, "code.python.": a.code.python.enabled, "code.toolchain.": a.code.python.enabled, "code.parser.": a.code.tree_sitter.enabled,
        }
        return tuple(p for p, on in rules.items() if not on)


def _built(kind: type, data: dict, where: str):
    if not isinstance(data, dict):
        raise ValueError(f"{where}: a table is expected")
    types, known = get_type_hints(kind), {f.name for f in fields(kind)}
    if unknown := sorted(set(data) - known):
        raise ValueError(f"{where}: unknown keys {unknown}")
    given = {}
    for name, value in data.items():
        want = types[name]
        if is_dataclass(want):
            value = _built(want, value, f"{where}.{name}")
        elif want is tuple:
            if not isinstance(value, list) or not all(isinstance(v, str) for v in value):
                raise ValueError(f"{where}.{name}: a list of strings is expected")
            value = tuple(value)
        elif type(value) is not want:
            raise ValueError(f"{where}.{name}: {want.__name__} is expected")
        given[name] = value
    return kind(**given)


def parse(data: dict, where: str = "configuration") -> Config:
    out = _built(Config, data, where)
    if out.version != 1:
        raise ValueError(f"{where}: version {out.version} isn't known")
    return out


def load(path: str | None = None, cwd: str | None = None, env: dict[str, str] | None = None) -> Config:
    """The configuration of the first of: the path, QUILLFRAME_CONFIG, quillframe.toml or pyproject.toml of the folder, the default."""
    chosen = path or (os.environ if env is None else env).get("QUILLFRAME_CONFIG")
    here = Path(cwd or ".")
    if chosen and not Path(chosen).is_file():
        raise ValueError(f"{chosen}: no such configuration")
    for file in (Path(chosen),) if chosen else (here / "quillframe.toml",):
        if file.is_file():
            return parse(tomllib.loads(file.read_text("utf-8")), str(file))
    project = here / "pyproject.toml"
    section = tomllib.loads(project.read_text("utf-8")).get("tool", {}).get("quillframe") if project.is_file() else None
    return Config() if section is None else parse(section, str(project))


# ---- manifests

# The context that an artifact may carry, and the keys of each table.
CONTEXT = ("author_id", "domain", "genre", "platform", "repository_id", "file_id", "problem_id", "framework_id", "commit_time", "formatter", "transformation_id", "label_source", "label_reliability")
ARTIFACT = ("id", "path", "sha256", "kind", "language")
TASKS = ("split_audit", "pairwise_comparison", "transformation_stability", "verification")
KEYS = {
    "dataset": {"schema", "schema_version", "id", "version", "license", "redistribution", "source", "artifact", "risks", "transformation"},
    "artifact": {*ARTIFACT, *CONTEXT},
    "transformation": {"original", "variant", "transformation_id"},
    "benchmark": {"schema", "schema_version", "id", "task", "dataset", "split", "pair", "checksums", "verifier"},
    "split": {"seed", "train_ppm", "dev_ppm", "test_ppm", "disjoint_by", "require_nonempty", "disjoint_content"},
    "pair": {"left", "right", "label", "population"},
    "training": {"schema", "schema_version", "id", "dataset", "verifier", "pair"},
    "verifier": {
        "kind", "l2_lambda", "max_iterations", "tolerance", "min_support_fraction", "min_class_support_fraction", "min_pairs", "threshold_rule", "threshold_alpha", "threshold_fixed", "calibration_method", "include_linguistic",
        "allow_unconstrained_language", "languages", "feature_ids", "pair_policy",
    },
}


def _checked(kind: str, data: object, where: str, required: tuple[str, ...] = ()) -> dict:
    if not isinstance(data, dict):
        raise ValueError(f"{where}: a table is expected")
    if unknown := sorted(set(data) - KEYS[kind]):
        raise ValueError(f"{where}: unknown keys {unknown}")
    for name in required:
        if not isinstance(data.get(name), str) or not data[name]:
            raise ValueError(f"{where}: {name} must be a string")
    return data


def _tables(kind: str, data: dict, where: str, required: tuple[str, ...]) -> list[dict]:
    rows = data.get(kind, [])
    if not isinstance(rows, list):
        raise ValueError(f"{where}: {kind} must be a list of tables")
    return [_checked(kind, row, f"{where} {kind} {i}", required) for i, row in enumerate(rows)]


def _read(path: str, kind: str, required: tuple[str, ...]) -> dict:
    return _checked(kind, tomllib.loads(Path(path).read_text("utf-8")), path, required)


def dataset(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """A dataset manifest: its header, its artifacts and its transformations as tables."""
    data = _read(path, "dataset", ("id", "version", "license", "redistribution", "source"))
    if data["redistribution"] not in ("allowed", "restricted", "unknown"):
        raise ValueError(f"{path}: redistribution {data['redistribution']!r} isn't known")
    rows = _tables("artifact", data, path, ARTIFACT)
    for r in rows:
        if len(r["sha256"]) != 64 or set(r["sha256"]) - set("0123456789abcdef"):
            raise ValueError(f"{path}: {r['id']} has no SHA-256")
    if len({r["id"] for r in rows}) != len(rows):
        raise ValueError(f"{path}: artifacts share an id")
    moves = _tables("transformation", data, path, ("original", "variant", "transformation_id"))
    if any(m["original"] == m["variant"] for m in moves):
        raise ValueError(f"{path}: original and variant must differ")
    names = [*ARTIFACT, *CONTEXT]
    artifacts = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ", ".join(f"{c} string" for c in names))
    kept = ("original", "variant", "transformation_id")
    return {k: v for k, v in data.items() if k not in ("artifact", "transformation")}, artifacts, spark.createDataFrame([tuple(m[c] for c in kept) for m in moves], ", ".join(f"{c} string" for c in kept))


def benchmark(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A benchmark specification: its header with the split, and its pairs as a table."""
    data = _read(path, "benchmark", ("id", "task", "dataset"))
    if data["task"] not in TASKS:
        raise ValueError(f"{path}: task {data['task']!r} isn't known")
    if "split" in data:
        split = _checked("split", data["split"], f"{path} split", ("seed",))
        if sum(int(split.get(k, 0)) for k in ("train_ppm", "dev_ppm", "test_ppm")) != 1_000_000:
            raise ValueError(f"{path}: the parts of the split must be the whole")
    return {k: v for k, v in data.items() if k != "pair"}, _pairs(spark, data, path)


def training(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """A training manifest: its header with the verifier's options, and its pairs as a table."""
    data = _read(path, "training", ("id", "dataset"))
    _checked("verifier", data.get("verifier", {}), f"{path} verifier")
    return {k: v for k, v in data.items() if k != "pair"}, _pairs(spark, data, path)


def _pairs(spark: SparkSession, data: dict, path: str) -> DataFrame:
    rows = _tables("pair", data, path, ("left", "right", "label"))
    for r in rows:
        if r["label"] not in ("same", "different") or r["left"] == r["right"]:
            raise ValueError(f"{path}: a pair needs two ends and a label")
        if r.get("population", "train") not in ("train", "tuning", "calibration"):
            raise ValueError(f"{path}: population {r['population']!r} isn't known")
    return spark.createDataFrame([(r["left"], r["right"], r["label"], r.get("population")) for r in rows], "left string, right string, label string, population string")
