"""The training-data subpackage can be taken away: nothing else imports it."""

import ast
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent


def imported(path):
    for node in ast.walk(ast.parse(path.read_text())):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        if isinstance(node, ast.ImportFrom):
            yield f"{node.module}.{'.'.join(a.name for a in node.names)}"


def test_library_stands_alone():
    for path in (ROOT / "quillframe").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not any("llm" in name.split(".") for name in imported(path)), path


def test_queries_and_sql_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(__spark_entry__.queries()) >= 50


def test_registry():
    from quillframe.plans.registry import FEATURES

    assert len(FEATURES) == 90 and sum(f.geometry == "cat" for f in FEATURES.values()) == 38 and sum(f.metric == "ABS" for f in FEATURES.values()) == 10


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.count() == 200 and "ttr" in rows.columns
