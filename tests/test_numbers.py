"""Distances, ranks, pooling, profiles, fitting and splits, against stated values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.functions import stats
from quillframe.operators import aggregate, benchmark, compare, corpus, profile, verify
from quillframe.operators.graph import components
from quillframe.sources import ingest

OBS = "artifact_id string, feature_id string, geometry string, status string, int_value bigint, numerator bigint, denominator bigint, scalar double, cat map<string,bigint>, hist map<int,bigint>, support_count bigint"


def one(spark, column, schema, *row):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def test_distances(spark):
    a, b = F.col("a"), F.col("b")
    cats, hists = "a map<string,bigint>, b map<string,bigint>", "a map<int,bigint>, b map<int,bigint>"
    assert one(spark, stats.jensen_shannon(a, b), cats, {"x": 2, "y": 2}, {"x": 1, "y": 1}) == 0
    assert one(spark, stats.jensen_shannon(a, b), cats, {"x": 3}, {"y": 5}) == pytest.approx(1)
    assert one(spark, stats.wasserstein(a, b), hists, {0: 4}, {3: 1}) == 3
    assert one(spark, stats.symmetric_proportional(a, b), "a double, b double", 1.0, 3.0) == 1.0
    rows = spark.createDataFrame([("p", "left", 0.5), ("p", "left", 0.75), ("p", "right", 0.9)], "pair_id string, side string, v double")
    assert stats.sample_wasserstein(rows, ["pair_id"], "side", "v").first()["distance"] == pytest.approx(0.275)


def test_order_statistics(spark):
    v = "v array<double>"
    data = [0.0, 10.0, 20.0, 30.0, 40.0]
    assert [one(spark, stats.quantile(F.col("v"), p), v, data) for p in (0.25, 0.5, 0.75)] == [10, 20, 30]
    assert one(spark, stats.midrank_percentile(F.col("v"), F.lit(2.0)), v, [1.0, 2.0, 2.0, 4.0]) == 50.0
    rows = spark.createDataFrame([(0.5, 1), (0.9, 1), (0.5, 0), (0.1, 0)], "s double, y int")
    assert stats.rank_auc(rows, [], "s", F.col("y") == 1).first()["auc"] == 0.875


def observation(artifact, feature, geometry="ratio", status="ok", **values):
    keys = ("int_value", "numerator", "denominator", "scalar", "cat", "hist", "support_count")
    return (artifact, feature, geometry, status, *(values.get(k) for k in keys))


def test_pooling(spark):
    share, kinds = "code.surface.blank_line_share", "code.surface.indent_kind"
    obs = spark.createDataFrame([observation("a", share, numerator=1, denominator=10, scalar=0.1), observation("b", share, numerator=9, denominator=90, scalar=0.1), observation("a", kinds, "cat", cat={"x": 1, "y": 2}), observation("b", kinds, "cat", cat={"x": 3})], OBS)
    members = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c")], "set_id string, artifact_id string")
    r = aggregate.pooled_ratios(members, obs).first()
    assert (r["numerator"], r["denominator"], r["value"]) == (10, 100, 0.1)
    assert {(x["key"], x["n"]) for x in aggregate.pooled_keys(members, obs, "CAT").collect()} == {("x", 4), ("y", 2)}
    assert {(x["feature_id"], x["status"], x["n"]) for x in aggregate.pooled_status(members, obs).collect()} == {(f, s, n) for f in (share, kinds) for s, n in (("ok", 2), ("unavailable", 1))}


def test_profile(spark):
    f = "text.lexical.ttr_casefold"
    base = spark.createDataFrame([observation(str(i), f, scalar=float(i)) for i in range(1, 21)], OBS)
    r = profile.profiled(spark.createDataFrame([observation("s", f, scalar=10.0)], OBS), profile.baseline(base)).first()
    assert (r["percentile_midrank"], r["q25"], r["median"], r["q75"], r["mad_raw"]) == (47.5, 5.75, 10.5, 15.25, 5)
    assert r["robust_z"] == pytest.approx(-0.5 / (5 * 1.482602218505602))


def test_comparison_gates(spark):
    f = "text.lexical.ttr_casefold"
    obs = spark.createDataFrame([observation("a", f, scalar=0.5), observation("b", f, scalar=0.75), observation("c", f, status="insufficient_support")], OBS)
    pairs = spark.createDataFrame([("1", "a", "b"), ("2", "a", "c"), ("3", "a", "zz")], "pair_id string, left string, right string")
    r = {x["pair_id"]: x for x in compare.compared(pairs, obs).collect()}
    assert r["1"]["value"] == 0.25 and r["2"]["reason"] == "FEATURE_NOT_COMPARABLE" and r["3"]["right_status"] == "unavailable"
    good, unknown = compare.endpoints(pairs, obs)
    assert {x["pair_id"] for x in good.collect()} == {"1", "2"} and unknown.first()["unknown"] == "zz"


def test_scores_and_metrics(spark):
    model = verify.Verifier(("f",), (0.5,), (0.25,), (2.0,), -1.0, 0.7, 0.3)
    rows = spark.createDataFrame([("1", "f", 0.2), ("2", "g", 0.2)], "pair_id string, feature_id string, value double")
    r = {x["pair_id"]: x for x in verify.scored(rows, model).collect()}
    assert r["1"]["logit"] == pytest.approx(-3.4) and r["1"]["verdict"] == "different_author"
    assert r["2"]["score"] is None and r["2"]["verdict"] == "abstain" and r["2"]["missing"] == 1


def test_newton_agrees_with_another_solver(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 2))
    y = (r.random(60) < 1 / (1 + np.exp(-(x @ [1.0, -2.0] + 0.3)))).astype(float)
    rows = spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y)], "y double, x array<double>")
    got, w = verify.newton(rows, 2, 0.5, tolerance=1e-10), np.zeros(3)
    z = np.c_[x, np.ones(60)]
    for _ in range(5000):
        w -= 0.05 * (z.T @ (1 / (1 + np.exp(-z @ w)) - y) + np.array([0.5, 0.5, 0]) * w)
    assert np.abs(got - w).max() < 1e-6


def test_components_and_split(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (11, 12), (7, 7)], "a long, b long")
    assert {(r["node"], r["component"]) for r in components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (10, 10), (11, 10), (12, 10)}
    items = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2"), ("c", "y", "2"), ("d", None, None)], "artifact_id string, p string, q string")
    parts = benchmark.split(items, ["p", "q"], "s", 500_000, 250_000).collect()
    assert {r["artifact_id"]: r["component"] for r in parts} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    assert len({r["part"] for r in parts if r["component"] == "a"}) == 1
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"split/1\0s\0a").digest(), "big") % 1_000_000
    assert next(r["bucket"] for r in parts if r["component"] == "a") == want


def test_canonical_json():
    assert corpus.canonical({"b": [1, 2.0, 0.1], "a": "é\n", "n": 1e21, "s": 1e-7, "z": -0.0}) == '{"a":"é\\n","b":[1,2,0.1],"n":1e+21,"s":1e-7,"z":0}'
    with pytest.raises(ValueError):
        corpus.canonical([None])


def test_ingest(spark, tmp_path):
    assert [bool(__import__("re").match(ingest.glob_pattern(p).replace(r"\z", r"\Z"), s)) for p, s in (("*.py", "a.py"), ("*.py", "d/a.py"), ("**/*.py", "d/e/a.py"), ("d/**", "d/x/y"), ("[ab].t", "b.t"))] == [True, False, True, True, True]
    rows = spark.createDataFrame([("a.txt", bytearray(b"\xef\xbb\xbfhi")), ("b.bin", bytearray(b"x")), ("c.md", bytearray(b"\xff")), ("d.rs", bytearray(b"a\0"))], "path string, content binary")
    got = {r["artifact_id"]: (r["reason"], r["text"], r["encoding"]) for r in ingest.from_bytes(rows).collect()}
    assert got["a.txt"] == (None, "hi", "utf-8-sig") and got["b.bin"][0] == "UNKNOWN_KIND" and got["c.md"][0] == "INVALID_UTF8" and got["d.rs"][0] == "NUL"
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_text("hello")
    (tmp_path / "b.py").write_text("1")
    assert {r["path"] for r in ingest.scan_folder(spark, str(tmp_path), ("**/*.txt",)).collect()} == {"x/a.txt"}


def test_corpus_round_trip(spark, tmp_path):
    obs = spark.createDataFrame([observation("a", "text.lexical.ttr_casefold", scalar=0.5)], OBS).withColumn("summary", F.lit(None).cast("struct<n:bigint>"))
    arts = spark.createDataFrame([("a", "text", "en", "hi")], "artifact_id string, kind string, language string, text string")
    path = str(tmp_path / "c")
    corpus.write_corpus(corpus.corpus_rows(arts, obs), path)
    good, bad = corpus.checked(corpus.open_corpus(spark, path))
    assert good.count() == 1 and bad.count() == 0
    assert corpus.query_corpus(spark, "SELECT sum(ok_feature_count) AS n FROM corpus").first()["n"] == 1
    with pytest.raises(ValueError):
        corpus.open_corpus(spark, "s3://x/y")
