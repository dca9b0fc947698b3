"""Signatures and gates, pairs, stores, configuration, manifests, files and JSON against stated values and plain loops."""

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillframe.functions import stats
from quillframe.operators import aggregate, compare, corpus, gates, graph, observations, pairs, profile, python_code, represent, store, verify
from quillframe.plans import tables
from quillframe.sources import config, ingest

TTR, SHARE, PLAIN = "text.lexical.ttr_casefold", "text.function_words.en.token_share", "text.surface.marker_style"
OBS = "artifact_id string, feature_id string, status string, geometry string, scalar double, cat map<string,bigint>, hist map<int,bigint>, support_count bigint"


def observed(spark, *rows):
    return spark.createDataFrame([(a, f, "ok", "ratio", v, {"x": 1}, None, 3) for a, f, v in rows], OBS)


def signatures(spark, **rows):
    """artifact -> (version, backend, resource hash, runtime)"""
    kind = "artifact_id string, " + ", ".join(f"{k} {t}" for k, t in gates.SIGNATURE.items())
    return spark.createDataFrame([(a, v, b, None if r is None else [("function-words-en", r, "1")], t) for a, (v, b, r, t) in rows.items()], kind)


SIGNED = {"a": ("1.0.0", "q/1", "h1", "r1"), "b": ("1.0.0", "q/1", "h1", "r1"), "v": ("2.0.0", "q/1", "h2", "r2"), "r": ("1.0.0", "q/1", "h2", "r2"), "n": ("1.0.0", "q/1", None, "r1"), "t": ("1.0.0", "q/2", "h1", "r2"), "k": ("1.0.0", None, "h1", "r1"), "e": ("1.0.0", "q/2", "h1", "r1")}


@pytest.mark.parametrize("other, ttr, share, plain", [
    ("b", None, None, None), ("v", gates.SEMANTIC, gates.SEMANTIC, gates.SEMANTIC), ("r", gates.RUNTIME, gates.RESOURCE, None), ("n", None, gates.RESOURCE, None), ("t", gates.RUNTIME, gates.SEMANTIC, gates.SEMANTIC),
    ("k", gates.SEMANTIC, gates.SEMANTIC, gates.SEMANTIC), ("e", gates.SEMANTIC, gates.SEMANTIC, gates.SEMANTIC),
])
def test_gates_give_the_first_reason(spark, other, ttr, share, plain):
    obs = gates.signed(observed(spark, *[(a, f, 0.5) for a in ("a", other) for f in (TTR, SHARE, PLAIN)]), signatures(spark, a=SIGNED["a"], **{other: SIGNED[other]}))
    rows = {r["feature_id"]: r for r in compare.compared(spark.createDataFrame([("1", "a", other)], "pair_id string, left string, right string"), obs).collect()}
    assert {f: rows[f]["reason"] for f in rows} == {TTR: ttr, SHARE: share, PLAIN: plain}
    assert all((r["value"] is None) == (r["reason"] is not None) for r in rows.values())


def test_compat_hash_is_of_the_canonical_tree(spark):
    obs = {(r["artifact_id"], r["feature_id"]): r["compat_sha256"] for r in gates.signed(observed(spark, *[(a, f, 0.5) for a in ("a", "n", "k") for f in (TTR, SHARE, PLAIN)]), signatures(spark, a=SIGNED["a"], n=SIGNED["n"], k=SIGNED["k"])).collect()}
    tree = {"backend_compatibility_id": "q/1", "feature_id": SHARE, "resources": [{"id": "function-words-en", "sha256": "h1", "version": "1"}], "semantic_version": "1.0.0"}
    assert obs["a", SHARE] == hashlib.sha256(corpus.canonical(tree).encode()).hexdigest()
    tree = {"backend_compatibility_id": "q/1", "feature_id": TTR, "resources": [], "runtime": "r1", "semantic_version": "1.0.0"}
    assert obs["a", TTR] == hashlib.sha256(corpus.canonical(tree).encode()).hexdigest() == obs["n", TTR]
    assert obs["n", SHARE] is None and obs["k", PLAIN] is None


def test_pools_drop_features_that_are_parted(spark):
    obs = gates.signed(observed(spark, *[(a, f, 0.5) for a in ("a", "b", "r") for f in (TTR, SHARE, PLAIN)]), signatures(spark, a=SIGNED["a"], b=SIGNED["b"], r=SIGNED["r"]))
    members = spark.createDataFrame([("s", "a", 0), ("s", "b", 1), ("s", "r", 2), ("t", "r", 0)], "set_id string, artifact_id string, ordinal int")
    kept, dropped = gates.gated(members, obs)
    assert {(r["set_id"], r["feature_id"], r["reason"]) for r in dropped.collect()} == {("s", TTR, gates.RUNTIME), ("s", SHARE, gates.RESOURCE)}
    assert Counter((r["set_id"], r["feature_id"]) for r in kept.collect()) == {("s", PLAIN): 3, ("t", TTR): 1, ("t", SHARE): 1, ("t", PLAIN): 1}


def test_counts_of_features_that_do_not_pool(spark):
    rows = [("a", "ok"), ("b", "insufficient_support")]
    obs = spark.createDataFrame([(a, "text.lexical.window_ttr_100", s) for a, s in rows], "artifact_id string, feature_id string, status string")
    members = spark.createDataFrame([("s", x) for x in "abc"], "set_id string, artifact_id string")
    assert tuple(aggregate.pooled_counts(members, obs).first()) == ("s", "text.lexical.window_ttr_100", 1, 2)


def test_sums_before_and_quantiles(spark):
    r = random.Random(3)
    rows = [(r.choice("abc"), r.randint(0, 40), r.randint(1, 5)) for _ in range(300)]
    merged = Counter()
    for k, v, n in rows:
        merged[k, v] += n
    df = spark.createDataFrame([(k, v, n) for (k, v), n in merged.items()], "k string, v int, n int")
    for x in tables.sums_before(df, ["k"], ["v"], before="n").collect():
        assert x["before"] == sum(n for (k, v), n in merged.items() if k == x["k"] and v < x["v"])
    import numpy as np

    got = {x["k"]: x for x in stats.quantiles(df, ["k"], "v", "n", {"a": 0.25, "b": 0.5, "c": 0.9}).collect()}
    for k in "abc":
        values = [v for (g, v), n in merged.items() if g == k for _ in range(n)]
        assert [got[k][c] for c in "abc"] == pytest.approx(list(np.percentile(values, [25, 50, 90]))) and got[k]["units"] == len(values)
    assert stats.quantiles(df, [], "v", "n", {"m": 0.5}).first()["m"] == np.median([v for (_, v), n in merged.items() for _ in range(n)])


def test_components_refuse_to_end_early(spark, monkeypatch):
    chain = spark.range(40).selectExpr("id AS a", "id + 1 AS b")
    assert {(x["node"], x["component"]) for x in graph.components(chain).collect()} == {(i, 0) for i in range(41)}
    monkeypatch.setattr(graph, "MAX_ROUNDS", 1)
    with pytest.raises(ArithmeticError):
        graph.components(chain)


def test_lookup_joins_hot_and_cold_keys(spark):
    left = spark.createDataFrame([(0 if i < 900 else i, i) for i in range(2000)], "k int, i int")
    right = left.groupBy("k").agg(F.count("*").alias("rows"), F.max("i").alias("top"))
    assert {(r["i"], r["top"]) for r in tables.lookup(left, right, "k", 2000).collect()} == {(i, 899 if i < 900 else i) for i in range(2000)}


# ---- pairs

def plain_selection(rows, per_author, per_problem, ratio):
    key = lambda p: hashlib.sha256(b"pair-select/1\0" + "\0".join([*sorted((p[2], p[3])), p[1]]).encode()).hexdigest()
    authors, problems, out, same, other = Counter(), Counter(), [], 0, 0
    for label in ("same", "different"):
        for p in sorted((p for p in rows if p[1] == label), key=key):
            full = (per_author and any(authors[a] >= per_author for a in p[4])) or (per_problem and any(problems[x] >= per_problem for x in p[5]))
            if full or (label == "different" and ratio is not None and other >= int(ratio * same)):
                continue
            authors.update(p[4])
            problems.update(p[5])
            same, other = same + (label == "same"), other + (label != "same")
            out.append(p[0])
    return sorted(out)


@pytest.mark.parametrize("caps", [(None, None, None), (3, None, None), (None, 2, 0.5), (2, 2, 1.5), (None, None, 0.4)])
def test_selection_is_the_greedy_loop(spark, caps):
    r = random.Random(7)
    rows = [(f"p{i}", label, f"{r.random():.9f}", f"{r.random():.9f}", ["a%d" % r.randint(0, 5)] if label == "same" else ["a%d" % r.randint(0, 5), "b%d" % r.randint(0, 5)], ["q%d" % r.randint(0, 9)]) for i, label in enumerate(r.choice(["same", "different", "different"]) for _ in range(120))]
    df = spark.createDataFrame([("train", p, p, label, a, b, au, pr) for p, label, a, b, au, pr in rows], "population string, left string, right string, label string, left_sha string, right_sha string, authors array<string>, problems array<string>")
    got = pairs.selected(df, *caps)
    assert sorted(x["left"] for x in got.collect()) == plain_selection(rows, *caps) and "rank_key" in got.columns


def test_pairs_and_populations(spark):
    arts = spark.createDataFrame([("1", "x", "s1", "q"), ("2", "x", "s2", "q"), ("3", "y", "s3", "q"), ("4", "y", "s4", "w")], "artifact_id string, author string, sha string, problem string")
    found = {(r["left"], r["right"], r["label"]) for r in pairs.enumerated(arts).collect()}
    assert found == {("1", "2", "same"), ("3", "4", "same"), ("1", "3", "different"), ("1", "4", "different"), ("2", "3", "different"), ("2", "4", "different")}
    assert {(r["left"], r["right"]) for r in pairs.enumerated(arts, "problem").filter("label = 'different'").collect()} == {("1", "3"), ("2", "3")}
    of = lambda a: "train tuning calibration evaluation".split()[sum(int(hashlib.sha256(f"population/1\0seed\0{a}".encode()).hexdigest(), 16) % 1_000_000 >= c for c in (400_000, 600_000, 800_000))]
    got = {(r["left"], r["right"]): r["population"] for r in pairs.assigned(pairs.enumerated(arts), "seed", 400_000, 200_000, 200_000).collect()}
    want = {(a, b): of(x) for (a, x), (b, y) in [(("1", "x"), ("2", "x")), (("3", "y"), ("4", "y")), (("1", "x"), ("3", "y")), (("1", "x"), ("4", "y")), (("2", "x"), ("3", "y")), (("2", "x"), ("4", "y"))] if of(x) == of(y)}
    assert got == want
    triples = spark.createDataFrame([("b" * 4, "a" * 4, "same"), ("a" * 4, "c" * 4, "different")], "left_sha string, right_sha string, label string")
    assert pairs.manifest_hash(triples).first()["sha256"] == hashlib.sha256(b'{"pairs":[["aaaa","cccc","different"],["bbbb","aaaa","same"]]}').hexdigest()
    members = spark.createDataFrame([("s", "z", 0), ("s", "b", 1)], "set_id string, artifact_id string, ordinal int")
    assert pairs.set_identity(members, "declared", "user").first()[1] == "es-" + hashlib.sha256(json.dumps({"linkage": ["declared", "user"], "members": ["z", "b"]}, sort_keys=True).encode()).hexdigest()[:16]


# ---- verification

def test_models_outside_their_scope_are_refused(spark):
    arts = spark.createDataFrame([("a", "text", "en"), ("b", "text", "de"), ("c", "code", "python")], "artifact_id string, kind string, language string")
    ends = lambda l, r: spark.createDataFrame([(l, r)], "left string, right string")
    good = verify.Verifier((TTR,), (0.0,), (1.0,), (1.0,), 0.0, metrics=("ABS",))
    verify.check_model(good, ends("a", "b"), arts)
    from dataclasses import replace

    for model, l, r in ((good, "a", "c"), (replace(good, languages=("en",)), "a", "b"), (replace(good, model_id="x"), "a", "b"), (replace(good, backend="x"), "a", "b"), (replace(good, registry_version="0"), "a", "b"), (replace(good, features=("no",)), "a", "b"), (replace(good, metrics=("W1",)), "a", "b")):
        with pytest.raises(ValueError):
            verify.check_model(model, ends(l, r), arts)


def test_candidates_by_kind_language_and_choice():
    english, french = verify.candidates("text", ("en",)), verify.candidates("text", ("fr", "en"))
    assert SHARE in english and SHARE not in french and TTR in french and not any(c.startswith("text.linguistic.") for c in english)
    assert "text.linguistic.upos" in verify.candidates("text", ("en",), linguistic=True) and "text.lexical.word_count" not in english
    assert verify.candidates("text", (), (TTR, SHARE)) == [TTR] and "code.python.lexical.token_class" in verify.candidates("code", ("python",)) and "code.parser.named_depth" in verify.candidates("code", ("c",))
    for bad in ("text.lexical.word_count", "code.surface.indent_kind", "nothing"):
        with pytest.raises(ValueError):
            verify.candidates("text", (), (bad,))


def separable(spark, n=10):
    rows = [(f"s{i}", "same", TTR, 0.001 * (i + 1)) for i in range(n)] + [(f"d{i}", "different", TTR, 0.39 + 0.001 * i) for i in range(n)]
    return spark.createDataFrame([(p, f, v) for p, _, f, v in rows], "pair_id string, feature_id string, value double"), spark.createDataFrame([(p, x) for p, x, _, _ in rows], "pair_id string, label string")


def test_fit_options(spark):
    values, labels = separable(spark)
    model = verify.fitted(values, labels, fixed=(0.8, 0.1), kind="text", languages=("en",))
    assert (model.t_same, model.t_different, model.metrics, model.languages) == (0.8, 0.1, ("ABS",), ("en",))
    x = [(0.001 * (i + 1), 1) for i in range(10)] + [(0.39 + 0.001 * i, 0) for i in range(10)]
    mean = sum(v for v, _ in x) / 20
    sd = (sum((v - mean) ** 2 for v, _ in x) / 20) ** 0.5
    from math import exp

    w = b = 0.0
    for _ in range(4000):
        g = [1 / (1 + exp(-(w * (v - mean) / sd + b))) - y for v, y in x]
        w -= 0.1 * (sum(e * (v - mean) / sd for e, (v, _) in zip(g, x)) + w)
        b -= 0.1 * sum(g)
    assert model.weights[0] == pytest.approx(w, abs=1e-9) and model.intercept == pytest.approx(b, abs=1e-9) and model.means[0] == pytest.approx(mean)
    for options in ({"min_pairs": 21}, {"fixed": (0.1, 0.8)}, {"platt": True}, {"candidates": ["nothing"]}):
        with pytest.raises(ValueError):
            verify.fitted(values, labels, **options)


# ---- statuses

def test_failed_parses_have_their_status(spark):
    deep = "x = " + "(" * 60 + "1" + ")" * 60 + "\n"
    nested = "x = " + "-" * 250 + "1\n"
    sources = {"bytes": b"\xff\xfe\x00", "token": b"x = (\n", "string": b"x = 'a\n", "tree": b"x = = 1\n", "limit": nested.encode(), "good": deep.encode(), "codec": b"# coding: nothing\n"}
    arts = spark.createDataFrame([(k, v.decode("latin-1"), bytearray(v), "python") for k, v in sources.items()], "artifact_id string, text string, raw binary, language string")
    rows = observations.python_fingerprints(arts).filter("feature_id LIKE 'code.python.%' OR feature_id LIKE 'code.toolchain.%'").collect()
    by = {k: Counter(r["status"] for r in rows if r["artifact_id"] == k and r["feature_id"].startswith(observations.TOKEN_FEATURES)) for k in sources}
    tree = {k: Counter(r["status"] for r in rows if r["artifact_id"] == k and not r["feature_id"].startswith(observations.TOKEN_FEATURES)) for k in sources}
    whole = len(rows) // len(sources)
    assert whole == 40
    for k in ("bytes", "token", "string", "codec"):
        assert set(by[k]) == set(tree[k]) == {"parser_error"}
    assert set(tree["tree"]) == {"parser_error"} and by["tree"]["ok"] > 3 and "parser_error" not in by["tree"]
    assert set(tree["limit"]) == {"unavailable"} and by["limit"]["ok"] > 3 and tree["good"]["ok"] > 5


def test_features_without_a_parser_are_unavailable(spark):
    arts = spark.createDataFrame([("a", "let x = 1;", "javascript")], "artifact_id string, text string, language string")
    rows = {r["feature_id"]: r["status"] for r in observations.code_fingerprints(arts).collect()}
    assert sum(k.startswith("code.parser.") and v == "unavailable" for k, v in rows.items()) == 7
    rows = {r["feature_id"]: r["status"] for r in observations.fingerprints(arts, linguistic=True, disabled=("text.surface.",)).collect()}
    assert sum(k.startswith("text.linguistic.") and v == "unavailable" for k, v in rows.items()) == 5 and rows["text.surface.letter_case"] == "disabled" and len(rows) == 32
    assert rows[SHARE] == "not_applicable" and rows["text.lexical.word_count"] == "ok"


def test_bundles_compare_prose_in_sources(spark):
    one, two = '''# alpha beta\n\ndef f():\n    """Reads one thing."""\n''', '''# gamma beta delta\n\ndef g():\n    pass  # tail\n'''
    arts = spark.createDataFrame([(i, t, bytearray(t.encode()), "python") for i, t in (("a", one), ("b", two))], "artifact_id string, text string, raw binary, language string")
    embedded = python_code.embedded(python_code.facts(arts))
    rows = compare.compared_bundles(spark.createDataFrame([("1", "a", "b")], "pair_id string, left string, right string"), observations.python_fingerprints(arts), embedded, observations.fingerprints).collect()
    found = {r["feature_id"]: r["value"] for r in rows}
    assert any(k.startswith("code.python.") for k in found) and "embedded.comments.text.lexical.word_length" in found and not any(k.startswith("embedded.docstrings") for k in found)
    # word lengths 5, 4 against 5, 4, 5, 4
    assert found["embedded.comments.text.lexical.word_length"] == 0 and found["embedded.comments.text.lexical.ttr_casefold"] == 0


# ---- stores

def test_only_unknown_artifacts_are_measured(spark, tmp_path):
    key = lambda df: df.withColumn("cache_key", store.cache_key(F.sha2("text", 256), F.lit("text"), F.col("language"), "c0", "1.0.0", {"text": "1"}))
    arts = key(spark.createDataFrame([("a", "one two", "en"), ("b", "one two", "en"), ("c", "one two", "de")], "artifact_id string, text string, language string"))
    asked = []

    def measure(rows):
        asked.append(sorted(r["artifact_id"] for r in rows.collect()))
        return rows.select("artifact_id", F.lit(TTR).alias("feature_id"), F.length("text").alias("value"))

    every, fresh = store.measured(arts, None, measure)
    assert asked == [["a", "c"]] and sorted((r["artifact_id"], r["value"]) for r in every.collect()) == [("a", 7), ("b", 7), ("c", 7)]
    fresh.write.parquet(f"{tmp_path}/store")
    more = key(spark.createDataFrame([("x", "one two", "en"), ("y", "three", "en")], "artifact_id string, text string, language string"))
    every, _ = store.measured(more, spark.read.parquet(f"{tmp_path}/store"), measure)
    assert asked[1:] == [["y"]] and sorted((r["artifact_id"], r["value"]) for r in every.collect()) == [("x", 7), ("y", 5)]
    keys = {arts.select(store.cache_key(F.lit("h"), F.lit(k), F.lit(l), c, v, s).alias("k")).first()["k"] for k, l, c, v, s in (("text", "en", "c", "1", {}), ("code", "en", "c", "1", {}), ("text", "de", "c", "1", {}), ("text", "en", "d", "1", {}), ("text", "en", "c", "2", {}), ("text", "en", "c", "1", {"a": "1"}))}
    assert len(keys) == 6


def test_states_are_known_by_their_content(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apple pear"), (2, "pear plum")], "artifact_id long, text string")
    terms = represent.vocabulary(represent.grams(docs, represent.WORD_TFIDF), 2)
    path = store.save_state(terms, represent.WORD_TFIDF, 2, str(tmp_path))
    assert store.save_state(terms.repartition(3), represent.WORD_TFIDF, 2, str(tmp_path)) == path
    back, spec, n = store.load_state(spark, path)
    assert (spec, n) == (represent.WORD_TFIDF, 2) and sorted(map(tuple, back.collect())) == sorted(map(tuple, terms.collect()))
    wrong = f"{tmp_path}/{'0' * 64}"
    spark.read.parquet(path).write.parquet(wrong)
    with pytest.raises(ValueError):
        store.load_state(spark, wrong)


def test_baselines_by_path_and_id(spark, tmp_path):
    base = profile.baseline(observed(spark, ("a", TTR, 0.5), ("b", TTR, 0.7)))
    one, two = f"{tmp_path}/one", f"{tmp_path}/two"
    path = store.save_baseline(base, "news", one)
    assert sorted((r["value"], r["n"]) for r in store.resolve_baseline(spark, path).collect()) == [(0.5, 1), (0.7, 1)]
    store.save_baseline(base, "news", two)
    assert store.resolve_baseline(spark, "news", (one, two)).count() == 2
    for ref, roots in (("none", (one,)), (f"{tmp_path}/nothing", ())):
        with pytest.raises(ValueError, match="NOT_FOUND"):
            store.resolve_baseline(spark, ref, roots)
    store.save_baseline(profile.baseline(observed(spark, ("a", TTR, 0.1))), "news", f"{tmp_path}/three")
    with pytest.raises(ValueError, match="INVALID"):
        store.resolve_baseline(spark, "news", (one, f"{tmp_path}/three"))


# ---- corpus

def test_rows_are_checked_again(spark, tmp_path):
    arts = spark.createDataFrame([("a", "one", "text", "en")], "artifact_id string, text string, kind string, language string")
    obs = observed(spark, ("a", TTR, 0.5)).withColumns({c: F.lit(None).cast("bigint") for c in ("int_value", "numerator", "denominator")}).withColumn("summary", F.lit(None).cast("struct<n:bigint>"))
    rows = corpus.corpus_rows(arts, obs)
    corpus.write_corpus(rows, f"{tmp_path}/c")
    assert [r["fault"] for r in corpus.scan_corpus(spark, f"{tmp_path}/c").collect()] == [None]
    good = rows.first()
    spaced = good["canonical_json"].replace(":", ": ", 1)
    faults = {
        "HASH": {"scientific_sha256": "0" * 64}, "NOT_JSON": {"canonical_json": "{"}, "NOT_CANONICAL": {"canonical_json": spaced, "scientific_sha256": hashlib.sha256(spaced.encode()).hexdigest()},
        "COLUMNS": {"artifact_id": "b"}, "IDENTITY": {"schema": "other"},
    }
    bad = spark.createDataFrame([tuple((good.asDict() | change)[c] for c in rows.columns) for change in faults.values()], corpus.ROW_SCHEMA)
    assert [r["fault"] for r in corpus.validated(bad.coalesce(1)).collect()] == list(faults)
    corpus.write_json(rows, f"{tmp_path}/j")
    back = corpus.read_json(spark, f"{tmp_path}/j").first()
    assert back["fault"] is None and (back["artifact_id"], back["ok_feature_count"], back["scientific_sha256"]) == ("a", 1, good["scientific_sha256"])
    assert (tmp_path / "j").is_dir() and corpus.frame(rows).num_rows == 1 and list(corpus.frame(rows, "pandas")["artifact_id"]) == ["a"]


# ---- configuration, manifests and files

def test_configuration(tmp_path):
    assert config.load(cwd=str(tmp_path), env={}) == config.Config() and config.Config().disabled() == ()
    (tmp_path / "pyproject.toml").write_text("[tool.quillframe.input]\nmax_files = 5\n")
    assert config.load(cwd=str(tmp_path), env={}).input.max_files == 5
    (tmp_path / "quillframe.toml").write_text("[analysis.text]\nfunction_words_en = false\n[analysis.code.python]\nenabled = false\n[baseline]\nsearch_paths = ['x']\n")
    found = config.load(cwd=str(tmp_path), env={})
    assert found.disabled() == ("text.function_words.en.", "code.python.", "code.toolchain.") and found.baseline.search_paths == ("x",) and found.input.max_files == 10_000
    other = tmp_path / "other.toml"
    other.write_text("version = 1\n")
    assert config.load(cwd=str(tmp_path), env={"QUILLFRAME_CONFIG": str(other)}) == config.Config()
    for text in ("[input]\nmax_file = 1\n", "version = 2\n", "[input]\nmax_files = 'many'\n", "[input]\ninclude = [1]\n", "input = 3\n"):
        other.write_text(text)
        with pytest.raises(ValueError):
            config.load(str(other))
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "none.toml"))


def test_manifests(spark, tmp_path):
    head = "id = 'd'\nversion = '1'\nlicense = 'x'\nredistribution = 'allowed'\nsource = 's'\n"
    sha = hashlib.sha256(b"text").hexdigest()
    item = lambda i, **more: "[[artifact]]\n" + "".join(f"{k} = '{v}'\n" for k, v in ({"id": i, "path": f"{i}.txt", "sha256": sha, "kind": "text", "language": "en"} | more).items())
    file = tmp_path / "m.toml"
    file.write_text(head + item("a", author_id="x") + item("b") + "[[transformation]]\noriginal = 'a'\nvariant = 'b'\ntransformation_id = 't'\n")
    header, artifacts, moves = config.dataset(spark, str(file))
    assert header["id"] == "d" and {(r["id"], r["author_id"]) for r in artifacts.collect()} == {("a", "x"), ("b", None)} and moves.count() == 1
    (tmp_path / "a.txt").write_text("text")
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.txt")).select(F.lit("a.txt").alias("path"), "content")
    assert {r["id"]: r["state"] for r in ingest.validated(artifacts, files).collect()} == {"a": "ok", "b": "missing"}
    assert ingest.validated(artifacts, files.withColumn("content", F.lit(b"other"))).filter("id = 'a'").first()["state"] == "changed"
    for text in (head + "more = 1\n", head + item("a") + item("a"), head + item("a", sha256="0"), head + item("a", colour="red"), head.replace("allowed", "maybe")):
        file.write_text(text)
        with pytest.raises(ValueError):
            config.dataset(spark, str(file))
    file.write_text("id = 'b'\ntask = 'split_audit'\ndataset = 'd.toml'\n[split]\nseed = 's'\ntrain_ppm = 500000\ndev_ppm = 250000\ntest_ppm = 250000\n[[pair]]\nleft = 'a'\nright = 'b'\nlabel = 'same'\n")
    header, found = config.benchmark(spark, str(file))
    assert header["split"]["seed"] == "s" and tuple(found.first()) == ("a", "b", "same", None)
    file.write_text("id = 't'\ndataset = 'd.toml'\n[verifier]\nl2_lambda = 1.0\n[[pair]]\nleft = 'a'\nright = 'b'\nlabel = 'different'\npopulation = 'tuning'\n")
    assert tuple(config.training(spark, str(file))[1].first()) == ("a", "b", "different", "tuning")
    for text in ("id = 'b'\ntask = 'none'\ndataset = 'd'\n", "id = 'b'\ntask = 'split_audit'\ndataset = 'd'\n[[pair]]\nleft = 'a'\nright = 'a'\nlabel = 'same'\n", "id = 'b'\ntask = 'split_audit'\ndataset = 'd'\n[split]\nseed = 's'\ntrain_ppm = 1\n"):
        file.write_text(text)
        with pytest.raises(ValueError):
            config.benchmark(spark, str(file))


def test_files_folders_and_standard_input(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "in.txt").write_text("in")
    (tmp_path / "one.txt").write_text("one")
    (tmp_path / "link.txt").symlink_to(tmp_path / "one.txt")
    rows = ingest.from_files(spark, [str(tmp_path / x) for x in ("one.txt", "link.txt", "none.txt", "d")], b"typed").collect()
    assert {(r["path"].rpartition("/")[2], bytes(r["content"]) if r["content"] is not None else None, r["reason"]) for r in rows} == {("one.txt", b"one", None), ("link.txt", None, "LINK"), ("none.txt", None, "MISSING"), ("-", b"typed", None), ("in.txt", b"in", None)}


def test_strict_decoding(spark):
    rows = spark.createDataFrame([(0, bytearray("é".encode("latin-1"))), (1, bytearray("\ufeffé".encode())), (2, bytearray(b"a\0b")), (3, None)], "i int, content binary")
    assert [(r["text"], r["reason"]) for r in ingest.decoded(rows.coalesce(1)).collect()] == [(None, "UNDECODABLE"), ("é", None), (None, "NUL"), (None, "NULL")]
    assert ingest.decoded(rows, encoding="latin-1").filter("i = 0").first()["text"] == "é"
    with pytest.raises(LookupError):
        ingest.decoded(rows, encoding="nothing")


def test_texts_that_are_refused_have_a_reason(spark):
    rows = spark.createDataFrame([(1, "fine"), (2, None), (3, "a\0b")], "artifact_id int, text string")
    assert [(r["text"], r["reason"], r["content_sha256"] is None) for r in ingest.from_text(rows.coalesce(1)).collect()] == [("fine", None, False), (None, "NULL", True), (None, "NUL", True)]
