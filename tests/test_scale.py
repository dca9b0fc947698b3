"""Steps that have to stay in proportion to the input, against plain loops on odd and repeated inputs."""

import hashlib
import itertools
import random
import re
from collections import Counter

import pytest

from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.functions import unicode as U
from quillframe.operators import corpus, pairs, represent, store, text, verify
from quillframe.plans import corpus_queries, queries


def plan(df):
    return df._jdf.queryExecution().toString()


# ---- pairs

PAIR = "population string, left string, right string, label string, left_sha string, right_sha string, authors array<string>"


def test_pairs_within_blocks_are_made_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PART_ROWS", 3)
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", "c", None]), f"s{i}", r.randint(0, 2), r.choice("xy")) for i in range(80)]
    got = pairs.within(spark.createDataFrame(rows, "artifact_id long, author string, sha string, block int, of string"), "block", "of")
    want = {(a[0], b[0], "same" if a[1] == b[1] else "different", a[4]) for a, b in itertools.combinations(rows, 2) if a[3:] == b[3:] and a[1] and b[1]}
    found = got.collect()
    assert {(x["left"], x["right"], x["label"], x["of"]) for x in found} == want and len(found) == len(want)
    assert all(len(x["authors"]) == (1 if x["label"] == "same" else 2) for x in found)


def test_pairs_of_one_key_are_selected_together(spark):
    other = [("train", f"l{i}", f"r{i}", "different", f"{i // 5}", "z", ["a", "b"]) for i in range(40)]
    same = [("train", f"m{i}", f"n{i}", "same", f"{i}", "y", ["a"]) for i in range(6)]
    got = {x["left"] for x in pairs.selected(spark.createDataFrame(other + same, PAIR), ratio=1.5).filter("label = 'different'").collect()}
    key = lambda p: hashlib.sha256(b"pair-select/1\0" + "\0".join([*sorted(p[4:6]), p[3]]).encode()).hexdigest()
    keys = sorted(map(key, other))
    assert got == {p[1] for p in other if sum(k < key(p) for k in keys) < 9} and len(got) == 10


def test_manifest_is_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CHUNK", 500)
    rows = [("train", f"l{i}", f"r{i}", "same", hashlib.sha256(b"%d" % (i % 700)).hexdigest(), hashlib.sha256(b"%d" % i).hexdigest(), ["a"]) for i in range(3000)]
    for given in (rows, []):
        found = pairs.manifest_hash(spark.createDataFrame(given, PAIR))
        lines = sorted(f'["{x[4]}","{x[5]}","{x[3]}"]' for x in given)
        assert tuple(found.first()) == (len(given), hashlib.sha256(('{"pairs":[' + ",".join(lines) + "]}").encode()).hexdigest())
        assert "collect_list" not in plan(found)


# ---- fitting

def test_newton_converges_on_values_close_together(spark):
    """Logits that nearly agree, as of a feature that parts nothing: their Hessian is nearly singular."""
    n = 4000
    rows = spark.range(n).select((F.xxhash64("id") % 2 == 0).cast("double").alias("y"), F.array(F.lit(3.0) + (F.xxhash64(F.lit(1), "id") % 1000) * 1e-9).alias("x"))
    w = verify.newton(rows, 1, 0.0)
    got = rows.agg(F.avg("y"), F.avg(1 / (1 + F.exp(-(F.col("x")[0] * float(w[0]) + float(w[1]))))), F.corr("y", F.col("x")[0]), F.stddev_pop(F.col("x")[0])).first()
    assert abs(got[0] - got[1]) < 1e-6 and abs(w[0] * got[3] - 2 * got[2]) < 0.2 * abs(got[2])


# ---- n-grams

def plain_grams(rows, spec):
    out = {}
    for a, text in rows:
        found = re.findall(r"[^\W\d_]+|\d+", text or "")
        units = list(text or "") if spec.unit == "char" else [w.casefold() for w in found if not w[0].isdecimal()]
        for n in range(spec.low, spec.high + 1):
            for i in range(len(units) - n + 1):
                of = out.setdefault(a, Counter())
                of[("" if spec.unit == "char" else " ").join(units[i : i + n])] += 1
    return out


@pytest.mark.parametrize("spec", [represent.CHAR, represent.WORD, represent.Spec("char", 1, 12), represent.Spec("word", 2, 9)])
def test_grams_are_counted_where_texts_are_read(spark, monkeypatch, spec):
    """Texts of one artifact in several rows, long and empty ones, characters of all widths, and more digits than a number holds."""
    monkeypatch.setattr(represent, "UNITS", 300)
    r = random.Random(5)
    words = ["Straße", "the", "THE", "Ärger", "été", "ΣΟΦΟΣ", "漢字", "x", "12", "日本", "𝒳y", "a😀b"]
    rows = [(r.randint(0, 40), " ".join(r.choice(words) for _ in range(r.choice((0, 1, 3, 30, 200))))) for _ in range(90)] + [(50, None), (51, ""), (52, "".join(map(chr, range(0x4E00, 0x5300))))]
    docs, want = spark.createDataFrame(rows, "artifact_id long, text string"), plain_grams(rows, spec)
    grams = represent.grams(docs, spec)
    assert {(x["artifact_id"], x["term"]): x["n"] for x in grams.collect()} == {(a, t): n for a, ts in want.items() for t, n in ts.items()}
    assert "HashAggregate" not in plan(grams)
    assert sorted(map(tuple, represent.sizes(docs, spec).collect())) == sorted((a, len(ts), sum(ts.values()), max(ts.values())) for a, ts in want.items())
    assert {tuple(x) for x in represent.totals(docs, spec).collect()} == {(t, sum(t in ts for ts in want.values()), sum(ts[t] for ts in want.values())) for t in {t for ts in want.values() for t in ts}}


def test_weights_need_no_join_with_the_terms(spark):
    r = random.Random(6)
    docs = spark.createDataFrame([(f"d{i}", "the " + " ".join(r.choice("alpha beta gamma delta epsilon straße".split()) for _ in range(r.randint(0, 30)))) for i in range(300)], "artifact_id string, text string")
    counts = represent.grams(docs, represent.WORD_TFIDF)
    terms = represent.vocabulary(counts, 300)
    got = represent.normed(represent.weighted(counts, 300))
    assert "SortMergeJoin" not in plan(got)
    want = {(x["artifact_id"], x["index"]): x["value"] for x in represent.transformed(counts, terms, represent.WORD_TFIDF).collect()}
    assert {(x["artifact_id"], x["index"]): x["value"] for x in got.collect()} == pytest.approx(want, rel=1e-12)
    assert sorted(map(tuple, represent.vocabulary_of(docs, represent.WORD_TFIDF, 300).collect())) == sorted(map(tuple, terms.collect()))


# ---- ranges and lengths

def test_rows_ahead_are_counted_without_pairs(spark):
    r = random.Random(8)
    rows = [(i, r.choice([1, 2, None]), r.choice([None, float("nan"), 0.0, -0.0, 0.1 + 0.2, 1.3, 1.0, 5.0, r.random() * 3])) for i in range(300)]
    found = corpus.ahead(spark.createDataFrame(rows, "i long, k int, v double"), "k", "v", 1.0)
    assert {x["i"]: x["n"] for x in found.collect()} == {i: sum(k is not None and k == b and v is not None and w is not None and v < w <= v + 1 for _, b, w in rows) for i, k, v in rows}
    assert "BroadcastNestedLoopJoin" not in plan(found)


def test_lengths_are_computed_once(spark):
    """Runs of a sorted array, computed once: the patterns of tokens and sentences occur once in the plan of each list."""
    given = ["One two. Three 4.5 five! Six?\n\nSeven eight's nine. Ten.", "", None, "x", "A b. c d.\n \nE f. " * 3]
    docs = spark.createDataFrame(list(enumerate(given)), "artifact_id int, text string")
    got = {(x["artifact_id"], x["feature_id"].rpartition(".")[2], x["key"]): x["n"] for x in text.structure_events(docs).collect()}
    want = Counter()
    for a, t in enumerate(given):
        for p in [p for p in re.split(r"\n\s*\n", t or "") if p.strip()]:
            sentences = [s.strip() for s in re.split(r"(?<=[.!?])(?=\s)", p) if s.strip()]
            sizes = [len(re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*|\d+(?:[.,_]\d+)*", s)) for s in sentences]
            want.update([(a, "paragraph_sentence_count", str(len(sentences))), (a, "paragraph_token_count", str(sum(sizes)))])
            want.update([(a, "sentence_length_tokens", str(n)) for n in sizes] + [(a, "sentence_length_characters", str(len(s))) for s in sentences])
    assert got == dict(want)
    optimized = text.structure_events(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("regexp_extract_all(") <= 2


def test_trim_is_of_white_space_at_the_ends(spark):
    white = [chr(i) for i in range(0x3001) if re.fullmatch(r"[\t-\r \x85\xa0  -     　]", chr(i))]
    assert len(white) == 25 and set(white) == set(U.WHITE_CHARACTERS)
    given = ["", "a", *white, *(w + "a" + w + "é b" + w * 2 for w in white), "​x​", "".join(white)]
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", T.trim(F.col("t")).alias("cut"), F.regexp_replace("t", rf"^[{U.WHITE}]+|[{U.WHITE}]+\z", "").alias("old")).collect()
    assert all(x["cut"] == x["old"] for x in rows) and "RegExp" not in plan(spark.createDataFrame([("a",)], "t string").select(T.trim(F.col("t"))))


def test_texts_are_shuffled_once_to_be_measured_once(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7}", f"k{i % 7}") for i in range(30)], "artifact_id long, text string, cache_key string")
    plans = []

    def measure(rows):
        plans.append(plan(rows))
        return rows.select("artifact_id", F.length("text").alias("value"))

    every, fresh = store.measured(docs, None, measure)
    assert sorted(map(tuple, every.select("artifact_id", "cache_key", "value").collect())) == sorted((i, f"k{i % 7}", 6) for i in range(30)) and fresh.count() == 7
    assert "hashpartitioning(cache_key" in plans[0] and not re.search(r"hashpartitioning\(cache_key#\d+, artifact_id", plans[0])


def test_surface_is_counted_without_a_pattern_each(spark):
    r = random.Random(9)
    given = ["", None, "....", "\r\n\r\r\n\n", *("".join(r.choice("ab\r\n\t .…   '’\"“”‘«»-–—\x0b") for _ in range(60)) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(given)), "artifact_id int, text string")
    named = {"lf": r"(?<!\r)\n", "crlf": r"\r\n", "cr": r"\r(?!\n)", "line_separator": " ", "paragraph_separator": " "}
    white = {"space_ascii": " ", "tab": r"\t", "line_feed": r"\n", "carriage_return": r"\r", "line_separator": " ", "paragraph_separator": " ", "other_white_space": "[\x0b ]"}
    want = Counter()
    for i, t in enumerate(given):
        for f, patterns in (("line_ending", named), ("whitespace_class", white), ("marker_style", {k: re.escape(m) for k, m in T.MARKERS.items()})):
            want.update({(i, f, k): len(re.findall(p, t or "")) for k, p in patterns.items()})
    found = text.surface_events(rows)
    assert {(x["artifact_id"], x["feature_id"].rpartition(".")[2], x["key"]): x["n"] for x in found.collect()} == dict(+want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") <= 1


def test_pairs_with_a_wordless_end_are_not_scored(spark, tmp_path):
    """Their SQL has no row for such a text, so that they are no decisions either."""
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in enumerate(["a b a", "c d", "12 34", "e f e f", "g", "h i h"])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_queries.decision_metrics(spark, str(tmp_path)).first()["n"] == 3
    assert {x["pair_id"] for x in queries.verifier_scores(spark, str(tmp_path)).collect()} == {"0-1", "3-4", "4-5"}
