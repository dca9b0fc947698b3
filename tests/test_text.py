"""Tokens, sentences, paragraphs, names and folding, against stated values."""

import pytest
from pyspark.sql import functions as F

from quillframe.functions import lexicon
from quillframe.functions import text as T
from quillframe.functions import unicode as U
from quillframe.operators import code, represent, text


def value(spark, column, **row):
    return spark.createDataFrame([row]).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("given", "words", "numbers"), [
    ("We can't co-own—much. Übel rôle 2.71", ["We", "can't", "co", "own", "much", "Übel", "rôle"], ["2.71"]),
    ("'cat' fish’n’chips a_b 20_000,75", ["cat", "fish’n’chips", "a", "b"], ["20_000,75"]),
    ("7.8..9", [], ["7.8", "9"]),
    ("Ⅻ ¾ ①", [], []),
])
def test_tokens(spark, given, words, numbers):
    assert value(spark, T.words(F.col("t")), t=given) == words
    assert value(spark, T.numbers(F.col("t")), t=given) == numbers


@pytest.mark.parametrize(("given", "want"), [
    ("St. Mary stood. It was 2.5 miles! Far?", ["St.", "Mary stood.", "It was 2.5 miles!", "Far?"]),
    ("‹No…› he said", ["‹No…›", "he said"]),
    ("p.q?r", ["p.q?r"]),
    ("", []),
])
def test_sentences(spark, given, want):
    assert value(spark, T.sentences(F.col("t")), t=given) == want


def test_paragraphs_and_lines(spark):
    assert value(spark, T.paragraphs(F.col("t")), t="a\r\n\r\nb c") == ["a", "b c"]
    assert value(spark, T.paragraphs(F.col("t")), t="a b") == ["a", "b"]
    assert value(spark, T.lines(F.col("t")), t="") == []
    assert value(spark, T.lines(F.col("t")), t="a\r\nb\rc\n") == ["a", "b", "c", ""]
    assert value(spark, T.line_endings(F.col("t")), t="a\r\nb\rc\n") == {"crlf": 1, "cr": 1, "lf": 1}


@pytest.mark.parametrize(("name", "style", "parts"), [
    ("_", "discard", []), ("__init__", "dunder", ["init"]), ("snake_case", "snake_lower", ["snake", "case"]), ("UPPER_CASE", "snake_upper", ["UPPER", "CASE"]),
    ("camelCase", "camel_lower", ["camel", "Case"]), ("HTTPServer", "pascal", ["HTTP", "Server"]), ("x", "lower", ["x"]), ("X", "upper", ["X"]), ("Mixed_name", "mixed", ["Mixed", "name"]), ("__", "other", []),
])
def test_names(spark, name, style, parts):
    assert value(spark, T.case_style(F.col("t")), t=name) == style
    assert value(spark, T.name_parts(F.col("t")), t=name) == parts


def test_casefold_is_pythons(spark):
    words = [c for c in U.folding()] + ["Straße", "ΑΣ", "İx", "plain"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", U.casefold(F.col("w")).alias("f")).collect()
    assert [r["f"] for r in rows] == [r["w"].casefold() for r in rows]


def test_lexicon():
    assert lexicon.digest(lexicon.function_words()) == lexicon.SHA256


def docs(spark, *texts, language="en"):
    return spark.createDataFrame([(i, t, language) for i, t in enumerate(texts)], "artifact_id long, text string, language string")


def test_diversity(spark):
    r = text.lexical_scalars(docs(spark, "a a b c", "")).orderBy("artifact_id").collect()
    assert (r[0]["word_count"], r[0]["type_count"], r[0]["ttr"], r[0]["hapax_count"], r[0]["hapax_share"], r[0]["simpson"]) == (4, 3, 0.75, 2, 0.5, 0.375)
    assert r[0]["entropy_bits"] == pytest.approx(1.5)
    assert (r[1]["word_count"], r[1]["type_count"], r[1]["ttr"]) == (0, 0, None)


def test_windows(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)]
    r = text.window_ttr(docs(spark, " ".join(words), " ".join(words[:99]), " ".join([*words, *(["x"] * 50), *words[:50], "tail"]))).orderBy("artifact_id").collect()
    assert [x["artifact_id"] for x in r] == [0, 2]
    assert r[0]["mean"] == 1.0 and r[0]["sample_sd"] is None
    assert r[1]["n"] == 2 and r[1]["mean"] == pytest.approx((1.0 + 0.51) / 2)


def test_function_words(spark):
    r = text.function_word_events(docs(spark, "They could not see the river, yet he didn't.")).collect()
    assert {x["key"]: x["n"] for x in r} == {"they": 1, "could": 1, "not": 1, "the": 1, "yet": 1, "he": 1, "didn't": 1}
    assert text.function_word_events(docs(spark, "the", language="fr")).count() == 0


def test_code_lines(spark):
    d = docs(spark, "a\n\n\nb\n\nc", "a \nb\t\nc\n")
    assert {(r["artifact_id"], r["key"], r["n"]) for r in code.blank_runs(d).collect()} == {(0, "2", 1), (0, "1", 1), (1, "1", 1)}
    r = code.line_scalars(d).orderBy("artifact_id").collect()
    assert (r[0]["blank_lines"], r[0]["line_count"], r[1]["trailing_lines"], r[1]["line_count"]) == (3, 6, 2, 4)


def test_representations(spark):
    d = docs(spark, "aaaa", "ab")
    assert {(r["artifact_id"], r["term"], r["n"]) for r in represent.grams(d, represent.CHAR).collect()} == {(0, "aaa", 2), (0, "aaaa", 1)}
    fruit, spec = docs(spark, "apple banana", "banana cherry"), represent.Spec("word", 1, 1, "tfidf")
    counts = represent.grams(fruit, spec)
    terms = represent.vocabulary(counts, 2)
    idf = {r["term"]: (r["index"], r["idf"]) for r in terms.collect()}
    assert idf["apple"] == (0, pytest.approx(1.4054651081)) and idf["banana"] == (1, 1.0) and idf["cherry"][0] == 2
    norms = represent.transformed(counts, terms, spec).groupBy("artifact_id").agg(F.sum(F.col("value") * F.col("value")).alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in norms)


def test_token_offsets(spark):
    t = "  Don't, é 3.14\u2014x"
    rows = text.token_offsets(docs(spark, t, "", "..")).orderBy("artifact_id", "ordinal").collect()
    assert [(r["token"], r["start"], r["end"]) for r in rows] == [("Don't", 2, 7), ("é", 9, 10), ("3.14", 11, 15), ("x", 16, 17)]
    assert all(t[r["start"] : r["end"]] == r["token"] for r in rows)
