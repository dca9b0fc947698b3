"""Text analyzers: each takes artifacts (artifact_id, text, language, ...) and measures them without Python workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.functions import unicode as U
from quillframe.functions.lexicon import function_words
from quillframe.functions.stats import quantiles
from quillframe.plans.tables import keyed

WINDOW = 100


def _event(feature: str, key: Column, n: Column | None = None) -> Column:
    return F.struct(F.lit(feature).alias("feature_id"), key.cast("string").alias("key"), (F.lit(1) if n is None else n).cast("bigint").alias("n"))


def _each(items: Column, feature: str, key) -> Column:
    return F.transform(items, lambda x: _event(feature, key(x)))


def _entries(table: Column, feature: str) -> Column:
    return F.transform(F.map_entries(table), lambda e: _event(feature, e["key"], e["value"]))


def tokenized(artifacts: DataFrame) -> DataFrame:
    """artifacts with tokens and words, taken once."""
    return artifacts.withColumn("tokens", T.tokens(F.col("text"))).withColumn("words", F.filter("tokens", lambda t: t.rlike(r"^\p{L}")))


def surface_event_list() -> Column:
    """Line endings, whitespace classes and markers."""
    text = F.col("text")
    return F.concat(_entries(T.line_endings(text), "text.surface.line_ending"), _entries(T.whitespace_classes(text), "text.surface.whitespace_class"), _entries(T.markers(text), "text.surface.marker_style"))


def surface_events(artifacts: DataFrame) -> DataFrame:
    """Line endings, whitespace classes and markers as (artifact_id, feature_id, key, n)."""
    return artifacts.select("artifact_id", F.inline(surface_event_list()))


def bound(value: Column, use) -> Column:
    """use(value), value being computed once however often it occurs there, also within lambdas."""
    return F.transform(F.array(value), use)[0]


def counted(array: Column, feature: str) -> Column:
    """Events of the values of an array of numbers, counted within the row: the array is computed and sorted once, and its runs are measured."""

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        starts = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))
        return bound(starts, lambda s: F.transform(s, lambda i, k: _event(feature, F.get(ordered, i - 1), F.coalesce(F.get(s, k + 1), n + 1) - i)))

    return bound(F.sort_array(array), runs)


def token_event_list() -> Column:
    """Word lengths and token kinds, from tokens and words."""
    kinds = T.counts({"word": F.size("words"), "number": F.size("tokens") - F.size("words")})
    return F.concat(counted(F.transform("words", lambda w: F.least(F.length(w), F.lit(31))), "text.lexical.word_length"), _entries(kinds, "text.lexical.token_kind"))


def token_events(artifacts: DataFrame) -> DataFrame:
    """Word lengths and token kinds."""
    return tokenized(artifacts).select("artifact_id", F.inline(token_event_list()))


def structured(artifacts: DataFrame) -> DataFrame:
    """artifacts with paragraphs and the sentences of each."""
    return artifacts.withColumn("paragraphs", T.paragraphs(F.col("text"))).withColumn("sentences", F.transform("paragraphs", T.sentences))


def structure_event_list() -> Column:
    """Lengths of sentences and paragraphs, from paragraphs and sentences; no token goes beyond its sentence, so that each is found once."""

    def events(sentences: Column, sizes: Column) -> Column:
        flat, total = F.flatten(sentences), lambda p: F.aggregate(p, F.lit(0), lambda a, n: a + n)
        return F.concat(
            counted(F.transform(F.flatten(sizes), lambda n: F.least(n, F.lit(101))), "text.structure.sentence_length_tokens"),
            counted(F.transform(flat, lambda s: F.least(F.length(s), F.lit(501))), "text.structure.sentence_length_characters"),
            counted(F.transform(sizes, lambda p: F.least(F.size(p), F.lit(51))), "text.structure.paragraph_sentence_count"),
            counted(F.transform(sizes, lambda p: F.least(total(p), F.lit(501))), "text.structure.paragraph_token_count"),
        )

    return bound(F.col("sentences"), lambda s: bound(F.transform(s, lambda p: F.transform(p, lambda x: F.size(T.tokens(x)))), lambda n: events(s, n)))


def structure_events(artifacts: DataFrame) -> DataFrame:
    """Lengths of sentences and paragraphs."""
    return structured(artifacts).select("artifact_id", F.inline(structure_event_list()))


def structure_scalars(artifacts: DataFrame) -> DataFrame:
    return structured(artifacts).select("artifact_id", F.size("paragraphs").cast("bigint").alias("paragraph_count"), F.size(F.flatten("sentences")).cast("bigint").alias("sentence_count"))


def character_counts(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, char, n); texts are dealt out before they are taken apart, so that no row per character is shuffled."""
    return keyed(artifacts).select("artifact_id", F.explode(T.extract(F.col("text"), "(?s).")).alias("char")).groupBy("artifact_id", "char").agg(F.count(F.lit(1)).alias("n"))


def category_events(artifacts: DataFrame) -> DataFrame:
    """General categories, letter case and punctuation; the category table is bounded by Unicode."""
    table = U.categories(artifacts.sparkSession)
    known = character_counts(artifacts).join(F.broadcast(table), "char", "left").withColumn("category", F.coalesce("category", F.lit("Cn")))
    case = F.when(F.col("category") == "Lu", "upper").when(F.col("category") == "Ll", "lower").when(F.col("category") == "Lt", "title").when(F.col("category").startswith("L"), "uncased")
    code = F.hex(F.ascii("char").cast("bigint"))
    mark = F.when(F.col("category").startswith("P"), F.concat(F.lit("U+"), F.lpad(code, F.when(F.ascii("char") > 0xFFFF, 6).otherwise(4), F.lit("0"))))
    every = F.array(_event("text.surface.unicode_general_category", F.col("category"), F.col("n")), _event("text.surface.letter_case", case, F.col("n")), _event("text.surface.punctuation_codepoint", mark, F.col("n")))
    return known.select("artifact_id", F.inline(every)).filter("key is not null").groupBy("artifact_id", "feature_id", "key").agg(F.sum("n").alias("n"))


def word_types(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, word, n) by casefolded word; texts are dealt out before they are taken apart."""
    return keyed(artifacts).select("artifact_id", F.explode(T.words(F.col("text"))).alias("w")).groupBy("artifact_id", U.casefold(F.col("w")).alias("word")).agg(F.count(F.lit(1)).alias("n"))


def token_types(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, language (null if not given), word, number, n): word types, one row for all numbers, and one with n = 0 where there is no token.

    Tokens are counted as they are written first, so that a form is folded once for each artifact.
    """
    language = F.col("language") if "language" in artifacts.columns else F.lit(None).cast("string").alias("language")
    rows = keyed(artifacts).select("artifact_id", language, F.explode_outer(T.tokens(F.col("text"))).alias("t"))
    forms = rows.groupBy("artifact_id", "language", "t").agg(F.count("t").alias("times"))
    is_word = F.coalesce(F.col("t").rlike(r"^\p{L}"), F.lit(False))
    return forms.groupBy("artifact_id", "language", F.when(is_word, U.casefold(F.col("t"))).alias("word"), (~is_word).alias("number")).agg(F.sum("times").alias("n"))


def diversity(types: DataFrame) -> DataFrame:
    """Type and hapax counts, entropy and concentration, from word_types()."""
    total, square = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    return types.groupBy("artifact_id").agg(
        total.alias("word_count"),
        F.count(F.lit(1)).alias("type_count"),
        F.count_if(F.col("n") == 1).alias("hapax_count"),
        (F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy_bits"),
        (square / (total * total)).alias("simpson"),
    )


def lexical_scalars(artifacts: DataFrame) -> DataFrame:
    """Counts and ratios of every artifact; ratios of nothing are null."""
    return type_scalars(token_types(artifacts))


def type_scalars(types: DataFrame) -> DataFrame:
    """lexical_scalars() from token_types(), with the number of matched function words."""
    word, n = F.col("word").isNotNull(), F.when(F.col("word").isNotNull(), F.col("n"))
    total, square = F.sum(n), F.sum(n * n)
    rows = types.groupBy("artifact_id").agg(
        F.coalesce(total, F.lit(0)).alias("word_count"),
        F.sum(F.when(F.col("number"), F.col("n")).otherwise(0)).alias("number_count"),
        F.count_if(word).alias("type_count"),
        F.count_if(word & (F.col("n") == 1)).alias("hapax_count"),
        (F.log2(total) - F.sum(n * F.log2(n)) / total).alias("entropy_bits"),
        (square / (total * total)).alias("simpson"),
        F.coalesce(F.sum(F.when(F.col("word").isin(*function_words()), F.col("n"))), F.lit(0)).alias("matched"),
        F.first("language", ignorenulls=True).alias("language"),
    )
    return rows.withColumns({"ttr": F.try_divide("type_count", "word_count"), "hapax_share": F.try_divide("hapax_count", "word_count")})


def window_ttr(artifacts: DataFrame, size: int = WINDOW) -> DataFrame:
    """Summary of the type share in consecutive full windows of words; a rest is dropped."""
    placed = keyed(artifacts).select("artifact_id", F.posexplode(T.words(F.col("text"))).alias("i", "w"))
    windows = placed.groupBy("artifact_id", F.floor(F.col("i") / size).alias("window")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(U.casefold(F.col("w"))).alias("types"))
    return summarized(windows.filter(F.col("n") == size).withColumn("x", F.col("types") / size), ["artifact_id"], "x")


def summarized(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Summary statistics of groups that are small, as one artifact's, with type-7 quartiles; the deviation of one value is null."""
    q = F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75))))
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("minimum"), q.alias("q"), F.max(value).alias("maximum"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sample_sd"))
    return out.select(*keys, "n", "minimum", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "maximum", "mean", "sample_sd")


def summarized_at_scale(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The same for groups of any size: quartiles from running counts over ranges of values."""
    counted_ = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("times"))
    out = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("minimum"), F.max(value).alias("maximum"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sample_sd"))
    q = quantiles(counted_, keys, value, "times", {"q25": 0.25, "median": 0.5, "q75": 0.75}).drop("units")
    return out.join(q, keys).select(*keys, "n", "minimum", "q25", "median", "q75", "maximum", "mean", "sample_sd")


def function_word_events(artifacts: DataFrame) -> DataFrame:
    """Matched function words of English artifacts."""
    return matched_events(token_types(artifacts.filter("language = 'en'")))


def matched_events(types: DataFrame) -> DataFrame:
    """function_word_events() from token_types()."""
    found = types.filter((F.col("language") == "en") & F.col("word").isin(*function_words()))
    return found.select("artifact_id", F.lit("text.function_words.en.lexeme_distribution").alias("feature_id"), F.col("word").alias("key"), "n")


def sample_scalars(artifacts: DataFrame) -> DataFrame:
    return artifacts.select("artifact_id", F.octet_length("text").cast("bigint").alias("byte_count"), F.length("text").cast("bigint").alias("character_count"))


def token_offsets(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, ordinal, token, start, end) of every token in code points, end exclusive: the sums of what stands before it."""
    pattern = f"{U.WORD}|{U.NUMBER}"
    pieces = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), T.tokens(F.col("text")).alias("token"))
    rows = keyed(artifacts).select("artifact_id", F.posexplode(pieces).alias("ordinal", "piece")).select("artifact_id", "ordinal", F.col("piece.gap").alias("gap"), F.col("piece.token").alias("token"))
    end = F.sum(F.length("gap") + F.coalesce(F.length("token"), F.lit(0))).over(Window.partitionBy("artifact_id").orderBy("ordinal")).cast("int")
    return rows.withColumn("end", end).filter("token is not null").select("artifact_id", "ordinal", "token", (F.col("end") - F.length("token")).alias("start"), "end")
