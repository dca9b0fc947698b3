"""The observation table: one row per artifact and registered feature, with a status.

Counts are ok at zero; a distribution, histogram or ratio of nothing has insufficient_support. English features of an
artifact without a language are unavailable, of another language not_applicable. A feature that is switched off is
disabled before any other rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.operators import code, python_code, text
from quillframe.plans.registry import FEATURES
from quillframe.plans.tables import spread, written

SCHEMA = {
    "int_value": "bigint", "numerator": "bigint", "denominator": "bigint", "scalar": "double", "cat": "map<string,bigint>", "hist": "map<int,bigint>",
    "summary": "struct<n:bigint,minimum:double,q25:double,median:double,q75:double,maximum:double,mean:double,sample_sd:double>", "support_count": "bigint",
}
STATUSES = ("ok", "insufficient_support", "not_applicable", "unavailable", "parser_error", "disabled")


def _pieces(df: DataFrame, **given: Column) -> DataFrame:
    return df.select("artifact_id", "feature_id", *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in SCHEMA.items()])


def from_events(events: DataFrame) -> DataFrame:
    """Counted events (artifact_id, feature_id, key, n) as distributions and histograms."""
    hist = [f.feature_id for f in FEATURES.values() if f.geometry == "hist"]
    grouped = events.groupBy("artifact_id", "feature_id").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("cat"))
    is_hist = F.col("feature_id").isin(hist)
    as_hist = F.transform_keys("cat", lambda k, _: F.try_to_number(k, F.lit("999999")).cast("int"))
    return _pieces(grouped, cat=F.when(~is_hist, F.col("cat")), hist=F.when(is_hist, as_hist), support_count=F.col("total"))


def from_scalars(wide: DataFrame, features: dict[str, dict[str, Column]]) -> DataFrame:
    """A row per feature from one wide row per artifact."""
    fields = {c: t for c, t in SCHEMA.items() if c not in ("cat", "hist")}
    rows = [F.struct(F.lit(name).alias("feature_id"), *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in fields.items()]) for name, given in features.items()]
    flat = wide.select("artifact_id", F.inline(F.array(*rows)))
    return _pieces(flat, **{c: F.col(c) for c in fields})


def _count(value: str, support: Column | None = None) -> dict[str, Column]:
    return {"int_value": F.col(value), "scalar": F.col(value), "support_count": F.lit(1) if support is None else support}


def _ratio(part: str, whole: str) -> dict[str, Column]:
    return {"numerator": F.col(part), "denominator": F.col(whole), "scalar": F.try_divide(part, whole), "support_count": F.col(whole)}


def text_pieces(artifacts: DataFrame) -> DataFrame:
    words = F.col("word_count")
    lexical = {
        "text.lexical.word_count": _count("word_count"), "text.lexical.number_count": _count("number_count"),
        "text.lexical.type_count_casefold": _count("type_count", words), "text.lexical.ttr_casefold": _ratio("type_count", "word_count"),
        "text.lexical.hapax_type_count_casefold": _count("hapax_count", words), "text.lexical.hapax_token_share_casefold": _ratio("hapax_count", "word_count"),
        "text.lexical.word_entropy_bits_casefold": {"scalar": F.col("entropy_bits"), "support_count": words}, "text.lexical.word_simpson_concentration_casefold": {"scalar": F.col("simpson"), "support_count": words},
    }
    plain = {
        "text.sample.byte_count": _count("byte_count"), "text.sample.character_count": _count("character_count"), "text.structure.sentence_count": _count("sentence_count"), "text.structure.paragraph_count": _count("paragraph_count"),
    }
    types = written(text.token_types(artifacts), "types")
    scalars = text.type_scalars(types)
    parts = text.structured(text.tokenized(artifacts))
    lists = F.concat(text.surface_event_list(), text.token_event_list(), text.structure_event_list())
    sizes = F.struct(F.octet_length("text").cast("bigint").alias("byte_count"), F.length("text").cast("bigint").alias("character_count"), F.size("paragraphs").cast("bigint").alias("paragraph_count"), F.size(F.flatten("sentences")).cast("bigint").alias("sentence_count"))
    read = written(spread(parts).select("artifact_id", lists.alias("events"), sizes.alias("sizes")), "text-events")
    windows = text.window_ttr(artifacts)
    summary = windows.select("artifact_id", F.lit("text.lexical.window_ttr_100").alias("feature_id"), F.struct(*[c for c in windows.columns if c != "artifact_id"]).alias("summary"), F.col("n").alias("support_count"))
    events = [read.select("artifact_id", F.inline("events")), text.category_events(artifacts), text.matched_events(types)]
    pieces = [
        from_events(reduce(DataFrame.unionByName, events)),
        from_scalars(scalars, lexical),
        from_scalars(read.select("artifact_id", "sizes.*"), plain),
        from_scalars(scalars.filter("language = 'en'"), {"text.function_words.en.token_share": _ratio("matched", "word_count")}),
        _pieces(summary, summary=F.col("summary"), support_count=F.col("support_count")),
    ]
    return reduce(DataFrame.unionByName, pieces)


def code_pieces(artifacts: DataFrame) -> DataFrame:
    scalars = {
        "code.sample.byte_count": _count("byte_count"), "code.sample.character_count": _count("character_count"), "code.sample.physical_line_count": _count("line_count"),
        "code.surface.blank_line_share": _ratio("blank_lines", "line_count"), "code.surface.trailing_space_line_share": _ratio("trailing_lines", "line_count"),
    }
    events = code.line_events(artifacts).unionByName(code.blank_runs(artifacts))
    return from_scalars(code.line_scalars(artifacts), scalars).unionByName(from_events(events))


def python_pieces(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Python features of artifacts(artifact_id, text, raw), and their parse states; the facts are written once."""
    found = written(python_code.facts(artifacts), "python-facts")
    wide = python_code.scalars(artifacts, found).filter("parse_status not in ('decode_error', 'token_error')")
    parsed = wide.filter("parse_status = 'ok'")
    tokens = {"code.python.comments.comment_count": _count("comment_count", F.col("comment_count")), "code.python.comments.comment_line_share": _ratio("comment_lines", "line_count")}
    tree = {
        "code.python.structure.function_count": _count("function_count"), "code.python.structure.class_count": _count("class_count"),
        "code.python.structure.nonterminal_return_function_share": _ratio("early_functions", "function_count"), "code.python.structure.import_alias_share": _ratio("renamed", "aliases"),
    }
    states = found.filter("fact = 'status'").select("artifact_id", F.col("key").alias("parse_status"))
    return from_events(python_code.events(found)).unionByName(from_scalars(wide, tokens)).unionByName(from_scalars(parsed, tree)), states


#: Features that need a Python source's tokens only; the other Python features need its tree.
TOKEN_FEATURES = ("code.python.lexical.", "code.python.naming.identifier_", "code.python.comments.comment_", "code.toolchain.")


def parse_status(feature: Column, state: Column) -> Column:
    """What a failed parse makes of a Python feature: null if nothing."""
    python = feature.startswith("code.python.") | feature.startswith("code.toolchain.")
    tokens = reduce(lambda a, b: a | b, [feature.startswith(p) for p in TOKEN_FEATURES])
    return F.when(python & state.isin("decode_error", "token_error"), "parser_error").when(python & ~tokens & (state == "ast_error"), "parser_error").when(python & ~tokens & (state == "ast_limited"), "unavailable")


def observed(artifacts: DataFrame, pieces: DataFrame, prefixes: tuple[str, ...], disabled: tuple[str, ...] = (), states: DataFrame | None = None) -> DataFrame:
    """Statuses for every artifact and every feature under the prefixes, with the values found; states(artifact_id, parse_status) of Python sources.

    The features of an artifact are a literal of at most 90 entries, so that no table is crossed; values and statuses
    meet in one grouping. No grammar and no linguistic model is at hand, so that their features are unavailable.
    """
    chosen = [f for f in FEATURES.values() if f.feature_id.startswith(prefixes)]
    names = F.array(*[F.struct(F.lit(f.feature_id).alias("feature_id"), F.lit(f.family).alias("family"), F.lit(f.geometry).alias("geometry"), F.lit(f.support_kind).alias("support_kind")) for f in chosen])
    own = artifacts.select("artifact_id", "language", F.lit(None).cast("string").alias("parse_status")) if states is None else artifacts.select("artifact_id", "language").join(states, "artifact_id", "left")
    frame = own.select("artifact_id", "language", "parse_status", F.inline(names))
    empty = {c: F.lit(None).cast(t) for c, t in SCHEMA.items()}
    marked = pieces.withColumns({c: F.lit(None).cast("string") for c in ("language", "parse_status", "family", "geometry", "support_kind")})
    both = frame.withColumns(empty).unionByName(marked)
    fields = ["language", "parse_status", "family", "geometry", "support_kind", *SCHEMA]
    rows = both.groupBy("artifact_id", "feature_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in fields]).filter("family is not null")
    found = F.col("scalar").isNotNull() | F.col("cat").isNotNull() | F.col("hist").isNotNull() | F.col("summary").isNotNull()
    feature, failed = F.col("feature_id"), parse_status(F.col("feature_id"), F.col("parse_status"))
    english = feature.startswith("text.function_words.en.")
    status = (
        F.when(F.lit(False) if not disabled else reduce(lambda a, b: a | b, [feature.startswith(d) for d in disabled]), "disabled")
        .when(english & (F.coalesce("language", F.lit("und")) == "und"), "unavailable")
        .when(english & (F.col("language") != "en"), "not_applicable")
        .when(feature.startswith("code.parser.") | feature.startswith("text.linguistic."), "unavailable")
        .when(failed.isNotNull(), failed)
        .when(found, "ok")
        .otherwise("insufficient_support")
    )
    out = rows.withColumn("status", status)
    return out.select("artifact_id", "feature_id", "family", "geometry", "status", *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in SCHEMA], "support_kind")


TEXT_FAMILIES = ("text.sample.", "text.surface.", "text.lexical.", "text.structure.", "text.function_words.")


def fingerprints(artifacts: DataFrame, disabled: tuple[str, ...] = (), linguistic: bool = False) -> DataFrame:
    """Observations of text artifacts (artifact_id, text, language); linguistic features only if asked for."""
    return observed(artifacts, text_pieces(artifacts), (*TEXT_FAMILIES, *(("text.linguistic.",) if linguistic else ())), disabled)


def code_fingerprints(artifacts: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Surface observations of code artifacts of any language, and the rows of the grammars' features."""
    return observed(artifacts, code_pieces(artifacts), ("code.sample.", "code.surface.", "code.parser."), disabled)


def python_fingerprints(artifacts: DataFrame, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Surface and Python observations of Python artifacts (artifact_id, text, raw, language)."""
    pieces, states = python_pieces(artifacts)
    return observed(artifacts, code_pieces(artifacts).unionByName(pieces), ("code.sample.", "code.surface.", "code.python.", "code.toolchain."), disabled, states)
