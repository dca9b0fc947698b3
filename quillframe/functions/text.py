"""Text primitives as column expressions; every one stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillframe.functions import unicode as U

def extract(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def extract_group(text: Column, pattern: str) -> Column:
    """First groups of all matches; with a look-ahead around the group the matches may overlap."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def count_of(text: Column, part: str) -> Column:
    """How often a string occurs, taken from the left without overlap: by the bytes that go with it, without a pattern."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / len(part.encode())).cast("bigint")


def tokens(text: Column) -> Column:
    """Words and numbers in order."""
    return extract(text, f"{U.WORD}|{U.NUMBER}")


def words(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: t.rlike(r"^\p{L}"))


def numbers(text: Column) -> Column:
    return F.filter(tokens(text), lambda t: t.rlike(r"^\p{Nd}"))


def trim(text: Column) -> Column:
    """text without white space at its ends; a pattern would try each white space within."""
    return F.btrim(text, F.lit(U.WHITE_CHARACTERS))


def is_blank(line: Column) -> Column:
    return ~line.rlike(f"[^{U.WHITE}]")


def lines(text: Column) -> Column:
    """Physical lines; the empty text has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, U.LINE_BREAK, -1))


def paragraphs(text: Column) -> Column:
    """Maximal runs of nonblank lines; U+2029 always ends one."""
    return F.filter(F.transform(F.split(text, U.PARAGRAPH_BREAK, -1), trim), lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    """Sentences of one paragraph, trimmed; what follows the last end is one too."""
    marked = F.split(F.regexp_replace(paragraph, U.SENTENCE_BREAK, "$1\u0000"), "\u0000", -1)
    return F.filter(F.transform(marked, trim), lambda s: s != "")


def counts(pairs: dict[str, Column]) -> Column:
    """A map of the counts that aren't zero."""
    table = F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v.cast("bigint"))))
    return F.map_filter(table, lambda _, n: n > 0)


def line_endings(text: Column) -> Column:
    both = count_of(text, "\r\n")
    found = {"lf": count_of(text, "\n") - both, "crlf": both, "cr": count_of(text, "\r") - both, "line_separator": count_of(text, "\u2028"), "paragraph_separator": count_of(text, "\u2029")}
    return counts(found)


def whitespace_classes(text: Column) -> Column:
    """White_Space code points by class; CRLF counts as two."""
    named = {"space_ascii": " ", "tab": "\t", "line_feed": "\n", "carriage_return": "\r", "line_separator": "\u2028", "paragraph_separator": "\u2029"}
    rest = r"[\x{b}\x{c}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
    return counts({k: count_of(text, c) for k, c in named.items()} | {"other_white_space": count(text, rest)})


# Marker events and the characters they count.
MARKERS = {
    "apostrophe_ascii": "'", "apostrophe_right": "\u2019", "quote_ascii": '"', "quote_left_single": "\u2018", "quote_left_double": "\u201c", "quote_right_double": "\u201d",
    "guillemet_left": "\u00ab", "guillemet_right": "\u00bb", "hyphen_minus": "-", "en_dash": "\u2013", "em_dash": "\u2014", "horizontal_ellipsis": "\u2026", "ascii_three_dots": "...",
}


def markers(text: Column) -> Column:
    """Marker events; three dots are taken from the left without overlap."""
    return counts({k: count_of(text, m) for k, m in MARKERS.items()})


# ---- names in code

CASED = r"\p{Lu}\p{Ll}\p{Lt}"


def case_style(name: Column) -> Column:
    """How a name is written; it has no style of its own if no component is left after the underscores."""
    core = F.regexp_replace(name, r"^_+|_+\z", "")
    cased, all_low, all_up = core.rlike(f"[{CASED}]"), ~core.rlike(r"[\p{Lu}\p{Lt}]"), ~core.rlike(r"[\p{Ll}\p{Lt}]")
    snake = F.when(~cased, "uncased").when(all_low, "snake_lower").when(all_up, "snake_upper").otherwise("mixed")
    return (
        F.when(name == "_", "discard")
        .when((F.length(name) > 4) & name.rlike(r"^__[A-Za-z0-9_]+__\z"), "dunder")
        .when(core == "", "other")
        .when(core.contains("_"), snake)
        .when(~cased, "uncased")
        .when(all_low, "lower")
        .when(all_up, "upper")
        .when(core.rlike(rf"^[^{CASED}]*\p{{Ll}}.*\p{{Lu}}"), "camel_lower")
        .when(core.rlike(rf"^[^{CASED}]*\p{{Lu}}.*\p{{Ll}}"), "pascal")
        .otherwise("mixed")
    )


def name_parts(name: Column) -> Column:
    """Components of a name: split at underscores, then at changes of case."""
    cut = F.regexp_replace(name, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", "_")
    return F.filter(F.split(cut, "_+", -1), lambda p: p != "")


def clean_comment(comment: Column) -> Column:
    return F.regexp_replace(comment, "^# ?", "")
