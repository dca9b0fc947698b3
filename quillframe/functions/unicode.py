"""Character classes and case rules as expressions for Java's regular expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The 25 White_Space code points; those that don't break lines; closing marks; sentence ends.
WHITE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WHITE_CHARACTERS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WHITE_IN_LINE = r"\x{9}\x{b}\x{c}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}"
CLOSING = r"'\")\]}\x{2019}\x{201d}\x{bb}\x{203a}\x{300d}\x{300f}\x{3011}"
TERMINAL = r"(?:[!?\x{2026}\x{3002}\x{ff01}\x{ff1f}]|\.(?!(?<=\p{Nd}\.)\p{Nd}))"

LINE_BREAK = r"\r\n|[\n\r\x{2028}\x{2029}]"
PARAGRAPH_BREAK = rf"\x{{2029}}|(?>\r\n|[\n\r\x{{2028}}])[{WHITE_IN_LINE}]*(?:\r\n|[\n\r\x{{2028}}\x{{2029}}])"
SENTENCE_BREAK = rf"((?:{TERMINAL})++[{CLOSING}]*+)(?=[{WHITE}]|\z)"
WORD = r"\p{L}[\p{L}\p{M}]*(?:['\x{2019}]\p{L}[\p{L}\p{M}]*)*"
NUMBER = r"\p{Nd}+(?:[.,_]\p{Nd}+)*"


@lru_cache(maxsize=1)
def folding() -> dict[str, str]:
    """Lower-case characters whose casefold differs."""
    every = map(chr, (*range(0xD800), *range(0xE000, 0x110000)))
    return {c: c.casefold() for c in every if c.lower() == c and c.casefold() != c}


@lru_cache(maxsize=1)
def _folding_class() -> str:
    """The characters of folding() as ranges."""
    points, out = sorted(map(ord, folding())), []
    start = last = points[0]
    for p in [*points[1:], 0x200000]:
        if p != last + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
            start = p
        last = p
    return "[" + "".join(out) + "]"


def casefold(word: Column) -> Column:
    """Full case folding of a string: lower case, then the characters that folding treats otherwise.

    Strings of one byte per character take the short way.
    """
    low = F.lower(word)
    pairs = F.create_map(*(F.lit(x) for kv in folding().items() for x in kv))
    mapped = F.array_join(F.transform(F.regexp_extract_all(low, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(pairs[c], c)), "")
    return F.when(F.octet_length(word) == F.length(word), low).when(low.rlike(_folding_class()), mapped).otherwise(low)


def categories(spark: SparkSession) -> DataFrame:
    """(char, category) of all assigned characters, by the interpreter's Unicode data; Unicode bounds its size."""
    rows = [(chr(i), c) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (c := unicodedata.category(chr(i))) not in ("Cn", "Co")]
    return spark.createDataFrame(rows, "char string, category string")
