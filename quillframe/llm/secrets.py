"""Secret scan: Aho-Corasick keyword prefilter, anchored expressions near hits only, embedded checksums checked.

One automaton finds all keywords in one pass over the text; an expression is then tried only at a hit, anchored there.
Runs of hexadecimal digits have no keyword and are found by one linear expression. Added kinds are tokens that carry a
checksum (six base-62 digits of the CRC-32 of what precedes; extended private keys by base-58 check, four bytes of a double
SHA-256; age identities by the Bech32 polynomial) and headers of private keys; base spans stay as they are.

Spans are (kind, start, end) in code points, end exclusive. Nulls and edge cases: a null or empty text has no spans;
repeated rows are scanned each and alike; a text may be of any length, as every expression is linear in it; of an empty
table comes an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._base import small_batches

KINDS = ("assign", "access", "hex", "token", "pem", "xprv", "age")
RANK = {k: i for i, k in enumerate(KINDS)}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
XPRV = re.compile(r"[xt]prv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
AGE = re.compile(r"AGE-SECRET-KEY-1([02-9AC-HJ-NP-Z]{58})(?![0-9A-Z])")
PEM = re.compile(r"-----BEGIN (?:[A-Z]{1,12} ){0,3}PRIVATE KEY-----")
#: Lower-cased keyword: the expressions tried where it begins.
KEYWORDS = dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign") | {"akia": "access", "-----begin": "pem", "xprv": "xprv", "tprv": "xprv", "age-secret-key-1": "age"} | dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), "token")
#: The alphabets of the checksums and the generator of Bech32.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOWER = {c: c + 32 for c in range(65, 91)}


def checksum_holds(body: str) -> bool:
    """Whether the last six of 36 characters are the base-62 CRC-32 of the first thirty."""
    value, digits = zlib.crc32(body[:30].encode()), ""
    for _ in range(6):
        value, d = divmod(value, 62)
        digits = BASE62[d] + digits
    return body[30:] == digits


def base58_holds(body: str) -> bool:
    """Whether the last four of the 82 bytes written in base 58 begin the double SHA-256 of the others."""
    value = 0
    for c in body:
        value = value * 58 + BASE58.index(c)
    if value >> (8 * 82):
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_sum(prefix: str, data: str) -> int:
    """The Bech32 polynomial of a prefix and its data, 1 if the checksum at the data's end holds."""
    value = 1
    for digit in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *map(BECH32.index, data)]:
        top, value = value >> 25, (value & 0x1FFFFFF) << 5 ^ digit
        for i, g in enumerate(BECH32_GENERATOR):
            value ^= g * (top >> i & 1)
    return value


#: Of each kind: the expression anchored at a hit, and what a match must meet.
CHECKS = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6), "access": (ACCESS, lambda m: len(m[0]) >= 20), "token": (TOKEN, lambda m: checksum_holds(m[1])), "pem": (PEM, lambda m: True),
    "xprv": (XPRV, lambda m: base58_holds(m[0])), "age": (AGE, lambda m: set(m[1]) <= set(BECH32) and bech32_sum("age-secret-key-", m[1]) == 1),
}


def finder() -> Callable[[str | None], list[tuple[str, int, int]]]:
    """A function from a text to its spans, sorted by start and kind."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()

    def spans(text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):
            low = text.translate(LOWER)
        out = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
        over = dict.fromkeys(KINDS, 0)
        for start, kind in sorted({(end + 1 - n, kind) for end, (kind, n) in automaton.iter(low)}):
            if start < over[kind]:
                continue
            form, holds = CHECKS[kind]
            m = form.match(text, start)
            if not m:
                continue
            over[kind] = m.end()
            if holds(m):
                out.append((kind, m.start(), m.end()))
        return sorted(out, key=lambda s: (s[1], RANK[s[0]]))

    return spans


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, found array<struct<kind, start, end>>), a row for each row."""
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = finder()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            found = [[dict(zip(("kind", "start", "end"), s)) for s in spans(t.as_py())] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(found, kind)], ["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long>>")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digest(found: DataFrame, kinds: tuple[str, ...] = ("assign", "access", "hex")) -> DataFrame:
    """The contract's columns of what scan() found."""
    base = F.filter("found", lambda s: s["kind"].isin(*kinds))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("found", _is(k))).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))
