"""Personal data: a semi-Markov conditional random field scores whole candidate spans and decodes them jointly.

A region is a stretch of a text that may hold an entity (digits with their separators, or an obfuscated address). Its
tokens are digit runs, letter runs, masks of signs and single signs. A segment is up to MAX_SEGMENT tokens (MASKED_SEGMENT in an obfuscated
address, the most that one can have); its features are of the whole span (full match of a kind's form, checksum or
range, numbers of digits and of their groups, separators, edges, digits that go on before or after, a cue word before, for a kind
or against all). Training is by the exact likelihood
over all segmentations on examples written from templates below, with forward-backward sums; decoding is the best
segmentation with kinds, over all segments. Both are bounded, so that the time is linear in the text.

Base spans come from the four fixed expressions and always stay; decoded segments that meet no base span are added.
Spans are (kind, start, end) in code points, end exclusive. Nulls and edge cases: a null or empty text has no spans;
repeated rows are scanned each and alike; segments of equal scores go to the kind listed first; of an empty table comes an empty
table. Only doc_id and text are read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._base import small_batches

KINDS = ("email", "ip", "card", "phone")
RANK = {k: i for i, k in enumerate(KINDS)}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The look-behind changes no match: a run of digits that fails at its start fails everywhere. It keeps the time linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """The card checksum."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    at, over = text.find("@"), 0
    while at >= 0:
        start = at
        while start > over and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            over = m.end()
            yield "email", start, over
        at = text.find("@", at + 1)


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The fixed expressions' spans, by kind and start."""
    if not text:
        return []
    out = list(_emails(text)) if "@" in text else []
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# ---- the random field

MAX_SEGMENT, MAX_CHARS = 24, 64
#: The most tokens and characters of a masked address: 64 and 6 x 63 characters, an "at" and five "dot".
MASKED_SEGMENT, MASKED_CHARS = 466, 483
MARK = re.compile(r"[(\[](?:at|dot)[)\]]", re.IGNORECASE | re.ASCII)
TOKENS = re.compile(r"[(\[](?i:at|dot)[)\]]|[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)
REGION = re.compile(r"[+(]?[0-9][0-9().+\x20/_-]{6,}")
MASKED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?[(\[](?i:at)[)\]]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?)[A-Za-z0-9-]{1,63}){1,5}")
#: What goes on after a span.
GOES_ON = re.compile(r"[\w-]|\.[A-Za-z0-9]|\x20?[(\[](?i:at|dot)[)\]]")
BEFORE, AFTER = re.compile(r"[0-9][\x20./_-]\Z"), re.compile(r"[\x20./_-]?[0-9]")
AGAINST = ("iban", "order", "part", "item", "ref", "serial", "invoice", "sku", "version", "isbn")
CUE = {"email": ("mail", "contact"), "ip": ("ip", "host", "server"), "card": ("card", "visa", "pay"), "phone": ("tel", "phone", "call", "fax", "mobile")}
FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+\x20?(?:@|[(\[](?i:at)[)\]])\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?[(\[](?i:dot)[)\]]\x20?)[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{4}(?:([\x20./_-])[0-9]{4}){3}"),
    "phone": re.compile(r"\([0-9]{3}\)\x20?[0-9]{3}[-.\x20][0-9]{4}|[0-9]{3}([-.])[0-9]{3}\1[0-9]{4}|00[1-9][0-9]{0,2}(?:[-\x20][0-9]{2,4}){2,4}"),
}
ONES = str.maketrans("023456789", "111111111")
RUNS = re.compile(r"[0-9]+")
N_FEATURES = 67


def shaped(s: str) -> str:
    """A span with all digits made 1, but for the zeros it begins with (two at most)."""
    zeros = 2 if s.startswith("00") else s.startswith("0")
    return s[:zeros] + s[zeros:].translate(ONES)


@lru_cache(maxsize=1 << 16)
def _form(shape: str) -> tuple[tuple[int, ...], tuple[bool, ...], int]:
    """Of a shape: its features common to all kinds, the kinds whose form it matches in full, its number of digits."""
    runs = [len(r) for r in RUNS.findall(shape)]
    n, signs = sum(runs), set(shape) - set("01()")
    on = [0, 1 + min(n, 20), 22 + min(len(runs), 6), 29 + min(runs[0] if runs else 0, 8), 38 + min(runs[-1] if runs else 0, 8)]
    flags = ("/" in shape, "  " in shape, len(shape) > 24, any(c.isalpha() for c in signs), "+" in shape, "(" in shape, shape.startswith("0"), shape.startswith("00"), len(signs) > 1, not signs)
    return (*on, *(47 + i for i, f in enumerate(flags) if f)), tuple(FORMS[k].fullmatch(shape) is not None for k in KINDS), n


def left_of(text: str, start: int) -> tuple[bool, ...]:
    """Whether a span may begin here, whether a cue of each kind comes before, one against all, and whether digits do."""
    before = text[max(0, start - 16) : start].lower()
    cues = (*(any(c in before for c in CUE[k]) for k in KINDS), any(c in before for c in AGAINST))
    return (not (before[-1:].isalnum() or before[-1:] in "+.-_" and bool(before[-1:])), *cues, BEFORE.search(before) is not None)


def right_of(text: str, end: int) -> tuple[bool, bool]:
    """Whether a span may end here, and whether digits follow."""
    return GOES_ON.match(text, end) is None, AFTER.match(text, end) is not None


def features(text: str, start: int, end: int, left: tuple[bool, ...], right: tuple[bool, bool]) -> tuple:
    """Whole-span features, as a key that many spans share; see vector()."""
    s = text[start:end]
    on, full, n = _form(shaped(s))
    sums = 12 < n < 20 and luhn(digits_of(s))
    in_range = full[1] and all(int(p) <= 255 for p in s.split("."))
    return on, full, sums, in_range, left, right


def vector(key: tuple) -> np.ndarray:
    """The features of a key, for all kinds: (kind, feature)."""
    on, full, sums, in_range, left, right = key
    out = np.zeros((len(KINDS), N_FEATURES))
    out[:, list(on)] = 1
    out[:, 57], out[:, 58] = left[0], right[0]
    out[:, 64], out[:, 65], out[:, 66] = left[5], left[6], right[1]
    for k, kind in enumerate(KINDS):
        holds = full[k] and (sums if kind == "card" else in_range if kind == "ip" else True)
        out[k, 59:64] = full[k], holds, left[1 + k], full[k] and not holds, kind == "card" and sums
    return out


def keys_of(text: str, edges: list[int], pairs: list[tuple[int, int]]) -> Iterator[tuple]:
    """The keys of candidate segments, which come by their beginnings."""
    last, left, right = -1, (), {}
    for i, j in pairs:
        if i != last:
            last, left = i, left_of(text, edges[i])
            right = {k: v for k, v in right.items() if k > i}
        if j not in right:
            right[j] = right_of(text, edges[j])
        yield features(text, edges[i], edges[j], left, right[j])


def segments(text: str, start: int, end: int, tokens: int = MAX_SEGMENT, chars: int = MAX_CHARS) -> tuple[list[int], list[tuple[int, int]]]:
    """Token edges of a region, and the candidate segments as pairs of token positions."""
    edges = [start, *(m.end() for m in TOKENS.finditer(text, start, end))]
    out = []
    for i in range(len(edges) - 1):
        first = text[edges[i]]
        if not (first.isalnum() or first in "(+"):
            continue
        for j in range(i + 1, min(i + tokens, len(edges) - 1) + 1):
            if edges[j] - edges[i] > chars:
                break
            if text[edges[j] - 1].isalnum():
                out.append((i, j))
    return edges, out


def best(scores: np.ndarray, pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """The best segmentation: (from, to, kind) of its entities; a token outside scores 0."""
    top, back = np.full(n + 1, -np.inf), [None] * (n + 1)
    top[0] = 0
    ending: dict[int, list[int]] = {}
    for k, (_, j) in enumerate(pairs):
        ending.setdefault(j, []).append(k)
    for j in range(1, n + 1):
        top[j] = top[j - 1]
        for k in ending.get(j, ()):
            kind = int(scores[k].argmax())
            if (value := top[pairs[k][0]] + scores[k, kind]) > top[j]:
                top[j], back[j] = value, (pairs[k][0], kind)
    out, j = [], n
    while j:
        if back[j] is None:
            j -= 1
        else:
            out.append((back[j][0], j, back[j][1]))
            j = back[j][0]
    return out[::-1]


def _examples(count: int, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Texts from templates with their entities: written forms that the base expressions miss, and look-alikes."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghiklmnoprstuw") for _ in range(r.randint(3, 8)))

    def card(right: bool = True) -> str:
        sizes = r.choice([(4, 4, 4, 4), (4, 6, 5)])
        body = r.choice("3456") + num(sum(sizes) - 2)
        full, sign = body + r.choice([d for d in "0123456789" if luhn(body + d) == right]), r.choice("./_ -")
        return sign.join(full[sum(sizes[:i]) : sum(sizes[: i + 1])] for i in range(len(sizes)))

    def email() -> str:
        name = r.choice([lambda: f"{word()}.{num(2)}", word, lambda: f"{word()}.{word()}", lambda: f"{word()}.{word()}-{word()}", lambda: f"{word()}_{num(3)}"])()
        at, dot = r.choice([" (at) ", "(at)", " [at] ", " (AT) ", "[AT]"]), r.choice([".", " (dot) ", "[dot]", " [DOT] "])
        return name + at + r.choice([word, lambda: f"{word()}.{word()}", lambda: f"{word()}-{word()}{dot}{word()}"])() + dot + r.choice(["com", "org", f"co{dot}uk"])

    makers = {
        "email": email,
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": card,
        "phone": lambda: r.choice([
            lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"0049 {num(3)} {num(3)} {num(4)}", lambda: f"{num(3)} {num(3)} {num(4)}",
            lambda: f"1 {num(3)} {num(7)}", lambda: f"1{r.choice('- ')}{num(3)}-{num(3)}-{num(4)}", lambda: f"0{r.choice('23456789')}{num(1)}/{num(7)}", lambda: f"0{num(3)}/{num(7)}", lambda: num(10),
        ])(),
    }
    others = [
        lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: f"{num(1)}.{num(2)}.{num(1)}", lambda: num(12), lambda: f"{num(3)} {num(3)} {num(3)}",
        lambda: ".".join(r.choice(["999", "300", "512"]) for _ in range(4)), lambda: card(False), lambda: f"{num(3)}.{num(3)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(5)}-{num(7)}",
        lambda: f"DE{num(2)} " + " ".join(num(4) for _ in range(4)) + f" {num(2)}", lambda: f"GB{num(2)} " + "".join(r.choice("ABCDEFGH") for _ in range(4)) + "".join(f" {num(4)}" for _ in range(3)) + f" {num(2)}",
        lambda: num(10), lambda: num(r.randint(1, 9)), lambda: num(r.randint(11, 20)), lambda: f"{num(1)} {num(3)} {num(3)} {num(3)}", lambda: f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"{num(4)}-{num(2)}-{num(2)} {num(2)}",
        lambda: f"{num(3)}-{num(2)}-{num(4)}", lambda: f"{num(4)}/{num(4)}", lambda: f"{num(4)} {num(4)}", lambda: " ".join(num(r.randint(1, 5)) for _ in range(r.randint(2, 6))), lambda: ".".join(num(r.randint(1, 4)) for _ in range(r.randint(2, 5))),
    ]
    cues = {"email": ["mail", "contact"], "ip": ["ip", "host"], "card": ["card", "visa"], "phone": ["tel", "phone", "call", "fax"]}
    for _ in range(count):
        text, gold = "", []
        for _ in range(r.randint(1, 3)):
            kind = r.choice(KINDS) if r.random() < 0.5 else None
            like = not kind and r.random() < 0.3
            s = makers[kind]() if kind else makers[r.choice(("phone", "phone", "card"))]() if like else r.choice(others)()
            # ten bare digits are a phone after a cue only, and nothing is one after a word against it
            if kind and (s.isdigit() or r.random() < 0.5):
                lead = r.choice(cues[kind]) + r.choice(["", ":"])
            elif like:
                lead = r.choice(AGAINST) + r.choice(["", ":", " no"])
            else:
                lead = r.choice([word(), word() + ","] if kind else [word(), word() + ",", "id", "born", "sum", r.choice(AGAINST)])
            text += lead + " "
            if kind:
                gold.append((len(text), len(text) + len(s), kind))
            text += s + r.choice([" ", ". ", ", "]) + word() + " "
        yield text, gold


def expected(scores: np.ndarray, pairs: list[tuple[int, int]], n: int) -> tuple[float, np.ndarray]:
    """Log sum over all segmentations of n tokens, and each segment's and kind's probability under them, by forward and backward sums."""
    whole = np.logaddexp.reduce(scores, axis=1)
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0
    by_end, by_start = {}, {}
    for k, (i, j) in enumerate(pairs):
        by_end.setdefault(j, []).append(k)
        by_start.setdefault(i, []).append(k)
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[pairs[k][0]] + whole[k] for k in by_end.get(j, ()))])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[pairs[k][1]] + whole[k] for k in by_start.get(i, ()))])
    start, stop = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    return float(ahead[n]), np.exp(ahead[start] + behind[stop] - ahead[n])[:, None] * np.exp(scores)


@lru_cache(maxsize=1)
def fitted(count: int = 900, epochs: int = 4, rate: float = 0.15, decay: float = 1e-3) -> np.ndarray:
    """Weights (kind, feature) by gradient steps on the likelihood of whole segmentations."""
    rows, known = [], {}
    for text, gold in _examples(count):
        edges, pairs = segments(text, 0, len(text), 32, 96)
        place = {e: i for i, e in enumerate(edges)}
        x = np.array([known.setdefault(k, len(known)) for k in keys_of(text, edges, pairs)])
        truth = np.zeros((len(pairs), len(KINDS)))
        spans = {(place.get(a), place.get(b)): RANK[k] for a, b, k in gold}
        for n, p in enumerate(pairs):
            if p in spans:
                truth[n, spans[p]] = 1
        rows.append((x, pairs, len(edges) - 1, truth))
    vectors = np.array([vector(k) for k in known], dtype=np.float32)
    w = np.zeros((len(KINDS), N_FEATURES))
    for _ in range(epochs):
        for x, pairs, n, truth in rows:
            if pairs:
                x = vectors[x]
                _, likely = expected(np.einsum("nkf,kf->nk", x, w), pairs, n)
                w += rate * (np.einsum("nk,nkf->kf", truth - likely, x) - decay * w)
    return w


def finder(weights: np.ndarray) -> Callable[[str | None], tuple[list, list]]:
    """A function from a text to its base spans and its added spans."""

    known: dict[tuple, np.ndarray] = {}

    def score(key: tuple) -> np.ndarray:
        if key not in known:
            if len(known) > 200_000:
                known.clear()
            known[key] = (vector(key) * weights).sum(axis=1)
        return known[key]

    def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        base = base_spans(text)
        if not text:
            return base, []
        regions = [(*m.span(), MAX_SEGMENT, MAX_CHARS) for m in REGION.finditer(text)] if DIGIT.search(text) else []
        if MARK.search(text):
            regions = [(*m.span(), MASKED_SEGMENT, MASKED_CHARS) for m in MASKED.finditer(text)] + regions
        added: list[tuple[str, int, int]] = []
        if not regions:
            return base, added
        taken = bytearray(len(text))
        for _, s, e in base:
            taken[s:e] = b"\1" * (e - s)
        for a, b, tokens, chars in regions:
            edges, pairs = segments(text, a, b, tokens, chars)
            if not pairs:
                continue
            scores = np.array([score(k) for k in keys_of(text, edges, pairs)])
            for i, j, kind in best(scores, pairs, len(edges) - 1):
                s, e = edges[i], edges[j]
                if taken.find(1, s, e) < 0:
                    added.append((KINDS[kind], s, e))
                    taken[s:e] = b"\1" * (e - s)
        return base, added

    return spans


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) to (doc_id, base, added), arrays of (kind, start, end), a row for each row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(fitted())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = ("kind", "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = finder(sent.value)
        for batch in batches:
            found = [spans(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
            both = [pa.array([[dict(zip(names, s)) for s in f[i]] for f in found], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *both], ["doc_id", "base", "added"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, base {span}, added {span}")


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what scan() found."""
    rank = lambda s: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    line = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, rank)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.concat("base", "added")).alias("spans"))
