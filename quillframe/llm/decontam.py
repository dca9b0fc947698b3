"""Benchmark decontamination: broadcast set of normalised benchmark n-grams against whole training texts.

Words are lower-cased (A-Z only) runs of digits, letters a-z and all characters from U+0080. A benchmark window is WIDTH
consecutive words of an item; an item of fewer words, but not none, is one window. Windows are looked up exactly by
their words: words outside the benchmark's vocabulary end a run, and only runs long enough are looked at. A document's
words inside an occurrence are hit.

The broadcast set holds at most MAX_WINDOWS windows. A larger benchmark is split by item into blocks of that size and
every block meets all documents in its own pass, the result of each pass being written.

Nulls and edge cases: null and empty texts have no words on either side; a null item_id counts as the item "null";
items given repeatedly count once; repeated documents are scanned each and alike; of an empty table comes an
empty table. Only doc_id, text and item_id are read, except
that clean() keeps all columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm._base import WORD_BYTES, raw_texts, small_batches, words_of, written

WIDTH = 10
MAX_WINDOWS = 1_000_000
PIECE = 1 << 20


class Windows:
    """Windows of some items: word ids, and by window length the items of each window."""

    def __init__(self, items: list[tuple[str, bytes | None]], width: int) -> None:
        self.ids: dict[bytes, int] = {}
        self.names: list[str] = []
        self.by_length: dict[int, dict[bytes, tuple[int, ...]]] = {}
        numbers: dict[str, int] = {}
        for name, raw in items:
            words = words_of(raw)
            if not words:
                continue
            if name not in numbers:
                numbers[name] = len(self.names)
                self.names.append(name)
            row = np.array([self.ids.setdefault(w, len(self.ids)) for w in words], dtype=np.int32)
            k = min(width, len(row))
            table, flat = self.by_length.setdefault(k, {}), row.tobytes()
            for i in range(len(row) - k + 1):
                key = flat[4 * i : 4 * (i + k)]
                if numbers[name] not in (had := table.get(key, ())):
                    table[key] = (*had, numbers[name])


def matcher(windows: Windows) -> Callable[[bytes | None], tuple[int, list[tuple[int, int]], list[str]]]:
    """A function from a text to its number of words, its merged hit word ranges and the items that hit it."""
    lengths = sorted(windows.by_length)

    def match(raw: bytes | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        if not raw:
            return 0, [], []
        clean, at, parts = raw.translate(WORD_BYTES), 0, []
        while at < len(clean):
            end = clean.find(b" ", at + PIECE)
            end = len(clean) if end < 0 else end
            words = clean[at:end].split()
            parts.append(np.fromiter((windows.ids.get(w, -1) for w in words), dtype=np.int32, count=len(words)))
            at = end
        ids = parts[0] if len(parts) == 1 else np.concatenate(parts)
        if not lengths:
            return len(ids), [], []
        edge = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= lengths[0]
        hits, items = [], set()
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            flat = ids[a:b].tobytes()
            for k in lengths:
                table = windows.by_length[k]
                for i in range(b - a - k + 1):
                    if found := table.get(flat[4 * i : 4 * (i + k)]):
                        hits.append((a + i, a + i + k))
                        items.update(found)
        return len(ids), merged(hits), [windows.names[i] for i in items]

    return match


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open ranges, as sorted ranges that don't touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, width: int, most: int) -> list[DataFrame]:
    """The benchmark's items in blocks of about so many windows at most."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[A-Z]+"))
    total = items.agg(F.sum(words)).first()[0] or 0
    n = -(-total // most) or 1
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)] if n > 1 else [items]


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MAX_WINDOWS) -> DataFrame:
    """docs to (doc_id, n_words, hits array<struct<start, end>> in words, items array<string>), a row for each row."""
    out = _passes(docs.select("doc_id", "text"), benchmark, width, most)
    return out.select("doc_id", "n_words", "hits", "items")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MAX_WINDOWS) -> DataFrame:
    """docs, with all columns, without the rows that hold a benchmark window."""
    for block in blocks(benchmark, width, most):
        docs = _filter(docs, _sent(docs, block, width))
    return docs


def _sent(docs: DataFrame, block: DataFrame, width: int):
    rows = block.toArrow()
    return docs.sparkSession.sparkContext.broadcast(Windows(list(zip(rows["item"].to_pylist(), rows["text"].cast(pa.binary()).to_pylist())), width))


def _filter(docs: DataFrame, sent) -> DataFrame:
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([not match(raw)[1] for raw in raw_texts(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _passes(docs: DataFrame, benchmark: DataFrame, width: int, most: int) -> DataFrame:
    small_batches(docs.sparkSession)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    todo = blocks(benchmark, width, most)
    for i, block in enumerate(todo):
        last = i == len(todo) - 1
        sent = _sent(docs, block, width)

        def run(batches: Iterator[pa.RecordBatch], first=i == 0, last=last, sent=sent) -> Iterator[pa.RecordBatch]:
            match = matcher(sent.value)
            for batch in batches:
                col = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
                found = [match(raw) for raw in raw_texts(batch)]
                hits, items = [f[1] for f in found], [sorted(f[2]) for f in found]
                if not first:
                    hits = [merged(h + [(s["start"], s["end"]) for s in was]) for h, was in zip(hits, col("hits").to_pylist())]
                    items = [sorted({*x, *was}) for x, was in zip(items, col("items").to_pylist())]
                data = [pa.array([f[0] for f in found], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in h] for h in hits], span), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([col("doc_id"), *([] if last else [col("text")]), *data], ["doc_id", *([] if last else ["text"]), "n_words", "hits", "items"])

        docs = docs.mapInArrow(run, f"doc_id long, {'' if last else 'text string, '}n_words long, hits array<struct<start:long,end:long>>, items array<string>")
        if not last:
            docs = written(docs, "decontam")
    return docs


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what scan() found."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + h["end"] - h["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def without_hits(raw: bytes, hits: list[tuple[int, int]]) -> bytes:
    """A text without its hit words; what stands between two hit words of a range goes with them."""
    if not hits:
        return raw
    edges, keep, at = [(m.start(), m.end()) for m in WORD.finditer(raw)], [], 0
    for a, b in hits:
        keep.append(raw[at : edges[a][0]])
        at = edges[b - 1][1]
    return b"".join([*keep, raw[at:]])


def cut(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = MAX_WINDOWS) -> DataFrame:
    """docs, with all columns, each text without the spans that hold benchmark windows."""
    small_batches(docs.sparkSession)
    for block in blocks(benchmark, width, most):
        sent = _sent(docs, block, width)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            match = matcher(sent.value)
            for batch in batches:
                texts = [None if raw is None else without_hits(raw, match(raw)[1]).decode() for raw in raw_texts(batch)]
                yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
