"""Sparse n-gram representations: counts and TF-IDF over a fitted vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.functions import text as T
from quillframe.plans.tables import keyed, parallelism, small_batches, written


@dataclass(frozen=True)
class Spec:
    """unit: char (substrings of the text) or word (casefolded words joined by one space)."""

    unit: str
    low: int
    high: int
    weighting: str = "count"


CHAR, WORD = Spec("char", 3, 5), Spec("word", 1, 3)
WORD_TFIDF, CHAR_TFIDF = Spec("word", 1, 3, "tfidf"), Spec("char", 3, 5, "tfidf")


#: Units (characters, words) whose n-grams are sorted at once, where one text doesn't have more.
UNITS = 1 << 18


def grams(artifacts: DataFrame, spec: Spec) -> DataFrame:
    """(artifact_id, term, n); each text's n-grams are sorted and counted where it is read, so that none is shuffled, spilled or hashed."""

    def rows(part: _Counted) -> Iterator[pa.RecordBatch]:
        for n, (doc, value, times) in part.sorted():
            yield pa.RecordBatch.from_arrays([part.ids.take(pa.array(doc)), part.terms(value, n), pa.array(times)], names=["artifact_id", "term", "n"])

    return _taken(artifacts, spec, rows, f"artifact_id {artifacts.schema['artifact_id'].dataType.simpleString()}, term string, n long")


def sizes(artifacts: DataFrame, spec: Spec) -> DataFrame:
    """(artifact_id, terms, total, most): how many terms grams() has of an artifact, their sum and the greatest; artifacts without any are left out."""

    def rows(part: _Counted) -> Iterator[pa.RecordBatch]:
        found = np.zeros((3, len(part.ids)), np.int64)
        for _, (doc, _, times) in part.sorted():
            np.add.at(found[0], doc, 1)
            np.add.at(found[1], doc, times)
            np.maximum.at(found[2], doc, times)
        has = found[0] > 0
        yield pa.RecordBatch.from_arrays([part.ids.filter(pa.array(has)), *[pa.array(x[has]) for x in found]], names=["artifact_id", "terms", "total", "most"])

    return _taken(artifacts, spec, rows, f"artifact_id {artifacts.schema['artifact_id'].dataType.simpleString()}, terms long, total long, most long")


def totals(artifacts: DataFrame, spec: Spec) -> DataFrame:
    """(term, documents, total): in how many artifacts a term is and how often; sums over many texts are shuffled, not their rows."""

    def rows(part: _Counted) -> Iterator[pa.RecordBatch]:
        for n, (_, value, times) in part.sorted():
            order = np.argsort(value, kind="stable")
            value, times = value[order], times[order]
            first = _starts(value)
            documents = np.diff(np.append(first, len(value)))
            total = np.add.reduceat(times, first) if len(first) else times
            yield pa.RecordBatch.from_arrays([part.terms(value[first], n), pa.array(documents), pa.array(total)], names=["term", "documents", "total"])

    parts = _taken(artifacts, spec, rows, "term string, documents long, total long")
    return parts.groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("total").alias("total"))


def _taken(artifacts: DataFrame, spec: Spec, rows, schema: str) -> DataFrame:
    """rows() of the n-grams of artifacts, all texts of one in the same part; the JVM finds words, workers count."""
    small_batches(artifacts.sparkSession)
    units = F.col("text") if spec.unit == "char" else T.tokens(F.col("text"))
    dealt = keyed(artifacts).select("artifact_id", F.col("text")).sortWithinPartitions("artifact_id").select("artifact_id", units.alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            for at, n in _portions(table, spec):
                yield from rows(_Counted(table.slice(at, n), spec))

    return dealt.mapInArrow(run, schema)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of sorted batches, none of which ends within an artifact."""
    held = None
    for batch in batches:
        if not len(batch):
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        codes = _codes(held)
        last = int(np.argmax(codes == codes[-1]))
        if last:
            yield held.slice(0, last).combine_chunks()
            held = held.slice(last)
    if held is not None:
        yield held.combine_chunks()


def _codes(table: pa.Table) -> np.ndarray:
    """A number for each row, the same in rows of one artifact."""
    return table.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def _portions(table: pa.Table, spec: Spec) -> Iterator[tuple[int, int]]:
    """(start, rows) of portions of about UNITS units that don't end within an artifact."""
    codes, column = _codes(table), table.column(1)
    size = np.cumsum(pc.fill_null(pc.binary_length(column) if spec.unit == "char" else pc.list_value_length(column), 0).to_numpy().astype(np.int64))
    ends = np.append(np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes))
    at, below = 0, 0
    for end in ends.tolist():
        if size[end - 1] - below >= UNITS or end == len(codes):
            yield at, end - at
            at, below = end, size[end - 1]


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where another value begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


class _Counted:
    """The n-grams of a portion of texts as numbers.

    Units are numbered within the portion; an n-gram is the number whose digits they are. Where that would be too large the numbers of shorter
    ones are replaced by their ranks, of which a table is kept.
    """

    def __init__(self, table: pa.Table, spec: Spec):
        codes, column = _codes(table), table.column(1).combine_chunks()
        first = _starts(codes)
        self.spec, self.ids = spec, table.column(0).combine_chunks().take(pa.array(first))
        doc = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(codes))))
        if spec.unit == "char":
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), pc.fill_null(column, "")), "")[0].as_py()
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            sizes_ = pc.fill_null(pc.utf8_length(column), 0).to_numpy().astype(np.int64)
            seen = np.zeros(0x110000, bool)
            seen[points] = True
            self.names = np.flatnonzero(seen).astype(np.uint32)
            unit = (np.cumsum(seen) - 1)[points]
        else:
            flat = column.flatten().dictionary_encode()
            words, sizes_ = flat.dictionary.to_pylist(), pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            folded = {w: i for i, w in enumerate(dict.fromkeys(w.casefold() for w in words if not w[0].isdecimal()))}
            self.names = pa.array(folded, pa.string())
            number = np.array([-1 if w[0].isdecimal() else folded[w.casefold()] for w in words], np.int64)
            unit = number[flat.indices.to_numpy()]
            row = np.repeat(np.arange(len(sizes_)), sizes_)[unit >= 0]
            unit, sizes_ = unit[unit >= 0], np.bincount(row, minlength=len(sizes_))
        self.unit, self.base = unit.astype(np.int64), max(1, len(self.names))
        self.doc, self.left = np.repeat(doc, sizes_), np.repeat(np.cumsum(sizes_), sizes_) - np.arange(len(unit))
        self.docs, self.ranks = max(1, len(first)), {}

    def sorted(self) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """By length: (artifact, value, times) of the distinct n-grams of each artifact."""
        value, bound = self.unit, self.base
        for n in range(1, self.spec.high + 1):
            if n > 1:
                if bound * self.base * self.docs >= 1 << 62:
                    self.ranks[n - 1], value = np.unique(value, return_inverse=True)
                    bound = len(self.ranks[n - 1])
                value, bound = value[:-1] * self.base + self.unit[n - 1 :], bound * self.base
            if n >= self.spec.low:
                fits = self.left[: len(value)] >= n
                both = np.sort(self.doc[: len(value)][fits] * bound + value[fits])
                first = _starts(both)
                yield n, (both[first] // bound, both[first] % bound, np.diff(np.append(first, len(both))))
            if not len(value):
                return

    def terms(self, value: np.ndarray, n: int) -> pa.Array:
        """The n-grams of values as strings."""
        digits = np.empty((len(value), n), np.int64)
        for k in range(n - 1, -1, -1):
            value, digits[:, k] = np.divmod(value, self.base) if k else (value, value)
            if k in self.ranks:
                value = self.ranks[k][value]
        if self.spec.unit == "word":
            return pc.binary_join_element_wise(*[self.names.take(pa.array(digits[:, k])) for k in range(n)], " ")
        points = self.names[digits] if len(self.names) else np.zeros((0, n), np.uint32)
        width = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).sum(axis=1)
        offsets = np.append(0, np.cumsum(width)).astype(np.int32)
        return pa.StringArray.from_buffers(len(points), pa.py_buffer(offsets), pa.py_buffer(points.tobytes().decode("utf-32-le").encode()))


def vocabulary(counts: DataFrame, documents: int) -> DataFrame:
    """(term, index, df, idf): terms in code-point order, idf = ln((n + 1) / (df + 1)) + 1.

    Terms are dealt out by ranges and numbered there, offset by the number of terms in the ranges before: one row of
    each range comes to the driver.
    """
    return _placed(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")), documents)


def vocabulary_of(artifacts: DataFrame, spec: Spec, documents: int) -> DataFrame:
    """vocabulary() of grams(artifacts), from sums over many texts instead of a row for each text and term."""
    return _placed(totals(artifacts, spec).select("term", F.col("documents").alias("df")), documents)


def _placed(terms: DataFrame, documents: int) -> DataFrame:
    spark = terms.sparkSession
    placed = written(terms.repartitionByRange(parallelism(spark), "term").sortWithinPartitions("term").withColumn("at", F.monotonically_increasing_id()), "terms")
    part = F.shiftright("at", 33).cast("int")
    before = _before(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1))))
    index = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("part", part).join(F.broadcast(before), "part").select("term", index.alias("index"), "df", _idf(documents).alias("idf"))


def _before(sizes_: DataFrame) -> DataFrame:
    """(part, before) of (part, size): the sizes of the parts before."""
    offsets, total = [], 0
    for p, n in sorted(map(tuple, sizes_.collect())):
        offsets.append((p, total))
        total += n
    return sizes_.sparkSession.createDataFrame(offsets, "part int, before long")


def _idf(documents: int) -> Column:
    return F.log(F.lit(documents + 1.0) / (F.col("df") + 1)) + 1


def weighted(counts: DataFrame, documents: int) -> DataFrame:
    """(artifact_id, index, raw = n idf) of counts over their own vocabulary(), rows as they come.

    Counts are dealt out once, by ranges of terms in order; there a term's rows are numbered and counted, so that no table of
    terms is made, and none is joined. What is kept is numbers.
    """
    small_batches(counts.sparkSession)
    kind = counts.schema["artifact_id"].dataType.simpleString()
    ordered = counts.select("artifact_id", "term", "n").repartitionByRange(parallelism(counts.sparkSession), "term").sortWithinPartitions("term")
    rows = written(ordered.mapInArrow(_numbered, f"artifact_id {kind}, n long, part int, at long, df long"), "numbered")
    before = _before(rows.groupBy("part").agg(F.max("at") + 1))
    return rows.join(F.broadcast(before), "part").select("artifact_id", (F.col("before") + F.col("at")).alias("index"), (F.col("n") * _idf(documents)).alias("raw"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of terms with the term's number in this part and its number of rows; the rows of one term are held until the next."""
    part, at, held, term = TaskContext.get().partitionId(), 0, [], None

    def out(table: pa.Table, index: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
        columns = {"part": pa.array(np.full(len(table), part, np.int32)), "at": pa.array(index), "df": pa.array(df)}
        for name, column in columns.items():
            table = table.append_column(name, column)
        yield from table.combine_chunks().to_batches()

    for table in _gathered(batches):
        terms = table.column("term").combine_chunks()
        new = np.append(terms[0].as_py() != term, pc.not_equal(terms[1:], terms[:-1]).to_numpy(zero_copy_only=False)).astype(bool)
        starts, table = np.flatnonzero(new), table.select(["artifact_id", "n"])
        if not len(starts):
            held.append(table)
            continue
        if held:
            whole = pa.concat_tables([*held, table.slice(0, starts[0])])
            yield from out(whole, np.full(len(whole), at), np.full(len(whole), len(whole)))
            at += 1
        times = np.diff(starts)
        if len(times):
            yield from out(table.slice(starts[0], starts[-1] - starts[0]), np.repeat(at + np.arange(len(times)), times), np.repeat(times, times))
            at += len(times)
        held, term = [table.slice(starts[-1])], terms[-1].as_py()
    if held:
        whole = pa.concat_tables(held)
        yield from out(whole, np.full(len(whole), at), np.full(len(whole), len(whole)))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15) -> Iterator[pa.Table]:
    """Batches as tables of about so many rows."""
    held, n = [], 0
    for batch in batches:
        if len(batch):
            held.append(batch)
            n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def transformed(counts: DataFrame, terms: DataFrame, spec: Spec) -> DataFrame:
    """(artifact_id, index, value): known terms only; TF-IDF rows have unit length."""
    known = counts.join(terms, "term")
    if spec.weighting == "count":
        return known.select("artifact_id", "index", F.col("n").cast("double").alias("value"))
    return normed(known.select("artifact_id", "index", (F.col("n") * F.col("idf")).alias("raw")))


def normed(raw: DataFrame) -> DataFrame:
    """(artifact_id, index, value) of (artifact_id, index, raw): rows of an artifact have unit length."""
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("artifact_id")))
    return raw.select("artifact_id", "index", (F.col("raw") / norm).alias("value"))


def vectors(sparse: DataFrame) -> DataFrame:
    """One row per artifact with its entries in index order."""
    return sparse.groupBy("artifact_id").agg(F.array_sort(F.collect_list(F.struct("index", "value"))).alias("entries"))
