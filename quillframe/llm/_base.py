"""Helpers shared by the training-data operators: words, ranks and grouped Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.plans.tables import discard, lookup, scratch, small_batches, written  # noqa: F401


def small_scans(spark: SparkSession) -> None:
    """Bounds the rows that a scan of Parquet decodes at once: 4096 long texts make arrays of tens of MB, which fill the heap."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")


#: A-Z to a-z; digits, a-z and all bytes from 0x80 stay; everything else parts words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a UTF-8 text; null has none."""
    return raw.translate(WORD_BYTES).split() if raw else []


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """The UTF-8 bytes of a string column, null as None."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that df doesn't have, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: The most bits of a bitmap that is broadcast: 16 MB.
BITMAP = 1 << 27


def screened(df: DataFrame, key: str, wanted: DataFrame, of: str) -> DataFrame:
    """df without most of the rows whose key, a 64-bit hash, isn't among wanted's, before a join that drops the rest by a shuffle.

    The bitmap has 16 bits for each key up to BITMAP in all, is put together on the executors, and is broadcast; above
    that it lets more rows pass, never fewer.
    """
    small_batches(df.sparkSession)
    bits = min(BITMAP, max(1 << 12, 1 << (16 * wanted.count()).bit_length()))
    at = wanted.select(F.col(of).bitwiseAND(F.lit(bits - 1)).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63L AS INT)))").alias("bits")).toArrow()
    bitmap = np.zeros(bits >> 6, dtype=np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sent = df.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            place = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(bits - 1)
            yield batch.filter(pa.array((table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)))

    return df.mapInArrow(run, df.schema)


def grouped_rank(df: DataFrame, keys: list[str], order: list[Column], salt: Column, out: str, bounded: bool = False) -> DataFrame:
    """df with out, the gapless rank from 0 of each row in its group.

    A group is ranked in parts (its salts), each part in one task, and the parts' sizes give the offsets, so no task
    holds a whole hot group. bounded: the groups times salts are few, so that the offsets may be broadcast.
    """
    salted = df.withColumn("__salt", salt)
    parts = [*keys, "__salt"]
    sizes = salted.groupBy(*parts).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*parts, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    ranked = salted.withColumn("__rank", F.row_number().over(Window.partitionBy(*parts).orderBy(*order)) - 1)
    if bounded:
        offsets = F.broadcast(offsets)
    return ranked.join(offsets, parts).withColumn(out, F.col("__rank") + F.col("__before")).drop("__salt", "__rank", "__before")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by integer keys; only one group is held besides the present batch."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(n, dtype=bool)
        new[0] = last is None or tuple(c[0] for c in cols) != last
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        last = tuple(c[n - 1] for c in cols)
        if not len(starts):
            held.append(batch)
            continue
        if starts[0] > 0:
            held.append(batch.slice(0, starts[0]))
        if held:
            yield pa.Table.from_batches(held)
        for a, b in zip(starts[:-1], starts[1:]):
            yield pa.Table.from_batches([batch.slice(a, b - a)])
        held = [batch.slice(starts[-1])]
    if held:
        yield pa.Table.from_batches(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a stream that is sorted by integer keys: tables of about so many rows, or of one larger group, with the groups' edges."""
    held: list[pa.Table] = []
    for group in sorted_groups(batches, keys):
        held.append(group)
        if sum(g.num_rows for g in held) >= rows:
            yield pa.concat_tables(held).combine_chunks(), np.cumsum([0, *(g.num_rows for g in held)])
            held = []
    if held:
        yield pa.concat_tables(held).combine_chunks(), np.cumsum([0, *(g.num_rows for g in held)])


def pairs_within(edges: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions (a < b) inside the groups between the edges, at most about so many at once."""
    last = np.repeat(edges[1:], np.diff(edges))
    partners = last - np.arange(len(last)) - 1
    upto, at = np.cumsum(partners), 0
    while at < len(partners):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + most, side="right")))
        n = partners[at:end]
        a = np.repeat(np.arange(at, end), n)
        if len(a):
            yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        at = end


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position connected with each of n positions by the given links."""
    parent = np.arange(n)
    while len(left):
        low = np.minimum(parent[left], parent[right])
        before = parent.copy()
        np.minimum.at(parent, left, low)
        np.minimum.at(parent, right, low)
        np.minimum.at(parent, before[left], low)
        np.minimum.at(parent, before[right], low)
        parent = parent[parent]
        if (before == parent).all():
            break
    return parent
