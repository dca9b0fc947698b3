"""Near-duplicate vectors by spherical-cap filters: list decoding of random product codes, join on filters, verification.

A filter is a direction, and holds all vectors whose product with it exceeds the cap's height, the same for all filters.
The directions are product codes: each of CODES random rotations cuts the space into two parts with a code of random unit
vectors each, and every pair of code words is a direction. List decoding finds all directions that a vector exceeds
without trying them all: a word of one part stays if the best of the other part could still lift the sum over the height.
Several small codes instead of one large one make the lists' lengths more even (measured in 64 dimensions at cosine 0.9:
lists of 17 in the mean for 4,000 filters instead of 60). A vector that exceeds fewer than LEAST directions is decoded again
below its own lower cap.

The height is the largest at which TARGET of sampled pairs at exactly the threshold share a filter. The number of filters
grows with the number of vectors; the cheapest is taken, counted in rows dealt out and comparisons. Where lists would be longer
than LONGEST (short vectors, low thresholds), all vectors share one filter, so that all are compared.

Filters are joined in two passes. The first deals out (filter, vector) with a sketch of SKETCH sign bits and the vector's lower
filters; it drops pairs whose sketches differ more than any linked pair's would (but for six deviations), and pairs that share a lower filter, so that
each pair is compared once, and keeps the rows that still have a pair. The second joins the vectors to those rows and compares the
pairs exactly, in double precision. What leaves a filter is each vector's number of links and the least vector linked to it there,
never pairs. Equal vectors are compared once and counted by their number. A filter above SPLIT vectors is split into
blocks, each pair of blocks being a group of bounded size of its own.

Nulls and edge cases: vectors that are null, empty, zero, or hold null or non-finite components, link with nothing, and
neither do vectors of different lengths. Repeated rows and equal vectors link with each other. A null vec_id is never
a component's least id. Vectors whose cosine is the threshold itself link. Of an empty table comes an empty table. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._base import discard, lookup, roots_of, small_batches, sorted_groups, written
from quillframe.operators.graph import components

THRESHOLD = 0.9
#: Share of sampled pairs at the threshold that must meet in a filter, and the number of them.
TARGET, SAMPLE_PAIRS = 0.999, 1000
#: Rotations; the shortest list that isn't decoded again; the longest mean list.
CODES, LEAST, LONGEST = 32, 4, 128
SPLIT = 1024
#: Comparisons that cost as much as one more row dealt out.
ROW_COST = 256
#: Sign bits of a sketch.
SKETCH = 256
#: Code words tried for each part of a code.
SIZES = (4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 512, 1024, 2048, 4096)
#: Pairs looked at together, and sums of two code words.
PAIRS, SUMS = 20_000, 1 << 20


def turned(dim: int, seed: int) -> np.ndarray:
    """A random rotation."""
    return np.linalg.qr(np.random.default_rng([dim, seed]).normal(size=(dim, dim)))[0]


class Codes:
    """The product codes for vectors of one length."""

    def __init__(self, dim: int, size: int) -> None:
        r, self.size = np.random.default_rng([dim, size]), size
        self.cuts = np.array_split(np.arange(dim), min(2, dim // 2)) if size else []
        self.turns = [turned(dim, c) for c in range(CODES)] if self.cuts else []
        self.words = []
        for _ in self.turns:
            own = [r.normal(size=(size, len(cut))) for cut in self.cuts]
            self.words.append([w / np.linalg.norm(w, axis=1)[:, None] / np.sqrt(len(self.cuts)) for w in own])

    def above(self, unit: np.ndarray, height: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(row, filter, product) of all directions that a row exceeds, SUMS of them tried at once; without codes the one filter of all.

        None as soon as there are more than most.
        """
        if not self.turns:
            return np.arange(len(unit)), np.zeros(len(unit), dtype=np.int64), np.ones(len(unit))
        out, found = [], 0
        for c, (turn, words) in enumerate(zip(self.turns, self.words)):
            at = unit @ turn
            score = [at[:, cut] @ w.T for cut, w in zip(self.cuts, words)]
            for row, name, product in self._sums(score, height):
                out.append((row, name + c * self.size ** len(self.cuts), product))
                found += len(row)
                if most is not None and found > most:
                    return None
        row, name, product = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((name, row))
        return row[order], name[order], product[order]

    def _sums(self, score: list[np.ndarray], height: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, direction, product) of one code's directions above the height, from the products with the words of each part."""
        most = [s.max(axis=1) for s in score]
        row, word = np.nonzero(score[0] >= (height - sum(most[1:]))[:, None] if len(most) > 1 else score[0] >= height)
        product, name = score[0][row, word], word.astype(np.int64)
        if len(score) == 1:
            yield row, name, product
            return
        other, second = np.nonzero(score[1] >= (height - most[0])[:, None])
        value, n = score[1][other, second], np.bincount(other, minlength=len(most[0]))
        begin, times = (np.cumsum(n) - n)[row], n[row]
        upto = np.cumsum(times)
        edges = np.searchsorted(upto, np.arange(SUMS, upto[-1], SUMS)) + 1 if len(upto) else []
        for part in np.split(np.arange(len(row)), edges):
            t = times[part]
            place = np.repeat(begin[part] - np.cumsum(t) + t, t) + np.arange(t.sum())
            total = np.repeat(product[part], t) + value[place]
            over = np.flatnonzero(total >= height)
            whose = np.repeat(part, t)[over]
            yield row[whose], name[whose] * self.size + second[place[over]], total[over]

    def lists(self, unit: np.ndarray, height: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter), by row and filter, each row with LEAST filters or more, if there are so many."""
        row, name, _ = self.above(unit, height)
        short = np.flatnonzero(np.bincount(row, minlength=len(unit)) < LEAST) if self.turns and height > -1 else []
        if not len(short):
            return row, name
        again, names = self.lists(unit[short], height - 0.05)
        keep = ~np.isin(row, short)
        row, name = np.concatenate([row[keep], short[again]]), np.concatenate([name[keep], names])
        order = np.lexsort((name, row))
        return row[order], name[order]


def pairs_at(dim: int, threshold: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors in pairs of exactly this cosine."""
    x, y = np.random.default_rng([dim, seed]).normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (y * x).sum(axis=1)[:, None] * x
    return x, threshold * x + np.sqrt(1 - threshold**2) * y / np.linalg.norm(y, axis=1)[:, None]


@lru_cache(maxsize=256)
def calibrated(dim: int, size: int, threshold: float) -> tuple[float, float] | None:
    """The largest height at which sampled pairs at the threshold meet often enough, and the lists' mean length; None if lists get too long."""
    code, (x, y) = Codes(dim, size), pairs_at(dim, threshold, SAMPLE_PAIRS, 1)
    height, allowed = min(0.95, 0.75 * np.sqrt(2 * np.log(CODES * size**2) / dim)), int(SAMPLE_PAIRS * (1 - TARGET) + 1e-9)
    while height > -1:
        most = 2 * LONGEST * SAMPLE_PAIRS
        left = code.above(x, height, most)
        right = left and code.above(y, height, most - len(left[0]))
        if right is None:
            return None
        (p, f, u), (q, g, v) = left, right
        _, a, b = np.intersect1d(p * (1 << 40) + f, q * (1 << 40) + g, assume_unique=True, return_indices=True)
        met = np.full(SAMPLE_PAIRS, -2.0)
        np.maximum.at(met, p[a], np.minimum(u[a], v[b]))
        if (met > -2).sum() >= SAMPLE_PAIRS - allowed:
            best = float(np.sort(met)[allowed])
            return best - 1e-9, float(((u >= best).sum() + (v >= best).sum()) / (2 * SAMPLE_PAIRS))
        height -= 0.015
    return None


@lru_cache(maxsize=64)
def planned(dim: int, n: int, threshold: float) -> tuple[int, float]:
    """Code size and height for n vectors: the cheapest, in rows dealt out and comparisons; (0, 0) where all share one filter."""
    best, parts = (np.inf, (0, 0.0)), min(2, dim // 2)
    for size in SIZES if parts else ():
        filters = CODES * size**parts
        if n * LEAST > 8 * SPLIT * filters and size < SIZES[-1] and parts == 2:
            continue
        found = calibrated(dim, size, threshold)
        if found:
            held = n * found[1] / filters
            cost = found[1] * max(1, held / SPLIT) + found[1] * held / 2 / ROW_COST
            if cost > 4 * best[0]:
                break
            best = min(best, (cost, (size, found[0])))
    return best[1]


def usable(embedding: Column) -> Column:
    """Vectors that may link."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(embedding.isNotNull() & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1)[:, None]
    return scaled / np.linalg.norm(scaled, axis=1)[:, None]


def sketches(unit: np.ndarray) -> np.ndarray:
    """SKETCH sign bits of each row, as 64-bit words."""
    planes = np.random.default_rng([unit.shape[1], 2]).normal(size=(unit.shape[1], SKETCH))
    return np.packbits(unit @ planes >= 0, axis=1).view(np.uint64)


def most_bits(threshold: float) -> int:
    """Bits in which the sketches of a linked pair differ at most, but for six standard deviations."""
    p = float(np.arccos(np.clip(threshold, -1, 1)) / np.pi)
    return int(np.ceil(SKETCH * p + 6 * np.sqrt(SKETCH * p * (1 - p)) + 2))


def _hashed(filters: np.ndarray) -> np.ndarray:
    """32 bits of each filter's number."""
    return ((filters.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32)


MEMBER = "f long, node long, sketch binary, lower array<int>"


def _decoder(plans: dict[int, tuple[int, float]]):
    """Rows (node, embedding) to a row for each of their filters: with the sketch and hashes of the lower filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, Codes] = {}
        for batch in batches:
            node, embedding = (batch.column(batch.schema.get_field_index(c)) for c in ("node", "embedding"))
            lengths = np.asarray(pa.compute.list_value_length(embedding))
            for dim in np.unique(lengths):
                size, height = plans[int(dim)]
                if dim not in codes:
                    codes[dim] = Codes(int(dim), size)
                at = np.flatnonzero(lengths == dim)
                unit = _unit(_matrix(embedding.take(pa.array(at))))
                row, name = codes[dim].lists(unit, height)
                n = np.bincount(row, minlength=len(at))
                order = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                begin = np.repeat(np.cumsum(n) - n, n)
                place = np.repeat(begin, order) + np.arange(order.sum()) - np.repeat(np.cumsum(order) - order, order)
                lower = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(order))).astype(np.int32)), pa.array(_hashed(name)[place]))
                bits = sketches(unit)
                raw = pa.array([b.tobytes() for b in bits], pa.binary()).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(name * 4099 + int(dim)), node.take(pa.array(at[row])), raw, lower], ["f", "node", "sketch", "lower"])

    return run


def _first_meetings(lower: pa.ListArray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs have no lower filter in common."""
    n = np.asarray(pa.compute.list_value_length(lower))
    longest = int(n.max()) if len(n) else 0
    if not longest:
        return np.ones(len(a), dtype=bool)
    table, spread = np.zeros((len(n), longest), dtype=np.int64), np.arange(longest)[None, :] < n[:, None]
    table[spread] = lower.flatten().to_numpy()
    left, right = np.where(spread, table, 1 << 40), np.where(spread, table, 1 << 41)
    step, out = max(1, PAIRS * 64 // longest**2), np.ones(len(a), dtype=bool)
    for i in range(0, len(a), step):
        x, y = left[a[i : i + step]], right[b[i : i + step]]
        out[i : i + step] = ~(x[:, :, None] == y[:, None, :]).any(axis=(1, 2))
    return out


def _open_pairs(group: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a group that are to be compared there; of two different blocks only pairs across."""
    words = np.frombuffer(b"".join(group["sketch"].to_pylist()), dtype=np.uint64).reshape(group.num_rows, -1)
    away = np.zeros((len(words), len(words)), dtype=np.uint8)
    for w in words.T:
        away += np.bitwise_count(w[:, None] ^ w[None, :])
    close = np.triu(away <= bits, 1)
    if group["bi"][0].as_py() != group["bj"][0].as_py():
        block = group["block"].to_numpy()
        close &= block[:, None] != block[None, :]
    a, b = np.nonzero(close)
    if len(a):
        first = _first_meetings(group["lower"].combine_chunks(), a, b)
        a, b = a[first], b[first]
    return a, b


def _chooser(bits: int):
    """Sorted groups without the rows that have no pair to be compared there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for group in sorted_groups(batches, ["f", "bi", "bj"]):
            if group.num_rows > 1:
                a, b = _open_pairs(group, bits)
                if len(a):
                    held.append(group.take(pa.array(np.union1d(a, b))))
            if sum(t.num_rows for t in held) > 2000:
                yield from pa.concat_tables(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return run


def _verifier(bits: int, threshold: float):
    """Sorted groups with vectors to (node, links, root) of those with links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["f", "bi", "bj"]):
            a, b = _open_pairs(group, bits)
            unit, copies, node = _unit(_matrix(group["embedding"])), group["copies"].to_numpy(), group["node"].to_numpy()
            cosine = (unit @ unit.T)[a, b] if len(a) > 4 * len(unit) else np.einsum("nd,nd->n", unit[a], unit[b])
            a, b = a[cosine >= threshold], b[cosine >= threshold]
            if len(a):
                count, root = np.bincount(a, copies[b], len(node)) + np.bincount(b, copies[a], len(node)), roots_of(len(node), a, b)
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(count[some].astype(np.int64)), pa.array(node[root[some]])], ["node", "links", "root"])

    return run


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("f", "bi", "bj").sortWithinPartitions("f", "bi", "bj", "node")


def _blocked(rows: DataFrame) -> DataFrame:
    """rows(f, node, ...) in groups (f, bi, bj), a large filter as pairs of blocks."""
    sizes = rows.groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SPLIT)
    large = written(sizes.select(F.col("f").alias("f_"), F.ceil(F.col("n") / SPLIT).cast("int").alias("blocks")), "large-filters")
    rows = rows.join(large, F.col("f") == F.col("f_"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("f", F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"), "block", "node", "sketch", "lower")


def linked(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select("vec_id", F.when(usable(F.col("embedding")), F.col("embedding")).alias("embedding"))
    same = rows.filter("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = written(same.withColumn("node", F.monotonically_increasing_id()), "vectors")
    plans = {d: planned(d, n, threshold) for d, n in nodes.groupBy(F.size("embedding")).count().collect()}
    members = written(nodes.select("node", "embedding").mapInArrow(_decoder(plans), MEMBER), "filters")
    bits, spread = most_bits(threshold), _blocked(members)
    chosen = written(_grouped(spread).mapInArrow(_chooser(bits), spread.schema), "chosen")
    full = _grouped(chosen.join(nodes.select("node", "copies", "embedding"), "node"))
    found = written(full.mapInArrow(_verifier(bits, threshold), "node long, links long, root long"), "vector-links")
    discard(members)
    discard(chosen)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = nodes.select("node", "least").join(whole, "node").groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    member = lookup(whole, least, "component", whole.count()).select("node", "component_id")
    info = nodes.select("node", "embedding", "copies", "least").join(links, "node", "left").join(member, "node", "left")
    info = written(info.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"), F.col("copies").alias("rows")), "vector-info")
    out = lookup(rows.filter("embedding is not null"), info, "embedding", vectors.count())
    out = out.unionByName(rows.filter("embedding is null"), allowMissingColumns=True)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").eqNullSafe(component)).alias("kept"))
