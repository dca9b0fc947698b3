"""N-gram Jaccard join: MinHash LSH forest for candidates, exact verification of shingle sets.

A text's shingles are its runs of SHINGLE words (a shorter text has one of all its words), as 64-bit hashes. In each of
TREES trees (more where a low threshold needs them) a text has a signature of DEPTH labels, 16 bits of a MinHash value
each. A tree is its signatures in sorted order: rows are dealt out by ranges of (tree, signature) and sorted there, and
each gets the lengths of the prefix that it shares with the row before and the row after it. Texts that share a prefix
of d labels are then a run of neighbours, and only rows in such runs are read when d is the depth at hand. Texts of equal
shingle sets are one class throughout, so that copies are never paired.

The join begins at full depth. Texts that share a whole signature in some tree are compared exactly; the similarities of
the links found so far give how many links there are by estimate, as a link of similarity s shares a prefix of d with
probability p = 1 - (1 - s^d)^trees and so stands for 1 / p (one more link, at the threshold itself, is always assumed). While the
share missed is above 1 - TARGET, the prefixes are shortened to the longest at which, by this estimate, it isn't, and what meets
there and met nowhere before is compared. At floor_depth() the target holds whatever the similarities are, so it ends there.

A pair is compared once, in the first tree in which it shares the prefix: rows of a run carry hashes of their prefixes
in all trees, at this depth and the last, and a first pass drops those that have no such pair left in the run; the others
meet with their texts. Runs above BLOCK_ROWS texts or BLOCK_BYTES bytes are split into blocks, each pair of blocks being
a task's group of its own. What leaves a group is each text's number of links and the least text linked to it there, never
pairs. The classes are the connected components of these links.

Nulls and edge cases: a null text, or one without words, has no shingles and links with nothing. Repeated rows link
like other copies. A null doc_id is never a class's least id. Of an empty table comes an empty table. Only doc_id and
text are read; kept() keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._base import WORD_BYTES, discard, free_names, lookup, pairs_within, raw_texts, roots_of, screened, small_batches, small_scans, whole_groups, written
from quillframe.operators.graph import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH = 32, 10
#: The share of all links that must be found, by the forest's own estimate.
TARGET = 0.9999
BLOCK_ROWS, BLOCK_BYTES = 2048, 8 << 20
#: Rows and pairs that a task looks at together.
ROWS, PAIRS = 1024, 50_000
#: Similarities are counted in so many bins from the threshold to 1.
BINS = 40
PIECE = 1 << 20


def n_trees(threshold: float = THRESHOLD) -> int:
    """TREES, or as many as it takes for a pair at the threshold to meet often enough by prefixes of one label."""
    if not 0 < threshold <= 1:
        raise ValueError(f"no number of trees reaches the target at the threshold {threshold}")
    return TREES if threshold == 1 else max(TREES, int(np.ceil(np.log1p(-TARGET) / np.log1p(-threshold))))


def meeting(similarity: np.ndarray | float, depth: int, trees: int) -> np.ndarray | float:
    """The probability that a pair shares a prefix of this depth in some tree."""
    return 1 - (1 - np.asarray(similarity, dtype=float) ** depth) ** trees


def floor_depth(threshold: float, trees: int) -> int:
    """The longest prefix at which even pairs at the threshold meet often enough."""
    return max(d for d in range(1, DEPTH + 1) if d == 1 or meeting(threshold, d, trees) >= TARGET)


def next_depth(counts: np.ndarray, depth: int, threshold: float, trees: int) -> int | None:
    """The prefix to go on with after links were found (counted by similarity in BINS bins) at this depth; None if the target is reached."""
    similarity = threshold + (1 - threshold) * np.arange(len(counts)) / len(counts)
    there = (counts + (np.arange(len(counts)) == 0)) / meeting(similarity, depth, trees)
    fine = lambda d: (there * (1 - meeting(similarity, d, trees))).sum() <= (1 - TARGET) * there.sum()
    floor = floor_depth(threshold, trees)
    if depth <= floor or fine(depth):
        return None
    return next((d for d in range(depth - 1, floor, -1) if fine(d)), floor)


class Shingler:
    """Texts to their sorted distinct shingle hashes; remembers frequent words."""

    def __init__(self, width: int = SHINGLE) -> None:
        self.width, self.known = width, {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > 400_000:
            self.known.clear()
        for w in set(words).difference(self.known):
            self.known[w] = int.from_bytes(blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))

    def __call__(self, raw: bytes | None) -> np.ndarray:
        if not raw:
            return np.zeros(0, dtype=np.uint64)
        clean, at, parts = raw.translate(WORD_BYTES), 0, []
        while at < len(clean):
            end = clean.find(b" ", at + PIECE)
            end = len(clean) if end < 0 else end
            parts.append(self.hashes(clean[at:end].split()))
            at = end
        h = np.concatenate(parts)
        if not len(h):
            return h
        width = min(self.width, len(h))
        mixed = np.full(len(h) - width + 1, width, dtype=np.uint64)
        for i in range(width):
            mixed = (mixed ^ h[i : len(h) - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def multipliers(trees: int, depth: int = DEPTH) -> np.ndarray:
    """Odd multipliers of the MinHash functions."""
    return np.random.default_rng(20).integers(0, 1 << 31, trees * depth, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray, odd: np.ndarray, trees: int) -> bytes:
    """The text's key in each tree, one after the other: the tree's number and the labels, two bytes each."""
    folded = ((shingles * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(odd), 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(folded), 256):
        np.minimum(least, (folded[a : a + 256, None] * odd[None, :]).min(axis=0), out=least)
    keys = np.empty((trees, 1 + len(odd) // trees), dtype=">u2")
    keys[:, 0] = np.arange(trees)
    keys[:, 1:] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).reshape(trees, -1)
    return keys.tobytes()


#: Bytes of a key.
WIDTH = 2 * (1 + DEPTH)


def signed(docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """A written row for each document: rid, doc_id, th (hash of the text), sets (key of the shingle set), n, sig (its keys)."""
    small_batches(docs.sparkSession)
    small_scans(docs.sparkSession)
    trees = n_trees(threshold)
    odd = multipliers(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            found = [shingle(raw) for raw in raw_texts(batch)]
            sets = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
            sigs = [signature(s, odd, trees) if len(s) else None for s in found]
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "th")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sets, pa.binary()), pa.array(map(len, found), pa.int32()), pa.array(sigs, pa.binary())], ["doc_id", "th", "sets", "n", "sig"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(run, "doc_id long, th long, sets binary, n int, sig binary")
    return written(rows.withColumn("rid", F.monotonically_increasing_id()), "signatures")


# ---- the forest

def common(keys: np.ndarray) -> np.ndarray:
    """The lengths of the prefixes that each key, a row of 16-bit numbers, shares with the next."""
    same = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1).sum(axis=1)
    return np.maximum(same - 1, 0).astype(np.int32)


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u2").reshape(len(column), -1)


def _neighbours(floor: int):
    """Sorted rows with the prefix lengths shared with the row before and after, where one is floor or more; at the partition's ends they are -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            after = common(_keys(rows.column(0)))
            n = rows.num_rows - 1
            ahead = np.concatenate(([before], after[:-1])).astype(np.int32)[:n]
            some = pa.array(np.flatnonzero((np.maximum(ahead, after) >= floor) | (ahead < 0)))
            yield pa.RecordBatch.from_arrays([*(c.take(some) for c in rows.columns), pa.array(ahead).take(some), pa.array(after).take(some)], [*rows.schema.names, "before", "after"])
            held, before = rows.slice(n), int(after[-1]) if n else before
        if held is not None:
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([before], pa.int32()), pa.array([-1], pa.int32())], [*held.schema.names, "before", "after"])

    return run


def forest(own: DataFrame, trees: int, floor: int) -> DataFrame:
    """own(rid, n, sig) as written trees: (key, rid, n, before, after), dealt out by ranges of (key, rid) and sorted.

    Rows that share no prefix of floor labels aren't kept. Two rows of each partition come to the driver, to compare each with
    the one across the border.
    """
    small_batches(own.sparkSession)
    cut = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: F.substring("sig", i * WIDTH + 1, F.lit(WIDTH)))
    rows = own.select(F.explode(cut).alias("key"), "rid", "n").repartitionByRange("key", "rid").sortWithinPartitions("key", "rid")
    placed = written(rows.mapInArrow(_neighbours(floor), "key binary, rid long, n int, before int, after int"), "forest")
    ends = sorted((bytes(r["key"]), r["rid"], r["before"], r["after"]) for r in placed.filter("before < 0 or after < 0").select("key", "rid", "before", "after").collect())
    fixed = [[key, rid, max(before, 0), max(after, 0)] for key, rid, before, after in ends]
    for left, right, a, b in zip(ends, ends[1:], fixed, fixed[1:]):
        if left[3] < 0 and right[2] < 0:
            a[3] = b[2] = int(common(np.frombuffer(left[0] + right[0], dtype=">u2").reshape(2, -1))[0])
    edges = own.sparkSession.createDataFrame([tuple(f) for f in fixed], "key binary, rid long, b int, a int")
    joined = placed.join(F.broadcast(edges), ["key", "rid"], "left")
    return joined.select("key", "rid", "n", F.coalesce("b", "before").alias("before"), F.coalesce("a", "after").alias("after"))


def runs(placed: DataFrame, depth: int, last: int, total: int) -> DataFrame:
    """(prefix, rid, blocks) of the rows in runs that share a prefix of this depth and don't all share one of the last depth."""
    shared = placed.filter(F.greatest("before", "after") >= depth)
    rows = shared.select(F.substring("key", 1, 2 + 2 * depth).alias("prefix"), "rid", "n", F.col("before").between(depth, last - 1).alias("fresh"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.col("n").cast("long") * 6) / BLOCK_BYTES)).cast("int")
    sizes = rows.groupBy("prefix").agg(F.bool_or("fresh").alias("fresh"), F.count(F.lit(1)).alias("rows"), blocks.alias("blocks")).filter("fresh").drop("fresh")
    return lookup(rows.select("prefix", "rid"), sizes, "prefix", total)


def _hashes(depth: int, trees: int) -> Column:
    """A hash of the prefix in each tree."""
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: F.hash(F.substring("sig", i * WIDTH + 1, F.lit(2 + 2 * depth))))


def grouped(members: DataFrame) -> DataFrame:
    """Rows in whole groups (g, bi, bj) of a task, in order."""
    return members.repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj")


def _open_pairs(table: pa.Table, edges: np.ndarray, trees: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions that meet in their group's tree for the first time."""
    marks = table["marks"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    now, then = marks[:, :trees], marks[:, trees:]
    tree, block, across = table["tree"].to_numpy(), table["block"].to_numpy(), table["bi"].to_numpy() != table["bj"].to_numpy()
    for a, b in pairs_within(edges, PAIRS):
        equal = now[a] == now[b]
        first = equal.argmax(axis=1)
        new = (first == tree[a]) & equal[np.arange(len(a)), first] & ~(across[a] & (block[a] == block[b]))
        if then.shape[1]:
            new[new] = ~(then[a[new]] == then[b[new]]).any(axis=1)
        if new.any():
            yield a[new], b[new]


def _chooser(trees: int):
    """Sorted groups without the rows that have no pair to be compared there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, ["g", "bi", "bj"], ROWS):
            wanted = np.zeros(table.num_rows, dtype=bool)
            for a, b in _open_pairs(table, edges, trees):
                wanted[a] = wanted[b] = True
            if wanted.any():
                yield from table.filter(pa.array(wanted)).to_batches()

    return run


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.float32)
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    some = times[place] > 1
    place, owner = place[some], owner[some]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    held = times[times > 1]
    starts = np.concatenate(([0], np.cumsum(held)))[:-1]
    flat = out.reshape(-1)
    for k in np.unique(held):
        if k > 24 and n > 24:
            break
        rows = owner[starts[held == k][:, None] + np.arange(k)]
        for i in range(k):
            for j in range(i + 1, k):
                np.add.at(flat, rows[:, i] * n + rows[:, j], 1)
    out += out.T
    if n > 24 and (many := np.flatnonzero(held > 24)).size:
        for a in range(0, len(many), 2048):
            part = many[a : a + 2048]
            has = np.zeros((n, len(part)), dtype=np.float32)
            for c, m in enumerate(part):
                has[owner[starts[m] : starts[m] + held[m]], c] = 1
            out += has @ has.T
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _verifier(width: int, threshold: float, trees: int):
    """Sorted groups with texts to (rid, links, root) of texts with links, and (null, number, bin) of similarities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, bins = Shingler(width), np.zeros(BINS, dtype=np.int64)
        for table, edges in whole_groups(batches, ["g", "bi", "bj"], ROWS):
            rid, copies, pairs = table["rid"].to_numpy(), table["copies"].to_numpy(), list(_open_pairs(table, edges, trees))
            if not pairs:
                continue
            known: dict[int, np.ndarray] = {}
            sets = [known[r] if r in known else known.setdefault(r, shingle(raw)) for r, raw in zip(rid.tolist(), table["text"].cast(pa.binary()).to_pylist())]
            size = np.array([len(s) for s in sets], dtype=np.float64)
            a, b = (np.concatenate(x) for x in zip(*pairs))
            both = np.zeros(len(a))
            group = np.searchsorted(edges, a, side="right")
            order = np.argsort(group, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                start, end = edges[group[at[0]] - 1], edges[group[at[0]]]
                if len(at) > 4 * (end - start):
                    both[at] = intersections(sets[start:end])[a[at] - start, b[at] - start]
                else:
                    both[at] = [overlap(sets[i], sets[j]) for i, j in zip(a[at].tolist(), b[at].tolist())]
            union = size[a] + size[b] - both
            near = both >= threshold * union - 1e-9
            a, b, both, union = a[near], b[near], both[near], union[near]
            if len(a):
                place = (both / union - threshold) / max(1 - threshold, 1e-9) * BINS
                bins += np.bincount(np.clip(place.astype(int), 0, BINS - 1), minlength=BINS)
                count = np.bincount(a, copies[b], len(rid)) + np.bincount(b, copies[a], len(rid))
                root, some = roots_of(len(rid), a, b), np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(rid[some]), pa.array(count[some].astype(np.int64)), pa.array(rid[root[some]])], ["rid", "links", "root"])
        some = np.flatnonzero(bins)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(bins[some]), pa.array(some.astype(np.int64))], ["rid", "links", "root"])

    return run


def classes(signatures: DataFrame) -> DataFrame:
    """A written row for each shingle set: sets, rep (its least rid), copies, least (by _order()), and the rep's n, sig, d (doc_id) and t (th)."""
    first = F.min_by(F.struct("n", "sig", F.col("doc_id").alias("d"), F.col("th").alias("t")), "rid")
    found = signatures.filter("sets is not null").groupBy("sets").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(_order()).alias("least"), first.alias("first"))
    return written(found.select("sets", "rep", "copies", "least", "first.*"), "sets")


def joined(docs: DataFrame, sets: DataFrame, width: int, threshold: float) -> tuple[DataFrame, list[int]]:
    """(rid, links, root), in parts, of the texts with links, and the depths that the prefixes were shortened to; sets: see classes()."""
    trees = n_trees(threshold)
    own = sets.withColumnRenamed("rep", "rid")
    floor = floor_depth(threshold, trees)
    placed = forest(own.select("rid", "n", "sig"), trees, floor)
    near = placed.filter(F.greatest("before", "after") >= floor)
    total = near.count()
    met = written(near.select("rid", F.xxhash64("rid").alias("h")).distinct(), "forest-ids")
    some = screened(own.select("rid", "copies", "sig", "d", "t", F.xxhash64("rid").alias("h")), "h", met, "h")
    info = written(some.join(met.select("rid"), "rid").select("rid", "copies", "sig", "d", "t"), "forest-texts")
    discard(met)
    wanted = written(info.select("rid", "copies", "d", "t"), "forest-ids")
    texts = screened(docs.select("doc_id", "text", F.xxhash64("text").alias("th")).filter("text is not null"), "th", wanted, "t")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    texts = written(texts.dropDuplicates(["rid"]).select("rid", "copies", "text"), "texts")
    depth, last, depths, parts = DEPTH, DEPTH + 1, [], []
    counts = np.zeros(BINS)
    while depth:
        depths.append(depth)
        marks = _hashes(depth, trees) if last > DEPTH else F.concat(_hashes(depth, trees), _hashes(last, trees))
        rows = runs(placed, depth, last, total).join(info.select("rid", marks.alias("marks")), "rid")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tree = F.conv(F.hex(F.substring("prefix", 1, 2)), 16, 10).cast("int")
        rows = rows.select(F.xxhash64("prefix").alias("g"), F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"), "block", tree.alias("tree"), "rid", "marks")
        small_batches(docs.sparkSession)
        chosen = written(grouped(rows).mapInArrow(_chooser(trees), rows.schema), "chosen")
        found = grouped(chosen.join(texts, "rid")).mapInArrow(_verifier(width, threshold, trees), "rid long, links long, root long")
        parts.append(written(found, "links"))
        discard(chosen)
        for r in parts[-1].filter("rid is null").groupBy("root").agg(F.sum("links").alias("n")).collect():
            counts[r["root"]] += r["n"]
        last, depth = depth, next_depth(counts, depth, threshold, trees)
    for table in (texts, info, wanted):
        discard(table)
    return reduce(DataFrame.unionByName, parts).filter("rid is not null"), depths


def _order() -> Column:
    """By doc_id, null last, then by text hash."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")


def linked(docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, th, class_id, n_links, kept) for each row of docs(doc_id, text).

    class_id is the least doc_id reachable by links, n_links the number of other rows linked directly, and kept marks
    one text of each class (its least doc_id, then th); repeated rows are all marked alike.
    """
    whole_rows = signed(docs, width, threshold)
    sets, signatures = classes(whole_rows), written(whole_rows.select("doc_id", "th", "sets"), "keys")
    discard(whole_rows)
    keyed = signatures.filter("sets is not null")
    found, _ = joined(docs, sets, width, threshold)
    links = found.groupBy("rid").agg(F.sum("links").alias("links")).withColumnRenamed("rid", "rep")
    whole = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    least = sets.join(whole, "rep").groupBy("component").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("rows"))
    member = lookup(whole, least, "component", whole.count()).select("rep", "first")
    merged = sets.join(links, "rep", "left").join(member, "rep", "left")
    merged = written(merged.select("sets", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("first", "least").alias("first"), F.col("copies").alias("rows")), "classes")
    discard(sets)
    out = lookup(keyed.select("doc_id", "th", "sets"), merged, "sets", signatures.count())
    out = out.unionByName(signatures.filter("sets is null").select("doc_id", "th", "sets"), allowMissingColumns=True)
    return out.select("doc_id", "th", F.coalesce(F.col("first.doc_id"), "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.col("first") == _order(), F.lit(True)).alias("kept"))


def kept(docs: DataFrame, width: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs, with all columns, one document of each class; of rows equal in doc_id and text one stays.

    What is joined are the keys to be dropped and those that occur repeatedly: Spark broadcasts them while they are small.
    """
    d, t, drop, own = free_names(docs, "d", "t", "drop", "own")
    keys = linked(docs, width, threshold).groupBy("doc_id", "th").agg((~F.bool_or("kept")).alias(drop), F.count(F.lit(1)).alias("n"))
    keys = written(keys.filter(F.col(drop) | (F.col("n") > 1)).select(F.col("doc_id").alias(d), F.col("th").alias(t), drop), "dropped")
    rows = docs.withColumn(own, F.xxhash64("text"))
    rows = rows.join(keys, rows["doc_id"].eqNullSafe(keys[d]) & (rows[own] == keys[t]), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = rows.filter(F.col(drop).isNull()).select(*columns)
    return once.unionByName(rows.filter(~F.col(drop)).dropDuplicates(["doc_id", own]).select(*columns))
