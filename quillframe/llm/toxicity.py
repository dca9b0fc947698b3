"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text gives the set of its hashed words, word pairs and pairs with one or two words between. The model is fitted with
per-coordinate learning rates and an L1 penalty on a bounded sample of labelled rows (MAX_ROWS rows of at most
MAX_BYTES bytes, those with the least hash of doc_id); few weights are left, and they are broadcast. Every
CALIBRATE_EVERY-th row of the sample refits slope and bias of the log odds, both classes weighing alike, so that 0.5 parts
them. Scoring reads whole texts, a long one in pieces.

Nulls and edge cases: a null or empty text has no features and gets the score of the bias. A null label isn't learned
from. Without labels of both classes the score is the smoothed share of label 1. Repeated rows are scored each. A null
doc_id counts as the empty string in the fold rule. A score equal to the threshold counts as toxic; texts of equal features score
alike; of an empty table comes an empty table. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm._base import WORD_BYTES, raw_texts, small_batches

BITS = 20
MAX_ROWS, MAX_BYTES = 12_000, 32_768
EPOCHS, ALPHA, BETA, L1, L2 = 4, 2.0, 1.0, 6.0, 0.05
#: Every so many-th row of the sample is kept from the weights and calibrates the score.
CALIBRATE_EVERY = 4
#: Words handled at once, and bytes of a long text.
PIECE_WORDS, PIECE_BYTES = 200_000, 1 << 20
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    """Weights that aren't zero by feature, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


def hasher() -> Callable[[list[bytes]], np.ndarray]:
    """A function from words to their 64-bit hashes, which remembers frequent words."""
    known: dict[bytes, int] = {}

    def hashes(words: list[bytes]) -> np.ndarray:
        if len(known) > 400_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w) + 1
        return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words)) * np.uint64(0x9E3779B97F4A7C15)

    return hashes


def _features(h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, features) of the words, of the pairs, and of the pairs at a distance of two and three."""
    shift = np.uint64(64 - BITS)
    yield doc, ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            pair = (h[:-gap] * np.uint64(0x94D049BB133111EB) + np.uint64(gap)) ^ (h[gap:] >> np.uint64(7))
            yield doc[gap:][same], ((pair * np.uint64(0xD6E8FEB86659FD93)) >> shift)[same]


def pieces(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], list[tuple[int, int]]]]:
    """Words of several texts together, with (text, number of words); a long text comes in pieces that share 3 words."""
    words: list[bytes] = []
    runs: list[tuple[int, int]] = []
    for i, raw in enumerate(texts):
        if not raw:
            continue
        clean, at, tail = raw.translate(WORD_BYTES), 0, []
        while at < len(clean):
            end = clean.find(b" ", at + PIECE_BYTES)
            end = len(clean) if end < 0 else end
            own = tail + clean[at:end].split()
            at, tail = end, own[-3:]
            words += own
            runs.append((i, len(own)))
            if len(words) >= PIECE_WORDS:
                yield words, runs
                words, runs = [], []
    if words:
        yield words, runs


def scorer(model: Model) -> Callable[[list[bytes | None]], np.ndarray]:
    """A function from texts to their scores."""
    dense = np.zeros(1 << BITS, dtype=np.float32)
    dense[model.index] = model.weight
    hashes = hasher()

    def scores(texts: list[bytes | None]) -> np.ndarray:
        found = []
        for words, runs in pieces(texts):
            doc = np.repeat(np.array([i for i, _ in runs]), np.array([n for _, n in runs]))
            for d, f in _features(hashes(words), doc):
                hit = dense[f] != 0
                found.append(np.unique((d[hit].astype(np.int64) << BITS) | f[hit].astype(np.int64)))
        logit = np.full(len(texts), model.bias)
        if found:
            both = np.unique(np.concatenate(found))
            np.add.at(logit, both >> BITS, dense[both & ((1 << BITS) - 1)].astype(np.float64))
        return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))

    return scores


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> Model:
    """The model of (feature set, label) rows, which are seen in the given order."""
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    positive = sum(y for _, y in rows)
    prior = (positive + 0.5) / (len(rows) + 1)
    bias, bias_n = float(np.log(prior / (1 - prior))), 0.0
    if 0 < positive < len(rows):
        for _ in range(epochs):
            for f, y in rows:
                zf, nf = z[f], n[f]
                w = np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(nf)) / ALPHA + L2))
                p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
                g = p - y
                z[f] = zf + g - (np.sqrt(nf + g * g) - np.sqrt(nf)) / ALPHA * w
                n[f] = nf + g * g
                bias_n += g * g
                bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    index = np.flatnonzero(w)
    return Model(index, w[index].astype(np.float32), bias)


def calibrated(model: Model, rows: list[tuple[np.ndarray, int]], steps: int = 40) -> Model:
    """The model with slope and bias of its log odds refitted on other rows, both classes weighing alike."""
    y = np.array([y for _, y in rows], dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return model
    dense = np.zeros(1 << BITS)
    dense[model.index] = model.weight
    x = np.stack([np.array([model.bias + dense[f].sum() for f, _ in rows]), np.ones(len(rows))], axis=1)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    goal, prior, w = np.where(y == 1, 0.995, 0.005), np.diag([0.1, 0.01]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + prior, x.T @ (weight * (p - goal)) + prior @ (w - [1.0, 0.0]))
        w -= step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
    slope = max(w[0], 1e-3)
    return Model(model.index, (model.weight * slope).astype(np.float32), float(model.bias * slope + w[1]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _feature_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = hasher()
    for batch in batches:
        out = []
        for raw in raw_texts(batch):
            parts = [f for words, runs in pieces([raw]) for _, f in _features(hashes(words), np.zeros(len(words), dtype=np.int64))]
            out.append(np.unique(np.concatenate(parts)).astype(np.int32) if parts else np.zeros(0, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("h", "y")] + [pa.array(out, pa.list_(pa.int32()))], ["h", "y", "f"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Learns labels.toxic from rows outside the held-out fold; the sample's ids, max_rows at most, are broadcast."""
    small_batches(docs.sparkSession)
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).filter("doc_id is not null and y is not null").filter(~held_out())
    sample = usable.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id", "y").limit(max_rows)
    texts = docs.select("doc_id", "text").filter(F.octet_length(F.coalesce("text", F.lit(""))) <= MAX_BYTES)
    rows = texts.join(F.broadcast(sample), "doc_id").select("h", "y", "text").mapInArrow(_feature_sets, "h long, y int, f array<int>")
    ordered = rows.repartition(1).sortWithinPartitions("h", "y", F.xxhash64("f"))
    got = ordered.mapInArrow(_trained(max_rows), "index array<int>, weight array<float>, bias double").first()
    if got is None:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), 0.0)
    return Model(np.array(got["index"], dtype=np.int64), np.array(got["weight"], dtype=np.float32), got["bias"])


def _trained(max_rows: int):
    """Sorted feature sets to one row with the model; the task holds the bounded sample, the driver only the weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, int]] = []
        for batch in batches:
            sets = batch.column(batch.schema.get_field_index("f"))
            for y, f in zip(batch.column(batch.schema.get_field_index("y")).to_pylist(), sets):
                if len(rows) < max_rows:
                    rows.append((f.values.to_numpy().copy(), y))
        if rows:
            m = calibrated(ftrl([r for i, r in enumerate(rows) if i % CALIBRATE_EVERY]), rows[::CALIBRATE_EVERY])
            yield pa.RecordBatch.from_arrays([pa.array([m.index], pa.list_(pa.int32())), pa.array([m.weight], pa.list_(pa.float32())), pa.array([m.bias])], ["index", "weight", "bias"])

    return run


def scored(docs: DataFrame, model: Model, keep_below: float | None = None) -> DataFrame:
    """docs(doc_id, text) to (doc_id, score); with keep_below, docs with all its columns, without rows that score as much."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(sent.value)
        for batch in batches:
            s = score(raw_texts(batch))
            if keep_below is None:
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(s)], ["doc_id", "score"])
            else:
                yield batch.filter(pa.array(s < keep_below))

    if keep_below is None:
        return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return docs.mapInArrow(run, docs.schema)
