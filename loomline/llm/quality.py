"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Random indexing: every unit of the vocabulary has a fixed sparse random index vector; the vector of a unit is the sum of
the index vectors of the units near it, over all documents. Units are words, hashed to a fixed vocabulary, and word
shapes (letter case, digits, marks, length, whether the word before is the same). A document is the mean of the vectors
of its words and of its shapes. A network of two layers learns on a bounded sample of labelled rows, and a temperature
fitted on rows set aside calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesgrams as bg
from .common import bound_batches, free
from .labelled import SAMPLE_ROWS, held_out, sample

#: Hashed words, hashed shapes, and dimensions of a vector. Together they bound what is summed and broadcast.
WORDS, SHAPES, DIM = 1 << 13, 1 << 12, 32
#: Neighbours on each side, and non-zero places of an index vector.
WINDOW, PLACES = 2, 2
#: Vocabulary rows that travel together when the tasks' sums are added.
SLICE = 1 << 9

UNITS = WORDS + SHAPES
#: Words whose neighbours are summed at a time.
WORDS_AT_ONCE = 200_000


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    seeds = bg.mix(np.arange(UNITS * PLACES, dtype=np.uint64) + np.uint64(7919)).reshape(UNITS, PLACES)
    return (seeds % np.uint64(DIM)).astype(np.int64), np.where(seeds >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word unit, shape unit) of each word of a chunk."""
    w = bg.words(data, offsets)
    if not len(w.hash):
        return w.doc, w.doc, w.doc
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = 4
    kinds[48:58], kinds[65:91], kinds[97:123], kinds[128:] = 3, 1, 2, 5
    kind = kinds[data]
    n = {}
    for k in (1, 2, 3, 4, 5):
        until = np.zeros(len(data) + 1, np.int32)
        np.cumsum(kind == k, out=until[1:])
        n[k] = until[w.start + w.length] - until[w.start]
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    shape = kind[w.start].astype(np.int64)
    for part, base in ((kind[w.start + w.length - 1], 6), (n[1] > 1, 2), (n[2] > 0, 2), (n[3] > 0, 2), (np.minimum(n[4], 4), 5), (n[5] > 0, 2), (np.minimum(w.length // 4, 5), 6), (same, 2)):
        shape = shape * base + part
    return w.doc, (w.hash % np.uint64(WORDS)).astype(np.int64), WORDS + (bg.mix(shape.astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int64)


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of index vectors near each unit, over a task's texts, in slices of the vocabulary."""
    place, sign = _index_vectors()
    total, held, n = None, [], 0

    def add() -> None:
        doc, word, shape = map(np.concatenate, zip(*held, strict=True))
        for off in range(1, WINDOW + 1):
            near = doc[off:] == doc[:-off]
            for own, other in ((word, word), (word, shape), (shape, shape)):
                for a, b in ((own[off:][near], other[:-off][near]), (own[:-off][near], other[off:][near])):
                    for k in range(PLACES):
                        total[:] += np.bincount(a * DIM + place[b, k], weights=sign[b, k], minlength=UNITS * DIM).reshape(UNITS, DIM)
        held.clear()

    texts = 0
    for batch in batches:
        for a, b, data, offsets in bg.chunks(batch.column("text")):
            total = np.zeros((UNITS, DIM)) if total is None else total
            doc, word, shape = units(data, offsets)
            held.append((doc + texts, word, shape))
            texts, n = texts + b - a, n + len(doc)
            if n >= WORDS_AT_ONCE:
                add()
                n = 0
    if held:
        add()
    if total is not None:
        for s in range(0, UNITS, SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([total[s : s + SLICE].astype(np.float32).tobytes()], pa.binary())], ["slice", "sums"])


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, sums in zip(batch.column("slice").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            own = held.setdefault(s, np.zeros(SLICE * DIM))
            own += np.frombuffer(sums, np.float32)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v.astype(np.float64).tobytes() for v in held.values()], pa.binary())], ["slice", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all units, of length 1 (or 0 if never seen), from every text. The driver gets UNITS x DIM numbers at any size of docs."""
    slices = docs.select("text").mapInArrow(_count_contexts, "slice bigint, sums binary")
    added = slices.repartition(UNITS // SLICE, "slice").mapInArrow(_add_slices, "slice bigint, sums binary")
    out = np.zeros((UNITS, DIM), np.float32)
    for s, sums in added.collect():
        out[s : s + SLICE] = np.frombuffer(bytes(sums), np.float64).reshape(SLICE, DIM)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of the words and mean vector of the shapes of each text, and their lengths."""
    n = len(offsets) - 1
    doc, word, shape = units(data, offsets)
    out = np.zeros((n, 2 * DIM + 2), np.float32)
    if len(doc):
        counts = np.maximum(np.bincount(doc, minlength=n), 1)[:, None]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        for k, unit in enumerate((word, shape)):
            for a in range(0, DIM, 8):  # a few columns at a time bound the memory
                sums = np.add.reduceat(vectors[unit, a : a + 8].astype(np.float64), first, axis=0)
                out[doc[first], k * DIM + a : k * DIM + a + 8] = sums / counts[doc[first]]
            out[:, 2 * DIM + k] = np.linalg.norm(out[:, k * DIM : (k + 1) * DIM], axis=1)
    return out


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Network:
    """Adam on the log loss over four fifths of the rows; the temperature with the least log loss on the last fifth.

    With no rows, or rows of one label, the network is constant: 0.5, or near that label.
    """
    d = x.shape[1] if x.ndim == 2 and len(x) else 2 * DIM + 2
    if len(set(y.tolist())) < 2:
        prior = 0.0 if not len(y) else np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), float(prior), 1.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside, used = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[used].mean(0), x[used].std(0) + 1e-6
    z = ((x - mean) / scale).astype(np.float64)
    p = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        eta = rate * (1 - epoch / epochs) + 1e-5
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // batch)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(err, p[2]) * (1 - h * h)
            grads = [z[rows].T @ back + decay * p[0], back.sum(0), h.T @ err + decay * p[2], np.array([err.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.001 * (g * g - v[k])
                p[k] = p[k] - eta * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    return net._replace(temperature=temperature(net.logits(x[aside]), y[aside]))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits, on a grid from 1/2 to 8, with the least log loss."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.5, 8, 60)
    loss = [np.mean(np.logaddexp(0, np.where(y > 0, -1, 1) * logits / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, Network]:
    """Word vectors from all texts, and the network from at most `rows` labelled ones, whose pooled vectors go to the driver."""
    bound_batches(docs.sparkSession)
    vectors = word_vectors(docs)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bg.chunks(batch.column("text")):
                x = pooled(data, offsets, vectors)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[a:b].cast(pa.int64()), batch.column("label")[a:b], pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"]
                )

    got = sample(docs, labels, "quality", rows).mapInArrow(features, "doc_id bigint, label int, x binary").toPandas()
    got = got.sort_values(["doc_id", "x"], ignore_index=True)
    x = np.stack([np.frombuffer(r, np.float32) for r in got["x"]]) if len(got) else np.zeros((0, 2 * DIM + 2), np.float32)
    return vectors, train(x, got["label"].to_numpy(dtype=float))


def score(docs: DataFrame, vectors: np.ndarray, net: Network, keep: list[str]) -> DataFrame:
    """The kept columns of docs with score as _score. Null text scores as empty text does."""
    names = [*keep, free("_score", keep)]
    at = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bg.chunks(batch.column(at)):
                part = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*part, pa.array(net.score(pooled(data, offsets, vectors)), pa.float64())], names=names)

    rows = docs.select(*keep) if at < len(keep) else docs.select(*keep, "text")
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), f"`{names[-1]}` double"]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 from the threshold on).

    Null and empty texts get the network's score of an empty document. Null ids are scored and not learned from;
    repeated rows score alike. No rows give no rows; no labels give 0.5. Other columns are not read.
    """
    vectors, net = fit(docs, labels, rows)
    scored = score(docs, vectors, net, ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs' own columns, without the documents that score below the threshold.

    Null and empty texts score as an empty document does; null ids are scored and not learned from; repeated rows stay or go
    together; without labels every row scores 0.5 and stays, and an empty table stays empty. Columns of any name and with
    nulls are carried along.
    """
    vectors, net = fit(docs, labels)
    scored = score(docs, vectors, net, docs.columns)
    return scored.filter(F.col(scored.columns[-1]) >= threshold).select(*docs.columns)
