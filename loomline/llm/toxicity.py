"""Toxicity: a factorization machine over hashed terms, which also learns how pairs of terms act together.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), where x_i is 1 for each distinct term of the text that
the learned rows hold often enough, damped by the text's number of such terms in the pair sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesgrams as bg
from .common import bound_batches, stage
from .labelled import SAMPLE_ROWS, held_out, sample

#: Hashed terms; factors of each; learned rows that must hold a term; steps of the training at least.
TERMS, FACTORS, LEAST_ROWS, LEAST_STEPS = 1 << 20, 6, 4, 600
#: Distinct terms of all learned rows together, at most: what the driver holds. Rows are taken in the order of their ids' hashes until there are so many.
HELD_TERMS = 12_000_000
#: Decay of the factors, over the number of learned rows; decay of a linear weight, in standard deviations of its gradient by chance.
DECAY, CHANCE = 4.0, 0.7
#: Bytes of the word beginnings that are terms of their own, so that inflected forms share one.
PREFIXES = (4, 5, 6)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hashed term) of every word of letters and digits, lower case for A-Z, and of its beginnings."""
    w, cut = bg.words(data, offsets, bg.NO_TERM, prefixes=PREFIXES)
    doc, hashes = [w.doc], [w.hash]
    for k, h in zip(PREFIXES, cut, strict=True):
        longer = w.length > k
        doc.append(w.doc[longer])
        hashes.append(bg.mix(h[longer] + np.uint64(k)))
    return np.concatenate(doc), (np.concatenate(hashes) >> np.uint64(64 - 20)).astype(np.int64)


def distinct(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pair = np.unique(doc * TERMS + term)
    return pair // TERMS, pair % TERMS


class Machine(NamedTuple):
    #: Place of each hashed term among the used ones, or -1.
    place: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        doc, term = terms(data, offsets)
        used = self.place[term] >= 0
        doc, term = distinct(doc[used], term[used])
        return 1 / (1 + np.exp(-np.clip(forward(doc, self.place[term], n, self.w0, self.w, self.v)[0], -40, 40)))


def forward(doc: np.ndarray, at: np.ndarray, n: int, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits of n texts, their sums of factors, and the damping of their pair sums."""
    damp = 1 / np.maximum(np.bincount(doc, minlength=n), 1)
    sums = np.stack([np.bincount(doc, weights=v[at, k], minlength=n) for k in range(v.shape[1])], axis=1)
    own = np.bincount(doc, weights=(v[at] ** 2).sum(1), minlength=n)
    return w0 + np.bincount(doc, weights=w[at], minlength=n) + 0.5 * damp * ((sums**2).sum(1) - own), sums, damp


def train(doc: np.ndarray, term: np.ndarray, y: np.ndarray, epochs: int = 20, batch: int = 256, rate: float = 0.02, seed: int = 5) -> Machine:
    """Adam on the log loss, over every term in enough rows. doc (0 to len(y) - 1, in order) and term are the distinct terms of each learned text.

    Only decay holds terms back, and only in the joint fit: the factors decay in proportion (L2), the linear weights by steps
    (L1), of the size that chance alone gives a term's gradient. A term without a linear weight keeps its factors.
    """
    if len(set(y.tolist())) < 2:
        prior = 0.0 if not len(y) else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return Machine(np.full(TERMS, -1, np.int32), prior, np.zeros(1), np.zeros((1, FACTORS)))
    rows = np.bincount(term, minlength=TERMS)
    used = np.flatnonzero(rows >= LEAST_ROWS)
    place = np.full(TERMS, -1, np.int32)
    place[used] = np.arange(len(used))
    at = place[term]
    hit = at >= 0
    at, doc = at[hit], doc[hit]
    begin = np.searchsorted(doc, np.arange(len(y) + 1, dtype=doc.dtype))
    n, share = max(len(used), 1), np.zeros(max(len(used), 1))
    share[: len(used)] = rows[used] / len(y)
    least = (CHANCE * np.sqrt(share * (1 - share) * y.mean() * (1 - y.mean()) / len(y))).astype(np.float32)
    rng = np.random.default_rng(seed)
    # the weight and the factors of each term
    p = np.zeros((n, 1 + FACTORS), np.float32)
    p[:, 1:] = rng.normal(0, 0.05, (n, FACTORS))
    g, m, s = np.zeros_like(p), np.zeros_like(p), np.zeros_like(p)
    w0, m0, s0, step = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 0.0, 0.0, 0
    parts = max(1, len(y) // batch)
    epochs = max(epochs, -(-LEAST_STEPS // parts))
    for epoch in range(epochs):
        eta = rate * (1 - epoch / epochs) + 1e-4
        for rows_ in np.array_split(rng.permutation(len(y)), parts):
            length = begin[rows_ + 1] - begin[rows_]
            of = np.repeat(np.arange(len(rows_)), length)
            x = at[np.repeat(begin[rows_], length) + np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)]
            z, sums, damp = forward(of, x, len(rows_), w0, p[:, 0], p[:, 1:])
            err = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows_]) / len(rows_)
            pull = err[of]
            part = (pull * damp[of])[:, None] * (sums[of] - p[x, 1:])
            g[:, 0] = np.bincount(x, weights=pull, minlength=n)
            for k in range(FACTORS):
                g[:, 1 + k] = np.bincount(x, weights=part[:, k], minlength=n)
            g[:, 1:] += np.float32(DECAY / len(y)) * p[:, 1:]
            step += 1
            m += np.float32(0.1) * (g - m)
            s += np.float32(0.001) * (g * g - s)
            pace = np.float32(eta) / (np.sqrt(s / np.float32(1 - 0.999**step)) + np.float32(1e-8))
            p -= pace * m / np.float32(1 - 0.9**step)
            p[:, 0] = np.sign(p[:, 0]) * np.maximum(np.abs(p[:, 0]) - pace[:, 0] * least, 0)
            m0, s0 = m0 + 0.1 * (err.sum() - m0), s0 + 0.001 * (err.sum() ** 2 - s0)
            w0 -= float(eta * (m0 / (1 - 0.9**step)) / (np.sqrt(s0 / (1 - 0.999**step)) + 1e-8))
    return Machine(place, w0, p[:, 0].copy(), p[:, 1:].copy())


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """Learns on the driver from at most `rows` labelled texts and HELD_TERMS terms; of each text it gets the distinct hashed terms only."""

    bound_batches(docs.sparkSession)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bg.chunks(batch.column("text")):
                doc, term = distinct(*terms(data, offsets))
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                held = [term[cut[k] : cut[k + 1]].astype(np.int32).tobytes() for k in range(b - a)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), pa.array(np.diff(cut), pa.int64()), pa.array(held, pa.binary())], names=["doc_id", "label", "n", "terms"]
                )

    wanted = sample(docs, labels, "toxic", rows).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    known = stage(wanted.mapInArrow(features, "doc_id bigint, label int, n bigint, terms binary"), "terms")
    order = F.xxhash64("doc_id").alias("hash")
    sizes = known.select(order, "doc_id", "n").toPandas().sort_values(["hash", "doc_id"], ignore_index=True)  # three numbers for each learned row
    many = np.flatnonzero(sizes["n"].cumsum().to_numpy() > HELD_TERMS)
    if len(many):
        known = known.filter(F.struct(order, "doc_id") < F.struct(*[F.lit(int(sizes[c][many[0]])).alias(c) for c in ("hash", "doc_id")]))
    got = known.select("doc_id", "label", "terms").toPandas().sort_values(["doc_id", "terms"], ignore_index=True)
    y, held = got["label"].to_numpy(dtype=float), [np.frombuffer(t, np.int32) for t in got.pop("terms")]
    doc = np.repeat(np.arange(len(held), dtype=np.int32), [len(t) for t in held])
    term = np.concatenate(held) if held else np.zeros(0, np.int32)
    del got, held
    return train(doc, term, y)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 from the threshold on).

    Null and empty texts get the score of a text without terms. Null ids are scored and not learned from; repeated rows
    score alike. No rows give no rows; no labels give 0.5. Other columns are not read.
    """
    machine = fit(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in bg.chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(machine.score(data, offsets), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
