"""Toxicity scores from a factorization machine over hashed terms.

A text's features are its distinct lower-cased words (stripped of the signs at
their ends), each hashed to one of DIM places.  The machine adds a bias, one
weight per place and the pairwise interactions of FACTORS-dimensional place
vectors, so that two terms together can mean what neither means alone; all
pairs of a text cost as much as one pass over its places.

Training uses a bounded sample of labelled documents (``sample``, drawn by a
hash of doc_id, of those whose crc32(doc_id) mod 4 is not 2); scoring covers
every whole text.  Terms get weights if they are frequent or associated with
the label, so rare words don't pass for evidence: a distributed count over the
sample picks them, and only those reach the driver, so what is gathered
doesn't grow with the length of texts.  A fifth of the sample isn't trained
on: it picks the epoch and calibrates the margin by a logistic fit, so that
the score is the chance of label 1.

Defined results: null or empty texts have no features and get the bias'
score; texts of any length are read whole; rows with a null doc_id are scored
and are not held out; repeated rows get the same score; without labels, or with labels of one kind only, every score is the
share of label 1 (0 if there are none); repeated labels of one document count
each; rows are independent; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .kernel import LOWER, Words, mix, slices, span_hash

DIM = 1 << 18
FACTORS = 8
SAMPLE = 20_000
THRESHOLD = 0.3

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places of each document, and the documents' offsets among them."""
    low = LOWER[data]
    words = Words(low, offsets)
    good = np.concatenate([[0], np.cumsum(_ALNUM[low])])
    core = good[words.end] > good[words.start]
    at = np.flatnonzero(_ALNUM[low])
    start, end, doc = words.start[core], words.end[core], words.doc[core]
    if len(at):
        start = at[np.searchsorted(at, start)]
        end = at[np.searchsorted(at, end) - 1] + 1
    place = (mix(span_hash(low, start, end) + np.uint64(11)) % np.uint64(DIM)).astype(np.int64)
    both = np.unique(doc.astype(np.int64) * DIM + place)
    return (both % DIM).astype(np.int32), np.searchsorted(both, np.arange(len(offsets)) * DIM)


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    used: np.ndarray | None = None

    def margins(self, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        if self.used is not None:
            own = self.used[place]
            place, doc = place[own], doc[own]
        linear = np.bincount(doc, self.weight[place], len(n))
        pairs = np.zeros(len(n))
        for k in range(self.factor.shape[1]):
            v = self.factor[place, k]
            pairs += np.bincount(doc, v, len(n)) ** 2 - np.bincount(doc, v * v, len(n))
        return self.bias + linear + pairs / 2

    def scores(self, place: np.ndarray, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(place, at) * self.scale + self.shift, -30, 30)))


def chosen(place: np.ndarray, seen: np.ndarray, positive: np.ndarray, n: int, n_positive: float) -> np.ndarray:
    """Which places get weights: in five texts at least, and either frequent or associated with a label (z of 3.5)."""
    used, share = np.zeros(DIM, bool), n_positive / n if n else 0.0
    z = (positive - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share) * (1 - seen / max(n, 1)), 1e-9))
    used[place[(seen >= 5) & ((np.abs(z) >= 3.5) | (seen >= 0.02 * n))]] = True
    return used


def fit(place: np.ndarray, at: np.ndarray, label: np.ndarray, test: np.ndarray, used: np.ndarray, epochs: int = 25, seed: int = 3) -> Machine:
    """Adagrad on the logistic loss over small batches; the rows of test pick the epoch and calibrate the margin."""
    rng = np.random.default_rng(seed)
    n = len(label)
    share = float(label.mean()) if n else 0.0
    m = Machine(np.log(share / (1 - share)) if 0 < share < 1 else 30.0 if share else -30.0, np.zeros(DIM, np.float32), np.zeros((DIM, FACTORS), np.float32))
    if not 0 < share < 1 or not 0 < label[test].sum() < test.sum() or not 0 < label[~test].sum():
        return m
    doc = np.repeat(np.arange(n), np.diff(at))
    keep = used[place]
    doc, place = doc[keep], place[keep]
    at = np.searchsorted(doc, np.arange(n + 1))
    m.factor = np.where(used[:, None], rng.normal(0, 0.02, (DIM, FACTORS)), 0).astype(np.float32)
    m.used = used
    gw, gv, gb = np.full(DIM, 1.0), np.full((DIM, FACTORS), 1.0), 1.0
    rows_all, best = np.flatnonzero(~test), (np.inf, None)
    for _ in range(epochs):
        order = rng.permutation(rows_all)
        for i in range(0, len(order), 128):
            rows = order[i : i + 128]
            count = at[rows + 1] - at[rows]
            if not count.sum():
                continue
            row = np.repeat(np.arange(len(rows)), count)
            p = place[np.concatenate([np.arange(at[r], at[r + 1]) for r in rows])]
            v = m.factor[p]
            total = np.stack([np.bincount(row, v[:, k], len(rows)) for k in range(FACTORS)], 1)
            square = np.stack([np.bincount(row, v[:, k] ** 2, len(rows)) for k in range(FACTORS)], 1)
            margin = m.bias + np.bincount(row, m.weight[p], len(rows)) + (total**2 - square).sum(1) / 2
            err = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[rows]
            u, where = np.unique(p, return_inverse=True)
            dw = np.bincount(where, err[row], len(u)) + 0.02 * m.weight[u]
            dv = np.stack([np.bincount(where, err[row] * (total[row, k] - v[:, k]), len(u)) for k in range(FACTORS)], 1) + 0.05 * m.factor[u]
            gw[u] += dw**2
            gv[u] += dv**2
            m.weight[u] -= (0.3 * dw / np.sqrt(gw[u])).astype(np.float32)
            m.factor[u] -= (0.02 * dv / np.sqrt(gv[u])).astype(np.float32)
            db = err.sum()
            gb += db**2
            m.bias -= 0.3 * db / np.sqrt(gb)
        margin = np.clip(m.margins(place, at)[test], -30, 30)
        loss = float(np.mean(np.logaddexp(0, margin) - label[test] * margin))
        if loss < best[0]:
            best = (loss, (m.bias, m.weight.copy(), m.factor.copy()))
    m.bias, m.weight, m.factor = best[1]
    margin, truth = m.margins(place, at)[test], label[test]
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the logistic calibration
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - truth) * margin).sum() + (a - 1), (p - truth).sum() + 0.1 * b])
        s = p * (1 - p)
        h = np.array([[(s * margin**2).sum() + 1, (s * margin).sum()], [(s * margin).sum(), s.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    m.scale, m.shift = a, b
    return m


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fit a machine on at most sample labelled documents, held-out ones never among them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(2)):
                place, at = places(data, off)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(i, j - i),
                        "toxic": batch.column(1).slice(i, j - i),
                        "places": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(place)),
                    }
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(drawn), "doc_id")  # at most sample rows
    hashed = texts.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, places array<int>")
    hashed = materialize(hashed.withColumn("test", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0), "hashed")
    train = hashed.filter("not test")
    counted = train.select("toxic", F.explode("places").alias("p")).groupBy("p").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).toArrow()  # DIM rows at most
    sums = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    used = chosen(np.asarray(counted["p"]).astype(np.int64), np.asarray(counted["n"]), np.asarray(counted["t"]).astype(float), sums[0], float(sums[1]))
    mask = docs.sparkSession.sparkContext.broadcast(np.packbits(used))  # DIM bits

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(mask.value).astype(bool)
        for batch in batches:
            place = np.asarray(batch.column(3).flatten())
            own = wanted[place]
            upto = np.concatenate([[0], np.cumsum(own)])[np.concatenate([[0], np.cumsum(np.asarray(batch.column(3).value_lengths()))]).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(place[own]))], ["doc_id", "toxic", "test", "places"])

    rows = hashed.select("doc_id", "toxic", "test", "places").mapInArrow(pick, "doc_id long, toxic int, test boolean, places array<int>").toArrow().combine_chunks()
    rows = rows.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    if not rows.num_rows:
        return fit(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0), np.zeros(0, bool), used)
    lists = rows["places"].combine_chunks()
    at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))]).astype(np.int64)
    return fit(np.asarray(lists.flatten()).astype(np.int64), at, np.asarray(rows["toxic"]).astype(float), np.asarray(rows["test"]), used)


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # DIM x (FACTORS + 1) floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, j, data, off in slices(batch.column(2)):
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column(0).slice(i, j - i), "held_out": batch.column(1).slice(i, j - i), "score": m.scores(*places(data, off))}
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score(docs, learn(docs, labels, **options))
