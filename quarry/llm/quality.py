"""Quality rules: robust multivariate outliers per language and source.

Each document gets counts (one vectorised pass over whole texts), then a
vector of six transformed rates in fixed point.  Minimum-covariance-determinant
estimates are found at three levels at once: for every group of language and
source whatever its size, for every language over all of its rows, and for the
table.  Each has several starts (medians with quartile ranges, plain moments,
the half nearest to the medians).  A concentration step keeps the 75 % of rows
nearest to the centre and takes their mean and covariance; steps go on as long
as the determinant falls, and the start of the least determinant stays.  A step is one
aggregate whose rows are distance bins of a group, with exact integer sums, so
a group may hold any share of the rows, results don't depend on the order of
rows, and nothing reaches the driver but counts.

A group's centre and scatter are drawn towards its language's, and a
language's towards the table's, by the weight of ``PULL`` rows: a group of
three rows is judged mostly by its language, one of a million by itself, and
nothing switches in between.  A floor on each rate's deviation, in every
direction, keeps rates that are constant in clean text (symbols, repeated
lines) from rejecting one email address or a repeated line.  Documents farther
than a cut of the Mahalanobis distance are rejected.

Defined results: null or empty texts have no words and fail the base rules;
null languages and sources are groups of their own; repeated rows count each
and get the same verdict; texts are taken whole; rows that fail the base rules
are in no estimate; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import broadcast_if_small, delete, materialize
from .kernel import SPACE, Words, mix, per_doc, run_hash, slices, span_hash

SYMBOLS = "#*$%&|<>"
RATES = ("symbols", "lines", "repeats", "length", "capitals", "marks")
#: Least deviation of each transformed rate, in its own unit.
FLOORS = (0.05, 0.12, 0.18, 0.35, 0.08, 0.08)
UNIT = 1024
BINS = 64  # distance bins per doubling
SHARE = 0.75
PULL_CENTRE, PULL_SCATTER = 20.0, 100.0
CUT = 40.0

_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in SYMBOLS]] = True
_capital = np.zeros(256, bool)
_capital[65:91] = True
_mark = np.zeros(256, bool)
_mark[[ord(c) for c in "!?@/\\_=+~^`{}[]()\"'0123456789"]] = True


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each document of a slice."""
    words = Words(data, offsets)
    n_docs = len(offsets) - 1
    begins = (data & 0xC0) != 0x80
    out = {
        "n_words": words.count.astype(np.int64),
        "word_chars": per_doc(begins & ~words.space, offsets),
        "n_symbols": per_doc(_symbol[data], offsets),
        "n_capitals": per_doc(_capital[data], offsets),
        "n_marks": per_doc(_mark[data], offsets),
    }
    # lines
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    doc = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(data)), offsets[doc + 1])
    end = end - ((end > start) & (data[end - 1] == 10) if len(start) else 0)
    inked = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~words.space, out=inked[1:])
    full = inked[end] > inked[start]
    doc = doc[full]
    keys = np.unique(mix(span_hash(data, start[full], end[full])) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)[1]
    lines = np.bincount(doc, minlength=n_docs)
    out["n_lines"] = lines
    out["n_dup_lines"] = lines - np.bincount(doc[keys], minlength=n_docs)
    # windows of three words
    at = words.windows(3)
    flags = np.zeros(len(words.start), bool)
    if len(at):
        key = run_hash(words.hashes(), 3)[at] + words.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[times[where] > 1]
        for k in range(3):
            flags[twice + k] = True
    out["n_repeat_words"] = per_doc(flags, words.first)
    return out


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_lines")


def statistics(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, key (a hash of text, lang and source), lang, source and the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(4)):
                got = counts(data, off)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(i, j - i) for k in range(4)] + [pa.array(got[c], pa.int64()) for c in COUNTS],
                    ["doc_id", "key", "lang", "source", *COUNTS],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text", "lang", "source").alias("key"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        "text",
    )
    return rows.mapInArrow(run, "doc_id long, key long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates() -> list[Column]:
    """The transformed vector in fixed point; short texts are drawn towards zero by the added 50."""
    w = F.col("n_words").cast("double") + 50
    chars = F.col("word_chars").cast("double") + 50
    values = (
        F.sqrt(F.col("n_symbols") / w),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 10.0)),
        F.sqrt(F.col("n_repeat_words") / w),
        F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)) / 4.0,
        F.sqrt(F.col("n_capitals") / chars),
        F.sqrt(F.col("n_marks") / chars),
    )
    return [F.round(F.least(v, F.lit(32.0)) * UNIT).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


D = len(RATES)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]
_WEIGHTS = [T.StructField(f"m{i}", T.DoubleType()) for i in range(D)] + [T.StructField(f"p{i}_{j}", T.DoubleType()) for i, j in PAIRS]
_PARAMS = T.StructType(
    [T.StructField("g", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("det", T.DoubleType()), T.StructField("moved", T.BooleanType())]
    + _WEIGHTS
    + [T.StructField(f"c{i}_{j}", T.DoubleType()) for i, j in PAIRS]
)
_FITTED = T.StructType([T.StructField("g0", T.StringType()), *_WEIGHTS])


def chi2_quantile(d: int, z: float) -> float:
    """The Wilson-Hilferty approximation at the normal quantile z."""
    return d * (1 - 2 / (9 * d) + z * (2 / (9 * d)) ** 0.5) ** 3


def _distance() -> Column:
    total = None
    for i, j in PAIRS:
        term = (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}")) * F.col(f"p{i}_{j}")
        total = term if total is None else total + term
    return total


def _sound(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance with the floors as least deviations in every direction, and its log-determinant.

    Variance under the floors counts beside the determinant, so that
    concentration steps never raise the sum.
    """
    unit = np.array(FLOORS) * UNIT
    size, axes = np.linalg.eigh(cov / np.outer(unit, unit))
    full = np.maximum(size, 1.0)
    return (axes * full) @ axes.T * np.outer(unit, unit), float((np.log(full) + size / full).sum())


def _weights(mean: np.ndarray, cov: np.ndarray) -> list[float]:
    p = np.linalg.inv(cov)
    return [*mean.tolist(), *[float(p[i, j]) * (1 if i == j else 2) for i, j in PAIRS]]


def _params_row(g: str, start: int, n: int, mean: np.ndarray, cov: np.ndarray) -> list:
    sound, det = _sound(cov)
    return [g, start, n, det, True, *_weights(mean, sound), *[float(cov[i, j]) for i, j in PAIRS]]


def _matrix(values: list[float]) -> np.ndarray:
    out = np.zeros((D, D))
    for (i, j), v in zip(PAIRS, values):
        out[i, j] = out[j, i] = v
    return out


def _moments(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of integer sums."""
    h = float(rows["n"].sum())
    mean = np.array([float(rows[f"s{i}"].sum()) for i in range(D)]) / h
    return mean, _matrix([float(rows[f"q{i}_{j}"].sum()) / h - mean[i] * mean[j] for i, j in PAIRS])


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(D)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in PAIRS]]


def _starts(vectors: DataFrame) -> DataFrame:
    """Start 0: medians and quartile ranges of each rate, from histograms. Start 1: plain moments. Start 2 begins as start 0, with half of the rows."""
    cells = vectors.select("g", F.posexplode(F.array(*[F.col(f"x{i}") for i in range(D)])).alias("i", "x"))
    cells = cells.groupBy("g", "i", F.shiftright("x", 4).alias("cell")).agg(F.count("*").alias("n"))
    upto, all_ = Window.partitionBy("g", "i").orderBy("cell"), Window.partitionBy("g", "i")
    cells = cells.withColumn("upto", F.sum("n").over(upto)).withColumn("rows", F.sum("n").over(all_))
    at = [F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("cell") * 16.0 + 8)).alias(c) for q, c in ((0.25, "lo"), (0.5, "mid"), (0.75, "hi"))]
    spots = cells.groupBy("g", "i").agg(*at, F.max("rows").alias("rows"))
    medians = spots.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "mid", "hi"))).alias("spots"))  # one struct per rate
    both = vectors.groupBy("g").agg(*_sums()).join(medians, "g")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k in range(len(b)):
                row = b.iloc[k : k + 1]
                g, n, spots = row["g"].iloc[0], int(row["n"].iloc[0]), row["spots"].iloc[0]
                mid = np.array([x["mid"] for x in spots])
                wide = np.diag(np.array([(x["hi"] - x["lo"]) / 1.349 for x in spots]) ** 2)
                out += [_params_row(g, 0, n, mid, wide), _params_row(g, 1, n, *_moments(row)), _params_row(g, 2, n, mid, wide)]
            yield pd.DataFrame(out, columns=_PARAMS.names)

    return both.mapInPandas(run, _PARAMS)


def _step(vectors: DataFrame, params: DataFrame, groups: int, turn: int) -> DataFrame:
    """One concentration step: mean and covariance of the nearest rows of each group and start."""
    bin_ = F.least(F.lit(4000), F.greatest(F.lit(0), F.floor(F.log2(_distance() + 2.0**-8) * BINS) + 8 * BINS)).cast("int")
    near = vectors.join(broadcast_if_small(params.select("g", "start", *[f.name for f in _WEIGHTS]), groups), "g").withColumn("bin", bin_)
    bins = near.groupBy("g", "start", "bin").agg(*_sums())
    before = F.array(*[F.col(f.name).cast("double") for f in _PARAMS.fields[3:]])
    lists = bins.join(broadcast_if_small(params.select("g", "start", before.alias("before")), groups), ["g", "start"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        n, start = rows["n"].to_numpy(np.int64).cumsum(), int(rows["start"].iloc[0])
        share = 0.5 if turn == 0 and start == 2 else SHARE
        last = int(np.searchsorted(n, share * n[-1])) + 1
        mean, cov = _moments(rows.iloc[:last])
        row = _params_row(rows["g"].iloc[0], start, int(n[-1]), mean, cov)
        old = list(rows["before"].iloc[0])
        if turn > (start == 2) and row[3] >= old[0] - 1e-9:  # the one before was of as many rows
            row[3:] = [old[0], False, *old[2:]]
        return pd.DataFrame([row], columns=_PARAMS.names)

    return lists.groupBy("g", "start").applyInPandas(run, _PARAMS)


def estimates(vectors: DataFrame) -> DataFrame:
    """Per g of vectors(g, x0..): the settled parameters of the start with the least determinant."""
    params = materialize(_starts(vectors), "params", small=True)
    fits = params.count()
    left, turn = fits, 0
    while left:
        stepped = _step(vectors, params.filter("moved"), fits, turn)
        params = materialize(stepped.unionByName(params.filter("not moved")), "params", small=True)
        left, turn = params.filter("moved").count(), turn + 1
    columns = [c for c in params.columns if c not in ("g", "moved")]
    best = params.groupBy("g").agg(F.min_by(F.struct(*columns), F.struct("det", "start")).alias("best"))
    return best.select("g", "best.*")


def _pulled(own: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group (g0, l) its parameters, drawn to its language's and those to the table's."""
    sides = ["rows", *[f"m{i}" for i in range(D)], *[f"c{i}_{j}" for i, j in PAIRS]]
    part = lambda at, key: own.select(F.col("g").alias(key), F.array(*[F.col(c).cast("double") for c in sides]).alias(at))
    # the nearest rows understate the spread: scale so that their edge stands at the chi-squared quantile
    scale = max(1.0, chi2_quantile(D, 0.6745) / max(chi2_quantile(D + 2, 0.6745) - 2, 1e-9))
    rows = groups.select("g0", "l", F.lit("[]").alias("every")).join(part("a", "g0"), "g0", "left").join(part("b", "l"), "l", "left").join(part("c", "every"), "every")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for g0, *levels in zip(batch["g0"], batch["c"], batch["b"], batch["a"]):
                mean = cov = None
                for level in levels:
                    if level is None:
                        continue
                    n, m, c = float(level[0]), np.asarray(level[1 : D + 1], float), scale * _matrix(list(level[D + 1 :]))
                    a, b = (1.0, 1.0) if mean is None else (n / (n + PULL_CENTRE), n / (n + PULL_SCATTER))
                    mean = m if mean is None else a * m + (1 - a) * mean
                    cov = c if cov is None else b * c + (1 - b) * cov
                out.append([g0, *_weights(mean, _sound(cov)[0])])
            yield pd.DataFrame(out, columns=_FITTED.names)

    return rows.select("g0", "a", "b", "c").mapInPandas(run, _FITTED)


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """Per row of docs: doc_id, key, the counts, base_failed, distance and kept."""
    spark = docs.sparkSession
    stats = materialize(statistics(docs), "statistics")
    vectors = stats.select("doc_id", "key", F.to_json(F.array("lang", "source")).alias("g0"), F.to_json(F.array("lang")).alias("l"), base_failed().alias("failed"), *COUNTS[:5], *rates())
    vectors = materialize(vectors, "vectors")
    sound = vectors.filter("not failed").select(F.explode(F.array("g0", "l", F.lit("[]"))).alias("g"), *[f"x{i}" for i in range(D)])
    groups = materialize(vectors.select("g0", "l").distinct(), "groups", small=True)
    fitted = materialize(_pulled(estimates(sound), groups), "fitted", small=True)
    out = vectors.join(broadcast_if_small(fitted, groups.count()), "g0", "left").withColumn("distance", _distance())
    delete(spark, stats)
    return out.select(
        "doc_id",
        "key",
        *COUNTS[:5],
        F.col("failed").alias("base_failed"),
        "distance",
        (~F.col("failed") & F.coalesce(F.col("distance") <= cut, F.lit(False))).alias("kept"),
    )


def keep(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that pass."""
    passed = judge(docs, **options).filter("kept").select(F.col("doc_id").alias("quarry__id"), F.col("key").alias("quarry__key")).distinct()
    key = F.xxhash64("text", "lang", "source")
    return docs.join(passed, F.col("doc_id").cast("long").eqNullSafe(F.col("quarry__id")) & (key == F.col("quarry__key")), "left_semi")
