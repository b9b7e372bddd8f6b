"""Exact top-k search by norm-sorted inner products.

Components become integers, floor(256 x).  The integer vectors are rotated by
the eigenvectors of their second moments (the SVD of all rows, from one
aggregate of dim x dim exact sums), so the leading coordinates hold most of
the length.  Candidates are range-partitioned and processed by descending
length in blocks.  A query leaves a block when its threshold (its k-th best
score so far) exceeds |q| times the block's largest length.  A candidate is
skipped when the partial sum over the leading coordinates plus the
Cauchy-Schwarz bound on the rest, |q_rest| |c_rest|, stays below it; the
leading part widens step by step (16, 32, 48 ..) while many candidates are
left.  What is left is scored exactly in integers; a tie with the threshold is
never skipped.  First thresholds come from the longest candidates of all.

Queries pass in waves of QUERY_BLOCK rows, each one bounded broadcast that is
destroyed after it; every wave is held against all candidates, and each task
writes at most k rows a query, which a window ranks.  ``counts`` reports how
many pairs each bound has dropped.  Vectors of about one length and without a
leading subspace leave the bounds little to drop: the work is then that of all
pairs, in matrix products.

Defined results: vectors that are null, empty, of another dimension than the
most common one, or hold null or non-finite components take no part, nor do
null ids; rows that share an id with the query are its own and no candidates;
repeated ids of candidates count each; queries that share an id and differ in
their vectors are searched each, and their candidates are ranked together;
fewer candidates than k give fewer rows; no rows give an empty result; other
columns are left alone.  Scores are exact as 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, partitions, scratch_path

QUERY_BLOCK = 4096
BLOCK = 1024
PROBE = 2048
HEAD = 16


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v, norm2) of the rows that take part."""
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    rows = vectors.filter(F.coalesce(sound, F.lit(False)) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v")
    )
    return rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors of the second moments, leading first; each task returns one dim x dim matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            v = np.asarray(batch.column(0).flatten(), np.float64).reshape(-1, dim)
            total += v.T @ v
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(dim), pa.int64()), "row": pa.array(list(total), pa.list_(pa.float64()))})

    parts = rows.select("v").mapInArrow(run, "i long, row array<double>")
    sums = parts.groupBy("i").agg(*[F.sum(F.col("row")[k]).alias(f"c{k}") for k in range(dim)]).orderBy("i").collect()
    matrix = np.array([[r[f"c{k}"] for k in range(dim)] for r in sums]) if sums else np.eye(dim)
    return np.linalg.eigh(matrix)[1][:, ::-1].copy()


class Block:
    """Queries of one wave with what pruning needs."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, turn: np.ndarray, head: int, k: int):
        self.ids, self.whole, self.v, self.k, self.head = ids, v, v.astype(np.float64), k, head
        self.turned = self.v @ turn
        self.norm = np.sqrt(np.square(self.v).sum(1))
        self.floor = np.full(len(ids), -np.inf)


def _tails(turned: np.ndarray, cuts: list[int]) -> list[np.ndarray]:
    """The lengths of what each cut leaves out."""
    square = np.square(turned)
    return [np.sqrt(square[:, c:].sum(1)) for c in cuts]


def search(block: Block, chunks: Iterator[tuple[np.ndarray, np.ndarray]], turn: np.ndarray, counts: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best candidates (query index, id, score) of chunks that come by descending length."""
    k, nq = block.k, len(block.ids)
    counts = counts if counts is not None else {}
    floor = block.floor.copy()
    best_s = np.full((nq, k), np.iinfo(np.int64).min)
    best_i, have = np.zeros((nq, k), np.int64), np.zeros((nq, k), bool)
    cuts = list(range(block.head, len(turn), block.head))
    q_tails = _tails(block.turned, cuts)
    for ids, whole in chunks:
        v = whole.astype(np.float64)
        norm = np.sqrt(np.square(v).sum(1))
        slack = 1e-6 * (1 + block.norm * norm.max())
        live = np.flatnonzero(block.norm * norm.max() + slack >= floor)
        pairs = nq * len(ids)
        counts["pairs"] = counts.get("pairs", 0) + pairs
        counts["by_length"] = counts.get("by_length", 0) + pairs - len(live) * len(ids)
        if not len(live):
            continue
        turned, least = v @ turn, (floor[live] - slack[live])[:, None]
        partial, done = np.zeros((len(live), len(ids))), 0
        left = np.ones(partial.shape, bool)
        for cut, q_tail, tail in zip(cuts, q_tails, _tails(turned, cuts)):
            if left.sum() < 0.2 * left.size:
                break
            partial += block.turned[live, done:cut] @ turned[:, done:cut].T
            done = cut
            left = partial + np.outer(q_tail[live], tail) >= least
        a, b = np.nonzero(left)
        counts["by_partial_sums"] = counts.get("by_partial_sums", 0) + left.size - len(a)
        if not len(a):
            continue
        q = live[a]
        if float(block.norm[live].max()) * float(norm.max()) < 2.0**52 and len(a) >= 0.2 * left.size:
            score = np.rint((block.v[live] @ v.T)[a, b]).astype(np.int64)  # exact below 2**53
        else:
            score = np.concatenate([np.einsum("ij,ij->i", block.whole[q[i : i + 65536]], whole[b[i : i + 65536]]) for i in range(0, len(q), 65536)])
        own = block.ids[q] != ids[b]
        q, c, s = q[own], ids[b][own], score[own]
        # only what reaches the k-th best so far can change it
        near = ~have[q, k - 1] | (s >= best_s[q, k - 1])
        q, c, s = q[near], c[near], s[near]
        oq, op = np.nonzero(have[live])
        oq = live[oq]
        q, c, s = np.concatenate([q, oq]), np.concatenate([c, best_i[oq, op]]), np.concatenate([s, best_s[oq, op]])
        order = np.lexsort((c, -s, q))
        q, c, s = q[order], c[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < k
        q, c, s, place = q[top], c[top], s[top], place[top]
        have[q] = False
        have[q, place], best_s[q, place], best_i[q, place] = True, s, c
        floor = np.maximum(floor, np.where(have[:, k - 1], best_s[:, k - 1].astype(np.float64), -np.inf))
    q, place = np.nonzero(have)
    return q, best_i[q, place], best_s[q, place]


def _arrays(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(table["vec_id"]), np.asarray(table["v"].combine_chunks().flatten(), np.int64).reshape(-1, dim)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, head: int = HEAD, wave: int = QUERY_BLOCK, counts: dict | None = None) -> DataFrame:
    """Per query: query_id, rank (from 1), vec_id, score; counts, if given, gets the pairs and what each bound dropped of them."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score long"
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = materialize(integers(vectors), "integers")
    dims = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return empty
    dim = dims["dim"]
    rows = rows.filter(F.size("v") == dim)
    turn = rotation(rows, dim)
    probe = _arrays(rows.orderBy(F.desc("norm2"), "vec_id").limit(PROBE).select("vec_id", "v").toArrow(), dim)
    near = rows.repartitionByRange(partitions(spark), F.desc("norm2")).sortWithinPartitions(F.desc("norm2")).select("vec_id", "v")
    near = materialize(near, "by_norm")
    queries = rows.filter(is_query)
    n_waves = max(1, -(-queries.count() // wave))
    queries = materialize(queries.select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(n_waves)).alias("wave")).distinct(), "queries")
    path, waves = scratch_path(spark, "found"), 0
    totals = {name: spark.sparkContext.accumulator(0) for name in ("pairs", "by_length", "by_partial_sums")}
    for b in range(n_waves):
        own = queries.filter(F.col("wave") == b).select("vec_id", "v").toArrow()
        if not own.num_rows:
            continue
        block = Block(*_arrays(own, dim), turn, min(head, dim), k)
        q, _, s = search(block, iter([probe]), turn)
        full = np.bincount(q, minlength=len(block.ids)) >= k
        least = np.full(len(block.ids), np.inf)
        np.minimum.at(least, q, s.astype(np.float64))
        block.floor = np.where(full, least, -np.inf)
        shared = spark.sparkContext.broadcast((block, turn))  # wave rows

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, turn = shared.value
            seen: dict = {}

            def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for batch in batches:
                    for i in range(0, batch.num_rows, BLOCK):
                        part = batch.slice(i, BLOCK)
                        yield np.asarray(part.column(0)), np.asarray(part.column(1).flatten(), np.int64).reshape(-1, len(turn))

            q, c, s = search(block, chunks(), turn, seen)
            for name, n in seen.items():
                totals[name].add(n)
            for i in range(0, len(q), 8192):
                p = slice(i, i + 8192)
                yield pa.RecordBatch.from_pydict({"query_id": block.ids[q[p]], "vec_id": c[p], "score": s[p]})

        near.mapInArrow(run, schema).write.mode("append").parquet(path)
        shared.destroy()
        waves += 1
    if counts is not None:
        counts.update({name: total.value for name, total in totals.items()})
    if not waves:
        return empty
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
