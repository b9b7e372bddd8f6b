"""Literal search: scan, trigram postings, candidates, verification, caps."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

PER_FILE = 64


PART = 4 << 20  # bytes of text whose trigrams are formed at once


def postings(files: DataFrame, keys: list[str] | None = None, only: list[int] | None = None) -> DataFrame:
    """(keys..., tri): one row per file and distinct trigram, or per wanted one with only; keys are unique."""
    keys = keys or ["root", "path"]
    rows = files.select(*keys, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, i = batch.column(len(keys)), 0
            size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)))
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + PART, "right")))
                row, tri = tx.trigram_rows(texts.slice(i, j - i), only)
                for k in range(0, len(tri), 1 << 18):
                    at = pa.array(row[k : k + (1 << 18)] + i)
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(len(keys))), pa.array(tri[k : k + (1 << 18)])], [*keys, "tri"])
                i = j

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", tri long")


def trigram_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("tri").agg(F.count("*").alias("df"))


def candidates(posts: DataFrame, query: str, case_sensitive: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Files that hold a variant of every trigram of the query: a superset of the matching files.

    The keys reach the scan as an IN filter; one aggregate divides by the number of groups.
    """
    keys = keys or ["root", "path"]
    groups = tx.query_groups(query, case_sensitive)
    flat = sorted({k for g in groups for k in g})
    hits = posts.filter(F.col("tri").isin(flat))
    seen = [F.max(F.when(F.col("tri").isin(g), 1).otherwise(0)).alias(f"g{i}") for i, g in enumerate(groups)]
    all_seen = reduce(lambda a, b: a & b, [F.col(f"g{i}") == 1 for i in range(len(groups))], F.lit(True))
    return hits.groupBy(*keys).agg(*seen).filter(all_seen).select(*keys)


def hits(files: DataFrame, query: str, case_sensitive: bool = True, keys: list[str] | None = None) -> DataFrame:
    """(keys..., line, col, line_text): every match of the query; a query of white space matches nothing.

    Files are filtered by containment before their lines are formed, so only
    matching texts are split.  A query with line ends is matched over whole texts.
    """
    keys = keys or ["root", "path"]
    if not query.strip():
        return files.limit(0).select(*keys, F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit("").alias("line_text"))
    needle = query if case_sensitive else tx.fold_str(query)
    view = (lambda c: c) if case_sensitive else tx.fold
    found = files.filter(F.contains(view(F.col("text")), F.lit(needle)))
    if "\n" in query:
        parts = F.split(view(F.col("text")), tx.quoted(needle), -1)
        rows = found.select(*keys, "text", F.posexplode(F.slice(parts, 1, F.size(parts) - 1)).alias("k", "part"))
        order = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("end", F.sum(F.length("part")).over(order) + F.col("k") * len(needle))
        before = F.substring(F.col("text"), F.lit(1), F.col("end"))
        line = F.size(tx.lines(before))
        column = F.length(F.substring_index(before, "\n", -1)) + 1
        return rows.select(*keys, line.alias("line"), column.cast("int").alias("col"), tx.shown_line(F.get(tx.lines(F.col("text")), line - 1)).alias("line_text"))
    rows = found.select(*keys, F.posexplode(tx.lines(F.col("text"))).alias("at", "line_text"))
    rows = rows.filter(F.contains(view(F.col("line_text")), F.lit(needle)))
    rows = rows.withColumn("col", F.explode(tx.match_columns(view(F.col("line_text")), needle)))
    return rows.select(*keys, (F.col("at") + 1).cast("int").alias("line"), "col", tx.shown_line(F.col("line_text")).alias("line_text"))


def indexed_hits(files: DataFrame, posts: DataFrame, query: str, case_sensitive: bool = True, keys: list[str] | None = None) -> DataFrame:
    """The same rows by way of the postings: candidates first, then verification."""
    keys = keys or ["root", "path"]
    chosen = candidates(posts, query, case_sensitive, keys)
    return hits(files.join(chosen, keys, "left_semi"), query, case_sensitive, keys)


def query_keys(query: str, case_sensitive: bool = True) -> list[int]:
    """All trigram keys that a query asks for."""
    return sorted({k for g in tx.query_groups(query, case_sensitive) for k in g})


def per_file_cap(rows: DataFrame, cap: int = PER_FILE, keys: list[str] | None = None) -> DataFrame:
    """At most cap rows per file by line and column, and whether the file had more."""
    keys = keys or ["root", "path"]
    own = Window.partitionBy(*keys)
    placed = rows.withColumn("_n", F.row_number().over(own.orderBy("line", "col"))).filter(F.col("_n") <= cap + 1)
    return placed.withColumn("capped", F.max("_n").over(own) > cap).filter(F.col("_n") <= cap).drop("_n")


def clamp(requested: int) -> int:
    return max(1, min(1000, requested))


def cap(rows: DataFrame, order: list[str | Column], limit: int) -> tuple[DataFrame, bool]:
    """The first rows of the order, and whether there are more; the query runs once, and limit + 1 rows at most are kept."""
    probe = rows.orderBy(*order).limit(limit + 1)
    found = probe.toArrow()
    spark = rows.sparkSession
    kept = spark.createDataFrame(found.slice(0, limit), probe.schema) if found.num_rows else spark.createDataFrame([], probe.schema)
    return kept, found.num_rows > limit


def whole_words(rows: DataFrame, size: int) -> DataFrame:
    return rows.filter(tx.whole_word(F.col("line_text"), F.col("col"), size))


RAREST = 3  # trigrams of a probe that a candidate must hold before texts are compared


def batch_contains(texts: DataFrame, probes: DataFrame, text_key: str, probe_key: str) -> DataFrame:
    """Which texts hold which probe texts literally: (probe_key, text_key).

    Each probe is looked up by its rarest trigrams, ids only; pairs that hold
    all of them are verified by containment.  Probes of one or two characters
    have no trigram and are looked for in every text, as a set; empty probes
    match nothing.
    """
    grams = postings(texts.select(text_key, "text"), [text_key])
    wanted = postings(probes.select(probe_key, "text"), [probe_key])
    freq = grams.join(wanted.select("tri").distinct(), "tri", "left_semi").groupBy("tri").agg(F.count("*").alias("df"))
    order = Window.partitionBy(probe_key).orderBy("df", "tri")
    scored = wanted.join(freq, "tri", "left").select(probe_key, "tri", F.coalesce("df", F.lit(0)).alias("df"))
    rare = scored.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= RAREST)
    held = rare.join(grams, "tri").groupBy(probe_key, text_key).agg(F.count("*").alias("_n"))
    asked = rare.groupBy(probe_key).agg(F.count("*").alias("_k"))
    pairs = held.join(asked, probe_key).filter(F.col("_n") == F.col("_k")).select(probe_key, text_key)
    short = probes.filter(F.length("text").isin(1, 2)).select(probe_key, F.col("text").alias("_short"))
    starts = F.sequence(F.lit(1), F.length("text"))
    pieces = F.concat(*[F.transform(starts, part) for part in (lambda i: F.substring(F.col("text"), i, F.lit(1)), lambda i: F.substring(F.col("text"), i, F.lit(2)))])
    pieces = F.array_distinct(pieces)
    spread = texts.filter(F.length("text") > 0).select(text_key, F.explode(pieces).alias("_short"))
    found = short.join(spread, "_short").select(probe_key, text_key)
    full = pairs.join(probes.select(probe_key, F.col("text").alias("_probe")), probe_key).join(texts.select(text_key, F.col("text").alias("_text")), text_key)
    return full.filter(F.contains("_text", F.col("_probe"))).select(probe_key, text_key).union(found)
