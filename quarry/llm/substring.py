"""Substring dedup by difference-cover anchors.

A set D of residues modulo a period v is a difference cover when every
difference modulo v is a difference of two members.  For any two positions
i, j there is then a shift below v that puts both on cover positions, so if
two documents share ``width`` words, they share an anchor (a window of
width - v + 1 words) that starts on a cover position in both.  Only anchors
are hashed at first, 6 of 31 windows.  Anchors held by two documents are
extended: the full windows around them are hashed with 96 bits, the least
doc_id of each window is found, and in every other document the words of that
window go.

Counts and minima are pre-aggregated before they are shuffled; the joins that
bring them back to the documents are between plain tables, so AQE splits
passages that very many documents share.  No pairs are formed.

Defined results: a null or empty text has no words; a document of fewer words
than the window keeps all; rows with a null doc_id keep all and remove
nothing; repeated rows of one doc_id count as one document; texts are taken
whole whatever their length; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, materialize
from .kernel import Words, ragged, run_hash, slices

WIDTH = 50
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)


def is_cover(cover: tuple[int, ...], period: int) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _anchors(words: Words, hashes: np.ndarray, width: int, period: int, cover: tuple[int, ...]) -> np.ndarray:
    """Word indexes of the slice where anchors start, in order."""
    at = words.windows(width - period + 1)
    on = np.zeros(period, bool)
    on[list(cover)] = True
    return at[on[(at - words.first[words.doc[at]]) % period]]


def _joined(words: Words, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """The words of each document joined by one space: all bytes, and the offsets of documents (each ends with one space more)."""
    start, length = words.start, words.end - words.start
    first = words.first
    if keep is not None:
        first = np.concatenate([[0], np.cumsum(keep)])[first]
        start, length = start[keep], length[keep]
    upto = np.concatenate([[0], np.cumsum(length + 1)])
    out = np.full(int(upto[-1]), 32, np.uint8)
    own = np.ones(len(out), bool)
    own[upto[1:] - 1] = False
    out[own] = words.data[ragged(start, length)]
    return out.tobytes(), upto[first]


def _digests(raw: bytes, at: np.ndarray) -> list[str]:
    a = at.tolist()
    return [hashlib.sha256(raw[p : q - 1] if q > p else b"").hexdigest() for p, q in zip(a, a[1:])]


def _lists(flat: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def scan(docs: DataFrame, width: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """Per row: doc_id, key (a hash of the text), n_words, the hash of its words and its anchors' hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(2)):
                words = Words(data, off)
                hashes = words.hashes()
                at = _anchors(words, hashes, width, period, cover)
                values = run_hash(hashes, width - period + 1)[at].view(np.int64)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(i, j - i),
                        "key": batch.column(1).slice(i, j - i),
                        "n_words": words.count.astype(np.int64),
                        "sha": _digests(*_joined(words)),
                        "anchors": _lists(values, np.searchsorted(at, words.first)),
                    }
                )

    return _keyed(docs).mapInArrow(run, "doc_id long, key int, n_words long, sha string, anchors array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("key"), "text")


def _at_documents(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts beside the lists of their (doc_id, key)."""
    return _keyed(docs).join(lists, ["doc_id", "key"])


def windows(docs: DataFrame, lists: DataFrame, width: int, period: int, cover: tuple[int, ...]) -> DataFrame:
    """Extend anchors: per document the full windows that hold a listed anchor, with 96-bit hashes.

    lists has, per (doc_id, key), shared: indexes of shared anchors, and
    later: which of them a smaller document holds too.  A window without an
    anchor of the second kind can't be removed and is marked as a witness only.
    """
    reach = period - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, later = batch.column(3), batch.column(4)
            for i, j, data, off in slices(batch.column(2)):
                words = Words(data, off)
                hashes = words.hashes()
                at = _anchors(words, hashes, width, period, cover)
                base = np.searchsorted(at, words.first)
                n = len(words.start)
                marks = []
                for column in (shared, later):
                    own = column.slice(i, j - i)
                    counts = np.asarray(own.value_lengths().fill_null(0))
                    picked = at[np.asarray(own.flatten(), np.int64) + np.repeat(base[:-1], counts)]
                    low = np.maximum(picked - reach, words.first[words.doc[picked]])
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, low, 1)
                    np.add.at(step, picked + 1, -1)
                    marks.append(np.cumsum(step)[:n] > 0)
                full = words.windows(width)
                full = full[marks[0][full]]
                upto = np.searchsorted(full, words.first)
                place = (full - words.first[words.doc[full]]) << 1 | marks[1][full]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(i, j - i),
                        "key": batch.column(1).slice(i, j - i),
                        "at": _lists(place.astype(np.int32), upto),
                        "h1": _lists(run_hash(hashes, width)[full].view(np.int64), upto),
                        "h2": _lists(run_hash(hashes, width, 7)[full].view(np.int64).astype(np.int32), upto),
                    }
                )

    return _at_documents(docs, lists).mapInArrow(run, "doc_id long, key int, at array<int>, h1 array<long>, h2 array<int>")


def cut(docs: DataFrame, lists: DataFrame, width: int, texts: bool = False) -> DataFrame:
    """Per listed document: n_removed and the hash of the words kept, or the kept words themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(2)):
                words = Words(data, off)
                own = batch.column(3).slice(i, j - i)
                counts = np.asarray(own.value_lengths().fill_null(0))
                begin = np.asarray(own.flatten(), np.int64) + np.repeat(words.first[:-1], counts)
                step = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, begin + width, -1)
                keep = np.cumsum(step)[:-1] == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[words.first]
                raw, at = _joined(words, keep)
                a = at.tolist()
                out = {"doc_id": batch.column(0).slice(i, j - i), "key": batch.column(1).slice(i, j - i), "n_removed": words.count - np.diff(kept)}
                out["kept"] = [raw[p : max(p, q - 1)].decode() for p, q in zip(a, a[1:])] if texts else _digests(raw, at)
                yield pa.RecordBatch.from_pydict(out)

    return _at_documents(docs, lists).mapInArrow(run, "doc_id long, key int, n_removed long, kept string").dropDuplicates(["doc_id", "key"])


def repeats(docs: DataFrame, width: int = WIDTH, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> tuple[DataFrame, DataFrame]:
    """The scanned documents, and per document (doc_id, key) the starts of windows to remove."""
    assert is_cover(cover, period) and width >= period
    spark = docs.sparkSession
    scanned = materialize(scan(docs, width, period, cover), "anchors")
    base = materialize(scanned.drop("anchors"), "documents")
    # a copy of a smaller document's whole word sequence goes entirely and witnesses nothing
    heads = materialize(base.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("head")), "heads")
    first = heads.select(F.col("head").alias("doc_id")).distinct()
    lone = scanned.join(first, "doc_id", "left_semi").select("doc_id", "key", F.posexplode("anchors").alias("i", "h"))
    lone = lone.select("doc_id", _pack("key", "i").alias("place"), "h")
    shared = lone.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("h", "low")
    shared = materialize(shared, "shared")
    delete(spark)
    own, index = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    lists = lone.join(shared, "h").groupBy("doc_id", own.alias("key")).agg(
        F.array_sort(F.collect_set(index)).alias("shared"), F.array_sort(F.collect_set(F.when(F.col("doc_id") > F.col("low"), index))).alias("later")
    )
    lists = materialize(lists, "lists")
    del lone
    delete(spark, shared, scanned)
    found = materialize(windows(docs, lists, width, period, cover), "windows")
    delete(spark, lists)
    each = found.select("doc_id", "key", F.explode(F.arrays_zip("at", "h1", "h2")).alias("w")).select(
        "doc_id", "w.h1", "w.h2", _pack("key", F.col("w.at")).alias("place")
    )
    least = each.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n")
    least = materialize(least, "least")
    delete(spark)
    gone = each.filter(F.col("place").bitwiseAND(F.lit(1)) == 1).join(least, ["h1", "h2"]).filter("doc_id > low")
    starts = gone.groupBy("doc_id", own.alias("key")).agg(F.collect_set(F.shiftright(index, 1)).alias("starts"))
    starts = materialize(starts, "starts")
    del each, gone
    delete(spark, found, least)
    base = base.join(heads, "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("head"), F.lit(False)) & (F.col("n_words") >= width))
    return base.drop("head"), starts


def _pack(key: str, at: str | Column) -> Column:
    """Two integers in one long."""
    return F.shiftleft(F.col(key).cast("long"), 32).bitwiseOR((F.col(at) if isinstance(at, str) else at).cast("long"))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256."""
    scanned, starts = repeats(docs, **options)
    removed = cut(docs, starts, options.get("width", WIDTH))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return scanned.join(removed, ["doc_id", "key"], "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), none).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def dedup(docs: DataFrame, **options) -> DataFrame:
    """docs with repeated passages cut from text; a changed text has its kept words joined by one space."""
    scanned, starts = repeats(docs, **options)
    copies = scanned.filter("copy").select("doc_id", "key", F.lit("").alias("kept"))
    removed = cut(docs, starts, options.get("width", WIDTH), texts=True).select("doc_id", "key", "kept")
    removed = removed.union(copies.distinct()).toDF("_id", "_key", "_kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("_doc"), F.hash("text").alias("_at"))
    joined = rows.join(removed, (F.col("_doc") == F.col("_id")) & (F.col("_at") == F.col("_key")), "left")
    return joined.select(*[F.coalesce("_kept", "row.text").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS pos FROM d WHERE len(w) >= 50),
k AS (SELECT p.doc_id, p.pos, min(p.doc_id) OVER (PARTITION BY md5(array_to_string(d.w[p.pos:p.pos + 49], ' '))) AS low FROM p JOIN d USING (doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM k WHERE doc_id > low),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
r AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.pos) AS kept, count(*) AS n FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.pos = g.pos GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(r.n, 0))::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
