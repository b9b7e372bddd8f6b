"""Blocks of large texts: cuts at line ends, start lines, Bloom filters, seams.

``blocks`` holds the texts and ``filters`` a narrow table of one Bloom filter
per block, sized by the block's distinct trigrams and stored as 64-bit words,
so a query tests single bits by expressions that stay in the JVM and reads
the texts of the blocks that pass only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

BLOCK_CHARS, SEAM = 1 << 20, 1024
BITS_PER_KEY, HASHES = 10, 4
LEAST_WORDS, MOST_WORDS = 1, 1 << 14  # of 64 bits
BLOCK = "root string, path string, block_no int, start_line int, start_col int, start long, text string, seam string"
FILTER = "root string, path string, block_no int, words array<long>"


def key_hashes(keys: np.ndarray) -> np.ndarray:
    """HASHES 32-bit numbers of each trigram key, by double hashing."""
    k = keys.astype(np.uint64)
    a = (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    b = ((k ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xDA942042E4DD58B5)) >> np.uint64(32) | np.uint64(1)
    return (a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) & np.uint64(0x7FFFFFFF)


def cut(text: str, size: int = BLOCK_CHARS) -> list[tuple[int, int]]:
    """Blocks that end at a line's end, or anywhere if a line is longer than a block; an empty text is one empty block."""
    out, at = [], 0
    while at < len(text) or not out:
        end = min(len(text), at + size)
        if end < len(text) and (line := text.rfind("\n", at, end)) >= 0:
            end = line + 1
        out.append((at, end))
        at = end
    return out


def blocks(files: DataFrame, size: int = BLOCK_CHARS, seam: int = SEAM) -> DataFrame:
    """One row per block, with the text that follows as its seam, so a match over a cut is found in the block it starts in.

    Given a seam of 1 or more, it is empty in the last block of a text and no other; a null text has no block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in BLOCK.split(", ")]
        for batch in batches:
            for k, text in enumerate(batch.column(2)):
                text = text.as_py()
                rows, line, column = [], 1, 1
                for no, (s, e) in enumerate([] if text is None else cut(text, size)):
                    rows.append((no, line, column, s, text[s:e], text[e : e + seam]))
                    line += text.count("\n", s, e)
                    column = e - text.rfind("\n", 0, e)
                if rows:
                    own = pa.array([k] * len(rows))
                    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(own), batch.column(1).take(own), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names
                    )

    return files.select("root", "path", "text").mapInArrow(run, BLOCK)


def filter_words(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of n Bloom filters, and where each starts; row and key are the distinct trigrams of each."""
    count = np.bincount(row, minlength=n)
    want = np.maximum(1, -(-count * BITS_PER_KEY // 64))
    size = np.clip(1 << np.ceil(np.log2(want)).astype(np.int64), LEAST_WORDS, MOST_WORDS)
    at = np.concatenate([[0], np.cumsum(size)])
    bit = key_hashes(key) & (size[row] * 64 - 1).astype(np.uint64)[:, None]
    word = at[row][:, None] + (bit >> np.uint64(6)).astype(np.int64)
    flags = np.zeros(int(at[-1]) * 64, bool)
    flags[(word * 64 + (bit & np.uint64(63)).astype(np.int64)).ravel()] = True
    return np.packbits(flags, bitorder="little").view("<i8"), at


def filters(table: DataFrame) -> DataFrame:
    """The Bloom filter of each block over the trigrams of its text and seam."""
    whole = table.select("root", "path", "block_no", F.concat("text", "seam").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                words, at = filter_words(*tx.trigram_rows(part.column(3)), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(words))], ["root", "path", "block_no", "words"])

    return whole.mapInArrow(run, FILTER)


def pruned(bits: DataFrame, query: str, case_sensitive: bool = True, seam: int = SEAM) -> DataFrame:
    """(root, path, block_no) of blocks whose filter may hold a variant of every trigram of the query; seam is the one the blocks were built with."""
    if len(query) > seam + 1:
        raise ValueError(f"a query of {len(query)} characters may cross a cut unseen: build the blocks with a seam of {len(query) - 1} or more")
    last = F.size("words") * 64 - 1

    def holds(h: int):
        bit = last.bitwiseAND(F.lit(h))
        return F.getbit(F.get("words", F.floor(bit / 64).cast("int")), bit.bitwiseAND(F.lit(63))) == 1

    both = lambda a, b: a & b
    groups = tx.query_groups(query, case_sensitive)
    fits = [reduce(lambda a, b: a | b, [reduce(both, [holds(int(h)) for h in hs]) for hs in key_hashes(np.array(g, np.int64))]) for g in groups]
    return bits.filter(reduce(both, fits, F.lit(True))).select("root", "path", "block_no")


def block_hits(table: DataFrame, bits: DataFrame, query: str, seam: int = SEAM) -> DataFrame:
    """(root, path, start): the offsets at which matches start, overlapping ones too; seam is the one the table was built with."""
    size = len(query)
    chosen = pruned(bits, query, seam=seam)
    near = F.concat("text", F.substring("seam", 1, size - 1)).alias("text")
    found = table.join(chosen, ["root", "path", "block_no"], "left_semi").select("root", "path", "start", near).filter(F.contains("text", F.lit(query)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at = [], []
            for k, (begin, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                spot = text.find(query)
                while spot >= 0:
                    row.append(k)
                    at.append(begin + spot)
                    spot = text.find(query, spot + 1)
            own = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(at, pa.int64())], ["root", "path", "start"])

    return found.mapInArrow(run, "root string, path string, start long")


def block_lines(table: DataFrame, bits: DataFrame, query: str, case_sensitive: bool = True, seam: int = SEAM) -> DataFrame:
    """(root, path, line, col, line_text): the matches in large files, read from the blocks that may hold them.

    A line longer than a block is shown as far as its block and seam reach;
    its column counts from the line's start.
    """
    from . import search

    keys = ["root", "path", "block_no", "start_line", "start_col", "own"]
    chosen = pruned(bits, query, case_sensitive, seam)
    near = table.join(chosen, ["root", "path", "block_no"], "left_semi")
    rest = F.substring_index("seam", "\n", 1)  # what completes the last line, for a match over the cut and for showing
    near = near.withColumn("own", F.length("text")).withColumn("text", F.when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", rest)))
    found = search.hits(near, query, case_sensitive, keys)
    # a match that starts beyond the block is its successor's
    first = F.col("line") == 1
    line, col = F.col("start_line") + F.col("line") - 1, F.when(first, F.col("col") + F.col("start_col") - 1).otherwise(F.col("col"))
    places = near.select("root", "path", "block_no", F.size(tx.lines(F.substring("text", F.lit(1), F.col("own")))).alias("last"), F.length(F.substring_index(F.substring("text", F.lit(1), F.col("own")), "\n", -1)).alias("width"))
    found = found.join(places, ["root", "path", "block_no"]).filter((F.col("line") < F.col("last")) | (F.col("col") <= F.col("width")))
    return found.select("root", "path", line.cast("int").alias("line"), col.cast("int").alias("col"), "line_text")
