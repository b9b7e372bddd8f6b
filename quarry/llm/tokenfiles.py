"""Token ids as flat binary files with 64-bit document offsets.

A folder holds, for each range partition of doc_id, ``NAME.ids`` (unsigned
integers, 16 bits if the vocabulary allows it, else 32, little-endian),
``NAME.offsets`` (unsigned 64-bit; n + 1 offsets counted over the whole
collection) and ``NAME.docs`` (signed 64-bit doc ids), and a ``manifest.json``
with the parts in order.  Tasks write ids under names of their own attempt and
report counts; the bases of the parts are the prefix sums of those counts (one
number per partition), and a second pass writes the offsets.  A lost or
repeated task leaves only files that the manifest doesn't name.

Defined results: a null or empty text holds only the end id; a null doc_id
sorts first and is marked in ``NAME.nulls`` (one byte a document, only where
there are any), so every 64-bit id reads back as itself; repeated doc ids stand
side by side; texts of any length are encoded whole; other columns aren't
read; an empty table gives a manifest without parts.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, scratch_path
from .kernel import SpanCache, Words, slices

NO_ID = -(1 << 63)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of whole texts from the tokenizers library, one call per distinct word and task.

    The normaliser and the pattern never join what white space separates, so
    a text's ids are those of its words in turn.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.words = SpanCache()

    def _fresh(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the documents of a slice, end_id after each, and each document's count."""
        words = Words(data, offsets)
        ids, length = self.words.lists(data, words.start, words.end, self._fresh)
        upto = np.concatenate([[0], np.cumsum(length)])
        of_doc = np.diff(upto[words.first])
        out = np.full(int(of_doc.sum()) + len(of_doc), end_id, np.uint32)
        last = np.cumsum(of_doc + 1) - 1
        own = np.ones(len(out), bool)
        own[last] = False
        out[own] = ids
        return out, of_doc + 1


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def store(folder: str):
    """The file system of a folder and the folder's path in it."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder)


def mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the store is a local or mounted folder, else read."""
    from pyarrow import fs

    at, path = store(folder)
    if isinstance(at, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}", dtype, "r") if os.path.getsize(f"{path}/{name}") else np.zeros(0, dtype)
    with at.open_input_file(f"{path}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def _put(folder: str, name: str, data: bytes) -> None:
    at, path = store(folder)
    with at.open_output_stream(f"{path}/{name}") as f:
        f.write(data)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 1) -> dict:
    """Encode docs and write the files; returns the manifest."""
    spark, path = docs.sparkSession, path or default_path()
    at, local = store(folder)
    at.create_dir(local, recursive=True)

    def put_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, part = encoder(path), TaskContext.get().partitionId()
        name, kind = f"part-{part:06d}-{uuid.uuid4().hex[:12]}", f"<u{encoder(path).width}"
        fs_, base = store(folder)
        counts, ids, nulls, out = [], [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or fs_.open_output_stream(f"{base}/{name}.ids")
            for _, _, data, off in slices(batch.column(1)):
                flat, n = tool.encode(data, off, end_id)
                out.write(flat.astype(kind).tobytes())
                counts.append(n)
            ids.append(np.asarray(batch.column(0).fill_null(NO_ID), "<i8"))
            nulls.append(np.asarray(batch.column(0).is_null()))
        if out:
            out.close()
            counts = np.concatenate(counts)
            _put(folder, f"{name}.counts", counts.astype("<u8").tobytes())
            _put(folder, f"{name}.docs", np.concatenate(ids).tobytes())
            if np.concatenate(nulls).any():
                _put(folder, f"{name}.nulls", np.concatenate(nulls).astype("u1").tobytes())
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_docs": [len(counts)], "n_tokens": [int(counts.sum())]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    parts = sorted(rows.mapInArrow(put_ids, "part long, name string, n_docs long, n_tokens long").collect())
    base, listed = 0, []
    for r in parts:
        listed.append({"name": r["name"], "n_docs": r["n_docs"], "n_tokens": r["n_tokens"], "base": base})
        base += r["n_tokens"]

    def put_offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                counts = mapped(folder, f"{r['name']}.counts", "<u8")
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype("<u8") + np.uint64(r["base"])
                _put(folder, f"{r['name']}.offsets", offsets.tobytes())
                del counts
                at, base = store(folder)
                at.delete_file(f"{base}/{r['name']}.counts")
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    if listed:
        _parts(spark, listed).mapInArrow(put_offsets, "n long").collect()
    manifest = {"dtype": f"<u{encoder(path).width}", "end_id": end_id, "n_tokens": base, "parts": listed}
    _put(folder, "manifest.json", json.dumps(manifest).encode())
    return manifest


def _parts(spark: SparkSession, listed: list[dict]) -> DataFrame:
    rows = [(p["name"], p["base"]) for p in listed]
    return spark.createDataFrame(rows, "name string, base long").repartition(len(rows))


def read(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """Per document of the files, in order: doc_id, start, n_tokens, and ids or the crc32 of the ids as 32-bit integers."""
    at, local = store(folder)
    with at.open_input_file(f"{local}/manifest.json") as f:
        manifest = json.loads(f.read())
    kind, last = manifest["dtype"], "ids_crc32 long" if digest else "ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, off, docs = (mapped(folder, f"{r['name']}.{x}", t) for x, t in (("ids", kind), ("offsets", "<u8"), ("docs", "<i8")))
                off, base = off.astype(np.int64), int(off[0])
                fs_, at = store(folder)
                marked = fs_.get_file_info(f"{at}/{r['name']}.nulls").is_file
                gone = mapped(folder, f"{r['name']}.nulls", "u1").astype(bool) if marked else np.zeros(len(docs), bool)
                for i in range(0, len(docs), 4096):
                    j = min(i + 4096, len(docs))
                    own = off[i : j + 1] - base
                    part = np.asarray(ids[own[0] : own[-1]])
                    own = own - own[0]
                    out = {"doc_id": pa.array(docs[i:j], mask=gone[i:j]), "start": off[i:j], "n_tokens": np.diff(own)}
                    if digest:
                        wide, b = part.astype("<u4").tobytes(), (own * 4).tolist()
                        out["ids_crc32"] = pa.array([zlib.crc32(wide[p:q]) for p, q in zip(b, b[1:])], pa.int64())
                    else:
                        out["ids"] = pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(part.astype(np.int32)))
                    yield pa.RecordBatch.from_pydict(out)

    schema = f"doc_id long, start long, n_tokens long, {last}"
    if not manifest["parts"]:
        return spark.createDataFrame([], schema)
    return _parts(spark, manifest["parts"]).mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """Write docs to files in the shared folder and report each document from them."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write(docs, folder, path, end_id)
    return read(docs.sparkSession, folder, digest=True)
