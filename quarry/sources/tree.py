"""Reading a directory tree, or rows of any table, as the table of files."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as ps
from ..operators.changes import UNIX_TICKS
from ..plans.storage import materialize, partitions
from . import ignore

SNIFF = 8000
FILES = "root string, path string, text string, size long, mtime_ticks long, content_hash string, encoding string"
BOMS = (
    (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8"),
)


def sniff(content: bytes) -> tuple[str, int] | None:
    """Encoding and length of the byte order mark; None for binary content."""
    for mark, name in BOMS:
        if content.startswith(mark):
            return name, len(mark)
    return None if b"\0" in content[:SNIFF] else ("utf-8", 0)


def decode(content: bytes) -> str | None:
    found = sniff(content)
    return None if found is None else content[found[1] :].decode(found[0], "replace")


LISTED = "path string, size long, mtime_us long, is_dir boolean, error string"


def _children(folder: str, names: set[str], retry: float) -> list[tuple]:
    """One folder's entries as (full path, size, mtime_us, is_dir, error); links and ignored folders are left out."""
    from pyarrow import fs

    at, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    scheme = folder.split("://", 1)[0] + "://" if "://" in folder else ""
    for attempt in (0, 1):
        try:
            found = at.get_file_info(fs.FileSelector(path))
            break
        except FileNotFoundError:
            return []  # it vanished
        except OSError as e:
            if attempt:
                return [(folder, 0, 0, True, str(e)[:200])]
            time.sleep(retry)  # a share may answer the second time
    out = []
    for f in found:
        name = f.path.rsplit("/", 1)[-1]
        if scheme in ("", "file://") and os.path.islink(f.path):
            continue
        if f.type == fs.FileType.Directory:
            if name.lower() not in names:
                out.append((folder.rstrip("/") + "/" + name, 0, 0, True, None))
        elif f.type == fs.FileType.File:
            out.append((folder.rstrip("/") + "/" + name, f.size, (f.mtime_ns or 0) // 1000, False, None))
    return out


def listing(
    spark: SparkSession, root: str, max_bytes: int = ps.MAX_FILE_BYTES, extra_ignored: list[str] | None = None, keep: list[str] | None = None,
    use_ignore_files: bool = True, under: str = "",
) -> DataFrame:
    """(path, size, mtime_us, full): the files that belong to the index; no content but that of ignore files is opened.

    Folders are listed level by level, each level spread over the executors,
    and ignored folders are never entered.  under keeps one sub-tree; the
    ignore files above it still hold.
    """
    base = root.rstrip("/")
    skip = {d.lower() for d in [*ps.IGNORED_DIRS, *(extra_ignored or [])]} - {d.lower() for d in keep or []}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for f in batch.column(0).to_pylist() for r in _children(f, skip, 0.075)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in LISTED.split(", ")])

    wanted = [base + "/" + "/".join(under.split("/")[:k]) for k in range(1, len(under.split("/")))] if under else []
    level, found = spark.createDataFrame([(base,)], "path string"), None
    while True:
        here = materialize(level.repartition(partitions(spark)).mapInArrow(run, LISTED), "listing")
        found = here if found is None else found.unionByName(here)
        level = here.filter("is_dir and error is null").select("path")
        if under:
            level = level.filter(F.col("path").isin([*wanted, f"{base}/{under}"]) | F.col("path").startswith(f"{base}/{under}/"))
        if not level.limit(1).count():
            break
    full = F.col("path")
    rows = found.filter("not is_dir").select(F.substring("path", len(base) + 2, 1 << 20).alias("path"), "size", "mtime_us", full.alias("full"))
    rows = rows.filter(~ps.ignored_file(F.col("path"), F.col("size"), max_bytes))
    if use_ignore_files:
        rules: dict[str, list[ignore.Rule]] = {}
        own = _contents(rows.filter(ps.basename(F.col("path")).isin(".gitignore", ".ignore"))).select("path", F.decode("content", "UTF-8").alias("t")).collect()
        for r in sorted(own, key=lambda r: r["path"].rsplit("/", 1)[-1]):  # .gitignore first, so .ignore wins
            rules.setdefault(r["path"].rpartition("/")[0], []).extend(ignore.parse(r["t"]))
        rows = ignore.not_ignored(rows, rules)
    if under:
        rows = rows.filter((F.col("path") == under) | F.col("path").startswith(f"{under}/"))
    return rows


def dropped(spark: SparkSession, root: str, extra_ignored: list[str] | None = None) -> DataFrame:
    """(path, error): folders that couldn't be listed twice; those that vanished aren't counted."""
    skip = {d.lower() for d in [*ps.IGNORED_DIRS, *(extra_ignored or [])]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for f in batch.column(0).to_pylist() for r in _children(f, skip, 0.075) if r[3]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.string())], ["path", "error"])

    level, out = spark.createDataFrame([(root.rstrip("/"),)], "path string"), None
    while True:
        here = materialize(level.repartition(partitions(spark)).mapInArrow(run, "path string, error string"), "folders")
        bad = here.filter("error is not null")
        out = bad if out is None else out.unionByName(bad)
        level = here.filter("error is null").select("path")
        if not level.limit(1).count():
            return out


def _contents(rows: DataFrame) -> DataFrame:
    """rows with a column full, and content: each file's bytes, read where the row is; a file that vanished has no row."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            at_full = batch.schema.get_field_index("full")
            for k, name in enumerate(batch.column(at_full).to_pylist()):
                try:
                    at, path = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
                    with at.open_input_stream(path) as f:
                        content = f.read()
                except OSError:
                    continue
                one = batch.slice(k, 1)  # a file a batch: memory follows the largest file
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([content], pa.binary())], [*names, "content"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", content binary")


def read_tree(
    spark: SparkSession, root: str, max_bytes: int = ps.MAX_FILE_BYTES, extra_ignored: list[str] | None = None, keep: list[str] | None = None,
    use_ignore_files: bool = True, under: str = "",
) -> DataFrame:
    """The text files under root as (root, path, text, size, mtime_ticks, content_hash, encoding); listed first, then only these are opened."""
    base = root.rstrip("/")
    rows = listing(spark, base, max_bytes, extra_ignored, keep, use_ignore_files, under)
    rows = rows.select("path", "size", (F.col("mtime_us") * 10 + F.lit(UNIX_TICKS)).alias("mtime_ticks"), "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, size, ticks, content in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                kind = sniff(content)
                if kind:
                    out.append((base, path, content[kind[1] :].decode(kind[0], "replace"), size, ticks, xxhash.xxh3_128_hexdigest(content).upper(), kind[0]))
            if out:
                names = [c.split()[0] for c in FILES.split(", ")]
                kinds = [pa.int64() if c.endswith(" long") else pa.string() for c in FILES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return _contents(rows.repartition(partitions(spark))).mapInArrow(run, FILES)


def from_rows(rows: DataFrame, root: Column, path: Column, text: Column) -> DataFrame:
    """Any table as files; the hash is over the text's bytes."""
    return rows.select(root.alias("root"), path.alias("path"), text.alias("text")).withColumns(
        {"size": F.octet_length("text").cast("long"), "content_hash": F.upper(F.md5("text"))}
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A text file's lines, split by Spark so that large files spread over tasks."""
    return spark.read.text(path, lineSep="\n").withColumnRenamed("value", "line_text")


def load_config(text: str, env: dict[str, str] | None = None) -> dict:
    """JSON with comments; environment variables QUARRY_<NAME> win over the file."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.DOTALL)
    bare = re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], bare)
    got = json.loads(bare) if bare.strip() else {}
    for k, v in (env if env is not None else os.environ).items():
        if k.startswith("QUARRY_"):
            got["".join(w if i == 0 else w.capitalize() for i, w in enumerate(k[7:].lower().split("_")))] = v
    return got
