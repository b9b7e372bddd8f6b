"""The published index: versioned tables, one manifest per version.

A version is complete before its manifest exists, and a manifest is renamed
into place only if no other writer has taken its number: of two writers that
started from one version the second fails and may try again.  Readers take
the newest readable manifest once per query.  An update writes the new
segment's rows and the tombstones of the rows it replaces; readers drop dead
rows by an anti-join on path and segment, and compaction rewrites live rows.

Files of more than ``LARGE`` characters are also kept as blocks with Bloom
filters, so that a search reads the blocks that may hold a match, not the
whole texts.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks, search, symbols

TABLES = ("files", "postings", "symbols", "calls", "spans", "blocks", "filters")
COMPACT_AT = 64
FORMAT = 2
LARGE = blocks.BLOCK_CHARS
LOCK_SECONDS = 600
KEEP_VERSIONS = 2


class Conflict(RuntimeError):
    """Another writer published first, or holds the lock."""


class Index:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    # small files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _put(self, path: str, text: str, replace: bool = True) -> None:
        """Write beside the target, then rename: over it, or only if it doesn't exist."""
        jvm = self.spark.sparkContext._jvm
        tmp = f"{path}.{uuid.uuid4().hex[:8]}"
        fs, p = self._fs(tmp)
        out = fs.create(p, True)
        out.write(text.encode())
        out.close()
        mode = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(mode, 1)
        options[0] = mode.OVERWRITE if replace else mode.NONE
        target = self._fs(path)[1]
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(p, target, options)
        except Exception as e:
            fs.delete(p, False)
            if not replace and fs.exists(target):
                raise Conflict(f"{path} was written by another writer") from e
            raise

    def _get(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _manifests(self) -> list[str]:
        return sorted((n for n in self._names(self.folder) if n.startswith("manifest-") and n.endswith(".json")), reverse=True)

    def manifest(self) -> dict:
        """The newest readable version, else an empty one."""
        for name in self._manifests():
            try:
                return json.loads(self._get(f"{self.folder}/{name}") or "")
            except ValueError:
                continue  # cut off: the version before it holds
        return {"version": 0, "segments": [], "tombstones": [], "next": 1, "stale": []}

    def _publish(self, m: dict, old: dict, **more) -> dict:
        m = {"tombstones": [], "stale": [], "format": FORMAT, "built": int(time.time()), **m, "version": old["version"] + 1, **more}
        self._put(f"{self.folder}/manifest-{m['version']:09d}.json", json.dumps(m), replace=False)
        return m

    def meta(self) -> dict:
        """What a status file would say: version, format, when it was built, segments and whether anything is stale."""
        m = self.manifest()
        return {k: m.get(k) for k in ("version", "format", "built", "stale")} | {"segments": len(m["segments"]), "state": "ready" if m["segments"] else "empty"}

    def mark_stale(self, reason: str) -> None:
        """Say in a new version that answers may be behind: lost events, changed ignore files."""
        m = self.manifest()
        if reason not in m["stale"]:
            self._publish({**m, "stale": [*m["stale"], reason]}, m)

    # one writer

    def lock(self, owner: str, now: float | None = None) -> None:
        """Become the writer; a lock that wasn't renewed for LOCK_SECONDS is taken over."""
        now = time.time() if now is None else now
        path, mine = f"{self.folder}/writer.json", json.dumps({"owner": owner, "at": now})
        held = json.loads(self._get(path) or "null")
        if held and held["owner"] != owner and now - held["at"] < LOCK_SECONDS:
            raise Conflict(f"{held['owner']} writes here")
        self._put(path, mine, replace=bool(held))

    def unlock(self, owner: str) -> None:
        path = f"{self.folder}/writer.json"
        held = json.loads(self._get(path) or "null")
        if held and held["owner"] == owner:
            fs, p = self._fs(path)
            fs.delete(p, False)

    # writing

    def _write(self, files: DataFrame) -> str:
        """A segment's tables; its name is its own, so writers never meet."""
        segment = f"{int(time.time()):010d}-{uuid.uuid4().hex[:8]}"
        at = f"{self.folder}/segments/{segment}"
        files.write.parquet(f"{at}/files")
        files = self.spark.read.parquet(f"{at}/files")
        posts = search.postings(files)
        # a common trigram's list is cut by path, so it is no task of its own
        posts.repartitionByRange("tri", "path").sortWithinPartitions("tri", "path").write.option("parquet.bloom.filter.enabled#tri", "true").parquet(f"{at}/postings")
        symbols.extract(files).sort("name").write.parquet(f"{at}/symbols")
        symbols.calls(files).write.parquet(f"{at}/calls")
        symbols.spans(files).write.parquet(f"{at}/spans")
        blocks.blocks(files.filter(F.length("text") > LARGE)).write.parquet(f"{at}/blocks")
        blocks.filters(self.spark.read.schema(blocks.BLOCK).parquet(f"{at}/blocks")).write.parquet(f"{at}/filters")
        return segment

    def build(self, files: DataFrame, **more) -> dict:
        old = self.manifest()
        return self._publish({"segments": [self._write(files)]}, old, **more)

    def apply(self, upserts: DataFrame, deletes: DataFrame) -> dict:
        """Replace the files of upserts, drop those of deletes (root, path); earlier segments keep their files."""
        old = self.manifest()
        if not old["segments"]:
            return self.build(upserts)
        dead = upserts.select("root", "path").unionByName(deletes.select("root", "path")).distinct()
        name = f"{old['version'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        held = self._segments("files", old).select("root", "path", "segment")
        held.join(dead, ["root", "path"], "left_semi").write.parquet(f"{self.folder}/tombstones/{name}")
        segment = self._write(upserts)
        m = self._publish({**old, "segments": [*old["segments"], segment], "tombstones": [*old["tombstones"], name]}, old)
        return self.compact() if len(m["segments"]) >= COMPACT_AT else m

    def compact(self) -> dict:
        old = self.manifest()
        return self._publish({"segments": [self._write(self.table("files"))]}, old)

    def clean(self) -> list[str]:
        """Remove what no kept version names: segments and tombstones of failed or replaced writes, older manifests, half-written files."""
        kept = self._manifests()[:KEEP_VERSIONS]
        named = [json.loads(self._get(f"{self.folder}/{n}") or "{}") for n in kept]
        live = {f"segments/{s}" for m in named for s in m.get("segments", [])} | {f"tombstones/{t}" for m in named for t in m.get("tombstones", [])}
        found = [f"{d}/{n}" for d in ("segments", "tombstones") for n in self._names(f"{self.folder}/{d}")]
        gone = [f for f in found if f not in live] + self._manifests()[KEEP_VERSIONS:] + [n for n in self._names(self.folder) if n.rsplit(".", 1)[0].endswith(".json")]
        for f in gone:
            fs, p = self._fs(f"{self.folder}/{f}")
            fs.delete(p, True)
        return gone

    # reading

    def _segments(self, name: str, m: dict) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.folder}/segments/{s}/{name}").withColumn("segment", F.lit(s)) for s in m["segments"]]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows

    def table(self, name: str) -> DataFrame:
        """The live rows of a table."""
        m = self.manifest()
        if not m["segments"]:
            raise LookupError("nothing is indexed here yet; build() first")
        rows = self._segments(name, m)
        if m["tombstones"]:
            dead = self.spark.read.parquet(*[f"{self.folder}/tombstones/{t}" for t in m["tombstones"]])
            rows = rows.join(dead, ["root", "path", "segment"], "left_anti")
        return rows.drop("segment")

    def sizes(self) -> DataFrame:
        """(segment, part, bytes) of the current version, largest first."""
        rows = []
        for s in self.manifest()["segments"]:
            for t in TABLES:
                fs, p = self._fs(f"{self.folder}/segments/{s}/{t}")
                rows.append((s, t, fs.getContentSummary(p).getLength() if fs.exists(p) else 0))
        return self.spark.createDataFrame(rows, "segment string, part string, bytes long").orderBy(F.desc("bytes"), "segment", "part")

    def stats(self) -> dict:
        files = self.table("files").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("c")).first()
        posts = self.table("postings").agg(F.count("*").alias("n"), F.count_distinct("tri").alias("t")).first()
        m = self.manifest()
        size = self.sizes().agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        return {"files": files["n"], "chars": files["c"], "segments": len(m["segments"]), "version": m["version"], "postings": posts["n"], "terms": posts["t"], "bytes": size}
