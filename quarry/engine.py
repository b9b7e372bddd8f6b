"""The engine's front: build, update, search, definitions, references, callees, symbols, links.

Every answer is a pair of DataFrames: rows, and notes (code, message, n) that
say when the answer is capped, scoped, stale or incomplete.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths as ps
from .functions import text as tx
from .operators import blocks, changes, refs, search, symbols
from .plans.index import FORMAT, Index
from .plans.ship import ship
from .plans.storage import materialize
from .sources import tree

SEARCH_CAP, REFERENCE_CAP, CALLEE_CAP, SYMBOL_CAP, DEFINITION_CAP = 50, 100, 50, 50, 50
INLINE_LINES = 40


AUTO_LIMIT = 100 << 20  # bytes of text that are brought up to date without being asked

# Folders that no index may take in.
SENSITIVE = "/ /bin /boot /dev /etc /lib /proc /root/.ssh /run /sbin /sys /usr /var".split()


def refused_link(path: str, roots: list[str], index: str) -> str | None:
    """Why a folder can't be a root: a system folder, the index itself, or one that holds or lies in another root."""
    p = path.rstrip("/") or "/"
    bare = p.removeprefix("file://")
    if bare in SENSITIVE or "/../" in bare + "/" or bare.rsplit("/", 1)[-1].lower() in (".ssh", ".gnupg", ".aws"):
        return f"{path} is a system or secret folder"
    for other, what in [(r, "another root") for r in roots] + [(index.removeprefix("file://"), "the index")]:
        if p == other or p.startswith(other + "/") or other.startswith(p.rstrip("/") + "/"):
            return f"{path} is, holds or lies in {what}: {other}"
    return None


class Answer(NamedTuple):
    rows: DataFrame
    notes: DataFrame


class Engine:
    """One index over several roots; the first root is the primary one."""

    def __init__(self, spark: SparkSession, folder: str, roots: list[str] | None = None):
        ship(spark)
        self.spark, self.index, self.roots = spark, Index(spark, folder), [r.rstrip("/") for r in roots or []]
        self.focused: list[str] = []
        linked = self.index._get(f"{folder.rstrip('/')}/links.json")
        self.roots += [r for r in json.loads(linked or "[]") if r not in self.roots]

    # building

    def _tree(self) -> DataFrame:
        rows = None
        for root in self.roots:
            part = tree.read_tree(self.spark, root)
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            raise ValueError("no roots are linked")
        return rows

    def build(self, files: DataFrame | None = None) -> dict:
        """Index the roots, or any table with root, path and text."""
        return self.index.build(files if files is not None else self._tree())

    def update(self, files: DataFrame | None = None) -> DataFrame:
        """Bring the index to the state of files: only what differs is written. Returns (root, path, change)."""
        new = files if files is not None else self._tree()
        named = lambda df: df.select(F.to_json(F.struct("root", "path")).alias("path"), F.upper(F.md5("text")).alias("content_hash"))
        diff = changes.snapshot_diff(named(self.index.table("files")), named(new))
        key = F.from_json("path", "root string, path string")
        diff = materialize(diff.select(key["root"].alias("root"), key["path"].alias("path"), "change"), "changes", small=True)
        n = diff.count()
        if n > changes.REBUILD_OVER:
            self.index.build(new)
        elif n:
            changed = new.join(diff.filter("change <> 'removed'"), ["root", "path"], "left_semi")
            columns = self.index.table("files").columns
            self.index.apply(changed.select([c for c in columns if c in changed.columns]), diff.filter("change = 'removed'").select("root", "path"))
        return diff

    def reconcile(self, limit: int = AUTO_LIMIT, force: bool = False) -> DataFrame | None:
        """At start: one update if the trees hold no more text than limit, else None and a note that answers may be behind."""
        total = 0
        for root in self.roots:
            total += tree.listing(self.spark, root).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        if total > limit and not force:
            self.index.mark_stale(f"{total} bytes of text weren't compared at start: the limit is {limit}")
            return None
        return self.update()

    def cancellable(self, tag: str) -> Engine:
        """Jobs that this thread starts from now on carry tag; cancel(tag) ends them."""
        self.spark.addTag(tag)
        return self

    def cancel(self, tag: str) -> None:
        self.spark.interruptTag(tag)
        self.spark.removeTag(tag)

    # answers

    def _notes(self, rows: list[tuple[str, str, int]]) -> DataFrame:
        rows = list(rows)
        m = self.index.manifest()
        rows += [("stale", reason, 0) for reason in m.get("stale", [])]
        if m["segments"] and m.get("format") != FORMAT:
            rows.append(("stale", "the index was built by another version of this engine: build() renews it", 0))
        if self.focused:
            rows.append(("scoped", "only roots in focus were asked: " + ", ".join(self.focused), len(self.focused)))
        return self.spark.createDataFrame(rows, "code string, message string, n long")

    def _table(self, name: str) -> DataFrame:
        rows = self.index.table(name)
        return rows.filter(F.col("root").isin(self.focused)) if self.focused else rows

    def _place(self) -> dict[str, int]:
        return {r: i for i, r in enumerate(self.roots)}

    def _ordered(self, rows: DataFrame) -> tuple[DataFrame, list]:
        place = self._place()
        order = F.lit(len(place))
        for r, i in place.items():
            order = F.when(F.col("root") == r, i).otherwise(order)
        return rows.withColumn("root_ord", order), ["root_ord", "root", "path", "line", "col"]

    def _capped(self, rows: DataFrame, limit: int, notes: list | None = None, order: list | None = None) -> Answer:
        rows, by = self._ordered(rows)
        kept, more = search.cap(rows, order or by, limit)
        notes = list(notes or [])
        if more:
            notes.append(("capped", f"more than {limit} rows; raise max_results or narrow the query", limit))
        return Answer(kept.drop("root_ord"), self._notes(notes))

    def search(self, query: str, max_results: int = SEARCH_CAP, case_sensitive: bool = True) -> Answer:
        """Literal matches (root, path, line, col, line_text) by way of the postings."""
        limit = search.clamp(max_results)
        files = self._table("files").filter(~ps.ignored_path(F.col("path")))
        if not query.strip() or len(query) < tx.MIN_QUERY:
            text = "the query is empty" if not query.strip() else f"a query has at least {tx.MIN_QUERY} characters"
            return Answer(search.hits(files, "").limit(0), self._notes([("refused", text, 0)]))
        rows = self._hits(files, query, case_sensitive)
        shown = tx.snippet(F.col("line_text"), F.col("col"), len(query))
        rows = rows.withColumn("text_offset", tx.snippet_offset(F.col("line_text"), F.col("col"))).withColumn("line_text", shown)
        return self._capped(rows, limit)

    def _hits(self, files: DataFrame, query: str, case_sensitive: bool) -> DataFrame:
        """Candidates by the postings; of large files only the blocks whose filters may hold the query are read."""
        chosen = search.candidates(self._table("postings"), query, case_sensitive)
        seam = blocks.SEAM
        if "\n" in query or len(query) > seam + 1:
            return search.hits(files.join(chosen, ["root", "path"], "left_semi"), query, case_sensitive)
        large = self._table("filters").select("root", "path").distinct()
        small = files.join(chosen, ["root", "path"], "left_semi").join(large, ["root", "path"], "left_anti")
        cut = self._table("blocks").join(chosen, ["root", "path"], "left_semi").join(files.select("root", "path"), ["root", "path"], "left_semi")
        return search.hits(small, query, case_sensitive).unionByName(blocks.block_lines(cut, self._table("filters"), query, case_sensitive))

    def definitions(self, name: str) -> Answer:
        """Exact, case-sensitive; a single short definition comes with its source."""
        rows = symbols.location(symbols.by_name(self._table("symbols"), name)).withColumn("source", F.lit(None).cast("string"))
        got = self._capped(rows, DEFINITION_CAP)
        found = got.rows.limit(2).collect()
        if len(found) == 1 and found[0]["end_line"] - found[0]["line"] + 1 <= INLINE_LINES:
            text = self._table("files").filter((F.col("root") == found[0]["root"]) & (F.col("path") == found[0]["path"])).select("root", "path", "text")
            part = F.array_join(F.slice(tx.lines(F.col("text")), F.col("line"), F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(1))), "\n")
            return Answer(got.rows.drop("source").join(text, ["root", "path"]).withColumn("source", part).drop("text"), got.notes)
        return got

    def symbols(self, query: str, max_results: int = SYMBOL_CAP) -> Answer:
        """Names that contain the query in any case; generated files come last, and that is decided before the cap."""
        rows = symbols.matching(self._table("symbols"), query) if query.strip() else self._table("symbols").limit(0).withColumn("generated", F.lit(False))
        return self._capped(symbols.location(rows), search.clamp(max_results), order=["generated", "root_ord", "root", "path", "line", "col"])

    def references(self, name: str, max_results: int = REFERENCE_CAP) -> Answer:
        """Uses by name in code; the notes say what a name match can't tell."""
        member = refs.member_of_qualified(name)
        files, posts = self._table("files"), self._table("postings")
        if len(member) >= tx.MIN_QUERY:
            chosen = search.candidates(posts, member)
            files = files.join(chosen, ["root", "path"], "left_semi")
        rows = refs.references(files, self._table("symbols"), self._table("spans"), member)
        notes = [("by_name", f"matched by the name {member}: uses of different symbols with this name are listed together", 0)]
        if member != name:
            notes.append(("qualified", f"{name} was matched by its last member {member}", 0))
        told = {"conditional": "conditional compilation in", "clash": "a using gives names another meaning in", "unreadable": "no text could be read of"}
        for r in refs.file_list(refs.incompleteness(files, files.select("root", "path")), ["reason"]).collect():  # one row per reason
            notes.append((r["reason"], f"{told[r['reason']]} {r['shown']}", r["n"]))
        got = self._capped(rows, search.clamp(max_results), notes)
        return got

    def callees(self, name: str, max_results: int = CALLEE_CAP) -> Answer:
        """Definitions that the bodies of name call, in the order of calls."""
        rows = refs.callees(self._table("calls"), self._table("symbols"), name)
        notes = [("by_name", "calls were resolved by name: same-named definitions are listed together", 0)]
        return self._capped(rows, search.clamp(max_results), notes, order=["how", "caller_path", "seq", "root_ord", "path", "line", "col"])

    # links

    def links(self, action: str = "list", path: str | None = None) -> DataFrame:
        """list, add or remove roots, purge one with its rows, or focus answers on those a token names (an empty token ends that)."""
        if action == "add" and path and path.rstrip("/") not in self.roots:
            if reason := refused_link(path, self.roots, self.index.folder):
                raise ValueError(reason)
            self.roots.append(path.rstrip("/"))
        elif action in ("remove", "purge") and path:
            if action == "purge" and self.index.manifest()["segments"]:
                gone = self.index.table("files").filter(F.col("root") == path.rstrip("/")).select("root", "path")
                self.index.apply(self.index.table("files").limit(0), gone)
            self.roots = [r for r in self.roots if r != path.rstrip("/")]
            self.focused = [r for r in self.focused if r in self.roots]
        elif action == "focus":
            every = self.spark.createDataFrame([(r,) for r in self.roots], "root string")
            self.focused = [r["root"] for r in refs.focus(every, path or "").collect()] if path else []
        elif action != "list":
            raise ValueError("action is list, add, remove, purge or focus")
        if action in ("add", "remove", "purge"):
            self.index._put(f"{self.index.folder}/links.json", json.dumps(self.roots))
        rows = [(r, i == 0, r in self.focused) for i, r in enumerate(self.roots)]
        return self.spark.createDataFrame(rows, "root string, is_primary boolean, focused boolean")

    def doctor(self) -> DataFrame:
        """Health checks as rows (check, ok, detail)."""
        m = self.index.manifest()
        rows = [("built", bool(m["segments"]), f"version {m['version']}"), ("compact", len(m["segments"]) < changes.COMPACT_AT, f"{len(m['segments'])} segments")]
        if m["segments"]:
            files = self.index.table("files")
            lost = self.index.table("postings").select("root", "path").distinct().join(files, ["root", "path"], "left_anti").limit(1).count()
            rows.append(("postings", not lost, "every posting's file is live"))
        return self.spark.createDataFrame(rows, "check string, ok boolean, detail string")
