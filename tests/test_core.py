"""The engine's operators against brute force and against SQL."""

import os
import random
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry import fixture, queries
from quarry.engine import Engine
from quarry.functions import text as tx
from quarry.operators import blocks, changes, lexing, refs, report, search, stats, symbols
from quarry.plans import storage
from quarry.plans.index import Conflict, Index
from quarry.sources import ignore, tree
from quarry.streaming import watch


def brute(files, q):
    out = []
    for path, text in files:
        at = text.find(q)
        while at >= 0:
            out.append((path, text.count("\n", 0, at) + 1, at - text.rfind("\n", 0, at)))
            at = text.find(q, at + max(1, len(q)))
    return sorted(out)


PIECES = st.sampled_from(["ab", "ba", "a", "b", " ", "\n", "\r\n", "é", "𝄞", "ab\nab", "aaaa", "\t"])


@settings(max_examples=6, deadline=None)
@given(texts=st.lists(st.lists(PIECES, max_size=40).map("".join), min_size=1, max_size=8), asked=st.lists(PIECES, min_size=1, max_size=3).map("".join))
def test_search_equals_brute_force(spark, texts, asked):
    rows = [(str(i), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([("r", p, t) for p, t in rows], "root string, path string, text string")
    want = brute(rows, asked) if asked.strip() else []
    sides = [search.hits(df, asked)] + ([search.indexed_hits(df, search.postings(df), asked)] if len(asked) > 2 else [])
    for got in sides:
        assert sorted((r["path"], r["line"], r["col"]) for r in got.collect()) == want


def test_search_edges(spark):
    df = spark.createDataFrame([("r", "a", "aaa\r\nfoo \u00b5 \u212a \u0131"), ("r", "b", ""), ("r", "c", None)], "root string, path string, text string")
    assert [(r["line"], r["col"], r["line_text"]) for r in search.hits(df, "aa").collect()] == [(1, 1, "aaa")]
    assert search.hits(df, "  \t").count() == 0
    assert search.hits(df, "\u039c", case_sensitive=False).count() == 1  # micro sign and Greek mu fold together
    assert search.hits(df, "o \u00b5 k", case_sensitive=False).count() == 0  # the Kelvin sign is no k
    assert search.hits(df, "FOO", case_sensitive=False).count() == 1


def test_caps(spark):
    df = spark.createDataFrame([("r", "a", "x y\n" * 70), ("r", "b", "x")], "root string, path string, text string")
    got = search.per_file_cap(search.hits(df, "x"))
    assert {(r["path"], r["capped"]) for r in got.collect()} == {("a", True), ("b", False)} and got.count() == 65
    kept, more = search.cap(search.hits(df, "x"), ["path", "line"], 71)
    assert kept.count() == 71 and not more
    assert search.cap(search.hits(df, "x"), ["path", "line"], 70)[1]
    assert (search.clamp(0), search.clamp(5000)) == (1, 1000)


def test_snippets(spark):
    long = "a" * 500 + "needle" + "b" * 500
    df = spark.createDataFrame([(long, 501), ("x\u202eneedle", 3)], "line string, col int")
    got = df.select(tx.snippet(F.col("line"), F.col("col"), 6).alias("s"), tx.snippet_offset(F.col("line"), F.col("col")).alias("o")).collect()
    assert got[0]["s"].startswith("…" + "a" * 120 + "needle") and got[0]["s"].endswith("…" + " (part of 1,006 characters in this line)")
    assert got[0]["s"][501 - 1 - got[0]["o"] :].startswith("needle")
    assert got[1]["s"] == "x·needle"


def test_blocks_find_matches_over_cuts(spark):
    text = ("ab " * 400 + "needle" + "x" * 3000 + "needle\n") * 3
    df = spark.createDataFrame([("r", "p", text)], "root string, path string, text string")
    want = [m.start() for m in re.finditer("needle", text)]
    for size in (7, 64, 1205, 5000):
        b = blocks.blocks(df, size, 32)
        assert sorted(r["start"] for r in blocks.block_hits(b, blocks.filters(b), "needle", 32).collect()) == want
        for folded in (False, True):
            lines = blocks.block_lines(b, blocks.filters(b), "NEEDLE" if folded else "needle", not folded, 32)
            assert sorted((r["line"], r["col"]) for r in lines.collect()) == sorted(x[1:] for x in brute([("p", text)], "needle"))
    b = blocks.blocks(df, 64, 16)
    assert blocks.pruned(blocks.filters(b), "needle", seam=16).count() < b.count()


def test_blocks_refuse_queries_beyond_the_seam(spark):
    query = "n" * 40
    df = spark.createDataFrame([("r", "p", "x" * 60 + query + "x" * 60)], "root string, path string, text string")
    b = blocks.blocks(df, 64, 39)
    assert blocks.block_hits(b, blocks.filters(b), query, 39).first()["start"] == 60
    for asked, seam in ((query, 32), ("n" * (blocks.SEAM + 2), blocks.SEAM)):
        with pytest.raises(ValueError):
            blocks.pruned(blocks.filters(b), asked, seam=seam)


def test_every_text_has_a_last_block(spark):
    texts = ["", None, "\n", "x" * 16, "x" * 15 + "\n", "x" * 16 + "\n", "a\r\nb\n" * 9, "𝄞" * 40]
    df = spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], "root string, path string, text string")
    b = blocks.blocks(df, 16, 1)
    last = b.filter("seam = ''").select("path", "start_line", "text").collect()
    assert sorted((r["path"], r["start_line"] + r["text"].count("\n")) for r in last) == [(str(i), t.count("\n") + 1) for i, t in enumerate(texts) if t is not None]
    assert blocks.filters(b).count() == b.count()
    rows = b.orderBy("path", "block_no").collect()
    assert ["".join(r["text"] for r in rows if r["path"] == str(i)) for i in range(len(texts))] == [t or "" for t in texts]


def test_start_lines_of_odd_documents(spark, tmp_path):
    """Empty and null texts, texts without a path, several texts of one path."""
    docs = [
        (0, "", "en", "s"), (1, None, "en", "s"), (2, "a\nb", None, "s"), (3, "a\n" * 3000, "en", None), (4, "c", None, None), (5, "a\n", "en", "s"), (5, "b\n" * 3000, "en", "s"),
        (6, "", "en", "s"), (6, "x", "en", "s"), (7, None, "en", "s"), (7, "z\n", "en", "s"), (8, "x" * 2047 + "\n", "en", "s"), (9, "", None, "s"),
    ]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    table.coalesce(1).write.parquet(str(tmp_path / "all"))
    (tmp_path / "sf").mkdir()
    next((tmp_path / "all").glob("*.parquet")).rename(tmp_path / "sf" / "documents.parquet")
    _same(spark, str(tmp_path / "sf"), "block_start_lines")


def test_ignore_rules():
    case = lambda text, path, folder=False: ignore.ignored({"": ignore.parse(text)}, path, folder)
    for text, path, want in [
        ("*.log", "a/b.log", True), ("*.log\n!keep.log", "a/keep.log", False), ("/top", "a/top", False), ("/top", "top", True), ("build/", "build", False),
        ("build/", "build/x", True), ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True), ("**/foo", "x/foo", True), ("foo/**", "foo/x/y", True), ("foo/*", "foo/x", True),
        ("a?c", "abc", True), ("a?c", "a/c", False), ("[[:digit:]]x", "3x", True), ("[!a-c]x", "bx", False), ("[!a-c]x", "dx", True), ("\\#x", "#x", True), ("#x", "#x", False),
        ("build/\n!build/keep", "build/keep", True), ("a\\*b", "a*b", True), ("a\\*b", "axb", False), ("x ", "x", True), ("[", "[", False), ("doc/*.txt", "doc/a/b.txt", False),
    ]:
        assert case(text, path) is want, (text, path)
    deep = {"": ignore.parse("*.x"), "sub": ignore.parse("!a.x")}
    assert not ignore.ignored(deep, "sub/a.x") and ignore.ignored(deep, "sub/b.x")


def test_lexing_fails_open():
    code = lambda t, lang="cpp": lexing.mask(t, lang)
    assert "foo" not in code("/* foo */ // foo\n") and "foo" in code("10'000 foo 'x'")
    assert "foo" in code('"unterminated foo\nfoo') and "foo" not in code('R"x(foo "y)x"')
    assert "foo" in code('$"{foo}"', "csharp") and "bar" not in code('$"bar {foo}"', "csharp") and "foo" not in code('@"a""foo"', "csharp")
    assert "foo" not in code('"""\nfoo "x"\n"""', "csharp") and "foo" in code("FOOR\"foo\" foo")
    assert lexing.inactive_lines("a\n#if X\nb\n#elif !Y\nc\n#else\nd\n#endif\ne") == {3, 7}


def test_symbols_by_language():
    names = lambda p, t: [(s[0], s[1]) for s in symbols.scan(p, t)[0]]
    assert names("a.c", "#define F(x) x\nstruct n { int v; };\nstruct n *u;\nint f(int a);\nint f(int a) { return g(a); }\ntypedef struct { int a; } p_t;\n") == [("n", "Struct"), ("f", "Function"), ("p_t", "TypeAlias")]
    assert ("spin", "Method") in names("a.cpp", "int W::spin(int x) { return 1; }") and ("operator==", "Method") in names("a.cpp", "struct A { bool operator==(A b) { return 1; } };")
    assert names("a.cs", "record P(string First, int Age = 3);") == [("P", "Record"), ("First", "Property"), ("Age", "Property")]
    assert names("a.py", "class A:\n    def m(self): pass\n# def no(): pass\n") == [("A", "Class"), ("m", "Function")]
    assert names("a.go", "func (s *T) Do() {}\ntype T struct {}\n") == [("Do", "Method"), ("T", "TypeAlias")]
    assert names("a.rs", "mod m { fn f() {} }\ntrait T {}\n") == [("m", "Namespace"), ("f", "Function"), ("T", "Trait")]
    assert names("a.cmm", "go:\n") == [("go", "Other")] and names("a.txt", "def f(): pass") == []


def test_qualified_names():
    for name, want in {"Widget::spin": "spin", "std::vector<std::string>": "vector", "operator<<": "operator<<", "A::operator<<": "operator<<", "plain": "plain", "ns::T<a>::f": "f"}.items():
        assert refs.member_of_qualified(name) == want
    assert refs.attribute_short("FooAttribute") == "Foo" and refs.attribute_short("Attribute") == "Attribute"


def test_references_are_uses_only(spark):
    f = fixture.corpus(spark)
    rows = refs.references(f, symbols.extract(f), symbols.spans(f), "compute_0").collect()
    found = {(r["path"], r["line"]) for r in rows}
    assert ("lib/mod_7.py", 3) in found and ("src/part_7.c", 5) in found and ("App/Part0.cs", 6) in found and ("web/view_0.ts", 1) in found
    assert not any(p.endswith(".md") for p, _ in found) and ("src/part_0.c", 1) not in found and ("src/part_0.c", 4) not in found and ("src/part_0.c", 3) not in found


def test_callees(spark):
    f = fixture.corpus(spark)
    rows = refs.callees(symbols.calls(f), symbols.extract(f), "Debug3").collect()
    assert {(r["name"], r["how"]) for r in rows} == {("compute_3", "inactive_branch")}


def test_changes(spark):
    mk = lambda d: spark.createDataFrame(list(d.items()), "path string, content_hash string")
    old, new = {"a/x": "1", "a/y": "2", "b/z": "3"}, {"a/x": "1", "a/y": "9", "c/w": "4"}
    assert {r["path"]: r["change"] for r in changes.snapshot_diff(mk(old), mk(new)).collect()} == {"a/y": "modified", "b/z": "removed", "c/w": "added"}
    h1, h2 = changes.directory_hashes(mk(old)), changes.directory_hashes(mk(old))
    assert changes.changed_directories(h1, h2).count() == 0
    assert {r["dir"] for r in changes.changed_directories(h1, changes.directory_hashes(mk(new))).collect()} == {"", "a", "b", "c"}


def test_stats_small(spark):
    df = spark.createDataFrame([(f"a{i}.py", i) for i in range(1, 101)], "path string, size long")
    r = stats.concentration(df).first()
    assert (r["median"], r["largest"], r["bytes"]) == (51, 100, 5050) and abs(r["top1"] - 100 / 5050) < 1e-12
    e = stats.extension_sizes(df).first()
    assert (e["p50"], e["p95"], e["largest_path"]) == (50, 95, "a100.py")


def test_reports(spark):
    f = fixture.corpus(spark)
    s, c = symbols.extract(f), symbols.calls(f)
    assert {r["ext"]: r["files"] for r in report.symbols_per_extension(s).collect()} == {".py": 8, ".c": 8, ".cs": 9, ".ts": 8}
    assert report.broad_names(s, c).first()["uses"] == 6
    assert report.misplaced(search.hits(f, "compute_0"), f, "compute_0").count() == 0
    p = spark.createDataFrame([("r", "a.csproj", '<Using Include="A.B"/> <using  Static="x" include = "C" />')], "root string, path string, text string")
    assert sorted(r["name"] for r in report.global_usings(p).collect()) == ["A.B", "C"]
    assert report.prune_ignored(spark.createDataFrame([("bin/x.py",), ("src/x.py",)], "path string")).count() == 1
    e = spark.createDataFrame([("changed", True), ("changed", False), ("deleted", True)], "kind string, is_dir boolean")
    assert report.without_folder_changes(e).count() == 2


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "bin").mkdir()
    (tmp_path / "src/a.py").write_text("def f(): pass\n")
    (tmp_path / "src/u16.txt").write_bytes("\ufeffhé".encode("utf-16-le"))
    (tmp_path / "src/blob.txt").write_bytes(b"a\0b")
    (tmp_path / "bin/x.py").write_text("no")
    (tmp_path / "skip.tmp").write_text("no")
    (tmp_path / ".gitignore").write_text("*.tmp\n")
    os.symlink(tmp_path / "src/a.py", tmp_path / "src/link.py")
    got = {r["path"]: r["text"] for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py": "def f(): pass\n", "src/u16.txt": "hé", ".gitignore": "*.tmp\n"}
    assert {r["path"] for r in tree.read_tree(spark, str(tmp_path), under="src").collect()} == {"src/a.py", "src/u16.txt"}
    assert tree.dropped(spark, str(tmp_path)).count() == 0
    assert tree.load_config('{"a": 1, // x\n "b": "//", }', {"QUARRY_MAX_FILE_MB": "3"}) == {"a": 1, "b": "//", "maxFileMb": "3"}


def test_engine_and_incremental_equals_rebuild(spark, tmp_path):
    rnd = random.Random(7)
    state = {("r", p): t for _, p, t in fixture.sources(4)}
    df = lambda: spark.createDataFrame([(r, p, t) for (r, p), t in state.items()], "root string, path string, text string")
    engine = Engine(spark, str(tmp_path / "one"), ["r"])
    engine.build(df())
    for step in range(3):
        keys = sorted(state)
        for k in rnd.sample(keys, 4):
            if rnd.random() < 0.4:
                del state[k]
            else:
                state[k] += f"\nint extra_{step}(int a) {{ return compute_1(a); }}\n"
        state[("r", f"new{step}.c")] = f"int fresh_{step}(int a) {{ return compute_0(a); }}\n"
        assert engine.update(df()).count()
    fresh = Engine(spark, str(tmp_path / "two"), ["r"])
    fresh.build(df())
    rows = lambda a: sorted(map(tuple, a.rows.drop("source").collect()))
    for ask in (lambda e: e.search("compute_1", 1000), lambda e: e.references("compute_1", 1000), lambda e: e.symbols("EXTRA", 1000), lambda e: e.definitions("fresh_1"), lambda e: e.callees("fresh_2")):
        assert rows(ask(engine)) == rows(ask(fresh))
    assert engine.index.stats()["segments"] == 4 and engine.index.compact()["segments"] != []
    assert rows(engine.search("compute_1", 1000)) == rows(fresh.search("compute_1", 1000))
    assert [n["code"] for n in engine.search("ab").notes.collect()] == ["refused"]
    assert "capped" in [n["code"] for n in engine.search("compute", 1).notes.collect()]
    assert "return" in engine.definitions("fresh_1").rows.first()["source"]
    assert all(r["ok"] for r in engine.doctor().collect())
    assert engine.links("add", "/x/other").count() == 2 and engine.links("focus", "other").filter("focused").count() == 1


def test_ranks_and_sweep(spark):
    df = spark.createDataFrame([(i * 7 % 100, i % 3) for i in range(100)], "a long, b long")
    rows = storage.ranked(df, ["a"]).collect()
    assert sorted((r["a"], r["rank"]) for r in rows) == [(i, i) for i in range(100)]
    assert storage.ranked(df.limit(0), ["a"]).count() == 0
    storage.sweep(spark)


def test_pointer_recovers(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.build(fixture.corpus(spark, 2))
    n = index.table("files").count()
    (tmp_path / "i/manifest-000000009.json").write_text("{ cut off")
    assert Index(spark, str(tmp_path / "i")).table("files").count() == n
    with pytest.raises(Conflict):  # a second writer from the same version
        index._publish({"segments": []}, {"version": 0})
    index.lock("a", now=1000.0)
    with pytest.raises(Conflict):
        index.lock("b", now=1100.0)
    index.lock("b", now=1700.0)  # the first one fell silent
    index.unlock("b")
    index.lock("c")


def test_stream_equals_rebuild(spark, tmp_path):
    events = [
        (1, "2024-01-01 00:00:00", "r", "a.c", "created", False, "int a(int x) { return 1; }"),
        (2, "2024-01-01 00:00:01", "r", "b.c", "created", False, "int b(int x) { return a(x); }"),
        (3, "2024-01-01 00:00:02", "r", "a.c", "deleted", True, None),
        (4, "2024-01-01 00:00:03", "r", "c.c", "renamed_to", True, "int a(int x) { return 2; }"),
    ]
    src = tmp_path / "feed"
    rows = spark.createDataFrame(events, "event_id long, ts string, root string, path string, kind string, structural boolean, text string").withColumn("ts", F.to_timestamp("ts"))
    rows.filter("event_id < 3").coalesce(1).write.parquet(str(src / "1"))
    index = Index(spark, str(tmp_path / "i"))

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(str(src / "*"))
        watch.start(stream, index, str(tmp_path / "cp"), availableNow=True).awaitTermination()

    run()
    assert sorted(r["path"] for r in index.table("files").collect()) == ["a.c", "b.c"]
    rows.filter("event_id >= 3").coalesce(1).write.parquet(str(src / "2"))
    run()
    assert sorted(r["path"] for r in index.table("files").collect()) == ["b.c", "c.c"]
    assert sorted(r["name"] for r in index.table("symbols").collect()) == ["a", "b"]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_trigrams(text):
    assert sorted(tx.trigram_keys(text)) == sorted({ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in zip(text, text[1:], text[2:])})


def _same(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    got = queries.queries()[name](spark, sf).toPandas()
    cur = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = cur.fetchall()
    norm = lambda v: round(float(v), 9) if isinstance(v, float) or type(v).__name__ == "float64" else str(v)
    assert sorted(cols) == sorted(got.columns)
    assert sorted(tuple(map(norm, r)) for r in got[cols].itertuples(index=False, name=None)) == sorted(tuple(map(norm, r)) for r in want)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    _same(spark, sf, name)
