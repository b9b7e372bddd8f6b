"""Rules of the engine's front, the index's safety and the self-checks."""

import random

import pytest
from pyspark.sql import functions as F

from quarry import codeset, fixture
from quarry.engine import Engine, refused_link
from quarry.functions import paths as ps
from quarry.operators import blocks, changes, report, search, symbols
from quarry.plans import index as plans
from quarry.plans.index import Conflict, Index
from quarry.sources import tree
from quarry.streaming import watch

FILES = "root string, path string, text string"


def test_links_refuse_what_they_must():
    assert refused_link("/etc", [], "/i") and refused_link("/home/me/.ssh", [], "/i") and refused_link("/a/../etc", [], "/i")
    assert refused_link("/a/b", ["/a"], "/i") and refused_link("/a", ["/a/b"], "/i") and refused_link("/i/x", [], "/i") and refused_link("/", [], "/i")
    assert refused_link("/a/bc", ["/a/b"], "/i") is None


def test_large_files_are_searched_by_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(plans, "LARGE", 500)
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 300)
    cut = blocks.blocks
    monkeypatch.setattr(blocks, "blocks", lambda files, size=300, seam=64: cut(files, size, blocks.SEAM))
    rnd = random.Random(3)
    texts = {f"f{i}.c": "".join(rnd.choice(["needle ", "hay\n", "straw ", "x" * 30, "Needle\n"]) for _ in range(rnd.choice([5, 200]))) for i in range(12)}
    engine = Engine(spark, str(tmp_path / "i"), ["r"])
    engine.build(spark.createDataFrame([("r", p, t) for p, t in texts.items()], FILES))
    assert engine.index.table("blocks").count() > 12
    for query, any_case in (("needle", False), ("needle", True), ("xne", False)):
        fold = str.lower if any_case else str
        want = []
        for p, t in texts.items():
            for n, line in enumerate(t.split("\n"), 1):
                at = fold(line).find(query)
                while at >= 0:
                    want.append((p, n, at + 1))
                    at = fold(line).find(query, at + len(query))
        got = engine._hits(engine.index.table("files"), query, not any_case).select("path", "line", "col").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_churn_equals_rebuild(spark, tmp_path):
    """Many small updates, compaction among them, against a fresh build."""
    rnd = random.Random(11)
    state = {f"d{i % 3}/f{i}.c": f"int f{i}(int a) {{ return g{i}(a); }}\n" for i in range(8)}
    index = Index(spark, str(tmp_path / "one"))
    frame = lambda d: spark.createDataFrame([("r", p, t) for p, t in d.items()], FILES)
    index.build(frame(state))
    for step in range(12):
        gone = [p for p in sorted(state) if rnd.random() < 0.15]
        put = {p: state[p] + f"int h{step}(void) {{ return {step}; }}\n" for p in sorted(state) if p not in gone and rnd.random() < 0.2}
        put[f"new/n{step}.c"] = f"int n{step}(int a) {{ return f1(a); }}\n"
        index.apply(frame(put), spark.createDataFrame([("r", p) for p in gone] or [("r", "none")], "root string, path string"))
        state = {p: t for p, t in state.items() if p not in gone} | put
        if step == 6:
            index.compact()
            assert index.clean() and index.clean() == []
    fresh = Index(spark, str(tmp_path / "two"))
    fresh.build(frame(state))
    for name in plans.TABLES:
        columns = [c for c in fresh.table(name).columns if c != "words"]
        assert sorted(map(str, index.table(name).select(columns).collect())) == sorted(map(str, fresh.table(name).select(columns).collect()))
    assert index.stats()["files"] == len(state) and index.meta()["state"] == "ready"


def test_two_writers_from_one_version(spark, tmp_path):
    a, b = (Index(spark, str(tmp_path / "i")) for _ in range(2))
    a.build(spark.createDataFrame([("r", "a.c", "int a;")], FILES))
    seen = b.manifest()
    a.apply(spark.createDataFrame([("r", "b.c", "int b;")], FILES), spark.createDataFrame([], "root string, path string"))
    with pytest.raises(Conflict):
        b._publish({"segments": seen["segments"]}, seen)
    assert a.table("files").count() == 2


def test_answers_say_that_they_may_be_stale(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a.py").write_text("def alpha():\n    return 1\n")
    engine = Engine(spark, str(tmp_path / "i"), [str(tmp_path / "r")])
    engine.build()
    assert engine.search("alpha").notes.count() == 0
    assert engine.reconcile(limit=1) is None
    assert [n["code"] for n in engine.search("alpha").notes.collect()] == ["stale"]
    (tmp_path / "r/b.py").write_text("def beta():\n    return alpha()\n")
    assert engine.reconcile().count() == 1 and engine.search("beta").rows.count() == 1
    engine.cancellable("t").search("alpha")
    engine.cancel("t")
    engine.links("purge", str(tmp_path / "r"))
    assert engine.index.table("files").count() == 0 and engine.roots == []


def test_ignored_contents_are_never_opened(spark, tmp_path, monkeypatch):
    for name in ("src/a.py", "node_modules/x/b.js", "gen/c.py", "src/big.bin", ".hidden/d.py", "_own/e.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text")
    (tmp_path / ".gitignore").write_text("gen/\n")
    opened, real = [], tree._contents
    monkeypatch.setattr(tree, "_contents", lambda rows: opened.append(sorted(r["path"] for r in rows.select("path").collect())) or real(rows))
    got = {r["path"] for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"src/a.py", ".gitignore", ".hidden/d.py", "_own/e.py"}
    assert opened == [[".gitignore"], sorted(got)]


def test_overflow_asks_for_everything(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.build(spark.createDataFrame([("r", "a.c", "int a;")], FILES))
    batch = spark.createDataFrame([(1, "2024-01-01 00:00:00", "r", "", "overflow", True, None)], "event_id long, ts string, root string, path string, kind string, structural boolean, text string")
    watch.apply_batch(index, batch, lambda: spark.createDataFrame([("r", "b.c", "int b;")], FILES))
    assert [r["path"] for r in index.table("files").collect()] == ["b.c"]
    assert watch.max_wait_ms(1000) == 10_000 and watch.max_wait_ms(100) == 5000


def test_debounced_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "a"), (2, "2024-01-01 00:00:00.5", "a"), (3, "2024-01-01 00:00:05", "a"), (4, "2024-01-01 01:00:00", "z")]
    df = spark.createDataFrame(rows, "event_id long, ts string, path string").select("event_id", F.to_timestamp("ts").alias("ts"), F.lit("r").alias("root"), "path", F.lit("changed").alias("kind"), F.lit(False).alias("structural"))
    df.coalesce(1).write.parquet(str(tmp_path / "feed"))
    stream = watch.debounced(spark.readStream.schema(df.schema).parquet(str(tmp_path / "feed")))
    stream.writeStream.format("memory").queryName("groups").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n_events"] for r in spark.table("groups").filter("path = 'a'").collect()) == [1, 2]


def test_self_checks(spark):
    rows = spark.createDataFrame([("a/b.c:3-5:2: Function f",), ("a.c:1:1: int x",), ("no place",)], "answer string")
    assert [tuple(r) for r in report.parse_answers(rows).collect()] == [("a/b.c", 3, 5, 2, "Function f"), ("a.c", 1, 1, 1, "int x")]
    one, two = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert tuple(report.set_difference(one, two).first()) == (2, 1) and tuple(report.set_difference(one, one).first()) == (0, 0)
    assert "<td>&lt;x&gt;</td>" in report.html(spark.createDataFrame([("<x>",)], "v string"), "t")
    assert {s for s, _, _ in report.parse_sweep(1 << 10, 2 << 10)} == {"functions", "nested", "comments", "strings", "numbers", "one_line"}


def test_short_probes_are_found(spark):
    texts = spark.createDataFrame([(1, "abcd"), (2, "b"), (3, ""), (4, None)], "t long, text string")
    probes = spark.createDataFrame([(10, "b"), (11, "cd"), (12, "abc"), (13, ""), (14, "zzz")], "p long, text string")
    assert sorted(map(tuple, search.batch_contains(texts, probes, "t", "p").collect())) == [(10, 1), (10, 2), (11, 1), (12, 1)]


def test_held_paths_are_asked_again(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    answers = spark.createDataFrame([("a", True), ("b", None)], "path string, listed boolean")
    held = changes.held_back(asked, answers)
    assert {r["path"] for r in changes.next_batch(spark.createDataFrame([("d",), ("b",)], "path string"), held).collect()} == {"b", "c", "d"}


def test_made_files_hold_what_their_tables_say(spark, sf):
    f = codeset.corpus(spark, sf)
    assert {r["ext"] for r in f.select(F.regexp_extract("path", r"\.[^.]+$", 0).alias("ext")).distinct().collect()} == set(codeset.ENDINGS)
    assert symbols.extract(f).count() and fixture.corpus(spark).count() == 41


def test_latest_row_of_each_key(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), (None, 5, "n"), (None, None, "m")], "k string, at int, v string")
    assert sorted((r["k"] or "", r["v"]) for r in changes.latest(rows, ["k"], ["at"]).collect()) == [("", "n"), ("a", "z")]
    assert changes.latest(rows, ["k"], ["at"]).columns == ["k", "at", "v"] and changes.latest(rows.limit(0), ["k"], ["at"]).count() == 0


def test_ledger_entries_and_folding(spark):
    rows = spark.createDataFrame([("a/1",), ("a/2",), ("ab",), ("b",)], "path string")
    paths = lambda **k: sorted(r["path"] for r in changes.entries(rows, **k).collect())
    assert paths(path="ab") == ["ab"] and paths(prefix="a/") == ["a/1", "a/2"] and paths(first="a/2", last="b") == ["a/2", "ab"] and len(paths()) == 4
    sizes = spark.createDataFrame([(1023, 0), (1024, 0), (1024, 40_000), (1250, 40_000), (49_999, 10**7), (50_000, 10**7)], "o long, b long")
    assert [r[0] for r in sizes.select(changes.fold_due(F.col("o"), F.col("b"))).collect()] == [False, True, False, True, False, True]


def test_skipped_files_as_an_expression(spark):
    texts = ["x", "int a; " * 200, "0x1F, 22,\n" * 200, None]
    rows = spark.createDataFrame([(p, t) for p in ("a.c", "a.txt", "b.py") for t in texts], "path string, text string")
    got = rows.select("path", "text", symbols.skipped(F.col("path"), F.col("text"), 1000).alias("s")).collect()
    assert all(r["s"] == symbols.would_skip(r["path"], r["text"] or "", 1000) for r in got) and any(r["s"] for r in got)


def test_places_of_paths(spark):
    rows = spark.createDataFrame([(".",), ("..",), ("..foo",), ("a/../b",), ("a\\b",), ("a.c",), ("",)], "p string")
    got = {r["p"]: (r["i"], r["b"]) for r in rows.select("p", ps.inside_repo(F.col("p")).alias("i"), ps.is_bare_name(F.col("p")).alias("b")).collect()}
    assert [p for p, (i, _) in got.items() if i] == ["..foo", "a\\b", "a.c"] and "a.c" in [p for p, (_, b) in got.items() if b] and not got["a\\b"][1]
