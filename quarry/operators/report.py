"""Reports over answers and corpora: footers, coverage, breadth, growth, savings, self-checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as ps
from ..functions import text as tx
from .symbols import skipped as by_size

CHARS_PER_TOKEN = 4


def answer_footer(rows: DataFrame) -> DataFrame:
    """How many rows of an answer each layer gave."""
    return rows.groupBy("layer").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))


def coverage(meta: DataFrame) -> DataFrame:
    """One row over the roots asked: what their indexes left out. meta: per root files, files_over_cap, symbol_skipped, dropped_dirs."""
    names = ("files", "files_over_cap", "symbol_skipped", "dropped_dirs")
    return meta.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names], F.count("*").alias("roots"))


def symbols_per_extension(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy(ps.extension(F.col("path")).alias("ext")).agg(F.count_distinct("root", "path").alias("files"), F.count("*").alias("symbols"))


def symbol_profile(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per extension: files, those with a symbol, those skipped for size or as numeric data, and the most symbols of one file."""
    per_file = symbols.groupBy("root", "path").agg(F.count("*").alias("_n"))
    rows = files.select("root", "path", by_size(F.col("path"), F.col("text")).alias("_skipped")).join(per_file, ["root", "path"], "left")
    return rows.groupBy(ps.extension(F.col("path")).alias("ext")).agg(
        F.count("*").alias("files"), F.count("_n").alias("with_symbols"), F.count_if("_skipped").alias("skipped"), F.coalesce(F.max("_n"), F.lit(0)).alias("most_symbols")
    )


def broad_names(symbols: DataFrame, calls: DataFrame, top: int = 10) -> DataFrame:
    """Defined names by how often they are called."""
    uses = calls.groupBy("name").agg(F.count("*").alias("uses"))
    return symbols.select("name").distinct().join(uses, "name").orderBy(F.desc("uses"), "name").limit(top)


def growth(rows: DataFrame, key: str, size: str, cost: str) -> DataFrame:
    """Each size's cost over the next smaller size's, per key."""
    w = Window.partitionBy(key).orderBy(size)
    return rows.withColumn("growth", F.col(cost) / F.lag(cost).over(w))


def knee(rows: DataFrame, key: str, size: str, slow: Column) -> DataFrame:
    """Rows from the first slow one on, per key by size."""
    w = Window.partitionBy(key).orderBy(size).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("past_knee", F.max(slow.cast("int")).over(w) == 1)


def savings(hits: DataFrame, files: DataFrame) -> DataFrame:
    """One row: tokens of an answer's lines against tokens of reading the files they stand in."""
    shown = hits.agg(F.coalesce(F.sum(F.length("line_text").cast("long")), F.lit(0)).alias("shown"))
    whole = files.join(hits.select("root", "path").distinct(), ["root", "path"], "left_semi").agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("whole"))
    one = shown.crossJoin(F.broadcast(whole))  # one row each
    return one.select(F.floor(F.col("shown") / CHARS_PER_TOKEN).alias("answer_tokens"), F.floor(F.col("whole") / CHARS_PER_TOKEN).alias("file_tokens"))


def misplaced(hits: DataFrame, files: DataFrame, query: str) -> DataFrame:
    """Rows that don't hold the query at their line and column: none, if search is right."""
    joined = hits.select("root", "path", "line", "col").join(files.select("root", "path", "text"), ["root", "path"])
    line = F.get(tx.lines(F.col("text")), F.col("line") - 1)
    return joined.filter(~F.coalesce(F.substring(line, F.col("col"), F.lit(len(query))) == query, F.lit(False))).drop("text")


def global_usings(projects: DataFrame) -> DataFrame:
    """(root, path, name): namespaces that project files use everywhere."""
    found = F.regexp_extract_all("text", F.lit(r'(?i)<Using\b[^>]*\bInclude\s*=\s*"([^"]+)"'), F.lit(1))
    return projects.select("root", "path", F.explode(F.array_distinct(found)).alias("name"))


def prune_ignored(rows: DataFrame, extra: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows whose path the present rules still admit."""
    return rows.filter(~ps.ignored_path(F.col("path"), extra, keep))


def without_folder_changes(events: DataFrame) -> DataFrame:
    """Events without the changes of folders themselves; their files have events of their own."""
    return events.filter(~((F.col("kind") == "changed") & F.col("is_dir")))


# answers and self-checks

ANSWER = r"^(.*?):(\d+)(?:-(\d+))?:(\d+): (.*)$"


def parse_answers(rows: DataFrame, column: str = "answer") -> DataFrame:
    """Printed places as (path, line, end_line, col, rest); rows that are no places are left out."""
    c = F.col(column)
    part = lambda k: F.regexp_extract(c, ANSWER, k)
    end = F.when(part(3) != "", part(3).cast("int"))
    found = rows.filter(c.rlike(ANSWER))
    return found.select(part(1).alias("path"), part(2).cast("int").alias("line"), F.coalesce(end, part(2).cast("int")).alias("end_line"), part(4).cast("int").alias("col"), part(5).alias("rest"))


def set_difference(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """One row: how many rows are missing and how many are too many, repeats counted; both 0 for equal answers."""
    names = wanted.columns
    both = wanted.withColumn("_d", F.lit(1)).unionByName(got.select(names).withColumn("_d", F.lit(-1)))
    each = both.groupBy(*names).agg(F.sum("_d").alias("d"))
    return each.agg(F.coalesce(F.sum(F.greatest(F.col("d"), F.lit(0))), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("extra"))


def io_totals(trace: DataFrame) -> DataFrame:
    """Reads and bytes of a query's trace (has_blocks, bytes), with and without blocks."""
    return trace.groupBy("has_blocks").agg(F.count("*").alias("reads"), F.sum("bytes").alias("bytes"))


def biggest_readers(trace: DataFrame, top: int = 15) -> DataFrame:
    return trace.groupBy("path").agg(F.sum("bytes").alias("bytes")).orderBy(F.desc("bytes"), "path").limit(top)


def cache_list(sizes: DataFrame) -> DataFrame:
    """(root, bytes, share): the size of each root's tables, largest first."""
    each = sizes.groupBy("root").agg(F.sum("bytes").alias("bytes"))
    total = each.agg(F.sum("bytes").alias("total"))
    return each.join(F.broadcast(total)).select("root", "bytes", (F.col("bytes") / F.col("total")).alias("share")).orderBy(F.desc("bytes"), "root")  # one row


def html(rows: DataFrame, title: str, limit: int = 1000) -> str:
    """A page with one table of the first rows, for self-test and bench reports."""
    from html import escape

    head = "".join(f"<th>{escape(c)}</th>" for c in rows.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(v))}</td>" for v in r) + "</tr>" for r in rows.limit(limit).collect())
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table>"


def parse_sweep(least: int = 64 << 10, most: int = 16 << 20) -> list[tuple[str, int, float]]:
    """(shape, characters, seconds) of the definition scanner over texts of doubling sizes."""
    import time

    from . import symbols

    shapes = {
        "functions": "int f(int x) { return g(x); }\n", "nested": "namespace n { struct s { int v; }; }\n", "comments": "/* words in a comment */ // more\n",
        "strings": 'const char *s = "text with { braces }";\n', "numbers": "0x1F, 0x2A, 1234567,\n", "one_line": "int a = b(c) + d[e]; ",
    }
    out, size = [], least
    while size <= most:
        for name, unit in shapes.items():
            text = unit * (size // len(unit))
            began = time.perf_counter()
            symbols.scan("sweep.cpp", text, cap=None)
            out.append((name, len(text), time.perf_counter() - began))
        size *= 2
    return out
