"""The registered queries of the engine, each with SQL for the same rows.

Rows of ``documents`` stand for files: a path is made of source, a folder,
the language and the id, so that path rules have something to tell apart.
``pages`` and ``conversations`` are a second and a third root.  ``events``
stand for a change feed: a user is a path, an event of type error deletes it.
Every query covers its whole tables; limits stand only where they are the
operator (top lists, caps, samples).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codeset
from .functions import paths as ps
from .functions import text as tx
from .operators import blocks, changes, refs, report, search, stats, symbols
from .plans.storage import materialize
from .sources import ignore

EXTENSIONS = [".py", ".c", ".md", ".json", ".designer.cs"]
FOLDERS = ["src", "bin", "lib", "node_modules", "Build", "docs", "target"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            used = [name for name in reversed(VIEWS) if re.search(rf"\b{name}\b", sql)]
            need = list(VIEWS) if used else []
            with_ = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in need if any(n == u or re.search(rf"\b{n}\b", VIEWS[u]) for u in _closure(used)))
            body = sql.strip()
            ORACLES[f.__name__] = body if not with_ else f"WITH {with_}{',' + chr(10) + body[5:] if body.startswith('WITH ') else chr(10) + body}"
        return f

    return put


def _closure(names: list[str]) -> set[str]:
    out, todo = set(), list(names)
    while todo:
        n = todo.pop()
        if n not in out:
            out.add(n)
            todo += [m for m in VIEWS if m != n and re.search(rf"\b{m}\b", VIEWS[n])]
    return out


PATH = "source || '/' || (['src','bin','lib','node_modules','Build','docs','target'])[doc_id % 7 + 1] || '/' || lang || '/' || doc_id || (['.py','.c','.md','.json','.designer.cs'])[doc_id % 5 + 1]"
VIEWS = {
    "files": f"SELECT source AS root, {PATH} AS path, text, octet_length(encode(text))::BIGINT AS size, upper(md5(text)) AS content_hash, doc_id FROM documents",
    "three": "SELECT 'documents' AS root, 0 AS ord, doc_id::VARCHAR AS path, text FROM documents UNION ALL SELECT 'pages', 1, page_id::VARCHAR, html FROM pages UNION ALL SELECT 'conversations', 2, conv_id || '/' || turn, text FROM conversations",
    "lines": "SELECT root, path, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line FROM files",
    "found": "SELECT root, path, line, regexp_replace(line_text, '\\r$', '') AS line_text, unnest(list_transform(range(1, len(string_split(line_text, 'the'))), lambda k: 1 + list_sum(list_transform(string_split(line_text, 'the')[1:k], lambda x: length(x))) + 3 * (k - 1)))::INTEGER AS col FROM lines WHERE contains(line_text, 'the')",
    "grams": "SELECT DISTINCT path, unnest(list_transform(range(1, length(text) - 1), lambda i: ord(a[i])::BIGINT * 4398046511104 + ord(a[i + 1])::BIGINT * 2097152 + ord(a[i + 2])::BIGINT)) AS tri FROM (SELECT path, text, string_split(text, '') AS a FROM files) WHERE length(text) > 2",
    "old": "SELECT path, content_hash FROM files WHERE doc_id % 11 <> 0",
    "new": "SELECT CASE WHEN doc_id % 19 = 1 THEN path || '.moved' ELSE path END AS path, CASE WHEN doc_id % 13 = 0 THEN upper(md5(text || 'x')) ELSE content_hash END AS content_hash FROM files WHERE doc_id % 17 <> 0",
    "feed": "SELECT event_id, ts, user_id, user_id::VARCHAR AS path, event_type = 'error' AS is_delete, event_type IN ('error', 'signup') AS structural, (event_id // 500)::BIGINT AS batch_id FROM events",
}


VIEWS |= codeset.VIEWS


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pick = lambda names, m: F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % m + 1).cast("int"))
    path = F.concat("source", F.lit("/"), pick(FOLDERS, 7), F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), pick(EXTENSIONS, 5))
    return d.select(
        F.col("source").alias("root"), path.alias("path"), "text", F.octet_length("text").cast("long").alias("size"), F.upper(F.md5("text")).alias("content_hash"), "doc_id"
    )


def three(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    one = lambda df, root, ord_, path, text: df.select(F.lit(root).alias("root"), F.lit(ord_).alias("ord"), path.cast("string").alias("path"), F.col(text).alias("text"))
    return (
        one(read("documents"), "documents", 0, F.col("doc_id"), "text")
        .union(one(read("pages"), "pages", 1, F.col("page_id"), "html"))
        .union(one(read("conversations"), "conversations", 2, F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")), "text"))
    )


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = files(spark, sf_dir)
    old = f.filter("doc_id % 11 <> 0").select("path", "content_hash")
    new = f.filter("doc_id % 17 <> 0").select(
        F.when(F.col("doc_id") % 19 == 1, F.concat("path", F.lit(".moved"))).otherwise(F.col("path")).alias("path"),
        F.when(F.col("doc_id") % 13 == 0, F.upper(F.md5(F.concat("text", F.lit("x"))))).otherwise(F.col("content_hash")).alias("content_hash"),
    )
    return old, new


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        "event_id",
        "ts",
        "user_id",
        F.col("user_id").cast("string").alias("path"),
        (F.col("event_type") == "error").alias("is_delete"),
        F.col("event_type").isin("error", "signup").alias("structural"),
        F.floor(F.col("event_id") / 500).alias("batch_id"),
    )


# search


@query("SELECT path, line, col FROM found")
def search_literal(spark, sf_dir):
    return search.hits(files(spark, sf_dir), "the").select("path", "line", "col")


@query("SELECT path, line, col, line_text FROM found")
def search_indexed(spark, sf_dir):
    f = files(spark, sf_dir)
    return search.indexed_hits(f, search.postings(f, only=search.query_keys("the")), "the").select("path", "line", "col", "line_text")


@query(
    """
WITH up AS (SELECT path, line, translate(line_text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS t FROM lines),
s AS (SELECT path, line, string_split(t, 'AND') AS p FROM up WHERE contains(t, 'AND'))
SELECT path, line, unnest(list_transform(range(1, len(p)), lambda k: 1 + list_sum(list_transform(p[1:k], lambda x: length(x))) + 3 * (k - 1)))::INTEGER AS col FROM s
"""
)
def search_icase_az(spark, sf_dir):
    return search.hits(files(spark, sf_dir), "and", case_sensitive=False).select("path", "line", "col")


@query(
    """
WITH l AS (SELECT root, ord, path, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1)::INTEGER AS line FROM three)
SELECT root, path, line, unnest(list_transform(range(1, len(string_split(t, 'with'))), lambda k: 1 + list_sum(list_transform(string_split(t, 'with')[1:k], lambda x: length(x))) + 4 * (k - 1)))::INTEGER AS col FROM l WHERE contains(t, 'with')
"""
)
def search_multi_root(spark, sf_dir):
    return search.hits(three(spark, sf_dir), "with", keys=["root", "ord", "path"]).select("root", "path", "line", "col")


@query(
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line, col) AS n, count(*) OVER (PARTITION BY path) AS c FROM found)
SELECT path, line, col, c > 64 AS capped FROM r WHERE n <= 64
"""
)
def search_per_file_cap(spark, sf_dir):
    return search.per_file_cap(search.hits(files(spark, sf_dir), "the")).select("path", "line", "col", "capped")


@query(
    """
WITH r AS (SELECT path, line, col, row_number() OVER (ORDER BY path, line, col) AS n, count(*) OVER () AS c FROM found)
SELECT path, line, col, c > 50 AS truncated FROM r WHERE n <= 50
"""
)
def search_cap_flag(spark, sf_dir):
    rows, more = search.cap(search.hits(files(spark, sf_dir), "the").select("path", "line", "col"), ["path", "line", "col"], 50)
    return rows.withColumn("truncated", F.lit(more))


@query(
    r"""
WITH s AS (SELECT path, string_split(text, '.' || chr(10) || 'T') AS p, text FROM files WHERE contains(text, '.' || chr(10) || 'T')),
k AS (SELECT path, text, p, unnest(range(1, len(p))) AS k FROM s),
o AS (SELECT path, substr(text, 1, (list_sum(list_transform(p[1:k], lambda x: length(x))) + 3 * (k - 1))::BIGINT) AS b FROM k)
SELECT path, len(string_split(b, chr(10)))::INTEGER AS line, (length(string_split(b, chr(10))[-1]) + 1)::INTEGER AS col FROM o
"""
)
def search_multiline(spark, sf_dir):
    return search.hits(files(spark, sf_dir), ".\nT").select("path", "line", "col")


@query("SELECT path FROM files WHERE contains(text, 'tha') AND contains(text, 'hat')")
def candidate_files(spark, sf_dir):
    return search.candidates(search.postings(files(spark, sf_dir), only=search.query_keys("that")), "that").select("path")


@query("SELECT tri, count(*) AS df FROM grams GROUP BY tri")
def trigram_doc_freq(spark, sf_dir):
    return search.trigram_stats(search.postings(files(spark, sf_dir)))


@query("SELECT tri, count(*) AS df FROM grams GROUP BY tri ORDER BY df DESC, tri LIMIT 20")
def postings_topk(spark, sf_dir):
    return search.trigram_stats(search.postings(files(spark, sf_dir))).orderBy(F.desc("df"), "tri").limit(20)


@query("SELECT count(DISTINCT path) AS files, count(DISTINCT tri) AS terms, count(*) AS postings FROM grams")
def trigram_stats(spark, sf_dir):
    per_term = search.trigram_stats(search.postings(files(spark, sf_dir)))
    n = files(spark, sf_dir).agg(F.count_if(F.length("text") > 2).alias("files"))
    return per_term.agg(F.count("*").alias("terms"), F.sum("df").alias("postings")).crossJoin(n).select("files", "terms", "postings")


@query(
    r"""
SELECT path, line, col FROM found WHERE NOT regexp_matches(CASE WHEN col > 1 THEN substr(line_text, col - 1, 1) ELSE '' END, '[\p{L}\p{Nd}_]') AND NOT regexp_matches(substr(line_text, col + 3, 1), '[\p{L}\p{Nd}_]')
"""
)
def whole_word_hits(spark, sf_dir):
    return search.whole_words(search.hits(files(spark, sf_dir), "the"), 3).select("path", "line", "col")


@query(
    """
WITH w AS (SELECT path, line, col, line_text AS t, length(line_text) AS n, greatest(col - 121, 0) AS b FROM found),
e AS (SELECT *, least(n, greatest(b + 300, col + 3)) AS e FROM w)
SELECT path, line, col, CASE WHEN n <= 300 THEN t ELSE (CASE WHEN b > 0 THEN '…' ELSE '' END) || substr(t, b + 1, e - b) || (CASE WHEN e < n THEN '…' ELSE '' END) || ' (part of ' || format('{:,}', n) || ' characters in this line)' END AS shown,
(CASE WHEN n <= 300 THEN 0 ELSE b - (CASE WHEN b > 0 THEN 1 ELSE 0 END) END)::INTEGER AS shift FROM e
"""
)
def line_snippet(spark, sf_dir):
    h = search.hits(files(spark, sf_dir), "the")
    return h.select("path", "line", "col", tx.snippet(F.col("line_text"), F.col("col"), 3).alias("shown"), tx.snippet_offset(F.col("line_text"), F.col("col")).alias("shift"))


@query("SELECT (CASE WHEN root = 'src0' THEN path ELSE '/repos/' || root || '/' || path END) || ':' || line || ':' || col || ': ' || line_text AS answer FROM found WHERE length(line_text) <= 300")
def answer_lines(spark, sf_dir):
    h = search.hits(files(spark, sf_dir), "the").filter(F.length("line_text") <= 300)
    place = ps.display(F.col("path"), F.concat(F.lit("/repos/"), "root"), F.col("root") == "src0")
    return h.select(F.concat(place, F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"), F.lit(": "), tx.scrub(F.col("line_text"))).alias("answer"))


@query("SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) > 0")
def benchmark_containment(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return search.batch_contains(read("documents").select("doc_id", "text"), read("benchmark").select("item_id", "text"), "doc_id", "item_id")


# paths and classifiers

_EXT = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '\.[^.]+$'))"
_DIR = "list_has_any(string_split(lower(regexp_extract(path, '^(.*)/[^/]*$', 1)), '/'), [{}])"


@query(f"SELECT path FROM files WHERE {_DIR.format(', '.join(repr(d) for d in ps.IGNORED_DIRS))} OR {_EXT} IN ({', '.join(map(repr, ps.IGNORED_EXTENSIONS))})")
def ignored_paths(spark, sf_dir):
    return files(spark, sf_dir).filter(ps.ignored_path(F.col("path"))).select("path")


@query(f"SELECT path FROM files WHERE {_DIR.format(', '.join(repr(d) for d in ps.IGNORED_DIRS if d not in ('bin', 'build')))} OR {_DIR.format(repr('lib'))}")
def kept_folders(spark, sf_dir):
    return files(spark, sf_dir).filter(ps.in_ignored_dir(F.col("path"), extra=["lib"], keep=["bin", "Build"])).select("path")


@query(f"SELECT count(*) AS n FROM files WHERE {_DIR.format(', '.join(repr(d) for d in ps.AMBIGUOUS_DIRS))}")
def ambiguous_folders(spark, sf_dir):
    return files(spark, sf_dir).filter(ps.in_ambiguous_dir(F.col("path"))).agg(F.count("*").alias("n"))


@query(f"SELECT path FROM files WHERE {_EXT} NOT IN ({', '.join(map(repr, ps.NON_CODE_EXTENSIONS))})")
def code_files(spark, sf_dir):
    return files(spark, sf_dir).filter(ps.is_code(F.col("path"))).select("path")


@query("SELECT path, ends_with(lower(path), '.designer.cs') AS generated FROM files WHERE contains(path, '1') ORDER BY generated, path LIMIT 100")
def generated_last(spark, sf_dir):
    f = files(spark, sf_dir).filter(F.contains("path", F.lit("1")))
    return f.select("path", ps.is_generated(F.col("path")).alias("generated")).orderBy("generated", "path").limit(100)


@query(r"WITH h AS (SELECT path, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || ' # if DEBUG' WHEN doc_id % 3 = 1 THEN text || chr(10) || '#ifdef X' ELSE text END AS t FROM files) SELECT path FROM h WHERE regexp_matches(t, '(?m)^[ \t]*#[ \t]*(if|elif|else)([^\p{L}\p{Nd}]|$)')")
def conditional_files(spark, sf_dir):
    f = files(spark, sf_dir)
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n # if DEBUG"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("\n#ifdef X"))).otherwise(F.col("text"))
    return f.withColumn("text", t).filter(tx.has_conditional(F.col("text"))).select("path")


@query(
    r"""
WITH h AS (SELECT path, CASE WHEN doc_id % 4 = 0 THEN regexp_replace(text, '[g-wyzG-WYZ]', '0', 'g') ELSE text END AS t FROM files),
c AS (SELECT path, length(regexp_replace(t, '[ \t\n\r]', '', 'g')) AS ink, length(regexp_replace(t, '[^g-wyzG-WYZ]', '', 'g')) AS letters FROM h)
SELECT path, ink = 0 OR letters * 100 < ink * 2 AS is_numeric FROM c
"""
)
def numeric_blob_flag(spark, sf_dir):
    t = F.when(F.col("doc_id") % 4 == 0, F.regexp_replace("text", "[g-wyzG-WYZ]", "0")).otherwise(F.col("text"))
    return files(spark, sf_dir).select("path", tx.is_numeric_data(t).alias("is_numeric"))


@query(r"WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS name FROM documents) SELECT name FROM w WHERE regexp_full_match(name, '[\p{L}_][\p{L}\p{Nd}_]*')")
def identifier_filter(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.explode(F.split("text", " ", -1)).alias("name")).distinct().filter(tx.is_identifier(F.col("name")))


@query(r"SELECT path, NOT regexp_matches(path, '^([/\\]|[A-Za-z]:)') AND NOT regexp_matches(path, '(^|[/\\])\.\.([/\\]|$)') AND length(path) > 0 AS inside FROM (SELECT CASE doc_id % 3 WHEN 0 THEN '../' || path WHEN 1 THEN '/' || path ELSE path END AS path FROM files)")
def path_safety(spark, sf_dir):
    p = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("../"), "path")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("/"), "path")).otherwise(F.col("path"))
    return files(spark, sf_dir).select(p.alias("path")).select("path", ps.inside_repo(F.col("path")).alias("inside"))


@query("SELECT DISTINCT root, upper(sha256('/repos/' || lower(root))[1:16]) AS repo_key FROM files")
def repo_keys(spark, sf_dir):
    return files(spark, sf_dir).select("root").distinct().select("root", ps.repo_key(F.concat(F.lit("/repos/"), "root")).alias("repo_key"))


@query(f"SELECT path, {_EXT} = '.cs' AS csharp, {_EXT} IN ({', '.join(map(repr, ps.C_FAMILY_EXTENSIONS))}) AS c_family FROM files")
def language_flags(spark, sf_dir):
    return files(spark, sf_dir).select("path", ps.is_csharp(F.col("path")).alias("csharp"), ps.is_c_family(F.col("path")).alias("c_family"))


# statistics


_BUCKET = "CASE " + " ".join(f"WHEN size < {e} THEN {i}" for i, e in enumerate((1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072))) + " ELSE 8 END"


@query(f"SELECT ({_BUCKET})::INTEGER AS bucket, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY 1")
def size_histogram(spark, sf_dir):
    return stats.size_histogram(files(spark, sf_dir), (1024, 2048, 4096, 8192, 16384, 32768, 65536, 131072))


@query(
    """
WITH r AS (SELECT size, row_number() OVER (ORDER BY size) AS up, row_number() OVER (ORDER BY size DESC) AS down, count(*) OVER () AS n FROM files)
SELECT max(n) AS files, sum(size)::BIGINT AS bytes, max(size) AS largest, max(CASE WHEN up = n // 2 + 1 THEN size END) AS median,
sum(CASE WHEN down <= greatest(1, ceil(n * 0.01)) THEN size ELSE 0 END)::BIGINT::DOUBLE / sum(size)::BIGINT AS top1, sum(CASE WHEN down <= greatest(1, ceil(n * 0.02)) THEN size ELSE 0 END)::BIGINT::DOUBLE / sum(size)::BIGINT AS top2 FROM r
"""
)
def byte_share_top(spark, sf_dir):
    return stats.concentration(files(spark, sf_dir))


@query(
    """
WITH big AS (SELECT size * 200 AS size FROM files), r AS (SELECT size, row_number() OVER (ORDER BY size DESC) AS down, row_number() OVER (ORDER BY size) AS up, count(*) OVER () AS n FROM big),
a AS (SELECT max(n) AS n, sum(size)::BIGINT AS b, max(CASE WHEN up = n // 2 + 1 THEN size END) AS med, sum(CASE WHEN down <= greatest(1, ceil(n * 0.02)) THEN size ELSE 0 END)::BIGINT AS t2,
 sum(CASE WHEN size >= 1048576 AND size < 8388608 THEN size ELSE 0 END)::BIGINT AS mb, count(*) FILTER (WHERE size >= 1048576 AND size < 8388608) AS mf, count(*) FILTER (WHERE size >= 1073741824) AS h FROM r),
t AS (SELECT *, concat_ws(', ', CASE WHEN t2::DOUBLE / b >= 0.6 THEN 'byte-heavy' END, CASE WHEN n >= 20000 AND med < 4096 THEN 'count-heavy' END, CASE WHEN h > 0 THEN h || ' >1GB' END) AS tags FROM a)
SELECT CASE WHEN tags = '' THEN 'ordinary' ELSE tags END AS tags, mb::DOUBLE / b AS middle_share, (CASE WHEN mb::DOUBLE / b >= 0.04 OR mf >= 1000 THEN 2097152 ELSE 8388608 END)::BIGINT AS network_threshold FROM t
"""
)
def archetype(spark, sf_dir):
    return stats.archetype(files(spark, sf_dir).withColumn("size", F.col("size") * 200))


@query(f"SELECT {_EXT} AS ext, count(*) AS files FROM files GROUP BY 1 ORDER BY files DESC, ext LIMIT 12")
def ext_census(spark, sf_dir):
    return stats.extension_census(files(spark, sf_dir))


@query(
    f"""
WITH r AS (SELECT {_EXT} AS ext, size, path, row_number() OVER (PARTITION BY {_EXT} ORDER BY size) AS k, count(*) OVER (PARTITION BY {_EXT}) AS n, row_number() OVER (PARTITION BY {_EXT} ORDER BY size DESC, path) AS d FROM files)
SELECT ext, count(*) AS files, max(size) AS largest, max(CASE WHEN d = 1 THEN path END) AS largest_path, max(CASE WHEN k = ceil(n * 0.5::DOUBLE) THEN size END) AS p50, max(CASE WHEN k = ceil(n * 0.95::DOUBLE) THEN size END) AS p95 FROM r GROUP BY ext
"""
)
def ext_percentiles(spark, sf_dir):
    return stats.extension_sizes(files(spark, sf_dir))


@query("SELECT count(*) FILTER (WHERE size <= 20000) AS indexed_files, coalesce(sum(CASE WHEN size <= 20000 THEN size END), 0)::BIGINT AS indexed_bytes, count(*) FILTER (WHERE size <= 20000 AND size > 5000) AS over_symbol_cap, count(*) FILTER (WHERE size > 20000) AS over_file_cap FROM files")
def over_cap_survey(spark, sf_dir):
    return stats.survey(files(spark, sf_dir), 5000, 20000)


@query("SELECT path, size FROM files WHERE size > 5000 ORDER BY size DESC, path LIMIT 5")
def largest_files(spark, sf_dir):
    return files(spark, sf_dir).filter("size > 5000").select("path", "size").orderBy(F.desc("size"), "path").limit(5)


@query(
    """
WITH r AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS r, count(*) OVER () AS n FROM files)
SELECT path FROM r WHERE r IN (SELECT DISTINCT i * n // 20 FROM (SELECT unnest(range(20)) AS i), (SELECT count(*) AS n FROM files))
"""
)
def stride_sample(spark, sf_dir):
    return stats.stride_sample(files(spark, sf_dir).select("path"), ["path"], 20)


@query(f"SELECT {_EXT} AS ext, path, row_number() OVER (PARTITION BY {_EXT} ORDER BY path)::INTEGER AS turn, count(*) OVER (PARTITION BY {_EXT}) AS group_size FROM files")
def round_robin_spread(spark, sf_dir):
    return stats.round_robin(files(spark, sf_dir).select(ps.extension(F.col("path")).alias("ext"), "path"), "ext", ["path"])


@query("SELECT content_hash, min(path) AS path FROM files GROUP BY content_hash")
def first_per_name(spark, sf_dir):
    return stats.first_per(files(spark, sf_dir).select("content_hash", "path"), "content_hash", ["path"])


@query("SELECT root, sum(length(text) // 4)::BIGINT AS tokens, count(*) AS files, sum(length(text))::DOUBLE / count(*) AS mean_chars FROM files GROUP BY root")
def token_estimate(spark, sf_dir):
    n = F.length("text").cast("long")
    return files(spark, sf_dir).groupBy("root").agg(F.sum(F.floor(n / 4)).alias("tokens"), F.count("*").alias("files"), (F.sum(n).cast("double") / F.count("*")).alias("mean_chars"))


# changes


@query("SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.content_hash <> n.content_hash THEN 'modified' ELSE 'same' END AS change FROM old o FULL JOIN new n ON o.path = n.path")
def snapshot_diff(spark, sf_dir):
    return changes.snapshot_diff(*snapshots(spark, sf_dir), keep_same=True)


@query("WITH d AS (SELECT CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.content_hash <> n.content_hash THEN 'modified' ELSE 'same' END AS change FROM old o FULL JOIN new n ON o.path = n.path) SELECT change, count(*) AS n FROM d WHERE change <> 'same' GROUP BY change")
def change_counts(spark, sf_dir):
    return changes.change_counts(changes.snapshot_diff(*snapshots(spark, sf_dir)))


@query("SELECT count(*) AS n, count(*) > 2000 AS rebuild FROM old o FULL JOIN new n ON o.path = n.path WHERE o.content_hash IS DISTINCT FROM n.content_hash")
def rebuild_decision(spark, sf_dir):
    n = changes.snapshot_diff(*snapshots(spark, sf_dir)).agg(F.count("*").alias("n"))
    return n.select("n", changes.needs_rebuild(F.col("n")).alias("rebuild"))


@query("WITH over AS (SELECT * FROM new WHERE path LIKE 'src1%') SELECT path, content_hash FROM old WHERE path NOT IN (SELECT path FROM over) AND path NOT LIKE 'src2/%' UNION ALL SELECT path, content_hash FROM over")
def ledger_merge(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    return changes.merge_ledger(old, new.filter(F.col("path").startswith("src1")), old.filter(F.col("path").startswith("src2/")))


@query("SELECT path FROM old WHERE path NOT IN (SELECT path FROM new)")
def unseen_keys(spark, sf_dir):
    return changes.unseen(*snapshots(spark, sf_dir))


@query(
    """
WITH s AS (SELECT path FROM files UNION ALL SELECT upper(path[1:1]) || path[2:] FROM files WHERE doc_id % 23 = 0)
SELECT lower(path) AS folded, array_to_string(list_sort(list(path)), '|') AS spellings, count(*) AS n FROM (SELECT DISTINCT path FROM s) GROUP BY 1 HAVING count(*) > 1
"""
)
def case_collisions(spark, sf_dir):
    f = files(spark, sf_dir)
    more = f.filter("doc_id % 23 = 0").select(F.concat(F.upper(F.substring("path", 1, 1)), F.expr("substring(path, 2)")).alias("path"))
    return changes.case_collisions(f.select("path").union(more)).withColumn("spellings", F.array_join("spellings", "|"))


_ROLL = """
leaf AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, string_agg('F' || regexp_extract(path, '[^/]*$') || ':' || content_hash || chr(10), '' ORDER BY path) AS c FROM {t} GROUP BY 1),
h3 AS (SELECT dir, upper(sha256(c)) AS hash FROM leaf),
h2 AS (SELECT regexp_extract(dir, '^(.*)/[^/]*$', 1) AS d, upper(sha256(string_agg('D' || regexp_extract(dir, '[^/]*$') || ':' || hash || chr(10), '' ORDER BY regexp_extract(dir, '[^/]*$')))) AS hash FROM h3 GROUP BY 1),
h1 AS (SELECT regexp_extract(d, '^(.*)/[^/]*$', 1) AS e, upper(sha256(string_agg('D' || regexp_extract(d, '[^/]*$') || ':' || hash || chr(10), '' ORDER BY regexp_extract(d, '[^/]*$')))) AS hash FROM h2 GROUP BY 1),
h0 AS (SELECT upper(sha256(string_agg('D' || e || ':' || hash || chr(10), '' ORDER BY e))) AS hash FROM h1),
roll AS (SELECT dir, hash FROM h3 UNION ALL SELECT d, hash FROM h2 UNION ALL SELECT e, hash FROM h1 UNION ALL SELECT '', hash FROM h0)
"""


@query("WITH " + _ROLL.format(t="files").strip() + " SELECT dir, hash FROM roll")
def dir_hash_rollup(spark, sf_dir):
    return changes.directory_hashes(files(spark, sf_dir))


@query(
    "WITH changed AS (SELECT path, CASE WHEN root = 'src3' AND doc_id % 9 = 0 THEN upper(md5(text || 'x')) ELSE content_hash END AS content_hash FROM files), "
    "touched AS (SELECT DISTINCT path FROM files WHERE root = 'src3' AND doc_id % 9 = 0), p AS (SELECT string_split(path, '/') AS s FROM touched) "
    "SELECT DISTINCT dir FROM (SELECT unnest([s[1] || '/' || s[2] || '/' || s[3], s[1] || '/' || s[2], s[1], '']) AS dir FROM p)"
)
def dir_diff(spark, sf_dir):
    f = files(spark, sf_dir)
    edited = F.when((F.col("root") == "src3") & (F.col("doc_id") % 9 == 0), F.upper(F.md5(F.concat("text", F.lit("x"))))).otherwise(F.col("content_hash"))
    return changes.changed_directories(changes.directory_hashes(f, 3), changes.directory_hashes(f.withColumn("content_hash", edited), 3))


_TICKS = "(epoch_us(ts) * 10 + 621355968000000000)"
_SIZE = "(value * 100)::BIGINT"


@query(
    f"""
WITH e AS (SELECT event_id, floor(value * 100)::BIGINT AS size, CASE WHEN event_id % 5 = 0 THEN -{_TICKS} ELSE {_TICKS} END AS m, {_TICKS} AS lm, floor(value * 100)::BIGINT + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS ls,
 CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS hashed, CASE WHEN event_id % 2 = 0 THEN {_TICKS} + 20000000 ELSE {_TICKS} + 40000000 END AS by_ FROM events)
SELECT event_id, m > 0 AND size = ls AND m = lm AND (hashed > 0 OR (by_ > 0 AND m <= by_ - 30000000)) AS trusted FROM e
"""
)
def ledger_trust(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t, size = changes.ticks(F.col("ts")), F.floor(F.col("value") * 100).cast("long")
    n = F.col("event_id")
    ok = changes.matches_listing(
        size, F.when(n % 5 == 0, -t).otherwise(t), F.when(n % 3 == 0, 0).otherwise(1), size + F.when(n % 7 == 0, 1).otherwise(0), t, F.when(n % 2 == 0, t + 20000000).otherwise(t + 40000000)
    )
    return e.select("event_id", ok.alias("trusted"))


@query(
    f"""
WITH e AS (SELECT event_id, {_TICKS} AS m, {_TICKS} + (event_id % 4) * 15000000 AS start, CASE WHEN event_id % 3 = 0 THEN -{_TICKS} ELSE 0 END AS pm, {_TICKS} - 20000000 AS anchor FROM events)
SELECT event_id, CASE WHEN m <= start - 30000000 THEN m WHEN pm = -m AND start >= anchor + 30000000 THEN m ELSE -m END AS recorded FROM e
"""
)
def recorded_mtime(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t, n, zero = changes.ticks(F.col("ts")), F.col("event_id"), F.lit(0).cast("long")
    got = changes.recorded_mtime(t, zero, t + (n % 4) * 15000000, F.when(n % 3 == 0, -t).otherwise(zero), zero, zero, t - 20000000, zero)
    return e.select("event_id", got.alias("recorded"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS r FROM feed) SELECT path, event_id, is_delete FROM r WHERE r = 1")
def latest_doc_per_path(spark, sf_dir):
    return changes.latest(feed(spark, sf_dir), ["path"], ["ts", "event_id"]).select("path", "event_id", "is_delete")


@query("SELECT event_id, path FROM feed f WHERE NOT is_delete AND NOT EXISTS (SELECT 1 FROM feed d WHERE d.is_delete AND d.path = f.path AND d.batch_id = f.batch_id)")
def tombstone_antijoin(spark, sf_dir):
    f = feed(spark, sf_dir)
    return changes.live(f.filter("not is_delete"), f.filter("is_delete").select("path", "batch_id").distinct(), ["path", "batch_id"]).select("event_id", "path")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY batch_id DESC, event_id DESC) AS r FROM feed) SELECT path, batch_id AS segment, event_id FROM r WHERE r = 1 AND NOT is_delete")
def segment_merge(spark, sf_dir):
    last = changes.latest(feed(spark, sf_dir), ["path"], ["batch_id", "event_id"])
    return last.filter("not is_delete").select("path", F.col("batch_id").alias("segment"), "event_id")


@query(
    """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY user_id, k
"""
)
def debounce_batches(spark, sf_dir):
    return changes.quiet_batches(feed(spark, sf_dir), "user_id", "6 hours")


@query("SELECT batch_id, path, bool_or(structural) AS structural, count(*) AS n_events FROM feed GROUP BY batch_id, path")
def coalesce_changes(spark, sf_dir):
    return changes.coalesce_events(feed(spark, sf_dir))


# federation


@query("SELECT DISTINCT '/repos/' || root AS root FROM files WHERE contains('/repos/' || root, 'src1')  AND root = 'src1'")
def focus_roots(spark, sf_dir):
    return refs.focus(files(spark, sf_dir).select(F.concat(F.lit("/repos/"), "root").alias("root")).distinct(), "src1")


@query("SELECT DISTINCT '/repos/' || root AS root FROM files WHERE contains('/repos/' || root, 'rc1')")
def focus_part(spark, sf_dir):
    return refs.focus(files(spark, sf_dir).select(F.concat(F.lit("/repos/"), "root").alias("root")).distinct(), "rc1")


@query("SELECT root, count(*) AS files, sum(length(text))::BIGINT AS chars FROM three WHERE root IN ('documents', 'pages') GROUP BY root")
def federated_union(spark, sf_dir):
    f = three(spark, sf_dir).filter(F.col("root").isin("documents", "pages"))
    return f.groupBy("root").agg(F.count("*").alias("files"), F.sum(F.length("text").cast("long")).alias("chars"))


@query(
    """
WITH a AS (SELECT path, line, col, 'first' AS layer FROM found WHERE col % 2 = 0), b AS (SELECT path, line, col, 'second' AS layer FROM found WHERE col % 3 = 0)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE col % 2 <> 0
"""
)
def dedup_precedence(spark, sf_dir):
    h = search.hits(files(spark, sf_dir), "the").select("path", "line", "col")
    first = h.filter("col % 2 = 0").withColumn("layer", F.lit("first"))
    second = h.filter("col % 3 = 0").withColumn("layer", F.lit("second"))
    return refs.merge_layers(first, second, ["path", "line", "col"])


@query("WITH l AS (SELECT root, list(path ORDER BY lower(path), path) AS p FROM files GROUP BY root) SELECT root, array_to_string(p[1:5], ', ') || CASE WHEN len(p) > 5 THEN ', +' || (len(p) - 5) || ' more' ELSE '' END AS shown, len(p) AS n FROM l")
def file_list_note(spark, sf_dir):
    return refs.file_list(files(spark, sf_dir).select("root", "path"), ["root"])


@query("WITH l AS (SELECT path, CASE WHEN col % 2 = 0 THEN 'first' ELSE 'second' END AS layer FROM found) SELECT layer, count(*) AS n, count(DISTINCT path) AS files FROM l GROUP BY layer")
def answer_footer(spark, sf_dir):
    h = search.hits(files(spark, sf_dir), "the")
    return report.answer_footer(h.withColumn("layer", F.when(F.col("col") % 2 == 0, "first").otherwise("second")))


@query("WITH m AS (SELECT root, count(*) AS files, count(*) FILTER (WHERE size > 20000) AS a, count(*) FILTER (WHERE size > 5000) AS b, 0 AS c FROM files GROUP BY root) SELECT sum(files)::BIGINT AS files, sum(a)::BIGINT AS files_over_cap, sum(b)::BIGINT AS symbol_skipped, sum(c)::BIGINT AS dropped_dirs, count(*) AS roots FROM m")
def coverage(spark, sf_dir):
    size = F.col("size")
    m = files(spark, sf_dir).groupBy("root").agg(
        F.count("*").alias("files"), F.count_if(size > 20000).alias("files_over_cap"), F.count_if(size > 5000).alias("symbol_skipped"), F.lit(0).alias("dropped_dirs")
    )
    return report.coverage(m)


@query("SELECT sum(length(line_text))::BIGINT // 4 AS answer_tokens, (SELECT sum(length(text))::BIGINT // 4 FROM files WHERE contains(text, 'the')) AS file_tokens FROM found")
def token_savings(spark, sf_dir):
    f = files(spark, sf_dir)
    return report.savings(search.hits(f, "the"), f)


@query("WITH g AS (SELECT user_id, event_id, value / lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS growth FROM events WHERE value > 0) SELECT * FROM g WHERE growth IS NOT NULL")
def growth(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value > 0")
    return report.growth(e, "user_id", "event_id", "value").select("user_id", "event_id", "growth").filter("growth is not null")


@query("SELECT user_id, event_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) = 1 AS past_knee FROM events")
def knee(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return report.knee(e, "user_id", "event_id", F.col("event_type") == "error").select("user_id", "event_id", "past_knee")


@query("SELECT root, path, line, col FROM found WHERE substr(line_text, col, 3) <> 'the'")
def misplaced_hits(spark, sf_dir):
    f = files(spark, sf_dir)
    return report.misplaced(search.hits(f, "the"), f, "the")


# blocks


@query("SELECT path, unnest(list_transform(range(1, len(string_split(text, 'tion'))), lambda k: list_sum(list_transform(string_split(text, 'tion')[1:k], lambda x: length(x))) + 4 * (k - 1)))::BIGINT AS start FROM files WHERE contains(text, 'tion')")
def block_prune(spark, sf_dir):
    b = materialize(blocks.blocks(files(spark, sf_dir), 2048, 64), "blocks")
    return blocks.block_hits(b, materialize(blocks.filters(b), "filters"), "tion", 64).select("path", "start")


@query("SELECT path, line, col FROM found")
def block_search(spark, sf_dir):
    b = blocks.blocks(files(spark, sf_dir), 2048, 64)
    return blocks.block_lines(b, blocks.filters(b), "the", seam=64).select("path", "line", "col")


@query("SELECT path, count(*) AS lines FROM lines WHERE contains(upper(line_text), 'AND') GROUP BY path")
def block_search_icase(spark, sf_dir):
    b = blocks.blocks(files(spark, sf_dir), 2048, 64)
    found = blocks.block_lines(b, blocks.filters(b), "and", False, 64)
    return found.groupBy("path").agg(F.count_distinct("line").alias("lines"))


@query("SELECT path, count(*) AS lines FROM lines GROUP BY path")
def block_start_lines(spark, sf_dir):
    b = blocks.blocks(files(spark, sf_dir), 2048, 1)
    last = F.col("start_line") + F.size(tx.lines(F.col("text"))) - 1
    return b.filter("seam = ''").groupBy("path").agg(F.sum(last).alias("lines"))  # several texts may share a path, or have none


# code: every document as a source file


def code(spark, sf_dir):
    return codeset.corpus(spark, sf_dir)


@query("SELECT root, path, name, kind, line, col, end_line FROM symbols")
def symbols_extract(spark, sf_dir):
    return symbols.extract(code(spark, sf_dir))


@query("SELECT root, path, caller, name, line, col, seq, inactive FROM calls")
def calls_extract(spark, sf_dir):
    return symbols.calls(code(spark, sf_dir))


@query("SELECT root, path, sl, sc, el, ec FROM spans")
def comment_spans(spark, sf_dir):
    return symbols.spans(code(spark, sf_dir))


@query("SELECT regexp_extract(path, '\\.[^.]+$') AS ext, count(DISTINCT path) AS files, count(*) AS symbols FROM symbols GROUP BY 1")
def symbols_per_extension(spark, sf_dir):
    return report.symbols_per_extension(symbols.extract(code(spark, sf_dir)))


@query("SELECT c.name, count(*) AS uses FROM calls c WHERE c.name IN (SELECT name FROM symbols) GROUP BY 1 ORDER BY uses DESC, c.name LIMIT 10")
def broad_names(spark, sf_dir):
    f = code(spark, sf_dir)
    return report.broad_names(symbols.extract(f), symbols.calls(f))


@query("SELECT root, path, name, kind, line, col, end_line, path || ':' || line || CASE WHEN end_line > line THEN '-' || end_line ELSE '' END || ':' || col || ': ' || kind || ' ' || name AS location FROM symbols WHERE name = 'f7'")
def definitions(spark, sf_dir):
    return symbols.location(symbols.by_name(symbols.extract(code(spark, sf_dir)), "f7"))


@query("SELECT root, path, name, kind, line, col, end_line, false AS generated FROM symbols WHERE contains(upper(name), 'F1')")
def symbols_matching(spark, sf_dir):
    return symbols.matching(symbols.extract(code(spark, sf_dir)), "f1")


@query("SELECT root, path, line, col, false AS capped, 'name' AS layer FROM uses WHERE name = 'f7'")
def references_by_name(spark, sf_dir):
    f = code(spark, sf_dir).drop("doc_id")
    return refs.references(f, symbols.extract(f), symbols.spans(f), "ns::f7").drop("line_text")


@query("SELECT path, count(*) AS n FROM uses WHERE name = 'f7' GROUP BY path")
def references_per_file(spark, sf_dir):
    f = code(spark, sf_dir).drop("doc_id")
    return refs.references(f, symbols.extract(f), symbols.spans(f), "f7").groupBy("path").agg(F.count("*").alias("n"))


@query(
    """
WITH own AS (SELECT name, bool_and(inactive) AS off, min({'root': root, 'path': path, 'seq': seq}) AS at FROM calls WHERE caller = 'f7' GROUP BY name)
SELECT 'f7' AS caller, o.name, s.root, s.path, s.line, s.col, CASE WHEN o.off THEN 'inactive_branch' ELSE 'name' END AS how, o.at.seq AS seq, o.at.path AS caller_path
FROM own o JOIN symbols s ON s.name = o.name AND s.kind IN ('Method', 'Function')
"""
)
def callees_by_name(spark, sf_dir):
    f = code(spark, sf_dir)
    return refs.callees(symbols.calls(f), symbols.extract(f), "f7")


@query("SELECT DISTINCT caller, name, inactive FROM calls WHERE inactive")
def inactive_calls(spark, sf_dir):
    return symbols.calls(code(spark, sf_dir)).filter("inactive").select("caller", "name", "inactive").distinct()


@query("SELECT 'f' || (doc_id % 50) AS name, count(*) AS n FROM code WHERE doc_id % 7 <> 6 GROUP BY 1")
def definition_counts(spark, sf_dir):
    found = symbols.extract(code(spark, sf_dir)).filter(F.col("kind").isin("Function", "Method") & F.col("name").rlike("^f[0-9]+$") & ~F.col("path").endswith(".cmm"))
    return found.groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT root, path, 'conditional' AS reason FROM code WHERE doc_id % 7 = 1 UNION ALL SELECT root, path, 'clash' FROM code WHERE doc_id % 7 = 1 AND doc_id % 3 = 0")
def incomplete_files(spark, sf_dir):
    f = code(spark, sf_dir)
    f = f.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nusing X = System.Text;\n"))).otherwise(F.col("text")))
    return refs.incompleteness(f, f.select("root", "path"))


@query("SELECT root, path, line, col, doc_id % 4 = 0 AS stale FROM (SELECT s.*, c.doc_id FROM uses s JOIN code c USING (root, path)) WHERE name = 'f7'")
def stale_hits(spark, sf_dir):
    f = code(spark, sf_dir)
    rows = refs.references(f.drop("doc_id"), symbols.extract(f), symbols.spans(f), "f7").select("root", "path", "line", "col")
    now = f.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.lit("gone")).otherwise(F.col("text")))
    return refs.outside_spans_or_stale(rows, symbols.spans(now), now, "f7")


@query(
    r"""
SELECT path, 'A.B' || doc_id % 3 AS name FROM files WHERE doc_id % 6 = 0 UNION ALL SELECT path, 'C' FROM files WHERE doc_id % 6 = 0
"""
)
def global_usings(spark, sf_dir):
    f = files(spark, sf_dir)
    mark = F.concat(F.lit('<Project>\n<Using Include="A.B'), (F.col("doc_id") % 3).cast("string"), F.lit('" />\n<using Static="x"\n include = "C"/> '))
    return report.global_usings(f.withColumn("text", F.when(F.col("doc_id") % 6 == 0, F.concat(mark, "text")).otherwise(F.col("text")))).select("path", "name")


_QUALIFIED = ["Widget::spin", "std::vector<std::string>", "operator<<", "A::operator<<", "plain", "ns::T<a>::f", "a::b<c::d<e>>::g<h>"]
_MEMBERS = ["spin", "vector", "operator<<", "operator<<", "plain", "f", "g"]


@query(f"SELECT doc_id, ({_MEMBERS})[doc_id % 7 + 1] AS member FROM documents")
def qualified_members(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = {n: refs.member_of_qualified(n) for n in _QUALIFIED}
    pick = F.element_at(F.array(*[F.lit(n) for n in _QUALIFIED]), (F.col("doc_id") % 7 + 1).cast("int"))
    return d.select("doc_id", F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), pick).alias("member"))


# ignore files

GITIGNORE = {"": "*.json\n!*/docs/**/1*.json\nnode_modules/\n/src1/b*n/\n", "src2": "*.md\n"}
CLASSES = {"": "# odd\nsrc[0-2]/l?b/\n[!1-4]*.c\n!**/en/*.c\n\\!x\n", "src0/docs": "/en\n**/5*.py\n"}


@query(
    r"""
SELECT path FROM files WHERE NOT (path LIKE '%/node\_modules/%' ESCAPE '\' OR path LIKE 'src1/bin/%' OR (path LIKE '%.json' AND NOT regexp_matches(path, '^[^/]+/docs/(.*/)?1[^/]*\.json$')) OR (path LIKE 'src2/%' AND path LIKE '%.md'))
"""
)
def gitignore_eval(spark, sf_dir):
    return ignore.not_ignored(files(spark, sf_dir).select("path"), {k: ignore.parse(v) for k, v in GITIGNORE.items()})


@query(
    r"""
SELECT path FROM files WHERE NOT (regexp_matches(path, '^src[0-2]/l.b/') OR (regexp_matches(path, '/[^1-4/][^/]*\.c$') AND NOT regexp_matches(path, '/en/[^/]*\.c$')) OR path LIKE 'src0/docs/en/%' OR regexp_matches(path, '^src0/docs/.*/5[^/]*\.py$'))
"""
)
def gitignore_classes(spark, sf_dir):
    return ignore.not_ignored(files(spark, sf_dir).select("path"), {k: ignore.parse(v) for k, v in CLASSES.items()})


# answers, self-checks, traces


@query("SELECT (CASE WHEN root = 'src0' THEN path ELSE '/repos/' || root || '/' || path END) AS path, line, line AS end_line, col, line_text AS rest FROM found WHERE length(line_text) <= 300 AND NOT contains(line_text, chr(13))")
def parsed_answers(spark, sf_dir):
    found = answer_lines(spark, sf_dir)
    return report.parse_answers(found)


@query("SELECT path, line, CASE WHEN end_line > line THEN end_line ELSE line END AS end_line, col, kind || ' ' || name AS rest FROM symbols WHERE name = 'f7'")
def parsed_definitions(spark, sf_dir):
    return report.parse_answers(definitions(spark, sf_dir), "location")


@query("WITH a AS (SELECT path, line, col FROM found WHERE col % 2 = 0), b AS (SELECT path, line, col FROM found WHERE col % 3 = 0) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS missing, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS extra")
def set_difference(spark, sf_dir):
    h = search.hits(files(spark, sf_dir), "the").select("path", "line", "col")
    return report.set_difference(h.filter("col % 2 = 0"), h.filter("col % 3 = 0"))


@query("SELECT root, path, line, col FROM found WHERE col % 5 = 0")
def misplaced_rows(spark, sf_dir):
    f = files(spark, sf_dir)
    moved = search.hits(f, "the").withColumn("col", F.when(F.col("col") % 5 == 0, F.col("col") + 100000).otherwise(F.col("col")))
    return report.misplaced(moved, f, "the").withColumn("col", F.col("col") - 100000)


def trace(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("user_id").cast("string").alias("path"), (F.col("event_id") % 2 == 0).alias("has_blocks"), F.floor(F.abs("value") * 100).cast("long").alias("bytes"), "event_type", "value")


@query("SELECT event_id % 2 = 0 AS has_blocks, count(*) AS reads, sum(floor(abs(value) * 100)::BIGINT)::BIGINT AS bytes FROM events GROUP BY 1")
def io_totals(spark, sf_dir):
    return report.io_totals(trace(spark, sf_dir))


@query("SELECT user_id::VARCHAR AS path, sum(floor(abs(value) * 100)::BIGINT)::BIGINT AS bytes FROM events GROUP BY 1 ORDER BY bytes DESC, path LIMIT 15")
def biggest_readers(spark, sf_dir):
    return report.biggest_readers(trace(spark, sf_dir))


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(CASE WHEN k = ceil(n * 0.5::DOUBLE) THEN value END) AS p50, max(CASE WHEN k = ceil(n * 0.95::DOUBLE) THEN value END) AS p95, max(CASE WHEN k = ceil(n * 0.99::DOUBLE) THEN value END) AS p99 FROM r GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return stats.nearest_rank(trace(spark, sf_dir), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("WITH s AS (SELECT root, sum(size)::BIGINT AS bytes FROM files GROUP BY root) SELECT root, bytes, bytes::DOUBLE / (SELECT sum(bytes)::BIGINT FROM s) AS share FROM s")
def cache_sizes(spark, sf_dir):
    return report.cache_list(files(spark, sf_dir).select("root", F.col("size").alias("bytes")))


# remaining predicates


@query("SELECT path, length(text) > 3000 AND doc_id % 5 IN (0, 1, 4) AS skipped FROM files")
def skipped_for_size(spark, sf_dir):
    f = files(spark, sf_dir).select("path", "text")
    return f.select("path", symbols.skipped(F.col("path"), F.col("text"), 3000).alias("skipped"))


@query(r"SELECT path, CASE WHEN length(t) <= 300 THEN t ELSE substr(t, 1, 300) || '… (part of ' || format('{:,}', length(t)) || ' characters in this line)' END AS shown FROM (SELECT path, string_split(text, chr(10))[1] AS t FROM files)")
def first_lines(spark, sf_dir):
    line = F.get(tx.lines(F.col("text")), F.lit(0))
    return files(spark, sf_dir).select("path", tx.head(line).alias("shown"))


@query("SELECT event_id, ts FROM events")
def ticks_round_trip(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    back = changes.from_ticks(changes.ticks(F.col("ts")))
    return e.select("event_id", back.cast(dict(e.dtypes)["ts"]).alias("ts"))


_ENDS = ["", ".cs", "\\(", "\\w", "\\", "\\<", "x*", "[a]", "a|b", "$"]


@query(f"WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS t FROM documents), p AS (SELECT DISTINCT t || ({_ENDS})[length(t) % 10 + 1] AS t FROM w) " .replace("\\\\", "\\") + r"SELECT t AS pattern, NOT regexp_full_match(t, '(?s)(?:[^\\|*+?()\[\]{}^$]|\\[^\p{L}\p{N}<>])*') AS is_regex FROM p")
def regex_patterns(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = d.select(F.explode(F.split("text", " ", -1)).alias("t")).distinct()
    end = F.element_at(F.array(*[F.lit(x) for x in _ENDS]), (F.length("t") % 10 + 1).cast("int"))
    return words.select(F.concat("t", end).alias("pattern")).distinct().withColumn("is_regex", tx.looks_like_regex(F.col("pattern")))


@query("SELECT DISTINCT n.n_name AS project FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE s.s_suppkey % 7 = 3 AND n.n_name <> 'CHINA'")
def linking_projects(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    links = s.select(F.col("n_name").alias("project"), F.concat(F.lit("root"), (F.col("s_suppkey") % 7).cast("string")).alias("linked_root"))
    return refs.linking_projects(links, "root3", "CHINA")


@query("SELECT event_id FROM events WHERE NOT (event_type = 'click' AND event_id % 4 = 0)")
def folder_changes(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "click", "changed").otherwise(F.col("event_type"))
    return report.without_folder_changes(e.select("event_id", kind.alias("kind"), (F.col("event_id") % 4 == 0).alias("is_dir"))).select("event_id")


@query(f"SELECT path FROM files WHERE NOT ({_DIR.format(', '.join(repr(d) for d in ps.IGNORED_DIRS))} OR {_EXT} IN ({', '.join(map(repr, ps.IGNORED_EXTENSIONS))}))")
def pruned_rows(spark, sf_dir):
    return report.prune_ignored(files(spark, sf_dir)).select("path")


_SUFFIXES = [".designer.cs", ".Designer.vb", ".g.cs", ".g.i.cs", ".generated.cs", ".cs", ".g.ts"]


@query(f"SELECT p AS path, regexp_matches(lower(p), '\\.(designer\\.cs|designer\\.vb|g\\.cs|g\\.i\\.cs|generated\\.cs)$') AS generated FROM (SELECT doc_id || ({_SUFFIXES})[doc_id % 7 + 1] AS p FROM documents)")
def generated_files(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    p = F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*[F.lit(x) for x in _SUFFIXES]), (F.col("doc_id") % 7 + 1).cast("int")))
    return d.select(p.alias("path")).withColumn("generated", ps.is_generated(F.col("path")))


@query("SELECT DISTINCT '/repos/' || root AS root FROM files WHERE root = 'src1' UNION ALL SELECT '/work/src1'")
def focus_tiers(spark, sf_dir):
    every = files(spark, sf_dir).select(F.concat(F.lit("/repos/"), "root").alias("root")).distinct()
    more = spark.createDataFrame([("/work/src1",), ("/other/src1x",)], "root string")
    return refs.focus(every.union(more), "SRC1")


@query(r"SELECT path, line, col, regexp_extract(substr(line_text, col), '^[\p{L}\p{Nd}_]*') AS identifier FROM found")
def identifiers_at(spark, sf_dir):
    h = search.hits(files(spark, sf_dir), "the")
    return h.select("path", "line", "col", tx.identifier_at(F.col("line_text"), F.col("col")).alias("identifier"))


@query(r"SELECT path FROM files WHERE regexp_matches(text, '(^|[^\p{L}\p{Nd}_])the($|[^\p{L}\p{Nd}_])')")
def files_with_word(spark, sf_dir):
    return files(spark, sf_dir).filter(tx.has_whole_word(F.col("text"), "the")).select("path")


@query(r"SELECT path, regexp_matches(path, '^[^/]+$') AS bare, starts_with(lower(path) || '/', 'src1/lib/') AS under FROM (SELECT CASE doc_id % 3 WHEN 0 THEN regexp_extract(path, '[^/]*$') WHEN 1 THEN upper(path) ELSE path END AS path FROM files UNION ALL SELECT 'src1/LIB')")
def path_places(spark, sf_dir):
    f, path = files(spark, sf_dir), F.col("path")
    p = f.select(F.when(F.col("doc_id") % 3 == 0, ps.basename(path)).when(F.col("doc_id") % 3 == 1, F.upper(path)).otherwise(path).alias("path"))
    p = p.union(spark.range(1).select(F.lit("src1/LIB")))
    return p.select("path", ps.is_bare_name(path).alias("bare"), ps.is_under(path, F.lit("Src1\\lib/")).alias("under"))


@query(r"WITH n AS (SELECT root, path, count(*) AS n FROM symbols GROUP BY root, path) SELECT regexp_extract(c.path, '\.[^.]+$') AS ext, count(*) AS files, count(n) AS with_symbols, 0::BIGINT AS skipped, coalesce(max(n), 0) AS most_symbols FROM code c LEFT JOIN n USING (root, path) GROUP BY 1")
def symbol_profile(spark, sf_dir):
    f = code(spark, sf_dir)
    return report.symbol_profile(f, symbols.extract(f))


@query("SELECT path, content_hash FROM old WHERE path >= 'src1/' AND path < 'src2/bin' AND path LIKE 'src2/%'")
def ledger_entries(spark, sf_dir):
    return changes.entries(snapshots(spark, sf_dir)[0], prefix="src2/", first="src1/", last="src2/bin")


@query("SELECT user_id, (count(*) * (user_id % 40))::BIGINT AS n_overlay, count(*) * (user_id % 40) >= least(50000, greatest(1024, (max(event_id) * 4) // 32)) AS due FROM events GROUP BY user_id")
def fold_decision(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id")
    e = e.agg((F.count("*") * (F.col("user_id") % 40)).cast("long").alias("n_overlay"), (F.max("event_id") * 4).alias("n_base"))
    return e.select("user_id", "n_overlay", changes.fold_due(F.col("n_overlay"), F.col("n_base")).alias("due"))


# batches


@query("SELECT event_id, ((row_number() OVER (ORDER BY ts, event_id) - 1) // 1000)::BIGINT AS batch_no FROM events")
def capped_batches(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return changes.capped_batches(e.select("event_id", "ts"), ["ts", "event_id"], 1000).select("event_id", "batch_no")


@query(
    """
WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
f AS (SELECT *, min(ts) OVER (PARTITION BY user_id, k) AS f FROM s)
SELECT user_id, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM f GROUP BY user_id, k, (epoch_us(ts) - epoch_us(f)) // 43200000000
"""
)
def debounce_max_wait(spark, sf_dir):
    return changes.quiet_batches(feed(spark, sf_dir), "user_id", "6 hours", 12 * 3600 * 1000)


@query("SELECT DISTINCT path FROM feed WHERE batch_id = 1 AND path NOT IN (SELECT path FROM feed WHERE batch_id = 1 AND event_id % 3 <> 0) UNION SELECT path FROM feed WHERE batch_id = 2")
def retried_paths(spark, sf_dir):
    f = feed(spark, sf_dir)
    answers = f.filter("batch_id = 1").select("path", F.when(F.col("event_id") % 3 != 0, F.lit(True)).alias("listed"))
    held = changes.held_back(f.filter("batch_id = 1"), answers)
    return changes.next_batch(f.filter("batch_id = 2"), held)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
