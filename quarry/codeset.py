"""Source files made from the rows of ``documents``, for the queries over code.

Every document becomes one file of one of seven languages: its text stands in
a comment at the top, so places in the file depend on it, and definitions,
calls, strings and comments of known shape follow.  Names repeat every
``NAMES`` documents, so a name is defined and used in many files.

Each template is written once, as lines with marks: {w} for the document's
words, {f} for the name defined, {g} for the name called, {i} for the id.
``spark_text`` and ``sql_text`` render it for Spark and for SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = 50
ENDINGS = (".c", ".cs", ".py", ".ts", ".go", ".rs", ".cmm")
TEMPLATES = (
    '/*{w}*/\nstruct s{i} { int v; };\nint {f}(int x) {\n    log_line("{f}");\n    return {g}(x) + 1;\n}\n',
    "/*{w}*/\nnamespace App {\n  public class P{i} {\n    // {f}\n    public int {f}(int x) { return {g}(x); }\n#if DEBUG\n    void D{i}() { {f}(0); }\n#endif\n  }\n}\n",
    '"""{w}"""\ndef {f}(x):\n    return {g}(x) + 1\n\n\nclass H{i}:\n    def run(self):\n        return {f}(2)\n',
    "/*{w}*/\nexport class V{i} { show() { return {f}(1); } }\nfunction {f}(x: number) { return x; }\n",
    "/*{w}*/\npackage p\n\nfunc {f}(x int) int {\n\treturn {g}(x)\n}\n\ntype T{i} struct {}\n",
    "/*{w}*/\nmod m{i} {\n  fn {f}(x: i32) { {g}(x); }\n}\nenum E{i} { A }\ntrait R{i} {}\n",
    "; a script\nSUBROUTINE {f}\n  GOSUB {g}\nL{i}:\n",
)
#: What stands in each template: name, kind, line after the words' last one, column before the name, lines up to the end.
DEFINED = (
    (".c", (("s{i}", "Struct", 1, "struct ", 0), ("{f}", "Function", 2, "int ", 3))),
    (".cs", (("App", "Namespace", 1, "namespace ", 8), ("P{i}", "Class", 2, "  public class ", 6), ("{f}", "Method", 4, "    public int ", 0), ("D{i}", "Method", 6, "    void ", 0))),
    (".py", (("{f}", "Function", 1, "def ", 1), ("H{i}", "Class", 5, "class ", 2), ("run", "Function", 6, "    def ", 1))),
    (".ts", (("V{i}", "Class", 1, "export class ", 0), ("show", "Method", 1, "export class V{i} { ", 0), ("{f}", "Function", 2, "function ", 0))),
    (".go", (("{f}", "Function", 3, "func ", 2), ("T{i}", "TypeAlias", 7, "type ", 0))),
    (".rs", (("m{i}", "Namespace", 1, "mod ", 2), ("{f}", "Function", 2, "  fn ", 0), ("E{i}", "Enum", 4, "enum ", 0), ("R{i}", "Trait", 5, "trait ", 0))),
    (".cmm", (("{f}", "Function", 1, "SUBROUTINE ", 0), ("L{i}", "Other", 3, "", 0))),
)
#: caller, name, line after the words' last one, what stands before it, its place in the body, in a branch that is off.
CALLED = (
    (".c", (("{f}", "log_line", 3, "    ", 0, False), ("{f}", "{g}", 4, "    return ", 1, False))),
    (".cs", (("{f}", "{g}", 4, "    public int {f}(int x) { return ", 0, False), ("D{i}", "{f}", 6, "    void D{i}() { ", 0, True))),
    (".py", (("{f}", "{g}", 2, "    return ", 0, False), ("run", "{f}", 7, "        return ", 0, False))),
    (".ts", (("show", "{f}", 1, "export class V{i} { show() { return ", 0, False),)),
    (".go", (("{f}", "{g}", 4, "\treturn ", 0, False),)),
    (".rs", (("{f}", "{g}", 2, "  fn {f}(x: i32) { ", 0, False),)),
)
#: Uses of a name in code that are no calls of a body.
USED = ((".cmm", (("{g}", 2, "  GOSUB "),)),)

_MARK = re.compile(r"\{([wfgi])\}")


def _render(template: str, lit, marks: dict, concat):
    parts, at = [], 0
    for m in _MARK.finditer(template):
        if m.start() > at:
            parts.append(lit(template[at : m.start()]))
        parts.append(marks[m[1]])
        at = m.end()
    if at < len(template) or not parts:
        parts.append(lit(template[at:]))
    return concat(parts)


def spark_text(template: str) -> Column:
    i = F.col("doc_id")
    marks = {
        "w": F.col("words"), "f": F.concat(F.lit("f"), (i % NAMES).cast("string")), "g": F.concat(F.lit("f"), ((i + 1) % NAMES).cast("string")), "i": i.cast("string")
    }
    return _render(template, F.lit, marks, lambda p: F.concat(*p))


def sql_text(template: str) -> str:
    marks = {"w": "words", "f": f"('f' || (doc_id % {NAMES}))", "g": f"('f' || ((doc_id + 1) % {NAMES}))", "i": "doc_id"}
    quote = lambda s: " || chr(10) || ".join("'" + p.replace("'", "''").replace("\t", "' || chr(9) || '") + "'" for p in s.split("\n"))
    return "(" + _render(template, quote, marks, " || ".join) + ")"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, path, text, doc_id)"""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("words", F.regexp_replace(F.coalesce("text", F.lit("")), r'[*"\\\r]', ""))
    kind, ending, text = F.pmod("doc_id", F.lit(len(ENDINGS))), None, None
    for k, (e, t) in enumerate(zip(ENDINGS, TEMPLATES)):
        ending = F.when(kind == k, e) if ending is None else ending.when(kind == k, e)
        text = F.when(kind == k, spark_text(t)) if text is None else text.when(kind == k, spark_text(t))
    return d.select(F.col("source").alias("root"), F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path"), text.alias("text"), "doc_id")


def _case(values: dict[str, str]) -> str:
    return "CASE doc_id % 7 " + " ".join(f"WHEN {ENDINGS.index(e)} THEN {v}" for e, v in values.items()) + " END"


#: SQL views over ``documents``; nl is the number of line ends before the template's second line.
_WORDS = r"""SELECT doc_id, source AS root, lang, regexp_replace(coalesce(text, ''), '[*"\\\r]', '', 'g') AS words FROM documents"""
CODE = (
    f"SELECT doc_id, root, words, lang || '/' || doc_id || {_case({e: repr(e) for e in ENDINGS})} AS path, "
    "(CASE WHEN doc_id % 7 = 6 THEN 1 ELSE length(words) - length(replace(words, chr(10), '')) + 1 END)::INTEGER AS nl "
    f"FROM ({_WORDS})"
)


def _rows(table, one) -> str:
    return " UNION ALL ".join(one(e, *row) for e, rows in table for row in rows)


def _col(before: str) -> str:
    return f"(length({sql_text(before)}) + 1)::INTEGER"


SYMBOLS = _rows(
    DEFINED,
    lambda e, name, kind, line, before, more: f"SELECT doc_id, root, path, {sql_text(name)} AS name, '{kind}' AS kind, (nl + {line})::INTEGER AS line, {_col(before)} AS col, (nl + {line + more})::INTEGER AS end_line FROM code WHERE doc_id % 7 = {ENDINGS.index(e)}",
)
CALLS = _rows(
    CALLED,
    lambda e, caller, name, line, before, seq, off: f"SELECT root, path, {sql_text(caller)} AS caller, {sql_text(name)} AS name, (nl + {line})::INTEGER AS line, {_col(before)} AS col, {seq}::INTEGER AS seq, {str(off).lower()} AS inactive FROM code WHERE doc_id % 7 = {ENDINGS.index(e)}",
)
USES = (
    "SELECT root, path, name, line, col FROM calls UNION ALL "
    + _rows(USED, lambda e, name, line, before: f"SELECT root, path, {sql_text(name)} AS name, (nl + {line})::INTEGER AS line, {_col(before)} AS col FROM code WHERE doc_id % 7 = {ENDINGS.index(e)}")
)
#: Comments and strings of the languages whose references skip them.
SPANS = (
    "SELECT root, path, 1 AS sl, 1 AS sc, nl AS el, (length(regexp_extract('/*' || words || '*/', '[^\\n]*$')) + 1)::INTEGER AS ec FROM code WHERE doc_id % 7 IN (0, 1) "
    f"UNION ALL SELECT root, path, (nl + 3)::INTEGER, 14, (nl + 3)::INTEGER, (16 + length({sql_text('{f}')}))::INTEGER FROM code WHERE doc_id % 7 = 0 "
    f"UNION ALL SELECT root, path, (nl + 3)::INTEGER, 5, (nl + 3)::INTEGER, (8 + length({sql_text('{f}')}))::INTEGER FROM code WHERE doc_id % 7 = 1"
)
VIEWS = {"code": CODE, "symbols": SYMBOLS, "calls": CALLS, "uses": USES, "spans": SPANS}
