"""References, callees, federation and focus, by name."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as ps
from ..functions import text as tx
from . import search


_PIECE = re.compile(r"(?P<op>\boperator(?!\w).*)|(?P<sep>::)|(?P<open><)|(?P<close>>)|(?P<word>.)", re.DOTALL)


def _unbracketed(name: str) -> list[str]:
    """The parts of a name between '::', without what stands in balanced <...>; an operator name ends the last part."""
    parts, nested = [""], 0
    for piece in _PIECE.finditer(name):
        kind = piece.lastgroup
        if kind == "op" and not nested:
            parts[-1] += piece[0]
            break
        if kind == "op":  # inside brackets it is a type's name like any other
            return _unbracketed(name[: piece.start()] + name[piece.start() :].replace("operator", "Operator", 1))
        nested += (kind == "open") - (kind == "close" and nested > 0)
        if nested or kind == "close":
            continue
        if kind == "sep":
            parts.append("")
        else:
            parts[-1] += piece[0]
    return parts


def member_of_qualified(name: str) -> str:
    """The last member of a qualified name, without template arguments; operator names run to the end."""
    return _unbracketed(name)[-1].strip() or name


def attribute_short(name: str) -> str:
    """The name an attribute class is used by."""
    return name[: -len("Attribute")] if name.endswith("Attribute") and len(name) > len("Attribute") else name


def outside_spans(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """Hits that don't start inside a comment or string of their file.

    The interval join is an equi-join on the lines a span touches, so it
    grows with hits and spans, not with their product.
    """
    by_line = spans.select("root", "path", F.explode(F.sequence("sl", "el")).alias("line"), "sl", "sc", "el", "ec")
    after = (F.col("h.line") > F.col("s.sl")) | (F.col("h.col") >= F.col("s.sc"))
    before = (F.col("h.line") < F.col("s.el")) | (F.col("h.col") < F.col("s.ec"))
    same = (F.col("h.root") == F.col("s.root")) & (F.col("h.path") == F.col("s.path")) & (F.col("h.line") == F.col("s.line"))
    return hits.alias("h").join(by_line.alias("s"), same & after & before, "left_anti")


def references(files: DataFrame, symbols: DataFrame, spans: DataFrame, name: str, per_file: int = search.PER_FILE) -> DataFrame:
    """Whole-word uses of a name in code: no comments, strings, data files or definitions; at most per_file a file."""
    member = member_of_qualified(name)
    code = files.filter(ps.is_code(F.col("path")) & ~ps.ignored_path(F.col("path")))
    found = search.whole_words(search.hits(code, member), len(member))
    found = outside_spans(found, spans)
    definitions = symbols.filter(F.col("name") == member).select("root", "path", "line", "col")
    found = found.join(definitions, ["root", "path", "line", "col"], "left_anti")
    return search.per_file_cap(found, per_file).withColumn("layer", F.lit("name"))


def callees(calls: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Definitions in the corpus that the bodies of name call, in the order of calls.

    By name: same-named definitions are listed together.  Calls in branches
    that are off stand apart, and only if no live call names the same place.
    """
    member = member_of_qualified(name)
    own = calls.filter(F.col("caller") == member).groupBy(F.col("name")).agg(F.min("inactive").alias("inactive"), F.min(F.struct("root", "path", "seq")).alias("at"))
    targets = symbols.filter(F.col("kind").isin("Method", "Function"))
    out = own.join(targets, "name").withColumn("how", F.when(F.col("inactive"), "inactive_branch").otherwise("name"))
    return out.select(F.lit(member).alias("caller"), "name", "root", "path", "line", "col", "how", F.col("at.seq").alias("seq"), F.col("at.path").alias("caller_path"))


def merge_layers(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Both layers, the first one's rows where they meet."""
    return first.unionByName(second.join(first, keys, "left_anti"))


def focus(roots: DataFrame, token: str) -> DataFrame:
    """Roots a token names: exact path, else folder name, else part of the path; the best kind of match only."""
    t = token.strip()
    norm = F.regexp_replace("root", r"/+$", "")
    low = F.lower(norm)
    tier = (
        F.when((low == t.rstrip("/").lower()) & F.lit(t.startswith("/")), 1)
        .when(F.lower(ps.basename(norm)) == t.lower(), 2)
        .when(F.contains(low, F.lit(t.lower())), 3)
    )
    tiers = roots.withColumn("tier", tier).filter(F.col("tier").isNotNull() & F.lit(bool(t)))
    best = tiers.agg(F.min("tier").alias("tier"))
    return tiers.join(F.broadcast(best), "tier").select(*roots.columns)  # one row


def linking_projects(links: DataFrame, root: str, excluding: str | None = None) -> DataFrame:
    return links.filter((F.col("linked_root") == root) & (F.col("project") != (excluding or ""))).select("project").distinct()


def incompleteness(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """(root, path, reason): candidate C# files that one reading by name may not tell whole.

    conditional: conditional compilation hides code; clash: a using alias or a
    global using gives the name another meaning; unreadable: no text.
    """
    chosen = files.filter(ps.is_csharp(F.col("path"))).join(candidates, ["root", "path"], "left_semi")
    text = F.col("text")
    reasons = F.array_compact(
        F.array(
            F.when(text.isNull(), "unreadable"),
            F.when(tx.has_conditional(text), "conditional"),
            F.when(text.rlike(r"(?m)^[ \t]*(global[ \t]+)?using[ \t]+(static[ \t]+[\w.]+[ \t]*;|\w+[ \t]*=)"), "clash"),
        )
    )
    return chosen.select("root", "path", F.explode(reasons).alias("reason"))


def file_list(rows: DataFrame, keys: list[str], path: str = "path", shown: int = 5) -> DataFrame:
    """Per key: the first paths in any case's order and how many more there are; no group is gathered."""
    order = Window.partitionBy(*keys).orderBy(F.lower(path), path)
    first = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= shown)
    first = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_r"), F.col(path).alias("p")))).alias("_p"))  # shown rows at most
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > shown, F.concat(F.lit(", +"), (F.col("n") - shown).cast("string"), F.lit(" more"))).otherwise(F.lit(""))
    return first.join(counted, keys).select(*keys, F.concat(F.array_join(F.transform("_p", lambda x: x["p"]), ", "), more).alias("shown"), "n")


def still_there(hits: DataFrame, files: DataFrame, token: str) -> DataFrame:
    """hits with stale: the token no longer stands at the row's place in the present text; such rows are kept, no span is held against them."""
    now = files.select("root", "path", F.col("text").alias("_now"))
    line = F.get(tx.lines(F.col("_now")), F.col("line") - 1)
    same = F.coalesce(F.substring(line, F.col("col"), F.lit(len(token))) == token, F.lit(False))
    return hits.join(now, ["root", "path"], "left").withColumn("stale", ~same).drop("_now")


def outside_spans_or_stale(hits: DataFrame, spans: DataFrame, files: DataFrame, token: str) -> DataFrame:
    """Hits outside comments and strings; a hit whose coordinates are stale fails open and stays."""
    marked = still_there(hits, files, token)
    return outside_spans(marked.filter("not stale"), spans).unionByName(marked.filter("stale"))
