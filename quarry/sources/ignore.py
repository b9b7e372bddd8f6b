"""Ignore files with git's pattern semantics."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# POSIX classes of bracket expressions.
POSIX = {
    "alnum": "a-zA-Z0-9", "alpha": "a-zA-Z", "blank": " \\t", "cntrl": "\\x00-\\x1f\\x7f", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": "!-/:-@\\[-`{-~", "space": "\\t-\\r ", "upper": "A-Z", "xdigit": "0-9a-fA-F",
}


def _bracket(glob: str, i: int) -> tuple[str, int] | None:
    """The regular expression of the bracket expression at i, and where it ends; None if it never ends."""
    j, out, negate = i + 1, "", False
    if j < len(glob) and glob[j] in "!^":
        negate, j = True, j + 1
    first = True
    while j < len(glob):
        c = glob[j]
        if c == "]" and not first:
            return f"(?:(?!/)[{'^' if negate else ''}{out}])" if out else None, j + 1
        first = False
        if c == "[" and glob.startswith("[:", j) and (end := glob.find(":]", j)) > 0:
            out += POSIX.get(glob[j + 2 : end], "")
            j = end + 2
            continue
        if c == "\\" and j + 1 < len(glob):
            j += 1
            c = glob[j]
        if glob[j + 1 : j + 2] == "-" and glob[j + 2 : j + 3] not in ("", "]"):
            k = j + 2
            if glob[k] == "\\" and k + 1 < len(glob):
                k += 1
            if c <= glob[k]:
                out += f"{re.escape(c)}-{re.escape(glob[k])}"
            j = k + 1
            continue
        out += re.escape(c)
        j += 1
    return None


@functools.lru_cache(4096)
def wildmatch(glob: str) -> re.Pattern | None:
    """A whole-path pattern: * and ? stay inside a component, ** spans components; None if it can match nothing."""
    out, i, n = "", 0, len(glob)
    while i < n:
        c = glob[i]
        if c == "*":
            j = i
            while j < n and glob[j] == "*":
                j += 1
            alone = j - i == 2 and (i == 0 or glob[i - 1] == "/") and (j == n or glob[j] == "/")
            if alone and j == n:
                out += ".+" if i else ".*"
            elif alone:
                out += "(?:[^/]+/)*"
                j += 1
            else:
                out += "[^/]*"
            i = j
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            got = _bracket(glob, i)
            if got is None or got[0] is None:
                return None
            out, i = out + got[0], got[1]
        elif c == "\\":
            if i + 1 == n:
                return None
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return re.compile(out, re.DOTALL)


@dataclass(frozen=True)
class Rule:
    glob: str
    negate: bool
    dir_only: bool
    anchored: bool

    def matches(self, rel: str, is_dir: bool) -> bool:
        if self.dir_only and not is_dir:
            return False
        rx = wildmatch(self.glob)
        return rx is not None and rx.fullmatch(rel if self.anchored else rel.rsplit("/", 1)[-1]) is not None


def parse_line(line: str) -> Rule | None:
    """One line of an ignore file; None for blank lines and comments."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negate = line.startswith("!")
    if negate:
        line = line[1:]
    elif line.startswith(("\\!", "\\#")):
        line = line[1:]
    dir_only = line.endswith("/")
    line = line.rstrip("/") if dir_only else line
    anchored = "/" in line
    line = line.removeprefix("/")
    return Rule(line, negate, dir_only, anchored) if line else None


def parse(text: str) -> list[Rule]:
    return [r for r in map(parse_line, text.split("\n")) if r]


def decide(rules: Iterable[Rule], rel: str, is_dir: bool) -> bool | None:
    """The last rule that matches says whether rel is ignored; None if none does."""
    out = None
    for r in rules:
        if r.matches(rel, is_dir):
            out = not r.negate
    return out


def ignored(files: dict[str, list[Rule]], path: str, is_dir: bool = False) -> bool:
    """files: rules by the folder that holds them ('' at the top).

    The deepest file that has a matching rule decides; what lies under an ignored
    folder can't be taken back.
    """
    parts = path.split("/")
    for depth in range(1, len(parts) + 1):
        node, folder = "/".join(parts[:depth]), depth < len(parts) or is_dir
        for up in range(depth - 1, -1, -1):
            base = "/".join(parts[:up])
            if base in files:
                verdict = decide(files[base], node[len(base) + 1 :] if base else node, folder)
                if verdict is not None:
                    if verdict:
                        return True
                    break
    return False


def not_ignored(paths: DataFrame, rules: dict[str, list[Rule]], column: str = "path") -> DataFrame:
    """Rows whose path no ignore file excludes; the rules of one tree are small and travel with the task."""

    @F.pandas_udf(T.BooleanType())
    def kept(p: pd.Series) -> pd.Series:
        return p.map(lambda x: not ignored(rules, x))

    return paths.filter(kept(F.col(column))) if rules else paths
