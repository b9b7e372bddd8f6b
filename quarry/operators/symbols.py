"""Definitions and calls of source files, by own scanners over masked code."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as ps
from ..functions import text as tx
from . import lexing

MAX_CHARS, BLOB_CHARS = 1 << 20, 1 << 20
SYMBOL = "root string, path string, name string, kind string, line int, col int, end_line int"
CALL = "root string, path string, caller string, name string, line int, col int, seq int, inactive boolean"

_TOKEN = re.compile(r"~?[^\W\d]\w*|::|=>|->|\d[\w.]*|[^\s\w]")
_NOT_NAMES = set(
    "if for while switch catch using lock foreach return new throw sizeof typeof nameof default fixed checked unchecked when await yield do else try "
    "case static_assert alignof decltype defined match loop unsafe in is as not and or base this function fn super import delete void typeid stackalloc".split()
)


@dataclass
class Block:
    kind: str  # type, namespace, body or other
    name: str
    symbol: int  # its place in the result, or -1


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


class _Places:
    def __init__(self, text: str):
        self.starts = _line_starts(text)

    def __call__(self, offset: int) -> tuple[int, int]:
        import bisect

        line = bisect.bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1] + 1


def _paren(tokens: list[re.Match]) -> int:
    """The first '(' outside <...> and [...]; -1 without one."""
    angle = square = 0
    for i, t in enumerate(tokens):
        c = t[0]
        if c == "[":
            square += 1
        elif c == "]":
            square -= 1
        elif c == "<":
            angle += 1
        elif c == ">" and angle:
            angle -= 1
        elif c == "(" and not square:
            if not angle or (i and tokens[i - 1][0] not in ("<", ",")):
                return i
    return -1


def _type_head(words: list[str], lang: str) -> tuple[str, int] | None:
    """Kind and place of a type's name in a head that opens a body."""
    keys = {"class": "Class", "struct": "Struct", "union": "Struct", "enum": "Enum", "interface": "Interface", "record": "Record"}
    if lang not in ("csharp", "typescript"):
        keys.pop("interface")
    if lang != "csharp":
        keys.pop("record")
    if lang in ("c",):
        keys.pop("class")
    if lang == "javascript":
        keys = {"class": "Class"}
    if lang == "typescript":
        keys = {k: v for k, v in keys.items() if k in ("class", "interface", "enum")}
    depth = 0
    for i, w in enumerate(words):
        depth += (w == "<") - (w == ">" and depth > 0)
        if w == "(":
            return None
        if w in keys and not depth and i + 1 < len(words):
            kind, j = keys[w], i + 1
            while j < len(words) and words[j] in ("class", "struct"):
                j += 1
            # an export macro or attribute may stand before the name: the last plain word before ':', '<', 'final' or the end
            last = None
            while j < len(words) and re.match(r"[^\W\d]\w*$", words[j]) and words[j] not in ("final", "extends", "implements", "where"):
                last, j = j, j + 1
                if lang in ("csharp", "typescript", "javascript"):
                    break
            return (kind, last) if last is not None else None
    return None


def _braced(text: str, code: str, lang: str) -> tuple[list[list], list[tuple[int, int, int]]]:
    """Symbols [name, kind, offset, end offset] and function bodies (symbol, start, end)."""
    out: list[list] = []
    bodies: list[tuple[int, int, int]] = []
    stack: list[Block] = []
    opened: list[int] = []
    head: list[re.Match] = []
    typedefs: dict[int, re.Match] = {}
    paren = 0
    cpp, cs = lang in ("c", "cpp"), lang == "csharp"

    def add(t: re.Match, kind: str, name: str | None = None) -> int:
        out.append([name or t[0], kind, t.start(), t.end()])
        return len(out) - 1

    def function(tokens: list[re.Match], closed_by: str) -> tuple[re.Match, str, str] | None:
        """The name of a function head: token, kind, full name."""
        words = [t[0] for t in tokens]
        p = _paren(tokens)
        if p < 1:
            return None
        if "=" in words[:p] and "operator" not in words[:p]:
            return None
        if cpp and words[p + 1 : p + 2] == ["*"] and words[p + 3 : p + 4] == ["("] and p:
            return tokens[p + 2], "Function", words[p + 2]  # it returns a function pointer
        name, full = tokens[p - 1], tokens[p - 1][0]
        if "operator" in words[:p] or words[p - 1] == "operator":
            k = max(i for i in range(len(words)) if words[i] == "operator")
            q = k + 1
            while q < len(words) and (words[q] != "(" or q == k + 1):
                q += 1
            return tokens[k], "Method", "operator" + "".join(words[k + 1 : q])
        if words[p - 1] == ">":
            k, depth = p - 1, 0
            while k >= 0:
                depth += (words[k] == ">") - (words[k] == "<")
                if not depth:
                    break
                k -= 1
            name, p = tokens[k - 1], k
            full = name[0]
        if not re.match(r"~?[^\W\d]\w*$", full) or full in _NOT_NAMES:
            return None
        before = [w for w in words[: tokens.index(name)] if w not in ("static", "inline", "extern", "const", "constexpr", "virtual", "explicit", "friend")]
        inside = bool(stack) and stack[-1].kind == "type"
        if lang in ("javascript", "typescript"):
            if "function" in words[:p]:
                return name, "Function", full
            return (name, "Method", full) if inside and closed_by == "{" and "." not in words[:p] else None
        if cs:
            ctor = inside and full == stack[-1].name and not any(re.match(r"\w", w) and w not in ("public", "private", "internal", "protected", "static", "unsafe", "extern") for w in before)
            typed = inside and any(re.match(r"[^\W\d]", w) for w in before) and before[-1] not in (".", "new", "return")
            return (name, "Method", full) if ctor or typed else None
        if "::" in before[-1:]:
            return name, "Method", full
        if inside:
            return name, "Method", full
        if any(re.match(r"[^\W\d]", w) for w in before) and before[-1] not in ("else", "do", "return"):
            return name, "Function", full
        return None

    i = 0
    tokens = list(_TOKEN.finditer(code))
    while i < len(tokens):
        t = tokens[i]
        c = t[0]
        if c == "#" and (t.start() == 0 or not code[code.rfind("\n", 0, t.start()) + 1 : t.start()].strip()):
            end = t.start()  # a directive runs to the end of its line, and on after a backslash
            while True:
                end = code.find("\n", end)
                if end < 0:
                    end = len(code)
                    break
                if code[end - 1 : end] != "\\" and code[end - 2 : end] != "\\\r":
                    break
                end += 1
            while i < len(tokens) and tokens[i].start() < end:
                i += 1
            continue
        if c in "([":
            paren += 1
        elif c in ")]":
            paren = max(0, paren - 1)
        opens = c == "{"
        if opens and paren:
            stack.append(Block("other", "", -1))
            opened.append(paren)
            paren = 0
            head = []
        elif opens or (not paren and c == ";") or (not paren and c == "=>" and cs):
            words = [h[0] for h in head]
            block = Block("other", "", -1)
            inside = not stack or stack[-1].kind in ("type", "namespace")
            if head and inside:
                kind = _type_head(words, lang) if opens or (cs and "record" in words) else None
                p = _paren(head)
                if cs and "record" in words and c in ";{" and (kind := _record(words)):
                    s = add(head[kind[1]], "Record")
                    block = Block("type", words[kind[1]], s)
                    for k in _record_parameters(head, kind[1]):
                        add(head[k], "Property")
                elif kind and opens:
                    block = Block("type", words[kind[1]], add(head[kind[1]], kind[0]))
                elif "namespace" in words and opens:
                    k = words.index("namespace") + 1
                    if cs and k < len(head):
                        block = Block("namespace", "", add(head[k], "Namespace", "".join(words[k:])))
                    elif cpp and k < len(head):
                        block = Block("namespace", "", add(head[-1], "Namespace"))
                    else:
                        block = Block("namespace", "", -1)
                elif cpp and words[:1] == ["extern"] and opens and len(words) <= 2 and p < 0:
                    block = Block("namespace", "", -1)
                elif cpp and words[0] == "typedef" and c == ";":
                    _typedef(head, words, add)
                    typedefs.pop(len(stack), None)
                elif lang == "cpp" and words[0] == "using" and "=" in words and c == ";" and words.index("=") >= 1:
                    add(head[words.index("=") - 1], "TypeAlias")
                elif (found := function(head, c)) and (opens or cs):
                    s = add(found[0], found[1], found[2])
                    block = Block("body", found[2], s)
                    if c == "=>":
                        end = code.find(";", t.end())
                        bodies.append((s, t.end(), end if end >= 0 else len(code)))
                        out[s][3] = end if end >= 0 else len(code)
                elif cs and p < 0 and c in ("{", "=>") and stack and stack[-1].kind == "type" and len([w for w in words if re.match(r"[^\W\d]", w)]) >= 2 and "=" not in words and "event" not in words and "enum" not in words:
                    block = Block("body", "", add(head[-1], "Property"))
            if opens:
                if head and not inside and lang in ("javascript", "typescript"):
                    kind = _type_head(words, lang)
                    if kind:
                        block = Block("type", words[kind[1]], add(head[kind[1]], kind[0]))
                    elif found := function(head, c):
                        block = Block("body", found[2], add(found[0], found[1], found[2]))
                stack.append(block)
                opened.append(0)
                if block.kind == "body" and block.symbol >= 0:
                    bodies.append((block.symbol, t.end(), len(code)))
                head = []
            elif c == ";" or c == "=>":
                head = []
        elif c == "}":
            if stack:
                closed = stack.pop()
                paren = opened.pop()
                if closed.symbol >= 0:
                    out[closed.symbol][3] = t.start()
                    if closed.kind == "body":
                        for k in range(len(bodies) - 1, -1, -1):
                            if bodies[k][0] == closed.symbol:
                                bodies[k] = (closed.symbol, bodies[k][1], t.start())
                                break
                head = [typedefs[len(stack)]] if cpp and len(stack) in typedefs else []
            else:
                head = []
        else:
            if cpp and c == "typedef":
                typedefs[len(stack)] = t
            head.append(t)
        i += 1
    return out, bodies


def _record(words: list[str]) -> tuple[str, int] | None:
    k = words.index("record") + 1
    while k < len(words) and words[k] in ("class", "struct"):
        k += 1
    named = k < len(words) and re.match(r"[^\W\d]\w*$", words[k]) and words[k + 1 : k + 2] in ([], ["("], ["<"], [":"], ["where"])
    return ("Record", k) if named else None


def _record_parameters(head: list[re.Match], at: int) -> list[int]:
    """Places of the parameter names of a positional record."""
    words, out, depth, k = [h[0] for h in head], [], 0, at
    while k < len(words) and words[k] != "(":
        if words[k] == ":":
            return []
        k += 1
    last = value = None
    for j in range(k, len(words)):
        w = words[j]
        depth += (w in "([<{") - (w in ")]>}")
        if depth == 0 or (depth == 1 and w == ","):
            if last is not None:
                out.append(last)
            last = value = None
            if depth == 0:
                break
        elif w == "=" and depth == 1:
            value = True
        elif depth == 1 and not value and re.match(r"[^\W\d]\w*$", w):
            last = j
    return out


def _typedef(head: list[re.Match], words: list[str], add) -> None:
    """The name a typedef gives: after '(*' for a function pointer, else the last word before brackets."""
    for k in range(len(words) - 3):
        if words[k] == "(" and words[k + 1] == "*" and words[k + 3] == ")":
            add(head[k + 2], "TypeAlias")
            return
    k = len(words)
    if "[" in words:
        k = words.index("[")
    if "(" not in words and k > 1 and re.match(r"[^\W\d]\w*$", words[k - 1]):
        add(head[k - 1], "TypeAlias")


def _close(code: str, at: int) -> int:
    """Where the block that opens at or after at ends, unless a ';' comes first."""
    depth = 0
    for m in re.compile(r"[{};]").finditer(code, at):
        c = m[0]
        if c == ";" and not depth:
            return m.start()
        depth += (c == "{") - (c == "}")
        if c == "}" and depth <= 0:
            return m.start()
    return at


# How languages without nested scanners spell definitions.
_SIMPLE = {
    "go": [
        (r"^func[ \t]+(?=[^\W\d])(\w+)", "Function"), (r"^func[ \t]*\([^)]*\)[ \t]*(\w+)", "Method"),
        (r"^[ \t]*type[ \t]+(\w+)[ \t]+(?!=)[^\n]", "TypeAlias"), (r"^[ \t]+([A-Za-z_]\w*)[ \t]+(?:struct|interface)[ \t]*\{", "TypeAlias"),
    ],
    "rust": [
        (r"\bfn[ \t]+(\w+)", "Function"), (r"\bstruct[ \t]+(\w+)", "Struct"), (r"\benum[ \t]+(\w+)", "Enum"), (r"\btrait[ \t]+(\w+)", "Trait"),
        (r"\bmod[ \t]+(\w+)", "Namespace"),
    ],
    "cmm": [(r"^[ \t]*SUBROUTINE[ \t]+(\w+)", "Function"), (r"^(\w+):", "Other")],
}


def _simple(code: str, lang: str) -> tuple[list[list], list[tuple[int, int, int]]]:
    out, bodies = [], []
    for rx, kind in _SIMPLE[lang]:
        for m in re.finditer(rx, code, re.MULTILINE | (re.IGNORECASE if lang == "cmm" else 0)):
            end = _close(code, m.end()) if lang != "cmm" else m.end(1)
            if lang == "go" and kind == "TypeAlias" and "{" not in code[m.end(1) : code.find("\n", m.end(1)) % (len(code) + 1)]:
                end = m.end(1)
            out.append([m[1], kind, m.start(1), max(end, m.end(1))])
    out.sort(key=lambda s: s[2])
    for k, s in enumerate(out):
        if s[1] in ("Function", "Method"):
            bodies.append((k, code.find("{", s[2]) + 1 or s[3], s[3]))
    return out, bodies


def _python(text: str, code: str) -> tuple[list[list], list[tuple[int, int, int]]]:
    """By the standard parser; by indentation where a file doesn't parse."""
    starts, out, bodies = _line_starts(text), [], []
    ends = lambda line: (starts[line] if line < len(starts) else len(text)) - 1
    try:
        nodes = [n for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
        for n in nodes:
            word = "class" if isinstance(n, ast.ClassDef) else "def"
            m = re.compile(rf"\b{word}\s+({re.escape(n.name)})\b").search(code, starts[n.lineno - 1])
            if m:
                out.append([n.name, "Class" if word == "class" else "Function", m.start(1), max(m.end(1), ends(n.end_lineno))])
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        for m in re.finditer(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)", code, re.MULTILINE):
            stop = re.compile(rf"^(?![ \t]{{{len(m[1]) + 1},}})(?=[ \t]*\S)", re.MULTILINE).search(code, m.end())
            out.append([m[3], "Class" if m[2] == "class" else "Function", m.start(3), max(m.end(3), (stop.start() if stop else len(code)) - 1)])
    out.sort(key=lambda s: s[2])
    for k, s in enumerate(out):
        if s[1] == "Function":
            bodies.append((k, code.find("\n", s[2]) if "\n" in code[s[2] : s[3]] else s[2] + len(s[0]), s[3]))
    return out, bodies


def would_skip(path: str, text: str, cap: int = MAX_CHARS) -> bool:
    """Is the file left out for its size or as numeric data, though its language has definitions?"""
    if lexing.language(path) is None:
        return False
    if len(text) > cap:
        return True
    if len(text) > BLOB_CHARS:
        ink = len(re.sub(r"[ \t\n\r]", "", text))
        return not ink or len(re.sub(r"[^g-wyzG-WYZ]", "", text)) * 100 < ink * 2
    return False


def skipped(path: Column, text: Column, cap: int = MAX_CHARS) -> Column:
    """The same as an expression, for reports that needn't send texts to Python."""
    numeric = (F.length(text) > BLOB_CHARS) & tx.is_numeric_data(text)
    return ps.extension(path).isin(list(lexing.LANGUAGES)) & F.coalesce((F.length(text) > cap) | numeric, F.lit(False))


def scan(path: str, text: str, cap: int | None = MAX_CHARS) -> tuple[list[tuple], list[tuple]]:
    """Symbols (name, kind, line, col, end_line) and calls (caller, name, line, col, seq, inactive) of one file."""
    lang = lexing.language(path)
    if lang is None or (cap and would_skip(path, text, cap)):
        return [], []
    code, place = lexing.mask(text, lang), _Places(text)
    if lang == "python":
        found, bodies = _python(text, code)
    elif lang in _SIMPLE:
        found, bodies = _simple(code, lang)
    else:
        found, bodies = _braced(text, code, lang)
    symbols = [(name, kind, *place(s), place(max(s, e))[0]) for name, kind, s, e in found]
    off = lexing.inactive_lines(code) if lang == "csharp" else set()
    calls = []
    for k, begin, end in bodies:
        for seq, m in enumerate(re.compile(r"([^\W\d]\w*)[ \t]*(?:<[\w,. \t]*>)?[ \t]*\(").finditer(code, begin, end)):
            if m[1] not in _NOT_NAMES:
                line, col = place(m.start(1))
                calls.append((found[k][0], m[1], line, col, seq, line in off))
    return symbols, calls


def _tables(files: DataFrame, which: int, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, p, *x) for r, p, t in zip(b["root"], b["path"], b["text"]) for x in scan(p, t or "")[which]]
            names = [c.split()[0] for c in schema.split(", ")]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    known = files.filter(ps.extension(F.col("path")).isin(list(lexing.LANGUAGES)))
    return known.select("root", "path", "text").mapInPandas(run, schema)


def extract(files: DataFrame) -> DataFrame:
    """One row per definition; other languages' files aren't read into Python."""
    return _tables(files, 0, SYMBOL)


def calls(files: DataFrame) -> DataFrame:
    """One row per call inside a function's body, in order; inactive marks code behind conditions that don't hold."""
    return _tables(files, 1, CALL)


def spans(files: DataFrame) -> DataFrame:
    """(root, path, sl, sc, el, ec): comments and strings of the languages whose references skip them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r, p, *x) for r, p, t in zip(b["root"], b["path"], b["text"]) for x in lexing.span_rows(t or "", lexing.language(p))]
            if rows:
                yield pd.DataFrame(rows, columns=["root", "path", "sl", "sc", "el", "ec"])

    aware = files.filter(ps.is_comment_aware(F.col("path")))
    return aware.select("root", "path", "text").mapInPandas(run, "root string, path string, sl int, sc int, el int, ec int")


def by_name(symbols: DataFrame, name: str) -> DataFrame:
    """Exact and case-sensitive."""
    return symbols.filter(F.col("name") == name)


def matching(symbols: DataFrame, query: str) -> DataFrame:
    """Names that contain the query in any case, with the mark that puts generated files last."""
    return symbols.filter(F.contains(tx.fold(F.col("name")), F.lit(tx.fold_str(query)))).withColumn("generated", ps.is_generated(F.col("path")))


def location(symbols: DataFrame) -> DataFrame:
    """Add the printed place: path:line[-end]:col: kind name."""
    end = F.when(F.col("end_line") > F.col("line"), F.concat(F.lit("-"), F.col("end_line").cast("string"))).otherwise(F.lit(""))
    at = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), end, F.lit(":"), F.col("col").cast("string"), F.lit(": "), F.col("kind"), F.lit(" "), F.col("name"))
    return symbols.withColumn("location", at)
