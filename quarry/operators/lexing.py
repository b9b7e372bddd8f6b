"""Comments and strings of C-like and other languages, failing open.

``mask`` blanks comments and strings (line ends stay), so what is left is code
at its own place.  Anything unterminated or unclear is left as code: a
reference is rather kept than lost.
"""

from __future__ import annotations

import re

_BLOCK = r"/\*.*?\*/"
_LINE = r"//(?:\\\r?\n|[^\n])*"
_STRING = r'"(?:\\.|[^"\\\n])*"'
_CHAR = r"(?<![0-9A-Za-z_])'(?:\\.|[^'\\\n])+'"
_C = re.compile(rf'{_BLOCK}|{_LINE}|(?<![0-9A-Za-z_])(?:u8|[uUL])?R"(?P<d>[^()\\\s]{{0,16}})\(.*?\)(?P=d)"|{_STRING}|{_CHAR}', re.DOTALL)
_CS = re.compile(
    rf'{_BLOCK}|//[^\n]*|(?P<raw>\$*"""+)|(?P<verbatim>@"(?:""|[^"])*")|(?P<interp>\$@"|@\$"|\$")|{_STRING}|{_CHAR}', re.DOTALL
)
_JS = re.compile(rf"{_BLOCK}|//[^\n]*|{_STRING}|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.DOTALL)
_GO = re.compile(rf"{_BLOCK}|//[^\n]*|{_STRING}|'(?:\\.|[^'\\\n])+'|`[^`]*`", re.DOTALL)
_RUST = re.compile(rf'{_BLOCK}|//[^\n]*|b?r(?P<h>#*)".*?"(?P=h)|"(?:\\.|[^"\\])*"|' + r"'(?:\\[^']+|[^'\\\n])'", re.DOTALL)
_PY = re.compile(r"#[^\n]*|'''(?:\\.|[^\\])*?'''|\"\"\"(?:\\.|[^\\])*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.DOTALL)
_CMM = re.compile(r";[^\n]*|//[^\n]*|\"[^\"\n]*\"")

FAMILIES = {
    "c": _C, "cpp": _C, "csharp": _CS, "javascript": _JS, "typescript": _JS, "go": _GO, "rust": _RUST, "python": _PY, "cmm": _CMM,
}
# Languages by file ending.
LANGUAGES = {
    **{e: "cpp" for e in ".cpp .cc .cxx .c++ .hpp .hh .hxx .h++ .h .inl .ipp .tcc".split()},
    **{e: "javascript" for e in ".js .jsx .mjs .cjs".split()},
    ".cs": "csharp", ".c": "c", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust", ".cmm": "cmm",
}


def language(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    return LANGUAGES.get("." + name.rsplit(".", 1)[-1].lower()) if "." in name else None


def _interpolated(text: str, start: int, open_: str) -> list[tuple[int, int]] | None:
    """The literal pieces of an interpolated C# string; its holes are code."""
    verbatim, i, n = "@" in open_, start + len(open_), len(text)
    out, begin = [], start
    while i < n:
        c = text[i]
        if c == '"':
            if verbatim and text[i + 1 : i + 2] == '"':
                i += 2
                continue
            return [*out, (begin, i + 1)]
        if c == "\\" and not verbatim:
            i += 2
            continue
        if c == "\n" and not verbatim:
            return None
        if c == "{":
            if text[i + 1 : i + 2] == "{":
                i += 2
                continue
            out.append((begin, i + 1))
            depth, i = 1, i + 1
            while i < n and depth:
                if text[i] == '"':
                    m = re.compile(_STRING).match(text, i)
                    if not m:
                        return None
                    out.append(m.span())
                    i = m.end()
                    continue
                depth += (text[i] == "{") - (text[i] == "}")
                i += 1
            begin = i - 1
            continue
        i += 1
    return None


def spans(text: str, lang: str) -> list[tuple[int, int]]:
    """Offsets of comments and strings, in order."""
    rx, out, i = FAMILIES[lang], [], 0
    while m := rx.search(text, i):
        groups = m.groupdict()
        if groups.get("raw"):
            quotes = m["raw"].lstrip("$")
            end = text.find(quotes, m.end())
            if end < 0:
                i = m.end()
                continue
            end += len(quotes)
            while text[end : end + 1] == '"':
                end += 1
            out.append((m.start(), end))
            i = end
        elif groups.get("interp"):
            got = _interpolated(text, m.start(), m["interp"])
            if got is None:
                i = m.end()
                continue
            out += got
            i = got[-1][1]
        else:
            out.append(m.span())
            i = max(m.end(), m.start() + 1)
    return sorted(out)


def mask(text: str, lang: str) -> str:
    out, at = [], 0
    for s, e in spans(text, lang):
        if s < at:
            continue
        out += [text[at:s], re.sub(r"[^\n]", " ", text[s:e])]
        at = e
    return "".join([*out, text[at:]])


def span_rows(text: str, lang: str) -> list[tuple[int, int, int, int]]:
    """(start line, start column, end line, end column), 1-based, end exclusive."""
    out, line, begin, at = [], 1, 0, 0

    def place(offset: int) -> tuple[int, int]:
        nonlocal line, begin, at
        line += text.count("\n", at, offset)
        if (last := text.rfind("\n", at, offset)) >= 0:
            begin = last + 1
        at = offset
        return line, offset - begin + 1

    for s, e in spans(text, lang):
        if s >= at:
            out.append((*place(s), *place(e)))
    return out


# conditional compilation with no symbols defined

_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(if|elif|else|endif)\b[ \t]*([^\n]*)", re.MULTILINE)


def _holds(expr: str) -> bool:
    """The value of a condition in which no symbol is defined."""
    words = re.findall(r"&&|\|\||==|!=|!|\(|\)|\w+", expr.split("//")[0])
    as_python = {"&&": " and ", "||": " or ", "!": " not ", "true": "True", "(": "(", ")": ")", "==": "==", "!=": "!="}
    try:
        return bool(eval("".join(as_python.get(w, "False") for w in words) or "False", {"__builtins__": {}}))  # only the words above reach it
    except SyntaxError:
        return False


def inactive_lines(text: str) -> set[int]:
    """Lines (1-based) in branches that are off when no symbol is defined."""
    out: set[int] = set()
    stack: list[list[bool]] = []  # [a branch was taken, this branch is on]
    marks = {text.count("\n", 0, m.start()) + 1: m for m in _DIRECTIVE.finditer(text)}
    for no in range(1, text.count("\n") + 2):
        if m := marks.get(no):
            word = m[1]
            if word == "if":
                on = _holds(m[2])
                stack.append([on, on])
            elif stack and word == "elif":
                on = not stack[-1][0] and _holds(m[2])
                stack[-1] = [stack[-1][0] or on, on]
            elif stack and word == "else":
                stack[-1] = [True, not stack[-1][0]]
            elif stack and word == "endif":
                stack.pop()
        elif not all(on for _, on in stack):
            out.add(no)
    return out
