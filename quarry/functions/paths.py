"""Column expressions over '/'-separated relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and endings that the search and index rules name.
IGNORED_DIRS = (
    ".git .hg .svn .vs .vscode .idea bin obj node_modules packages dist build out target .gradle __pycache__ .pytest_cache "
    ".mypy_cache venv .venv coverage .quarry .corpus .next .nuget .claude .cursor .aider .serena .continue"
).split()
AMBIGUOUS_DIRS = "bin obj packages dist build out target coverage".split()
IGNORED_EXTENSIONS = (
    ".exe .dll .pdb .so .dylib .a .lib .o .obj .class .jar .png .jpg .jpeg .gif .bmp .ico .svg .webp .tif .tiff .mp3 .mp4 .avi .mov "
    ".wav .flac .ogg .webm .mkv .zip .gz .tar .7z .rar .bz2 .xz .zst .pdf .doc .docx .xls .xlsx .ppt .pptx .ttf .otf .woff .woff2 "
    ".eot .bin .dat .db .sqlite .pack .idx"
).split()
NON_CODE_EXTENSIONS = (
    ".csv .tsv .json .jsonl .ndjson .yaml .yml .md .markdown .rst .txt .log .html .htm .svg .map .lock .lst .bak .i .s .d .o .obj "
    ".elf .hex .bin"
).split()
GENERATED_SUFFIXES = ".designer.cs .designer.vb .g.cs .g.i.cs .generated.cs".split()
C_FAMILY_EXTENSIONS = ".c .cpp .cc .cxx .c++ .hpp .hh .hxx .h++ .h .inl .ipp .tcc".split()
MAX_FILE_BYTES = 2000 << 20


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    """The part before the last '/', empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The last '.' and what follows it in the file name, lower-cased; empty without one or if nothing follows."""
    return F.lower(F.regexp_extract(basename(path), r"(\.[^.]+)$", 1))


def in_ignored_dir(path: Column, extra: list[str] | None = None, keep: list[str] | None = None) -> Column:
    """Some directory of the path is ignored; names in keep never are."""
    names = sorted({d.lower() for d in [*IGNORED_DIRS, *(extra or [])]} - {d.lower() for d in keep or []})
    parts = F.split(F.lower(directory(path)), "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names])) if names else F.lit(False)


def in_ambiguous_dir(path: Column) -> Column:
    """Pruned by a name that may well hold sources, which answers must disclose."""
    return F.arrays_overlap(F.split(F.lower(directory(path)), "/"), F.array(*[F.lit(n) for n in AMBIGUOUS_DIRS]))


def ignored_extension(path: Column) -> Column:
    return extension(path).isin(IGNORED_EXTENSIONS)


def ignored_file(path: Column, size: Column, cap: int = MAX_FILE_BYTES) -> Column:
    return (size > cap) | ignored_extension(path)


def ignored_path(path: Column, extra: list[str] | None = None, keep: list[str] | None = None) -> Column:
    """The rule that also holds when an answer is made: directories and extension, no size."""
    return in_ignored_dir(path, extra, keep) | ignored_extension(path)


def is_code(path: Column) -> Column:
    return ~extension(path).isin(NON_CODE_EXTENSIONS)


def is_generated(path: Column) -> Column:
    low = F.lower(path)
    out = F.lit(False)
    for s in GENERATED_SUFFIXES:
        out = out | low.endswith(s)
    return out


def is_csharp(path: Column) -> Column:
    return extension(path) == ".cs"


def is_c_family(path: Column) -> Column:
    return extension(path).isin(C_FAMILY_EXTENSIONS)


def is_comment_aware(path: Column) -> Column:
    return is_csharp(path) | is_c_family(path)


def inside_repo(path: Column) -> Column:
    """Relative, without '..' parts and not rooted (a drive letter counts as a root)."""
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)") & (F.length(path) > 0) & (path != ".")


def is_bare_name(name: Column) -> Column:
    """A file's name alone, without any folder."""
    return (F.length(name) > 0) & ~name.rlike(r"[/\\]")


def is_under(child: Column, parent: Column) -> Column:
    """Is child the folder parent or inside it, in any case and with either slash?"""
    plain = lambda c: F.rtrim(F.lower(F.translate(c, "\\", "/")), F.lit("/"))
    return (plain(child) == plain(parent)) | F.startswith(plain(child), F.concat(plain(parent), F.lit("/")))


def display(path: Column, root: Column, is_primary: Column) -> Column:
    """Relative in the primary root, absolute elsewhere."""
    return F.when(is_primary, path).otherwise(F.concat(root, F.lit("/"), path))


def repo_key(root: Column) -> Column:
    """The first 16 hexadecimal digits of the lower-cased root's SHA-256."""
    return F.upper(F.substring(F.sha2(F.lower(root), 256), 1, 16))
