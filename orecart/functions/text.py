"""Path, name and token functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Definition keywords in order of priority, and calls that are not references.
NAME_KEYWORDS = ["fn ", "struct ", "impl", "trait ", "enum ", "def ", "class ", "func "]
DEFINING = ["fn ", "struct ", "trait ", "enum ", "def ", "class ", "func "]
IDENT = r"([\p{IsAlphabetic}\p{N}_]{0,40})"
IMPL = r"impl[<\p{IsAlphabetic}\p{N}_, >]*+(?U:\s*)" + IDENT
CALL = r"([A-Za-z_][A-Za-z0-9_]*) *(?:\(|::)"
# File extensions by language.
EXTENSIONS = {
    "rust": ["rs"], "python": ["py", "pyw", "pyi"], "javascript": ["js", "mjs", "cjs"], "typescript": ["ts", "tsx"], "java": ["java"],
    "c": ["c", "h"], "cpp": ["cpp", "cc", "cxx", "hpp", "hxx"], "go": ["go"],
}

#: Lower-case Latin letters with marks and the letters without, by the rule that decomposition gives a letter of a to z and marks.
ACCENTED = "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and (d := unicodedata.normalize("NFD", c))[0] in "abcdefghijklmnopqrstuvwxyz" and len(d) > 1)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)
#: Marks that stand apart from their letter.
MARKS = "[\u0300-\u036f]"


def slugify(s: Column) -> Column:
    dashed = F.regexp_replace(F.lower(s), r"[^\p{IsAlphabetic}\p{N}]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 50)


def file_dir(path: Column) -> Column:
    d = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(d == "", ".").otherwise(d)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def detect_language(path: Column) -> Column:
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    out = F.lit(None).cast("string")
    for lang, exts in EXTENSIONS.items():
        out = F.when(ext.isin(exts), lang).otherwise(out)
    return out


def lines(text: Column) -> Column:
    """Lines between \\n or \\r\\n; a trailing line end makes no empty line."""
    parts = F.split(text, "\r?\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def trim_space(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, without the marks of Latin letters."""
    plain = F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), MARKS, "")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def phrase_tokens(phrase: str) -> list[str]:
    """What `tokens` gives for a phrase."""
    import re

    plain = re.sub(MARKS, "", phrase.lower().translate(str.maketrans(ACCENTED, PLAIN)))
    return [t for t in re.split(r"[\W_]+", plain) if t]


def defined_names(line: Column) -> Column:
    """Names that a line defines: after the first occurrence of each keyword (anywhere, also inside words), then of `impl`."""
    found = [F.regexp_extract(line, k + IDENT, 1) for k in DEFINING] + [F.regexp_extract(line, IMPL, 1)]
    return F.filter(F.array(*found), lambda n: n != "")


def item_name(text: Column) -> Column:
    """Name on the first line that is neither blank nor a comment; null without a keyword there."""
    # most texts tell it by their first line, without a look at the others
    top, other = trim_space(F.substring_index(text, "\n", 1)), "^(//|#|$)"
    line = F.when(~top.rlike(other), top).otherwise(F.get(F.filter(F.transform(lines(text), trim_space), lambda x: ~x.rlike(other)), F.lit(0)))
    out = F.lit(None).cast("string")
    for k in reversed(NAME_KEYWORDS):
        out = F.when(line.contains(k), F.regexp_extract(line, IMPL if k == "impl" else k + IDENT, 1)).otherwise(out)
    return out


def call_names(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(CALL), F.lit(1))


def chunk_ref(file: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", file, start, end)


def parse_ref(ref: Column) -> Column:
    part = lambda i: F.regexp_extract(ref, r"^(.*):([0-9]+)-([0-9]+)$", i)
    return F.when(part(2) != "", F.struct(part(1).alias("file"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end")))


def format_tokens(n: Column) -> Column:
    """x.xM from a million on, xk from a thousand on, ties to even."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", F.bround(n / 1e6, 1))).when(n >= 1000, F.format_string("%.0fk", F.bround(n / 1e3, 0))).otherwise(n.cast("string"))


def path_key(path: Column) -> Column:
    """A folder's name in the list of projects: its path with dashes for slashes, without dashes in front."""
    return F.regexp_replace(F.translate(path, "/", "-"), "^-+", "")


def short_id(name: Column, length: int) -> Column:
    return F.substring(name, 1, length)


def truncated(text: Column, length: int) -> Column:
    """The first characters of a text, for providers that take no more."""
    return F.substring(text, 1, length)
