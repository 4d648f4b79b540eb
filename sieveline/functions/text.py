"""Text functions as column expressions: lines, trimming, token normalisation, escaping, paths.

All are built-in functions, so they stay inside code generation or JVM-side array
processing. Null in, null out, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE_BREAK = r"\r\n|\n|\r"
"""Line ends of text files."""
WIDE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
"""Line ends of captured output, which also breaks at separators."""

#: Words that token normalisation keeps.
KEPT_WORDS = (
    "if elif else for while return def class try except finally with as lambda yield import from pass break continue "
    "raise assert global nonlocal del and or not in is switch case default do goto struct enum union template typename "
    "namespace using public private protected virtual override const static inline new delete this true false nullptr "
    "None True False catch throw"
).split()

#: How a line starts that clone detection leaves out.
SKIPPED_STARTS = ("#", "//", "/*", "*", "import ", "from ", "#include")


def lines_of(text: Column, breaks: str = FILE_BREAK) -> Column:
    """Array of lines; a last line that is empty does not count. Null text has none."""
    parts = F.split(F.coalesce(text, F.lit("")), breaks, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


#: Every character that counts as white space.
WHITE_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(line: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(line, F.lit(WHITE_SPACE))


def starts_with_any(line: Column, starts: tuple[str, ...] | list[str]) -> Column:
    found = F.lit(False)
    for start in starts:
        found = found | F.startswith(line, F.lit(start))
    return found


#: Tokens that normalisation replaces, as patterns over word characters W.
WORD_CHARACTERS = r"\p{L}\p{N}_"
STRING_TOKEN = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
NUMBER_TOKEN = r"(?<![W])\p{Nd}+(?:\.\p{Nd}+)?(?![W])"
NAME_TOKEN = r"(?<![W])(?!(?:KEPT)(?![W]))[A-Za-z_][W]*"


def normalised_tokens(line: Column) -> Column:
    """Strings and numbers as ``LIT``, names as ``ID`` unless kept, white space removed; all else stays.

    As one pass from left to right would have it: strings never overlap other tokens,
    and a name or number is only one that no word character touches. Noncharacters
    stand in for what has been replaced.
    """
    literal, name = "\ufdd0", "\ufdd1"
    spelled = lambda pattern: "(?d)" + pattern.replace("[W]", f"[{WORD_CHARACTERS}]").replace("KEPT", "|".join(KEPT_WORDS))
    marked = F.regexp_replace(line, spelled(STRING_TOKEN), literal)
    marked = F.regexp_replace(marked, spelled(NUMBER_TOKEN), literal)
    marked = F.regexp_replace(marked, spelled(NAME_TOKEN), name)
    return replaced(F.translate(marked, WHITE_SPACE, ""), [(literal, "LIT"), (name, "ID")])


def replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def html_escaped(text: Column) -> Column:
    """For element and attribute text."""
    return replaced(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")])


def cell_escaped(text: Column) -> Column:
    """For a Markdown table cell: one line, pipes and back-ticks as text."""
    return replaced(html_escaped(text), [("\r\n", "<br>"), ("\n", "<br>"), ("\r", "<br>"), ("|", "&#124;"), ("`", "&#96;")])


def command_escaped(text: Column, is_property: bool = False) -> Column:
    """For a workflow command; properties also escape ``:`` and ``,``."""
    pairs = [("%", "%25"), ("\r", "%0D"), ("\n", "%0A")]
    return replaced(text, pairs + ([(":", "%3A"), (",", "%2C")] if is_property else []))


def fence_for(text: Column) -> Column:
    """A back-tick fence longer than any run in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit("(`+)"), F.lit(1)), F.length)
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(runs), F.lit(0)) + 1))


def shortened(text: Column, most: int = 300) -> Column:
    """White space collapsed, at most ``most`` characters."""
    return F.substring(stripped(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")), 1, most)


def grouped_digits(number: Column) -> Column:
    """An integer with thousands separators."""
    return F.format_number(number, 0)


def anchor(start: Column, end: Column) -> Column:
    """``#Lx`` or ``#Lx-Ly``."""
    return F.when(end.isNotNull() & (end > start), F.concat(F.lit("#L"), start.cast("string"), F.lit("-L"), end.cast("string"))).otherwise(F.concat(F.lit("#L"), start.cast("string")))


def path_parts(path: Column) -> Column:
    return F.split(path, "/")


#: Directories whose files no scan reports.
IGNORED_PARTS = (".venv", "venv", "build", "__pycache__", ".git", ".pytest_cache", ".ruff_cache")
IGNORED_STARTS = ("v1.", "v0.")


def ignored_path(path: Column) -> Column:
    """Whether any part of a relative path hides the file."""
    return F.exists(path_parts(path), lambda p: p.isin(*IGNORED_PARTS) | starts_with_any(p, IGNORED_STARTS))


def parent_of(path: Column) -> Column:
    """The direct parent directory, ``.`` at the top."""
    parts = path_parts(path)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")).otherwise(".")


def relative_to(path: Column, root: str) -> Column:
    """Path below ``root``; other paths stay as they are."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def module_name(path: Column, roots: tuple[str, ...] = ("src", "lib", "app", "packages", "python")) -> Column:
    """Dotted module name of a source path: below its root, without suffix or ``__init__``."""
    below = path
    for root in roots:
        below = F.when(F.startswith(path, F.lit(root + "/")), F.substring(path, len(root) + 2, 1 << 30)).otherwise(below)
    bare = F.regexp_replace(below, r"(/__init__)?\.py$", "")
    return F.replace(bare, F.lit("/"), F.lit("."))


def resolved_import(package: Column, level: Column, name: Column) -> Column:
    """Absolute module of a relative import: ``level`` dots from ``package``."""
    parts = F.split(package, r"\.")
    base = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - level + 1, F.lit(0))), ".")
    return F.when(level == 0, name).when(F.coalesce(name, F.lit("")) == "", base).when(base == "", name).otherwise(F.concat(base, F.lit("."), name))


def url_quoted(text: Column) -> Column:
    """Percent-encoded but for letters, digits and ``_.-~/``."""
    return replaced(F.url_encode(text), [("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")])


def permalink(base: Column, revision: Column, path: Column, start: Column, end: Column) -> Column:
    """A link to lines of a file at a revision; null unless the base is an http(s) address."""
    link = F.concat(F.rtrim(base, F.lit("/")), F.lit("/blob/"), url_quoted(revision), F.lit("/"), url_quoted(path), anchor(start, end))
    return F.when(base.rlike(r"^https?://[^/\s]+"), link)


#: How names and versions of projects are spelled.
PROJECT_VALUE = r"\A[A-Za-z0-9._-]+\z"


def project_name(name: Column) -> Column:
    """The name where it is one; null for anything else, also for what names a directory."""
    return F.when(name.rlike(PROJECT_VALUE) & ~name.isin(".", ".."), name)


def release_name(version: Column) -> Column:
    """``v`` and the version, of which one leading ``v`` does not count; null for what is no version."""
    bare = F.regexp_replace(version, "^v", "")
    return F.when(bare.rlike(PROJECT_VALUE), F.concat(F.lit("v"), bare))


def simple_code_lines(text: Column) -> Column:
    """Lines that are neither blank nor start with ``#``, ``//`` or ``/*``; no block state."""
    return F.size(F.filter(F.transform(lines_of(text), stripped), lambda s: (s != "") & ~starts_with_any(s, ("#", "//", "/*")))).cast("long")


def normal_path(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and empty parts, which climb no higher than the top."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def within(path: Column, root: str) -> Column:
    """Whether a normal path lies below ``root``; one that climbs out does not."""
    return F.startswith(path, F.lit(root.rstrip("/") + "/")) & ~F.array_contains(path_parts(path), "..")
