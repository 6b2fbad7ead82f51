"""Column expressions over text, names and paths."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a regular-expression class of Java and of DuckDB.
SPACE = r"[\t\n\x0B\f\r\p{Z}\x{85}]"
#: What separates tokens.
SEPARATOR = r"[^\p{L}\p{N}]+"
SNIPPET_CHARS = 60


def trimmed(text: Column) -> Column:
    """Without white space at either end (any that Unicode knows)."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def format_of(path: Column) -> Column:
    """``markdown`` or ``pdf`` by the file extension, whatever its case; null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(extension.isin("md", "markdown"), "markdown").when(extension == "pdf", "pdf")


def has_control(path: Column) -> Column:
    """Whether a path holds a control character; such documents are not indexed."""
    return path.rlike(r"\p{Cc}")


def is_safe_path(path: Column) -> Column:
    """relative, without parent segments or a drive."""
    return ~path.rlike(r"^/|^\\|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)")


def is_collection_name(name: Column) -> Column:
    """letters, digits, _ and -, at most 64."""
    return name.rlike(r"^[A-Za-z0-9_-]{1,64}$")


def source_hash(content: Column) -> Column:
    """Lower-case hexadecimal SHA-256."""
    return F.sha2(content, 256)


def is_valid_utf8(content: Column) -> Column:
    """Whether bytes are strict UTF-8."""
    return F.is_valid_utf8(content)


def tokens(text: Column) -> Column:
    """E5: lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), SEPARATOR), "")


def once(value: Column) -> Column:
    """value, computed once a row: filters above are not rewritten in its terms."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def query_tokens(query: str) -> list[str]:
    """E5 for a query, each token once, in order."""
    return list(dict.fromkeys(t for t in regex.split(SEPARATOR, query.lower()) if t))


def one_line(text: Column) -> Column:
    return F.translate(text, "\r\n", "  ")


def head_snippet(body: Column, size: int = SNIPPET_CHARS) -> Column:
    """The first characters on one line, marked if there are more."""
    more = F.when(F.char_length(body) > size, "…").otherwise("")
    return F.concat(one_line(F.substring(body, 1, size)), more)


def fts_snippet(body: Column, query: str, size: int = SNIPPET_CHARS) -> Column:
    """A window around the first verbatim occurrence of the query, else the head.

    A match whose start is the last character counts as lying one further.
    """
    wanted = regex.sub(r"^[\p{White_Space}]+|[\p{White_Space}]+$", "", query)
    length = F.char_length(body)
    at = F.instr(body, F.lit(wanted)) - 1 if wanted else F.lit(0)
    at = F.when((at > 0) & (at == length - 1), length).otherwise(F.greatest(at, F.lit(0)))
    start = F.greatest(at - size // 2, F.lit(0))
    before = F.when(start > 0, "…").otherwise("")
    after = F.when(start + size < length, "…").otherwise("")
    return F.concat(before, one_line(F.substring(body, start + 1, F.lit(size))), after)


def xml_escape(text: Column) -> Column:
    """For element content; carriage returns by reference, what XML 1.0 cannot hold as U+FFFD."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    out = F.replace(out, F.lit("\r"), F.lit("&#xD;"))
    return F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "�")


def size_allowed(content: Column, limit: int) -> Column:
    """Whether the UTF-8 bytes stay within the limit; 0 stands for none."""
    return F.lit(True) if limit == 0 else F.octet_length(content) <= limit
