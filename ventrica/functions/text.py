"""String rules of the gates as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in their order: tokens that stand for text still to be written.
PLACEHOLDERS = ("tbd", "todo", "fixme", "unknown", "n/a", "na", "xxx", "placeholder", "???")


def slug(name: Column) -> Column:
    """Letters and digits of any script in lower case, with a hyphen for each stretch of other signs between them."""
    cut = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.lower(cut), F.lit("")), F.lit("structure"))


def is_placeholder(text: Column) -> Column:
    """The text is one of PLACEHOLDERS or opens with one, up to white space or one of : ; , . _ -"""
    tokens = "|".join(t.replace("?", r"\?") for t in PLACEHOLDERS)
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.lower(bare).rlike(rf"(?U)^(?:{tokens})(?:[\s:;,._-]|\z)"), F.lit(False))


def is_http(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike(r"^https?://[^/?#\s]+"), F.lit(False))


def is_date(text: Column) -> Column:
    """A day of the calendar as YYYY-MM-DD, from the year 100."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull() & (F.substring(text, 1, 4) >= "0100"), F.lit(False))


def path_problem(path: Column) -> Column:
    """Why a path inside a pack is refused, null if it is not; the first reason counts. A null path is no path.

    Backslash, query and fragment are looked for in the path as it stands, all else in the
    decoded one, so that no escape hides it. An escape that is not UTF-8 is refused.
    """
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    garbled = plain.isNull() | (plain.contains("\ufffd") & ~path.contains("\ufffd") & ~F.upper(path).contains("%EF%BF%BD"))
    parts = F.split(plain, "/")
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(path.contains("\\"), "backslash")
        .when(path.rlike(r"[?#]"), "query or fragment")
        .when(garbled, "bad escape")
        .when(plain.contains("\\"), "encoded backslash")
        .when(plain.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), "scheme")
        .when(plain.startswith("/"), "absolute")
        .when(F.array_contains(parts, ""), "empty segment")
        .when(F.array_contains(parts, ".") | F.array_contains(parts, ".."), "leaves the pack")
    )
