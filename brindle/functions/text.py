"""Text functions. Case is ASCII case, comparison is by byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.model import KINDS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ascii_lower(c: Column | str) -> Column:
    return F.translate(col(c), UPPER, LOWER)


def equals_ignore_case(a: Column | str, b: Column | str) -> Column:
    return ascii_lower(a) == ascii_lower(b)


def bytes_as_chars(c: Column | str) -> Column:
    """One character for each UTF-8 byte, so that lengths and positions count bytes."""
    return F.decode(F.encode(col(c), "UTF-8"), "ISO-8859-1")


def normal_path(c: Column | str) -> Column:
    """Backslashes become slashes; one leading ``./`` goes."""
    return F.regexp_replace(F.translate(col(c), "\\", "/"), "^[.]/", "")


def extension(path: Column | str) -> Column:
    """What follows the last dot of the last path component, unless that dot begins it; else ''."""
    return F.regexp_extract(col(path), "(?:^|/)[^/]+[.]([^./]*)$", 1)


def tokens(c: Column | str) -> Column:
    """Split at blanks only; tabs stay; empty parts go."""
    return F.filter(F.split(col(c), " "), lambda x: x != "")


def is_file_token(token: Column | str) -> Column:
    return col(token).rlike(r"[/\\.]")


def kind_of(token: Column | str) -> Column:
    """The kind a query token names, in any case; null if none."""
    low = ascii_lower(token)
    return F.when(low.isin(*KINDS), low)


def kind_name(c: Column | str) -> Column:
    """The kind written in a snapshot, case-sensitive; anything else is a function."""
    return F.when(col(c).isin(*KINDS), col(c)).otherwise("function")


def known_kind(c: Column | str) -> Column:
    return F.when(col(c).isin(*KINDS), col(c)).otherwise("unknown")
