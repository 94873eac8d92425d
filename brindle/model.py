"""Schemas and fixed values of the declaration index."""

from __future__ import annotations

from pyspark.sql import types as T

#: The kinds of a declaration.
KINDS = ("function", "class", "struct", "enum", "alias", "typedef", "macro", "variable")
#: Extensions of C and C++ sources, without the dot, case-sensitive.
EXTENSIONS = ("cpp", "h", "hpp", "cc", "cxx", "c", "hxx", "ixx")
#: Rows of a result when a request has no positive limit, version of the JSON snapshot, files in the slow report.
DEFAULT_LIMIT, SNAPSHOT_VERSION, SLOWEST = 200, 2, 20

#: Seconds that a client waits for a query.
QUERY_TIMEOUT = 3.0

DECLARATIONS = T.StructType().add("name", "string").add("kind", "string").add("file", "string").add("line", "integer").add("ord", "long")
FILES = T.StructType().add("path", "string").add("mtime_ns", "long")
SOURCES = T.StructType().add("path", "string").add("mtime_ns", "long").add("content", "binary")
RESULTS = T.StructType().add("name", "string").add("kind", "string").add("file", "string").add("line", "integer").add("score", "integer")
#: Results are ordered by score, then by everything else, so that a limit always cuts at the same row.
ORDER = ("file", "line", "name", "ord")
