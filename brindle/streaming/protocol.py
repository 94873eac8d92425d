"""Requests and responses, as columns for batches and as functions for the loop."""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.lenient_json import BadJson, parse
from brindle.model import DEFAULT_LIMIT

#: Methods of the protocol.
METHODS = ("query", "status", "rebuild", "forceRebuild", "rebuildFile", "shutdown")
_REQUEST = "id long, method string, pattern string, limit long, file string, bad boolean"
MAX_LIMIT = (1 << 31) - 1


def parse_requests(lines: DataFrame, line: str = "line", strict_compat: bool = False) -> DataFrame:
    """Adds ``id, method, pattern, limit, file, bad``; an empty line gives nothing, an unknown method ``unknown``.

    ``parse_request`` for a column: the lines alone go through it, in Arrow batches.
    """

    @F.arrow_udf(_REQUEST)
    def requests(texts: pa.Array) -> pa.Array:
        got = [parse_request(x, strict_compat) for x in texts.to_pylist()]
        rows = [(Request(), True) if r is None else (r, False) for r in got]
        cols = [pa.array([r.id for r, _ in rows], pa.int64()), *(pa.array([getattr(r, c) for r, _ in rows], k) for c, k in (("method", pa.string()), ("pattern", pa.string()), ("limit", pa.int64()), ("file", pa.string()))), pa.array([b for _, b in rows], pa.bool_())]
        return pa.StructArray.from_arrays(cols, ["id", "method", "pattern", "limit", "file", "bad"])

    # named so, a filter on its fields stays behind it: it is not called twice, nor ahead of an exchange that deals the lines
    requests = requests.asNondeterministic()
    asked = lines.where(~F.col(line).isin("", "\r")).withColumn("__r", requests(F.col(line)))
    return asked.select(*lines.columns, "__r.*")


def query_response(rid: Column, results: Column, rows_key: str = "declarations") -> Column:
    return F.to_json(F.struct(rid.alias("id"), results.alias(rows_key)))


def status_response(rid: Column, ready: Column, files: Column, declarations: Column, rows_key: str = "declarations") -> Column:
    return F.to_json(F.struct(rid.alias("id"), F.when(ready, "ready").otherwise("building").alias("status"), files.alias("files"), declarations.alias(rows_key)))


def ack_response(rid: Column, status: Column) -> Column:
    return F.to_json(F.struct(rid.alias("id"), status.alias("status")))


def error_response(rid: Column, message: Column) -> Column:
    return F.to_json(F.struct(rid.alias("id"), message.alias("error")))


def matched(pending: DataFrame, responses: DataFrame, key: str = "id") -> DataFrame:
    """Responses with the requests that wait for them, by id; a response nobody waits for is left out."""
    return pending.join(responses, key)


@dataclass(frozen=True)
class Request:
    id: int = 0
    method: str = "unknown"
    pattern: str = ""
    limit: int = DEFAULT_LIMIT
    file: str = ""


def parse_request(line: str, strict_compat: bool = False) -> Request | None:
    """None if the line is no JSON, as ``lenient_json.parse`` has it; never an exception. JSON that is no object is a request without fields, and a field
    of another type than its own is a missing one. ``strict_compat`` reads every ``\\uXXXX`` as ``?``, as older clients expect.
    """
    try:
        v = parse(line, strict_compat)
    except BadJson:
        return None
    if not isinstance(v, dict):
        return Request()
    params = v.get("params") if isinstance(v.get("params"), dict) else {}
    text = lambda x: x if isinstance(x, str) else ""
    whole = lambda x: x if isinstance(x, int) and not isinstance(x, bool) else 0
    method, limit = text(v.get("method")), whole(params.get("limit"))
    return Request(whole(v.get("id")), method if method in METHODS else "unknown", text(params.get("pattern")), min(limit, MAX_LIMIT) if limit > 0 else DEFAULT_LIMIT, text(params.get("file")))


def dump(**fields) -> str:
    return json.dumps(fields, separators=(",", ":"), ensure_ascii=False)
