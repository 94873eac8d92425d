"""Declarations of a C or C++ source: a tolerant scanner in place of a grammar.

Offsets are bytes: the source is read as Latin-1. What is reported, with the name exactly as written:

* functions: defined or declared, free, member or local, with a plain or qualified name right before the parameters (a name behind
  ``*`` or ``&`` is not reported);
* classes and structs with a body and a plain name; enums with a name, forward declarations included;
* aliases, typedefs of a plain name, object-like and function-like macros;
* variables with a plain or once-pointed name that are global (outside any function body) or ``constexpr``; not members.

A class whose head carries an extra word, as export macros do, is read as a function body: its functions are reported,
its name is not. Nothing nested deeper than ``MAX_DEPTH`` syntax levels is reported.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.shared import settled

MAX_DEPTH = 16
#: One file's rows and what became of it: ``error`` is null if it was read.
PARSED = "file string, mtime_ns long, seconds float, error string, found array<struct<name:string,kind:string,line:int,byte_offset:int,byte_end:int>>"

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//(?:[^\n\\]|\\.|\\\n)*|/\*.*?(?:\*/|\Z))
    |(?P<pre>\#(?:[^\n\\/]|\\\r?\n|\\.|/(?!\*)|/\*.*?\*/)*)
    |(?P<raw>(?:u8|[uUL])?R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)")
    |(?P<str>(?:u8|[uUL])?"(?:[^"\\\n]|\\.|\\\n)*"?|(?:u8|[uUL])?'(?:[^'\\\n]|\\.)*'?)
    |(?P<id>[A-Za-z_\x80-\xff$][\w\x80-\xff$]*)
    |(?P<num>\.?[0-9](?:[eEpP][+-]|['\w.])*)
    |(?P<op>::|->|&&|\|\||\.\.\.|<<=|<=>|<=|>=|==|!=|\+\+|--|[-+*/%&|^]=|<<|[{}()\[\];:,<>=*&~!+\-/%^|?.@\\`])
    |(?P<other>.)""",
    re.S | re.X,
)
_DEFINE = re.compile(r"#[ \t]*define[ \t]+([A-Za-z_]\w*)")
_NOT_A_TYPE = frozenset("return throw delete new case goto else co_return co_yield co_await sizeof typeid alignof decltype noexcept static_assert if while for switch catch and or not".split())
_SPECIFIERS = frozenset("static extern inline const constexpr constinit consteval volatile mutable thread_local register virtual explicit friend unsigned signed auto typename".split())
_BUILTIN = frozenset("void bool char short int long float double wchar_t char8_t char16_t char32_t unsigned signed auto".split())
_CONTROL = frozenset("if for while switch catch".split())


@dataclass
class Tok:
    text: str
    kind: str
    at: int
    end: int


class Scanner:
    """Statement by statement; braces decide what scope follows."""

    def __init__(self, source: str):
        self.out: list[tuple[int, int, str]] = []
        self.source, self.toks = source, []
        for m in _TOKEN.finditer(source):
            kind = m.lastgroup if m.lastgroup != "d" else "raw"
            if m["raw"] is not None:
                kind = "str"
            if kind == "skip":
                continue
            if kind == "pre":
                if d := _DEFINE.match(m[0]):
                    self.out.append((m.start() + d.start(1), m.start() + d.end(1), "macro"))
                continue
            self.toks.append(Tok(m[0], kind, m.start(), m.end()))
        self.i = 0

    def run(self) -> list[tuple[int, int, str]]:
        """Sorted (offset, end, kind), one for each offset."""
        stack: list[tuple[str, int]] = [("space", 0)]
        while self.i < len(self.toks):
            self.statement(stack)
        seen: dict[int, tuple[int, int, str]] = {}
        for c in self.out:
            seen.setdefault(c[0], c)
        return [seen[k] for k in sorted(seen)]

    def emit(self, first: Tok, last: Tok, kind: str, depth: int) -> None:
        if depth <= MAX_DEPTH:
            self.out.append((first.at, last.end, kind))

    def close(self, i: int, opener: str, closer: str) -> int:
        """Index after the bracket that closes the one at ``i``; stops at the end."""
        depth = 0
        while i < len(self.toks):
            t = self.toks[i].text
            if t == opener:
                depth += 1
            elif t == closer:
                depth -= 1
                if not depth:
                    return i + 1
            elif opener == "<" and t in ";{}":
                return i
            elif opener == "<" and t == "(":
                i = self.close(i, "(", ")")
                continue
            i += 1
        return i

    def attributes(self, i: int) -> int:
        while i < len(self.toks):
            t = self.toks[i].text
            if t == "[" and i + 1 < len(self.toks) and self.toks[i + 1].text == "[":
                i = self.close(i, "[", "]")
            elif t in ("alignas", "__attribute__", "__declspec", "requires") and i + 1 < len(self.toks) and self.toks[i + 1].text == "(":
                i = self.close(i + 1, "(", ")")
            else:
                return i
        return i

    def statement(self, stack: list[tuple[str, int]]) -> None:
        toks, n = self.toks, len(self.toks)
        scope, depth = stack[-1]
        i = self.attributes(self.i)
        if i >= n:
            self.i = n
            return
        t = toks[i].text
        if t == "}":
            self.i = i + 1
            if len(stack) > 1:
                kind, _ = stack.pop()
                if kind == "class":
                    self.trailing(stack)
            return
        if t == ";":
            self.i = i + 1
            return
        if t == "{":
            self.i = i + 1
            stack.append(("body" if scope != "space" else "space", depth + 1))
            return
        if scope == "class" and t in ("public", "private", "protected") and i + 1 < n and toks[i + 1].text == ":":
            self.i = i + 2
            return
        while i + 1 < n and toks[i].text == "template" and toks[i + 1].text == "<":
            i, depth = self.attributes(self.close(i + 1, "<", ">")), depth + 1
        if i < n and toks[i].text == "requires":
            i += 1
        if i >= n:
            self.i = n
            return
        t = toks[i].text
        if t == "inline" and i + 1 < n and toks[i + 1].text == "namespace":
            i, t = i + 1, "namespace"
        if t == "namespace" or (t == "extern" and i + 1 < n and toks[i + 1].kind == "str"):
            j = i + 1
            while j < n and toks[j].text not in "{;=":
                if t == "extern" and toks[j].kind == "id":
                    break
                j += 1
            if j < n and toks[j].text == "{":
                self.i = j + 1
                stack.append(("space", depth + 2))
                return
            if j < n and t == "extern" and toks[j].kind == "id":
                i, depth = j, depth + 1
                t = toks[i].text
            else:
                self.i = self.until_semicolon(j)
                return
        if t == "using":
            j = self.attributes(i + 2)
            if i + 1 < n and toks[i + 1].kind == "id" and j < n and toks[j].text == "=":
                self.emit(toks[i + 1], toks[i + 1], "alias", depth + 1)
            self.i = self.until_semicolon(i)
            return
        if t == "concept":
            self.i = self.until_semicolon(i)
            return
        typedef = t == "typedef"
        if scope == "body" and t in _CONTROL:
            j = i + 1
            if j < n and toks[j].text == "constexpr":
                j += 1
            self.i = self.close(j, "(", ")") if j < n and toks[j].text == "(" else j
            return
        if scope == "body" and t in ("else", "do", "try", "default"):
            self.i = i + 1
            return
        self.declaration(i, stack, depth, typedef)

    def until_semicolon(self, i: int) -> int:
        while i < len(self.toks):
            t = self.toks[i].text
            if t == ";":
                return i + 1
            if t == "}":
                return i
            i = self.close(i, t, {"(": ")", "{": "}", "[": "]"}[t]) if t in "({[" else i + 1
        return i

    def declaration(self, start: int, stack: list[tuple[str, int]], depth: int, typedef: bool) -> None:
        """Reads to ``;`` or to a body. The words before the first parameter list or initializer decide."""
        toks, n, scope = self.toks, len(self.toks), stack[-1][0]
        i, head, params = start, [], None
        tagged = None
        while i < n:
            i = self.attributes(i) if toks[i].text != "[" or (i + 1 < n and toks[i + 1].text == "[") else i
            if i >= n:
                break
            x = toks[i]
            t = x.text
            if t in ("class", "struct", "union", "enum") and tagged is None:
                entered, i, plain = self.tag(i, stack, depth)
                if entered == "scope":
                    if typedef:
                        stack[-1] = ("class", stack[-1][1])
                        self.pending = "typedef"
                    return
                tagged = plain
                head.append(Tok(plain or "", "id", x.at, x.end))
                continue
            if t == "operator" and params is None:
                j = i + 1
                if j + 1 < n and toks[j].text == "(" and toks[j + 1].text == ")":
                    j += 2
                else:
                    while j < n and toks[j].text not in "(;{":
                        j += 1
                head.append(Tok("operator", "id", x.at, toks[j - 1].end))
                i = j
                continue
            if t == "<" and head and head[-1].kind == "id":
                j = self.close(i, "<", ">")
                if j < n and toks[j - 1].text in (">", ">>"):
                    head[-1] = Tok(head[-1].text, "tpl", head[-1].at, toks[j - 1].end)
                    i = j
                    continue
            if t == "(":
                if head and head[-1].text in ("decltype", "noexcept", "explicit", "typeof", "__typeof__"):
                    i = self.close(i, "(", ")")
                    head[-1] = Tok("auto", "id", head[-1].at, head[-1].end)
                    continue
                params = i
                break
            if t in ";={}:,[":
                break
            head.append(x)
            i += 1
        if typedef:
            self.i = self.until_semicolon(i)
            self.typedef_names(start, self.i, depth)
            return
        if params is not None:
            self.function(head, params, stack, depth)
            return
        if i >= n:
            self.i = n
            return
        t = toks[i].text
        if t == ":" and scope == "body" and len(head) <= 2:
            self.i = i + 1
            return
        if t == "}":
            self.i = i
            return
        self.variables(head, i, scope, depth)

    def tag(self, i: int, stack: list[tuple[str, int]], depth: int):
        """A class, struct, union or enum head. -> ("scope" | "", next index, its name as a type)."""
        toks, n = self.toks, len(self.toks)
        word = toks[i].text
        j = i + 1
        if word == "enum" and j < n and toks[j].text in ("class", "struct"):
            j += 1
        j = self.attributes(j)
        names = []
        while j < n and (toks[j].kind == "id" or toks[j].text == "::") and toks[j].text != "final":
            names.append(toks[j])
            j += 1
            if j < n and toks[j].text == "<":
                j = self.close(j, "<", ">")
                names.append(Tok("<>", "op", toks[j - 1].at, toks[j - 1].end))
        final = j < n and toks[j].text == "final"
        k = j + final
        if word == "enum":
            if len(names) >= 1 and all(x.kind == "id" for x in names):
                self.emit(names[0], names[0], "enum", depth + 1)
            if k < n and toks[k].text == ":":
                while k < n and toks[k].text not in "{;":
                    k += 1
            if k < n and toks[k].text == "{":
                k = self.close(k, "{", "}")
                return "", k, "int"
            return "", j if len(names) <= 1 else self.rewind(names, i), "int"
        has_body = k < n and (toks[k].text == "{" or (toks[k].text == ":" and self.bases_end(k) is not None))
        if not has_body:
            return "", self.rewind(names, i) if len(names) > 1 and names[-1].kind == "id" and all(x.kind == "id" for x in names) else j, names[0].text if names else word
        if len(names) > 1 and all(x.kind == "id" for x in names):
            self.i = (k if toks[k].text == "{" else self.bases_end(k)) + 1
            stack.append(("body", depth + 2))
            return "scope", self.i, None
        if len(names) == 1 and word != "union":
            self.emit(names[0], names[0], word, depth + 1)
        self.i = (k if toks[k].text == "{" else self.bases_end(k)) + 1
        stack.append(("class", depth + 2))
        return "scope", self.i, None

    def rewind(self, names: list[Tok], i: int) -> int:
        """Index of the second name: ``struct X f();`` goes on at ``f``."""
        j = i
        while self.toks[j] is not names[0]:
            j += 1
        return j + 1

    def bases_end(self, i: int) -> int | None:
        while i < len(self.toks) and self.toks[i].text not in ";)}":
            if self.toks[i].text == "{":
                return i
            i = self.close(i, "(", ")") if self.toks[i].text == "(" else i + 1
        return None

    pending: str | None = None

    def trailing(self, stack: list[tuple[str, int]]) -> None:
        """Declarators after a class body."""
        start = self.i
        self.i = self.until_semicolon(self.i)
        depth = stack[-1][1]
        if self.pending == "typedef":
            self.pending = None
            self.typedef_names(start, self.i, depth)
        elif stack[-1][0] == "space" and self.i > start + 1:
            self.declarators(start, self.i - 1, depth)

    def typedef_names(self, start: int, stop: int, depth: int) -> None:
        """Each declarator that is a plain name, at bracket level zero."""
        toks, i = self.toks, start
        prev: Tok | None = None
        while i < stop:
            t = toks[i].text
            if t in "([{":
                i = self.close(i, t, {"(": ")", "{": "}", "[": "]"}[t])
                prev = Tok(")", "op", 0, 0)
                continue
            if t == "<":
                i = self.close(i, "<", ">")
                prev = Tok(">", "op", 0, 0)
                continue
            ends = i + 1 < stop and toks[i + 1].text in (";", ",")
            if ends and toks[i].kind == "id" and (prev is None or prev.text not in ("*", "&", "&&", "::", "typedef")):
                self.emit(toks[i], toks[i], "typedef", depth + 1)
            prev = toks[i] if t != "," else None
            i += 1

    def function(self, head: list[Tok], params: int, stack: list[tuple[str, int]], depth: int) -> None:
        toks, n, scope = self.toks, len(self.toks), stack[-1][0]
        after = self.close(params, "(", ")")
        # the name: identifiers joined by ::, with ~ or operator
        j = len(head) - 1
        first = last = None
        if j >= 0 and head[j].kind in ("id", "tpl"):
            first = last = head[j]
            j -= 1
            if j >= 0 and head[j].text == "~":
                first, j = head[j], j - 1
            while j >= 1 and head[j].text == "::" and head[j - 1].kind in ("id", "tpl"):
                first, j = head[j - 1], j - 2
            if j >= 0 and head[j].text == "::":
                first, j = head[j], j - 1
        pointer = bool(head) and params + 1 < n and toks[params + 1].text in ("*", "&", "&&") and after < n and toks[after].text == "(" and (scope != "body" or head[-1].text in _BUILTIN)
        if pointer:
            first, last, j = None, None, len(head) - 1
        before = head[: j + 1]
        types = [x for x in before if x.kind in ("id", "tpl")]
        wrapped = bool(before) and before[-1].text in ("*", "&", "&&")
        word = first.text if first else ""
        if scope == "body" and (any(x.text in _NOT_A_TYPE for x in before) or word in _NOT_A_TYPE or any(x.kind not in ("id", "tpl") and x.text not in ("*", "&", "&&", "::") for x in before)):
            first = None
        # what follows the parameters
        i = after
        while i < n and toks[i].text not in ";{}=,:[":
            if toks[i].text == "(":
                i = self.close(i, "(", ")")
            elif toks[i].text == "->":
                i += 1
                while i < n and toks[i].text not in ";{}=":
                    i = self.close(i, "<", ">") if toks[i].text == "<" else i + 1
                break
            elif scope == "body" and toks[i].kind == "op" and toks[i].text not in ("&", "&&"):
                break
            else:
                i += 1
        t = toks[i].text if i < n else ";"
        body = t == "{" or (t == ":" and scope != "body")
        literal = params + 1 < after and (toks[params + 1].kind in ("num", "str") or toks[params + 1].text in ("true", "false", "nullptr", "-", "{"))
        declared = bool(types) or scope == "class" or body or (last is not None and first is not last)
        if scope == "body" and not body and not types:
            declared = False
        if pointer and not wrapped:
            if scope != "body" or types:
                self.emit(toks[params], toks[after - 1], "function", depth + 1)
        elif first is not None and declared and not wrapped and not (literal and not body) and word not in ("if", "for", "while", "switch", "catch"):
            if not (scope == "body" and not body and not self.looks_like_parameters(params, after)):
                self.emit(first, last, "function", depth + 1)
        elif first is not None and literal and types and not body and first is last and scope != "class":
            if scope != "body" or any(x.text == "constexpr" for x in before):
                self.emit(first, last, "variable", depth + 1)
        if t == ":" and scope != "body":
            # constructor initializers
            i += 1
            while i < n and toks[i].text != ";":
                if toks[i].text in "({":
                    opener = toks[i].text
                    prev = toks[i - 1]
                    if opener == "{" and prev.text in (")", "}"):
                        break
                    i = self.close(i, opener, ")" if opener == "(" else "}")
                    continue
                i += 1
            t = toks[i].text if i < n else ";"
        if t == "{" and (first is not None or pointer or scope == "body"):
            self.i = i + 1
            stack.append(("body", depth + 2))
            return
        self.i = self.until_semicolon(i)

    def looks_like_parameters(self, params: int, after: int) -> bool:
        inner = self.toks[params + 1 : after - 1]
        if not inner:
            return True
        return inner[0].text in _BUILTIN or inner[0].text in ("const", "struct", "class", "enum", "...") or (len(inner) > 1 and inner[0].kind == "id" and (inner[1].kind == "id" or inner[1].text in ("*", "&", "&&") and len(inner) > 2 and inner[2].kind == "id" or inner[1].text in ("::", "<")))

    def variables(self, head: list[Tok], i: int, scope: str, depth: int) -> None:
        """Declarators of a declaration without parameters; ``i`` is at ``; = { : , [``."""
        stop = self.until_semicolon(i)
        self.i = stop
        constexpr = any(x.text == "constexpr" for x in head)
        if scope == "class" or (scope == "body" and not constexpr):
            return
        words = [x for x in head if x.kind in ("id", "tpl")]
        if len(words) < 2 or any(x.text in _NOT_A_TYPE for x in head) or words[0].text in ("friend",):
            return
        self.one(head, i, depth)
        k = i
        while k < stop and self.toks[k].text != ",":
            t = self.toks[k].text
            k = self.close(k, t, {"(": ")", "{": "}", "[": "]"}[t]) if t in "({[" else k + 1
        if k < stop:
            self.declarators(k + 1, stop - 1, depth)

    def one(self, head: list[Tok], i: int, depth: int) -> None:
        if self.toks[i].text == "[" or head[-1].kind != "id" or head[-1].text in _SPECIFIERS:
            return
        stars = 0
        while stars + 1 < len(head) and head[-2 - stars].text == "*":
            stars += 1
        before = head[-2 - stars] if len(head) > 1 + stars else None
        if stars > 1 or (before is not None and before.text in ("&", "&&", "::", "~")):
            return
        self.emit(head[-1], head[-1], "variable", depth + 1)

    def declarators(self, start: int, stop: int, depth: int) -> None:
        """``a, *b = 1`` : further declarators."""
        toks, i = self.toks, start
        while i < stop:
            head = []
            while i < stop and (toks[i].kind == "id" or toks[i].text in ("*", "&", "&&", "::")):
                head.append(toks[i])
                i += 1
            here = i
            while i < stop and toks[i].text != ",":
                t = toks[i].text
                i = self.close(i, t, {"(": ")", "{": "}", "[": "]"}[t]) if t in "({[" else i + 1
            if head and (here >= stop or toks[here].text in ("=", "{", ",")) and head[-1].kind == "id":
                stars = sum(x.text == "*" for x in head)
                if stars <= 1 and all(x.text == "*" for x in head[:-1]):
                    self.emit(head[-1], head[-1], "variable", depth + 1)
            i += 1


def scan(content: bytes) -> list[tuple[str, str, int, int, int]]:
    """(name, kind, line, offset, end) of a source, by offset."""
    text = content.decode("latin-1")
    out, line, at = [], 1, 0
    for start, end, kind in Scanner(text).run():
        line += text.count("\n", at, start)
        at = start
        out.append((content[start:end].decode("utf-8", "replace"), kind, line, start, end))
    return out


def parse_sources(sources: DataFrame) -> DataFrame:
    """``path, mtime_ns, content`` -> one row per file in the ``PARSED`` schema. Null content is a read error."""

    def body(batches):
        for b in batches:
            rows = [[], [], []]
            for content in b.column("content").to_pylist():
                began = time.perf_counter()
                try:
                    found, error = (scan(content), None) if content is not None else (None, "cannot be read")
                except RecursionError as e:
                    found, error = None, str(e)
                rows[0].append(time.perf_counter() - began)
                rows[1].append(error)
                rows[2].append([dict(zip(("name", "kind", "line", "byte_offset", "byte_end"), x, strict=True)) for x in found] if found is not None else None)
            item = pa.struct([("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("byte_offset", pa.int32()), ("byte_end", pa.int32())])
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("mtime_ns"), pa.array(rows[0], pa.float32()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.list_(item))], ["file", "mtime_ns", "seconds", "error", "found"])

    return sources.select("path", "mtime_ns", "content").mapInArrow(body, PARSED)


def captures_of(parsed: DataFrame) -> DataFrame:
    """``file, name, kind, line, byte_offset, byte_end``: one row per declaration."""
    # a scan has each place once; only a file that was scanned twice repeats itself
    once = parsed.where("error is null").groupBy("file").agg(F.any_value("found").alias("found"))
    return once.select("file", F.explode("found").alias("c")).select("file", "c.*")


def declarations_of(parsed: DataFrame, settle: bool = True) -> DataFrame:
    """Rows of the index, numbered from 0 by file, then offset. A file that was scanned twice has its numbers twice.

    ``parsed`` is read twice, hence settled unless the caller has done so. Only ``(file, number of declarations)`` pairs are put in order, in ranges of files: a running
    sum within each range, and before it the sum of the ranges before, of which there are as many as partitions.
    """
    good = parsed.where("error is null").select("file", "found")
    good = settled(good) if settle else good
    sizes = good.groupBy("file").agg(F.max(F.size("found")).cast("long").alias("n"))
    sizes = settled(sizes.repartitionByRange("file").withColumn("part", F.spark_partition_id()))
    offset, first = {}, 0
    for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        offset[r["part"]], first = first, first + r["n"]
    ranges = parsed.sparkSession.createDataFrame(list(offset.items()), "part int, first long")
    before = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.join(F.broadcast(ranges), "part").select("file", (F.col("first") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("base"))
    rows = good.select("file", F.posexplode("found").alias("i", "c")).join(base, "file")
    return rows.select("c.name", "c.kind", "file", "c.line", (F.col("base") + F.col("i")).alias("ord"))
