"""Requests are read leniently: wrong or missing fields become defaults, decimals are cut to integers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.text import col


def number(text: Column | str) -> Column:
    """Integer part of a JSON number's text; 0 for anything else. A leading minus stays, exponents are not read."""
    return F.coalesce(_leading_integer(col(text)), F.lit(0).cast("long"))


def _leading_integer(c: Column) -> Column:
    return F.regexp_extract(c, r"^\s*(-?[0-9]{1,63})(?:\.[0-9]*)?", 1).try_cast("long")


def string(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def size(array: Column | str) -> Column:
    """Number of elements; 0 where there is no array."""
    return F.coalesce(F.size(col(array)), F.lit(0))


def at(array: Column | str, i: int) -> Column:
    """The element at ``i``, from 0; null beyond the ends."""
    return F.get(col(array), F.lit(i))


def pushed(array: Column | str, value: Column) -> Column:
    """The array with one more element at its end."""
    return F.array_append(col(array), value)


#: Blanks, the longest number, and what a backslash and a letter stand for.
_BLANK, _MAX_NUMBER = re.compile(r"[ \t\n\r]*"), 63
_ESCAPED = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_PLAIN, _NUMBER, _HEX = re.compile(r'[^"\\]*'), re.compile(r"(-?[0-9]*)(?:\.[0-9]*)?"), re.compile(r"[0-9a-fA-F]{4}")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}
_OPENING = re.compile(r"\[(?:[ \t\n\r]*\[)+")
_MOST, _ENDS = (1 << 63) - 1, frozenset("]},")


class BadJson(ValueError):
    """The text does not begin with a JSON value."""


def _string(text: str, at: int, compat: bool) -> tuple[str, int]:
    """The string whose first character is at ``at``, and where its closing quote ends."""
    out = []
    while True:
        m = _PLAIN.match(text, at)
        out.append(m[0])
        at = m.end()
        if at >= len(text):
            raise BadJson("unterminated string")
        if text[at] == '"':
            return "".join(out), at + 1
        e = text[at + 1 : at + 2]
        at += 2
        if e != "u":
            if not e:
                raise BadJson("unterminated string")
            out.append(_ESCAPED.get(e, e))
            continue
        m = None if compat else _HEX.match(text, at)
        at += 4
        code = int(m[0], 16) if m else ord("?")
        if 0xD800 <= code < 0xDC00 and text[at : at + 2] == "\\u" and (low := _HEX.match(text, at + 2)) and 0xDC00 <= int(low[0], 16) < 0xE000:
            code, at = 0x10000 + ((code - 0xD800) << 10) + int(low[0], 16) - 0xDC00, at + 6
        out.append("\ufffd" if 0xD800 <= code < 0xE000 else chr(code))


def parse(text: str, compat: bool = False):
    """The first JSON value of ``text``; what follows it is not read. Raises ``BadJson`` and nothing else, at any depth.

    A number is an optional minus, digits (none: 0) and a fraction that is cut off, 63 characters at most and clamped to 64 bits; there are no
    exponents, NaN or Infinity. Raw control bytes pass in strings; ``\\u`` and four hexadecimal digits are that character, halves of a pair U+FFFD; with ``compat``, or
    where the digits are none, ``\\u`` and four characters are ``?``; other escapes stand for their character. The last of equal keys wins.
    """
    at, open_ = 0, []  # containers around, each with the key that waits for its value

    def blank() -> str:
        nonlocal at
        at = _BLANK.match(text, at).end()
        return text[at : at + 1]

    def key() -> str:
        nonlocal at
        if blank() != '"':
            raise BadJson(f"no key at {at}")
        k, at = _string(text, at + 1, compat)
        if blank() != ":":
            raise BadJson(f"no colon at {at}")
        at += 1
        return k

    while True:
        c = blank()
        if c == "[" and (run := _OPENING.match(text, at)):  # all but the innermost of arrays in arrays
            open_.extend(([], None) for _ in range(run[0].count("[") - 1))
            at = run.end() - 1
        if c == '"':
            value, at = _string(text, at + 1, compat)
        elif c and c in "{[":
            value = {} if c == "{" else []
            at += 1
            if blank() == ("}" if c == "{" else "]"):
                at += 1
            else:
                open_.append((value, key() if c == "{" else None))
                continue
        elif c in _WORDS:
            word, value = _WORDS[c]
            if not text.startswith(word, at):
                raise BadJson(f"no value at {at}")
            at += len(word)
        elif c == "-" or c.isascii() and c.isdigit():
            m = _NUMBER.match(text, at)
            if len(m[0]) > _MAX_NUMBER:
                raise BadJson(f"number too long at {at}")
            at = m.end()
            value = max(-_MOST - 1, min(_MOST, int(m[1]))) if m[1] not in ("", "-") else 0
        else:
            raise BadJson(f"no value at {at}")
        while open_:
            around, k = open_[-1]
            if k is None:
                around.append(value)
            else:
                around[k] = value
            c = text[at : at + 1]
            if c not in _ENDS:
                c = blank()
            at += 1
            if c == ("]" if k is None else "}"):
                open_.pop()
                value = around
            elif c == ",":
                open_[-1] = (around, None if k is None else key())
                break
            else:
                raise BadJson(f"no end at {at}")
        else:
            return value
