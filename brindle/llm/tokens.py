"""Encoding whole texts with public tokenizer files, unit by unit."""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np

from brindle.llm.common import tokenizer_path

#: Bytes of encoded units that a Python worker remembers, by estimate, and characters of the longest unit that is remembered at all;
#: the memory is emptied when it is full. Results do not depend on it.
REMEMBER, LONGEST = 128 << 20, 64

#: GPT-2's published splitting pattern.
GPT2_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def units(text: str) -> list[str]:
    """Cut before every single blank between two non-blanks: byte-level BPE with the pattern above never joins across it.

    The pattern gives a lone blank to what follows it. Where white space meets a blank, the parts stay together.
    """
    parts = text.split(" ")
    if len(parts) == 1:
        return parts
    out = [parts[0], *(" " + p for p in parts[1:])]
    if "  " not in text and not _EDGE.search(text) and text[0] != " " and text[-1] != " ":
        return out
    joined = [out[0]]
    for u in out[1:]:
        if len(u) == 1 or u[1].isspace() or not joined[-1] or joined[-1][-1].isspace():
            joined[-1] += u
        else:
            joined.append(u)
    return joined


_EDGE = re.compile(r"\s | \s")


class ByteBpe:
    """Byte-level BPE file of the tokenizers library, without added special tokens; special strings in a text keep their ids.

    Units are remembered. New units of plain letters go through tiktoken's merge loop over the same vocabulary, others through the
    tokenizers library itself.
    """

    _shared: dict[str, ByteBpe] = {}

    @classmethod
    def shared(cls, name: str) -> ByteBpe:
        """One for each worker process and file."""
        path = tokenizer_path(name)
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("units", pat_str=GPT2_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.merge = self.fast._core_bpe.encode_ordinary
        #: A character that every special string begins with, if there is one.
        self.mark = self.special[0][0] if self.special and len({s[0] for s in self.special}) == 1 else ""
        self.known: dict[str, bytes] = {}
        self.size = 0
        self.plain = re.compile("[\x00-ɏ]*")

    def _new(self, unit: str) -> bytes:
        if self.plain.fullmatch(unit) and not (self.mark in unit and any(s in unit for s in self.special)):
            ids = self.merge(unit)
        else:
            ids = self.lib.encode(unit, add_special_tokens=False).ids
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null is empty."""
        known, out = self.known, []
        for t in texts:
            parts = units(t or "")
            try:
                out.append(b"".join(map(known.__getitem__, parts)))
            except KeyError:
                if self.size > REMEMBER:
                    known.clear()
                    self.size = 0
                long: dict[str, bytes] = {}
                for u in parts:
                    if u not in known and u not in long:
                        if len(u) > LONGEST:
                            long[u] = self._new(u)
                        else:
                            known[u] = self._new(u)
                            self.size += 190 + len(u) + len(known[u])
                out.append(b"".join([long[u] if u in long else known[u] for u in parts]))
        return out
