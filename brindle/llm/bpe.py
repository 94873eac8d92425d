"""BPE with word ends: speculate with greedy longest match, verify adjacent pairs, merge exactly only what fails."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from array import array
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import free_name, kept_columns, slices, tokenizer_path

#: Bytes, by estimate, of each of the two generations of units (text between blanks) that a Python worker remembers, and characters
#: of the longest unit or word that outlives its slice. Results do not depend on either.
REMEMBER, LONGEST = 224 << 20, 64
RESULTS = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
#: Letters and numbers below U+0250, as Unicode has them; there NFC changes nothing.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
#: Capitals whose lower case lies beyond (Ə, Ɓ, Ɗ and others) are left out: the classes above do not know it.
_PLAIN = re.compile("[\n!-~" + "".join([c for c in map(chr, range(0xA1, 0x250)) if max(c.lower()) < "ɐ"]) + "]*")


_FIRST, _SECOND = itemgetter(0), itemgetter(1)


class WordBpe:
    """A tokenizers file with NFC, lower case, a splitting pattern, byte alphabet and a word-end suffix."""

    _shared: dict[str, WordBpe] = {}

    @classmethod
    def shared(cls, name: str) -> WordBpe:
        path = tokenizer_path(name)
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte = [""] * 256
        for b in shown:
            self.byte[b] = chr(b)
        for i, b in enumerate(hidden):
            self.byte[b] = chr(256 + i)
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        n = max(self.token) + 1
        #: As they are decoded, with a blank after each.
        self.shown = {i: f"{t} " for i, t in self.token.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        #: When a token is formed (merge number, -1 for characters) and from what.
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.arange(n), np.arange(n)
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            i, j, to = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge[i, j] = (r, to)
            if self.rank[to] < 0:
                self.rank[to], self.left[to], self.right[to] = r, i, j
        keys = np.array([(i << 32) | j for i, j in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair, self.pair_rank = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        #: Longest token that begins with the same four characters; where there is none, three characters are the most.
        self.longest: dict[str, int] = {}
        for t in self.vocab:
            bare = t.removesuffix(self.suffix) if self.suffix else t
            if len(bare) > 3:
                self.longest[bare[:4]] = max(len(bare), self.longest.get(bare[:4], 4))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split").replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _NUMBERS)
        #: The same splitting for plain units, if the pattern only tells letters, numbers and white space apart.
        self.plain_words = None if r"\p" in pattern else re.compile(pattern)
        #: Marks that stand alone after a word of letters.
        self.tails = frozenset(p for p in ".,;:!?" if self.plain_words and not any(p in s for s in self.special) and self.plain_words.findall(f"ab{p}") == ["ab", p])
        #: Tokens that may be proposed, with their ids, and those that may not.
        self.sound: dict[str, int] = {}
        self.unsound: set[str] = set()
        self.word_ids: dict[str, tuple[int, ...]] = {}
        #: Of a unit its ids, and its tokens with a blank after each; what is new, and what was new before.
        self.units: dict[str, tuple[bytes, str]] = {}
        self.before: dict[str, tuple[bytes, str]] = {}
        self.size = self.speculated = self.failed = 0

    def exact(self, characters: list[str]) -> list[int]:
        """Lowest merge first, leftmost among equals."""
        ids = [self.vocab[c] for c in characters if c in self.vocab]
        if len(ids) <= 24:
            get, none = self.merge.get, (1 << 60, 0)
            found = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
            while found:
                best = min(found)
                if best is none or best[0] == none[0]:
                    break
                i = found.index(best)
                ids[i : i + 2] = [best[1]]
                del found[i]
                if i < len(found):
                    found[i] = get((ids[i], ids[i + 1]), none)
                if i:
                    found[i - 1] = get((ids[i - 1], ids[i]), none)
            return ids
        nxt, prv, alive = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), [True] * len(ids)
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(len(ids) - 1) if (m := self.merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = to, False, nxt[j]
            if nxt[i] < len(ids):
                prv[nxt[i]] = i
                if m := self.merge.get((to, ids[nxt[i]])):
                    heapq.heappush(heap, (m[0], i, to, ids[nxt[i]], m[1]))
            if prv[i] >= 0 and (m := self.merge.get((ids[prv[i]], to))):
                heapq.heappush(heap, (m[0], prv[i], ids[prv[i]], to, m[1]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def characters(self, word: str, end: bool = True) -> list[str]:
        return [*word[:-1], word[-1] + self.suffix] if end else list(word)

    def is_sound(self, token: str) -> bool:
        """Whether the exact merges of a token's own characters give the token back."""
        if token in self.sound:
            return True
        if token in self.unsound or token not in self.vocab:
            return False
        end = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
        if self.exact(self.characters(token[: -len(self.suffix)] if end else token, end)) == [self.vocab[token]]:
            self.sound[token] = self.vocab[token]
            return True
        self.unsound.add(token)
        return False

    def greedy(self, word: str) -> list[int] | None:
        """Longest sound token first; None where no token fits."""
        out, i, n, sound, longest, vocab = [], 0, len(word), self.sound, self.longest, self.vocab
        whole = word + self.suffix
        while i < n:
            j = i + longest.get(word[i : i + 4], 3)
            if j >= n:
                t = whole[i:]
                if t in sound or (t in vocab and self.is_sound(t)):
                    out.append(sound[t])
                    return out
                j = n - 1
            while j > i:
                t = word[i:j]
                if t in sound or (t in vocab and self.is_sound(t)):
                    out.append(sound[t])
                    i = j
                    break
                j -= 1
            else:
                return None
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each adjacent pair of tokens: do the exact merges of the two together leave both as they are?

        Runs their making backwards, all pairs at once. Only the piece at the right edge of a and that at the left edge
        of b matter. If those two merge with each other before the later of them goes into its parent, the pair fails. Among
        equal merges the left one comes first, so a parent on the right gives way to an equal merge across.
        """
        ok, x, y = np.ones(len(a), bool), a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        live = np.arange(len(a))
        while len(live):
            key = (x[live] << 32) | y[live]
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            bad = (self.pair[at] == key) & (self.pair_rank[at] < limit[live])
            ok[live[bad]] = False
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            live = live[~bad & (np.maximum(rx, ry) >= 0)]
            rx, ry = self.rank[x[live]], self.rank[y[live]]
            undo = rx > ry
            u, v = live[undo], live[~undo]
            limit[u], x[u] = self.rank[x[u]], self.right[x[u]]
            limit[v], y[v] = self.rank[y[v]] + 1, self.left[y[v]]
        return ok

    def merged(self, word: str) -> list[int]:
        """``exact`` for a whole word, by the library's merge loop over the same table."""
        return [t.id for t in self.lib.model.tokenize(word)]

    def learn(self, words: list[str]) -> None:
        """Encode new words (in the byte alphabet) into ``word_ids``."""
        guess = [self.greedy(w) for w in words]
        self.speculated += len(words)
        n = np.array([len(g) if g else 0 for g in guess])
        flat = np.array([t for g in guess if g for t in g], np.int64)
        owner = np.repeat(np.arange(len(words)), n)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) else np.zeros(0, np.int64)
        bad = np.zeros(len(words), bool)
        bad[owner[inner[~self.compatible(flat[inner], flat[inner + 1])]]] = True
        for w, g, fails in zip(words, guess, bad, strict=True):
            if fails or g is None:
                self.failed += 1
                g = self.merged(w)
            self.word_ids[w] = tuple(g)

    def split(self, unit: str) -> list[str | int]:
        """Words of a unit in the byte alphabet, and ids of special strings."""
        if unit.isascii():
            if unit.isalpha():
                return [unit.lower()]
            if unit[-1:] in self.tails and unit[:-1].isalpha():
                return [unit[:-1].lower(), unit[-1]]
        special = self.cut and "<" in unit and any(s in unit for s in self.special)
        if self.plain_words and not special and _PLAIN.fullmatch(unit):
            found = self.plain_words.findall(unit.lower())
            return [w if w.isascii() and w.isprintable() else self.spelled(w) for w in found]
        out: list[str | int] = []
        for part in self.cut.split(unit) if special else [unit]:
            if part in self.special:
                out.append(self.special[part])
                continue
            # by the library itself, whose Unicode tables no other has; its words are in the byte alphabet
            out += [w for w, _ in self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(part))]
        return out

    def spelled(self, word: str) -> str:
        """A word in the byte alphabet, in which printable ASCII stands for itself."""
        return word if word.isascii() and word.isprintable() else "".join([self.byte[x] for x in word.encode()])

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids (little-endian unsigned 32-bit) and its decoding: the tokens, joined by blanks."""
        parts = [t.split(" ") for t in texts]
        if self.size > REMEMBER:
            self.before, self.units, self.size = self.units, {}, 0
            self.word_ids.clear()
        units, before = self.units, self.before
        new = set().union(*parts).difference(units)
        known = new.intersection(before)
        for u in known:
            units[u] = before[u]
        split = {u: self.split(u) for u in new - known}
        fresh = {w for s in split.values() for w in s if isinstance(w, str)} - self.word_ids.keys()
        if fresh:
            self.learn(list(fresh))
        token = self.shown
        for u, s in split.items():
            ids = [i for w in s for i in (self.word_ids[w] if isinstance(w, str) else (w,))]
            raw = array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()
            units[u] = (raw, "".join([token[i] for i in ids]))
        out, get = [], units.__getitem__
        for p in parts:
            pairs = list(map(get, p))
            out.append((b"".join(map(_FIRST, pairs)), "".join(map(_SECOND, pairs))[:-1]))
        for w in [w for w in fresh if len(w) > LONGEST]:
            del self.word_ids[w]
        for u in [u for u in split if len(u) > LONGEST]:
            del units[u], split[u]
        # a unit with its two values, and about one word
        self.size += 600 * (len(split) + len(known)) + 12 * (sum(map(len, split)) + sum(map(len, known)))
        return out


def encode_decode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", text_col: str = "text", keep: list[Column] | None = None, ids: bool = True) -> DataFrame:
    """``keep`` columns (all by default) plus ``ids`` (array, if asked for), ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    Whole texts, null as empty (no tokens, empty decoding). Special strings in a text keep their ids, none are added. A text
    is handled between blanks: normalisation, splitting and merges never cross one. A column of ``docs`` named like a result
    gives way to it.
    """
    text = free_name(docs, "text")
    src = docs.select(*(keep if keep is not None else kept_columns(docs, RESULTS if ids else RESULTS[1:])), F.col(f"`{text_col}`").alias(text))
    out = type(src.schema)(src.schema.fields[:-1])
    if ids:
        out = out.add("ids", T.ArrayType(T.IntegerType()))
    out = out.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def body(batches):
        bpe = WordBpe.shared(tokenizer)
        for b in slices(batches, text):
            done = bpe.encode([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            raw = [d[0] for d in done]
            cols = [pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array([hashlib.sha256(d[1].encode()).hexdigest() for d in done])]
            if ids:
                cols.insert(0, pa.array([np.frombuffer(r, "<u4").astype(np.int32) for r in raw], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [f.name for f in out.fields])

    return src.mapInArrow(body, out)
