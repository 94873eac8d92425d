"""Token counts of whole texts; huge ones by overlap resynchronisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import free_name, kept_columns, slices, tokenizer_path

#: Texts with more characters are encoded in chunks of CHUNK characters that overlap by OVERLAP.
HUGE, CHUNK, OVERLAP = 16_384, 8_192, 128
RESULTS = ("n_bytes", "n_tokens", "over_limit")


class PieceCounter:
    """Counts the pieces of a sentencepiece BPE model with byte fallback, begin and end not added."""

    _shared: dict[str, PieceCounter] = {}

    @classmethod
    def shared(cls, name: str) -> PieceCounter:
        path = tokenizer_path(name)
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, huge: int = HUGE):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap, self.huge, self.widened = chunk, overlap, huge, 0
        feed = self.lib.piece_to_id("\n")
        if feed and not self.lib.is_unknown(feed):
            raise ValueError("the model has a piece for the line feed, which is needed to keep parts apart")
        pieces = (self.lib.id_to_piece(i) for i in range(self.lib.get_piece_size()) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i)))
        every = range(self.lib.get_piece_size())
        byte = {i: int(self.lib.id_to_piece(i)[3:5], 16) for i in every if self.lib.is_byte(i)}
        #: Characters of each piece; of a character's bytes the first counts, the others follow.
        self.follows = np.array([0x80 <= byte.get(i, 0) < 0xC0 for i in every], np.int64)
        self.length = np.array([1 - self.follows[i] if i in byte else len(self.lib.id_to_piece(i)) for i in every], np.int64)
        self.joined = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def stable(self, text: str, at: int) -> bool:
        """No piece holds the two characters around ``at`` side by side, so no merge, in any context, crosses it."""
        return text[at - 1 : at + 1].replace(" ", "▁") not in self.joined

    def offsets(self, text: str, inner: bool = False) -> np.ndarray:
        """Character at which each piece of ``text`` begins; a character's byte pieces share it.

        The model puts a blank before what it is given. ``inner`` undoes that for a part that begins at a stable boundary:
        its own first blank stands for the added one, or else a line feed, which no piece holds, keeps the two apart.
        """
        if not inner:
            return self._begins(text)
        if text[0] in " ▁":
            got = self._begins(text[1:]) + 1
            got[:1] = 0
            return got if len(got) else np.zeros(1, np.int64)
        return self._begins("\n" + text)[2:] - 1

    def _begins(self, text: str) -> np.ndarray:
        """From the pieces' lengths, as they spell the text; the added blank at the front has none."""
        ids = self.lib.encode(text, return_type="numpy")
        begin = np.cumsum(self.length[ids]) - self.length[ids] - 1
        begin[:1] = 0
        return begin - self.follows[ids]

    def huge_count(self, text: str) -> int:
        """Chunks are joined at a boundary in their overlap that both encodings have and that is proven stable.

        Without one the overlap is doubled, down to the last join; without one there either, the chunk itself is made longer, in
        the end up to the whole rest of the text.
        """
        total, joint, size, n = 0, 0, self.chunk, len(text)
        while joint + size < n:
            left = self.offsets(text[joint : joint + size], joint > 0) + joint
            end, width, found = joint + size, self.overlap, None
            while found is None:
                begin = max(joint + 1, end - width)
                right = self.offsets(text[begin : end + width]) + begin
                both = np.intersect1d(left, right)
                found = next((int(p) for p in both[::-1] if begin < p < end and self.stable(text, int(p))), None)
                if found is None:
                    self.widened += 1
                    if begin == joint + 1:
                        break
                    width *= 2
            if found is None:
                size *= 2
                continue
            total += int(np.searchsorted(left, found))
            size, joint = self.chunk, found
        return total + len(self.offsets(text[joint:], joint > 0))

    def count(self, texts: list[str]) -> list[int]:
        short = [t for t in texts if len(t) <= self.huge]
        got = iter(self.lib.encode(short, num_threads=1, return_type="numpy")) if short else iter(())
        return [len(next(got)) if len(t) <= self.huge else self.huge_count(t) for t in texts]


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` columns (all by default) plus ``n_bytes``, ``n_tokens`` and ``over_limit`` for every row.

    Null and empty texts have 0 of both. Whole texts are counted, however long. Rows are never dropped. A column of ``docs`` named like a
    result gives way to it.
    """
    text = free_name(docs, "text")
    src = docs.select(*(keep if keep is not None else kept_columns(docs, RESULTS)), F.col(f"`{text_col}`").alias(text))
    out = type(src.schema)(src.schema.fields[:-1]).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def body(batches):
        counter = PieceCounter.shared(model)
        for b in slices(batches, text):
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                [*b.schema.names[:-1], *RESULTS],
            )

    return src.mapInArrow(body, out)
