"""Chat formatting by token-level assembly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import slices
from brindle.llm.tokens import ByteBpe

#: How the markers of a turn are written; their ids are the first two beyond the tokenizer's.
IM_START, IM_END = "<|im_start|>", "<|im_end|>"
#: A conversation with more tokens is given out in several rows.
PART_TOKENS = 1 << 18

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def reserved(tokenizer: str) -> tuple[int, int]:
    """Ids of the two markers. A tokenizer that already has them is refused: content could spell them."""
    lib = ByteBpe.shared(tokenizer).lib
    if any(lib.token_to_id(m) is not None for m in (IM_START, IM_END)):
        raise ValueError("the tokenizer has the markers of a turn among its tokens")
    first = max(lib.get_vocab(with_added_tokens=True).values()) + 1
    return first, first + 1


def escape(text: str) -> str:
    """One more backslash inside every ``<|``, ``<\\|``, ...: no control string is left, and unescape takes it out again."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As ``escape``, and on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _arrays(b: pa.RecordBatch, name: str) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in b.column(name).to_pylist()]


def format_conversations(turns: DataFrame, tokenizer: str = "byte_bpe_50k.json", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_tokens: int = PART_TOKENS) -> DataFrame:
    """``conv_id, part, last, n_turns, tokens, loss_mask``: each conversation's tokens in order of turn.

    A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Role line and text are escaped and encoded where they lie, before any
    shuffle; the reserved ids are spliced in afterwards and cannot come from content. ``loss_mask`` is true for the
    tokens of assistant texts, markers excluded, by a prefix sum over +1 at the start and -1 at the end of each.

    Null role or text is empty; null conversations are one group; null turns come first; equal turns are ordered by
    role, then content; repeated rows are turns of their own. A long conversation is given out in parts of whole turns,
    ``last`` marking the final one; only one part is in memory at a time. Parts of a conversation follow each other in one partition.
    """

    def encode(batches):
        bpe = ByteBpe.shared(tokenizer)
        for b in slices(batches, "x"):
            roles = [r or "" for r in b.column("r").to_pylist()]
            head = bpe.encode_bytes([escape_role(r) + "\n" for r in roles])
            body = bpe.encode_bytes([escape(t or "") for t in b.column("x").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("c"), b.column("n"), pa.array(roles), pa.array(head, pa.binary()), pa.array(body, pa.binary())], ["c", "n", "r", "head", "body"])

    src = turns.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("n"), F.col(role_col).alias("r"), F.col(text_col).alias("x"))
    coded = src.mapInArrow(encode, "c long, n long, r string, head binary, body binary")
    ordered = coded.repartition("c").sortWithinPartitions("c", "n", "r", "head", "body")

    def assemble(batches):
        end = np.frombuffer(ByteBpe.shared(tokenizer).encode_bytes(["\n"])[0], "<u4")
        start, stop = (np.array([i], "<u4") for i in reserved(tokenizer))
        conv, part, held, size = None, 0, [], 0

        def flush(last: bool) -> pa.RecordBatch:
            segments = [s for _, h, t in held for s in (start, h, t, stop, end)]
            edges = np.concatenate(([0], np.cumsum([len(s) for s in segments])))
            delta = np.zeros(edges[-1] + 1, np.int64)
            learn = np.array([r == "assistant" for r, _, _ in held])
            np.add.at(delta, edges[2::5][learn], 1)
            np.add.at(delta, edges[3::5][learn], -1)
            mask = np.cumsum(delta)[:-1] > 0
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([part], pa.int32()), pa.array([last]), pa.array([len(held)], pa.int64()), pa.array([np.concatenate(segments).astype(np.int32)], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.bool_()))],
                ["conv_id", "part", "last", "n_turns", "tokens", "loss_mask"],
            )

        for b in batches:
            for c, r, h, t in zip(b.column("c").to_pylist(), b.column("r").to_pylist(), _arrays(b, "head"), _arrays(b, "body"), strict=True):
                if held and c != conv:
                    yield flush(True)
                    part, held, size = 0, [], 0
                elif size > part_tokens:
                    yield flush(False)
                    part, held, size = part + 1, [], 0
                conv = c
                held.append((r, h, t))
                size += len(h) + len(t)
        if held:
            yield flush(True)

    return ordered.mapInArrow(assemble, "conv_id long, part int, last boolean, n_turns long, tokens array<int>, loss_mask array<boolean>")


class Reader:
    """Reads turns and loss text back from tokens and mask alone."""

    def __init__(self, tokenizer: str):
        bpe = ByteBpe.shared(tokenizer)
        self.start, self.stop = reserved(tokenizer)
        self.bytes = {i: bpe.fast.decode_single_token_bytes(i) for i in bpe.fast._mergeable_ranks.values()}

    def text(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode()

    def turns(self, tokens: np.ndarray) -> Iterator[tuple[str, str, int]]:
        """Role, text, and number of characters of the formatted turn."""
        for a, z in zip(np.flatnonzero(tokens == self.start), np.flatnonzero(tokens == self.stop), strict=True):
            inner = self.text(tokens[a + 1 : z])
            role, _, text = inner.partition("\n")
            yield unescape_role(role), unescape(text), len(IM_START) + len(inner) + len(IM_END) + 1

    def learned(self, tokens: np.ndarray, mask: np.ndarray) -> Iterator[str]:
        """Text of each run under the mask."""
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
        for a, z in zip(edge[::2], edge[1::2], strict=True):
            yield unescape(self.text(tokens[a:z]))


def digests(formatted: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """What can be read back from ``format_conversations``, one row per conversation."""

    def body(batches):
        reader, state = Reader(tokenizer), None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for b in batches:
            for i in range(b.num_rows):
                tokens = b.column("tokens")[i].values.to_numpy()
                mask = b.column("loss_mask")[i].values.to_numpy(zero_copy_only=False)
                state = state or [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, chars in reader.turns(tokens):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[4] += chars
                for text in reader.learned(tokens, mask):
                    state[2] += len(text)
                    state[3].update(text.encode())
                if b.column("last")[i].as_py():
                    n, turns, chars, loss, written = state
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                    row = (b.column("conv_id")[i].as_py(), n, turns.hexdigest(), chars, loss.hexdigest(), written)
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)
                    state = None

    return formatted.mapInArrow(body, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
