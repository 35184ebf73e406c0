"""Sum-of-squares online packing of token pieces into windows.

Every document becomes its ids plus one end id. Full windows are cut off a document as they come; the rest is placed
online into the open window whose fill level makes the sum of squared level counts smallest (or into a new window),
tracked in an array with one counter per level. A level is ``STEP`` tokens of fill; a piece that fills a window with less
than a step too many is cut there, and what is over is placed as a piece of its own. So some ``WINDOW / STEP`` windows
are open at a time, whatever the partition's size. Those still open at a partition's end are laid end to end into full windows, and
the very last rest is cut into windows whose lengths are powers of two, which need no padding. A partition is packed by
itself, so there is no shuffle and a lost task is repeated alone.

Defined results: a null text is empty, and an empty text is its end id alone; rows with null or repeated ids and repeated
rows are packed each by itself; a text of any length is cut into windows as a whole; an empty table gives no piece; other columns are not read. sequence_id is unique: the partition's number times 2**33 plus a count.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

WINDOW = 1024
STEP = 64
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict[str, object] = {}


def encoder(name: str):
    """texts -> lists of ids of the tokenizer file ``name``.

    The same vocabulary and splitting is available as ranks, several times as fast; texts that hold a special token
    go through the tokenizer file itself.
    """
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name)) as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        whole = []
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb"))}  # noqa: SIM115
        fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

        def encode(texts: list[str]) -> list[list[int]]:
            return [exact(t) if any(s in t for s in special) else fast.encode_ordinary(t) for t in texts]

        def exact(text: str) -> list[int]:
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(public_tokenizers.path(name)))
            return whole[0].encode(text, add_special_tokens=False).ids

        _encoders[name] = encode
    return _encoders[name]


class SumOfSquares:
    """Online packer; ``place`` takes (row, start, length) pieces shorter than a window, ``closed`` gets finished windows.

    ``counts`` has the number of open windows by fill level, a level being ``step`` tokens of fill.
    """

    def __init__(self, window: int = WINDOW, step: int = STEP):
        self.window, self.step, self.closed = window, step, []
        self.counts = [0] * (-(-window // step))
        self.open: list[list[tuple[int, list]]] = [[] for _ in self.counts]

    def choice(self, size: int) -> int | None:
        """The level whose last window takes a piece of this size so that the sum of squared counts becomes smallest, the lowest on a tie; None for a new window.

        A window is full with less than ``step`` tokens too many; those are cut off.
        """
        counts, step, best = self.counts, self.step, None
        least = 2 * counts[size // step] + 1
        for level, n in enumerate(counts):
            if not n:
                continue
            fill = self.open[level][-1][0] + size
            if fill >= self.window + step:
                break
            if fill >= self.window:
                change = 1 - 2 * n
            else:
                after = fill // step
                change = 0 if after == level else 2 * (counts[after] - n) + 2
            if change < least:
                least, best = change, level
        return best

    def place(self, piece: tuple) -> None:
        row, start, size = piece
        level = self.choice(size)
        fill, held = 0, []
        if level is not None:
            fill, held = self.open[level].pop()
            self.counts[level] -= 1
        fits = min(size, self.window - fill)
        held.append((row, start, fits))
        fill += fits
        if fill == self.window:
            self.closed.append(held)
        else:
            self.counts[fill // self.step] += 1
            self.open[fill // self.step].append((fill, held))
        if fits < size:
            self.place((row, start + fits, size - fits))

    def finish(self) -> None:
        """Close what is open without padding."""
        rest = [p for windows in reversed(self.open) for _, held in windows for p in held]
        left = sum(p[2] for p in rest)
        self.counts, self.open = [0] * len(self.counts), [[] for _ in self.open]
        room, held = 0, []
        for row, start, length in rest:
            while length:
                if not room:
                    room = self.window if left >= self.window else 1 << left.bit_length() - 1
                    left -= room
                n = min(length, room)
                held.append((row, start, n))
                start, length, room = start + n, length - n, room - n
                if not room:
                    self.closed.append(held)
                    held = []


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", window: int = WINDOW, step: int = STEP, id_col: str = "doc_id", text_col: str = "text", batch: int = 256) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kernel.small_batches(docs.sparkSession, batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), SumOfSquares(window, step)
        sequence = TaskContext.get().partitionId() << 33
        ids: dict[int, tuple] = {}  # of rows with an open piece: doc_id, the ids left, their start, doc_tokens
        left: dict[int, int] = {}
        out: list[tuple] = []
        row = 0

        def close() -> None:
            nonlocal sequence
            for held in packer.closed:
                at = 0
                for r, start, n in held:
                    doc, rest, first, total = ids[r]
                    out.append((doc, start, n, zlib.crc32(rest[start - first : start - first + n].tobytes()), total, sequence, at))
                    at += n
                    left[r] -= n
                    if not left[r]:
                        del ids[r], left[r]
                sequence += 1
            packer.closed.clear()

        def rows() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=[p.split()[0] for p in SCHEMA.split(", ")])

        for b in batches:
            names = b["doc_id"].to_pylist()
            for k, found in enumerate(encode([t or "" for t in b["text"].to_pylist()])):
                found.append(END_ID)
                whole = np.array(found, "<u4")
                cut = len(whole) - len(whole) % window
                for s in range(0, cut, window):
                    out.append((names[k], s, window, zlib.crc32(whole[s : s + window].tobytes()), len(whole), sequence, 0))
                    sequence += 1
                if cut < len(whole):
                    ids[row], left[row] = (names[k], whole[cut:].copy(), cut, len(whole)), len(whole) - cut
                    packer.place((row, cut, len(whole) - cut))
                    close()
                row += 1
            if out:
                yield rows()
        packer.finish()
        close()
        if out:
            yield rows()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
