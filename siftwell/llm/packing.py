"""Packing token sequences into fixed windows by best-fit decreasing.

Overlong documents are first cut into full windows; what remains is packed, longest piece first,
each into the tightest open window that holds it. A segment tree over remaining capacities finds
that window. Pieces are dealt evenly into groups of about PIECES_PER_GROUP,
each packed alone, so a group's padding is at most about one window and no task sees all pieces.

Null and empty texts have the end token alone. Ties are broken by doc_id and start. Rows that repeat
a doc_id, or have none, are documents of their own; pieces are dealt by their places in the staged
table, so such rows spread like any others. An empty
table gives no rows. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import bpe
from siftwell.llm.common import slices, staged, tidy

WINDOW = 4096
END_ID = 2
PIECES_PER_GROUP = 20_000
#: Text that is encoded at once.
TEXT_BYTES = 1 << 20
#: Sequence numbers of a group start at its number times this.
GROUP_STRIDE = 1 << 32


class BestFit:
    """Open windows by remaining capacity: a segment tree whose leaves are capacities 0..window."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.window, self.made = window, 0

    def _add(self, capacity: int, n: int) -> None:
        i, tree = self.leaves + capacity, self.tree
        while i:
            tree[i] += n
            i >>= 1

    def tightest(self, length: int) -> int:
        """The smallest capacity of an open window that is at least length, or -1."""
        i, tree = self.leaves + length, self.tree
        if tree[i]:
            return length
        while i > 1:
            if not i & 1 and tree[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return -1
        while i < self.leaves:
            i <<= 1
            if not tree[i]:
                i += 1
        return i - self.leaves

    def place(self, length: int) -> tuple[int, int]:
        """The window that takes a piece, and the piece's offset in it."""
        capacity = self.tightest(length)
        if capacity < 0:
            number, capacity = self.made, self.window
            self.made += 1
        else:
            number = self.open[capacity].pop()
            self._add(capacity, -1)
        if rest := capacity - length:
            self.open[rest].append(number)
            self._add(rest, 1)
        return number, self.window - capacity


def pack_lengths(lengths, window: int = WINDOW) -> list[tuple[int, int]]:
    """(window, offset) of each piece; lengths must not rise."""
    fit = BestFit(window)
    return [fit.place(n) for n in lengths]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, word_store: int = bpe.WORD_STORE) -> DataFrame:
    """The pieces of each document's ids (its end token included): full windows, then the rest.

    word_store: distinct words that a worker keeps, at about 200 bytes each.
    """
    blob = bpe.vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.opened(blob.value, bpe.LibraryBPE, word_store)
        for batch in batches:
            for i, j in slices(batch, "text", TEXT_BYTES):
                part = batch.slice(i, j - i)
                ids, at = enc.encode_batch(part.column("text").to_pylist())
                n = len(at) - 1
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(n + 1)
                total = np.diff(at)
                k = -(-total // window)
                doc = np.repeat(np.arange(n), k)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)) * window
                length = np.minimum(window, total[doc] - start)
                raw, begin = ids.view(np.uint8), (at[doc] + start) * 4
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), PIECES)


def pack(cut: DataFrame, window: int = WINDOW, per_group: int = PIECES_PER_GROUP) -> DataFrame:
    """sequence_id and offset for each piece (doc_id, start, length and any further columns)."""
    cut = staged(cut, "pieces")
    groups = max(1, -(-cut.count() // per_group))
    fields = [f for f in cut.schema.fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fit = None, None
        for batch in batches:
            seq, off = [], []
            for g, n in zip(batch.column("_group").to_pylist(), batch.column("length").to_pylist()):
                if g != group:
                    group, fit = g, BestFit(window)
                w, o = fit.place(n)
                seq.append(g * GROUP_STRIDE + w)
                off.append(o)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], [*names, "sequence_id", "offset"])

    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    ordered = dealt.repartition(groups, "_group").sortWithinPartitions("_group", F.desc("length"), "doc_id", "start")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return ordered.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, word_store: int = bpe.WORD_STORE) -> DataFrame:
    return pack(pieces(docs, path, word_store=word_store))
