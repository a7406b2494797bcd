"""SimHash near-duplicates with pigeonring filtering.

A 64-bit fingerprint is cut into four segments on a ring. If two fingerprints differ in at most
three bits, some start on the ring has cumulative differences within the proportional budget for
every chain length: none in its first segment, at most one in the first two, at most two in the
first three. The first two conditions make the candidate key: the first segment whole plus one
half of the next (one of its halves must agree, as one bit at most differs). Every candidate then
has its whole chain tested before the full Hamming check.

Documents meet as distinct fingerprints; a fingerprint shared by many documents is one row.
A bucket's members are linked by a spanning forest, never by all pairs. A bucket of more than DENSE
fingerprints is cut into parts, and each two parts meet in a group of their own, so no task holds it.

Texts without words (null and empty ones too) have fingerprint zero and link like any other.
Texts of any length are hashed whole. An empty table gives no rows. Only doc_id and text are
read, so other columns can't clash. Ties: a component's id is its smallest doc_id; rows without
doc_id get that of an equal fingerprint, or none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import LOWER_AZ, slices, staged, tidy
from siftwell.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
SEGMENTS, SEGMENT_BITS = 4, 16
#: Rows of a bucket that are compared at once.
BLOCK = 2048
#: Fingerprints of a bucket that meet in one group, about.
DENSE = 1 << 13
#: Rows from which a fingerprint's rows are not shuffled, and fingerprints that this may hold for (what is broadcast).
HOT_ROWS, MOST_HOT = 1 << 14, 1 << 20
#: Bits of a candidate key; a group of a cut bucket has its two parts above them.
KEY_BITS, PART_BITS = 28, 18
#: Shingles whose bits are counted at once.
COUNT_BLOCK = 1 << 16


def shingle_hashes(text: str | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of each run of `size` lower-cased words; of the whole sequence where there are fewer."""
    words = (text or "").encode("utf-8").translate(LOWER_AZ).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(b" ".join(words), SEED)], np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    return np.array([h(line[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), COUNT_BLOCK):
        part = np.ascontiguousarray(hashes[i : i + COUNT_BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp LONG (the 64 bits as a signed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch, "text"):
                part = batch.slice(i, j - i)
                fp = np.array([majority_bits(shingle_hashes(t)) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, fp long")


def ring_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight candidate keys of each fingerprint: (row, key), a key naming its start and half."""
    half = SEGMENT_BITS // 2
    segment = [(fp >> np.uint64(SEGMENT_BITS * s)) & np.uint64((1 << SEGMENT_BITS) - 1) for s in range(SEGMENTS)]
    keys = []
    for s in range(SEGMENTS):
        after = segment[(s + 1) % SEGMENTS]
        for k, part in enumerate((after & np.uint64((1 << half) - 1), after >> np.uint64(half))):
            label = np.uint64(2 * s + k) << np.uint64(SEGMENT_BITS + half)
            keys.append(label | (segment[s] << np.uint64(half)) | part)
    return np.tile(np.arange(len(fp)), len(keys)), np.concatenate(keys) if len(fp) else np.zeros(0, np.uint64)


def within_ring(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the differing bits x pass every chain from the segment `start` on, and the whole check."""
    turn = (start * np.uint64(SEGMENT_BITS)).astype(np.uint64)
    turned = np.where(turn == 0, x, (x >> turn) | (x << ((np.uint64(64) - turn) & np.uint64(63))))
    ok = np.ones(len(x), bool)
    for length in range(1, SEGMENTS + 1):
        bits = SEGMENT_BITS * length
        mask = np.uint64((1 << bits) - 1)
        ok &= np.bitwise_count(turned & mask) <= MAX_BITS * length // SEGMENTS
    return ok


def _bucket_links(fp: np.ndarray, rep: np.ndarray, start: int) -> list[tuple[int, int]]:
    """A spanning forest of one bucket's links, block against block."""
    n = len(fp)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            x = fp[a : a + BLOCK, None] ^ fp[None, b : b + BLOCK]
            near = within_ring(x.ravel(), np.full(x.size, start, np.uint64)).reshape(x.shape)
            if a == b:
                near = np.triu(near, 1)
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                mine = find(a + i)
                for j in np.flatnonzero(near[i]).tolist():
                    other = find(b + j)
                    if other != mine:
                        root[max(mine, other)] = min(mine, other)
                        mine = min(mine, other)
                        out.append((int(rep[a + i]), int(rep[b + j])))
    return out


def links_of_sorted(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that are sorted by key."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(edge, len(key)))
    start = (key & np.uint64((1 << KEY_BITS) - 1)) >> np.uint64(SEGMENT_BITS + SEGMENT_BITS // 2 + 1)
    a, b = [], []
    for gap in (1, 2, 3):  # buckets of up to four rows, all buckets at once
        first = np.concatenate([edge[size == s] + k for s in range(gap + 1, 5) for k in range(s - gap)] or [np.zeros(0, np.int64)]).astype(np.int64)
        hit = first[within_ring(fp[first] ^ fp[first + gap], start[first])]
        a.append(rep[hit])
        b.append(rep[hit + gap])
    large = [(x, y) for e, s in zip(edge[size > 4].tolist(), size[size > 4].tolist()) for x, y in _bucket_links(fp[e : e + s], rep[e : e + s], int(start[e]))]
    a.append(np.array([x for x, _ in large], np.int64))
    b.append(np.array([y for _, y in large], np.int64))
    return np.concatenate(a), np.concatenate(b)


def grouped(rows: DataFrame) -> DataFrame:
    """The rows with the keys of their groups: a row of a cut bucket is in a group with every part of it."""
    size = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    dense = staged(size.where(F.col("n") > DENSE).select("key", F.ceil(F.col("n") / DENSE).alias("parts")), "dense")
    if dense.isEmpty():
        return rows
    parts = F.col("parts")
    mine = F.pmod(F.xxhash64("fp"), parts)
    cut = rows.join(dense, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    pair = F.shiftleft(F.least("mine", "other"), KEY_BITS).bitwiseOR(F.shiftleft(F.greatest("mine", "other"), KEY_BITS + PART_BITS))
    whole = rows.join(dense.select("key"), "key", "left_anti")
    return whole.unionByName(cut.select(F.col("key").bitwiseOR(pair).alias("key"), "fp", "rep"))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) representatives of fingerprints that differ in 1 to 3 bits; a forest of each bucket's links.

    distinct: fp, rep with one row a fingerprint.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            rep = batch.column("rep").to_numpy(zero_copy_only=False)
            row, key = ring_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row]), pa.array(rep[row])], ["key", "fp", "rep"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def take(cut_last: bool):
            key, fp, rep = (np.concatenate(x) for x in zip(*held))
            end = int(np.searchsorted(key, key[-1])) if cut_last and len(key) else len(key)
            held[:] = [(key[end:], fp[end:], rep[end:])]
            a, b = links_of_sorted(key[:end].view(np.uint64), fp[:end].view(np.uint64), rep[:end])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", "rep")))
            if held[0][0].size == 0 or held[0][0][0] != held[-1][0][-1]:
                yield take(True)
        if held:
            yield take(False)

    rows = grouped(distinct.select("fp", "rep").mapInArrow(keyed, "key long, fp long, rep long"))
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(tidy(joined), "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document."""
    prints = staged(fingerprints(docs), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = components(links(distinct.where("rep is not null")))
    found = distinct.join(reps, distinct["rep"] == reps["node"], "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    found = staged(found, "components")
    # a fingerprint may be that of a third of all rows: at most MOST_HOT such ones are broadcast
    many = F.col("n") > max(HOT_ROWS, prints.count() // MOST_HOT)
    hot = F.broadcast(found.where(many))
    usual = prints.join(hot.select("fp"), "fp", "left_anti").join(found.where(~many), "fp")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return usual.unionByName(prints.join(hot, "fp")).select("doc_id", hexed.alias("fingerprint"), "component_id")
