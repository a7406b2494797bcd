"""Suffix-array deduplication of long repeated byte strings, over all documents.

A byte is removed if a MIN_BYTES-byte string that covers it also starts earlier: in a document of
smaller doc_id, or earlier in the same one. Matches never cross documents.

Equal strings of MIN_BYTES bytes hold the same anchors: of the K-byte grams in the string, the one
of smallest hash. So suffixes are sampled at anchors, and only occurrences of the same anchor need
to be compared. Occurrences whose whole surroundings (every MIN_BYTES string that holds the anchor)
are equal are summed up as one class first: all but the first of a class are repeats, and only that
one goes on, if its anchor has other classes.

Those suffixes meet in the order of a Burrows-Wheeler transform, an interval an anchor. Extension is
breadth-first, a byte a step, in both directions. To the right, an interval that splits at step v
fixes the common prefixes at its borders as v, so these come by increasing value, and what holds to
MIN_BYTES is not told apart further. To the left, at depth l, every interval is split by the byte
before, so its rows share l bytes to the left and their common prefix to the right; a repeat is an
interval whose l plus common prefix reaches MIN_BYTES. Depths end at MIN_BYTES - K; single rows stop.
An anchor with more than HOT_ROWS classes (a passage that very many documents share, each time with
other neighbours) is not compared in one task: its strings are hashed whole, settled within each
slice, and compared by hash over all tasks.

Null and empty texts have no bytes and nothing removed. Texts shorter than MIN_BYTES lose nothing.
Very long texts are handled whole, in slices of vectorised work. Equal texts keep the first. An
empty table gives no rows. Only doc_id and text are read, so other columns can't clash. Rows that
repeat a doc_id are taken in the order of their texts, each a document of its own, and rows without
doc_id come after all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftwell.llm.common import free_name, joined_bytes, numbered, slices, staged, tidy, trimmed

MIN_BYTES = 100
K = 32
LEFT = MIN_BYTES - K
#: Rows whose suffixes are sorted together; whole anchors only.
BLOCK_ROWS = 1 << 13
#: An anchor with more classes to compare is not sorted in one task; its windows are compared by hash.
HOT_ROWS = 1 << 15
#: Text whose anchors are found at once; about a hundred bytes of working memory a byte.
ANCHOR_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_HASH = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(12, int(n).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every run of `width` neighbours, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document index, position in it, anchor hash, hash of the surroundings) of every anchor."""
    n = len(data)
    size = np.diff(offsets)
    if n < MIN_BYTES or not (size >= MIN_BYTES).any():
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = _BYTE_HASH[data]
        gram, have, power = h, 1, _BASE
        while have < K:
            gram = gram[: len(gram) - have] * power + gram[have:]
            power, have = power * power, have * 2
        gram = _mixed(gram)
        least = _sliding(gram, MIN_BYTES - K + 1, np.minimum)  # by start of a MIN_BYTES string
        doc = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(least)) + MIN_BYTES <= offsets[1:][doc[: len(least)]]
        least = np.where(inside, least, np.uint64(0))
        pad = np.zeros(LEFT, np.uint64)
        best = _sliding(np.concatenate([pad, least, pad]), LEFT + 1, np.maximum)
        at = np.flatnonzero(gram == best[: len(gram)])
        up, down = _powers(n + 1)
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])
        d = doc[at]
        start, end = np.maximum(at - LEFT, offsets[:-1][d]), np.minimum(at + MIN_BYTES, offsets[1:][d])
        around = (prefix[end] - prefix[start]) * down[start]
        around = _mixed(around ^ _mixed(((at - start) * 256 + (end - at)).astype(np.uint64) + _BASE))
    return d, at - offsets[:-1][d], gram[at], around


def repeated_here(anchor: np.ndarray, around: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether a row of the same anchor and surroundings, among these, comes earlier in the corpus."""
    order = np.lexsort([pos, doc, around, anchor])
    again = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    again[a] = (anchor[a] == anchor[b]) & (around[a] == around[b])
    return again


def anchor_table(docs: DataFrame) -> DataFrame:
    """anchor, around, doc_id, place (position, reach to the left and right) and done of every anchor.

    done: the same surroundings stand earlier in the same slice of the input, so the row is settled
    and takes no part in the comparison; its anchor is a number that only deals it out evenly. So a
    frequent line or a text repeated in itself is summed up before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch, "text", ANCHOR_BYTES):
                part = batch.slice(i, j - i)
                data, offsets = joined_bytes(part.column("text"))
                d, pos, anchor, around = anchors(data, offsets)
                left, right = np.minimum(pos, LEFT), np.minimum(np.diff(offsets)[d] - pos, MIN_BYTES)
                doc = part.column("doc_id").take(pa.array(d))
                done = repeated_here(anchor, around, doc.to_numpy(zero_copy_only=False), pos) & (left + right >= MIN_BYTES)
                with np.errstate(over="ignore"):
                    anchor = np.where(done, _mixed(anchor + _BASE * np.arange(1, len(anchor) + 1, dtype=np.uint64)), anchor)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(around.view(np.int64)), doc, pa.array((pos << 16) | (left << 8) | right), pa.array(done)], ["anchor", "around", "doc_id", "place", "done"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "anchor long, around long, doc_id long, place long, done boolean")


def settled(table: DataFrame) -> DataFrame:
    """doc_id, place, anchor: repeats of whole surroundings (anchor null), and the first row of each class.

    Streams over rows sorted by anchor and surroundings, dealt by both: the classes of a frequent
    anchor go to all tasks.
    """
    cols = ("anchor", "around", "doc_id", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        for batch in batches:
            done = batch.column("done").to_numpy(zero_copy_only=False)
            anchor, around, doc, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in cols)
            n = len(anchor)
            if not n:
                continue
            first = np.ones(n, bool)
            first[1:] = (anchor[1:] != anchor[:-1]) | (around[1:] != around[:-1])
            first[0] = last != (anchor[0], around[0])
            first |= done
            last = None if done[-1] else (anchor[-1], around[-1])
            whole = (place >> 8 & 255) + (place & 255) >= MIN_BYTES
            send = np.where(first, True, whole)
            null = ~first | done
            yield pa.RecordBatch.from_arrays([pa.array(doc[send]), pa.array(place[send]), pa.array(anchor[send], mask=null[send])], ["doc_id", "place", "anchor"])

    ordered = table.repartition("anchor", "around").sortWithinPartitions("done", *cols)
    return ordered.mapInArrow(tidy(run), "doc_id long, place long, anchor long")


def contested(found: DataFrame) -> DataFrame:
    """doc_id, place, anchor, classes: the firsts of classes whose anchor has several."""
    firsts = found.where("anchor is not null")
    several = firsts.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    return firsts.join(several, "anchor").select("doc_id", "place", "anchor", "classes")


def surroundings(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """anchor, doc_id, place, bytes: the text around each row's anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch, "text"):
                part = batch.slice(i, j - i)
                data, offsets = joined_bytes(part.column("text"))
                lists = part.column("rows")
                k = np.diff(np.asarray(lists.offsets))
                flat = lists.flatten()
                place = flat.field("place").to_numpy(zero_copy_only=False)
                base = offsets[:-1][np.repeat(np.arange(len(k)), k)] + (place >> 16)
                start, size = base - (place >> 8 & 255), (place >> 8 & 255) + (place & 255)
                ends = np.cumsum(size)
                at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)
                cut = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])
                doc = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(k)), k)))
                yield pa.RecordBatch.from_arrays([flat.field("anchor"), doc, pa.array(place), cut], ["anchor", "doc_id", "place", "bytes"])

    by_doc = rows.groupBy("doc_id").agg(F.collect_list(F.struct("place", "anchor")).alias("rows"))
    return docs.select("doc_id", "text").join(by_doc, "doc_id").mapInArrow(tidy(run), "anchor long, doc_id long, place long, bytes binary")


def common_prefixes(group: np.ndarray, suffix: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes within their groups, and the common prefix of each with the one before it.

    Breadth-first by increasing value: at step v every open interval is split by its rows' byte v, and
    the borders that this makes have common prefix v. Intervals of one row are done; what is still
    together at MIN_BYTES shares as much. The first of a group has -1. Rows come by group.
    """
    order = np.arange(len(group))
    common = np.full(len(group), MIN_BYTES)
    common[:1] = -1
    common[1:][group[1:] != group[:-1]] = -1
    at, interval = order, group.astype(np.int64)
    for v in range(K, MIN_BYTES):  # the anchor's own bytes are shared by all
        alone = np.bincount(interval)[interval] < 2
        at, interval = at[~alone], interval[~alone]
        if not len(at):
            break
        rows = order[at]
        key = interval * 257 + np.where(right[rows] > v, suffix[rows, v].astype(np.int64) + 1, 0)  # an end comes before all bytes
        by = np.argsort(key, kind="stable")
        key, order[at] = key[by], rows[by]
        edge = (key[1:] != key[:-1]) | (key[1:] % 257 == 0)
        inside = key[1:] // 257 == key[:-1] // 257
        common[at[1:][edge & inside]] = v
        interval = np.concatenate([[0], np.cumsum(edge | ~inside)])
    return order, common


def expanded(group: np.ndarray, left: np.ndarray, right: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the least and the greatest l of its repeated strings (which start l bytes before the anchor); -1: none.

    Rows come by anchor (group), then in order of their places. left, right: bytes before and from the anchor.
    """
    n = len(group)
    lo, hi = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    middle = offsets[:-1] + left
    take = lambda at, ok: np.where(ok, data[np.clip(at, 0, len(data) - 1)], 0)
    suffix = take(middle[:, None] + np.arange(MIN_BYTES), np.arange(MIN_BYTES) < right[:, None]).astype(np.uint8)
    order, common = common_prefixes(group, suffix, right)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = take(middle[:, None] - 1 - np.arange(LEFT), np.arange(LEFT) < left[:, None]).astype(np.uint8)  # the transform's columns
    rows, interval = order, group[order].astype(np.int64)
    for depth in range(LEFT + 1):
        need = MIN_BYTES - depth
        fits = (right[rows] >= need) & (left[rows] >= depth)
        r, iv = rows[fits], interval[fits]
        if len(r) > 1:
            prefix_class = np.cumsum(common < need)[place[r]]
            new = np.concatenate([[True], (iv[1:] != iv[:-1]) | (prefix_class[1:] != prefix_class[:-1])])
            starts = np.flatnonzero(new)
            first = np.minimum.reduceat(r, starts)
            again = r[r != first[np.cumsum(new) - 1]]
            lo[again] = np.where(lo[again] < 0, depth, lo[again])
            hi[again] = depth
        if depth == LEFT:
            break
        grows = left[rows] > depth
        rows, interval = rows[grows], interval[grows]
        if len(rows) < 2:
            break
        key = interval * 256 + before[rows, depth]
        by = np.argsort(key, kind="stable")
        rows, key = rows[by], key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        interval = np.cumsum(new) - 1
        alone = np.bincount(interval)[interval] < 2
        rows, interval = rows[~alone], interval[~alone]
        if len(rows) < 2:
            break
    return lo, hi


def repeats(around: DataFrame) -> DataFrame:
    """doc_id, start, end of repeated strings found by backward extension, one run a row at most."""
    cols = ("anchor", "doc_id", "place")

    def settle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        anchor, doc, place = (t.column(c).to_numpy() for c in cols)
        data, offsets = joined_bytes(t.column("bytes"))
        pos, left, right = place >> 16, place >> 8 & 255, place & 255
        group = np.concatenate([[0], np.cumsum(anchor[1:] != anchor[:-1])])
        lo, hi = expanded(group, left, right, data, offsets)
        hit = hi >= 0
        return pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(pos[hit] - hi[hit]), pa.array(pos[hit] - lo[hit] + MIN_BYTES)], ["doc_id", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if rows >= BLOCK_ROWS:
                anchor = batch.column("anchor").to_numpy()
                last = held[-1].column("anchor")[-1].as_py()
                cut = int(np.searchsorted(anchor != last, True)) if anchor[0] == last and (anchor != last).any() else (len(anchor) if anchor[0] == last else 0)
                if cut < len(anchor):
                    yield settle([*held, batch.slice(0, cut)])
                    held, rows, batch = [], 0, batch.slice(cut)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield settle(held)

    ordered = around.repartition("anchor").sortWithinPartitions(*cols)
    return ordered.mapInArrow(tidy(run), "doc_id long, start long, end long")


def window_hashes(anchor: np.ndarray, left: np.ndarray, right: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, l, hash) of every MIN_BYTES string that holds a row's anchor and starts l bytes before it."""
    low, high = np.maximum(0, MIN_BYTES - right), np.minimum(left, LEFT)
    n = np.maximum(0, high - low + 1)
    row = np.repeat(np.arange(len(n)), n)
    depth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + low[row]
    start = offsets[:-1][row] + left[row] - depth
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_HASH[data] * up[: len(data)], dtype=np.uint64)])
        h = (prefix[start + MIN_BYTES] - prefix[start]) * down[start]
        return row, depth, _mixed(h ^ _mixed(anchor[row].view(np.uint64) + depth.astype(np.uint64)))


def frequent_repeats(around: DataFrame) -> DataFrame:
    """doc_id, start, end of repeated strings of hot anchors, whose rows may be a large part of all.

    Every string of MIN_BYTES bytes goes by its hash, so an anchor's rows are spread over tasks. Equal
    strings of one slice are settled before the shuffle: a string of any frequency leaves a slice once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch, "bytes", ANCHOR_BYTES):
                part = batch.slice(i, j - i)
                anchor, doc, place = (part.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "doc_id", "place"))
                data, offsets = joined_bytes(part.column("bytes"))
                row, depth, key = window_hashes(anchor, place >> 8 & 255, place & 255, data, offsets)
                doc, start = doc[row], (place >> 16)[row] - depth
                again = repeated_here(np.zeros(len(key), np.uint8), key, doc, start)
                # a row's repeats overlap in its anchor, so they are one run
                hit, lo, hi = row[again], np.full(len(part), MIN_BYTES), np.full(len(part), -1)
                np.minimum.at(lo, hit, depth[again])
                np.maximum.at(hi, hit, depth[again])
                met = np.flatnonzero(hi >= 0)
                first = ~again
                key = pa.array(np.concatenate([key[first].view(np.int64), np.zeros(len(met), np.int64)]), mask=np.arange(int(first.sum()) + len(met)) >= int(first.sum()))
                docs = part.column("doc_id").take(pa.array(np.concatenate([row[first], met])))
                a = np.concatenate([start[first], (place >> 16)[met] - hi[met]])
                b = np.concatenate([start[first] + MIN_BYTES, (place >> 16)[met] - lo[met] + MIN_BYTES])
                yield pa.RecordBatch.from_arrays([key, docs, pa.array(a), pa.array(b)], ["key", "doc_id", "start", "end"])

    rows = staged(around.mapInArrow(tidy(run), "key long, doc_id long, start long, end long"), "windows")
    keyed = rows.where("key is not null")
    # the smallest place of each key is summed up before the shuffle; joins of skewed keys are split
    first = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = keyed.join(first, "key").where(F.struct("doc_id", "start") != F.col("first"))
    return rows.where("key is null").drop("key").unionByName(again.select("doc_id", "start", "end"))


def compared_bytes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, start, end of the repeats among rows (doc_id, place, anchor, classes) whose surroundings differ."""
    usual = repeats(surroundings(docs, rows.where(F.col("classes") <= HOT_ROWS)))
    hot = rows.where(F.col("classes") > HOT_ROWS)
    return usual if hot.isEmpty() else usual.unionByName(frequent_repeats(surroundings(docs, hot)))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans ARRAY<LONG> (start << 16 | length): what to remove, not yet merged. doc_id is a key here."""
    found = staged(settled(anchor_table(docs)), "anchors")
    compared = staged(compared_bytes(docs, staged(contested(found), "contested")), "repeats")
    whole = found.where("anchor is null").select("doc_id", (F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(255)).alias("start"), (F.shiftright("place", 16) + F.col("place").bitwiseAND(255)).alias("end"))
    both = whole.unionByName(compared).select("doc_id", F.shiftleft("start", 16).bitwiseOR(F.col("end") - F.col("start")).alias("span"))
    return both.groupBy("doc_id").agg(F.collect_list("span").alias("spans"))


def merged(packed: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs covered by packed spans."""
    if not len(packed):
        return []
    packed = np.sort(packed)
    start, end = packed >> 16, (packed >> 16) + (packed & 0xFFFF)
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    return list(zip(start[first].tolist(), reach[np.append(first[1:] - 1, len(reach) - 1)].tolist()))


def _cut(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without characters of which they hold a part only."""
    out = []
    for a, b in runs:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with what to remove from each, and that column's name."""
    docs, key = numbered(docs)
    name = free_name(docs, "spans")
    found = spans(docs.select(F.col(key).alias("doc_id"), "text")).select(F.col("doc_id").alias(key), F.col("spans").alias(name))
    return docs.join(found, key, "left").drop(key), name


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            out = []
            for k, text in enumerate(batch.column("text")):
                raw = (text.as_py() or "").encode("utf-8")
                runs = merged(lists[k].values.to_numpy()) if lists[k].is_valid else []
                out.append((len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_cut(raw, runs)).hexdigest()))
            n, removed, count, sha = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    both, name = _with_spans(docs.select("doc_id", "text"))
    return both.select("doc_id", "text", F.col(name).alias("spans")).mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@F.arrow_udf(StringType())
def _shortened(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in batches:
        out = []
        for k, text in enumerate(texts):
            text = text.as_py()
            if text and spans[k].is_valid:
                raw = text.encode("utf-8")
                text = _cut(raw, whole_characters(raw, merged(spans[k].values.to_numpy()))).decode("utf-8")
            out.append(text)
        yield pa.array(out, pa.string())
    trimmed()


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with their columns, texts without repeats (characters are removed whole or not at all)."""
    both, name = _with_spans(docs)
    return both.withColumn("text", _shortened("text", name)).select(*docs.columns)
