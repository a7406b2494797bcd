"""Language-model scores of whole texts, with exact word counts as a base line.

Learning rows are those that fold() leaves in. One pass over them counts all words and writes all
windows of WINDOW_WORDS words as subword ids. Counts of ids, and of pairs of neighbours, cover all
windows; the attention model then learns from every window once, in one of ROUNDS rounds.

A window belongs to a learner by a hash of its document and place, and a learner takes its windows
in the order of that hash, so the model is a function of the table's rows and not of how they are
dealt over files and tasks. Learners hold about LEARNER_WINDOWS windows and grow in number with the
input. All start from the same weights; after a round their weights are averaged as whole numbers,
in which the order of adding does not count.

Words that are frequent in the learning rows (at most FREQUENT of them, a fixed size for the
broadcast) are looked up while texts are scored; all rarer words are counted exactly by a join.
Words are told apart by their 64-bit hash.

A null text counts as empty and has its end token alone. Texts of any length are scored whole.
An empty table gives no rows; without learning rows all counts are 0 and the model is as it
starts. Only doc_id and text are read, so other columns can't clash. Repeated rows count each time; a row without doc_id is a
learning row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import attention, bpe
from siftwell.llm.common import LOWER_AZ, fold, joined_bytes, kept, slices, staged

FREQUENT = 1 << 17
WINDOW_WORDS = 32
#: Averages of weights; each window is learned from in one of them.
ROUNDS = 2
RATE = 0.04
#: Windows that a learner has in a round, about; and those of one step.
LEARNER_WINDOWS, STEP_WINDOWS = 1 << 15, 64
#: Steps that a learner makes at least in a round; one of few windows goes over them again.
LEAST_STEPS = 400
#: Weights are summed as whole numbers of this part.
GRAIN = 2.0**-32
#: Distinct words that a worker keeps what it knows of; a store beyond it is filled anew.
STORED = 700_000
#: Frequent ids that are grouped by their neighbours; rarer ones by a rule.
GROUPED = 4096
NEIGHBOURS = 96
FOLDS, HELD_OUT = 5, 1
#: 1 for bytes of words, 0 for those between them.
INSIDE = bytes(c != 32 and not 9 <= c <= 13 for c in range(256))
#: Kinds of bytes in pre-tokens: letters, numerals, others; 3 where a pattern decides.
KIND = np.array([0 if 97 <= c <= 122 or 65 <= c <= 90 else 1 if 48 <= c <= 57 else 3 if c >= 128 or c == 39 else 2 for c in range(256)], np.uint8)
#: The first 0 to 8 of eight bytes.
LEADING = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of words that are hashed together; longer ones by themselves.
LONG_WORD = 64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(LOWER_AZ).split()


def words_in(col: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """words_of() for all texts at once: lower-cased bytes, each word's place and bytes there, each text's words."""
    raw, offsets = joined_bytes(col)
    text = raw.tobytes().translate(LOWER_AZ)
    inside = np.frombuffer(text.translate(INSIDE), bool)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = offsets[offsets < len(text)]
    first[at] = inside[at]
    at = offsets[offsets > 0] - 1
    last[at] = inside[at]
    start = np.flatnonzero(first)
    return text, start, np.flatnonzero(last) + 1 - start, np.diff(np.searchsorted(start, offsets))


def hashed(text: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes a step; never 0."""
    eight = np.ndarray((len(text),), "<u8", text + bytes(8), 0, (1,))
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    part, left, live = start, size, slice(None)
    with np.errstate(over="ignore"):
        while len(part):
            here = eight[part] & LEADING.take(np.minimum(left, 8))
            out[live] = mixed(out[live] ^ here)
            more = np.flatnonzero((left > 8) & (left <= LONG_WORD))
            part, left = part[more] + 8, left[more] - 8
            live = more if isinstance(live, slice) else live[more]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(text[start[k] : start[k] + size[k]])
    out[out == 0] = 1
    return out


def gathered(train: DataFrame, vocabulary, begin: int, end: int, kind: str = "<u4") -> DataFrame:
    """All that is learned from, in one pass: rows of windows and rows of word counts.

    A window: at (a hash of its document and place) and ids (of that kind of number), with the document's
    begin or end where it touches it. A count: word (its hash) and n, in parts to be summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = store_of(vocabulary.value, np.zeros(0, np.uint64), np.zeros(0))
        h = xxhash.xxh64_intdigest
        seen = np.zeros(0, np.int64)
        names = ["at", "ids", "word", "n"]

        def counted() -> pa.RecordBatch:
            code = np.flatnonzero(seen)
            none = pa.nulls(len(code), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.nulls(len(code), pa.binary()), pa.array(store.key[code].view(np.int64)), pa.array(seen[code])], names)

        for batch in batches:
            for i, j in slices(batch, "text"):
                part = batch.slice(i, j - i)
                *words, size = words_in(part.column("text"))
                if store.full():
                    yield counted()
                    store.reset()
                    seen = np.zeros(0, np.int64)
                code = store.codes_in(*words)
                seen = np.concatenate([seen, np.zeros(len(store.key) - len(seen), np.int64)]) + np.bincount(code, minlength=len(store.key))
                ids, per_word = store.ids(code)
                upto = np.concatenate([[0], np.cumsum(per_word)])
                last = np.cumsum(size)
                first = last - size
                n = np.maximum(1, -(-size // WINDOW_WORDS))
                doc = np.repeat(np.arange(len(size)), n)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                cut = np.concatenate([upto[first[doc] + k * WINDOW_WORDS], upto[-1:]])
                ends = np.concatenate([[0], np.cumsum(np.diff(cut) + (k == 0) + (k == n[doc] - 1))])
                flat = np.insert(ids, np.stack([upto[first], upto[last]], axis=1).ravel(), np.tile([begin, end], len(size)))
                at = np.array([h(str(d)) for d in part.column("doc_id").to_pylist()], np.uint64)[doc]
                with np.errstate(over="ignore"):
                    at = mixed(at + np.uint64(0x9E3779B97F4A7C15) * k.astype(np.uint64))
                raw = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.dtype(kind).itemsize * ends).astype(np.int32)), pa.py_buffer(flat.astype(kind))])
                none = pa.nulls(len(at), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), raw, none, none], names)
        if seen.any():
            yield counted()

    return train.select("doc_id", "text").mapInArrow(run, "at long, ids binary, word long, n long")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat_ids(batch: pa.RecordBatch, kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """The ids of all windows, and the n + 1 offsets."""
    raw, at = joined_bytes(batch.column("ids"))
    return np.ascontiguousarray(raw).view(kind).astype(np.int64), at // np.dtype(kind).itemsize


def tallied(seen: DataFrame, kind: str, cells: int, cells_of) -> np.ndarray:
    """How often each of a fixed number of cells occurs: cells_of gives those of some ids and offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, np.int64)
        for batch in batches:
            n += np.bincount(cells_of(*flat_ids(batch, kind)), minlength=cells)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

    t = seen.select("ids").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[t.column("cell").to_numpy()] = t.column("n").to_numpy()
    return out


def neighbours(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids that follow each other in a window."""
    inside = np.ones(max(0, len(ids) - 1), bool)
    inside[offsets[(offsets > 0) & (offsets < len(ids))] - 1] = False
    return ids[:-1][inside], ids[1:][inside]


def vocabulary_of(seen: DataFrame, kind: str, size: int) -> attention.Vocabulary:
    """Classes and counted pairs from all windows: ids of like neighbours share a class.

    At most `size` counts and two fixed tables of pairs reach the driver.
    """
    counts = tallied(seen, kind, size, lambda ids, _: ids)
    order = np.argsort(-counts, kind="stable")
    listed = order[:GROUPED]
    place, near = np.full(size, -1), np.full(size, -1)
    place[listed] = np.arange(len(listed))
    near[order[:NEIGHBOURS]] = np.arange(min(NEIGHBOURS, size))

    def beside(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        a, b = neighbours(ids, offsets)
        cells = []
        for x, y, side in ((a, b, 0), (b, a, NEIGHBOURS)):
            y = near.take(y)
            met = np.flatnonzero(y >= 0)
            x, y = place.take(x.take(met)), y.take(met)
            cells.append((x * 2 * NEIGHBOURS + side + y)[x >= 0])
        return np.concatenate(cells)

    table = tallied(seen, kind, GROUPED * 2 * NEIGHBOURS, beside).reshape(GROUPED, 2 * NEIGHBOURS).astype(np.float64)
    x = np.sqrt((table + 0.05) / (table + 0.05).sum(axis=1, keepdims=True))
    rng = np.random.default_rng(3)
    use = np.flatnonzero(counts[listed] > 0)
    group = np.arange(size) % attention.GROUPS
    if len(use) > attention.GROUPS:
        x, weight = x[use], np.sqrt(counts[listed][use].astype(np.float64))
        centre = x[rng.choice(len(x), attention.GROUPS, replace=False)]
        for _ in range(12):
            own = np.argmax(x @ centre.T - 0.5 * (centre**2).sum(axis=1), axis=1)
            for k in range(attention.GROUPS):
                if (own == k).any():
                    centre[k] = np.average(x[own == k], axis=0, weights=weight[own == k])
        group[listed[use]] = own
    vocab = attention.Vocabulary(counts, group)
    slot, cell = vocab.slot, vocab.cell
    slots, cells = attention.INPUTS + attention.GROUPS, attention.GROUPS * attention.LEAVES

    def following(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        a, b = neighbours(ids, offsets)
        return slot.take(a) * cells + cell.take(b)

    vocab.follow(tallied(seen, kind, slots * cells, following).reshape(slots, cells))
    return vocab


def fitted(seen: DataFrame, kind: str, vocab: attention.Vocabulary) -> dict[str, np.ndarray]:
    """Weights averaged over learners that each learn from their own windows. The driver gets one row a weight."""
    sc = seen.sparkSession.sparkContext
    now = attention.fresh(vocab)
    turn = F.pmod(F.shiftright("at", 48), F.lit(ROUNDS))
    for r in range(ROUNDS):
        rows = seen.where(turn == r)
        learners = max(1, round(rows.count() / LEARNER_WINDOWS))
        start = sc.broadcast((now, vocab))
        rate = RATE / (r + 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, v = start.value
            total, done = np.zeros(len(attention.packed(p)), np.int64), 0
            held: list[np.ndarray] = []
            mine = None

            def learn() -> None:
                nonlocal total, done
                if held:
                    w, _ = attention.trained(p, v, held, rate, STEP_WINDOWS, LEAST_STEPS)
                    total += np.rint(attention.packed(w).astype(np.float64) / GRAIN).astype(np.int64)
                    done += 1
                    held.clear()

            for batch in batches:
                ids, at = flat_ids(batch, kind)
                ids = ids.astype(kind)
                for k, a, b in zip(batch.column("learner").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    if k != mine:
                        learn()
                        mine = k
                    if b - a > 1:
                        held.append(ids[a:b])
            learn()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array(np.full(len(total), done))], ["k", "w", "n"])

        dealt = rows.select(F.pmod("at", F.lit(learners)).cast("int").alias("learner"), "at", "ids")
        ordered = dealt.repartitionById(learners, "learner").sortWithinPartitions("learner", "at", "ids")
        sums = ordered.mapInArrow(run, "k int, w long, n long").groupBy("k").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()
        if not sums:
            continue
        flat = np.zeros(len(attention.packed(now)), np.float64)
        for k, w, n in sums:
            flat[k] = w * GRAIN / n
        now = attention.unpacked(flat, now)
    return now


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the most frequent words: as many whole count levels as stay within `most`."""
    level = F.when(F.col("n") < 2000, F.col("n")).otherwise(F.lit(2000) + F.floor(F.log(F.col("n").cast("double")) * 50)).cast("long")
    least, total = None, 0
    for at, n in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if total + n > most:
            break
        least, total = at, total + n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = counts.where(level >= least).select("word", "n").toArrow()
    word, n = t.column("word").to_numpy().view(np.uint64), t.column("n").to_numpy()
    order = np.argsort(word)
    return word[order], n[order]


class WordStore:
    """What a worker knows of each word: its hash, log10 of its count plus 0.5 if frequent, and its subword ids.

    Ids are the vocabulary's greedy longest matches in the word's pre-tokens, or in the whole word
    where pre-tokens leave out a part of it. STORED words are kept; they are found by hashed() in an
    open table, of which at most half is in use.
    """

    COLUMNS = {"mark": np.uint64, "key": np.uint64, "logs": np.float64, "hit": bool, "start": np.int64, "length": np.int32, "flat": np.int32}

    def __init__(self, enc: bpe.SpeculativeBPE, known: np.ndarray, value: np.ndarray):
        self.enc, self.greedy, self.known, self.value = enc, bpe.Greedy(enc), known, value
        pattern = bpe.word_pattern().pattern
        self.parts = re.compile(f"{pattern}|.", re.DOTALL).findall
        self.left_out = np.array([c for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not enc.find(chr(c))])
        self.reset()

    def reset(self) -> None:
        self.room: dict[str, np.ndarray] = {}
        for name, kind in self.COLUMNS.items():
            self.room[name] = np.zeros(0, kind)
            setattr(self, name, self.room[name])
        self._open(16)

    def rated(self, known: np.ndarray, value: np.ndarray) -> None:
        """Another table of frequent words; subword ids do not depend on it."""
        if not (np.array_equal(known, self.known) and np.array_equal(value, self.value)):
            self.known, self.value = known, value
            self.logs[:], self.hit[:] = self._rates(self.key)

    def _rates(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.zeros(len(key)), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
        hit = self.known[at] == key
        return np.where(hit, self.value[at], 0.0), hit

    def full(self) -> bool:
        return len(self.key) > STORED

    def _open(self, bits: int) -> None:
        self.bits, self.marks, self.code = bits, np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _find(self, mark: np.ndarray) -> np.ndarray:
        at = (mark >> np.uint64(64 - self.bits)).astype(np.int64)
        met = self.marks.take(at)
        out = np.where(met == mark, self.code.take(at), -1)
        live = np.flatnonzero((met != mark) & (met != 0))
        while len(live):
            at[live] = at[live] + 1 & len(self.marks) - 1
            here = at.take(live)
            met, own = self.marks.take(here), mark.take(live)
            same = met == own
            out[live[same]] = self.code.take(here[same])
            live = live[~same & (met != 0)]
        return out

    def _enter(self, mark: np.ndarray, code: np.ndarray) -> None:
        at = (mark >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(mark):
            free = self.marks.take(at) == 0
            self.marks[at[free]] = mark[free]
            won = self.marks.take(at) == mark
            self.code[at[won]] = code[won]
            mark, code, at = mark[~won], code[~won], at[~won] + 1 & len(self.marks) - 1

    def _begins(self, words: list[bytes], raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where pieces begin in the words' joined bytes, of which each piece is a part."""
        kind = KIND.take(raw)
        begins = kind == 1
        begins[1:] |= kind[1:] != kind[:-1]
        hard = np.maximum.reduceat(kind, first) == 3
        begins &= ~np.repeat(hard, size)
        begins[first] = True
        hard = np.flatnonzero(hard)
        if not len(hard):
            return begins
        # all by the pattern at once, with a line end between words; it takes what pre-tokens leave out as single characters
        text = b"\n".join([words[k] for k in hard.tolist()]).decode("utf-8", "surrogateescape")
        parts = self.parts(text)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        width = 1 + (chars >= 0x80) + (chars >= 0x800) + (chars >= 0x10000)
        width[(chars >= 0xDC80) & (chars <= 0xDCFF)] = 1  # bytes that are no UTF-8
        at = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        at = np.concatenate([[0], at[:-1]])
        own = chars.take(at)
        word = np.cumsum(own == 10)
        left_out = np.isin(own, self.left_out)
        whole = np.zeros(len(hard), bool)
        whole[word[left_out & (own != 10)]] = True
        place = (np.cumsum(width) - width).take(at)
        begin = np.cumsum(size[hard] + 1) - size[hard] - 1
        good = ~left_out & ~whole[word]
        begins[(place - begin[word] + first[hard][word])[good]] = True
        return begins

    def _learn(self, text: bytes, start: np.ndarray, size: np.ndarray, mark: np.ndarray) -> None:
        words = [text[a:b] for a, b in zip(start.tolist(), (start + size).tolist())]
        key = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        first = np.cumsum(size) - size
        begins = self._begins(words, raw, first, size)
        at = np.flatnonzero(begins)
        ids, per_piece = self.greedy.walked(raw, np.diff(at, append=len(raw)))
        length = np.add.reduceat(per_piece, np.searchsorted(at, first)).astype(np.int32)
        start = len(self.flat) + np.cumsum(length, dtype=np.int64) - length
        for name, x in zip(self.COLUMNS, (mark, key, *self._rates(key), start, length, ids)):
            n, room = len(getattr(self, name)), self.room[name]
            if n + len(x) > len(room):
                self.room[name] = np.empty(n + len(x) + (n >> 1), room.dtype)
                self.room[name][:n] = room[:n]
            self.room[name][n : n + len(x)] = x
            setattr(self, name, self.room[name][: n + len(x)])
        bits = max(self.bits, (2 * len(self.mark) - 1).bit_length())
        if bits > self.bits:
            self._open(bits)
            self._enter(self.mark, np.arange(len(self.mark)))
        else:
            self._enter(mark, np.arange(len(self.mark) - len(mark), len(self.mark)))

    def codes_in(self, text: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """A code for each word of a text, for as long as the store is not reset."""
        mark = hashed(text, start, size)
        codes = self._find(mark)
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            new, at = np.unique(mark[missing], return_index=True)
            at = missing[at]
            self._learn(text, start[at], size[at], new)
            codes[missing] = self._find(mark[missing])
        return codes

    def codes(self, words: list[bytes]) -> np.ndarray:
        size = np.fromiter(map(len, words), np.int64, len(words))
        return self.codes_in(b"".join(words), np.cumsum(size) - size, size)

    def ids(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All subword ids, and the number of ids of each word."""
        n = self.length.take(code).astype(np.int64)
        ends = np.cumsum(n)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.start.take(code) - (ends - n), n)
        return self.flat.take(at).astype(np.int64), n


def with_ends(ids: np.ndarray, per_word: np.ndarray, words: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets and lengths of texts: a begin before and an end after each text's ids."""
    upto = np.concatenate([[0], np.cumsum(per_word)])
    off = upto[np.concatenate([[0], np.cumsum(words)])]
    return np.insert(ids, off[:-1], begin), np.insert(ids, off[1:], end), np.diff(off) + 1


def store_of(blob: bytes, known: np.ndarray, value: np.ndarray) -> WordStore:
    """One store a worker process for each vocabulary, with this table of frequent words."""
    store = kept(("words", hash(blob)), lambda: WordStore(bpe.SpeculativeBPE(blob), known, value))
    store.rated(known, value)
    return store


def scored(docs: DataFrame, path: str, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select("doc_id", "text")
    train = docs.where(F.coalesce(fold("doc_id", FOLDS), F.lit(0)) != HELD_OUT)
    blob = bpe.vocabulary(docs, path)
    size = bpe.SpeculativeBPE(blob.value).size
    begin, end = size, size + 1
    kind = "<u2" if end < 1 << 16 else "<u4"
    both = staged(gathered(train, blob, begin, end, kind), "gathered")
    seen = both.where("at is not null").select("at", "ids")
    counts = staged(both.where("at is null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    n_docs = train.count()
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = n_words + n_docs, distinct + (n_docs > 0)
    floor = math.log10(total + 0.5 * (kinds + 1))
    vocab = vocabulary_of(seen, kind, end + 1)
    model = sc.broadcast((fitted(seen, kind, vocab), vocab, *frequent_words(counts, frequent)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, v, known, known_n = model.value
        words = store_of(blob.value, known, np.log10(known_n + 0.5))
        scorer = attention.Scorer(p, v)
        for batch in batches:
            for i, j in slices(batch, "text"):
                part = batch.slice(i, j - i)
                *found, size = words_in(part.column("text"))
                n = len(size)
                if words.full():
                    words.reset()
                code = words.codes_in(*found)
                logs, hit = words.logs.take(code), words.hit.take(code)
                doc = np.repeat(np.arange(n), size)
                base = np.bincount(doc, weights=logs, minlength=n) - floor * (size + 1) + math.log10(n_docs + 0.5)
                n_known = np.bincount(doc, weights=hit, minlength=n).astype(np.int64) + (n_docs > 0)
                rare = ~hit
                ends = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=n))])
                rare_words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words.key[code[rare]].view(np.int64)))
                inputs, targets, lengths = with_ends(*words.ids(code), size, begin, end)
                lp = scorer.log_probs(inputs, targets, lengths)
                score = np.bincount(np.repeat(np.arange(n), lengths), weights=lp, minlength=n) / math.log(10)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size + 1), pa.array(n_known), pa.array(base), pa.array(score), rare_words], ["doc_id", "n_tokens", "n_known", "base", "score", "rare"])

    rows = staged(docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, score double, rare array<long>").withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = rows.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    sums = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.count("n").alias("found"))
    out = rows.drop("rare").join(sums, "row", "left")
    return out.select(
        "doc_id",
        (F.coalesce(fold("doc_id", FOLDS), F.lit(0)) == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
