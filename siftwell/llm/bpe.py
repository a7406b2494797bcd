"""BPE encoding by speculation and verification, and decoding.

A word's greedy longest-match split is the exact BPE result if every token is what BPE makes
of its own text and every adjacent pair is compatible: no merge across the border would have
happened before the merges that built the two neighbours. Both checks look only at the merge
tree, so all pairs of a batch are tested at once with numpy. Words that fail are merged exactly.

Nulls count as empty texts. Empty texts give no ids. Texts of any length are encoded whole.
Strings of the two special tokens in a text become those tokens, as in the tokenizers library.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftwell.llm.common import kept, slices, tidy, trimmed

#: Distinct words and pre-tokens that a worker keeps (about 200 bytes each); a store beyond it is emptied and filled anew.
WORD_STORE = 1_200_000
#: New words of one batch that leave much memory free behind them.
MANY = 5_000
#: New words that are split at once.
LEARNED = 1 << 16
_NEVER = 1 << 40


def _ranges(test) -> str:
    out, start = [], None
    for c in range(sys.maxunicode + 2):
        hit = c <= sys.maxunicode and not 0xD800 <= c <= 0xDFFF and test(chr(c))
        if hit and start is None:
            start = c
        elif not hit and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def word_pattern() -> re.Pattern:
    """Runs of letters, single numerals, English clitics, runs of anything else but white space."""
    letters = _ranges(lambda c: unicodedata.category(c)[0] == "L")
    numerals = _ranges(lambda c: unicodedata.category(c)[0] == "N")
    space = r"\x09-\x0d\x20\x85\xa0  -     　"
    return re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numerals}]|[^{space}{letters}{numerals}]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(odd)) for b in range(256)]


class SpeculativeBPE:
    """Encoder and decoder for a word-level BPE file of the tokenizers library (word ends marked)."""

    def __init__(self, blob: bytes, most: int = WORD_STORE):
        self.most = most
        spec = json.loads(blob)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.text = [""] * self.size
        for k, v in vocab.items():
            self.text[v] = k
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for k, v in self.special.items():
            self.text[v] = k
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letter = byte_letters()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        #: The merge that builds each token (-1: a single symbol) and its two parts.
        self.rank = np.full(self.size, -1, np.int64)
        self.rank[made[::-1]] = np.arange(len(merges))[::-1]
        self.left, self.right = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        self.left[made[::-1]], self.right[made[::-1]] = left[::-1], right[::-1]
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order
        self.rank_of = dict(zip(zip(left.tolist(), right.tolist()), range(len(merges))))
        self.made = made.tolist()
        self._index_tokens(vocab)
        self.sound = self._sound_tokens(left, right, made)
        self.find = word_pattern().findall
        self.reset()

    def _index_tokens(self, vocab: dict[str, int]) -> None:
        """Raw bytes to id, separately for tokens that end a word and tokens that don't."""
        back = {c: b for b, c in enumerate(self.letter)}
        self.inner, self.final = {}, {}
        for k, v in vocab.items():
            ends = bool(self.suffix) and k.endswith(self.suffix)
            body = k[: len(k) - len(self.suffix)] if ends else k
            if all(c in back for c in body):
                (self.final if ends or not self.suffix else self.inner)[bytes(back[c] for c in body)] = v
        if not self.suffix:
            self.inner = self.final
        self.longest = max([1, *map(len, self.inner), *map(len, self.final)])
        #: The longest token that does not end a word, by its first two bytes.
        self.reach: dict[bytes, int] = {}
        for t in self.inner:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))

    def _sound_tokens(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Whether BPE turns a token's own text into that token."""
        sound = np.ones(self.size, bool)
        fine = self.compatible(left, right, below=self.rank[made])
        for a, b, m, ok in zip(left.tolist(), right.tolist(), made.tolist(), fine.tolist()):
            sound[m] = ok and sound[a] and sound[b]
        return sound

    def cross_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge joins the border of each pair before both sides are complete.

        Walks back through the two merge trees along the border, undoing the later merge first; at
        each state a merge across the border must not precede the merge that consumes either side.
        On equal ranks the leftmost merge goes first. below: ranks up to which the pair must stay apart.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        ok = np.ones(len(a), bool)
        eats_a = np.full(len(a), _NEVER) if below is None else below.copy()
        eats_b = eats_a - (below is not None)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            r = self.cross_rank(x, y)
            bad = (r < _NEVER) & (r < eats_a[live]) & (r <= eats_b[live])
            ok[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
            first = rx > ry
            u = live[first]
            eats_a[u] = rx[first]
            a[u] = self.right[x[first]]
            v = live[~first]
            eats_b[v] = ry[~first]
            b[v] = self.left[y[~first]]
        return ok

    def merged(self, word: bytes) -> list[int]:
        """Exact merging of one word: the lowest rank first, leftmost on ties."""
        ids = [self.inner[word[i : i + 1]] for i in range(len(word) - 1)] + [self.final[word[-1:]]]
        if len(ids) > 256:
            return self._merged_long(ids)
        rank, made = self.rank_of.get, self.made
        ranks = [rank(p, _NEVER) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            ids[i : i + 2] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), _NEVER)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, for very long words."""
        import heapq

        n = len(ids)
        after, before, gone = [*range(1, n), -1], [*range(-1, n - 1)], [False] * n
        heap = [(self.rank_of[p], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank_of]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], gone[j] = self.made[self.rank_of[pair]], True
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for s in (before[i], i):
                if s >= 0 and after[s] >= 0 and (p := (ids[s], ids[after[s]])) in self.rank_of:
                    heapq.heappush(heap, (self.rank_of[p], s, p))
        return [t for t, g in zip(ids, gone) if not g]

    def proposed(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        inner, final, reach, out, i, n = self.inner, self.final, self.reach.get, [], 0, len(word)
        while i < n:
            if n - i <= self.longest and (t := final.get(word[i:])) is not None:
                out.append(t)
                break
            for j in range(min(n - 1, i + reach(word[i : i + 2], 1)), i, -1):
                if (t := inner.get(word[i:j])) is not None:
                    out.append(t)
                    i = j
                    break
        return out

    def split_words(self, words: list[str]) -> list[list[int]]:
        """The ids of distinct words: speculate, verify all pairs at once, merge only what fails."""
        raw = [w.encode("utf-8") for w in words]
        ids = [self.proposed(w) for w in raw]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for x in ids for t in x), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(ids)), n)
        inside = owner[1:] == owner[:-1]
        key, where = np.unique(flat[:-1][inside] * self.size + flat[1:][inside], return_inverse=True)
        fits = self.compatible(key // self.size, key % self.size)[where]
        failed = np.zeros(len(ids), bool)
        failed[owner[1:][inside][~fits]] = True
        failed[owner[~self.sound[flat]]] = True
        for k in np.flatnonzero(failed).tolist():
            ids[k] = self.merged(raw[k])
        return ids

    def reset(self) -> None:
        self.codes: dict[str | int, int] = {}
        self.count = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = 0

    def _parts(self, word: str) -> list[str]:
        """The pre-tokens of a word; the usual ones are told without the pattern."""
        if word.isascii():
            if word.isalpha():
                return [word]
            if word[:-1].isalpha() and word[-1] in ".,;:!?":
                return [word[:-1], word[-1]]
        return self.find(word)

    def split_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words as one array, and the number of ids of each."""
        ids = self.split_words(words)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n

    def _learn(self, words: list[str | int]) -> None:
        """Store the ids of words as they stand between white space; an int is a special token's id.

        Pre-tokens are words of other texts: they are stored as such, and other words are put together from them.
        """
        special = [w for w in words if isinstance(w, int)]
        self._store(special, np.array(special, np.uint32), np.ones(len(special), np.int64))
        words = [w for w in words if not isinstance(w, int)]
        parts = list(map(self._parts, words))
        new = [p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in self.codes]
        for a in range(0, len(new), LEARNED):
            part = new[a : a + LEARNED]
            self._store(part, *self.split_flat(part))
        rest = [(w, ps) for w, ps in zip(words, parts) if len(ps) != 1 or ps[0] != w]
        size = np.fromiter((len(ps) for _, ps in rest), np.int64, len(rest))
        of = np.fromiter((self.codes[p] for _, ps in rest for p in ps), np.int64, int(size.sum()))
        ids, n = self.ids_of(of)
        self._store([w for w, _ in rest], ids, np.diff(np.concatenate([[0], np.cumsum(n)])[np.cumsum(size)], prepend=0))

    def _store(self, words: list[str | int], ids: np.ndarray, lens: np.ndarray) -> None:
        n, k = len(ids), self.count
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while k + len(words) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.flat[self.used : self.used + n] = ids
        self.length[k : k + len(words)] = lens
        self.start[k : k + len(words)] = self.used + np.cumsum(lens) - lens
        self.used += n
        self.codes.update(zip(words, range(k, k + len(words))))
        self.count += len(words)

    def words(self, text: str) -> list[str | int]:
        """Normalised words between white space; strings of special tokens become their ids."""
        if self.special_pattern is not None and "<|" in text:
            parts = self.special_pattern.split(text)
            if len(parts) > 1:
                return [w for i, p in enumerate(parts) for w in ([self.special[p]] if i % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-casing is by single characters: no final sigma
        text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for split() but not for the pattern
            return self.find(text)
        return text.split()

    def word_codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A code for each word of all texts, and the number of words of each text."""
        if self.count > self.most:
            self.reset()
            trimmed()
        split = [self.words(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        listed = list(chain.from_iterable(split))
        codes = np.fromiter(map(self.codes.get, listed, repeat(-1)), np.int64, len(listed))
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            unknown = [listed[i] for i in missing.tolist()]
            gc.disable()  # a hundred thousand new lists and no cycles: collections would only walk the stores
            try:
                self._learn(list(dict.fromkeys(unknown)))
            finally:
                gc.enable()
            codes[missing] = [self.codes[w] for w in unknown]
            if len(missing) > MANY:
                trimmed()
        return codes, counts

    def ids_of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the coded words, and the number of ids of each word."""
        n = self.length[codes]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start[codes] - (ends - n), n)
        return self.flat[at], n

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one uint32 array, and the n + 1 offsets of the texts in it."""
        codes, words = self.word_codes(texts)
        ids, n = self.ids_of(codes)
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids, ends[np.concatenate([[0], np.cumsum(words)])]

    def decode(self, ids) -> str:
        """The library joins token texts with a space where a file names no decoder."""
        text = self.text
        return " ".join([text[i] for i in ids])


class LibraryBPE(SpeculativeBPE):
    """The same stores and ids, with new words encoded by the tokenizers library itself."""

    def __init__(self, blob: bytes, most: int = WORD_STORE):
        from tokenizers import Tokenizer

        super().__init__(blob, most)
        self.library = Tokenizer.from_str(blob.decode("utf-8"))
        self.closes = np.array([t.endswith(self.suffix) for t in self.text], bool)

    def split_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words go to the library in lines; each ends with its one token that closes a word."""
        out = [(np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        lines = [words[a : a + 512] for a in range(0, len(words), 512)]
        joined = list(map(" ".join, lines))
        for line, text, e in zip(lines, joined, self.library.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            n = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
            if len(n) != len(line) or not unicodedata.is_normalized("NFC", text):  # lower-casing undid the normal form, or a character that the library splits at and we don't
                ids, n = super().split_flat(line)
            out.append((ids, n))
        return tuple(map(np.concatenate, zip(*out)))


class Greedy:
    """SpeculativeBPE.proposed() for many pieces at once: all walk one table of the tokens' prefixes, a byte a step.

    Bytes that are in no longer token share a column of the table, in which nothing goes on.
    """

    #: Pieces that walk together, and the bytes of one at most; a longer one is split by itself.
    TOGETHER, LONGEST = 1 << 14, 64

    def __init__(self, enc: SpeculativeBPE):
        self.enc = enc
        tokens = [*enc.inner.items(), *enc.final.items()]
        used = sorted(set(b"".join(t for t, _ in tokens if len(t) > 1)))
        self.kind = np.zeros(256, np.int32)
        self.kind[used] = np.arange(1, len(used) + 1)
        self.kinds = len(used) + 1
        state: dict[bytes, int] = {b"": 1}  # 0: no token goes on so
        for t, _ in tokens:
            if self.kind[t[0]]:
                for i in range(1, len(t) + 1):
                    state.setdefault(t[:i], len(state) + 1)
        self.inner, self.final = (np.full(len(state) + 1, -1, np.int32) for _ in range(2))
        for ids, of in ((self.inner, enc.inner), (self.final, enc.final)):
            ids[[state.get(t, 0) for t in of]] = list(of.values())
            ids[0] = -1
        self.alone = np.array([[of.get(bytes([b]), -1) for b in range(256)] for of in (enc.inner, enc.final)])
        self.step = np.zeros((len(state) + 1) * self.kinds, np.int32)
        prefixes = list(state)[1:]
        self.step[np.array([state[t[:-1]] for t in prefixes]) * self.kinds + self.kind[[t[-1] for t in prefixes]]] = [state[t] for t in prefixes]

    def split(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each piece."""
        return self.walked(np.frombuffer(b"".join(pieces), np.uint8), np.fromiter(map(len, pieces), np.int64, len(pieces)))

    def walked(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """split() of pieces that follow each other in one array of bytes."""
        ends = np.concatenate([[0], np.cumsum(size)])
        parts = []
        for a in range(0, len(size), self.TOGETHER):
            some = size[a : a + self.TOGETHER]
            parts.append(self._walked(raw[ends[a] : ends[a + len(some)]], some))
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2

    def _walked(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        end = np.cumsum(size)
        first = end - size
        kind = self.kind.take(raw)
        out = np.full(len(raw), -1, np.int64)  # each token's id at its first byte
        ends = np.zeros(len(raw), np.int64)
        ends[end[size > 0] - 1] = 1
        for k in np.flatnonzero(size > self.LONGEST).tolist():
            ids = self.enc.proposed(raw[first[k] : end[k]].tobytes())
            out[first[k] : first[k] + len(ids)] = ids
        lone = self.alone[ends, raw]
        live = (size > 0) & (size <= self.LONGEST)
        start, end = first[live], end[live]
        at, state = start.copy(), np.ones(len(start), np.int32)
        best, upto = np.full(len(start), -1, np.int32), start + 1
        while len(at):
            state = self.step.take(state * self.kinds + kind.take(at))
            at += 1
            last = at == end
            met = np.where(last, self.final.take(state), self.inner.take(state))
            found = met >= 0
            np.copyto(best, met, where=found)
            np.copyto(upto, at, where=found)
            stop = np.flatnonzero((state == 0) | last)
            if len(stop):
                here = start.take(stop)
                out[here] = np.where(best.take(stop) >= 0, best.take(stop), lone.take(here))
                start[stop] = at[stop] = upto.take(stop)
                state[stop], best[stop] = 1, -1
                more = start != end
                if not more.all():
                    start, end, at, state, best, upto = (x[more] for x in (start, end, at, state, best, upto))
                upto = np.maximum(upto, start + 1)
        has = out >= 0
        return out[has], np.diff(np.concatenate([[0], np.cumsum(has)])[np.concatenate([[0], first + size])])


def opened(blob: bytes, kind: type[SpeculativeBPE] = SpeculativeBPE, most: int = WORD_STORE) -> SpeculativeBPE:
    """One encoder a worker process for each vocabulary."""
    return kept((kind.__name__, most, hashlib.md5(blob).digest()), lambda: kind(blob, most))


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file (a fixed 2 MB) as a broadcast value: executors need no file of their own."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids ARRAY<INT>: the ids of each whole text."""
    blob = vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(blob.value)
        for batch in batches:
            for i, j in slices(batch, "text"):
                part = batch.slice(i, j - i)
                ids, at = bpe.encode_batch(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text: each row's ids decoded, special tokens kept."""
    blob = vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(blob.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([bpe.decode(x or ()) for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of the ids and of the text decoded from them."""
    blob = vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(blob.value)
        for batch in batches:
            for i, j in slices(batch, "text"):
                part = batch.slice(i, j - i)
                codes, words = bpe.word_codes(part.column("text").to_pylist())
                ids, n = bpe.ids_of(codes)
                raw = np.ascontiguousarray(ids, "<u4").view(np.uint8)
                ends = np.concatenate([[0], np.cumsum(n)])
                w = np.concatenate([[0], np.cumsum(words)])
                at = ends[w]
                used, where = np.unique(codes, return_inverse=True)
                listed, shown = where.tolist(), [bpe.decode(bpe.flat[bpe.start[c] : bpe.start[c] + bpe.length[c]].tolist()) for c in used.tolist()]
                ids_sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                texts = [" ".join([shown[c] for c in listed[a:b] if shown[c]]) for a, b in zip(w[:-1].tolist(), w[1:].tolist())]
                text_sha = [hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
