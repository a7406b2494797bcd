"""The training-data operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftwell.llm import ann, attention, bpe, components, langid, lm, packing, puquality, queries, rules, sharding, simhash, suffixdedup

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path(queries.TOKENIZER)
SCHEMA = "doc_id long, text string, lang string, source string, words string, row string, score double, fp long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeats, and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(20_000))
    texts = [None, "", " \n\t", "a", "the cat", "the cat", long, "é" * 300, "x" * 5000, "<|endoftext|> Hi!!", "line\nline\nline", None]
    rows = [(i if i != 3 else None, t, None if i % 5 == 0 else "en", None, "w", "r", None, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def plain(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def operators(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, None), (None, 1)], "doc_id long, quality int")
    return {
        "langid": langid.identified,
        "simhash": simhash.near_duplicates,
        "packing": lambda d: packing.pack_documents(d, TOKENIZER),
        "bpe": lambda d: bpe.round_trip(d, TOKENIZER),
        "lm": lambda d: lm.scored(d, TOKENIZER),
        "rules": rules.judged,
        "rules_kept": rules.passing,
        "puquality": lambda d: puquality.classified(d, labels),
        "sharding": lambda d: sharding.assign(d, 3)[0],
        "suffixdedup": suffixdedup.digests,
        "suffixdedup_texts": suffixdedup.deduplicated,
        "near_dedup": lambda d: corpus_pipeline.near_dedup(spark, d, SF),
    }


@pytest.mark.parametrize("name", ["langid", "simhash", "packing", "bpe", "lm", "rules", "rules_kept", "puquality", "sharding", "suffixdedup", "suffixdedup_texts", "near_dedup"])
def test_odd_and_empty_tables(spark, odd, name):
    run = operators(spark)[name]
    assert run(odd.limit(0)).count() == 0
    n = run(odd).count()
    assert n == {"rules_kept": 0, "near_dedup": 8}.get(name, 12) or name == "packing" and n > 12


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    und = spark.createDataFrame([(1, None, "en"), (2, "123 !", "en"), (3, "hello there", "en")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.predicted(und, langid.fit(und)).collect()} == {1: "und", 2: "und", 3: "en"}


@pytest.mark.parametrize("small", [False, True])
def test_simhash_against_all_pairs(docs, plain, monkeypatch, small):
    if small:  # every path for hot rows and dense buckets
        monkeypatch.setattr(simhash, "DENSE", 2)
        monkeypatch.setattr(simhash, "HOT_ROWS", 2)

    def fingerprint(text):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fp = {i: fingerprint(t) for i, t in plain.items()}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fp:
        for j in fp:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in fp}


def test_pigeonring_loses_no_link():
    rng = random.Random(4)
    for _ in range(3000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        keys = [set(simhash.ring_keys(np.array([x], np.uint64))[1].tolist()) for x in (a, b)]
        shared = keys[0] & keys[1]
        assert any(simhash.within_ring(np.array([a ^ b], np.uint64), np.array([k >> 25], np.uint64))[0] for k in shared)


def test_dense_bucket():
    rng = np.random.default_rng(0)
    fp = np.unique(np.array([1 << b for b in range(24, 64)], np.uint64) | rng.integers(0, 8, 40).astype(np.uint64))
    key = np.zeros(len(fp), np.uint64)
    a, b = simhash.links_of_sorted(key, fp, np.arange(len(fp)))
    assert len(a) < len(fp)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


@pytest.mark.parametrize("copies", [False, True])
def test_neighbours(spark, copies):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1200, 16))
    if copies:
        x[100:700] = x[100]
    rows = [(i, v.astype("float32").tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 20 == 0).toPandas()
    x = x.astype("float32").astype("float64")
    hit = 0
    for q in range(0, 1200, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1200), -s))[:20]
        mine = got[got.query_id == q].sort_values("rank")
        assert len(mine) == 20 and np.allclose(mine.score, s[mine.vec_id])
        hit += (np.sort(s[mine.vec_id])[::-1] >= s[best] - 1e-9).sum()
    assert hit / (60 * 20) >= 0.9
    few = ann.nearest(df.where("vec_id < 5"), "vec_id", "embedding", F.col("vec_id") == 0)
    assert few.count() == 4
    assert ann.nearest(df.limit(0), "vec_id", "embedding", F.col("vec_id") == 0).count() == 0


def test_neighbours_of_many_lists(spark, monkeypatch):
    """400 lists of vectors that are uniform on the sphere: no cap on lists may cost recall."""
    monkeypatch.setattr(ann, "LIST_ROWS", 50)
    x = np.random.default_rng(4).standard_normal((20_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(df, "vec_id", "embedding", F.col("vec_id") % 400 == 0).toPandas()
    hit = 0
    for q in range(0, len(x), 400):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(got[got.query_id == q].vec_id))
    assert hit / (50 * 20) >= 0.99


def test_packing(docs, plain):
    lib = Tokenizer.from_file(TOKENIZER)
    got = packing.pack_documents(docs, TOKENIZER).toPandas()
    for i, part in got.groupby("doc_id"):
        ids = [*lib.encode(plain[i] or "", add_special_tokens=False).ids, 2]
        part = part.sort_values("start")
        assert part.start.tolist() == np.cumsum([0, *part.length[:-1]]).tolist() and part.length.sum() == len(ids) == part.doc_tokens.iloc[0]
        for r in part.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.cumsum([0, *s.length[:-1]]).tolist() and s.length.sum() <= 4096
    assert got.length.sum() / (4096 * got.sequence_id.nunique()) > 0.95


def test_best_fit_takes_the_tightest():
    fit = packing.BestFit(10)
    assert [fit.place(n) for n in (7, 6, 4, 3, 2)] == [(0, 0), (1, 0), (1, 6), (0, 7), (2, 0)]


def test_bpe_equals_the_library(docs, plain):
    lib = Tokenizer.from_file(TOKENIZER)
    rng = random.Random(2)
    odd = "aàéßİΣς'’tsrevdml \n\t01²º.,!?-_<|>中한้🙂́‍\x1c\x85"
    texts = [*plain.values(), *("".join(rng.choice(odd) for _ in range(rng.randint(0, 40))) for _ in range(2000)), "<|endoftext|>a", "z" * 3000, "ab" * 900, ""]
    want = lib.encode_batch([t or "" for t in texts], add_special_tokens=False)
    for kind in (bpe.SpeculativeBPE, bpe.LibraryBPE):
        with open(TOKENIZER, "rb") as f:
            enc = kind(f.read())
        ids, at = enc.encode_batch(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [w.ids for w in want]
    got = {r.doc_id: r for r in bpe.round_trip(docs, TOKENIZER).collect()}
    for (i, t), w in zip(plain.items(), want):
        assert got[i].ids_sha256 == hashlib.sha256(np.array(w.ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(w.ids, skip_special_tokens=False).encode()).hexdigest()
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, TOKENIZER), TOKENIZER).collect()} == {i: lib.decode(w.ids, skip_special_tokens=False) for i, w in zip(plain, want)}


def test_words_are_learned_by_arrays():
    from tokenizers import Tokenizer

    with open(TOKENIZER, "rb") as f:
        blob = f.read()
    library = Tokenizer.from_str(blob.decode("utf-8"))
    words = ["the", "don't", "a.b,c", "!!'s", "\u0130x", "\u0915\u093c", "x\u00a0y", "\u3000", "12", "e\u0301e"]
    for kind in (bpe.SpeculativeBPE, bpe.LibraryBPE):
        enc = kind(blob)
        ids, n = enc.split_flat(["the", "information", "zzqq"])
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(w, add_special_tokens=False).ids for w in ("the", "information", "zzqq")]
        enc._learn([*words, 2])
        got, n = enc.ids_of(np.array([enc.codes[w] for w in [*words, 2]]))
        plain = [enc.split_words(enc.find(w)) for w in words]
        assert [x.tolist() for x in np.split(got, np.cumsum(n)[:-1])] == [*(sum(x, []) for x in plain), [2]]


def test_lm_base_scores(docs, plain):
    got = {r.doc_id: r for r in lm.scored(docs, TOKENIZER, frequent=50).collect()}
    train = {i: t for i, t in plain.items() if zlib.crc32(str(i).encode()) % 5 != 1}
    c = Counter(w for t in train.values() for w in lm.words_of(t))
    n, v = sum(c.values()) + len(train), len(c) + 1
    log = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    for i, t in plain.items():
        w = lm.words_of(t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(w) + 1, sum(x in c for x in w) + 1, n, i not in train)
        assert got[i].base_score == pytest.approx(sum(log(c[x]) for x in w) + log(len(train)), rel=1e-9)
        assert got[i].score < 0 and math.isfinite(got[i].score)


def test_lm_learns_from_all_windows_once(spark):
    """Texts of 0 to 300 words: windows by document in order, the ids they hold, and the words counted."""
    texts = ["", None, "one", *(" ".join(f"w{i}x{j % 7}" for j in range(n)) for i, n in enumerate((31, 32, 33, 64, 300)))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    blob = bpe.vocabulary(df, TOKENIZER)
    enc = bpe.SpeculativeBPE(blob.value)
    store = lm.WordStore(enc, np.zeros(0, np.uint64), np.zeros(0))
    rows = lm.gathered(df, blob, enc.size, enc.size + 1).collect()
    seen = [np.frombuffer(r.ids, "<u4").tolist() for r in rows if r.at is not None]
    want = [[enc.size, *store.ids(store.codes(lm.words_of(t)))[0].tolist(), enc.size + 1] for t in texts]
    assert [i for ids in seen for i in ids] == [i for w in want for i in w]
    assert len(seen) == 3 + 1 + 1 + 2 + 2 + 10
    counts = {r.word: r.n for r in rows if r.at is None}
    words = Counter(w for t in texts for w in lm.words_of(t))
    assert counts == {int(np.uint64(xxhash.xxh64_intdigest(w)).astype(np.int64)): n for w, n in words.items()}


def test_lm_words_have_ids_of_their_own():
    with open(TOKENIZER, "rb") as f:
        enc = bpe.SpeculativeBPE(f.read())
    store = lm.WordStore(enc, np.zeros(0, np.uint64), np.zeros(0))
    words = ["Ärzte", "ärzte", "a\u00a0b", "ab", "a\u3000b", "l'eau", "leau", "x1y", "xy.", "xy"]
    ids = [tuple(store.ids(store.codes([w.encode()]))[0].tolist()) for w in words]
    assert all(ids) and len(set(ids)) == len(words)


def test_lm_words_are_found_by_arrays():
    with open(TOKENIZER, "rb") as f:
        blob = f.read()
    enc = bpe.SpeculativeBPE(blob)
    rng = np.random.default_rng(11)
    signs = [*"abT19's.-", "ll", " ", "\n", "\x0b", "\x1c", "\x00", "\x85", "\u00a0", "\u3000", "\u00e9", "\u0130", "\u00b2", "\U0001f600", "x" * 70]
    texts = [None, "", "  ", " a", *("".join(rng.choice(signs, rng.integers(0, 50))) for _ in range(3000)), "w" * 1000, "a ", None, ""]
    text, start, size, words = lm.words_in(pa.array(texts))
    plain = [lm.words_of(t) for t in texts]
    flat = [w for ws in plain for w in ws]
    assert words.tolist() == [len(ws) for ws in plain]
    assert [text[a : a + n] for a, n in zip(start.tolist(), size.tolist())] == flat
    none = np.zeros(0)
    store = lm.WordStore(enc, none.astype(np.uint64), none)
    store._open(4)  # grows with its words
    for _ in range(2):
        code = store.codes_in(text, start, size)
        assert len(store.key) == len(set(flat)) and store.key[code].tolist() == [xxhash.xxh64_intdigest(w) for w in flat]
        ids, n = store.ids(code)
        for w, got in list(zip(flat, np.split(ids, np.cumsum(n)[:-1])))[:5000]:
            pieces = [p.encode() for p in enc.find(w.decode())]
            assert got.tolist() == sum(map(enc.proposed, pieces if b"".join(pieces) == w else [w]), [])
    # scoring goes on with the words that gathering has learned
    first = lm.store_of(blob, none.astype(np.uint64), none)
    code = first.codes([b"a", b"b"])
    known = np.array([xxhash.xxh64_intdigest(b"b")], np.uint64)
    again = lm.store_of(blob, known, np.array([2.5]))
    assert again is first and again.codes([b"a", b"b"]).tolist() == code.tolist()
    assert (again.hit[code].tolist(), again.logs[code].tolist()) == ([False, True], [0.0, 2.5])


def test_lm_pieces_are_split_together():
    with open(TOKENIZER, "rb") as f:
        enc = bpe.SpeculativeBPE(f.read())
    rng = np.random.default_rng(8)
    drawn = ["".join(map(chr, rng.choice([*range(33, 127), 0xE9, 0xDF, 0x3B1, 0x65E5, 0x1F600], rng.integers(1, 90)))) for _ in range(300)]
    pieces = [w.encode("utf-8") for w in [*drawn, "a", "the", "\x00\x01", "a\x7fb", "\U0010ffff", "\u0378q", "a" * 300, "", "information", "\u65e5" * 40]]
    ids, n = bpe.Greedy(enc).split(pieces)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [enc.proposed(w) for w in pieces]
    assert [len(x) for x in bpe.Greedy(enc).split([])] == [0, 0]


def test_attention_gradients_are_differences():
    rng = np.random.default_rng(12)
    v = attention.Vocabulary(rng.integers(0, 50, 300), rng.integers(0, attention.GROUPS, 300))
    v.follow(rng.poisson(0.3, (attention.INPUTS + attention.GROUPS, attention.GROUPS * attention.LEAVES)))
    p = {k: x + rng.normal(0, 0.1, x.shape).astype(np.float32) for k, x in attention.fresh(v).items()}
    lengths = np.array([40, 1, 16, 33])
    inputs, targets = (rng.integers(0, 300, lengths.sum()) for _ in range(2))
    at, begins = attention.blocks_of(lengths)
    slots = np.zeros(len(begins) * attention.BLOCK, np.int64)
    slots[at] = v.slot[inputs]
    loss, g = attention._gradients(p, v, slots, v.group[targets], v.leaf[targets], at, begins)
    mean = lambda q: -(attention.log_probs(q, v, inputs, targets, lengths) - v.share_log[targets]).mean()
    assert abs(loss - mean(p)) < 1e-4
    for k, x in p.items():
        way = np.where(g[k] > 0, 1, -1).astype(np.float32)
        met = abs(g[k]) > 0.1 * abs(g[k]).max()
        step = (2e-3 * way * met).astype(np.float32)
        up, down = mean(p | {k: x + step}), mean(p | {k: x - step})
        want = 2 * float((g[k] * step).sum())
        assert abs(up - down - want) < 0.03 * want + 2e-6, k


def test_lm_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(0)
    size, lengths = 3000, rng.integers(1, 400, 60)
    vocab = attention.Vocabulary(rng.integers(0, 500, size), rng.integers(0, attention.GROUPS, size))
    vocab.follow(rng.poisson(0.3, (attention.INPUTS + attention.GROUPS, attention.GROUPS * attention.LEAVES)))
    p = attention.fresh(vocab)
    texts = [rng.integers(0, size, n + 1) for n in lengths]

    def scores(rows):
        return attention.log_probs(p, vocab, np.concatenate([texts[i][:-1] for i in rows]), np.concatenate([texts[i][1:] for i in rows]), lengths[rows])

    alone = [scores(np.array([i])) for i in range(60)]
    for rows in (np.arange(60), rng.permutation(60), np.arange(7, 31)):
        assert np.array_equal(scores(rows), np.concatenate([alone[i] for i in rows]))


def test_lm_is_a_function_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEARNER_WINDOWS", 1500)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = [{r.doc_id: (r.score, r.base_score) for r in lm.scored(d, TOKENIZER).collect()} for d in (docs, docs.repartition(13).orderBy(F.rand(3)))]
    assert out[0].keys() == out[1].keys()
    assert all(a == pytest.approx(out[1][i], rel=1e-9) for i, a in out[0].items())


def test_lm_beats_the_base_line(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    t = lm.scored(docs, TOKENIZER).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert t[0] > t[1]


def test_attention_is_a_distribution_and_scores_once():
    rng = np.random.default_rng(3)
    v = attention.Vocabulary(rng.integers(0, 50, 300).astype(float), np.arange(300) % attention.GROUPS)
    p = attention.fresh(v)
    text = rng.integers(0, 300, 70)
    inputs = np.repeat(text[None, :], 300, axis=0)
    targets = np.concatenate([np.tile(text[1:], (300, 1)), np.arange(300)[:, None]], axis=1)
    lp = attention.log_probs(p, v, inputs.ravel(), targets.ravel(), np.full(300, 70)).reshape(300, 70)
    assert np.exp(lp[:, -1]).sum() == pytest.approx(1.0, abs=1e-3)
    assert np.allclose(lp[:, :-1], lp[0, :-1], atol=1e-4)
    better, _ = attention.trained(p, v, [text] * 64, 0.02, least_steps=100)
    assert attention.log_probs(better, v, text[:-1], text[1:], np.array([69])).sum() > lp[0, :-1].sum() + 20


def test_rules_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES["op7_quality_rules"]).df()
    got = queries.op7_quality_rules(spark, SF).toPandas()
    cols = sorted(got.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = puquality.classified(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got.score[got.quality == 1].values, got.score[got.quality == 0].values
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert (got.predicted == got.quality).mean() > 0.9
    net = puquality.fit(docs, labels)
    assert 0.6 < net.prior < 0.98


def test_sharding(spark, docs, plain):
    got, m = sharding.assign(docs, 8)
    got = got.toPandas()
    assert sorted(got.doc_id) == sorted(plain)
    assert all(sorted(s.slot) == list(range(len(s))) for _, s in got.groupby("shard"))
    assert all((r.size_, r.text_crc32) == (len((plain[r.doc_id] or "").encode()) + 16, zlib.crc32((plain[r.doc_id] or "").encode())) for r in got.rename(columns={"size": "size_"}).itertuples())
    load = got.groupby("shard")["size"].sum()
    assert load.max() < 1.1 * load.mean()
    sizes = [0] * sharding.SLOTS
    for s, b in got.groupby("virtual_slot")["size"].sum().items():
        sizes[s] = int(b)
    more = m.grown(sizes)
    assert all(b in (a, 8) for a, b in zip(m.owner, more.owner)) and more.version == m.version + 1
    assert more.loads(sizes)[8] > 0


def test_next_run_edits_the_stored_map(spark, docs, tmp_path):
    store = str(tmp_path / "versions")
    sharding.SlotMap.balanced([1] * 64, 4).save(spark, store)
    got, m = sharding.assign(docs, 4, slots=64, store=store)
    again, n = sharding.assign(docs, 4, slots=64, store=store)
    assert m.version == 2 and n == m and sharding.SlotMap.load(spark, store, 1).version == 1
    assert got.select("doc_id", "shard").exceptAll(again.select("doc_id", "shard")).count() == 0
    moved = sum(a != b for a, b in zip(m.owner, sharding.SlotMap.load(spark, store, 1).owner))
    assert 0 < moved < 32


def test_slot_map_is_kept(spark, tmp_path):
    m = sharding.SlotMap.balanced([5, 4, 3, 2, 1], 2)
    m.save(spark, str(tmp_path / "map"))
    n = m.rebalanced([50, 4, 3, 2, 1])
    n.save(spark, str(tmp_path / "map"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "map")) == n
    assert sharding.SlotMap.load(spark, str(tmp_path / "map"), 1) == m


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        cover = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                cover[p : p + 100] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], cover.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(cover.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~cover].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffixdedup.HOT_ROWS, 4])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixdedup, "HOT_ROWS", hot)
    rng = random.Random(0)
    base = ["".join(rng.choice("abc") for _ in range(400)) for _ in range(4)]
    rows = []
    for i in range(200):
        t = "".join(rng.choice("ab\0é ") for _ in range(rng.randint(0, 150)))
        for _ in range(rng.randint(0, 4)):
            b, a = rng.choice(base), rng.randint(0, 300)
            t += b[a : a + rng.randint(50, 300)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 5)))
        rows.append((i, t if i % 17 else None))
    rows += [(1000, "a" * 5000), (1001, "ab" * 400), (1003, "a" * 99), (1004, "é" * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffixdedup.digests(df).collect()}
    assert got == brute_repeats(rows)
    texts = {r.doc_id: r.text for r in suffixdedup.deduplicated(df).collect()}
    assert texts[0] is None and len(texts[1000]) < 200 and set(texts[1004]) == {"é"}


def in_order(rows):
    """Rows of (doc_id, text) as the operators take them: by doc_id, then text, without an id last."""
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


def test_suffix_dedup_of_repeated_ids(spark):
    rng = random.Random(7)
    long = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (120, 2000, 900)]
    rows = [(2, long[1]), (2, long[1]), (1, long[0]), (1, long[2] + long[0]), (None, long[2]), (None, None), (3, ""), (None, "x" + long[0] + long[0]), (4, long[0][:99])]
    extra = [(i, t, [1], "s", "k", [i or 0]) for i, t in rows]
    df = spark.createDataFrame(extra, "doc_id long, text string, spans array<int>, _spans string, row_key string, ROW_KEY_ array<long>").repartition(3)
    want = brute_repeats([(k, t) for k, (_, t) in enumerate(in_order(rows))])
    got = [tuple(r)[1:] for r in suffixdedup.digests(df).collect()]
    assert sorted(got) == sorted(want.values())
    out = suffixdedup.deduplicated(df)
    assert out.columns == df.columns and sum(len(r.text or "") for r in out.collect()) == sum(n - m for n, m, *_ in want.values())


def brute_groups(rows):
    """The first row of each group of near duplicates, by single linkage over all pairs."""
    rows = in_order(rows)
    fp = [simhash.majority_bits(simhash.shingle_hashes(t)) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [r for i, r in enumerate(rows) if find(i) == i]


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on its own input, with nulls, repeats and ties among the documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("doc_id % 7 = 0")
    docs = docs.unionByName(some).unionByName(some.withColumn("doc_id", F.lit(None).cast("long"))).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    key = lambda rows: sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "", r.lang or "") for r in rows)
    steps = dict(corpus_pipeline.STAGES)

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = puquality.fit(docs, labels)
    score = lambda t: puquality._scores(pa.RecordBatch.from_arrays([pa.array([t], pa.string())], ["text"]), net)[0]
    good = steps["quality_classifier"](spark, docs, SF)
    assert key(good.collect()) == key(r for r in docs.collect() if score(r.text) >= puquality.THRESHOLD)

    ruled = steps["quality_rules"](spark, good, SF)
    kept = rules.judged(good.select(F.monotonically_increasing_id().alias("doc_id"), "text")).where("kept").count()
    assert ruled.columns == docs.columns and ruled.count() == kept > 0

    rows = ruled.collect()
    once = steps["near_dedup"](spark, ruled, SF)
    assert sorted((i is None, i or 0, t or "") for i, t in [(r.doc_id, r.text) for r in once.collect()]) == sorted((i is None, i or 0, t or "") for i, t in brute_groups([(r.doc_id, r.text) for r in rows]))

    cut = steps["suffix_dedup"](spark, once, SF)
    left = in_order([(r.doc_id, r.text) for r in once.collect()])
    want = brute_repeats([(k, t) for k, (_, t) in enumerate(left)])
    got = cut.collect()
    assert len(got) == len(left) and all(r.n_chars == len(r.text) for r in got)
    assert 0 <= sum(len(r.text.encode()) for r in got) - sum(n - m for n, m, *_ in want.values()) <= 6 * sum(w[2] for w in want.values())

    packed = steps["packing"](spark, cut, SF).toPandas()
    lib = Tokenizer.from_file(TOKENIZER)
    assert packed.length.sum() == sum(len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in got)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        assert docs.count() <= before.count()
    assert corpus_pipeline.run(spark, SF).count() >= docs.count()
