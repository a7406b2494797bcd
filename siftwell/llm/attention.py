"""A small causal self-attention model over subword ids, trained and run in numpy.

Inputs are subword ids: frequent ids have embeddings of their own, others share their group's. The
output is in two steps: a group of ids with like neighbours, then a leaf in that group (a frequent
id alone, or all others of the group, of which each has a fixed share). So a token costs a score
for each group and for each leaf of one group. Both steps start from what has been counted after
the id before (Vocabulary), and what the attention adds is learned.

Sequences run in blocks; a block's queries see the block before and their own up to themselves, so
context windows overlap by half and each token is scored once. Query and key projections are one
matrix (`look`), value and output projections another (`move`).

How a matrix product rounds depends on its shape and on a row's place in it. A text's score must not
depend on the texts beside it, so scoring multiplies block by block, and where rows of many blocks
come together it multiplies whole numbers.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16
WIDTH = 16
GROUPS, LEAVES = 16, 32
INPUTS = 1024
#: Blocks computed at once.
CHUNK = 256

#: Offsets of the keys of two blocks from a query, and which of them it may not see.
_OFFSET = np.arange(BLOCK)[:, None] + BLOCK - np.arange(2 * BLOCK)[None, :]
_HIDDEN = _OFFSET < 0
_SLOT = np.clip(_OFFSET, 0, 2 * BLOCK - 1)
_SEEN = _SLOT[~_HIDDEN]
_ONES = np.ones(2 * BLOCK, np.float32)
_NAMES = ("embed", "look", "move", "near", "top", "top_bias", "leaf", "leaf_bias")
#: Factors of a product of whole numbers are rounded to this part; up to 8192 its sums are exact.
PART = 2.0**-20
#: Pairs that a row of the pair counts is taken to have from the general shares.
PRIOR = 25.0


class Vocabulary:
    """Group, leaf, share in its leaf and input slot of each id, from counts and group labels.

    follow() adds the log shares of groups and leaves after each input slot, from counts of pairs.
    """

    def __init__(self, counts: np.ndarray, group: np.ndarray):
        size = len(counts)
        order = np.argsort(-counts, kind="stable")
        self.group = group.astype(np.int64)
        self.leaf = np.full(size, LEAVES - 1)
        for g in range(GROUPS):
            first = order[self.group[order] == g][: LEAVES - 1]
            self.leaf[first] = np.arange(len(first))
        smooth = counts + 0.5
        self.cell = self.group * LEAVES + self.leaf
        mass = np.bincount(self.cell, weights=smooth, minlength=GROUPS * LEAVES)
        self.share_log = np.log(smooth / mass[self.cell])
        self.share = np.maximum(mass, 1e-9) / np.maximum(mass, 1e-9).sum()
        self.slot = INPUTS + self.group
        self.slot[order[:INPUTS]] = np.arange(min(INPUTS, size))
        self.follow(np.zeros((INPUTS + GROUPS, GROUPS * LEAVES)))

    def follow(self, pairs: np.ndarray) -> None:
        """pairs: how often each cell comes after an id of each slot."""
        given = (pairs + PRIOR * self.share) / (pairs.sum(axis=1, keepdims=True) + PRIOR)
        given = given.reshape(-1, GROUPS, LEAVES)
        top = given.sum(axis=2)
        self.top_log = np.log(top).astype(np.float32)
        self.leaf_log = np.log(given / top[:, :, None]).astype(np.float32)


def fresh(vocab: Vocabulary, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    d = WIDTH
    return {
        "embed": draw(INPUTS + GROUPS, d, scale=0.5),
        "look": draw(d, d, scale=0.5 / d),
        "move": draw(d, d, scale=d**-0.5),
        "near": (-0.1 * np.arange(2 * BLOCK)).astype(np.float32),
        "top": draw(d, GROUPS, scale=0.05),
        "top_bias": np.zeros(GROUPS, np.float32),
        "leaf": draw(GROUPS, d, LEAVES, scale=0.05),
        "leaf_bias": np.zeros((GROUPS, LEAVES), np.float32),
    }


def blocks_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all tokens in padded blocks, and whether each block begins its sequence."""
    n = -(-lengths // BLOCK)
    first = np.cumsum(n) - n
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first * BLOCK - (ends - lengths), lengths)
    begins = np.zeros(int(n.sum()), bool)
    begins[first[n > 0]] = True
    return at, begins


def _near(p) -> np.ndarray:
    return np.where(_HIDDEN, np.float32(-1e9), p["near"][_SLOT])


def _capped(x: np.ndarray) -> np.ndarray:
    """At most 60, in place; a pass that only looks is far cheaper."""
    if x.size and not x.max() <= 60:
        np.minimum(x, 60, out=x)
    return x


def _with_before(x: np.ndarray) -> np.ndarray:
    """Each block after the first together with the block that precedes it, as a view."""
    return np.ndarray((len(x) - 1, 2 * BLOCK, x.shape[2]), x.dtype, x, 0, x.strides)


def _weights(q: np.ndarray, xx: np.ndarray, near: np.ndarray, begins: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Attention weights of queries q, before they are divided by their sums."""
    s = np.matmul(q, xx.transpose(0, 2, 1), out=out)
    s += near
    s[begins, :, :BLOCK] = -1e9
    return np.exp(_capped(s), out=s)


def _whole(x: np.ndarray) -> np.ndarray:
    """In parts, rounded to whole numbers; a power of two as factor loses nothing."""
    return np.rint(x * x.dtype.type(1 / PART)).astype(np.float64)


def _exp(logits: np.ndarray) -> np.ndarray:
    """exp(logits) in place."""
    return np.exp(logits, out=logits)


class Scorer:
    """log_probs() of one model. What depends on a slot alone is worked out once and looked up."""

    def __init__(self, p: dict[str, np.ndarray], vocab: Vocabulary):
        self.vocab, self.embed = vocab, p["embed"]
        self.asks, self.near = p["embed"] @ p["look"], _near(p)
        # a token's own part in what comes out, and what is done to what it attends to
        self.top = p["move"] @ p["top"]
        self.top_at = vocab.top_log + p["top_bias"] + p["embed"] @ p["top"]
        self.leaf = _whole(np.matmul(p["move"], p["leaf"])) * PART**2
        self.leaf_at = (vocab.leaf_log + p["leaf_bias"] + np.matmul(p["embed"], p["leaf"]).transpose(1, 0, 2)).reshape(-1, LEAVES)

    def log_probs(self, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log probability of each target, given the inputs of its sequence so far."""
        vocab = self.vocab
        at, begins = blocks_of(lengths)
        nb = len(begins)
        slots, group, leaf = (np.zeros(nb * BLOCK, np.int64) for _ in range(3))
        slots[at] = vocab.slot.take(inputs)
        group[at] = vocab.group.take(targets)
        leaf[at] = vocab.leaf.take(targets)
        out = np.zeros(nb * BLOCK, np.float32)
        x = np.zeros((CHUNK + 1, BLOCK, WIDTH), np.float32)
        for a in range(0, nb, CHUNK):
            b = min(nb, a + CHUNK)
            here = slice(a * BLOCK, b * BLOCK)
            at_slot, g = slots[here], group[here]
            x[0] = x[CHUNK]
            x = x[: b - a + 1]
            x[1:] = self.embed.take(at_slot, axis=0).reshape(-1, BLOCK, WIDTH)
            xx = _with_before(x)
            w = _weights(self.asks.take(at_slot, axis=0).reshape(-1, BLOCK, WIDTH), xx, self.near, begins[a:b])
            c = np.matmul(w, xx)
            c *= (1 / (np.matmul(w, _ONES) + np.float32(1e-30)))[:, :, None]
            z = np.matmul(c, self.top).reshape(-1, GROUPS)
            z += self.top_at.take(at_slot, axis=0)
            _capped(z)
            rows = np.arange(len(z))
            score = z.ravel().take(rows * GROUPS + g)
            score -= np.log(np.matmul(_exp(z).reshape(-1, BLOCK, GROUPS), _ONES[:GROUPS]).ravel() + np.float32(1e-30))
            order = np.argsort(g.astype(np.int8), kind="stable")
            g = g.take(order)
            edge = np.searchsorted(g, np.arange(GROUPS + 1)).tolist()
            c = _whole(c.reshape(-1, WIDTH).take(order, axis=0))
            z = self.leaf_at.take(at_slot.take(order) * GROUPS + g, axis=0)
            for k, i, j in zip(range(GROUPS), edge, edge[1:]):
                if i < j:
                    z[i:j] += (c[i:j] @ self.leaf[k]).astype(np.float32)
            _capped(z)
            part = z.ravel().take(rows * LEAVES + leaf[here].take(order))
            part -= np.log(np.einsum("ij->i", _exp(z)) + np.float32(1e-30))
            score[order] += part
            out[here] = score
        return out[at].astype(np.float64) + vocab.share_log.take(targets)


def log_probs(p: dict[str, np.ndarray], vocab: Vocabulary, inputs: np.ndarray, targets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return Scorer(p, vocab).log_probs(inputs, targets, lengths)


def _softmax_gradient(z: np.ndarray, own: np.ndarray, n: float) -> float:
    """Logits become gradients of the mean loss over n rows, in place; the loss. own: each row's target."""
    own = np.arange(len(z)) * z.shape[1] + own
    _capped(z)
    loss = -float(z.ravel().take(own).sum())
    total = _exp(z) @ _ONES[: z.shape[1]]
    loss += float(np.log(total + np.float32(1e-30)).sum())
    z *= (1 / (n * (total + np.float32(1e-30))))[:, None]
    z.ravel()[own] -= np.float32(1 / n)
    return loss / n


def _gradients(p, vocab, slots, group, leaf, at, begins):
    """Mean loss over the real places `at` and its gradients; slots: of all places of all blocks, group and leaf: of the real ones."""
    d = WIDTH
    shape = (-1, BLOCK, d)
    # a column of ones sums the weights up, and takes means off their gradients
    x = np.zeros((len(begins) + 1, BLOCK, d + 1), np.float32)
    own = np.ones((len(p["embed"]), d + 1), np.float32)
    own[:, :d] = p["embed"]
    x[1:] = own.take(slots, axis=0).reshape(-1, BLOCK, d + 1)
    xx, x = _with_before(x), x[1:].reshape(-1, d + 1)[:, :d]
    # weights and their gradients in one array, and what is summed by them in another
    both, beside = np.empty((len(xx), 2 * BLOCK, 2 * BLOCK), np.float32), np.empty((len(xx), 2 * BLOCK, d), np.float32)
    s, ds, dc, q = both[:, :BLOCK], both[:, BLOCK:], beside[:, :BLOCK], beside[:, BLOCK:]
    q[:] = (p["embed"] @ p["look"]).take(slots, axis=0).reshape(shape)
    _weights(q, xx[:, :, :d], _near(p), begins, s)
    c = np.matmul(s, xx)
    scale = 1 / (c[:, :, d:] + np.float32(1e-30))
    c = c[:, :, :d] * scale
    order = np.argsort(group.astype(np.int8), kind="stable")
    edge = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()
    place, group, leaf = at[order], group[order], leaf[order]
    n = max(1, len(at))
    # real places in the order of their groups, with a one for the biases
    h = np.ones((len(at), d + 1), np.float32)
    h[:, :d] = (c.reshape(-1, d) @ p["move"] + x).take(place, axis=0)
    of = slots.take(place)
    z = h @ np.concatenate([p["top"], p["top_bias"][None]])
    z += vocab.top_log.take(of, axis=0)
    loss = _softmax_gradient(z, group, n)
    g = {"leaf": np.zeros_like(p["leaf"]), "leaf_bias": np.zeros_like(p["leaf_bias"])}
    top = h.T @ z
    g["top"], g["top_bias"] = top[:d], top[d]
    dh = z @ p["top"].T
    z = vocab.leaf_log.reshape(-1, LEAVES).take(of * GROUPS + group, axis=0)
    weights = np.concatenate([p["leaf"], p["leaf_bias"][:, None]], axis=1)
    for k, i, j in zip(range(GROUPS), edge, edge[1:]):
        if i < j:
            z[i:j] += h[i:j] @ weights[k]
    loss += _softmax_gradient(z, leaf, n)
    for k, i, j in zip(range(GROUPS), edge, edge[1:]):
        if i < j:
            own = h[i:j].T @ z[i:j]
            g["leaf"][k], g["leaf_bias"][k] = own[:d], own[d]
            dh[i:j] += z[i:j] @ p["leaf"][k].T
    back = np.full(len(slots), len(dh))
    back[place] = np.arange(len(dh))
    dh = np.concatenate([dh, np.zeros((1, d), np.float32)]).take(back, axis=0)
    g["move"] = c.reshape(-1, d).T @ dh
    np.multiply((dh @ p["move"].T).reshape(shape), scale, out=dc)
    off = np.empty((len(xx), BLOCK, d + 1), np.float32)
    off[:, :, :d] = dc
    np.negative(np.einsum("bid,bid->bi", dc, c), out=off[:, :, d])
    np.matmul(off, xx.transpose(0, 2, 1), out=ds)
    ds *= s
    g["near"] = np.bincount(_SEEN, weights=ds.sum(axis=0)[~_HIDDEN], minlength=2 * BLOCK).astype(np.float32)
    dq = np.matmul(ds, xx[:, :, :d]).reshape(-1, d)
    dxx = np.matmul(both.transpose(0, 2, 1), beside)
    g["look"] = x.T @ dq
    dx = dh + dq @ p["look"].T
    dx = dx.reshape(shape)
    dx += dxx[:, BLOCK:]
    dx[:-1] += dxx[1:, :BLOCK]
    cells = np.arange(p["embed"].size).reshape(-1, d).take(slots, axis=0)
    g["embed"] = np.bincount(cells.ravel(), weights=dx.ravel(), minlength=p["embed"].size).astype(np.float32).reshape(-1, d)
    return loss, g


def trained(p: dict[str, np.ndarray], vocab: Vocabulary, windows: list[np.ndarray], rate: float, batch: int = 32, least_steps: int = 1) -> tuple[dict[str, np.ndarray], float]:
    """Adam over windows of ids (a window's first id is input only): whole passes until least_steps are made."""
    flat = packed(p)
    p = unpacked(flat, p)
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    step, total = 0, 0.0
    passes = max(1, -(-least_steps // max(1, -(-len(windows) // batch))))
    count = max(1, passes * -(-len(windows) // batch))
    for _ in range(passes):
        for a in range(0, len(windows), batch):
            part = windows[a : a + batch]
            lengths = np.fromiter((len(w) - 1 for w in part), np.int64, len(part))
            at, begins = blocks_of(lengths)
            if not len(begins):
                continue
            slots = np.zeros(len(begins) * BLOCK, np.int64)
            ids = np.concatenate(part)
            ends = np.cumsum(lengths + 1)
            targets = np.delete(ids, ends - lengths - 1)
            slots[at] = vocab.slot.take(np.delete(ids, ends - 1))
            loss, g = _gradients(p, vocab, slots, vocab.group.take(targets), vocab.leaf.take(targets), at, begins)
            total += loss
            step += 1
            now = rate * min(1.0, step / 10) * (1.0 - 0.9 * step / (count + 1))
            g = packed(g)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            flat -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return p, total / max(1, step)


def packed(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in _NAMES])


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in _NAMES:
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32, copy=False)
        at += like[k].size
    return out
