"""A small causal self-attention model over subword ids, in numpy.

One layer reads the ids before a position and gives a distribution over classes of
ids; within its class an id has its smoothed share of the training counts.  Both
are proper distributions, so their product is one over all ids.

Where a softmax would raise e to a power, weights here are two to a power, linear
between whole powers: adding the exponent's offset and reading the bits of the whole number as a
float gives it in one step.  Scale and offset are folded into the products before
(a column of ones), as are biases and the sums that attention divides by.  The
gradient is that of the same function.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

WINDOW, STRIDE = 32, 26
PAD = 0xFFFFFFFF  # no id: what follows a document's end in its last window
WIDTH, SINGLES, GROUPS = 8, 24, 40
_UNIT, _ZERO = np.float32(1 << 23), np.float32(127 << 23)  # one power of two, and 2**0, in the bits of a float
_LOW, _HIGH = np.float32(87 << 23), np.float32(167 << 23)
_POWER = np.int32(0x7F800000)


def powers(x: np.ndarray) -> np.ndarray:
    """Two to (x / _UNIT - 127), linear between whole powers and held within 2**-40 and 2**40; x is changed."""
    return np.clip(x, _LOW, _HIGH, out=x).astype(np.int32).view(np.float32)


def _slopes(p: np.ndarray) -> np.ndarray:
    """Derivatives of `powers` by the exponent: the whole power below."""
    return (p.view(np.int32) & _POWER).view(np.float32)


@dataclass
class Model:
    """`embed` and `place` end in a column that makes ones; `out` ends in the row of biases."""

    embed: np.ndarray
    place: np.ndarray
    wq: np.ndarray
    wk: np.ndarray
    wv: np.ndarray
    wo: np.ndarray
    out: np.ndarray

    @classmethod
    def start(cls, vocab: int, prior: np.ndarray, width: int = WIDTH, seed: int = 11) -> Model:
        r = np.random.default_rng(seed)
        n = lambda *s, k=1.0: (r.normal(0, k / np.sqrt(s[0]), s)).astype(np.float32)
        embed, place = r.normal(0, 0.3, (vocab, width + 1)).astype(np.float32), r.normal(0, 0.1, (WINDOW, width + 1)).astype(np.float32)
        embed[:, -1], place[:, -1] = 1, 0
        return cls(embed, place, n(width, width), n(width, width), n(width, width), n(width, width, k=0.5), np.concatenate([n(width, len(prior), k=0.2), np.log2(prior)[None, :].astype(np.float32)]))

    def pack(self) -> bytes:
        return b"".join(getattr(self, f.name).tobytes() for f in fields(self))

    def unpack(self, data: bytes) -> Model:
        """Arrays of these shapes from the bytes of another model."""
        at, got = 0, []
        for f in fields(self):
            a = getattr(self, f.name)
            got.append(np.frombuffer(data, np.float32, a.size, at).reshape(a.shape).copy())
            at += a.nbytes
        return Model(*got)


_MASK = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def hidden(m: Model, ids: np.ndarray) -> tuple:
    """States after the layer for rows of ids, ending in ones, and what the backward pass needs."""
    b, n = ids.shape
    d = m.wq.shape[0]
    x = m.embed.take(ids, axis=0)
    x += m.place[:n]
    x = x.reshape(b * n, d + 1)
    ext = lambda w, scale, one: np.block([[w * scale, np.zeros((d, 1))], [np.zeros((1, d)), one]]).astype(np.float32)
    q = (x @ ext(m.wq, _UNIT / np.sqrt(d), _ZERO)).reshape(b, n, d + 1)
    k = (x @ ext(m.wk, 1, 1)).reshape(b, n, d + 1)
    v = (x @ ext(m.wv, 1, 1)).reshape(b, n, d + 1)
    a = powers(q @ k.transpose(0, 2, 1))
    a *= _MASK[:n, :n]
    s = a @ v
    s /= s[:, :, d:].copy()
    s = s.reshape(b * n, d + 1)
    z = s @ ext(m.wo, 1, 0)
    z += x
    return x, q, k, v, a, s, z


def _weights(m: Model, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes, and their sums."""
    w = m.out * _UNIT
    w[-1] += _ZERO
    p = powers(states @ w)
    return p, p @ np.ones(p.shape[1], np.float32)


def class_log(m: Model, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Natural log probability of each row's class."""
    p, total = _weights(m, states)
    return np.log(p.ravel()[np.arange(len(p)) * p.shape[1] + classes] / total)


def gradients(m: Model, ids: np.ndarray, classes: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss (in nats) over live positions and its gradients; of embed, a row for each of the ids given."""
    b, n = ids.shape
    d = m.wq.shape[0]
    x, q, k, v, a, s, z = hidden(m, ids)
    p, sums = _weights(m, z)
    count = np.float32(max(1, int(live.sum())))
    live = live.ravel()
    at = np.arange(b * n) * p.shape[1] + classes.ravel()
    own = p.ravel()[at]
    loss = float(-np.log(own / sums)[live].sum() / count)
    w = live / count
    g = _slopes(p)
    mine = g.ravel()[at] * (w / own)
    g *= (w / sums)[:, None]
    g.ravel()[at] -= mine
    out = {"out": z.T @ g}
    dz = g @ m.out.T
    dz[:, d] = 0
    ds = dz[:, :d] @ m.wo.T
    out["wo"] = s[:, :d].T @ dz[:, :d]
    dot = np.einsum("ij,ij->i", ds, s[:, :d])
    ds = np.concatenate([ds, -dot[:, None]], 1).reshape(b, n, d + 1)
    total = np.float32(1) / (a @ v[:, :, d:])
    ds *= total
    da = ds @ v.transpose(0, 2, 1)
    da *= _slopes(a)
    dv = (a.transpose(0, 2, 1) @ ds).reshape(b * n, d + 1)[:, :d]
    dq = (da @ k).reshape(b * n, d + 1)[:, :d]
    dk = (da.transpose(0, 2, 1) @ q).reshape(b * n, d + 1)[:, :d]
    up = np.float32(1 / np.sqrt(d))
    out |= {"wq": x[:, :d].T @ dq * up, "wk": x[:, :d].T @ dk / _UNIT, "wv": x[:, :d].T @ dv}
    dz[:, :d] += dq @ (m.wq.T * up)
    dz[:, :d] += dk @ (m.wk.T / _UNIT)
    dz[:, :d] += dv @ m.wv.T
    out["place"] = np.zeros_like(m.place)
    out["place"][:n] = dz.reshape(b, n, d + 1).sum(0)
    out["embed"] = dz
    return loss, out


class Trainer:
    """Adagrad on batches of windows, changing the model in place."""

    def __init__(self, m: Model, classes_of: np.ndarray, rate: float, end: int):
        self.m, self.classes_of, self.rate, self.end = m, classes_of, rate, end
        self.past = {f.name: np.full_like(getattr(m, f.name), 1e-6) for f in fields(m)}
        self.slot = np.zeros(len(classes_of), np.int64)

    def step(self, w: np.ndarray) -> float:
        """One batch: rows of WINDOW + 1 ids, PAD after a document's end."""
        live = w[:, 1:] != PAD
        w = np.where(w == PAD, self.end, w).astype(np.int64)
        ids = w[:, :-1]
        loss, g = gradients(self.m, ids, self.classes_of[w[:, 1:]], live)
        e, flat = g.pop("embed"), ids.ravel()
        seen = np.zeros(len(self.slot), bool)
        seen[flat] = True
        hit = np.flatnonzero(seen)
        self.slot[hit] = np.arange(len(hit))
        at = self.slot[flat]
        sums = np.stack([np.bincount(at, c, len(hit)) for c in e.T], 1).astype(np.float32)
        past = self.past["embed"][hit] + sums**2
        self.past["embed"][hit] = past
        self.m.embed[hit] -= np.float32(self.rate) * sums / np.sqrt(past)
        for name, d in g.items():
            self.past[name] += d**2
            getattr(self.m, name)[...] -= np.float32(self.rate) * d / np.sqrt(self.past[name])
        return loss


    def all(self, windows: np.ndarray, batch: int = 128) -> float:
        """Every window once, in the order given; the mean loss."""
        return float(np.mean([self.step(windows[i : i + batch]) for i in range(0, len(windows), batch)])) if len(windows) else 0.0


def train(m: Model, windows: np.ndarray, classes_of: np.ndarray, end: int, epochs: int = 1, rate: float = 0.05, seed: int = 3) -> float:
    """All windows in random order, `epochs` times; the last mean loss."""
    r, t, loss = np.random.default_rng(seed), Trainer(m, classes_of, rate, end), 0.0
    for _ in range(epochs):
        loss = t.all(windows[r.permutation(len(windows))])
    return loss


def windows_of(ids: np.ndarray, off: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Training windows, one after another, over documents (targets: the ids and an end): rows of WINDOW + 1 with PAD behind the last target."""
    n = np.diff(off)
    seq = np.insert(ids, off[:-1], begin).astype(np.uint32)
    first = off[:-1] + np.arange(len(n))
    k = -(-(n + 1) // WINDOW)
    doc = np.repeat(np.arange(len(n)), k)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)) * WINDOW
    seq = np.append(seq, np.zeros(WINDOW + 1, np.uint32))
    w = np.lib.stride_tricks.sliding_window_view(seq, WINDOW + 1)[first[doc] + at].copy()
    left = (n + 1)[doc] - at  # ids from here to the document's end, the start id counted
    tail = np.flatnonzero(left <= WINDOW)
    cols = np.arange(WINDOW + 1)[None, :]
    w[tail] = np.where(cols < left[tail][:, None], w[tail], np.where(cols == left[tail][:, None], end, PAD))
    return w


#: Context vectors have this many coordinates for the id before and as many for the one after.
MARKS = 16


def contexts(ids: np.ndarray, off: np.ndarray, vocab: int, seed: int = 9) -> np.ndarray:
    """For each id, how often each group of ids comes before and after it.  Counts of parts add up to the count of the whole."""
    mark = np.random.default_rng(seed).integers(0, MARKS, vocab)
    ids = ids.astype(np.int64)
    inner = np.ones(len(ids), bool)
    inner[off[:-1][off[:-1] < len(ids)]] = False
    right = np.flatnonzero(inner)
    out = np.bincount(ids[right] * (2 * MARKS) + mark[ids[right - 1]], minlength=vocab * 2 * MARKS)
    out += np.bincount(ids[right - 1] * (2 * MARKS) + MARKS + mark[ids[right]], minlength=vocab * 2 * MARKS)
    return out.reshape(vocab, 2 * MARKS)


def cluster(ctx: np.ndarray, counts: np.ndarray, singles: int = SINGLES, groups: int = GROUPS) -> np.ndarray:
    """A class for each id: the most frequent alone, the rest by what stands around them (contexts)."""
    vocab = len(counts)
    share = ctx.sum(0) / max(1, ctx.sum())
    ctx = np.sqrt(ctx) - np.sqrt(ctx.sum(1, keepdims=True) * share)
    norm = np.sqrt((ctx**2).sum(1, keepdims=True))
    ctx = ctx / np.maximum(norm, 1e-9)
    top = np.argsort(-counts, kind="stable")[:singles]
    rest = np.setdiff1d(np.arange(vocab), top)
    seen = rest[norm[rest, 0] > 0]
    out = np.zeros(vocab, np.int64)
    out[rest] = singles + rest % groups
    if len(seen) > groups:
        centre = ctx[seen[np.argsort(-counts[seen], kind="stable")[:groups]]].copy()
        for _ in range(12):
            near = (ctx[seen] @ centre.T).argmax(1)
            for c in range(groups):
                own = near == c
                if own.any():
                    mean = (ctx[seen[own]] * np.sqrt(1 + counts[seen[own]])[:, None]).sum(0)
                    centre[c] = mean / max(1e-9, float(np.sqrt((mean**2).sum())))
        out[seen] = singles + near
    out[top] = np.arange(len(top))
    return out


def placed(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over documents of these token offsets (targets of a document: its ids and an end): first input, length, and the first position that each scores.

    Every target is scored once, by the window in which it has most context.
    """
    targets = np.diff(off)
    extra = np.maximum(0, -(-(targets - WINDOW) // STRIDE))
    n = extra + 1
    doc = np.repeat(np.arange(len(targets)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    begin = k * STRIDE
    length = np.minimum(WINDOW, targets[doc] - begin)
    fresh = np.where(k == 0, 0, WINDOW - STRIDE)
    return off[:-1][doc] + begin, length, fresh


def score(m: Model, classes_of: np.ndarray, inside: np.ndarray, ids: np.ndarray, off: np.ndarray, end: int, chunk: int = 256) -> np.ndarray:
    """log10 probability of each document, given all inputs laid out with a start id before each document (`off` counts those).

    Windows shorter than WINDOW run with ids of the next document behind them, which the mask keeps from what is scored.
    """
    if len(off) < 2:
        return np.zeros(0)
    nxt = np.append(ids[1:], end)
    nxt[off[1:] - 1] = end
    begin, length, fresh = placed(off)
    got = inside[nxt]
    cls = classes_of[nxt]
    view = np.lib.stride_tricks.sliding_window_view(np.append(ids, np.full(WINDOW, end, ids.dtype)), WINDOW)
    cols = np.arange(WINDOW)[None, :]
    for i in range(0, len(begin), chunk):
        w = slice(i, i + chunk)
        z = hidden(m, view[begin[w]])[-1]
        take = ((cols >= fresh[w][:, None]) & (cols < length[w][:, None])).ravel()
        to = (begin[w][:, None] + cols).ravel()[take]
        got[to] += class_log(m, z[take], cls[to])
    return np.add.reduceat(got, off[:-1]) / np.log(10)
