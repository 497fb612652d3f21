"""A gated recurrent network over word ids in numpy, with a class-factored softmax.

The probability of a word is that of its class times that of the word within the class; classes hold equally many words,
so both factors are small softmaxes.  Training is truncated backpropagation through windows of a few steps; scoring
carries the state across windows, so a document's log-likelihood covers all of it.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import numpy as np

#: Marks a place of a stream without a token.
NOTHING = -1
WINDOW = 16
#: Streams that are trained side by side.
WIDTH = 512
SCORE_WINDOW = 32
#: Tokens through which the state is carried in training.
SEGMENT = 256


@dataclass
class Weights:
    """``x``: gate inputs of each word (update, reset, candidate); ``h``: gate inputs of the state; then the classes and the words in each class."""

    x: np.ndarray
    h: np.ndarray
    class_w: np.ndarray
    class_b: np.ndarray
    word_w: np.ndarray
    word_b: np.ndarray

    def items(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def pack(self) -> bytes:
        return np.concatenate([a.ravel() for a in self.items()]).astype("<f4").tobytes()

    def unpack(self, data: bytes) -> Weights:
        """Weights of the same shapes from what ``pack`` gave."""
        flat, at, out = np.frombuffer(data, "<f4"), 0, {}
        for f in fields(self):
            shape = getattr(self, f.name).shape
            size = int(np.prod(shape))
            out[f.name], at = flat[at : at + size].reshape(shape).copy(), at + size
        return Weights(**out)

    @property
    def hidden(self) -> int:
        return self.h.shape[0]

    @property
    def class_size(self) -> int:
        return self.word_b.shape[1]


def initial(counts: np.ndarray, classes: int, class_size: int, hidden: int, seed: int = 7) -> Weights:
    """Small random weights whose biases give each word its smoothed share of ``counts`` (one for each word id)."""
    rng = np.random.default_rng(seed)
    share = np.zeros(classes * class_size)
    share[: len(counts)] = counts + 0.5
    share = np.maximum(share, 1e-4).reshape(classes, class_size)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return Weights(
        x=small(classes * class_size, 3 * hidden),
        h=small(hidden, 3 * hidden),
        class_w=small(hidden, classes),
        class_b=np.log(share.sum(axis=1) / share.sum()).astype(np.float32),
        word_w=small(classes, hidden, class_size),
        word_b=np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32),
    )


def sigmoid(a: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-a)), in place."""
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += 1
    return np.reciprocal(a, out=a)


def step(w: Weights, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The state after tokens with the gate inputs ``x``, and what backpropagation needs."""
    n = w.hidden
    a = h @ w.h
    gates = sigmoid(x[:, : 2 * n] + a[:, : 2 * n])
    z, r = gates[:, :n], gates[:, n:]
    c = r * a[:, 2 * n :]
    c += x[:, 2 * n :]
    np.tanh(c, out=c)
    after = h - c
    after *= z
    after += c
    return after, (h, z, r, c, a[:, 2 * n :])


def log_softmax(a: np.ndarray, bounded: bool) -> np.ndarray:
    """The log softmax of the rows, in place; rows whose values are ``bounded`` need no shift."""
    if not bounded:
        a -= a.max(axis=1, keepdims=True)
    a -= np.log(np.exp(a).sum(axis=1, keepdims=True))
    return a


def within_bounds(w: Weights) -> bool:
    """Whether no value of which an exponential is taken can be large: states lie between -1 and 1, so weights bound them."""
    return max(np.abs(w.class_w).sum(axis=0).max() + np.abs(w.class_b).max(), np.abs(w.word_w).sum(axis=1).max() + np.abs(w.word_b).max()) < 60


def by_class(tokens: np.ndarray, class_size: int, classes: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """An order that puts the tokens of a class side by side, and the stretch of every class that occurs."""
    group = (tokens // class_size).astype(np.int16)  # short keys are sorted by counting
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(classes + 1)).tolist()
    return order, [(k, slice(ends[k], ends[k + 1])) for k in range(classes) if ends[k] < ends[k + 1]]


def word_values(w: Weights, states: np.ndarray, stretches: list[tuple[int, slice]]) -> np.ndarray:
    """What the words of each state's class get before the softmax; states stand by class."""
    out = np.empty((len(states), w.class_size), states.dtype)
    for k, at in stretches:
        np.matmul(states[at], w.word_w[k], out=out[at])
        out[at] += w.word_b[k]
    return out


def log_share(a: np.ndarray, own: np.ndarray, bounded: bool) -> np.ndarray:
    """The log softmax of one column of each row; ``a`` is used up."""
    if not bounded:
        a -= a.max(axis=1, keepdims=True)
    chosen = a[np.arange(len(own)), own]
    return chosen - np.log(np.exp(a, out=a).sum(axis=1))


def log_likelihood(w: Weights, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Natural log probability of each token given the state before it."""
    size, bounded = w.class_size, within_bounds(w)
    order, stretches = by_class(tokens, size, w.class_b.shape[0])
    states, tokens = states[order], tokens[order]
    out = np.empty(len(tokens), states.dtype)
    out[order] = log_share(states @ w.class_w + w.class_b, tokens // size, bounded) + log_share(word_values(w, states, stretches), tokens % size, bounded)
    return out


def columns_of(documents: list[np.ndarray], start: int, steps: int) -> np.ndarray:
    """Tokens start..start + steps of every document, as steps x documents (0 where a document has ended)."""
    table = np.zeros((len(documents), steps), dtype=np.int64)
    for row, tokens in enumerate(documents):
        part = tokens[start : start + steps]
        table[row, : len(part)] = part
    return np.ascontiguousarray(table.T)


def score(w: Weights, documents: list[np.ndarray], together: int = 1024) -> np.ndarray:
    """Natural log probability of every whole document; documents of like length run side by side."""
    out = np.zeros(len(documents))
    order = np.argsort([-len(d) for d in documents], kind="stable")
    for first in range(0, len(order), together):
        group = order[first : first + together]
        own = [documents[i] for i in group.tolist()]
        sizes = np.array([len(d) for d in own])
        h = np.zeros((len(group), w.hidden), np.float32)
        for start in range(0, int(sizes[0]), SCORE_WINDOW):
            live = int(np.searchsorted(-sizes, -start, side="left"))  # sizes descend: those with more than ``start`` tokens
            steps = min(SCORE_WINDOW, int(sizes[0]) - start)
            tokens, h, states = columns_of(own[:live], start, steps), h[:live], []
            inputs = w.x[tokens]
            for now in inputs:  # a document that ends within the window runs on to its end, uncounted
                states.append(h)
                h, _ = step(w, h, now)
            there = np.arange(start, start + steps)[:, None] < sizes[None, :live]
            found = log_likelihood(w, np.concatenate(states)[there.ravel()], tokens[there])
            out[group] += np.bincount(np.nonzero(there)[1], found, minlength=len(group))
    return out


def gradients(w: Weights, h0: np.ndarray, window: np.ndarray, end: int) -> tuple[float, Weights, np.ndarray]:
    """Loss per token, its gradients, and the state after a window (steps x streams).

    The state of a stream starts anew after the ``end`` token and after NOTHING, which is not counted.
    """
    steps, n = window.shape[0], w.hidden
    there = window != NOTHING
    words = np.where(there, window, 0)
    inputs = w.x[words]
    goes_on = (there & (window != end)).astype(np.float32)[:, :, None]
    h, kept, states = h0, [], []
    for t in range(steps):
        states.append(h)
        after, memory = step(w, h, inputs[t])
        kept.append(memory)
        h = after * goes_on[t]
    flat_h, flat, count = np.concatenate(states), words.reshape(-1), there.reshape(-1)
    whole = count.all()
    used, tokens = (flat_h, flat) if whole else (flat_h[count], flat[count])
    size, classes, m, bounded = w.class_size, w.class_b.shape[0], max(len(tokens), 1), within_bounds(w)
    order, stretches = by_class(tokens, size, classes)
    used, tokens, at = used[order], tokens[order], np.arange(len(tokens))
    loss, shares = 0.0, []
    for values, own in ((used @ w.class_w + w.class_b, tokens // size), (word_values(w, used, stretches), tokens % size)):
        p = log_softmax(values, bounded)
        loss -= float(p[at, own].sum())
        np.exp(p, out=p)
        p[at, own] -= 1
        p /= m
        shares.append(p)
    p, q = shares
    d_sorted = p @ w.class_w.T
    grad = replace(w, x=np.zeros_like(w.x), h=np.zeros_like(w.h), class_w=used.T @ p, class_b=p.sum(axis=0), word_w=np.zeros_like(w.word_w), word_b=np.zeros_like(w.word_b))
    for k, own in stretches:
        grad.word_w[k], grad.word_b[k] = used[own].T @ q[own], q[own].sum(axis=0)
        d_sorted[own] += q[own] @ w.word_w[k].T
    d_used = np.empty_like(d_sorted)
    d_used[order] = d_sorted
    if whole:
        d_states = d_used.reshape(steps, -1, n)
    else:
        d_states = np.zeros_like(flat_h)
        d_states[count] = d_used
        d_states = d_states.reshape(steps, -1, n)
    d_h = np.zeros_like(h0)
    d_x = np.empty((steps, h0.shape[0], 3 * n), flat_h.dtype)
    d_a = np.empty((h0.shape[0], 3 * n), flat_h.dtype)
    for t in range(steps - 1, -1, -1):
        before, z, r, c, a = kept[t]
        d = d_h * goes_on[t]
        d_z, d_r, d_c = d_x[t, :, :n], d_x[t, :, n : 2 * n], d_x[t, :, 2 * n :]
        np.multiply(d, (1 - z) * (1 - c * c), out=d_c)
        np.multiply(d, (before - c) * (z * (1 - z)), out=d_z)
        np.multiply(d_c, a * (r * (1 - r)), out=d_r)
        d_a[:, : 2 * n] = d_x[t, :, : 2 * n]
        np.multiply(d_c, r, out=d_a[:, 2 * n :])
        grad.h += before.T @ d_a
        d *= z
        d += d_a @ w.h.T
        d += d_states[t]
        d_h = d
    # the rows of a word side by side, and one sum for each word
    order = np.argsort(flat.astype(np.uint16 if len(w.x) <= 1 << 16 else np.int64), kind="stable")
    rows, first = np.unique(flat[order], return_index=True)
    grad.x[rows] = np.add.reduceat(d_x.reshape(len(flat), -1)[order], first, axis=0)
    return loss / m, grad, h


class Adam:
    """First and second moments of the gradients, clipped to a norm."""

    def __init__(self, w: Weights, rate: float, clip: float = 1.0):
        self.rate, self.clip, self.t = rate, clip, 0
        self.m, self.v = [np.zeros_like(a) for a in w.items()], [np.zeros_like(a) for a in w.items()]

    def update(self, w: Weights, grad: Weights) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grad.items())))
        scale = np.float32(min(1.0, self.clip / max(norm, 1e-9)))
        rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t))
        for a, g, m, v in zip(w.items(), grad.items(), self.m, self.v, strict=True):
            g = g * scale
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            a -= rate * m / (np.sqrt(v) + np.float32(1e-8))


def streams(documents: list[np.ndarray], n: int, seed: int = 13) -> np.ndarray:
    """Segments of the documents in a shuffled order, dealt to ``n`` streams of like length, as steps x streams.

    Long documents are cut, so that no stream runs on alone; NOTHING follows a cut and fills up the ends.
    """
    gap = np.array([NOTHING])
    parts = [p for d in documents for k in range(0, len(d), SEGMENT) for p in [d[k : k + SEGMENT] if k + SEGMENT >= len(d) else np.concatenate([d[k : k + SEGMENT], gap])]]
    total = sum(map(len, parts))
    n = max(1, min(n, total // (2 * SEGMENT)))
    flat = np.concatenate([np.zeros(0, np.int64), *[parts[k] for k in np.random.default_rng(seed).permutation(len(parts))]])
    steps = -(-total // n)
    table = np.full(steps * n, NOTHING, dtype=np.int64)
    table[:total] = flat
    return np.ascontiguousarray(table.reshape(n, steps).T)


def train(w: Weights, documents: list[np.ndarray], end: int, optimizer: Adam, width: int = WIDTH, window: int = WINDOW) -> float:
    """One pass over the documents (each ending in ``end``), changing the weights in place; the mean loss per token."""
    if not documents:
        return 0.0
    table = streams(documents, width)
    h, total, n = np.zeros((table.shape[1], w.hidden), np.float32), 0.0, 0
    for start in range(0, len(table), window):
        part = table[start : start + window]
        loss, grad, h = gradients(w, h, part, end)
        optimizer.update(w, grad)
        count = int((part != NOTHING).sum())
        total, n = total + loss * count, n + count
    return total / max(n, 1)
