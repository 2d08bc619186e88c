"""A gated recurrent language model in numpy: one layer, factored softmax, truncated backpropagation through time.

The probability of a token is that of its class given the state, times its own within the class; tokens of a class are
numbered one after the other. The input is a token's row of gate inputs (an embedding with its projection folded in).
With output weights of 0 the model is a unigram model, by its biases; that is where training begins.

Documents run side by side in lanes, end to end, the longest first; lanes are sorted by length, so that those still
running at a step are the first few. State is carried from window to window and reset where a document begins, so a
document's log-likelihood is complete, however long it is; gradients stop at a window's beginning.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

F4 = np.float32
#: Lanes at most, steps of a window when scoring and when training, tokens of a piece when training.
LANES, WINDOW, BACK, PIECE = 512, 64, 32, 1024


class Shape(NamedTuple):
    """hidden: the state's width; first: the number of each class's first token, and the number of tokens at the end."""

    hidden: int
    first: np.ndarray

    @property
    def tokens(self) -> int:
        return int(self.first[-1])

    @property
    def classes(self) -> int:
        return len(self.first) - 1


def class_cuts(mass: np.ndarray, classes: int) -> np.ndarray:
    """Cuts of tokens in falling order of mass into classes of about equal sums of roots: frequent tokens have small classes."""
    part = np.cumsum(np.sqrt(mass))
    cut = np.searchsorted(part, part[-1] * np.arange(1, classes) / classes, side="left") + 1
    return np.unique(np.concatenate([[0], np.minimum(cut, len(mass)), [len(mass)]]))


def start(mass: np.ndarray, shape: Shape, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters of a model that gives each token its share of mass, whatever came before: those of the gates (update, then
    reset) and of the candidate by input (x), state (u) and bias (b), and those of classes (wc, bc) and tokens (wo, bo)."""
    r, h = np.random.default_rng(seed), shape.hidden
    of = np.add.reduceat(mass.astype(float), shape.first[:-1])
    own = np.log(mass / np.repeat(of, np.diff(shape.first)))
    return {
        "xg": r.normal(0, 0.3, (shape.tokens, 2 * h)).astype(F4),
        "xn": r.normal(0, 0.3, (shape.tokens, h)).astype(F4),
        "ug": r.normal(0, h**-0.5, (h, 2 * h)).astype(F4),
        "un": r.normal(0, h**-0.5, (h, h)).astype(F4),
        "bg": np.repeat([1.0, 0.0], h).astype(F4),  # the update gate begins by keeping
        "bn": np.zeros(h, F4),
        "wc": np.zeros((h, shape.classes), F4),
        "bc": np.log(of / of.sum()).astype(F4),
        "wo": np.zeros((shape.tokens, h), F4),
        "bo": own.astype(F4),
    }


class Lanes(NamedTuple):
    """target, input (steps, lanes), begins (whether a document does) and doc; live: lanes that run at each step."""

    target: np.ndarray
    input: np.ndarray
    begins: np.ndarray
    doc: np.ndarray
    live: np.ndarray


def lanes_of(docs: Sequence[np.ndarray], before: Sequence[int] | None = None, lanes: int = LANES) -> Lanes:
    """docs: each a document's tokens with its end token last; that is also what stands before its first one, unless given."""
    n = max(1, min(lanes, len(docs)))
    load = [(0, i) for i in range(n)]
    placed = []
    for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
        at, lane = heapq.heappop(load)
        placed.append((d, lane, at))
        heapq.heappush(load, (at + len(docs[d]), lane))
    length = np.zeros(n, np.int64)
    for at, lane in load:
        length[lane] = at
    order = np.argsort(-length, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    steps = int(length.max())
    target, input_, doc = (np.zeros((steps, n), np.int32) for _ in range(3))
    begins = np.zeros((steps, n), bool)
    for d, lane, at in placed:
        to, k = at + len(docs[d]), rank[lane]
        target[at:to, k] = docs[d]
        input_[at + 1 : to, k] = docs[d][:-1]
        input_[at, k] = docs[d][-1] if before is None else before[d]
        doc[at:to, k] = d
        begins[at, k] = True
    return Lanes(target, input_, begins, doc, (length[:, None] > np.arange(steps)[None, :]).sum(axis=0))


def _fresh(state: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The state as the lanes that still run go on with it: nothing where a document begins."""
    state = state[: len(begins)]
    if begins.any():
        state = state.copy()
        state[begins] = 0
    return state


def _step(gates: np.ndarray, new: np.ndarray, p: dict[str, np.ndarray], state: np.ndarray) -> tuple[np.ndarray, ...]:
    """(next state, gates z and r, candidate, its recurrent part) from the inputs of both, which are used up."""
    h = state.shape[1]
    gates += state @ p["ug"]
    np.negative(gates, out=gates)
    np.exp(gates, out=gates)
    gates += F4(1)
    np.reciprocal(gates, out=gates)
    z, r, gc = gates[:, :h], gates[:, h:], state @ p["un"]
    c = r * gc
    c += new
    np.tanh(c, out=c)
    out = state - c
    out *= z
    out += c
    return out, z, r, c, gc


def _exponents(a: np.ndarray, bound: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """exp of a, each row's sum; a row's greatest is taken off where it could overflow (from a as well). No number is above bound."""
    if bound > 60 and a.max(initial=0) > 60:
        a -= a.max(axis=1, keepdims=True)
    e = np.exp(a)
    return e, e @ np.ones(a.shape[1], a.dtype)


def outputs(p: dict[str, np.ndarray], shape: Shape, state: np.ndarray, target: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(log probability of each target, gradient of their negative sum by the state); grads gets those by the parameters."""
    cls = np.repeat(np.arange(shape.classes, dtype=np.int16), np.diff(shape.first))[target]
    most = float(np.abs(state).max(initial=0)) * 1.01
    a = state @ p["wc"]
    a += p["bc"]
    e, total = _exponents(a, (np.abs(p["wc"]).sum(axis=0) * most + p["bc"]).max())
    bounds = np.maximum.reduceat(np.abs(p["wo"]).sum(axis=1) * most + p["bo"], shape.first[:-1])
    at = np.arange(len(target))
    out = (a[at, cls] - np.log(total)).astype(np.float64)
    back = None
    if grads is not None:
        e /= total[:, None]
        e[at, cls] -= 1
        grads["wc"] = state.T @ e
        grads["bc"] = np.ones(len(e), e.dtype) @ e
        back = e @ p["wc"].T
        grads["wo"], grads["bo"] = np.zeros_like(p["wo"]), np.zeros_like(p["bo"])
    order = np.argsort(cls, kind="stable")
    ends = np.searchsorted(cls[order], np.arange(shape.classes + 1))
    own, place = state[order], target[order] - shape.first[cls[order]]
    for c in range(shape.classes):
        lo, hi, s, t = shape.first[c], shape.first[c + 1], ends[c], ends[c + 1]
        if s == t or hi - lo == 1:
            continue
        w = p["wo"][lo:hi]
        a = own[s:t] @ w.T
        a += p["bo"][lo:hi]
        e, total = _exponents(a, bounds[c])
        k = (np.arange(t - s), place[s:t])
        out[order[s:t]] += a[k] - np.log(total)
        if grads is not None:
            e /= total[:, None]
            e[k] -= 1
            grads["wo"][lo:hi] = e.T @ own[s:t]
            grads["bo"][lo:hi] = np.ones(len(e), e.dtype) @ e
            back[order[s:t]] += e @ w
    return out, back


@np.errstate(over="ignore")  # a gate's exp may be infinite: the gate is 0 then
def score(p: dict[str, np.ndarray], shape: Shape, docs: Sequence[np.ndarray]) -> np.ndarray:
    """The natural log-likelihood of each document, complete."""
    total = np.zeros(len(docs))
    if not len(docs):
        return total
    run = lanes_of(docs)
    xg, xn = p["xg"] + p["bg"], p["xn"] + p["bn"]
    state = np.zeros((run.target.shape[1], shape.hidden), F4)
    for t0 in range(0, len(run.live), WINDOW):
        steps = range(t0, min(t0 + WINDOW, len(run.live)))
        kept = []
        for t in steps:
            n = run.live[t]
            token = run.input[t, :n]
            state = _step(xg.take(token, axis=0), xn.take(token, axis=0), p, _fresh(state, run.begins[t, :n]))[0]
            kept.append(state)
        pick = [(t, slice(0, run.live[t])) for t in steps]
        got, _ = outputs(p, shape, np.concatenate(kept), np.concatenate([run.target[i] for i in pick]))
        total += np.bincount(np.concatenate([run.doc[i] for i in pick]), got, len(docs))
    return total


def _descend(p: dict[str, np.ndarray], seen: dict[str, np.ndarray], name: str, g: np.ndarray, rate: float, rows: np.ndarray | slice = slice(None)) -> None:
    """A step by the gradient over the root of the sum of its squares (Adagrad)."""
    s = seen[name][rows] + g * g
    seen[name][rows] = s
    p[name][rows] -= F4(rate) * g / np.sqrt(s)


@np.errstate(over="ignore")
def train(p: dict[str, np.ndarray], seen: dict[str, np.ndarray], shape: Shape, docs: Sequence[np.ndarray], rate: float = 0.1) -> None:
    """One pass over docs, window by window, in place; seen has the sums of squared gradients.

    Long documents are learned in pieces of PIECE tokens side by side, each after the token before it."""
    before = [d[i - 1] for d in docs for i in range(0, len(d), PIECE)]
    docs = [d[i : i + PIECE] for d in docs for i in range(0, len(d), PIECE)]
    if not len(docs):
        return
    run, h = lanes_of(docs, before), shape.hidden
    state = np.zeros((run.target.shape[1], h), F4)
    for t0 in range(0, len(run.live), BACK):
        steps = list(range(t0, min(t0 + BACK, len(run.live))))
        kept = []
        for t in steps:
            n = run.live[t]
            old = _fresh(state, run.begins[t, :n])
            token = run.input[t, :n]
            state, *rest = _step(p["xg"].take(token, axis=0) + p["bg"], p["xn"].take(token, axis=0) + p["bn"], p, old)
            kept.append((old, state, *rest))
        pick = [(t, slice(0, run.live[t])) for t in steps]
        g: dict[str, np.ndarray] = {}
        token = np.concatenate([run.input[i] for i in pick])
        scale = F4(1 / len(token))
        _, back = outputs(p, shape, np.concatenate([k[1] for k in kept]), np.concatenate([run.target[i] for i in pick]), g)
        at = np.concatenate([[0], np.cumsum([run.live[t] for t in steps])])
        old, _, z, r, c, gc = (np.concatenate(x) for x in zip(*kept, strict=True))
        # what the state's gradient is multiplied by for the candidate's input, its recurrent part, and the gates
        by = (1 - z) * (1 - c * c)
        recurrent = by * r
        gates = np.empty((len(token), 2, h), F4)
        np.multiply(by * gc, r * (1 - r), out=gates[:, 1])
        np.multiply((old - c) * z, 1 - z, out=gates[:, 0])
        later, utg, utn = np.zeros((0, h), F4), np.ascontiguousarray(p["ug"].T), np.ascontiguousarray(p["un"].T)
        for j in range(len(steps) - 1, -1, -1):
            lo, hi = at[j], at[j + 1]
            d = back[lo:hi]
            d[: len(later)] += later
            gates[lo:hi] *= d[:, None, :]
            recurrent[lo:hi] *= d
            later = gates[lo:hi].reshape(hi - lo, 2 * h) @ utg
            later += recurrent[lo:hi] @ utn
            later += d * z[lo:hi]
            begins = run.begins[steps[j], : hi - lo]
            if begins.any():
                later[begins] = 0
        dn, dg = by * back, gates.reshape(len(token), 2 * h)
        g |= {"ug": old.T @ dg, "un": old.T @ recurrent, "bg": np.ones(len(dg), dg.dtype) @ dg, "bn": np.ones(len(dn), dn.dtype) @ dn}
        order = np.argsort(token.astype(np.uint16) if shape.tokens < 1 << 16 else token, kind="stable")
        sorted_ = token[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        for name, grad in g.items():
            _descend(p, seen, name, grad * scale, rate)
        for name, grad in (("xg", dg), ("xn", dn)):
            _descend(p, seen, name, np.add.reduceat(grad[order], first, axis=0) * scale, rate, sorted_[first])


def unseen(p: dict[str, np.ndarray], least: float = 1e-6) -> dict[str, np.ndarray]:
    """Sums of squared gradients to begin with."""
    return {k: np.full_like(v, least) for k, v in p.items()}
