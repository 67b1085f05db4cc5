"""A gated recurrent language model in numpy, with a class-factored softmax and truncated backpropagation.

Documents lie end to end in lanes; a lane is read window by window and its state is carried from one window to the
next, and set to zero where a document begins.  Gradients reach back to the beginning of the window.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

HIDDEN, EMBED, CLASSES, PER_CLASS = 24, 16, 32, 64
SIZE = CLASSES * PER_CLASS
WINDOW = 32
#: Rows whose outputs stay in a core's cache, and rows that are scored together.
ROWS, TOGETHER = 1024, 1 << 14

Params = dict[str, np.ndarray]


def initial(counts: np.ndarray, seed: int = 7) -> Params:
    """Small random weights; output biases at the log of the symbols' frequencies (counts: SIZE numbers)."""
    r = np.random.default_rng(seed)
    w = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
    p = ((counts + 0.5) / (counts.sum() + 0.5 * SIZE)).reshape(CLASSES, PER_CLASS)
    by_class = p.sum(axis=1)
    return {
        "emb": w(SIZE, EMBED) * 3, "wx": w(EMBED, 3 * HIDDEN) * 3, "bx": np.zeros(3 * HIDDEN, np.float32), "wh": w(HIDDEN, 3 * HIDDEN) * 2, "bn": np.zeros(HIDDEN, np.float32),
        "wc": w(HIDDEN, CLASSES) * 0.1, "bc": np.log(by_class).astype(np.float32), "ww": w(CLASSES, HIDDEN, PER_CLASS) * 0.1, "bw": np.log(p / by_class[:, None]).astype(np.float32),
    }


@dataclass
class Lanes:
    """Documents in lanes: symbol to predict, symbol before it, whether a document begins, and the document (-1: none)."""

    target: np.ndarray
    before: np.ndarray
    begins: np.ndarray
    doc: np.ndarray


def lanes(symbols: np.ndarray, first: np.ndarray, end_symbol: int, width: int) -> Lanes:
    """symbols of all documents one after another; first: where each begins, and the end."""
    length = np.diff(first)
    width = max(1, min(width, len(length)))
    free = [(0, k) for k in range(width)]
    at = np.zeros(len(length), np.int64)
    lane = np.zeros(len(length), np.int64)
    for d in np.argsort(-length, kind="stable").tolist():
        begin, k = free[0]
        at[d], lane[d] = begin, k
        heapq.heapreplace(free, (begin + int(length[d]), k))
    steps = max(b for b, _ in free)
    target = np.zeros((steps, width), np.int32)
    before, doc = np.full((steps, width), end_symbol, np.int32), np.full((steps, width), -1, np.int32)
    begins = np.zeros((steps, width), bool)
    for d in range(len(length)):
        s, n, k = at[d], length[d], lane[d]
        own = symbols[first[d] : first[d + 1]]
        target[s : s + n, k] = own
        before[s + 1 : s + n, k] = own[:-1]
        doc[s : s + n, k] = d
        begins[s, k] = True
    return Lanes(target, before, begins, doc)


class _Space:
    """Memory by name that one window after another takes, so that it is not fetched anew for each."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def of(self, name: str, dtype: np.dtype, *shape: int) -> np.ndarray:
        n = math.prod(shape)
        if name not in self.held or self.held[name].size < n or self.held[name].dtype != dtype:
            self.held[name] = np.empty(n, dtype)
        return self.held[name][:n].reshape(shape)


def _inputs(p: Params, before: np.ndarray, space: _Space) -> tuple[np.ndarray, np.ndarray]:
    """(embeddings of the symbols before and a one, what they say to the gates: a row of lanes for each step and input).

    A gate is 1 / (1 + exp(-x)), so the inputs of the gates are negated once.
    """
    (steps, width), dtype = before.shape, p["wx"].dtype
    emb = space.of("emb", dtype, SIZE, EMBED + 1)
    emb[:, :-1], emb[:, -1] = p["emb"], 1
    wx = np.concatenate([p["wx"], p["bx"][None]])
    wx[:, : 2 * HIDDEN] *= -1
    said = np.take(emb, before, axis=0, out=space.of("said", dtype, steps, width, EMBED + 1), mode="clip")
    return said, np.matmul(wx.T, said.transpose(0, 2, 1), out=space.of("x", dtype, steps, 3 * HIDDEN, width))


def _forward(p: Params, x: np.ndarray, begins: np.ndarray, h: np.ndarray, keep: bool, space: _Space):
    """(states before the first step and after each, what the way back needs), each of them with a row of lanes for a unit."""
    steps, width = begins.shape
    k = HIDDEN
    states = space.of("states", x.dtype, steps + 1, k, width)
    states[0] = h
    # of each step: both gates, the candidate's recurrent part and the candidate
    held = [space.of(name, x.dtype, steps if keep else 1, n, width) for name, n in (("zr", 2 * k), ("un", k), ("n", k))]
    wh = p["wh"].T.copy()
    wh[: 2 * k] *= -1
    bn, u, going = p["bn"][:, None], space.of("u", x.dtype, 3 * k, width), ~begins
    gates_said, candidate_said = u[: 2 * k], u[2 * k :]
    with np.errstate(over="ignore"):  # a gate at infinity is shut
        for t, new in enumerate(begins.any(axis=1).tolist()):
            h = states[t] * going[t] if new else states[t]
            zr, un, n = (a[t if keep else 0] for a in held)
            said, step = x[t], states[t + 1]
            np.matmul(wh, h, out=u)
            np.add(gates_said, said[: 2 * k], out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.add(candidate_said, bn, out=un)
            np.multiply(zr[k:], un, out=n)
            n += said[2 * k :]
            np.tanh(n, out=n)
            np.subtract(h, n, out=step)
            step *= zr[:k]
            step += n
    return states, held


def _by_place(states: np.ndarray, places: np.ndarray, space: _Space, out: np.ndarray | None = None) -> np.ndarray:
    """The states at some places, a row for each, with a one behind the units for the biases."""
    steps, k, width = states.shape
    rows = space.of("rows", states.dtype, steps - 1, width, k + 1)
    rows[:, :, :k], rows[:, :, k] = states[1:].transpose(0, 2, 1), 1
    return np.take(rows.reshape(-1, k + 1), places, axis=0, out=out, mode="clip")


class _Outputs:
    """Both softmaxes over rows of states that are sorted by class; the biases are the weights' last row."""

    def __init__(self, p: Params, space: _Space):
        k, dtype = HIDDEN, p["ww"].dtype
        self.space, self.classes = space, np.concatenate([p["wc"], p["bc"][None]])
        self.words = space.of("words", dtype, CLASSES, k + 1, PER_CLASS)
        self.words[:, :k], self.words[:, k] = p["ww"], p["bw"]
        # states are within 1, so no output is over the sum of its weights
        sizes = np.abs(self.words, out=space.of("sizes", dtype, *self.words.shape)).sum(axis=1)
        self.wide = bool(max(sizes.max(), np.abs(self.classes).sum(axis=0).max()) > 60)

    def _rows(self, n: int, columns: int) -> np.ndarray:
        return self.space.of("outputs", self.words.dtype, n, columns)

    def of_classes(self, rows: np.ndarray) -> np.ndarray:
        """Unnormalised logarithms of the classes' shares, in memory that the next call takes."""
        return self._bounded(np.matmul(rows, self.classes, out=self._rows(len(rows), CLASSES)))

    def of_words(self, rows: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
        """The same of the words of each row's class; spans: (class, from, to) of the rows."""
        x = self._rows(len(rows), PER_CLASS)
        for c, a, b in spans:
            np.matmul(rows[a:b], self.words[c], out=x[a:b])
        return self._bounded(x)

    def _bounded(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(x, 60, out=x) if self.wide else x  # exp stays finite


def _sorted_kinds(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by class, the classes in that order)."""
    kind = (target // PER_CLASS).astype(np.int16)
    order = np.argsort(kind, kind="stable")
    return order, kind[order]


def _blocks(kind: np.ndarray) -> Iterator[tuple[slice, list[tuple[int, int, int]]]]:
    """Blocks of ROWS rows of sorted classes, each with the (class, from, to) within it."""
    edges = np.searchsorted(kind, np.arange(CLASSES + 1)).tolist()
    for a in range(0, len(kind), ROWS):
        b = min(a + ROWS, len(kind))
        cut = [(c, max(edges[c] - a, 0), min(edges[c + 1], b) - a) for c in range(kind[a], kind[b - 1] + 1)]
        yield slice(a, b), [x for x in cut if x[1] < x[2]]


def _log_share(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The log softmax of each row at its chosen column."""
    at = x[np.arange(len(x)), chosen]
    return at - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], x.dtype))


def _misses(x: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(softmax of each row less one at its chosen column, the share that the chosen one has)."""
    np.exp(x, out=x)
    x *= (1 / (x @ np.ones(x.shape[1], x.dtype)))[:, None]
    at = (np.arange(len(x)), chosen)
    share = x[at]
    x[at] = share - 1
    return x, share


def _scores(outputs: _Outputs, flat: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The log probability of each target after its state."""
    # by class, so that a class's words are one product
    order, kind = _sorted_kinds(target)
    flat, word, out = flat[order], target[order] % PER_CLASS, np.empty(len(flat), flat.dtype)
    for own, spans in _blocks(kind):
        score = _log_share(outputs.of_classes(flat[own]), kind[own])
        score += _log_share(outputs.of_words(flat[own], spans), word[own])
        out[order[own]] = score
    return out


def log_likelihood(p: Params, data: Lanes, n_docs: int) -> np.ndarray:
    """The natural log probability of each document; states carry over all windows of a lane."""
    space, h = _Space(), np.zeros((HIDDEN, data.target.shape[1]), p["wh"].dtype)
    outputs, out, waiting = _Outputs(p, space), np.zeros(n_docs), []
    for t in range(0, len(data.target), WINDOW):
        piece = slice(t, t + WINDOW)
        live = np.flatnonzero(data.doc[t] >= 0)  # a lane that has ended stays ended
        if len(live) < h.shape[1]:
            data = Lanes(data.target[:, live], data.before[:, live], data.begins[:, live], data.doc[:, live])
            h = h[:, live]
        if len(live):
            states, _ = _forward(p, _inputs(p, data.before[piece], space)[1], data.begins[piece], h, False, space)
            h, doc = states[-1].copy(), data.doc[piece].ravel()
            real = np.flatnonzero(doc >= 0)
            waiting.append((_by_place(states, real, space), data.target[piece].ravel()[real], doc[real]))
        # windows of few lanes are scored together
        if sum(len(x[2]) for x in waiting) >= TOGETHER or waiting and (not len(live) or piece.stop >= len(data.target)):
            flat, target, doc = (np.concatenate(x) for x in zip(*waiting, strict=True))
            out += np.bincount(doc, _scores(outputs, flat, target), n_docs)
            waiting = []
        if not len(live):
            break
    return out


def gradients(p: Params, data: Lanes, h: np.ndarray, space: _Space | None = None) -> tuple[Params, np.ndarray, float, int]:
    """(gradients of the mean loss of a window, last state, loss, symbols); the gradients lie in space."""
    (steps, width), k, space = data.target.shape, HIDDEN, space or _Space()
    said, x = _inputs(p, data.before, space)
    states, (zr, un, m) = _forward(p, x, data.begins, h.T, True, space)
    dtype = x.dtype
    array = lambda name, *shape: space.of(name, dtype, *shape)
    # the places that hold a symbol, by class, so that a class's words are one slice
    real = np.flatnonzero(data.doc.ravel() >= 0)
    order, kind = _sorted_kinds(data.target.ravel()[real])
    real = real[order]
    flat, word = _by_place(states, real, space, array("flat", len(real), k + 1)), data.target.ravel()[real] % PER_CLASS
    n = max(1, len(real))
    outputs = _Outputs(p, space)
    classes, words = np.zeros_like(outputs.classes), array("dwords", *outputs.words.shape)
    words[:] = 0
    dreal, shares = array("dreal", len(real), k), np.empty((2, len(real)), dtype)
    for own, spans in _blocks(kind):
        mine, dmine = flat[own], dreal[own]
        d, shares[0, own] = _misses(outputs.of_classes(mine), kind[own])
        classes += mine.T @ d
        np.matmul(d, p["wc"].T, out=dmine)
        d, shares[1, own] = _misses(outputs.of_words(mine, spans), word[own])
        dw = array("dw", *dmine.shape)
        for c, a, b in spans:
            words[c] += mine[a:b].T @ d[a:b]
            np.matmul(d[a:b], p["ww"][c].T, out=dw[a:b])
        dmine += dw
    loss = -np.log(shares).sum()
    for x in (classes, words, dreal):
        x /= dtype.type(n)
    g = {"wc": classes[:k], "bc": classes[k], "ww": words[:, :k], "bw": words[:, k]}
    dflat = array("dflat", steps * width, k)
    dflat[:] = 0
    dflat[real] = dreal
    dstates, dh = array("dstates", steps, k, width), np.zeros((k, width), dtype)
    dstates[:] = dflat.reshape(steps, width, k).transpose(0, 2, 1)
    new, going = data.begins.any(axis=1).tolist(), ~data.begins
    h0 = np.multiply(states[:-1], going[:, None], out=array("h0", steps, k, width)) if any(new) else states[:-1]
    z, r = zr[:, :k], zr[:, k:]
    # what does not hang on the gradient that comes back is one product for all steps: the parts of it that the gates and
    # the candidate take
    takes = array("takes", steps, 3, k, width)
    for_z, for_r, for_un = (takes[:, i] for i in range(3))
    rest = np.subtract(1, z, out=array("rest", steps, k, width))
    np.subtract(h0, m, out=for_z)
    for_z *= z
    for_z *= rest
    for_m = np.multiply(m, m, out=m)
    np.subtract(1, for_m, out=for_m)
    for_m *= rest
    np.multiply(for_m, r, out=for_un)
    np.subtract(1, r, out=for_r)
    for_r *= for_un
    for_r *= un
    du, back = array("du", steps, 3 * k, width), array("back", k, width)
    for t in range(steps - 1, -1, -1):
        own, step = dstates[t], du[t]
        own += dh
        np.multiply(takes[t], own, out=step.reshape(3, k, width))
        np.matmul(p["wh"], step, out=back)
        np.multiply(own, z[t], out=dh)
        dh += back
        if new[t]:
            dh *= going[t]
    g["wh"] = np.matmul(h0, du.transpose(0, 2, 1)).sum(axis=0)
    g["bn"] = (du[:, 2 * k :] @ np.ones(width, dtype)).sum(axis=0)
    np.multiply(dstates, for_m, out=du[:, 2 * k :])  # the candidate takes its input whole
    by_lane = du.transpose(0, 2, 1)
    wx = np.matmul(said.transpose(0, 2, 1), by_lane).sum(axis=0)
    g["wx"], g["bx"] = wx[:-1], wx[-1]
    # the symbols of the window, each with the sum over its places
    before = data.before.ravel()
    order = np.argsort(before.astype(np.int16), kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(before[order]) != 0]))
    dsaid = np.matmul(by_lane, p["wx"].T, out=array("dsaid", steps, width, EMBED)).reshape(-1, EMBED)
    g["emb"] = array("demb", SIZE, EMBED)
    g["emb"][:] = 0
    g["emb"][before[order[edges]]] = np.add.reduceat(np.take(dsaid, order, axis=0, out=array("sorted", *dsaid.shape), mode="clip"), edges, axis=0)
    return g, states[-1].T.copy(), float(loss), n


def train(p: Params, data: Lanes, rate: float = 0.01, clip: float = 1.0, block: int = 1 << 13) -> Params:
    """One pass of Adam over the lanes, window by window."""
    # all weights in one row, of which p's are views
    flat = np.concatenate([x.ravel() for x in p.values()])
    edges = np.cumsum([0, *(x.size for x in p.values())])
    p = {k: flat[a:b].reshape(x.shape) for (k, x), a, b in zip(p.items(), edges, edges[1:], strict=False)}
    # output biases begin at the frequencies and move slowly
    rates = np.concatenate([np.full(x.size, rate * (0.1 if k in ("bc", "bw") else 1.0), flat.dtype) for k, x in p.items()])
    # ten times the mean and a hundred times the mean square
    m, v, x = np.zeros_like(flat), np.zeros_like(flat), np.empty_like(flat)
    h, space = np.zeros((data.target.shape[1], HIDDEN), np.float32), _Space()
    for i, t in enumerate(range(0, len(data.target), WINDOW), 1):
        piece = slice(t, t + WINDOW)
        g, h, _, _ = gradients(p, Lanes(data.target[piece], data.before[piece], data.begins[piece], data.doc[piece]), h, space)
        np.concatenate([g[k].ravel() for k in p], out=x)
        scale = np.float32(min(1.0, clip / max(float(np.sqrt(x @ x)), 1e-9)))
        root = 0.1 * (1 - 0.99**i) ** -0.5
        least, mean = np.float32(1e-6 / root), np.float32(0.1 / (1 - 0.9**i) / root)
        # in blocks that stay in a core's cache
        for a in range(0, len(flat), block):
            own = slice(a, a + block)
            y, mm, vv = x[own], m[own], v[own]
            y *= scale
            mm *= np.float32(0.9)
            mm += y
            y *= y
            vv *= np.float32(0.99)
            vv += y
            np.sqrt(vv, out=y)
            y += least
            np.divide(mm, y, out=y)
            y *= mean
            y *= rates[own]
            flat[own] -= y
    return {k: x.copy() for k, x in p.items()}


def packed(p: Params) -> bytes:
    return b"".join(p[k].astype(np.float32).tobytes() for k in sorted(p))


def unpacked(data: bytes, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.frombuffer(data, np.float32, like[k].size, at).reshape(like[k].shape).copy()
        at += 4 * like[k].size
    return out
