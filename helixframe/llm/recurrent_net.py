"""A gated recurrent network over symbols with a class-factored softmax, in numpy.

Symbols 0 .. words-1 are the frequent words (0 is the end of a document), in classes of ``width`` by rank;
each further symbol is a class of its own and stands for all rare words of one tail class. A symbol's
probability is its class's times, within a word class, its own; so a step costs the number of classes plus
one class's width, whatever the number of words.

Documents are laid end to end on parallel lanes. A lane's state runs on from window to window and starts
anew after each end symbol, so every token is predicted from its whole document. In training the gradient
is cut at the window's beginning (truncated backpropagation through time), the state is not. Where only the longest
documents still run, windows are longer, so that a step of descent rests on about as many tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

END = 0
#: Lanes in parallel, steps a window; how many times as long a window gets, at most, as lanes come to their end.
LANES, WINDOW, STRETCH = 512, 16, 16


@dataclass(frozen=True)
class Shape:
    """words: symbols with a word class; width: words a class; tails: symbols that are classes themselves; hidden: units of the state."""

    words: int
    width: int
    tails: int
    hidden: int

    @property
    def symbols(self) -> int:
        return self.words + self.tails

    @property
    def word_classes(self) -> int:
        return -(-self.words // self.width)

    @property
    def classes(self) -> int:
        return self.word_classes + self.tails

    def parts(self) -> list[tuple[str, tuple[int, ...]]]:
        h = self.hidden
        return [("table", (3 * h, self.symbols)), ("recur", (h, 3 * h)), ("bias", (3 * h,)), ("to_class", (h, self.classes)), ("class_bias", (self.classes,)), ("to_word", (self.word_classes, h, self.width)), ("word_bias", (self.word_classes, self.width))]

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for _, s in self.parts())

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parameters by name, as views of one vector."""
        out, at = {}, 0
        for name, shape in self.parts():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        return out

    def start(self, counts: np.ndarray, seed: int = 1) -> np.ndarray:
        """First parameters: small random weights, and biases that give each symbol its share of ``counts`` (one added)."""
        r = np.random.default_rng(seed)
        flat = np.zeros(self.size, np.float32)
        v = self.views(flat)
        v["table"][:] = r.normal(0, 0.3, v["table"].shape)
        v["recur"][:] = r.normal(0, 1 / np.sqrt(self.hidden), v["recur"].shape)
        v["bias"][: self.hidden] = -1.0  # the share of the new is small at first: states last
        share = counts.astype(float) + 1
        words = np.full(self.word_classes * self.width, 1e-30)
        words[: self.words] = share[: self.words]
        words = words.reshape(self.word_classes, self.width)
        v["word_bias"][:] = np.log(words / words.sum(axis=1, keepdims=True))
        v["class_bias"][:] = np.log(np.concatenate([words.sum(axis=1), share[self.words :]]) / share.sum())
        return flat


class Lanes:
    """Documents end to end on at most LANES lanes: long ones first, each onto the shortest lane. One flat array holds all lanes, the longest first."""

    def __init__(self, docs: Sequence[np.ndarray]) -> None:
        n = max(1, min(LANES, len(docs)))
        heap, held = [(0, k) for k in range(n)], [[] for _ in range(n)]
        for i in sorted(range(len(docs)), key=lambda i: (-len(docs[i]), i)):
            load, k = heapq.heappop(heap)
            held[k].append(i)
            heapq.heappush(heap, (load + len(docs[i]), k))
        held = sorted((x for x in held if x), key=lambda x: -sum(len(docs[i]) for i in x))
        self.order = [i for x in held for i in x]
        self.size = np.array([sum(len(docs[i]) for i in x) for x in held], int)
        self.first = np.cumsum(self.size) - self.size
        self.targets = np.concatenate([docs[i] for i in self.order]).astype(np.int32) if docs else np.zeros(0, np.int32)
        self.inputs = np.concatenate([[END], self.targets[:-1]]).astype(np.int32)  # what stands before a lane's first target is the end of another lane
        self.starts = np.cumsum([0, *(len(docs[i]) for i in self.order[:-1])])

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each window the places in the flat array (steps x lanes still running) and which of them are of the lane."""
        t, end = 0, int(self.size.max(initial=0))
        while t < end:
            on = int((self.size > t).sum())
            steps = np.arange(min(WINDOW * min(STRETCH, len(self.size) // on), end - t))[:, None]
            live = steps + t < self.size[:on]
            yield np.where(live, self.first[:on] + t + steps, 0), live
            t += len(steps)


def _logistic(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _log_softmax(logit: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of entry ``at`` of each column; the columns turn into probabilities."""
    k = np.arange(logit.shape[1])
    logit -= logit.max(axis=0)
    log_p = logit[at, k]
    np.exp(logit, out=logit)
    total = logit.sum(axis=0)
    logit /= total
    return log_p - np.log(total)


class Net:
    """The network on one parameter vector. Arrays keep units first and lanes (or tokens) last, so that every operation runs along contiguous lanes."""

    def __init__(self, shape: Shape, flat: np.ndarray) -> None:
        self.shape, self.flat, self.p = shape, flat, shape.views(flat)

    def forward(self, inputs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """States after each step of a window (units x steps x lanes), from inputs (steps x lanes) and the state before (units x lanes); what the way back needs."""
        h, p = self.shape.hidden, self.p
        table = p["table"] + p["bias"][:, None]
        on, recur = (inputs != END).astype(self.flat.dtype), np.ascontiguousarray(p["recur"].T)
        states, kept = np.empty((h, *inputs.shape), self.flat.dtype), []
        for t in range(len(inputs)):
            before = state * on[t]
            back = recur @ before
            fed = np.take(table, inputs[t], axis=1, mode="clip")
            gates = fed[: 2 * h]
            gates += back[: 2 * h]
            z, r = _logistic(gates[:h]), _logistic(gates[h:])
            new = r * back[2 * h :]
            new += fed[2 * h :]
            np.tanh(new, out=new)
            step = before - new
            state = z * step
            np.subtract(step, state, out=state)
            state += new
            states[:, t] = state
            kept.append((before, z, r, new, back[2 * h :], step))
        return states, kept

    def outputs(self, states: np.ndarray, targets: np.ndarray, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log probabilities of targets (tokens) after their states (units x tokens); with ``grads``, adds the output layer's and returns the states' gradient."""
        p, s = self.p, self.shape
        of = np.where(targets < s.words, targets // s.width, targets - s.words + s.word_classes)
        logit = np.ascontiguousarray(p["to_class"].T) @ states
        logit += p["class_bias"][:, None]
        log_p = _log_softmax(logit, of)
        back = None
        if grads is not None:
            logit[of, np.arange(len(of))] -= 1
            grads["to_class"] += states @ logit.T
            grads["class_bias"] += logit.sum(axis=1)
            back = p["to_class"] @ logit
        order = np.flatnonzero(of < s.word_classes)
        order = order[np.argsort(of[order].astype(np.uint16) if s.word_classes < 1 << 16 else of[order], kind="stable")]
        ends = np.searchsorted(of[order], np.arange(s.word_classes + 1))
        sorted_states, words = np.take(states, order, axis=1, mode="clip"), targets[order] % s.width
        inside = np.empty(len(order), log_p.dtype)
        # a column more, of zeros, for tokens of tail classes
        turned = np.zeros((len(states), len(order) + 1), states.dtype) if grads is not None else None
        for c in range(s.word_classes):
            a, b = ends[c], ends[c + 1]
            if a == b:
                continue
            inner = p["to_word"][c].T @ sorted_states[:, a:b]
            inner += p["word_bias"][c][:, None]
            inside[a:b] = _log_softmax(inner, words[a:b])
            if grads is not None:
                inner[words[a:b], np.arange(b - a)] -= 1
                grads["to_word"][c] += sorted_states[:, a:b] @ inner.T
                grads["word_bias"][c] += inner.sum(axis=1)
                turned[:, a:b] = p["to_word"][c] @ inner
        log_p[order] += inside
        if grads is not None:
            place = np.full(len(of), len(order))
            place[order] = np.arange(len(order))
            back += np.take(turned, place, axis=1, mode="clip")
        return log_p, back

    def backward(self, inputs: np.ndarray, kept: list[tuple], back: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        """Gradients of a window from those of its states, cut at its beginning."""
        h, recur = self.shape.hidden, self.p["recur"]
        fed = np.empty((3 * h, *inputs.shape), back.dtype)
        on = (inputs != END).astype(back.dtype)
        d = np.zeros_like(back[:, 0])
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, new, hidden, step = kept[t]
            d += back[:, t]
            turn = d * z
            dz = step * (turn * (z - 1))
            turn *= 1 - new * new
            inner = np.concatenate([dz, turn * hidden * r * (1 - r), turn * r])
            fed[: 2 * h, t], fed[2 * h :, t] = inner[: 2 * h], turn
            grads["recur"] += before @ inner.T
            d *= 1 - z
            d += recur @ inner
            d *= on[t]
        fed = fed.reshape(3 * h, -1)
        keys = inputs.ravel()
        order = np.argsort(keys.astype(np.uint16) if self.shape.symbols < 1 << 16 else keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(np.take(fed, order, axis=1, mode="clip"), starts, axis=1)
        grads["table"][:, keys[starts]] += sums
        grads["bias"] += sums.sum(axis=1)

    def log_probabilities(self, docs: Sequence[np.ndarray]) -> np.ndarray:
        """Natural log probability of each document (symbols with the end as last)."""
        if not len(docs):
            return np.zeros(0)
        lanes = Lanes(docs)
        got = np.zeros(len(lanes.targets))
        state = np.zeros((self.shape.hidden, len(lanes.size)), self.flat.dtype)
        for at, live in lanes.windows():
            states, _ = self.forward(lanes.inputs[at], state[:, : at.shape[1]])
            state, places = states[:, -1], at[live]
            got[places] = self.outputs(states.reshape(len(states), -1) if live.all() else states[:, live], lanes.targets[places])[0]
        out = np.zeros(len(docs))
        out[lanes.order] = np.add.reduceat(got, lanes.starts)
        return out

    def train(self, docs: Sequence[np.ndarray], adam: Adam) -> int:
        """One pass over documents, a step of descent each window; tokens seen."""
        lanes = Lanes(docs)
        state = np.zeros((self.shape.hidden, len(lanes.size)), self.flat.dtype)
        grad = np.zeros_like(self.flat)
        grads = self.shape.views(grad)
        for at, live in lanes.windows():
            grad[:] = 0
            inputs, places = lanes.inputs[at], at[live]
            states, kept = self.forward(inputs, state[:, : at.shape[1]])
            state = states[:, -1]
            if live.all():
                back = self.outputs(states.reshape(len(states), -1), lanes.targets[places], grads)[1].reshape(states.shape)
            else:
                back = np.zeros_like(states)
                back[:, live] = self.outputs(states[:, live], lanes.targets[places], grads)[1]
            self.backward(inputs, kept, back, grads)
            grad /= len(places)
            adam.step(self.flat, grad)
        return len(lanes.targets)


class Adam:
    """Steps of descent by running means of gradients and of their squares; a gradient longer than 1 is shortened to 1."""

    def __init__(self, size: int, rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m, self.v = np.zeros(size, np.float32), np.zeros(size, np.float32)

    def step(self, flat: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        norm = float(np.sqrt(grad @ grad))
        if norm > 1:
            grad /= norm
        self.m *= 0.9
        self.m += 0.1 * grad
        grad *= grad
        self.v *= 0.99
        self.v += 0.01 * grad
        np.divide(self.v, 1 - 0.99**self.t, out=grad)
        np.sqrt(grad, out=grad)
        grad += 1e-6
        np.divide(self.m, grad, out=grad)
        grad *= self.rate / (1 - 0.9**self.t)
        flat -= grad
