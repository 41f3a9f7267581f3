"""A gated recurrent language model over words, in numpy.

The input weights of a word are its row of a table, so a step reads one row and multiplies the
state by one matrix. The output is factored by classes of words of like frequency: the chance of
a word is that of its class times that of the word in it, which costs the square root of the
vocabulary. Training cuts a stream of words into windows and carries the state, without its
gradient, from one to the next; scoring carries it from a document's first window to its last.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np

END = 0  # also what stands before a document's first word
RARE = 1
LANES = 256
WINDOW = 24
CLIP = 2.0


@dataclass
class Shape:
    words: int
    hidden: int

    @property
    def of_class(self) -> int:
        return max(1, int(np.ceil(np.sqrt(self.words))))

    @property
    def classes(self) -> int:
        return -(-self.words // self.of_class)

    def parts(self) -> dict[str, tuple[int, ...]]:
        h, n, c = self.hidden, self.words, self.classes
        return {
            "table": (n, 3 * h), "inner": (h, 3 * h), "inner_bias": (h,),
            "class_out": (c, h), "class_bias": (c,), "word_out": (c * self.of_class, h), "word_bias": (c * self.of_class,),
        }

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        found, at = {}, 0
        for name, shape in self.parts().items():
            size = int(np.prod(shape))
            found[name] = flat[at : at + size].reshape(shape)
            at += size
        return found

    @property
    def size(self) -> int:
        return sum(int(np.prod(s)) for s in self.parts().values())


def first_weights(shape: Shape, counts: np.ndarray, seed: int = 11) -> np.ndarray:
    """Weights that give each word its share of ``counts``; words are numbered by falling count."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(shape.size, np.float32)
    w = shape.views(flat)
    spread = 1 / np.sqrt(shape.hidden)
    w["table"][:] = rng.normal(0, spread, w["table"].shape)
    w["inner"][:] = rng.normal(0, spread, w["inner"].shape)
    w["class_out"][:] = rng.normal(0, 0.1, w["class_out"].shape)
    w["word_out"][:] = rng.normal(0, 0.1, w["word_out"].shape)
    padded = np.zeros(shape.classes * shape.of_class)
    padded[: shape.words] = np.maximum(counts, 1)
    by_class = padded.reshape(shape.classes, shape.of_class)
    w["class_bias"][:] = np.log(by_class.sum(1) / padded.sum())
    with np.errstate(divide="ignore"):
        w["word_bias"][:] = np.maximum(np.log(padded / np.repeat(by_class.sum(1), shape.of_class)), -1e9)
    return flat


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Gru:
    def __init__(self, shape: Shape, flat: np.ndarray):
        self.shape, self.flat = shape, flat
        self.w = shape.views(flat)

    def states(self, inputs: np.ndarray, state: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """The state after each step of (steps, lanes) inputs; ``END`` clears a lane's state first."""
        h, w = self.shape.hidden, self.w
        steps, lanes = inputs.shape
        x = w["table"][inputs]
        out, saved = np.empty((steps, lanes, h), np.float32), []
        for t in range(steps):
            start = inputs[t] == END
            if start.any():
                state = np.where(start[:, None], np.float32(0), state)
            inner = state @ w["inner"]
            gates = _sigmoid(x[t, :, : 2 * h] + inner[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            held = inner[:, 2 * h :] + w["inner_bias"]
            new = np.tanh(x[t, :, 2 * h :] + r * held)
            after = new + z * (state - new)
            if keep:
                saved.append((start, state, z, r, held, new))
            out[t] = state = after
        return out, saved

    def log_chances(self, hidden: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of each target's chance; with ``grads`` also the gradient of their negative sum."""
        w, size = self.w, self.shape.of_class
        rows = np.arange(len(targets))
        which = targets // size
        # one column for each target, so that sums over words run along memory
        learn = grads is not None
        found, chances = self._softmax(w["class_out"], w["class_bias"], hidden, which, rows, learn)
        back = None
        if learn:
            grads["class_out"] += chances @ hidden
            grads["class_bias"] += chances.sum(1)
            back = chances.T @ w["class_out"]
        order = np.argsort(which.astype(np.uint16), kind="stable")
        cuts = np.searchsorted(which[order], np.arange(self.shape.classes + 1))
        own, place = hidden[order], (targets - which * size)[order]
        in_class, own_back = np.empty(len(order), np.float32), np.empty_like(hidden) if learn else None
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            a, b, at = cuts[c], cuts[c + 1], slice(c * size, (c + 1) * size)
            in_class[a:b], chances = self._softmax(w["word_out"][at], w["word_bias"][at], own[a:b], place[a:b], rows[: b - a], learn)
            if learn:
                grads["word_out"][at] += chances @ own[a:b]
                grads["word_bias"][at] += chances.sum(1)
                own_back[a:b] = chances.T @ w["word_out"][at]
        found[order] += in_class
        if learn:
            back[order] += own_back
        return found, back

    @staticmethod
    def _softmax(
        out: np.ndarray, bias: np.ndarray, hidden: np.ndarray, place: np.ndarray, rows: np.ndarray, learn: bool
    ) -> tuple[np.ndarray, np.ndarray]:
        """Log of the chance at each row's place; to learn, also all chances by column, less one at the places."""
        logits = out @ hidden.T
        logits += bias[:, None]
        logits -= logits.max(0)
        found = logits[place, rows]
        chances = np.exp(logits, out=logits)
        total = chances.sum(0)
        found -= np.log(total)
        if learn:
            chances /= total
            chances[place, rows] -= 1
        return found, chances

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, state: np.ndarray, flat: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss of a window, with its gradient in ``flat``, and the state after it."""
        h, w = self.shape.hidden, self.w
        flat[:] = 0
        grads = self.shape.views(flat)
        out, saved = self.states(inputs, state, keep=True)
        steps, lanes, _ = out.shape
        found, back = self.log_chances(out.reshape(-1, h), targets.ravel(), grads)
        back = back.reshape(out.shape)
        dx, d_inner = np.empty((steps, lanes, 3 * h), np.float32), np.empty((steps, lanes, 3 * h), np.float32)
        later = np.zeros((lanes, h), np.float32)
        turned = np.ascontiguousarray(w["inner"].T)
        for t in range(steps - 1, -1, -1):
            start, before, z, r, held, new = saved[t]
            d = back[t] + later
            d_new = d * (1 - z) * (1 - new * new)
            dx[t, :, :h] = d * (before - new) * z * (1 - z)
            dx[t, :, h : 2 * h] = d_new * held * r * (1 - r)
            dx[t, :, 2 * h :] = d_new
            d_inner[t, :, : 2 * h] = dx[t, :, : 2 * h]
            d_inner[t, :, 2 * h :] = d_new * r
            later = d * z + d_inner[t] @ turned
            if start.any():
                later[start] = 0
        befores = np.concatenate([s[1] for s in saved])
        d_inner, dx = d_inner.reshape(-1, 3 * h), dx.reshape(-1, 3 * h)
        grads["inner"] += befores.T @ d_inner
        grads["inner_bias"] += d_inner[:, 2 * h :].sum(0)
        ids = inputs.ravel()
        order = np.argsort(ids, kind="stable")
        firsts = np.flatnonzero(np.r_[True, ids[order][1:] != ids[order][:-1]])
        grads["table"][ids[order][firsts]] = np.add.reduceat(dx[order], firsts, axis=0)
        flat /= len(found)
        return -float(found.mean()), out[-1]


class Adam:
    def __init__(self, size: int, rate: float, fade: float = 0.9, fade_square: float = 0.99):
        self.mean, self.square = np.zeros(size, np.float32), np.zeros(size, np.float32)
        self.rate, self.fade, self.fade_square, self.steps = rate, fade, fade_square, 0

    def step(self, flat: np.ndarray, grad: np.ndarray) -> None:
        norm = float(np.sqrt(np.dot(grad, grad)))
        if norm > CLIP:
            grad *= CLIP / norm
        self.steps += 1
        self.mean += (1 - self.fade) * (grad - self.mean)
        np.multiply(grad, grad, out=grad)
        self.square += (1 - self.fade_square) * (grad - self.square)
        rate = self.rate * np.sqrt(1 - self.fade_square**self.steps) / (1 - self.fade**self.steps)
        np.sqrt(self.square, out=grad)
        grad += 1e-8
        np.divide(self.mean, grad, out=grad)
        flat -= np.float32(rate) * grad


def train(shape: Shape, flat: np.ndarray, stream: np.ndarray, rate: float) -> np.ndarray:
    """Weights after one pass of truncated backpropagation over a stream of documents' ids."""
    flat = flat.copy()
    model, grad, optimiser = Gru(shape, flat), np.empty_like(flat), Adam(len(flat), rate)
    lanes = min(LANES, max(1, len(stream) // (4 * WINDOW)))
    length = -(-len(stream) // lanes)
    padded = np.zeros(lanes * length, stream.dtype)
    padded[: len(stream)] = stream  # a few more ends at the last lane's end
    by_lane = padded.reshape(lanes, length).T
    state, last = np.zeros((lanes, shape.hidden), np.float32), np.full((1, lanes), END)
    for at in range(0, length, WINDOW):
        targets = by_lane[at : at + WINDOW].astype(np.int64)
        _, state = model.gradient(np.concatenate([last, targets[:-1]]), targets, state, grad)
        optimiser.step(flat, grad)
        last = targets[-1:]
    return flat


def score(shape: Shape, flat: np.ndarray, documents: list[np.ndarray]) -> np.ndarray:
    """log10 of each document's chance; its ids end with ``END``.

    Documents are dealt to lanes, the longest first, and follow each other there. The state
    goes from window to window, so a document is scored as a whole whatever its length.
    """
    model = Gru(shape, flat)
    order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
    lanes: list[list[int]] = [[] for _ in range(min(LANES, len(documents)))]
    load = [(0, k) for k in range(len(lanes))]
    for i in order:
        size, k = load[0]
        lanes[k].append(i)
        heapq.heapreplace(load, (size + len(documents[i]), k))
    sizes = [sum(len(documents[i]) for i in lane) for lane in lanes]
    by_size = sorted(range(len(lanes)), key=lambda k: -sizes[k])
    lanes, sizes = [lanes[k] for k in by_size], np.array([sizes[k] for k in by_size])
    begins = np.cumsum(sizes) - sizes
    stream = np.concatenate([documents[i] for lane in lanes for i in lane])
    found = np.zeros(len(stream), np.float32)
    state, last = np.zeros((len(lanes), shape.hidden), np.float32), np.full((1, len(lanes)), END)
    for at in range(0, int(sizes.max(initial=0)), WINDOW):
        busy = int(np.searchsorted(-sizes, -at))  # lanes that still have words
        steps = at + np.arange(min(WINDOW, sizes[0] - at))[:, None]
        inside = steps < sizes[:busy]
        place = begins[:busy] + np.minimum(steps, sizes[:busy] - 1)
        window = stream[place].astype(np.int64)
        out, _ = model.states(np.concatenate([last[:, :busy], window[:-1]]), state[:busy])
        chances = model.log_chances(out.reshape(-1, shape.hidden), window.ravel())[0].reshape(window.shape)
        found[place[inside]] = chances[inside]
        state, last = out[-1], window[-1:]
    held = [i for lane in lanes for i in lane]
    starts = np.cumsum([0, *[len(documents[i]) for i in held[:-1]]])
    scores = np.zeros(len(documents))
    scores[held] = np.add.reduceat(found.astype(np.float64), starts)
    return scores / np.log(10)
