"""A small gated recurrent language model in numpy, with a class-factored output.

P(word | state) = P(class | state) P(word | class, state). Words are numbered so that a class is a
range of them. Word 0 stands for all words outside the vocabulary, word 1 ends a text.
"""

from __future__ import annotations

import numpy as np

UNKNOWN, END = 0, 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def class_starts(counts: np.ndarray, classes: int) -> np.ndarray:
    """First words of the classes, and the number of words: classes of about equal sums of sqrt(count).

    Words 0 and 1 are classes of their own; the others come by falling count.
    """
    weight = np.sqrt(counts[2:].astype(np.float64) + 1)
    if not len(weight):
        return np.array([0, 1, 2])
    share = (np.cumsum(weight) - weight / 2) / weight.sum()
    number = np.minimum((share * classes).astype(int), classes - 1)
    return np.array([0, 1, *(2 + np.flatnonzero(np.diff(number, prepend=-1))), len(counts)])


class Model:
    """A model over one vector of numbers, ``flat``, of which its parts are views.

    embed: words x inner. w, u, b: input, state and bias of the gates z, r and n. cw, cb and ow, ob:
    output for classes and words.
    """

    def __init__(self, starts: np.ndarray, inner: int, state: int, flat: np.ndarray | None = None):
        self.starts, self.inner, self.state = starts, inner, state
        classes, words = len(starts) - 1, int(starts[-1])
        shapes = {"embed": (words, inner), "w": (inner, 3 * state), "u": (state, 3 * state), "b": (3 * state,), "cw": (state, classes), "cb": (classes,), "ow": (words, state), "ob": (words,)}
        ends = np.cumsum([int(np.prod(x)) for x in shapes.values()])
        self.flat = np.zeros(ends[-1], np.float32) if flat is None else flat
        self.parts = tuple(shapes)
        for (name, shape), end in zip(shapes.items(), ends.tolist()):
            setattr(self, name, self.flat[end - int(np.prod(shape)) : end].reshape(shape))
        #: the class of each word
        self.classes = np.repeat(np.arange(classes, dtype=np.int16), np.diff(starts))

    def __reduce__(self):
        return Model, (self.starts, self.inner, self.state, self.flat)

    def zeros(self) -> Model:
        return Model(self.starts, self.inner, self.state, np.zeros_like(self.flat))

    @classmethod
    def new(cls, counts: np.ndarray, classes: int, inner: int, state: int, seed: int = 0) -> Model:
        """Starts as the unigram model of ``counts``."""
        rng = np.random.default_rng(seed)
        out = cls(class_starts(counts, classes), inner, state)
        p = (counts + 1.0) / (counts + 1.0).sum()
        mass = np.add.reduceat(p, out.starts[:-1])
        for part in (out.embed, out.w, out.u):
            part[...] = rng.standard_normal(part.shape) * 0.1
        out.cb[...], out.ob[...] = np.log(mass), np.log(p / mass[out.classes])
        return out

    def inputs(self) -> np.ndarray:
        """Each word's share of the gates."""
        return self.embed @ self.w + self.b

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The next state; states and gates stand in columns. x: the input words' share of the gates."""
        k = self.state
        g = self.u.T @ h
        zr = _sigmoid(x[: 2 * k] + g[: 2 * k])
        gn = g[2 * k :]
        n = zr[k:] * gn
        n += x[2 * k :]
        n += n
        _sigmoid(n)
        n += n
        n -= 1  # tanh
        after = h - n
        after *= zr[:k]
        after += n
        return after, (h, zr, n, gn)

    def output(self, h: np.ndarray, words: np.ndarray, grad: Model | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln P(word | state) of each row. With ``grad``: adds gradients of the mean loss to it and returns that of h."""
        of, rows, share = self.classes[words], np.arange(len(words)), h.dtype.type(1 / max(len(words), 1))
        e = h @ self.cw
        e += self.cb
        e -= e.max(axis=1, keepdims=True)
        out = e[rows, of]
        np.exp(e, out=e)
        total = e.sum(axis=1)
        out = out - np.log(total)
        dh = None
        if grad is not None:
            e *= (share / total)[:, None]
            e[rows, of] -= share
            grad.cw += h.T @ e
            grad.cb += e.sum(axis=0)
            dh = e @ self.cw.T
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(len(self.starts)))
        h, words, part, back = h[order], words[order], np.zeros(len(words), h.dtype), None if dh is None else np.zeros_like(dh)
        for a, b, lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), self.starts[:-1].tolist(), self.starts[1:].tolist()):
            if a == b or hi - lo == 1:
                continue
            own, at, each = h[a:b], words[a:b] - lo, rows[: b - a]
            e = own @ self.ow[lo:hi].T
            e += self.ob[lo:hi]
            e -= e.max(axis=1, keepdims=True)
            got = e[each, at]
            np.exp(e, out=e)
            total = e.sum(axis=1)
            part[a:b] = got - np.log(total)
            if grad is not None:
                e *= (share / total)[:, None]
                e[each, at] -= share
                grad.ow[lo:hi] += e.T @ own
                grad.ob[lo:hi] += e.sum(axis=0)
                back[a:b] = e @ self.ow[lo:hi]
        out[order] += part
        if dh is not None:
            dh[order] += back
        return out, dh

    def window(self, words: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[float, Model, np.ndarray]:
        """Loss, gradients and last state over a window (steps x rows), back-propagated to the window's start."""
        grad, k, steps, rows = self.zeros(), self.state, len(words), words.shape[1]
        inputs, states, memory = self.inputs(), np.empty((steps, rows, k), self.flat.dtype), []
        for t in range(steps):
            h, m = self.step(np.ascontiguousarray(inputs[words[t]].T), h)
            states[t] = h.T
            memory.append(m)
        out, dhs = self.output(states.reshape(-1, k), targets.ravel(), grad)
        dhs = np.ascontiguousarray(dhs.reshape(steps, rows, k).transpose(0, 2, 1))
        dxs, dh = np.empty((steps, rows, 3 * k), h.dtype), np.zeros_like(h)
        dx = np.empty((3 * k, rows), h.dtype)
        for t in reversed(range(steps)):
            before, zr, n, gn = memory[t]
            dh += dhs[t]
            slope = 1 - zr
            dn = np.multiply(n, n, out=dx[2 * k :])
            np.subtract(1, dn, out=dn)
            dn *= slope[:k]
            dn *= dh
            slope *= zr
            np.subtract(before, n, out=dx[:k])
            dx[:k] *= slope[:k]
            dx[:k] *= dh
            np.multiply(slope[k:], gn, out=dx[k : 2 * k])
            dx[k : 2 * k] *= dn
            dxs[t] = dx.T
            dn *= zr[k:]
            grad.u += before @ dx.T
            dh *= zr[:k]
            dh += self.u @ dx
        flat = words.ravel().astype(np.int32)
        order = np.argsort(flat, kind="stable")
        ids, first = np.unique(flat[order], return_index=True)
        sums = np.add.reduceat(dxs.reshape(-1, 3 * k)[order], first, axis=0)
        grad.b += sums.sum(axis=0)
        grad.w += self.embed[ids].T @ sums
        grad.embed[ids] += sums @ self.w.T
        return -float(out.mean()), grad, h

    def log10_likelihoods(self, words: np.ndarray, at: np.ndarray, flush: int = 1 << 14) -> np.ndarray:
        """log10 P of whole texts: text k is words[at[k]:at[k + 1]]. Each starts from the end mark and a zero state.

        All texts advance together, the longest first, so those that have ended drop out at the tail.
        """
        sizes = np.diff(at)
        order = np.argsort(-sizes, kind="stable")
        begins, left = at[:-1][order], sizes[order]
        active = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")  # texts longer than t
        inputs = self.inputs()
        h = np.zeros((self.state, len(order)), np.float32)
        before = np.full(len(order), END)
        out = np.zeros(len(order))
        states, targets, texts, held = [], [], [], 0

        def score() -> None:
            got, _ = self.output(np.concatenate(states), np.concatenate(targets))
            np.add(out, np.bincount(np.concatenate(texts), weights=got, minlength=len(out)), out=out)
            states.clear(), targets.clear(), texts.clear()

        rows = np.arange(len(order))
        for t, n in enumerate(active.tolist()):
            h, _ = self.step(np.ascontiguousarray(inputs[before[:n]].T), np.ascontiguousarray(h[:, :n]))
            before = words[begins[:n] + t]
            states.append(h.T)
            targets.append(before)
            texts.append(rows[:n])
            held += n
            if held >= flush:
                score()
                held = 0
        if held:
            score()
        result = np.zeros(len(order))
        result[order] = out / np.log(10)
        return result


class Trainer:
    """Truncated back-propagation with Adam over a stream of words that is handed over in parts.

    The stream is laid in ``rows`` lanes of ``steps * windows`` words; a lane's state is carried from
    window to window. What is left at the end is laid in fewer or shorter lanes, so every word is learned.
    """

    def __init__(self, model: Model, rows: int = 512, steps: int = 8, windows: int = 32, rate: float = 0.02):
        self.model, self.rows, self.steps, self.windows, self.rate = model, rows, steps, windows, rate
        self.mean, self.square, self.n = np.zeros_like(model.flat), np.zeros_like(model.flat), 0
        self.held: list[np.ndarray] = [np.array([END])]
        self.waiting, self.learned = 0, 0
        self.losses: list[float] = []

    def add(self, words: np.ndarray) -> None:
        self.held.append(words)
        self.waiting += len(words)
        full = self.rows * self.steps * self.windows
        if self.waiting < full:
            return
        stream = np.concatenate(self.held)
        while len(stream) > full:
            self._learn(stream[: full + 1], self.rows)
            stream = stream[full:]
        self.held, self.waiting = [stream], len(stream) - 1

    def finish(self) -> Model:
        stream = np.concatenate(self.held)
        while (n := len(stream) - 1) > 0:
            lanes = max(1, min(self.rows, n // self.steps))
            each = n // lanes
            self._learn(stream[: lanes * each + 1], lanes)
            stream = stream[lanes * each :]
        self.held, self.waiting = [stream], 0
        return self.model

    def _learn(self, stream: np.ndarray, lanes: int) -> None:
        x, y = stream[:-1].reshape(lanes, -1).T, stream[1:].reshape(lanes, -1).T
        h = np.zeros((self.model.state, lanes), np.float32)
        for t in range(0, len(x), self.steps):
            loss, grad, h = self.model.window(x[t : t + self.steps], y[t : t + self.steps], h)
            self._update(grad.flat)
            self.losses.append(loss)
        self.learned += x.size

    def _update(self, g: np.ndarray) -> None:
        self.n += 1
        g *= min(1.0, 1.0 / max(float(np.sqrt(g @ g)), 1e-9))
        self.mean *= 0.9
        self.mean += 0.1 * g
        self.square *= 0.99
        g *= g
        g *= 0.01
        self.square += g
        step = np.sqrt(self.square / (1 - 0.99**self.n))
        step += 1e-8
        np.divide(self.mean, step, out=step)
        step *= self.rate / (1 - 0.9**self.n)
        self.model.flat -= step
