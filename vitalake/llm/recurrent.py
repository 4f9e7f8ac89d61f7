"""A bidirectional gated recurrent network with attention pooling, in numpy: forward, backward and training.

A word's input is its own vector (words of the vocabulary; all others share one) beside the mean of the
vectors of its character trigrams. What the gates take from an input depends on the word alone, so it is
worked out once per distinct word and looked up at each step.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from vitalake.llm.arrays import ALNUM, U, Words, mixed, ranges, slices

HIDDEN, WORD, CHAR, GRAMS, ATTEND = 8, 8, 4, 4096, 8
#: Words of a window, and from one window's start to the next.
WINDOW, STRIDE = 64, 48
BATCH = 1024


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Vocabulary:
    """Distinct words of texts: their hashes, character trigrams, and the word at each place of each text."""

    def __init__(self, column):
        words = Words(column, lower=True, kind=ALNUM)
        self.count, self.first = words.count, words.first
        self.hash, first, self.at = np.unique(words.hash, return_index=True, return_inverse=True)
        # Trigrams from the byte before a word to the byte after it, both read as 0.
        padded = np.concatenate(([0], np.where(ALNUM[words.buf], words.buf, 0), [0, 0])).astype(np.int64)
        start, n = words.start[first], words.end[first] - words.start[first]
        self.lengths, self.ends = n, np.cumsum(n)
        place = ranges(start, n)
        codes = padded[place] << 16 | padded[place + 1] << 8 | padded[place + 2]
        self.grams = (mixed(codes.astype(U)) % U(GRAMS)).astype(np.int16)

    @classmethod
    def joined(cls, parts: list[Vocabulary]) -> Vocabulary:
        """The vocabulary of the texts of several, one after the other."""
        whole = cls.__new__(cls)
        every = np.concatenate([p.hash for p in parts])
        whole.hash, first = np.unique(every, return_index=True)
        whole.at = np.concatenate([np.searchsorted(whole.hash, p.hash)[p.at] for p in parts])
        whole.count = np.concatenate([p.count for p in parts])
        whole.first = np.concatenate(([0], np.cumsum(whole.count)))
        lengths, grams = np.concatenate([p.lengths for p in parts]), np.concatenate([p.grams for p in parts])
        whole.lengths = lengths[first]
        whole.ends = np.cumsum(whole.lengths)
        whole.grams = grams[ranges((np.cumsum(lengths) - lengths)[first], whole.lengths)]
        return whole

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start (a word's number), length and row of all overlapping windows."""
        count = self.count
        per_row = np.where(count > 0, 1 + np.maximum(0, -(-(count - WINDOW) // STRIDE)), 0)
        row = np.repeat(np.arange(len(count)), per_row)
        number = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        start = self.first[row] + number * STRIDE
        return start, np.minimum(WINDOW, self.first[row + 1] - start), row


class Network:
    """Weights by name; `known` holds the sorted hashes of the vocabulary, row 0 of `words` is for the rest."""

    def __init__(self, known: np.ndarray, hint: np.ndarray, seed: int = 5):
        random = np.random.default_rng(seed)

        def small(*shape, by=0.3):
            return (random.standard_normal(shape) * by).astype(np.float32)

        wide = 2 * HIDDEN
        self.known = known
        self.w = {
            "words": small(len(known) + 1, WORD, by=0.1), "grams": small(GRAMS, CHAR, by=0.1),
            "input_f": small(WORD + CHAR, 3 * HIDDEN), "input_b": small(WORD + CHAR, 3 * HIDDEN),
            "bias_f": small(3 * HIDDEN, by=0), "bias_b": small(3 * HIDDEN, by=0),
            "again_f": small(HIDDEN, 3 * HIDDEN), "again_b": small(HIDDEN, 3 * HIDDEN),
            "attend": small(wide, ATTEND), "attend_to": small(ATTEND), "out": small(wide), "out_bias": small(1, by=0),
        }
        self.w["words"][1:, 0] = hint

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each word in `words`."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def inputs(self, vocabulary: Vocabulary, which: np.ndarray | None = None):
        """Input vector of each distinct word, and what backward needs of the characters."""
        grams, lengths, ends, hashes = vocabulary.grams, vocabulary.lengths, vocabulary.ends, vocabulary.hash
        if which is not None:
            n = lengths[which]
            grams, lengths, hashes = grams[ranges(ends[which] - n, n)], n, hashes[which]
            ends = np.cumsum(n)
        sums = np.add.reduceat(self.w["grams"][grams], ends - lengths, axis=0) if len(ends) else np.zeros((0, CHAR), np.float32)
        numbers = self.numbers(hashes)
        x = np.concatenate([self.w["words"][numbers], sums / np.maximum(lengths, 1)[:, None].astype(np.float32)], axis=1)
        return x, numbers, grams, lengths

    def _direction(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, again: np.ndarray, back: bool, keep: list | None):
        n, steps = at.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((n, steps, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1) if back else range(steps):
            p, m = gates[at[:, t]], mask[:, t : t + 1]
            q = h @ again
            zr = _sigmoid(p[:, : 2 * HIDDEN] + q[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(p[:, 2 * HIDDEN :] + r * q[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            if keep is not None:
                keep.append((t, h, z, r, c, q[:, 2 * HIDDEN :]))
            h = np.where(m, new, h)
            out[:, t] = h
        return out

    def forward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log odds of each window; at[i, t] is the row in x of its t-th word where mask holds."""
        w, both = self.w, []
        for side in "fb":
            steps: list | None = [] if keep is not None else None
            both.append(self._direction(x @ w[f"input_{side}"] + w[f"bias_{side}"], at, mask, w[f"again_{side}"], side == "b", steps))
            if keep is not None:
                keep[side] = steps
        states = np.concatenate(both, axis=2)
        look = np.tanh(states @ w["attend"])
        scores = np.where(mask, look @ w["attend_to"], np.float32(-1e9))
        weight = np.exp(scores - scores.max(axis=1, keepdims=True)) * mask
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        pooled = (weight[:, :, None] * states).sum(axis=1)
        if keep is not None:
            keep |= {"states": states, "look": look, "weight": weight, "pooled": pooled}
        return pooled @ w["out"] + w["out_bias"][0]

    def backward(self, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: dict, slope: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients by name and of the inputs x, from the slope of the loss at each window's log odds."""
        w, g = self.w, {}
        states, look, weight, pooled = keep["states"], keep["look"], keep["weight"], keep["pooled"]
        g["out"], g["out_bias"] = pooled.T @ slope, np.array([slope.sum()], np.float32)
        d_pooled = slope[:, None] * w["out"]
        d_weight = (states * d_pooled[:, None, :]).sum(axis=2)
        d_scores = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["attend_to"] = np.einsum("nt,nta->a", d_scores, look)
        d_look = d_scores[:, :, None] * w["attend_to"] * (1 - look**2)
        g["attend"] = np.einsum("nth,nta->ha", states, d_look)
        d_states = weight[:, :, None] * d_pooled[:, None, :] + d_look @ w["attend"].T
        d_x = np.zeros_like(x)
        for i, side in enumerate("fb"):
            d_out = d_states[:, :, i * HIDDEN : (i + 1) * HIDDEN]
            again = w[f"again_{side}"]
            d_again, d_gates = np.zeros_like(again), np.zeros((len(x), 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(at), HIDDEN), np.float32)
            for t, h, z, r, c, q in reversed(keep[side]):
                m = mask[:, t : t + 1]
                d_new = np.where(m, d_h + d_out[:, t], 0)
                d_c = d_new * (1 - z) * (1 - c**2)
                d_z = d_new * (h - c) * z * (1 - z)
                d_r = d_c * q * r * (1 - r)
                d_p = np.concatenate([d_z, d_r, d_c], axis=1)
                d_q = np.concatenate([d_z, d_r, d_c * r], axis=1)
                d_again += h.T @ d_q
                np.add.at(d_gates, at[:, t], d_p)
                d_h = np.where(m, d_new * z + d_q @ again.T, d_h + d_out[:, t])
            g[f"again_{side}"], g[f"bias_{side}"] = d_again, d_gates.sum(axis=0)
            g[f"input_{side}"] = x.T @ d_gates
            d_x += d_gates @ w[f"input_{side}"].T
        return g, d_x

    def score(self, vocabulary: Vocabulary, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Log odds of windows."""
        x = self.inputs(vocabulary)[0]
        out = np.zeros(len(start), np.float32)
        # Windows of like length together, so that short ones take few steps.
        order = np.argsort(length, kind="stable")
        for low in range(0, len(order), BATCH):
            own = order[low : low + BATCH]
            at, mask = places(vocabulary, start[own], length[own])
            out[own] = self.forward(x, at, mask)
        return out


def places(vocabulary: Vocabulary, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word at each step of windows, and which steps hold one."""
    steps = np.arange(int(length.max()) if len(length) else 0)
    mask = steps[None, :] < length[:, None]
    return vocabulary.at[np.where(mask, start[:, None] + steps, start[:, None])], mask


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in gradients.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            move = self.m[k] / (1 - 0.9**self.t) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
            self.weights[k] -= (self.rate * move).astype(np.float32)


def train(column, labels: np.ndarray, epochs: int = 8, rate: float = 0.01, least: int = 3, seed: int = 5) -> Network:
    """A network for texts of which only the whole is labelled.

    A text's label is that of its most telling window. At first that is the one with the highest sum of
    its words' log odds; after each two epochs it is the one that the network scores highest, and texts
    whose label the network then finds very unlikely (under 5 %) are left out as mislabelled until it has
    changed its view. Texts without the mark also give two windows at random. Words of `least` texts or
    more are the vocabulary.
    """
    # Slice by slice, so that what is held at once is the words and not the work on their bytes.
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    vocabulary = Vocabulary.joined([Vocabulary(part.column("text")) for part in slices(batch, "text")] or [Vocabulary(column)])
    random, n = np.random.default_rng(seed), max(1, len(column))
    pairs = np.unique(vocabulary.at.astype(np.int64) * n + np.repeat(np.arange(len(column)), vocabulary.count))
    toxic = labels[pairs % n]
    bad, good = (np.bincount(pairs // n, x, len(vocabulary.hash)) for x in (toxic, 1 - toxic))
    del pairs, toxic
    odds = np.log((bad + 0.1) / (labels.sum() + 0.2)) - np.log((good + 0.1) / ((1 - labels).sum() + 0.2))
    hint = np.clip(odds * (1 - np.exp(-(bad + good) / 8)), -3, 3)
    common = bad + good >= least
    network = Network(vocabulary.hash[common], (hint[common] / 3).astype(np.float32), seed)
    start, length, row = vocabulary.windows()
    if not len(start) or labels.min() == labels.max():
        network.w["out"][:] = 0
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        network.w["out_bias"][0] = np.log(share / (1 - share))
        return network
    sums = np.concatenate(([0], np.cumsum(np.maximum(hint, 0)[vocabulary.at] ** 2)))
    telling = sums[start + length] - sums[start]
    adam = Adam(network.w, rate)
    others = np.flatnonzero(labels[row] == 0)
    for epoch in range(epochs):
        if epoch and epoch % 2 == 0:
            telling = network.score(vocabulary, start, length)
        order = np.lexsort((telling, row))
        best = order[np.append(np.flatnonzero(np.diff(row[order])), len(order) - 1)]
        if epoch > 1:
            best = best[np.where(labels[row[best]] > 0, telling[best], -telling[best]) > -3]
        extra = random.choice(others, min(len(others), 2 * int((labels == 0).sum())), replace=False)
        chosen = random.permutation(np.concatenate([best, extra]))
        for low in range(0, len(chosen), 128):
            own = chosen[low : low + 128]
            at, mask = places(vocabulary, start[own], length[own])
            used, at = np.unique(at, return_inverse=True)
            at = at.reshape(mask.shape)
            x, numbers, grams, lengths = network.inputs(vocabulary, used)
            keep: dict = {}
            slope = (_sigmoid(network.forward(x, at, mask, keep)) - labels[row[own]]).astype(np.float32) / len(own)
            gradients, d_x = network.backward(x, at, mask, keep, slope)
            gradients["words"] = np.zeros_like(network.w["words"])
            np.add.at(gradients["words"], numbers, d_x[:, :WORD])
            gradients["grams"] = np.zeros_like(network.w["grams"])
            np.add.at(gradients["grams"], grams, np.repeat(d_x[:, WORD:] / lengths[:, None], lengths, axis=0))
            adam.step(gradients)
    return network
