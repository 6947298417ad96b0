"""A bidirectional LSTM over sequences of blocks, in numpy: scoring and training.

A block enters as the decayed sum of the hashed features of the elements around it (its tag path) and the mean of
its hashed words. Forward and backward states together give the probability that the block is main text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

from surveyspan.llm.page_blocks import BUCKETS, Block, Paths, token

WORDS = 4096
PATH_SIZE = 24
WORD_SIZE = 16
STATES = 24
#: An element counts this much of the one inside it.
DECAY = 0.8
#: Sequences scored together, and pages of one training step.
BATCH = 32
STEP_PAGES = 16
_SENTENCE = (".", "!", "?", "…", "。", "！", "？", ":", ";", '"', "”", "»")


def block_tokens(block: Block) -> tuple[int, ...]:
    """Hashed features of a block's own shape; they join those of its path."""
    size = len(block.text)
    return (
        token(f"length {min(size, 4000).bit_length()}"),
        token(f"linked {round(4 * min(1.0, block.linked / size))}"),
        token(f"sentence {block.text.endswith(_SENTENCE)}"),
    )


def word_ids(text: str) -> list[int]:
    return [zlib.crc32(w.encode()) % WORDS for w in text.lower().split()]


@dataclass
class Network:
    """All weights; ``w``, ``u`` and ``b`` hold forward and backward direction, gates in the order i, f, o, g."""

    path: np.ndarray
    word: np.ndarray
    w: np.ndarray
    u: np.ndarray
    b: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @staticmethod
    def initial(random: np.random.Generator) -> Network:
        def normal(*shape: int, size: float) -> np.ndarray:
            return random.normal(0, size, shape).astype(np.float32)

        d = PATH_SIZE + WORD_SIZE
        b = np.zeros((2, 4 * STATES), np.float32)
        b[:, STATES : 2 * STATES] = 1  # remember at first
        return Network(
            normal(BUCKETS, PATH_SIZE, size=0.2),
            normal(WORDS, WORD_SIZE, size=0.2),
            normal(2, d, 4 * STATES, size=d**-0.5),
            normal(2, STATES, 4 * STATES, size=STATES**-0.5),
            b,
            normal(2 * STATES, size=0.2),
            np.zeros(1, np.float32),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.path, self.word, self.w, self.u, self.b, self.out, self.bias]

    def path_vectors(self, paths: Paths, known: list[np.ndarray]) -> list[np.ndarray]:
        """Extend ``known`` to the vectors of all nodes; a parent always stands before its children."""
        for node in range(len(known), len(paths.parents)):
            own = self.path[list(paths.tokens[node])].sum(0) if paths.tokens[node] else np.zeros(PATH_SIZE, np.float32)
            known.append(own + np.float32(DECAY) * known[paths.parents[node]] if node else own)
        return known

    def inputs(self, pages: list[list[Block]], vectors: list[np.ndarray]) -> np.ndarray:
        """One row per block of all pages."""
        blocks = [b for page in pages for b in page]
        x = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE), np.float32)
        if not blocks:
            return x
        x[:, :PATH_SIZE] = np.stack([vectors[b.node] for b in blocks])
        x[:, :PATH_SIZE] += self.path[np.array([block_tokens(b) for b in blocks])].sum(1)
        for i, b in enumerate(blocks):
            ids = np.array(word_ids(b.text))
            if len(ids) < WORDS:
                x[i, PATH_SIZE:] = self.word[ids].mean(0)
            else:
                x[i, PATH_SIZE:] = np.bincount(ids, minlength=WORDS).astype(np.float32) @ self.word / len(ids)
        return x

    def _run(self, direction: int, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """States over time-major input (steps, sequences, features)."""
        steps, n, d = x.shape
        gates = (x.reshape(-1, d) @ self.w[direction] + self.b[direction]).reshape(steps, n, -1)
        cells, states = (np.zeros((steps + 1, n, STATES), np.float32) for _ in range(2))
        k, u = 3 * STATES, self.u[direction]
        for t in range(steps):
            z = gates[t]
            z += states[t] @ u
            z[:, :k] = 1 / (1 + np.exp(-np.clip(z[:, :k], -30, 30)))
            z[:, k:] = np.tanh(z[:, k:])
            cells[t + 1] = z[:, STATES : 2 * STATES] * cells[t] + z[:, :STATES] * z[:, k:]
            states[t + 1] = z[:, 2 * STATES : k] * np.tanh(cells[t + 1])
        return gates, cells, states

    def probabilities(self, pages: list[list[Block]], vectors: list[np.ndarray]) -> list[np.ndarray]:
        x = self.inputs(pages, vectors)
        ends = np.cumsum([0, *map(len, pages)])
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            forward, sizes = _padded([x[ends[i] : ends[i + 1]] for i in some])
            backward, _ = _padded([x[ends[i] : ends[i + 1]][::-1] for i in some])
            f, b = self._run(0, forward)[2][1:], self._run(1, backward)[2][1:]
            for j, (i, n) in enumerate(zip(some, sizes, strict=True)):
                score = f[:n, j] @ self.out[:STATES] + b[:n, j][::-1] @ self.out[STATES:] + self.bias
                out[i] = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    sizes = [len(r) for r in rows]
    x = np.zeros((max(sizes), len(rows), rows[0].shape[1]), np.float32)
    for j, r in enumerate(rows):
        x[: len(r), j] = r
    return x, sizes


class _Adam:
    def __init__(self, parts: list[np.ndarray]) -> None:
        self.parts = parts
        self.first, self.second = ([np.zeros_like(p) for p in parts] for _ in range(2))
        self.step = 0

    def apply(self, gradients: list[np.ndarray], rate: float) -> None:
        self.step += 1
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in gradients)))
        shrink = np.float32(min(1.0, 5.0 / (norm + 1e-9)))
        scale = np.float32(rate * (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step))
        for p, g, m, v in zip(self.parts, gradients, self.first, self.second, strict=True):
            g = g * shrink
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.001) * (g * g - v)
            p -= scale * m / (np.sqrt(v) + np.float32(1e-8))


@dataclass
class _Page:
    """A labelled page as sparse features: entries (block, bucket, weight) of its paths and of its words."""

    n: int
    path: tuple[np.ndarray, np.ndarray, np.ndarray]
    word: tuple[np.ndarray, np.ndarray, np.ndarray]
    labels: np.ndarray


def _sparse(blocks: list[Block], labels: list[bool], paths: Paths) -> _Page:
    path, word = [], []
    for i, b in enumerate(blocks):
        path += [(i, t, 1.0) for t in block_tokens(b)]
        node, weight = b.node, 1.0
        while node:
            path += [(i, t, weight) for t in paths.tokens[node]]
            node, weight = paths.parents[node], weight * DECAY
        ids = word_ids(b.text)
        word += [(i, t, 1 / len(ids)) for t in ids]

    def columns(entries: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, t, w = zip(*entries, strict=True)
        return np.array(i), np.array(t), np.array(w, np.float32)

    return _Page(len(blocks), columns(path), columns(word), np.array(labels, np.float32))


def _sums(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Sum of the rows of each key; equal keys stand together."""
    return np.add.reduceat(rows, np.flatnonzero(np.diff(keys, prepend=-1)), axis=0)


def _gradients(net: Network, pages: list[_Page]) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy over the blocks of some pages."""
    steps, n = max(p.n for p in pages), len(pages)
    d = PATH_SIZE + WORD_SIZE
    sizes = [p.n for p in pages]
    starts = np.cumsum([0, *sizes])
    step = np.concatenate([np.arange(k) for k in sizes])
    page = np.repeat(np.arange(n), sizes)
    entries = []
    for kind in ("path", "word"):
        i, t, w = (np.concatenate(c) for c in zip(*[getattr(p, kind) for p in pages], strict=True))
        entries.append((i + np.repeat(starts[:-1], [len(getattr(p, kind)[0]) for p in pages]), t, w[:, None]))
    (pi, pt, pw), (wi, wt, ww) = entries
    x = np.zeros((steps, n, d), np.float32)
    x[step, page, :PATH_SIZE] = _sums(net.path[pt] * pw, pi)
    x[step, page, PATH_SIZE:] = _sums(net.word[wt] * ww, wi)
    labels, mask = np.zeros((steps, n), np.float32), np.zeros((steps, n), np.float32)
    turn = np.tile(np.arange(steps)[:, None], (1, n))
    for j, p in enumerate(pages):
        labels[: p.n, j], mask[: p.n, j] = p.labels, 1
        turn[: p.n, j] = np.arange(p.n)[::-1]
    every = np.arange(n)[None, :]
    inputs = (x, x[turn, every])
    runs = [net._run(k, inputs[k]) for k in (0, 1)]
    f, b = runs[0][2][1:], runs[1][2][1:][turn, every]
    both = np.concatenate([f, b], axis=2)
    score = both @ net.out + net.bias
    delta = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels) * mask / mask.sum()
    d_out = np.einsum("tn,tnh->h", delta, both)
    d_both = delta[:, :, None] * net.out
    d_states = (d_both[:, :, :STATES], d_both[:, :, STATES:][turn, every])
    d_x = np.zeros_like(x)
    d_w, d_u, d_b = np.zeros_like(net.w), np.zeros_like(net.u), np.zeros_like(net.b)
    k = 3 * STATES
    for way in (0, 1):
        gates, cells, states = runs[way]
        d_gates = np.zeros_like(gates)
        d_h, d_c = np.zeros((n, STATES), np.float32), np.zeros((n, STATES), np.float32)
        for t in range(steps - 1, -1, -1):
            z, bent = gates[t], np.tanh(cells[t + 1])
            i, forget, o, g = z[:, :STATES], z[:, STATES : 2 * STATES], z[:, 2 * STATES : k], z[:, k:]
            d_h = d_h + d_states[way][t]
            d_c = d_c + d_h * o * (1 - bent * bent)
            own = d_gates[t]
            own[:, :STATES] = d_c * g * i * (1 - i)
            own[:, STATES : 2 * STATES] = d_c * cells[t] * forget * (1 - forget)
            own[:, 2 * STATES : k] = d_h * bent * o * (1 - o)
            own[:, k:] = d_c * i * (1 - g * g)
            d_c = d_c * forget
            d_h = own @ net.u[way].T
        flat = d_gates.reshape(-1, 4 * STATES)
        d_w[way] = inputs[way].reshape(-1, d).T @ flat
        d_u[way] = states[:-1].reshape(-1, STATES).T @ flat
        d_b[way] = flat.sum(0)
        back = (flat @ net.w[way].T).reshape(steps, n, d)
        d_x += back if way == 0 else back[turn, every] * mask[:, :, None]
    d_rows = d_x[step, page]
    d_path, d_word = np.zeros_like(net.path), np.zeros_like(net.word)
    for total, i, t, w, rows in ((d_path, pi, pt, pw, d_rows[:, :PATH_SIZE]), (d_word, wi, wt, ww, d_rows[:, PATH_SIZE:])):
        order = np.argsort(t, kind="stable")
        total[np.unique(t)] = _sums(rows[i[order]] * w[order], t[order])
    return [d_path, d_word, d_w, d_u, d_b, d_out, delta.sum(keepdims=True).reshape(1)]


def train(pages: list[tuple[list[Block], list[bool]]], paths: Paths, epochs: int = 6, rate: float = 0.02, seed: int = 11) -> Network:
    """Fit on (blocks, labels) pages; the same pages in the same order give the same weights."""
    random = np.random.default_rng(seed)
    net = Network.initial(random)
    data = [_sparse(blocks, labels, paths) for blocks, labels in pages if blocks]
    adam = _Adam(net.parts())
    batches_of = sorted(range(len(data)), key=lambda i: (data[i].n, i))
    batches = [batches_of[at : at + STEP_PAGES] for at in range(0, len(batches_of), STEP_PAGES)]
    for epoch in range(epochs):
        for at, k in enumerate(random.permutation(len(batches))):
            left = 1 - (epoch + at / len(batches)) / epochs
            adam.apply(_gradients(net, [data[i] for i in batches[k]]), rate * max(left, 0.05))
    return net
