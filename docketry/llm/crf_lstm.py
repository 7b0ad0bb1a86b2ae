"""A bidirectional LSTM over character classes with a linear-chain CRF on top: training and decoding in numpy."""

from __future__ import annotations

import numpy as np

HIDDEN = 16


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Tagger:
    """Parameters by name; those of the LSTM have a first axis for the direction, forward and backward, which run together."""

    def __init__(self, symbols: int, tags: int, seed: int = 7, hidden: int = HIDDEN, kind: type = np.float64):
        rng = np.random.default_rng(seed)
        h = hidden
        self.hidden, self.tags = h, tags
        p = {"out": rng.normal(0, 0.3, (2 * h, tags)), "bias": np.zeros(tags), "move": np.zeros((tags, tags)), "first": np.zeros(tags), "last": np.zeros(tags)}
        p |= {"x": rng.normal(0, 0.3, (2, symbols, 4 * h)), "h": rng.normal(0, 0.2, (2, h, 4 * h)), "b": np.tile(np.concatenate((np.zeros(h), np.ones(h), np.zeros(2 * h))), (2, 1))}
        self.p = {k: x.astype(kind) for k, x in p.items()}

    def _run(self, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states (steps, windows, both directions' units), each at its own character."""
        n, steps = ids.shape
        h, kind = self.hidden, self.p["out"].dtype
        state, cell, before_state = np.zeros((2, n, h), kind), np.zeros((2, n, h), kind), None
        out, kept = np.empty((steps, n, 2 * h), kind), []
        x, u = self.p["x"] + self.p["b"][:, None, :], self.p["h"]
        given = np.stack((x[0][ids], x[1][ids[:, ::-1]]))
        for t in range(steps):
            z = given[:, :, t] + state @ u
            gate = sigmoid(z[:, :, : 3 * h])
            i, f, o, g = gate[:, :, :h], gate[:, :, h : 2 * h], gate[:, :, 2 * h :], np.tanh(z[:, :, 3 * h :])
            before, before_state = cell, state
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out[t, :, :h], out[steps - 1 - t, :, h:] = state[0], state[1]
            if keep:
                kept.append((i, f, o, g, before, squashed, before_state))
        return out, kept

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """Scores (steps, windows, tags)."""
        return self._run(ids, False)[0] @ self.p["out"] + self.p["bias"]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best tag path of every window, and at each character how far its tag's score is above that of tag 0."""
        score = self.emissions(ids)
        steps, n, _ = score.shape
        best, back = score[0] + self.p["first"], []
        for t in range(1, steps):
            all_ways = best[:, :, None] + self.p["move"]
            back.append(all_ways.argmax(1))
            best = all_ways.max(1) + score[t]
        path = np.empty((n, steps), np.int64)
        path[:, -1] = (best + self.p["last"]).argmax(1)
        for t in range(steps - 2, -1, -1):
            path[:, t] = back[t][np.arange(n), path[:, t + 1]]
        chosen = np.take_along_axis(score.transpose(1, 0, 2), path[:, :, None], 2)[:, :, 0]
        return path, chosen - score[:, :, 0].T

    def odds(self, path: np.ndarray, margin: np.ndarray, begin: int, end: int) -> float:
        """How far a window's path scores above the same path with tag 0 in [begin, end): emissions and moves. `path` and `margin` as decode gives them."""
        other = path.copy()
        other[begin:end] = 0
        move = self.p["move"]
        gain = float(margin[begin:end].sum() + (move[path[:-1], path[1:]] - move[other[:-1], other[1:]]).sum())
        return gain + float(self.p["first"][path[0]] - self.p["first"][other[0]] + self.p["last"][path[-1]] - self.p["last"][other[-1]])

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the windows' tag paths, and its gradient."""
        n, steps = ids.shape
        h, k, p = self.hidden, self.tags, self.p
        kind = p["out"].dtype
        both, kept = self._run(ids, True)
        score = both @ p["out"] + p["bias"]
        alpha, beta = np.empty((steps, n, k), kind), np.empty((steps, n, k), kind)
        alpha[0] = score[0] + p["first"]
        for t in range(1, steps):
            alpha[t] = log_sum(alpha[t - 1][:, :, None] + p["move"], 1) + score[t]
        beta[-1] = p["last"]
        for t in range(steps - 2, -1, -1):
            beta[t] = log_sum(p["move"] + (score[t + 1] + beta[t + 1])[:, None, :], 2)
        total = log_sum(alpha[-1] + p["last"], 1)
        gold = np.zeros((steps, n, k), kind)
        gold[np.arange(steps)[:, None], np.arange(n), tags.T] = 1
        marginal = np.exp(alpha + beta - total[:, None])
        g = {"first": (marginal[0] - gold[0]).sum(0) / n, "last": (marginal[-1] - gold[-1]).sum(0) / n}
        pair = alpha[:-1, :, :, None] + p["move"] + (score[1:] + beta[1:])[:, :, None, :] - total[:, None, None]
        move = np.exp(pair).sum((0, 1))
        np.subtract.at(move, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        g["move"] = move / n
        right = (score * gold).sum() + p["first"][tags[:, 0]].sum() + p["last"][tags[:, -1]].sum() + p["move"][tags[:, :-1], tags[:, 1:]].sum()
        d_score = (marginal - gold) / n
        g["out"], g["bias"] = np.tensordot(both, d_score, ((0, 1), (0, 1))), d_score.sum((0, 1))
        d_both = d_score @ p["out"].T
        d_out = np.stack((d_both[:, :, :h], d_both[::-1, :, h:]), 1)
        back = p["h"].transpose(0, 2, 1)
        d_state, d_cell = np.zeros((2, n, h), kind), np.zeros((2, n, h), kind)
        every = np.empty((2, steps, n, 4 * h), kind)
        for t in range(steps - 1, -1, -1):
            i, f, o, c, before, squashed, _ = kept[t]
            d_state = d_state + d_out[t]
            d_cell = d_cell + d_state * o * (1 - squashed**2)
            dz = every[:, t]
            dz[:, :, :h], dz[:, :, h : 2 * h] = d_cell * c * i * (1 - i), d_cell * before * f * (1 - f)
            dz[:, :, 2 * h : 3 * h], dz[:, :, 3 * h :] = d_state * squashed * o * (1 - o), d_cell * i * (1 - c**2)
            d_state, d_cell = dz @ back, d_cell * f
        states = np.stack([x[6] for x in kept], 1).reshape(2, steps * n, h)
        flat = every.reshape(2, steps * n, 4 * h)
        seen = np.stack((ids.T, ids.T[::-1])).reshape(2, steps * n)
        one_hot = (seen[:, :, None] == np.arange(p["x"].shape[1])).astype(kind)
        g |= {"h": states.transpose(0, 2, 1) @ flat, "x": one_hot.transpose(0, 2, 1) @ flat, "b": flat.sum(1)}
        return float((total.sum() - right) / n), g

    def train(self, ids: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 50, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over shuffled batches; the mean loss of each epoch."""
        rng, losses, step = np.random.default_rng(seed), [], 0
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for epoch in range(epochs):
            order, sums = rng.permutation(len(ids)), []
            for at in range(0, len(ids), batch):
                rows = order[at : at + batch]
                loss, g = self.gradient(ids[rows], tags[rows])
                sums.append(loss)
                step += 1
                for k, x in g.items():
                    x = np.clip(x, -5, 5)
                    m[k] += 0.1 * (x - m[k])
                    v[k] += 0.01 * (x * x - v[k])
                    self.p[k] -= (rate * 0.5 ** (3 * epoch // epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(x.dtype)
            losses.append(float(np.mean(sums)))
        return losses
