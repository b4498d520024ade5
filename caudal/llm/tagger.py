"""A character-level bidirectional LSTM with CRF transitions, trained and decoded in numpy over batches of windows."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # 0 outside, 1 + 2k begins kind k, 2 + 2k goes on
SIGNS = "@.-_+() \n:=,/[]%'\"#"
CLASSES = len(SIGNS) + 6
PAD = CLASSES - 1


def character_classes() -> np.ndarray:
    """Class of each code point under 256; others count as letters."""
    table = np.full(256, len(SIGNS) + 4, np.int64)
    table[ord("0") : ord("9") + 1] = len(SIGNS)
    table[ord("a") : ord("z") + 1] = len(SIGNS) + 1
    table[ord("A") : ord("Z") + 1] = len(SIGNS) + 2
    table[192:256] = len(SIGNS) + 3
    for i, c in enumerate(SIGNS):
        table[ord(c)] = i
    return table


CLASS_OF = character_classes()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 256, CLASS_OF[np.minimum(points, 255)], len(SIGNS) + 3)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    def __init__(self, hidden: int = 14, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * hidden)).astype(np.float32)
            self.p[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            self.p[f"c{d}"] = np.concatenate([np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]).astype(np.float32)
        self.p["e"] = rng.normal(0, 0.3, (2 * hidden, TAGS)).astype(np.float32)
        self.p["a"] = np.zeros(TAGS, np.float32)
        self.p["t"] = np.zeros((TAGS, TAGS), np.float32)
        #: A tag that goes on must follow its own kind.
        self.wall = np.zeros((TAGS, TAGS), np.float32)
        for k in range(len(KINDS)):
            go = 2 + 2 * k
            self.wall[:, go] = -1e4
            self.wall[[1 + 2 * k, go], go] = 0

    def _run(self, ids: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        n, steps, h = len(ids), ids.shape[1], self.hidden
        wx, wh, bias = self.p[f"x{d}"], self.p[f"h{d}"], self.p[f"c{d}"]
        out, state, cell, held = np.zeros((n, steps, h), np.float32), np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = wx[ids[:, t]] + state @ wh + bias
            gates = _sigmoid(z[:, : 3 * h])
            new = np.tanh(z[:, 3 * h :])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            before, cell_before = state, cell
            cell = f * cell + i * new
            squashed = np.tanh(cell)
            state = o * squashed
            out[:, t] = state
            if keep:
                held.append((t, i, f, o, new, squashed, before, cell_before))
        return out, held

    def emissions(self, ids: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        f, held_f = self._run(ids, "f", keep)
        b, held_b = self._run(ids, "b", keep)
        both = np.concatenate([f, b], axis=2)
        return both @ self.p["e"] + self.p["a"], (both, held_f, held_b)

    def slopes(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradient."""
        scores, (both, held_f, held_b) = self.emissions(ids, keep=True)
        n, steps, _ = scores.shape
        move = (self.p["t"] + self.wall).astype(np.float64)
        s = scores.astype(np.float64)
        ahead, back = np.zeros_like(s), np.zeros_like(s)
        ahead[:, 0] = s[:, 0]
        for t in range(1, steps):
            x = ahead[:, t - 1, :, None] + move
            top = x.max(1)
            ahead[:, t] = top + np.log(np.exp(x - top[:, None]).sum(1)) + s[:, t]
        for t in range(steps - 2, -1, -1):
            x = move + (s[:, t + 1] + back[:, t + 1])[:, None, :]
            top = x.max(2)
            back[:, t] = top + np.log(np.exp(x - top[:, :, None]).sum(2))
        last = ahead[:, -1]
        top = last.max(1)
        log_z = top + np.log(np.exp(last - top[:, None]).sum(1))
        pair = np.exp(ahead[:, :-1, :, None] + move + (s[:, 1:] + back[:, 1:])[:, :, None, :] - log_z[:, None, None, None])
        g = {"t": pair.sum((0, 1))}
        np.subtract.at(g["t"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        slope = np.exp(ahead + back - log_z[:, None, None])
        rows, cols = np.arange(n)[:, None], np.arange(steps)[None]
        gold = s[rows, cols, tags].sum(1) + move[tags[:, :-1], tags[:, 1:]].sum(1)
        slope[rows, cols, tags] -= 1
        slope = (slope / n).astype(np.float32)
        g["t"] = (g["t"] / n).astype(np.float32)
        g["e"], g["a"] = np.einsum("nth,ntk->hk", both, slope, optimize=True), slope.sum((0, 1))
        down, h = slope @ self.p["e"].T, self.hidden
        for d, held, part in (("f", held_f, down[:, :, :h]), ("b", held_b, down[:, :, h:])):
            gx, gh, gc = (np.zeros_like(self.p[f"{k}{d}"]) for k in "xhc")
            to_state, to_cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t, i, f, o, new, squashed, before, cell_before in reversed(held):
                ds = part[:, t] + to_state
                dc = to_cell + ds * o * (1 - squashed * squashed)
                dz = np.concatenate([dc * new * i * (1 - i), dc * cell_before * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - new * new)], axis=1)
                np.add.at(gx, ids[:, t], dz)
                gh += before.T @ dz
                gc += dz.sum(0)
                to_state, to_cell = dz @ self.p[f"h{d}"].T, dc * f
            g[f"x{d}"], g[f"h{d}"], g[f"c{d}"] = gx, gh, gc
        return float((log_z - gold).mean()), g

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int = 64, rate: float = 0.02, seed: int = 11) -> list[float]:
        rng, first, second, losses = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(ids), batch)
            loss, g = self.slopes(ids[pick], tags[pick])
            losses.append(loss)
            size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, x in g.items():
                x = x * min(1.0, 5 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * x
                second[k] = 0.99 * second[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each window (Viterbi), and each place's margin: its emission and move into it over those of staying outside."""
        s, _ = self.emissions(ids)
        move = self.p["t"] + self.wall
        best, came = s[:, 0] + np.where(np.isin(np.arange(TAGS), np.arange(2, TAGS, 2)), np.float32(-1e4), np.float32(0)), []
        for t in range(1, s.shape[1]):
            x = best[:, :, None] + move
            came.append(x.argmax(1))
            best = x.max(1) + s[:, t]
        tags = np.zeros(ids.shape, np.int64)
        tags[:, -1] = best.argmax(1)
        for t in range(s.shape[1] - 2, -1, -1):
            tags[:, t] = came[t][np.arange(len(ids)), tags[:, t + 1]]
        margins = np.take_along_axis(s, tags[:, :, None], 2)[:, :, 0] - s[:, :, 0]
        margins[:, 1:] += move[tags[:, :-1], tags[:, 1:]] - move[0, 0]
        return tags, margins
