"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

#: Character classes: 0 padding, 1..95 printable ASCII, then line ends and blanks, other letters, anything else.
CLASSES = 99


def _alike() -> np.ndarray:
    """Of ASCII: letters in one case, all digits as one, brackets by their side."""
    table = np.arange(128)
    table[ord("A") : ord("Z") + 1] += 32
    table[ord("0") : ord("9") + 1] = ord("0")
    for brackets, one in (("([{<", "("), (")]}>", ")")):
        table[[ord(c) for c in brackets]] = ord(one)
    return table


_ALIKE = _alike()


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    shown = (points >= 32) & (points < 127)
    return np.where(shown, _ALIKE[np.where(shown, points, 0)] - 31, np.where(points < 32, 96, np.where(points >= 0xC0, 97, 98)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    def __init__(self, tags: int, embed: int = 12, hidden: int = 16, seed: int = 5):
        r = np.random.default_rng(seed)
        self.tags, self.hidden = tags, hidden
        p = {"E": r.normal(0, 0.3, (CLASSES, embed)), "Wo": r.normal(0, 0.2, (2 * hidden, tags)), "bo": np.zeros(tags), "T": np.zeros((tags, tags)), "S": np.zeros(tags)}
        for d in "fb":
            p |= {f"Wx{d}": r.normal(0, 0.3, (embed, 4 * hidden)), f"Wh{d}": r.normal(0, 0.2, (hidden, 4 * hidden)), f"b{d}": np.zeros(4 * hidden)}
            p[f"b{d}"][hidden : 2 * hidden] = 1
        self.p = {k: v.astype(np.float32) for k, v in p.items()}

    def _run(self, ids: np.ndarray, d: str, keep: bool):
        """One direction over ids (time, lanes), already in its order of reading."""
        p, n = self.p, self.hidden
        inputs = (p["E"] @ p[f"Wx{d}"] + p[f"b{d}"]).astype(np.float32)
        h = c = np.zeros((ids.shape[1], n), np.float32)
        out, tape = np.empty((*ids.shape, n), np.float32), []
        for t, step in enumerate(ids):
            z = inputs[step] + h @ p[f"Wh{d}"]
            s = _sigmoid(z[:, : 3 * n])
            i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(z[:, 3 * n :])
            before, c_before = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[t] = h
            if keep:
                tape.append((i, f, o, g, c_before, tc, before))
        return out, tape

    def emissions(self, ids: np.ndarray, keep: bool = False):
        forward, tape_f = self._run(ids, "f", keep)
        backward, tape_b = self._run(ids[::-1], "b", keep)
        both = np.concatenate((forward, backward[::-1]), axis=2)
        return both @ self.p["Wo"] + self.p["bo"], (both, tape_f, tape_b)

    def _back(self, ids: np.ndarray, d: str, tape: list, dh_out: np.ndarray, grads: dict) -> None:
        p, n = self.p, self.hidden
        dh, dc = np.zeros_like(dh_out[0]), np.zeros_like(dh_out[0])
        dz_all = np.empty((*ids.shape, 4 * n), np.float32)
        for t in range(len(ids) - 1, -1, -1):
            i, f, o, g, c_before, tc, before = tape[t]
            dh = dh + dh_out[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate((dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)), axis=1)
            dz_all[t] = dz
            grads[f"Wh{d}"] += before.T @ dz
            dh, dc = dz @ p[f"Wh{d}"].T, dc * f
        flat, of = dz_all.reshape(-1, 4 * n), ids.reshape(-1)
        grads[f"b{d}"] += flat.sum(axis=0)
        grads[f"Wx{d}"] += p["E"][of].T @ flat
        np.add.at(grads["E"], of, flat @ p[f"Wx{d}"].T)

    def loss(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of tag rows (time, lanes), and gradients."""
        p, (steps, lanes) = self.p, ids.shape
        e, (both, tape_f, tape_b) = self.emissions(ids, keep=True)
        e = e.astype(np.float64)
        T, start = p["T"].astype(np.float64), p["S"].astype(np.float64)
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + start
        for t in range(1, steps):
            alpha[t] = e[t] + _log_sum(alpha[t - 1][:, :, None] + T, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = _log_sum(T + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = _log_sum(alpha[-1], 1)
        lane = np.arange(lanes)
        path = start[gold[0]] + e[0, lane, gold[0]] + sum(T[gold[t - 1], gold[t]] + e[t, lane, gold[t]] for t in range(1, steps))
        de = np.exp(alpha + beta - z[:, None])
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        grads["S"] = de[0].sum(axis=0)
        np.add.at(grads["S"], gold[0], -1)
        dT = np.zeros_like(T)
        for t in range(1, steps):
            dT += np.exp(alpha[t - 1][:, :, None] + T + (e[t] + beta[t])[:, None, :] - z[:, None, None]).sum(axis=0)
            np.add.at(dT, (gold[t - 1], gold[t]), -1)
        grads["T"] = dT
        np.put_along_axis(de, gold[:, :, None], np.take_along_axis(de, gold[:, :, None], 2) - 1, 2)
        de = (de / lanes).astype(np.float32)
        grads["S"], grads["T"] = grads["S"] / lanes, grads["T"] / lanes
        grads["bo"] += de.sum(axis=(0, 1))
        grads["Wo"] += both.reshape(-1, both.shape[2]).T @ de.reshape(-1, self.tags)
        dh = de @ p["Wo"].T
        self._back(ids, "f", tape_f, dh[:, :, : self.hidden], grads)
        self._back(ids[::-1], "b", tape_b, dh[::-1, :, self.hidden :], grads)
        return float((z - path).mean()), grads

    def fit(self, ids: np.ndarray, gold: np.ndarray, epochs: int, lanes: int = 64, rate: float = 0.01, seed: int = 9) -> list[float]:
        """Adam over rows (examples, time); the losses by epoch."""
        r, step, losses = np.random.default_rng(seed), 0, []
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in "12")
        for epoch in range(epochs):
            order, total = r.permutation(len(ids)), 0.0
            for at in range(0, len(order), lanes):
                rows = order[at : at + lanes]
                loss, grads = self.loss(ids[rows].T, gold[rows].T)
                total += loss * len(rows)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                step += 1
                for k, g in grads.items():
                    g = (g * min(1.0, 5.0 / (norm + 1e-9))).astype(np.float32)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - np.float32(rate * (0.5 ** (epoch / 3))) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(total / len(ids))
        return losses

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tags of one stretch of emissions (time, tags)."""
        T, score, back = self.p["T"], e[0] + self.p["S"], np.empty(e.shape, np.int64)
        for t in range(1, len(e)):
            all_ = score[:, None] + T
            back[t] = all_.argmax(axis=0)
            score = all_.max(axis=0) + e[t]
        out = np.empty(len(e), np.int64)
        out[-1] = score.argmax()
        for t in range(len(e) - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
        return out
