"""A small causal self-attention model of subwords in numpy: windows, training, scores.

A text is the start symbol and its subwords; what follows each of them is predicted, at the end the end symbol. Windows of
``CONTEXT + SPAN`` inputs overlap so that each of the last ``SPAN`` has at least ``CONTEXT`` inputs before it, where the text
has as many, and is scored in one window only. A batch of windows goes through masked attention at once.

The output is normalised over all subwords: the likeliest ``FREQUENT`` ones, by the counts of the whole corpus, form classes
of about equal counts; the network gives the class, then the member. All others are one class, whose members share its
probability by their counts plus one.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass

import numpy as np

CONTEXT, SPAN = 16, 32
WIDTH, HEADS, HIDDEN = 32, 1, 32
FREQUENT, CLASSES, CLASS_SIZE = 2048, 64, 64
#: Windows of a step, steps that a small sample is gone through for, the highest rate, and that of a fitted network that goes on.
BATCH, STEPS, RATE, RATE_ON = 64, 600, 4e-3, 2e-3
#: Windows scored at once: their weights stay in a core's cache.
TOGETHER = 64
NOTHING = -1
_LENGTH = CONTEXT + SPAN
_FAR = np.float32(-1e9)
_LEAST = np.float32(1e-30)
_SCALE = np.float32((WIDTH // HEADS) ** -0.5)


@dataclass(frozen=True)
class Vocabulary:
    """Which subwords are inputs and outputs of their own, and how outputs fall into classes.

    ``place`` gives for each subword its number among the frequent ones by falling count, or ``len(frequent)``.
    """

    place: np.ndarray
    starts: np.ndarray  # first number of each class, and the end
    prior: np.ndarray  # counts of the classes, the last for all other subwords
    counts: np.ndarray  # counts of the frequent subwords
    rest: np.ndarray  # log10 of the share of its class, for each other subword

    @property
    def size(self) -> int:
        return int(self.starts[-1])

    @property
    def member_class(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts)), np.diff(np.append(self.starts, self.size + 1)))


def make_vocabulary(counts: np.ndarray, end: int) -> Vocabulary:
    """``counts`` of every subword; ``end`` is always among the frequent ones."""
    counts = counts.astype(np.float64)
    rank = counts.copy()
    rank[end] = max(rank[end], 0.5)
    order = np.argsort(-rank, kind="stable")
    held = order[: min(FREQUENT, int((rank > 0).sum()))]
    if end not in held:
        held = np.append(held[:-1], end)
    place = np.full(len(counts), len(held), dtype=np.int64)
    place[held] = np.arange(len(held))
    mass, starts = counts[held] + 1, [0]
    for k in range(1, len(held)):
        if mass[starts[-1] : k].sum() >= mass.sum() / CLASSES or k - starts[-1] == CLASS_SIZE:
            starts.append(k)
    others = np.flatnonzero(place == len(held))
    rest = np.zeros(len(counts))
    share = counts[others] + 1
    rest[others] = np.log10(share / share.sum()) if len(others) else 0
    prior = np.append(np.add.reduceat(mass, starts), share.sum() if len(others) else 1e-9)
    return Vocabulary(place, np.append(starts, len(held)), prior, mass, rest)


def windows(inputs: np.ndarray, lengths: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of all windows, and each window's text.

    ``inputs`` are the outputs of all texts, one after the other, of ``lengths`` (1 at least): what is input at a place is the
    output before it, and at a text's first place the end of ``prefix``, which stands before it. ``NOTHING`` is no input.
    """
    many = -(-lengths // SPAN)
    at = np.concatenate(([0], np.cumsum(many * SPAN + CONTEXT)))
    held, wanted = np.full(at[-1], NOTHING, dtype=np.int64), np.full(at[-1], NOTHING, dtype=np.int64)
    first = np.cumsum(lengths) - lengths
    text = np.repeat(np.arange(len(lengths)), lengths)
    place = at[text] + CONTEXT + np.arange(len(inputs)) - first[text]
    wanted[place] = inputs
    inner = np.ones(len(inputs), dtype=bool)
    inner[first + lengths - 1] = False
    held[place[inner] + 1] = inputs[inner]
    near = prefix[-CONTEXT - 1 :]
    held[(at[:-1] + CONTEXT - len(near) + 1)[:, None] + np.arange(len(near))] = near
    owner = np.repeat(np.arange(len(lengths)), many)
    start = at[owner] + SPAN * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
    grid = start[:, None] + np.arange(_LENGTH)
    return held[grid], wanted[grid[:, CONTEXT:]], owner


class Scratch:
    """Memory of results that the next batch overwrites: asked for anew each time, pages would be zeroed for every batch."""

    def __init__(self):
        self.held: dict[tuple, np.ndarray] = {}

    def __call__(self, name: str, *shape: int, dtype=np.float32) -> np.ndarray:
        size, key = int(np.prod(shape)), (name, np.dtype(dtype))
        if key not in self.held or self.held[key].size < size:
            self.held[key] = np.empty(size, dtype)
        return self.held[key][:size].reshape(shape)


def _weights(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax weights in place and their sums along the last axis. Logits are held within what float32 can sum."""
    if x.size and x.max() > 60:
        np.minimum(x, 60, out=x)
    np.exp(x, out=x)
    return x, np.maximum(x @ np.ones((x.shape[-1], 1), x.dtype), np.float32(1e-35))


def _softmax(x: np.ndarray) -> np.ndarray:
    x, total = _weights(x)
    x /= total
    return x


class Network:
    """Weights, forward and backward passes. Inputs are numbers of frequent subwords, then: other, start, nothing."""

    def __init__(self, vocabulary: Vocabulary, seed: int = 1):
        self.vocabulary = v = vocabulary
        rng = np.random.default_rng(seed)
        some = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        classes = len(v.starts)
        self.weights = {
            "embed": some(v.size + 3, WIDTH, scale=0.3), "near": np.zeros((HEADS, _LENGTH), np.float32),
            "q": some(WIDTH, WIDTH, scale=WIDTH**-0.5), "k": some(WIDTH, WIDTH, scale=WIDTH**-0.5), "v": some(WIDTH, WIDTH, scale=WIDTH**-0.5), "o": some(WIDTH, WIDTH, scale=0.5 * WIDTH**-0.5),
            "up": some(WIDTH, HIDDEN, scale=WIDTH**-0.5), "up0": np.zeros(HIDDEN, np.float32), "down": some(HIDDEN, WIDTH, scale=HIDDEN**-0.5),
            "class": some(WIDTH, classes, scale=0.1), "class0": np.log(v.prior / v.prior.sum()).astype(np.float32),
            "member": some(v.size, WIDTH, scale=0.1), "member0": np.log(v.counts / v.counts.sum()).astype(np.float32),
        }
        # how far a query looks back, and what it may not see
        self.distance = CONTEXT + np.arange(SPAN)[:, None] - np.arange(_LENGTH)
        self.member_class, self.bands = v.member_class, self._bands()
        self.table = np.concatenate((v.place, [v.size + 1, v.size + 2]))

    def numbers(self, subwords: np.ndarray) -> np.ndarray:
        """Inputs as numbers; ``len(place)`` is the start symbol."""
        return self.table[subwords]  # NOTHING is the table's last

    def _hide(self, scores: np.ndarray, inputs: np.ndarray) -> None:
        """Inputs that aren't there are not looked at; after a text's end the mask does as much."""
        absent = inputs[:, :CONTEXT] == self.vocabulary.size + 2
        some = np.flatnonzero(absent.any(axis=1))
        if len(some):
            scores[some, ..., :CONTEXT] += np.where(absent[some], _FAR, np.float32(0)).reshape(len(some), *[1] * (scores.ndim - 2), CONTEXT)

    def _tables(self) -> list[tuple[np.ndarray, ...]]:
        """What an input is as a query, a key and a mixed-in value of each head, and the biases: for scoring, products are looked up."""
        w, size = self.weights, WIDTH // HEADS
        of = lambda name: w["embed"] @ w[name]
        heads = [slice(i * size, (i + 1) * size) for i in range(HEADS)]
        bias = np.where(self.distance >= 0, w["near"][:, np.maximum(self.distance, 0)], _FAR)
        return [((of("q") * _SCALE)[:, h].copy(), of("k")[:, h].copy(), of("v")[:, h] @ w["o"][h], b) for h, b in zip(heads, bias, strict=True)]

    def _outputs(self, inputs: np.ndarray, tables: list[tuple[np.ndarray, ...]], of: Scratch) -> np.ndarray:
        """What the output layers read."""
        w, own, n = self.weights, np.ascontiguousarray(inputs[:, CONTEXT:]), len(inputs)
        take = lambda name, table, at: np.take(table, at, axis=0, out=of(name, *at.shape, table.shape[1]), mode="clip")
        h = take("h", w["embed"], own)
        for queries, keys, values, bias in tables:
            scores = np.matmul(take("queries", queries, own), take("keys", keys, inputs).transpose(0, 2, 1), out=of("scores", n, SPAN, _LENGTH))
            scores += bias
            self._hide(scores, inputs)
            seen, total = _weights(scores)
            mixed = np.matmul(seen, take("values", values, inputs), out=of("mixed", n, SPAN, WIDTH))
            mixed /= total
            h += mixed
        h = h.reshape(-1, WIDTH)
        z = np.matmul(h, w["up"], out=of("z", len(h), HIDDEN))
        z += w["up0"]
        m = np.matmul(np.maximum(z, 0, out=z), w["down"], out=of("m", len(h), WIDTH))
        m += h
        return m

    def _members(self, m: np.ndarray, numbers: np.ndarray, use) -> None:
        """Calls ``use(rows, first, last, p)`` with the members' probabilities for the rows of each class of several members."""
        order = np.argsort(numbers.astype(np.uint16), kind="stable")
        edges = np.searchsorted(numbers[order], self.vocabulary.starts)
        for first, last, i, j in zip(self.vocabulary.starts[:-1], self.vocabulary.starts[1:], edges[:-1], edges[1:], strict=True):
            if i < j and last - first > 1:
                rows = order[i:j]
                use(rows, first, last, _softmax(m[rows] @ self.weights["member"][first:last].T + self.weights["member0"][first:last]))

    def scores(self, inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """The log10 probability of every target, 0 for ``NOTHING``. Any number of windows goes through in small batches."""
        flat = targets.ravel()
        wanted = np.flatnonzero(flat != NOTHING)
        numbers = self.vocabulary.place[flat[wanted]]
        kinds, edges = self.member_class[numbers], np.searchsorted(wanted, np.arange(0, len(inputs) + TOGETHER, TOGETHER) * SPAN)
        ids, tables, hidden, got = self.numbers(inputs), self._tables(), np.empty((len(wanted), WIDTH), np.float32), np.empty(len(wanted))
        scratch = Scratch()
        for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            first = k * TOGETHER
            m = self._outputs(ids[first : first + TOGETHER], tables, scratch)
            np.take(m, wanted[i:j] - first * SPAN, axis=0, out=hidden[i:j], mode="clip")
            p = np.matmul(hidden[i:j], self.weights["class"], out=scratch("p", j - i, len(self.weights["class0"])))
            p += self.weights["class0"]
            p, total = _weights(p)
            got[i:j] = p[np.arange(j - i), kinds[i:j]] / total[:, 0]

        def multiply(rows: np.ndarray, first: int, last: int, p: np.ndarray) -> None:
            got[rows] *= p[np.arange(len(rows)), numbers[rows] - first]

        self._members(hidden, numbers, multiply)
        out = np.zeros(len(flat))
        out[wanted] = np.log10(np.maximum(got, _LEAST)) + self.vocabulary.rest[flat[wanted]]
        return out.reshape(targets.shape)

    def _bands(self) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of classes of several members by about equal size: first and last class, their members' numbers, a row each, and which
        of these there are."""
        v, at, bands = self.vocabulary, 0, []
        size = np.diff(v.starts)
        while at < len(size):
            end = at + 1
            while end < len(size) and size[end] <= (2 * size[at] if size[at] > 1 else 1):
                end += 1
            if size[at] > 1:
                there = np.arange(size[at:end].max()) < size[at:end, None]
                bands.append((at, end, np.minimum(v.starts[at:end, None] + np.arange(there.shape[1]), v.size - 1), there))
            at = end
        return bands

    def _member_gradients(self, rows: np.ndarray, numbers: np.ndarray, scale: float, g: dict[str, np.ndarray], d: np.ndarray, of) -> float:
        """Adds what the members of classes give to the gradients, all classes of a band at once; the sum of their losses.
        The rows are sorted by their numbers."""
        w, loss, starts = self.weights, 0.0, self.vocabulary.starts
        edges = np.searchsorted(numbers, starts)
        for at, end, members, there in self.bands:
            low, high, many = edges[at], edges[end], edges[at + 1 : end + 1] - edges[at:end]
            if low == high:
                continue
            # each class has as many places; those that no row takes are zero
            kinds, size, top = end - at, members.shape[1], int(many.max())
            band = np.repeat(np.arange(kinds), many)
            place = np.arange(low, high) + (np.arange(kinds) * top - edges[at:end])[band]
            x = of("x_of_band", kinds * top, WIDTH)
            x[:] = 0
            x[place] = rows[low:high]
            x = x.reshape(kinds, top, WIDTH)
            table = np.take(w["member"], members, axis=0, out=of("members", kinds, size, WIDTH), mode="clip")
            p = np.matmul(x, table.transpose(0, 2, 1), out=of("p_of_band", kinds, top, size))
            p += np.where(there, w["member0"][members], _FAR)[:, None]
            p = _softmax(p)
            own = place * size + numbers[low:high] - starts[at:end][band]
            chosen = p.reshape(-1)[own]
            loss -= float(np.log(np.maximum(chosen, _LEAST)).sum())
            p.reshape(-1)[own] = chosen - 1
            p *= scale
            # a run's members follow one another
            run = slice(starts[at], starts[end])
            g["member"][run] = np.matmul(p.transpose(0, 2, 1), x, out=of("member", kinds, size, WIDTH))[there]
            g["member0"][run] = ((np.arange(top) < many[:, None]).astype(p.dtype)[:, None] @ p)[:, 0][there]
            d[low:high] += np.matmul(p, table, out=x).reshape(-1, WIDTH)[place]
        return loss

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, g: dict[str, np.ndarray] | None = None, scratch: Scratch | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss a target in nats, and its gradients, in ``g`` if that is given."""
        w, n, kind = self.weights, len(inputs), self.weights["q"].dtype
        own_memory = scratch or Scratch()
        of = lambda name, *shape: own_memory(name, *shape, dtype=kind)
        size, places = WIDTH // HEADS, n * _LENGTH
        ids = self.numbers(inputs)
        # forward: as for scoring, with all that the way back needs
        x = np.take(w["embed"], ids, axis=0, out=of("x", n, _LENGTH, WIDTH), mode="clip")
        own = of("own", n * SPAN, WIDTH)
        own.reshape(n, SPAN, WIDTH)[:] = x[:, CONTEXT:]
        both = np.concatenate((w["k"], w["v"]), axis=1)
        split = lambda y: y.reshape(n, -1, HEADS, size).transpose(0, 2, 1, 3)
        q = split(np.matmul(own, w["q"] * _SCALE, out=of("q", n * SPAN, WIDTH)))
        kv = np.matmul(x.reshape(places, WIDTH), both, out=of("kv", places, 2 * WIDTH))
        k, v = split(kv[:, :WIDTH]), split(kv[:, WIDTH:])
        seen = np.matmul(q, k.transpose(0, 1, 3, 2), out=of("seen", n, HEADS, SPAN, _LENGTH))
        seen += np.where(self.distance >= 0, w["near"][:, np.maximum(self.distance, 0)], _FAR)
        self._hide(seen, ids)
        seen, total = _weights(seen)
        seen /= total
        mixed = of("mixed", n * SPAN, WIDTH)
        np.matmul(seen, v, out=split(mixed))
        h = np.matmul(mixed, w["o"], out=of("h", n * SPAN, WIDTH))
        h += own
        z = np.matmul(h, w["up"], out=of("z", n * SPAN, HIDDEN))
        z += w["up0"]
        np.maximum(z, 0, out=z)
        m = np.matmul(z, w["down"], out=of("m", n * SPAN, WIDTH))
        m += h
        # outputs
        flat = targets.ravel()
        wanted = np.flatnonzero(flat != NOTHING)
        numbers = self.vocabulary.place[flat[wanted]]
        order = np.argsort(numbers.astype(np.uint16), kind="stable")
        wanted, numbers = wanted[order], numbers[order]
        rows = np.take(m, wanted, axis=0, out=of("rows", len(wanted), WIDTH), mode="clip")
        kinds, scale, each = self.member_class[numbers], np.float32(1 / max(1, len(wanted))), np.arange(len(wanted))
        p = np.matmul(rows, w["class"], out=of("p", len(wanted), w["class"].shape[1]))
        p += w["class0"]
        p = _softmax(p)
        loss = -float(np.log(np.maximum(p[each, kinds], _LEAST)).sum())
        p[each, kinds] -= 1
        p *= scale
        if g is None:
            g = {name: np.empty_like(value) for name, value in w.items()}
        g["embed"][:], g["member"][:], g["member0"][:] = 0, 0, 0
        np.matmul(rows.T, p, out=g["class"])
        np.sum(p, axis=0, out=g["class0"])
        d = np.matmul(p, w["class"].T, out=of("d", len(wanted), WIDTH))
        loss += self._member_gradients(rows, numbers, scale, g, d, of)
        # back
        dm = of("dm", n * SPAN, WIDTH)
        dm[:] = 0
        dm[wanted] = d
        np.matmul(z.T, dm, out=g["down"])
        dz = np.matmul(dm, w["down"].T, out=of("dz", n * SPAN, HIDDEN))
        dz *= z > 0
        np.matmul(h.T, dz, out=g["up"])
        np.sum(dz, axis=0, out=g["up0"])
        dh = np.matmul(dz, w["up"].T, out=of("dh", n * SPAN, WIDTH))
        dh += dm
        np.matmul(mixed.T, dh, out=g["o"])
        dmixed = split(np.matmul(dh, w["o"].T, out=of("dmixed", n * SPAN, WIDTH)))
        dq, dkv = of("dq", n * SPAN, WIDTH), of("dkv", places, 2 * WIDTH)
        np.matmul(seen.transpose(0, 1, 3, 2), dmixed, out=split(dkv[:, WIDTH:]))
        ds = np.matmul(dmixed, v.transpose(0, 1, 3, 2), out=of("ds", n, HEADS, SPAN, _LENGTH))
        ds *= seen
        # each row's sum goes to its inputs by their weights
        seen *= ds @ np.ones((_LENGTH, 1), kind)
        ds -= seen
        see, by = self.distance >= 0, ds.sum(axis=0)
        for head in range(HEADS):
            g["near"][head] = np.bincount(self.distance[see], weights=by[head][see], minlength=_LENGTH)
        np.matmul(ds, k, out=split(dq))
        dq *= _SCALE
        np.matmul(ds.transpose(0, 1, 3, 2), q, out=split(dkv[:, :WIDTH]))  # q is scaled already
        np.matmul(own.T, dq, out=g["q"])
        whole = x.reshape(places, WIDTH).T @ dkv
        g["k"][:], g["v"][:] = whole[:, :WIDTH], whole[:, WIDTH:]
        dx = np.matmul(dkv, both.T, out=of("dx", places, WIDTH))
        dh += np.matmul(dq, w["q"].T, out=of("dmixed", n * SPAN, WIDTH))
        dx.reshape(n, _LENGTH, WIDTH)[:, CONTEXT:] += dh.reshape(n, SPAN, WIDTH)
        # sums by input: sorted rows, since unbuffered addition is slow
        order = np.argsort(ids.ravel().astype(np.uint16), kind="stable")
        held = ids.ravel()[order]
        first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
        g["embed"][held[first]] = np.add.reduceat(np.take(dx, order, axis=0, out=of("x", places, WIDTH), mode="clip"), first, axis=0)
        return loss / max(1, len(wanted)), g


def train(vocabulary: Vocabulary, inputs: np.ndarray, targets: np.ndarray, seed: int = 1, steps: int = STEPS) -> tuple[Network, list[float]]:
    """A network fitted to windows by Adam, and the mean loss of each step: some ``steps``, whole times through
    the windows and once at least. No windows leave the counts alone to decide."""
    net = Network(vocabulary, seed)
    if not len(inputs):
        for name in ("class", "member"):
            net.weights[name][:] = 0
        return net, []
    once = -(-len(inputs) // BATCH)
    return net, _descend(net, inputs, targets, seed, once * max(1, round(steps / once)), RATE)


def moved(net: Network, inputs: np.ndarray, targets: np.ndarray, seed: int = 1) -> np.ndarray:
    """The weights of a network, one after the other, after going once through windows from where it stands."""
    own = copy.deepcopy(net)
    _descend(own, inputs, targets, seed, -(-len(inputs) // BATCH), RATE_ON)
    return np.concatenate([x.ravel() for x in own.weights.values()])


def with_weights(net: Network, flat: np.ndarray) -> Network:
    """The network with other weights, one after the other."""
    own, at = copy.deepcopy(net), 0
    for name, x in own.weights.items():
        own.weights[name] = flat[at : at + x.size].reshape(x.shape).astype(np.float32)
        at += x.size
    return own


def _descend(net: Network, inputs: np.ndarray, targets: np.ndarray, seed: int, steps: int, highest: float) -> list[float]:
    rng, losses = np.random.default_rng(seed), []
    # one row of all weights, of which the network's are parts
    flat = np.concatenate([x.ravel() for x in net.weights.values()])
    mean, square, step_of, grad = (np.zeros_like(flat) for _ in range(4))
    net.weights, grads, scratch = _parts(flat, net.weights), _parts(grad, net.weights), Scratch()
    once = -(-len(inputs) // BATCH)
    for step in range(steps):
        if step % once == 0:
            order = rng.permutation(len(inputs))
        at = step % once * BATCH
        losses.append(net.gradients(inputs[order[at : at + BATCH]], targets[order[at : at + BATCH]], grads, scratch)[0])
        rate = highest * min(1, (step + 1) / 50) * (1 - 0.95 * step / steps)
        np.subtract(grad, mean, out=step_of)
        step_of *= 0.1
        mean += step_of
        np.multiply(grad, grad, out=step_of)
        step_of -= square
        step_of *= 0.01
        square += step_of
        np.multiply(square, 1 / (1 - 0.99 ** (step + 1)), out=step_of)
        np.sqrt(step_of, out=step_of)
        step_of += 1e-8
        np.divide(mean, step_of, out=step_of)
        step_of *= rate / (1 - 0.9 ** (step + 1))
        flat -= step_of
    return losses


def _parts(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Parts of a row, in the shapes of these."""
    ends = np.cumsum([x.size for x in like.values()])
    return {name: flat[end - x.size : end].reshape(x.shape) for (name, x), end in zip(like.items(), ends.tolist(), strict=True)}
