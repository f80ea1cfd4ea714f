"""A causal self-attention model over subword ids, trained and applied with numpy.

One head attends over the last ``BEFORE`` to ``BEFORE + SPAN - 1`` ids.  A key joins an id with the one before it, so the
head can find earlier places that follow the same id.  Beside the head stands a feed-forward path over the
last two ids.  The output is factored: head and path move the class distribution that corpus counts give after
the last id, and counts give the id within its class.  Windows overlap by ``BEFORE`` ids, and each id is scored in one
window only.

Where a softmax has exp(x), this one has max(LEAST, 1 + x / POWER) ** POWER, by squaring: numpy's exp takes
several times as long, and any positive function that is normalised gives probabilities.  With untrained
weights the class distribution is exactly that of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Ids that a window only reads, ids that it scores, width of the head and of the path, windows computed at once.
BEFORE, SPAN, WIDTH, PATH, AT_ONCE = 16, 32, 8, 16, 512
_KEYS = BEFORE + SPAN - 1
#: The power that stands for the exponential (two to SQUARINGS), and the bounds of what is raised to it.
SQUARINGS, LEAST, MOST = 4, 0.02, 60.0
POWER = 1 << SQUARINGS
#: Steps back from the query of scored place i, which stands at BEFORE - 1 + i, to each key.
_GAP = (BEFORE - 1 + np.arange(SPAN))[:, None] - np.arange(_KEYS)[None, :]
_SEEN = (_GAP >= 0).astype(np.float32)
#: Places of a window that are computed together, and how many keys they reach: later ones are not computed.
_PARTS = [(slice(i, i + SPAN // 2), BEFORE - 1 + i + SPAN // 2) for i in (0, SPAN // 2)]
_GAP = np.maximum(_GAP, 0)


@dataclass
class Counts:
    """What the whole corpus says: ``log_class[last, class]`` and ``log_id[last, id]`` within the id's class."""

    classes: np.ndarray
    log_class: np.ndarray
    log_id: np.ndarray
    #: Classes stand in so many groups of equal size, one group after another.
    groups: int = 1

    @classmethod
    def from_pairs(cls, pairs: np.ndarray, n_classes: int, strength: float = 8.0, seed: int = 5, groups: int = 1) -> Counts:
        """``pairs[a, b]``: how often b follows a.  Rows are smoothed by the frequencies of all ids."""
        if n_classes % groups:
            raise ValueError("groups have equally many classes")
        overall = pairs.sum(0) + 0.5
        overall = overall / overall.sum()
        p = (pairs + strength * overall) / (pairs.sum(1, keepdims=True) + strength)
        classes = _cluster(np.sqrt(p), overall, n_classes, seed, groups)
        member = np.zeros((len(classes), n_classes))
        member[np.arange(len(classes)), classes] = 1
        by_class = np.maximum(p @ member, 1e-30)
        return cls(classes, np.log(by_class).astype(np.float32), (np.log(p) - np.log(by_class)[:, classes]).astype(np.float32), groups)


def _cluster(rows: np.ndarray, weight: np.ndarray, n: int, seed: int, groups: int = 1) -> np.ndarray:
    """Classes of ids with like neighbours: k-means on a random projection of what precedes and follows them.

    With ``groups``, ids fall into groups first and each group into its share of the ``n`` classes."""
    rng = np.random.default_rng(seed)
    turn = rng.normal(size=(rows.shape[1], 24)) / 5
    x = np.concatenate([rows @ turn, (rows.T / np.sqrt(weight)[:, None] * np.sqrt(weight)[None, :]) @ turn], 1)
    if groups == 1:
        return _means(x, weight, n)
    group, own = _means(x, weight, groups), np.zeros(len(x), np.int64)
    for g in range(groups):
        if (at := np.flatnonzero(group == g)).size:
            own[at] = g * (n // groups) + _means(x[at], weight[at], n // groups)
    return own


def _means(x: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    common = np.argsort(-weight)
    centre = x[common[:n]].copy()
    own = np.zeros(len(x), np.int64)
    for _ in range(12):
        own = np.argmin((x * x).sum(1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(1)[None, :], 1)
        for c in range(len(centre)):
            if (own == c).any():
                centre[c] = x[own == c].mean(0)
    return own


def windows(ids: np.ndarray, sizes: np.ndarray, end: int, filler: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, text, nth): windows of BEFORE + SPAN + 1 ids, the text that each is of, and its number there.

    ``ids`` are the ids of all texts in a line, each text's ``end`` included, and ``sizes`` how many each text has.
    ``end`` also stands before a text's first id, ``filler`` before that and after its last.
    """
    spans = -(-sizes // SPAN)
    room = BEFORE + 1 + SPAN * spans
    first = np.cumsum(room) - room
    stream = np.full(int(room.sum()), filler, np.int32)
    stream[first + BEFORE] = end
    begin = np.cumsum(sizes) - sizes
    stream[np.repeat(first + BEFORE + 1 - begin, sizes) + np.arange(len(ids))] = ids
    text = np.repeat(np.arange(len(sizes)), spans)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(spans) - spans, spans)
    at = first[text] + SPAN * nth
    rows = np.lib.stride_tricks.sliding_window_view(stream, BEFORE + SPAN + 1)[at] if len(at) else np.empty((0, BEFORE + SPAN + 1), np.int32)
    return rows, text, nth


class Model:
    """Ids are 0 to n_ids - 1; n_ids itself is filler, which no query sees and no score counts."""

    def __init__(self, counts: Counts, seed: int = 3):
        rng = np.random.default_rng(seed)
        m, c = counts.log_class.shape
        self.n_ids, self.groups, self.each = m, counts.groups, c // counts.groups
        table = lambda width: rng.normal(0, 0.3, (m + 1, width)).astype(np.float32)
        self.weights = {
            "query": table(WIDTH),
            "key": table(WIDTH),
            "key_before": table(WIDTH),
            "value": table(WIDTH),
            "last": table(PATH),
            "last_but_one": table(PATH),
            "out": np.zeros((WIDTH + PATH, c), np.float32),
            "near": np.zeros(BEFORE + SPAN, np.float32),  # by distance
        }
        self.classes = np.append(counts.classes, 0)
        of_group = np.log(np.exp(counts.log_class.astype(float)).reshape(m, self.groups, self.each).sum(2))
        within = counts.log_class - of_group.repeat(self.each, 1)
        self.root = np.vstack([np.exp(within / POWER), np.ones((1, c))]).astype(np.float32)
        if self.groups > 1:
            self.weights["out_group"] = np.zeros((WIDTH + PATH, self.groups), np.float32)
            self.root_group = np.vstack([np.exp(of_group / POWER), np.ones((1, self.groups))]).astype(np.float32)
        self.log_id = np.pad(counts.log_id, ((0, 1), (0, 1)))

    def _forward(self, rows: np.ndarray, held: dict[str, np.ndarray], keep: bool = False) -> None:
        """Into ``held``, which keeps the large arrays from call to call: ``h``, hidden values of head and path at each scored
        place; with ``keep`` also what gradients need."""
        w, n = self.weights, len(rows)
        if held.get("n") != n:
            held.clear()
            held["n"] = n
            for i in ("x", "a", "ds")[: 3 if keep else 1]:
                held[i] = [np.empty((n, SPAN // 2, reach), np.float32) for _, reach in _PARTS]
        before, ids, last, two = rows[:, :_KEYS], rows[:, 1 : BEFORE + SPAN], rows[:, BEFORE : BEFORE + SPAN], rows[:, BEFORE - 1 : BEFORE - 1 + SPAN]
        k = w["key"].take(ids, 0)
        k += w["key_before"].take(before, 0)
        k *= np.float32(WIDTH**-0.5 / POWER)
        q, v = w["query"].take(last, 0), w["value"].take(ids, 0)
        turned, near = _turned(k), (1 + w["near"] / np.float32(POWER))[_GAP]
        filler = ids[:, :BEFORE] == self.n_ids
        at = np.flatnonzero(filler.any(1))
        found, whole = np.empty((n, SPAN, WIDTH), np.float32), np.empty((n, SPAN, WIDTH), np.float32)
        for i, (places, reach) in enumerate(_PARTS):
            x = held["x"][i]
            np.matmul(q[:, places], turned[:, :, :reach], out=x)
            x += near[places, :reach]
            a = _raised(x, held["a"][i] if keep else x)
            a *= _SEEN[places, :reach]
            if at.size:
                a[at, :, :BEFORE] *= ~filler[at][:, None, :]
            np.matmul(a, v[:, :reach], out=found[:, places])
            # sums stand WIDTH times, since whole arrays are divided far faster than rows of a few numbers
            whole[:, places] = (a.reshape(-1, reach) @ np.ones((reach, WIDTH), np.float32)).reshape(n, -1, WIDTH)
        found /= whole
        found, whole = found.reshape(-1, WIDTH), whole.reshape(-1, WIDTH)
        # columns for the head's values are left free beside the path's
        h = np.pad(w["last"], ((0, 0), (WIDTH, 0))).take(last.ravel(), 0)
        h += np.pad(w["last_but_one"], ((0, 0), (WIDTH, 0))).take(two.ravel(), 0)
        np.maximum(h, 0, out=h)
        h[:, :WIDTH] = found
        held |= {"k": k, "q": q, "v": v, "whole": whole, "found": found, "h": h}

    def _order(self, goal: np.ndarray) -> np.ndarray:
        """The real places; those whose goals are of a group stand together, so that each group's classes are one product."""
        real = np.flatnonzero(goal != self.n_ids)
        if self.groups == 1:
            return real
        return real.take(np.argsort((self.classes.take(goal.take(real)) // self.each).astype(np.uint8), kind="stable"))

    def _levels(self, h: np.ndarray, last: np.ndarray, goal: np.ndarray) -> Iterator[tuple]:
        """Of each level of the output, groups and then classes within the goal's group, for places as ``_order`` has them:
        (name, what the power is taken of, place of each goal's among all of these, places and weights that belong together)."""
        aim, line = self.classes.take(goal), np.arange(len(goal))
        group = aim // self.each
        for name, root, n in (("out_group", "root_group", self.groups), ("out", "root", self.each)):
            out = self.weights.get(name)
            if out is None:
                continue
            whole = name == "out_group"
            x = getattr(self, root).reshape(-1, n).take(last if whole else last * self.groups + group, 0)
            ends = [0, len(goal)] if whole else np.searchsorted(group, np.arange(self.groups + 1)).tolist()
            parts = [(slice(*ends[i : i + 2]), slice(i * n, i * n + n)) for i in range(len(ends) - 1) if ends[i] < ends[i + 1]]
            for places, classes in parts:
                x[places] += h[places] @ (np.ascontiguousarray(out[:, classes]) / np.float32(POWER))
            yield name, x, line * n + (group if whole else aim - group * n), parts

    def log_probabilities(self, rows: np.ndarray) -> np.ndarray:
        """Natural-log probability of each window's scored places; filler has 0."""
        out, held = np.zeros((len(rows), SPAN), np.float32), {}
        for at in range(0, len(rows), AT_ONCE):
            some = rows[at : at + AT_ONCE]
            self._forward(some, held)
            last, goal = some[:, BEFORE : BEFORE + SPAN].ravel(), some[:, BEFORE + 1 :].ravel()
            order = self._order(goal)
            last, goal = last.take(order), goal.take(order)
            found = self.log_id.take(last * np.int64(self.n_ids + 1) + goal)
            for _, x, aim, _ in self._levels(held["h"].take(order, 0), last, goal):
                np.clip(x, LEAST, MOST, out=x)
                logs = np.log(x.take(aim))
                logs *= POWER
                found += logs
                found -= np.log(_raised(x, x) @ np.ones(x.shape[1], np.float32))
            out[at : at + AT_ONCE].reshape(-1)[order] = found
        return out

    def gradients(self, rows: np.ndarray, held: dict[str, np.ndarray] | None = None) -> tuple[dict[str, np.ndarray], list[tuple[str, np.ndarray, np.ndarray]]]:
        """Of the mean loss over the rows' real places: whole arrays, and (table, ids, gradient of each) to be summed."""
        w, held = self.weights, {} if held is None else held
        self._forward(rows, held, keep=True)
        k, q, v, h = (held[i] for i in ("k", "q", "v", "h"))
        before, ids, last, two = rows[:, :_KEYS], rows[:, 1 : BEFORE + SPAN], rows[:, BEFORE : BEFORE + SPAN], rows[:, BEFORE - 1 : BEFORE - 1 + SPAN]
        goal = rows[:, BEFORE + 1 :].ravel()
        order = self._order(goal)
        own = h.take(order, 0)
        back = np.zeros((len(order) + 1, WIDTH + PATH), np.float32)  # the last row stands for filler
        found, share = {}, np.float32(max(1, len(order)))
        for name, z, aim, parts in self._levels(own, last.ravel().take(order), goal.take(order)):
            p = _raised(z, np.empty_like(z))
            p /= p @ np.full((p.shape[1], p.shape[1]), share)
            flat = p.reshape(-1)
            flat[aim] -= 1 / share
            p /= z
            found[name] = np.zeros(w[name].shape, np.float32)
            for places, classes in parts:
                found[name][:, classes] = own[places].T @ p[places]
                back[places] += p[places] @ np.ascontiguousarray(w[name][:, classes].T)
        at = np.full(len(goal), len(order))
        at[order] = np.arange(len(order))
        path = back.take(at, 0)
        dh = np.ascontiguousarray(path[:, :WIDTH])
        path *= h > 0
        path = np.ascontiguousarray(path[:, WIDTH:])
        dh /= held["whole"]
        within = (dh * held["found"]) @ np.ones(WIDTH, np.float32)
        dh = dh.reshape(q.shape)
        found["near"] = np.zeros(BEFORE + SPAN, np.float32)
        dv, dk, dq = np.zeros(v.shape, np.float32), np.zeros(k.shape, np.float32), np.empty(q.shape, np.float32)
        turned, within = _turned(v), within.reshape(len(rows), SPAN, 1)
        for i, (places, reach) in enumerate(_PARTS):
            x, a, ds, some = held["x"][i], held["a"][i], held["ds"][i], dh[:, places]
            np.matmul(some, turned[:, :, :reach], out=ds)
            ds -= within[:, places]
            ds *= a
            ds /= x
            found["near"] += np.bincount(_GAP[places, :reach].ravel(), np.ones(len(rows), np.float32) @ ds.reshape(len(rows), -1), BEFORE + SPAN).astype(np.float32)
            dv[:, :reach] += a.transpose(0, 2, 1) @ some
            dk[:, :reach] += ds.transpose(0, 2, 1) @ q[:, places]
            np.matmul(ds, k[:, :reach], out=dq[:, places])
        dk *= np.float32(WIDTH**-0.5)
        dq *= np.float32(POWER)
        return found, [("query", last, dq), ("last", last, path), ("key", ids, dk), ("value", ids, dv), ("key_before", before, dk), ("last_but_one", two, path)]

    def train(self, rows: np.ndarray, epochs: int = 1, batch: int = 64, rate: float = 0.05, seed: int = 9) -> None:
        """Passes over the rows in random order, at a pace that falls to nothing."""
        rng, adam = np.random.default_rng(seed), Adam(self)
        steps = epochs * -(-len(rows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                adam.step(rows[order[at : at + batch]], rate * (1 - adam.steps / steps))

    def flat(self) -> np.ndarray:
        """All weights in a line, in the order of their names."""
        return np.concatenate([self.weights[k].ravel() for k in sorted(self.weights)])

    def unflat(self, line: np.ndarray) -> None:
        at = 0
        for k in sorted(self.weights):
            w = self.weights[k]
            self.weights[k] = line[at : at + w.size].reshape(w.shape).astype(np.float32, copy=False)
            at += w.size


class Adam:
    """Steps on the class likelihood, of all weights at once; the counts stay as they are."""

    def __init__(self, model: Model):
        self.model, self.steps, self.held, self.line = model, 0, {}, model.flat()
        model.unflat(self.line)  # from now on the model's weights are parts of the line
        self.first, self.second, self.grad = (np.zeros_like(self.line) for _ in range(3))
        self.parts, at = {}, 0
        for k in sorted(model.weights):
            self.parts[k] = self.grad[at : at + model.weights[k].size].reshape(model.weights[k].shape)
            at += model.weights[k].size

    def step(self, rows: np.ndarray, rate: float) -> None:
        whole, by_id = self.model.gradients(rows, self.held)
        self.steps += 1
        g, m, s = self.grad, self.first, self.second
        g[:] = 0
        for name, found in whole.items():
            self.parts[name][:] = found
        for name, where, found in _summed(by_id):
            self.parts[name][where] = found
        m *= np.float32(0.9)
        m += np.float32(0.1) * g
        s *= np.float32(0.99)
        g *= g
        g *= np.float32(0.01)
        s += g
        np.multiply(s, np.float32(1 / (1 - 0.99**self.steps)), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-7)
        np.divide(m, g, out=g)
        g *= np.float32(rate / (1 - 0.9**self.steps))
        self.line -= g


def _turned(x: np.ndarray) -> np.ndarray:
    """The matrices of a row turned, in new places: products of small matrices take three times as long with a turned view."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


def _raised(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``out``, which is ``x`` within its bounds to the power of POWER; ``x`` is put within them in place."""
    np.clip(x, LEAST, MOST, out=x)
    np.multiply(x, x, out=out)
    for _ in range(SQUARINGS - 1):
        np.multiply(out, out, out=out)
    return out


def _summed(by_id: list[tuple[str, np.ndarray, np.ndarray]]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Of each table the distinct ids, which need 16 bits, and the sum of the gradients of each."""
    now = None
    for name, where, grad in by_id:
        if where is not now:
            now, flat = where, where.astype(np.uint16).ravel()  # 16 bits are sorted by digits
            order = np.argsort(flat, kind="stable")
            flat = flat.take(order)
            first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
            distinct = flat.take(first).astype(np.intp)
        # two numbers are added at a time
        yield name, distinct, np.add.reduceat(grad.reshape(len(order), -1).take(order, 0).view(np.complex64), first, 0).view(np.float32)
