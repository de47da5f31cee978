"""A causal self-attention model in numpy over real symbols: trained a batch of windows at a time, scored in overlapping windows.

The next symbol is predicted in two factors that are both learned: its class, and the symbol within it.
"""

from __future__ import annotations

import numpy as np

WINDOW = 32
#: Tokens of each window after a document's first that are context only.
OVERLAP = 16
WIDTH = 16
_SEEN = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_ONES = np.ones(WINDOW, np.float32)
#: Logits are held within this, so that exp() needs no row's maximum.
_MOST = np.float32(60)
#: Rows of logits that are made at a time, so that they stay in the processor's cache.
_PART = 512
#: Logits within classes that are made at a time; a class with more has them to itself.
_TOGETHER = 1 << 17
_DENSE = ("p", "q", "k", "v", "u", "b")
_ROWS = ("e", "o", "ob")


def _longest(x: np.ndarray, columns: int | None = None) -> float:
    """The length of the longest row, of its first columns if so many are given."""
    counted = np.zeros(x.shape[-1], x.dtype)
    counted[:columns] = 1
    return float(((x * x) @ counted).max(initial=0)) ** 0.5


def _exp(x: np.ndarray, bound: float = np.inf) -> np.ndarray:
    """exp of logits, in place; bound: none of them is larger than it or smaller than its negative."""
    if not bound < _MOST and not (x.max(initial=0) < _MOST and x.min(initial=0) > -_MOST):
        np.minimum(np.maximum(x, -_MOST, out=x), _MOST, out=x)
    return np.exp(x, out=x)


def windows(symbols: np.ndarray, sizes: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol as a target once: rows of WINDOW symbols before it and of targets, -1 where there is none."""
    number = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), number)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    at = ((np.cumsum(sizes) - sizes)[text] + k * WINDOW)[:, None] + np.arange(WINDOW)
    real = np.arange(WINDOW) < (sizes[text] - k * WINDOW)[:, None]
    last = max(0, len(symbols) - 1)
    target = np.where(real, symbols[np.minimum(at, last)], -1).astype(np.int32)
    before = np.where(real, symbols[np.clip(at - 1, 0, last)], 0).astype(np.int32)
    before[k == 0, 0] = begin
    return before, target


class Attention:
    """Predicts the next of `symbols` from those before it in the window; symbol `symbols` begins a text.

    group has the class of each symbol (without it each is a class of its own), counts where to start from.
    """

    def __init__(self, symbols: int, group: np.ndarray | None = None, counts: np.ndarray | None = None, seed: int = 5):
        r = np.random.default_rng(seed)
        d = WIDTH
        self.begin = symbols
        self.group = np.arange(symbols) if group is None else group
        self.size = np.bincount(self.group)
        self.first = np.cumsum(self.size) - self.size
        c = len(self.size)
        members = np.argsort(self.group, kind="stable")
        self.slot = np.empty(symbols, np.int64)
        self.slot[members] = np.arange(symbols)
        self.inside = self.slot - self.first[self.group]
        self.shared = np.append(self.size[self.group] > 1, False)  # -1, where there is no target, has no class
        self.ones = np.ones(max(c, int(self.size.max(initial=0))), np.float32)
        self.near = self.group.astype(np.uint16 if c < 1 << 16 else np.int64)  # a stable sort of small numbers counts instead of comparing
        shape = {"e": (symbols + 1, d), "p": (WINDOW, d), "q": (d, d), "k": (d, d), "v": (d, d), "u": (d, c), "b": (c,)}
        self.w = {n: (r.standard_normal(s) * (0.3 if n in "e" else 0.1 if n == "p" else d**-0.5)).astype(np.float32) for n, s in shape.items()}
        weight = np.ones(symbols) if counts is None else counts + 0.5
        each = np.bincount(self.group, weight)
        self.w["b"] = np.log(each / each.sum()).astype(np.float32)
        self.w["o"] = np.zeros((symbols, d), np.float32)  # by slot: a class has one run of rows
        self.w["ob"] = np.log(weight / each[self.group])[members].astype(np.float32)[:, None]

    def _runs(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int, int]]]:
        """Places of targets y in classes of several symbols, by class; their places in the class; for each class where they begin and end, it, and its slots."""
        several = np.flatnonzero(self.shared[y])
        near = self.near[y[several]]
        order = several[np.argsort(near, kind="stable")]
        number = np.bincount(near, minlength=len(self.size))
        stop = np.cumsum(number)
        c = np.flatnonzero(number)
        runs = zip((stop - number)[c].tolist(), stop[c].tolist(), c.tolist(), self.first[c].tolist(), (self.first + self.size)[c].tolist(), strict=True)
        return order, self.inside[y[order]], list(runs)

    def _chances(self, h: np.ndarray, spots: np.ndarray, runs: list, within: np.ndarray, bound: float = np.inf):
        """exp of the logits within classes, some runs at a time: those runs, each one's as a table, all in a row, the targets' places there, and the sums of targets' rows."""
        sizes = [(b1 - b0) * (hi - lo) for b0, b1, _, lo, hi in runs]
        first = 0
        while first < len(runs):
            last, count = first + 1, sizes[first]
            while last < len(runs) and count + sizes[last] <= _TOGETHER:
                count, last = count + sizes[last], last + 1
            some, row, tables, at = runs[first:last], np.empty(count, np.float32), [], 0
            for (b0, b1, _, lo, hi), n in zip(some, sizes[first:last], strict=True):
                tables.append(row[at : at + n].reshape(b1 - b0, hi - lo))
                np.matmul(h[b0:b1], within[lo:hi].T, out=tables[-1])
                at += n
            _exp(row, bound)
            begin = some[0][0]
            total = np.empty(some[-1][1] - begin, np.float32)
            for (b0, b1, *_), z in zip(some, tables, strict=True):
                np.matmul(z, self.ones[: z.shape[1]], out=total[b0 - begin : b1 - begin])
            wide = np.repeat([hi - lo for *_, lo, hi in some], [b1 - b0 for b0, b1, *_ in some])
            yield some, tables, row, np.cumsum(wide) - wide + spots[begin : some[-1][1]], total
            first = last

    def train(self, ids: np.ndarray, target: np.ndarray, passes: int = 1, batch: int = 128, rate: float = 0.01, seed: int = 3, done: float = 0.0, share: float = 1.0) -> float:
        """ids, target: of windows(); each is used once in a pass. done and share: which part of the whole training this is. The last loss, in nats."""
        r, w, d = np.random.default_rng(seed), self.w, WIDTH
        dense, sizes = self.dense(), [w[n].size for n in _DENSE]
        w |= {n: z.reshape(w[n].shape) for n, z in zip(_DENSE, np.split(dense, np.cumsum(sizes)[:-1]), strict=True)}  # views: one step moves all
        m, s2 = np.zeros_like(dense), np.zeros_like(dense)
        e2, o2, ob2 = np.full(len(w["e"]), 1e-8, np.float32), [1e-8] * len(self.size), [1e-8] * len(self.size)
        flat = lambda y: y.reshape(-1, d)
        within, pull = np.hstack([w["o"], w["ob"]]), np.empty(d + 1, np.float32)  # a last column of ones in h meets the biases
        begins = np.arange(_PART) * len(self.size)
        turns = [a for _ in range(passes) for order in [r.permutation(len(ids))] for a in np.split(order, np.arange(batch, len(order), batch))]
        few = np.uint16 if len(w["e"]) <= 1 << 16 else np.int32
        root, loss = np.float32(d**-0.5), 0.0
        class_ones, some_ones, logits = self.ones[: len(self.size)], self.ones[:1].repeat(d), np.empty((_PART, len(self.size)), np.float32)
        for t, pick in enumerate(turns, 1):
            i, y = ids[pick], target[pick]
            x = w["e"].take(i, 0)
            x += w["p"]
            wide = np.hstack([w["q"] * root, w["k"], w["v"]])
            q, k, v = np.split((flat(x) @ wide).reshape(*i.shape, 3 * d), 3, 2)
            a = _exp(q @ k.transpose(0, 2, 1))
            a *= _SEEN
            a *= (1 / (a @ _ONES))[..., None]
            seen = a @ v
            h = np.ones((i.size, d + 1), np.float32)
            np.add(flat(seen), flat(x), out=h[:, :d])
            goal = y.ravel()
            real = goal >= 0
            n = np.float32(np.count_nonzero(real))
            weight = real / n
            heads, classes = np.vstack([w["u"], w["b"]]), self.group[goal]
            bound = _longest(h, d) * _longest(w["u"].T) + float(np.abs(w["b"]).max())
            back_u, gu, dh, chance = np.ascontiguousarray(w["u"].T), 0, np.empty((len(goal), d), np.float32), np.empty(len(goal), np.float32)
            for a0 in range(0, len(goal), _PART):
                part = h[a0 : a0 + _PART]
                p = _exp(np.matmul(part, heads, out=logits[: len(part)]), bound)
                line, at = p.reshape(-1), begins[: len(part)] + classes[a0 : a0 + _PART]
                right, total = line.take(at), p @ class_ones
                np.divide(right, total, out=chance[a0 : a0 + _PART])
                line[at] = right - total  # each row is total times n too large; what is made from it is brought down
                down = (weight[a0 : a0 + _PART] / total)[:, None]
                gu = gu + (part * down).T @ p
                np.multiply(p @ back_u, down, out=dh[a0 : a0 + _PART])
            now = -np.log(chance + 1e-30).sum(where=real)
            grad = {"b": gu[d], "u": gu[:d]}
            pace = np.float32(min(1.0, t / 20) * (1 - 0.9 * (done + share * t / len(turns))))
            fast, slow = 50 * rate * float(pace), 20 * rate * float(pace)
            own, spots, runs = self._runs(goal)
            by_class, back = h.take(own, 0), np.empty((len(own), d + 1), np.float32)
            for some, tables, line, at, total in self._chances(by_class, spots, runs, within):
                begin, stop = some[0][0], some[-1][1]
                right = line[at]
                now -= np.log(right / total + 1e-30).sum()
                line[at] = right - total
                down = (1 / (n * total))[:, None]
                low = by_class[begin:stop] * down
                for (b0, b1, c, lo, hi), dz in zip(some, tables, strict=True):
                    mine = within[lo:hi]
                    np.matmul(dz, mine, out=back[b0:b1])
                    do = dz.T @ low[b0 - begin : b1 - begin]
                    db = do[:, d]
                    bias = float(np.vdot(db, db))
                    o2[c] += float(np.vdot(do, do)) - bias
                    ob2[c] += bias
                    pull[:d], pull[d] = fast / o2[c] ** 0.5, slow / ob2[c] ** 0.5
                    do *= pull
                    mine -= do
                back[begin:stop] *= down
            more = np.zeros_like(dh)
            more[own] = back[:, :d]
            dh += more
            loss = now / n if t == 1 else 0.95 * loss + 0.05 * now / n
            dh = dh.reshape(x.shape)
            ds = dh @ v.transpose(0, 2, 1)
            ds -= ((dh * seen) @ some_ones)[..., None]
            ds *= a
            each = np.empty((*i.shape, 3 * d), np.float32)
            np.matmul(ds, k, out=each[..., :d])
            np.matmul(ds.transpose(0, 2, 1), q, out=each[..., d : 2 * d])
            np.matmul(a.transpose(0, 2, 1), dh, out=each[..., 2 * d :])
            each = each.reshape(-1, 3 * d)
            gq, gk, gv = np.split(sum(flat(x)[a0 : a0 + _PART].T @ each[a0 : a0 + _PART] for a0 in range(0, len(each), _PART)), 3, 1)
            grad |= {"q": gq * root, "k": gk, "v": gv}
            dx = (each @ wide.T).reshape(x.shape)
            dx += dh
            grad["p"] = dx.sum(0)
            ranked = i.ravel().astype(few)
            order = np.argsort(ranked, kind="stable")
            ranked = ranked[order]
            edge = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
            some, de = ranked[edge], np.add.reduceat(flat(dx).take(order, 0), edge)
            e2[some] += np.einsum("ij,ij->i", de, de)
            de *= (np.float32(20 * rate * pace) / np.sqrt(e2[some]))[:, None]
            w["e"][some] -= de
            g = np.concatenate([grad[name].ravel() for name in _DENSE])
            m += 0.1 * (g - m)
            s2 += 0.01 * (g * g - s2)
            dense -= (rate * pace * (m / (1 - 0.9**t)) / (np.sqrt(s2 / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        w["o"], w["ob"] = within[:, :d].copy(), within[:, d:].copy()
        return float(loss)

    def dense(self) -> np.ndarray:
        return np.concatenate([self.w[n].ravel() for n in _DENSE])

    def rows(self) -> np.ndarray:
        """A row for each symbol and slot: what is learned for it alone."""
        pad = np.zeros((1, WIDTH + 1), np.float32)
        return np.hstack([self.w["e"], np.vstack([np.hstack([self.w["o"], self.w["ob"]]), pad])])

    def put(self, dense: np.ndarray, rows: np.ndarray) -> None:
        at = np.cumsum([0, *(self.w[n].size for n in _DENSE)])
        for n, a, b in zip(_DENSE, at, at[1:], strict=False):
            self.w[n] = dense[a:b].reshape(self.w[n].shape).astype(np.float32)
        rows = rows.astype(np.float32)
        self.w |= {"e": rows[:, :WIDTH].copy(), "o": rows[:-1, WIDTH:-1].copy(), "ob": rows[:-1, -1:].copy()}

    def ready(self) -> Attention:
        """Products by symbol and by place, so that scoring gathers instead of multiplying."""
        w = self.w
        asks, told = np.hstack([w["q"] * np.float32(WIDTH**-0.5), np.eye(WIDTH, WIDTH + 1, dtype=np.float32)]), np.hstack([w["k"], w["v"], np.zeros((WIDTH, 1), np.float32)])
        self.asks, self.asks_at, self.told, self.told_at = w["e"] @ asks, w["p"] @ asks, w["e"] @ told, w["p"] @ told
        self.told_at[:, -1] = 1  # a last column of ones adds up attention's weights, then meets the biases
        self.heads, self.within = np.vstack([w["u"], w["b"]]), np.hstack([w["o"], w["ob"]])
        reach = [_longest(x, WIDTH) for x in (self.asks, self.asks_at, self.told, self.told_at)]
        self.bound = (reach[0] + reach[1]) * (reach[2] + reach[3])  # of attention's logits
        return self

    def log_probability(self, symbols: np.ndarray, sizes: np.ndarray, block: int = 512) -> np.ndarray:
        """Natural log probability of each text; symbols of all texts, one after another, each scored once."""
        step = WINDOW - OVERLAP
        more = np.maximum(0, -(-(sizes - WINDOW) // step))
        number = np.where(sizes > 0, 1 + more, 0)
        first = np.cumsum(sizes) - sizes
        text = np.repeat(np.arange(len(sizes)), number)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
        out = np.zeros(len(text))
        place = np.arange(WINDOW)
        padded = np.concatenate([symbols, np.zeros(WINDOW + 1, symbols.dtype)])
        class_ones, logits = self.ones[: len(self.size)], np.empty((_PART, len(self.size)), np.float32)
        begins = np.arange(_PART) * len(self.size)
        most, bias = _longest(self.heads[:-1].T), float(np.abs(self.heads[-1]).max())
        most_within, bias_within = _longest(self.within, WIDTH), float(np.abs(self.within[:, -1]).max(initial=0))
        # what is context only answers but doesn't ask: a text's later windows ask from OVERLAP on
        for ask, which in ((0, np.flatnonzero(nth == 0)), (OVERLAP, np.flatnonzero(nth > 0))):
            for pick in np.split(which, np.arange(block, len(which), block)):
                t, k = text[pick], nth[pick]
                begin = (first[t] + k * step)[:, None] + place
                before = padded[np.clip(begin - 1, 0, len(padded) - 1)].astype(np.int64, copy=False)
                before[k == 0, 0] = self.begin
                x = self.told.take(before, 0)
                x += self.told_at
                own = self.asks.take(before[:, ask:], 0)
                own += self.asks_at[ask:]
                q, key, v = own[..., :WIDTH], x[..., :WIDTH], x[..., WIDTH:]
                s = _exp(q @ key.transpose(0, 2, 1), self.bound)
                s *= _SEEN[ask:]
                mix = s @ v
                mix *= (1 / mix[..., WIDTH])[..., None]
                mix += own[..., WIDTH:]
                counted = place[ask:] < (sizes[t] - k * step)[:, None]
                real = np.flatnonzero(counted)
                h, y = mix.reshape(-1, WIDTH + 1).take(real, 0), padded.take(begin[:, ask:].ravel().take(real)).astype(np.int64, copy=False)
                long = _longest(h, WIDTH)
                classes, chance = self.group[y], np.empty(len(y), np.float32)
                for a0 in range(0, len(y), _PART):
                    part = h[a0 : a0 + _PART]
                    z = _exp(np.matmul(part, self.heads, out=logits[: len(part)]), long * most + bias)
                    np.divide(z.reshape(-1).take(begins[: len(part)] + classes[a0 : a0 + _PART]), z @ class_ones, out=chance[a0 : a0 + _PART])
                logp = np.log(chance + 1e-30).astype(float)
                order, spots, runs = self._runs(y)
                by_class, right = h.take(order, 0), np.empty(len(order), np.float32)
                for some, _, line, at, total in self._chances(by_class, spots, runs, self.within, long * most_within + bias_within):
                    np.divide(line[at], total, out=right[some[0][0] : some[-1][1]])
                logp[order] += np.log(right + 1e-30)
                out[pick] = np.bincount(real // (WINDOW - ask), logp, minlength=len(t))
        return np.bincount(text, out, minlength=len(sizes))
