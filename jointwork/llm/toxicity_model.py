"""A small bidirectional gated recurrent network with attention pooling, in numpy.

A window of words goes in as one vector per word: the word's own evidence and
that of its characters (n-grams), both counted on labelled documents.  Two
recurrent passes, one from each side, give a state per word; attention weighs
the states; their sum gives the window's logit.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np

from jointwork.llm.rolling import prefix_sums, spans

WINDOW, STRIDE = 16, 8
HIDDEN, ATTENTION = 8, 8
BUCKETS = 1 << 20
NGRAMS = (3, 4, 5)
FEATURES = 6
#: Documents at the base rate that are added to each count.
PRIOR = 4.0
REMEMBERED = 150_000
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def core(token: str) -> str:
    return _EDGES.sub("", token)


def ngram_buckets(cores: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of all character n-grams, word edges included."""
    if not cores:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    parts = [b"^" + c.encode() + b"$" for c in cores]
    data = np.frombuffer(b"".join(parts), "u1")
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    sums = prefix_sums(data)
    who, where = [], []
    for n in NGRAMS:
        at = np.flatnonzero(owner[: len(data) - n + 1] == owner[n - 1 :]) if len(data) >= n else np.zeros(0, "i8")
        who.append(owner[at])
        where.append((spans(sums, at, at + n) & np.uint64(BUCKETS - 1)).astype("i8"))
    return np.concatenate(who), np.concatenate(where)


class Evidence:
    """Log odds of words and n-grams, from documents with and without label 1."""

    def __init__(self, words: dict[str, float], grams: np.ndarray):
        self.words, self.grams = words, grams

    @classmethod
    def count(cls, docs: Iterable[set[str]], labels: list[int]) -> "Evidence":
        n, k = np.zeros(BUCKETS, "f4"), np.zeros(BUCKETS, "f4")
        word_n: dict[str, int] = {}
        word_k: dict[str, int] = {}
        for cores, y in zip(docs, labels):
            seen = np.unique(ngram_buckets(sorted(cores))[1])
            n[seen] += 1
            k[seen] += y
            for c in cores:
                word_n[c] = word_n.get(c, 0) + 1
                if y:
                    word_k[c] = word_k.get(c, 0) + 1
        rate = min(0.99, max(0.01, sum(labels) / max(1, len(labels))))
        base = np.log(rate / (1 - rate))

        def odds(n, k):
            return np.log((k + PRIOR * rate) / (n - k + PRIOR * (1 - rate))) - base

        return cls({w: float(odds(a, word_k.get(w, 0))) for w, a in word_n.items() if a > 1}, odds(n, k).astype("f4"))

    def features(self, toks: list[str]) -> np.ndarray:
        """Word evidence; largest n-gram evidence, mean of its positive part, mean; known or not; letters or not."""
        each = [core(t) for t in toks]
        number = {c: i for i, c in enumerate(dict.fromkeys(each))}
        cores = list(number)
        out = np.zeros((len(cores), FEATURES), "f4")
        known = [self.words.get(c) for c in cores]
        out[:, 0] = [x or 0.0 for x in known]
        out[:, 4] = [x is not None for x in known]
        out[:, 5] = [bool(c) for c in cores]
        who, where = ngram_buckets(cores)
        value = self.grams[where]
        grams = np.bincount(who, minlength=len(cores))
        out[:, 1] = -9
        for part in np.split(np.arange(len(who)), np.flatnonzero(np.diff(who) < 0) + 1):  # one part per n, in order of words
            if len(part):
                first = np.flatnonzero(np.diff(who[part], prepend=-1))
                words = who[part][first]
                out[words, 1] = np.maximum(out[words, 1], np.maximum.reduceat(value[part], first))
                out[words, 2] += np.add.reduceat(np.maximum(value[part], 0), first)
                out[words, 3] += np.add.reduceat(value[part], first)
        out[:, 2:4] /= np.maximum(1, grams)[:, None]
        out[:, :4] *= 0.25
        out[~(out[:, 5] > 0), :] = 0
        return out[[number[c] for c in each]]


def windows(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(document, first word) of all windows: every STRIDE words, the last up to the end, one at least."""
    who, at = [], []
    for i, n in enumerate(lengths):
        count = 1 if n <= WINDOW else -(-(n - WINDOW) // STRIDE) + 1
        who.append(np.full(count, i))
        at.append(np.arange(count) * STRIDE)
    return np.concatenate(who), np.concatenate(at)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = rng.normal(0, 0.4, (FEATURES, 3 * h))
            self.p[f"U{d}"] = rng.normal(0, 0.3, (h, 3 * h))
            self.p[f"c{d}"] = np.zeros(3 * h)
        self.p |= {"A": rng.normal(0, 0.4, (2 * h, ATTENTION)), "v": rng.normal(0, 0.4, ATTENTION), "w": rng.normal(0, 0.4, 2 * h), "o": np.zeros(1)}
        self.p = {k: x.astype("f4") for k, x in self.p.items()}

    def _pass(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction, (steps, windows, hidden)."""
        h, (steps, n, _) = HIDDEN, x.shape
        inputs = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
        state, out = np.zeros((n, h), "f4"), np.empty((steps, n, h), "f4")
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            u = state @ self.p[f"U{d}"]
            gates = _sigmoid(inputs[t, :, : 2 * h] + u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(inputs[t, :, 2 * h :] + r * u[:, 2 * h :])
            after = new + z * (state - new)
            if mask is not None:
                after = np.where(mask[t][:, None], after, state)
            if keep is not None:
                keep.append((t, state, u, z, r, new))
            out[t] = state = after
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; x (steps, windows, features), mask (steps, windows) tells words from padding."""
        lists = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        states = np.concatenate([self._pass(d, x, mask, lists[d]) for d in "fb"], axis=2)
        shown = np.tanh(states @ self.p["A"])
        e = shown @ self.p["v"]
        if mask is not None:
            e = np.where(mask, e, -30)
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep |= {"lists": lists, "states": states, "shown": shown, "weight": weight, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["o"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        logit = self.forward(x, mask, keep)
        h, p = HIDDEN, self.p
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((_sigmoid(logit) - y) * weights / len(y)).astype("f4")
        g["o"][0], g["w"] = dl.sum(), keep["pooled"].T @ dl
        dpool = dl[:, None] * p["w"]
        states, weight, shown = keep["states"], keep["weight"], keep["shown"]
        dstates = weight[:, :, None] * dpool
        dweight = (states * dpool).sum(axis=2)
        de = weight * (dweight - (weight * dweight).sum(axis=0))
        de = np.where(mask, de, 0)
        g["v"] = (shown * de[:, :, None]).sum(axis=(0, 1))
        dshown = de[:, :, None] * p["v"] * (1 - shown**2)
        g["A"] = np.tensordot(states, dshown, ((0, 1), (0, 1)))
        dstates = dstates + dshown @ p["A"].T
        for i, d in enumerate("fb"):
            back = np.zeros((x.shape[1], h), "f4")
            for t, state, u, z, r, new in reversed(keep["lists"][d]):
                m = mask[t][:, None]
                dh = dstates[t, :, i * h : (i + 1) * h] + back
                live = np.where(m, dh, 0)
                dz = live * (state - new) * z * (1 - z)
                dn = live * (1 - z) * (1 - new**2)
                dr = dn * u[:, 2 * h :] * r * (1 - r)
                da = np.concatenate([dz, dr, dn], axis=1)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                g[f"W{d}"] += x[t].T @ da
                g[f"c{d}"] += da.sum(axis=0)
                g[f"U{d}"] += state.T @ du
                back = np.where(m, live * z, dh) + du @ p[f"U{d}"].T
        return g


def gather(table: np.ndarray, ids: list[np.ndarray], who: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, windows, features) and mask; the table's row 0 is padding."""
    flat = np.concatenate([*ids, np.zeros(WINDOW, "i4")])
    lengths = np.array([len(x) for x in ids])
    start = np.cumsum(lengths) - lengths
    steps = np.arange(WINDOW)[:, None]
    mask = at + steps < lengths[who]
    rows = np.where(mask, flat[np.minimum(start[who] + at + steps, len(flat) - 1)], 0)
    return table[rows], mask


def pooled(who: np.ndarray, logit: np.ndarray, n: int) -> np.ndarray:
    """Per text, from all its windows: highest, third and fifth logit (a word is in two windows), number of windows, one."""
    order = np.lexsort((-logit, who))
    first = np.searchsorted(who, np.arange(n))
    count = np.bincount(who, minlength=n)
    out = np.full((n, 5), -6.0)
    for j, rank in enumerate((0, 2, 4)):
        some = count > rank
        out[some, j] = np.clip(logit[order[first[some] + rank]], -6, 8)
    out[:, 3], out[:, 4] = np.log(count), 1
    return out


def fit_pooling(x: np.ndarray, y: np.ndarray, ridge: float = 4.0) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + keep, x.T @ (q - y) + keep @ w)
    return w


class Model:
    """Evidence, network and the weights that make one score of a text's windows."""

    def __init__(self, evidence: Evidence, network: Network, pooling: np.ndarray | None = None):
        self.evidence, self.network, self.pooling = evidence, network, pooling
        self.known: dict[str, int] = {}
        self.table = np.zeros((1, FEATURES), "f4")

    def copy(self) -> "Model":
        """The same model that remembers no words yet."""
        return Model(self.evidence, self.network, self.pooling)

    def _ids(self, lists: list[list[str]]) -> list[np.ndarray]:
        new = list({t for words in lists for t in words}.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            self.table = self.table[:1]
            new = list({t for words in lists for t in words})
        if new:
            rows = self.evidence.features(new)
            self.known.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, rows])
        find = self.known.__getitem__
        return [np.fromiter(map(find, words), "i4", len(words)) for words in lists]

    def window_logits(self, lists: list[list[str]], block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, logit) of all overlapping windows."""
        ids = self._ids(lists)
        who, at = windows([len(x) for x in ids])
        out = np.empty(len(who), "f4")
        for lo in range(0, len(who), block):
            x, mask = gather(self.table, ids, who[lo : lo + block], at[lo : lo + block])
            out[lo : lo + block] = self.network.forward(x, None if mask.all() else mask)
        return who, at, out

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        who, _, logit = self.window_logits([tokens(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(pooled(who, logit, len(texts)) @ self.pooling, -30, 30)))


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def train(texts: list[str | None], labels: list[int], epochs: int = 5, per_doc: int = 6, seed: int = 7) -> Model:
    """Fit on labelled texts.  A text's label holds for its highest window if it is 1, for all of them if it is 0.

    Evidence for a text comes from the other half of the texts, so that a
    rare word is not taken as proof of the label it was counted with.
    """
    rng = np.random.default_rng(seed)
    one: dict[str, str] = {}  # each word once in memory
    lists = [[one.setdefault(t, t) for t in tokens(text)] for text in texts]
    bare = {t: one.setdefault(c, c) for t, c in [(t, core(t)) for t in one]}
    cores = [{bare[t] for t in words} - {""} for words in lists]
    fold = np.arange(len(texts)) % 2
    pick = lambda xs, f: [x for x, g in zip(xs, fold) if g == f]
    network = Network(seed)
    halves = [Model(Evidence.count(pick(cores, 1 - f), pick(labels, 1 - f)), network) for f in (0, 1)]
    y_all = np.array(labels, "f4")
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    step = 0
    order = [np.flatnonzero(fold == f) for f in (0, 1)]
    for epoch in range(epochs):
        xs, masks, ys = [], [], []
        for f, model in enumerate(halves):
            for lo in range(0, len(order[f]), 256):
                docs = order[f][lo : lo + 256]
                mine = [lists[i] for i in docs]
                ids = model._ids(mine)
                who, at = windows([len(x) for x in ids])
                x, mask = gather(model.table, ids, who, at)
                # Before the first turn the strongest evidence in a window stands for its score.
                rank = x[:, :, :2].max(axis=(0, 2)) if epoch == 0 else network.forward(x, mask)
                y = y_all[docs][who]
                sort = np.lexsort((-(rank + 1e-6 * rng.random(len(rank))), who))
                place = np.arange(len(who)) - np.searchsorted(who, who)
                chosen = sort[np.where(y[sort] > 0, place == 0, place < per_doc // 2)]
                more = np.flatnonzero((y == 0) & (rng.random(len(y)) < per_doc / 2 / np.maximum(1, np.bincount(who)[who])))
                chosen = np.concatenate([chosen, more])
                xs.append(x[:, chosen]), masks.append(mask[:, chosen]), ys.append(y[chosen])
        x, mask, y = np.concatenate(xs, 1), np.concatenate(masks, 1), np.concatenate(ys)
        weights = np.where(y > 0, min(4.0, max(1.0, float((y == 0).sum() / max(1, y.sum())) / 4)), 1.0).astype("f4")
        parts = max(1, len(y) // 256)
        for _ in range(max(2, -(-50 // parts))):  # at least so many steps an epoch
            for part in np.array_split(rng.permutation(len(y)), parts):
                step += 1
                grads = network.gradients(x[:, part], mask[:, part], y[part], weights[part])
                for k, g in grads.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    rate = 0.02 * (1 - 0.9 * epoch / epochs)
                    network.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype("f4")
    seen, truth = [], []
    for f, model in enumerate(halves):
        for lo in range(0, len(order[f]), 256):
            docs = order[f][lo : lo + 256]
            who, _, logit = model.window_logits([lists[i] for i in docs])
            seen.append(pooled(who, logit, len(docs)))
            truth.append(y_all[docs])
    return Model(Evidence.count(cores, labels), network, fit_pooling(np.concatenate(seen), np.concatenate(truth)))
