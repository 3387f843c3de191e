"""Language-model scoring with a small causal self-attention model, trained in numpy on subword ids.

Ids come from a public word BPE, and a text ends with an end id. The model predicts the class of the next
id in two steps, its group of classes and the class within it: one head of causal attention over the ids of
a window gives a vector, whose logits are added to the log probabilities of the groups, and of the classes
of a group, after the id before; within a class, ids go by their probabilities after that id. All counts (words for the base, ids, pairs of ids) are gathered from every training document;
classes and the KEPT ids with a row of their own follow the counts of all training ids, and pairs are
counted for those, the others being one in them. The attention weights learn from every window of every
training document, once, at any size of the input: the windows are dealt out by hash to ROUNDS rounds and in each to shards of
about SHARD, each fitted in a task of its own from common weights, whose mean starts the next round.
Windows overlap: each but the first scores only what follows its first WINDOW - STRIDE places, so every
id is scored once, with context, in batches with a causal mask.

The base is a smoothed unigram model of words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased) and an end token.
Counts of the most frequent words (MOST_WORDS) are broadcast; those of rarer ones are joined by hash.

Training rows: crc32(doc_id) mod 5 is not 1. A null text is empty (an end alone); a row with a null doc_id
trains and is not held out. Repeated rows are each scored. With no training rows all counts are zero.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .storage import materialize, prepare, release
from .subwords import WordIds, text_ids

U = np.uint64
WINDOW, STRIDE, WIDTH, CLASSES, SINGLE, KEPT = 32, 24, 24, 256, 240, 2047
#: Classes come in groups of equal size: the model predicts the group, then the class within it. TILE: places of one product.
GROUPS, SIZE, TILE = 16, CLASSES // 16, 32
EVERY, SHARD, ROUNDS, FAN, MOST_WORDS = 1, 12_000, 2, 64, 1_000_000
END_WORD = U(0x9D8A7C6B5E4F3A21)
#: Word counts that a task holds before it sums and emits them.
HELD = 1_000_000


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in it, first scored place) of the windows over texts of these lengths."""
    count = 1 + np.maximum(0, -(-(lengths - WINDOW) // STRIDE))
    owner = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    return owner, nth * STRIDE, np.where(nth > 0, WINDOW - STRIDE, 0)


def windows(n: int) -> list[tuple[int, int]]:
    """(start, first scored place) of the windows over n places."""
    _, start, first = spans(np.array([n]))
    return list(zip(start.tolist(), first.tolist(), strict=True))


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(-1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(-1, keepdims=True)
    return z


class AttentionModel:
    """count: of each id. slot: the embedding row of an id; to_class: its class."""

    MASK = np.triu(np.full((WINDOW, WINDOW), -1e9, np.float32), 1)
    KEYS_MASK = np.ascontiguousarray(MASK.T)

    def __init__(self, count: np.ndarray, ends_word: np.ndarray):
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(count), np.int64)
        rank[order] = np.arange(len(count))
        tier = np.minimum((np.log2(1 + np.maximum(rank - SINGLE, 0) / 64.0)).astype(np.int64), (CLASSES - SINGLE) // 2 - 1)
        self.to_class = np.where(rank < SINGLE, rank, SINGLE + 2 * tier + ends_word)
        self.slot = np.minimum(rank, KEPT)  # the ids that have a row of their own; KEPT: the others
        self.begin = KEPT + 1
        rng = np.random.default_rng(11)
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": w(KEPT + 2, WIDTH) * np.float32(8), "pos": w(WINDOW, WIDTH) * np.float32(0.5), "q": w(WIDTH, WIDTH), "k": w(WIDTH, WIDTH), "v": w(WIDTH, WIDTH), "h": w(WIDTH, WIDTH), "b": np.zeros(WIDTH, np.float32), "g": w(WIDTH, GROUPS) * np.float32(0.1), "o": w(WIDTH, CLASSES).reshape(WIDTH, GROUPS, SIZE).transpose(1, 0, 2) * np.float32(0.1)}

    def set_counts(self, ids: np.ndarray, pairs: np.ndarray, off: float = 0.5) -> None:
        """Corpus counts: of each id, and of (slot before, slot); absolute discounting down to single ids."""
        self.made = None
        c = ids.astype(np.float64) + 0.5
        single = c / c.sum()
        self.prior = np.zeros((KEPT + 2, CLASSES), np.float32)
        self.inner = np.zeros((KEPT + 2, KEPT + 1), np.float32)
        slots = np.bincount(self.slot, single, KEPT + 1)
        kind = np.bincount(self.slot * CLASSES + self.to_class, single, (KEPT + 1) * CLASSES).reshape(KEPT + 1, CLASSES)
        # Ids without a slot of their own are told apart by their single counts alone.
        self.single = np.where(self.slot < KEPT, 0.0, np.log(single / slots[self.slot])).astype(np.float32)
        share = kind / np.maximum(slots, 1e-300)[:, None]
        class_of = np.zeros(KEPT, np.int64)
        class_of[self.slot[self.slot < KEPT]] = self.to_class[self.slot < KEPT]
        for i in range(KEPT + 2):
            n = pairs[i].astype(np.float64)
            total = n.sum()
            p = (np.maximum(n - off, 0) + off * (n > 0).sum() * slots) / total if total else slots
            with np.errstate(divide="ignore"):  # a slot or class without ids
                self.inner[i] = np.log(p)
                self.prior[i] = np.log(np.bincount(class_of, p[:KEPT], CLASSES) + p[KEPT] * share[KEPT])
        self._arrange(pairs.sum(1))

    def _arrange(self, often: np.ndarray) -> None:
        """Put classes that come after the same slots into a group: halves by the first principal component, four times."""
        top = np.argsort(-often, kind="stable")[:CLASSES]
        joint = np.exp(self.prior.astype(np.float64)) * often[:, None]
        total = joint.sum(0)
        x = np.sqrt(joint[top] / np.maximum(total, 1e-300)).T
        x[total == 0] = x[total > 0].mean(0) if total.any() else 0
        parts = [np.arange(CLASSES)]
        while len(parts) < GROUPS:
            halves = []
            for at in parts:
                y = x[at] - x[at].mean(0)
                at = at[np.argsort(np.round(y @ np.linalg.svd(y, full_matrices=False)[2][0], 9), kind="stable")]
                halves += [at[: len(at) // 2], at[len(at) // 2 :]]
            parts = halves
        order = np.concatenate(parts)
        rank = np.empty(CLASSES, np.int64)
        rank[order] = np.arange(CLASSES)
        self.to_class, self.prior = rank[self.to_class], np.ascontiguousarray(self.prior[:, order])

    def weights(self) -> bytes:
        return b"".join(w.astype(np.float32).tobytes() for w in self.p.values())

    def set_weights(self, made: bytes) -> None:
        flat, at, self.made = np.frombuffer(made, np.float32), 0, None
        for n, w in self.p.items():
            self.p[n] = flat[at : at + w.size].reshape(w.shape).copy()
            at += w.size

    def _hidden(self, inputs: np.ndarray):
        p = self.p
        x = p["e"][inputs] + p["pos"]
        q, k, v = x @ p["q"], x @ p["k"], x @ p["v"]
        a = _softmax(q @ k.transpose(0, 2, 1) * np.float32(WIDTH**-0.5) + self.MASK)
        h = x + a @ v
        return np.tanh(h @ p["h"] + p["b"])

    def _forward(self, inputs: np.ndarray, before: np.ndarray):
        """The vectors of places, and the probabilities of classes there: that of the group times that within it."""
        o = self._hidden(inputs)
        share = np.exp(self.prior[before]).reshape(*before.shape, GROUPS, -1)
        of_group = _softmax(o @ self.p["g"] + np.maximum(_log(share.sum(-1)), -1e9))
        within = _softmax(np.einsum("...i,gij->...gj", o, self.p["o"]) + np.maximum(_log(share), -1e9))
        return o, (of_group[..., None] * within).reshape(*before.shape, CLASSES)

    def _shares(self) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the groups after each slot, and of the classes in their group, a row for each (slot, group). Rows sum to one,
        so that a group that hardly ever comes after a slot does not vanish in 32 bits."""
        share = np.exp(self.prior.astype(np.float64)).reshape(-1, SIZE)
        of_group = share.sum(1)
        share /= np.maximum(of_group, 1e-300)[:, None]
        return of_group.astype(np.float32).reshape(-1, GROUPS), share.astype(np.float32)

    def gradient(self, inputs: np.ndarray, wanted: np.ndarray, shares: tuple, g: dict[str, np.ndarray]) -> None:
        """Into g, the gradient of the mean of -log P(wanted class) over the places that have one (-1: none); inputs: slots of windows.

        Arrays of places have features first within a window where that makes products faster. Weights of the attention are
        never divided by their sums: a row of ones below the values gives these, and one below the gradients takes the mean
        off. Places are sorted by the wanted group and filled up to whole tiles, each a product with its group's weights.
        """
        p, (n, w), d, wide = self.p, inputs.shape, WIDTH, np.float32(WIDTH**-0.5)
        inputs, wanted = inputs.ravel(), wanted.ravel()
        x = p["e"].take(inputs, axis=0).reshape(n, w, d)
        x += p["pos"]
        y = np.empty((n, 3 * d + 1, w), np.float32)
        into = np.concatenate((p["q"].T * wide, p["k"].T, p["v"].T))
        turned = np.ascontiguousarray(x.transpose(0, 2, 1))
        np.matmul(into, turned, out=y[:, : 3 * d])
        y[:, 3 * d] = 1
        q, k, v = y[:, :d], y[:, d : 2 * d], y[:, 2 * d :]
        a = k.transpose(0, 2, 1) @ q  # keys by queries
        a += self.KEYS_MASK
        seen = v @ np.exp(a, out=a)
        if not (seen[:, d].min() > 1e-20 and seen[:, d].max() < 1e30):
            a = k.transpose(0, 2, 1) @ q + self.KEYS_MASK
            a -= a.max(1, keepdims=True)
            seen = v @ np.exp(a, out=a)
        part = 1 / seen[:, d:]
        seen = seen[:, :d]
        seen *= part
        h = np.ones((n, d + 1, w), np.float32)
        np.add(seen, turned, out=h[:, :d])
        o = np.zeros((n * w + 1, d), np.float32)
        made = o[:-1].reshape(n, w, d)
        np.matmul(h.transpose(0, 2, 1), np.concatenate((p["h"], p["b"][None])), out=made)
        np.tanh(made, out=made)

        at, of, tiles, first = _tiled(wanted)
        weight = (at < n * w).astype(np.float32)
        weight /= max(1, weight.sum())
        mine, before = o.take(at, axis=0), inputs.take(at, mode="clip").astype(np.int64)
        row, far = np.arange(len(at)), self._far()
        z = mine @ p["g"]
        _less_wanted(z, shares[0].take(before, axis=0), row, of, weight, far)
        g["g"][:] = mine.T @ z
        back = z @ np.ascontiguousarray(p["g"].T)
        split = lambda m: m.reshape(len(tiles), TILE, m.shape[1])
        np.matmul(split(mine), p["o"].take(tiles, axis=0), out=split(z))
        _less_wanted(z, shares[1].take(before * GROUPS + of, axis=0), row, wanted.take(at, mode="clip") % SIZE, weight, far)
        g["o"][:] = 0
        if len(tiles):
            g["o"][tiles[first]] = np.add.reduceat(split(mine).transpose(0, 2, 1) @ split(z), first, axis=0)
        back += (split(z) @ p["o"].transpose(0, 2, 1).copy().take(tiles, axis=0)).reshape(back.shape)
        mine *= mine
        np.subtract(1, mine, out=mine)
        back *= mine
        o[:] = 0
        o[at] = back
        of_h = (h @ made).sum(0)
        g["h"][:], g["b"][:] = of_h[:d], of_h[d]

        dy = np.empty((n, 4 * d, w), np.float32)
        dh = dy[:, 3 * d :]
        np.matmul(p["h"], np.ascontiguousarray(made.transpose(0, 2, 1)), out=dh)
        back = np.empty((n, d + 1, w), np.float32)
        np.multiply(dh, part, out=back[:, :d])
        seen *= back[:, :d]
        np.matmul(np.full((1, d), -1, np.float32), seen, out=back[:, d:])
        ds = v.transpose(0, 2, 1) @ back
        ds *= a
        np.matmul(k, ds, out=dy[:, :d])
        np.matmul(q, np.ascontiguousarray(ds.transpose(0, 2, 1)), out=dy[:, d : 2 * d])
        np.matmul(back[:, :d], np.ascontiguousarray(a.transpose(0, 2, 1)), out=dy[:, 2 * d : 3 * d])
        made = (dy[:, : 3 * d] @ x).sum(0)
        g["q"][:], g["k"][:], g["v"][:] = made[:d].T * wide, made[d : 2 * d].T, made[2 * d :].T
        dx = dy.transpose(0, 2, 1) @ np.concatenate((into, np.eye(d, dtype=np.float32)))
        g["pos"][:] = dx.sum(0)
        order = np.argsort(inputs, kind="stable")
        row = inputs[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        g["e"][:] = 0
        g["e"][row[first]] = np.add.reduceat(dx.reshape(-1, d).take(order, axis=0), first)

    def fit(self, ids: np.ndarray, epochs: int = 1, batch: int = 64, rate: float = 0.01) -> AttentionModel:
        """ids: windows (first column the id before, -2: none; -1 past the end) of WINDOW + 1 ids."""
        self.made = None
        rng, t, shares = np.random.default_rng(13), 0, self._shares()
        # All weights are one array, of which p has the parts; so are gradients and both moments, scaled.
        flat = np.concatenate([w.ravel() for w in self.p.values()])
        grad, m, s, step = (np.zeros_like(flat) for _ in range(4))
        self.p, g = self._parts(flat), self._parts(grad)
        inputs = self._shifted(ids[:, :-1])[0].astype(np.uint16)
        wanted = np.where(ids[:, 1:] >= 0, self.to_class[np.maximum(ids[:, 1:], 0)], -1).astype(np.int16)
        for _ in range(epochs if len(ids) else 0):
            order = rng.permutation(len(ids))
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                self.gradient(inputs[rows], wanted[rows], shares, g)
                t += 1
                scale = (0.01 / (1 - 0.99**t)) ** 0.5
                m *= np.float32(0.9)
                m += grad
                s *= np.float32(0.99)
                s += np.multiply(grad, grad, out=step)
                np.sqrt(s, out=step)
                step += np.float32(1e-8 / scale)
                np.divide(m, step, out=step)
                step *= np.float32(rate * 0.1 / (1 - 0.9**t) / scale)
                flat -= step
        return self

    def _parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of an array that holds all weights."""
        ends = np.cumsum([w.size for w in self.p.values()])
        return {n: flat[z - w.size : z].reshape(w.shape) for (n, w), z in zip(self.p.items(), ends.tolist(), strict=True)}

    def _shifted(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = np.maximum(ids, 0)
        inputs = np.where(ids == -2, self.begin, self.slot[known])
        return inputs, inputs

    def _tables(self) -> tuple:
        """What scoring needs of each id and place: (query, key, value with a one), and the rest; shares; whether
        weights can go without their maximum taken off, and whether logits cannot."""
        p, d = self.p, WIDTH
        known = lambda x, v: np.concatenate((x @ p["q"] * np.float32(d**-0.5), x @ p["k"], x @ p["v"] @ p["h"], np.full((len(x), 1), v)), axis=1).astype(np.float32)
        of_id, of_place = known(p["e"], 0), known(p["pos"], 1)
        most = sum(float(np.abs(x[:, :d] @ y[:, d : 2 * d].T).max()) for x in (of_id, of_place) for y in (of_id, of_place))
        rest = p["e"] @ p["h"], p["pos"] @ p["h"] + p["b"]
        return of_id, of_place, rest, self._shares(), most < 60, self._far()

    def _far(self) -> bool:
        """Whether logits, of vectors between -1 and 1, can be too large for exp."""
        return max(np.abs(self.p["g"]).sum(0).max(), np.abs(self.p["o"]).sum(1).max()) > 60

    def log10(self, ids: np.ndarray, off: np.ndarray, batch: int = 128) -> np.ndarray:
        """log10 probability of each text, ids[off[i]:off[i + 1]] with its end id.

        The same sums as _forward, arranged for few operations: what depends on an id or a place alone is made
        once, groups are worked out for scored places only and classes for the group of the id there, and a batch
        fits a core's cache.
        """
        d = WIDTH
        if self.made is None:
            self.made = self._tables()
        of_id, of_place, rest, shares, calm, far = self.made
        owner, start, firsts = spans(np.diff(off))
        start = start + off[owner]
        stops = off[owner + 1]
        begin = np.zeros(len(ids) + 1, bool)
        begin[off[:-1]] = True
        classes, places = self.to_class[ids].astype(np.int16), np.arange(WINDOW)
        before = np.where(begin[:-1], self.begin, self.slot[np.roll(ids, 1)])
        # The log probability of an id's class after the one before cancels out with that of the id within it.
        got = self.inner[before, self.slot[ids]].astype(np.float64) + self.single[ids]
        for lo in range(0, len(start), batch):
            at = start[lo : lo + batch, None] + places
            stop = stops[lo : lo + batch, None]
            mask = (at < stop) & (places >= firsts[lo : lo + batch, None])
            np.minimum(at, stop - 1, out=at)
            x = of_id.take(before.take(at), axis=0)
            x += of_place
            a = x[..., :d] @ np.ascontiguousarray(x[..., d : 2 * d].transpose(0, 2, 1))
            a += self.MASK
            if not calm:
                a -= a.max(-1, keepdims=True)
            np.exp(a, out=a)
            # The last column of the values is one, so that of the product is what weights sum to.
            seen = (a @ x[..., 2 * d :]).reshape(-1, d + 1)
            mine, of, tiles, _ = _tiled(np.where(mask, classes.take(at), np.int16(-1)).ravel())
            real = mine < len(seen)
            np.minimum(mine, len(seen) - 1, out=mine)
            at = at.ravel().take(mine)
            prior = before.take(at)
            seen = seen.take(mine, axis=0)
            o = rest[0].take(prior, axis=0)
            o += rest[1].take(mine % WINDOW, axis=0)
            o += seen[:, :d] / seen[:, d:]
            np.tanh(o, out=o)
            row = np.arange(len(at))
            u = o @ self.p["g"]
            more = _hit(u, shares[0].take(prior, axis=0), row, of, far)
            split = lambda m: m.reshape(len(tiles), TILE, m.shape[1])
            np.matmul(split(o), self.p["o"].take(tiles, axis=0), out=split(u))
            more += _hit(u, shares[1].take(prior * GROUPS + of, axis=0), row, classes.take(at) % SIZE, far)
            got[at[real]] += more[real]
        return np.bincount(np.repeat(np.arange(len(off) - 1), np.diff(off)), got, len(off) - 1) / np.log(10)


def _log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


def _hit(u: np.ndarray, share: np.ndarray, row: np.ndarray, wanted: np.ndarray, far: bool) -> np.ndarray:
    """The wanted logits less the log of what all weigh, each by its share; u is used up."""
    if far:
        u -= u.max(1, keepdims=True)
    hit = u.reshape(-1).take(row * u.shape[1] + wanted)
    np.exp(u, out=u)
    u *= share
    return hit - np.log(u @ np.ones(u.shape[1], np.float32))


def _less_wanted(z: np.ndarray, share: np.ndarray, row: np.ndarray, wanted: np.ndarray, weight: np.ndarray, far: bool) -> None:
    """In place of logits: probabilities, each by its share, less one at the wanted place; all times the row's weight."""
    if far:
        z -= np.where(share > 0, z, -np.inf).max(1, keepdims=True)
        np.minimum(z, 60, out=z)
    np.exp(z, out=z)
    z *= share
    z *= (weight / (z @ np.ones(z.shape[1], np.float32)))[:, None]
    z.reshape(-1)[row * z.shape[1] + wanted] -= weight


def _tiled(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, their groups, groups of tiles, first tile of each group there) of the places with a wanted class (-1: none), sorted
    by its group, with places past the last that fill up the tiles."""
    of = (wanted // SIZE).astype(np.uint8)
    n = np.bincount(of, minlength=GROUPS)[:GROUPS]
    order = np.argsort(of, kind="stable")[: n.sum()]
    each = -(-n // TILE)
    spare = np.cumsum(each * TILE - n) - (each * TILE - n)
    out = np.full(int(each.sum()) * TILE, len(wanted))
    out[np.arange(len(order)) + np.repeat(spare, n)] = order
    tiles = np.repeat(np.arange(GROUPS), each)
    return out, np.repeat(tiles, TILE), tiles, (np.cumsum(each) - each)[each > 0]


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def _encoded(path: str, end_id: int, kind: np.dtype):
    """Rows with the ids of their texts, of that type, as bytes."""

    def run(batches):
        for b in batches:
            made = []
            for lo, hi, ids, off in text_ids(b.column("text"), path, end_id):
                ids = ids.astype(kind)
                made += [ids[off[i] : off[i + 1]].tobytes() for i in range(hi - lo)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), pa.array(made, pa.binary())], ["doc_id", "text", "ids"])

    return run


def stored_ids(column: pa.Array, kind: np.dtype):
    """(ids, bounds) for chunks of a column of encoded ids."""
    data, off = K.flat(column.view(pa.string()))
    for lo, hi in K.chunks(off):
        yield lo, hi, data[off[lo] : off[hi]].view(kind).astype(np.int64), (off[lo : hi + 1] - off[lo]) // kind.itemsize


def _tally(vocabulary: int, kind: np.dtype):
    """Counts of word hashes (kind 0) and ids (1), and the number of windows (3)."""

    def run(batches):
        ids_seen, n_windows = np.zeros(vocabulary, np.int64), 0
        seen, often, held = [], [], 0

        def words_so_far():
            key, back = np.unique(np.concatenate(seen), return_inverse=True)
            return _counted(0, key.view(np.int64), np.bincount(back, np.concatenate(often)))

        for b in batches:
            for lo, hi, words in K.texts(b.column("text")):
                key, n = np.unique(words.hash, return_counts=True)
                seen += [key, np.array([END_WORD])]
                often += [n, np.array([hi - lo])]
                held += len(key) + 1
                if held > HELD:
                    yield words_so_far()
                    seen, often, held = [], [], 0
            for _, _, ids, off in stored_ids(b.column("ids"), kind):
                ids_seen += np.bincount(ids, minlength=vocabulary)
                n_windows += int((-(-np.diff(off) // WINDOW)).sum())
        if seen:
            yield words_so_far()
        at = np.flatnonzero(ids_seen)
        yield _counted(1, at, ids_seen[at])
        yield _counted(3, np.zeros(1, np.int64), np.array([n_windows]))

    return run


def _counted(kind, keys, n):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n.astype(np.int64))], ["kind", "key", "n"])


def _pairs(shared, kind: np.dtype):
    """Counts of (slot before, slot)."""

    def run(batches):
        model = shared.value
        pairs = np.zeros((KEPT + 2) * (KEPT + 1), np.int32)
        for b in batches:
            for _, _, ids, off in stored_ids(b.column("ids"), kind):
                c = model.slot[ids]
                before = np.concatenate(([model.begin], c[:-1])) if len(c) else c
                before[off[:-1]] = model.begin
                key, n = np.unique(before * (KEPT + 1) + c, return_counts=True)
                pairs[key] += n.astype(np.int32)
        at = np.flatnonzero(pairs)
        yield _counted(2, at, pairs[at])

    return run


def _windows_to_learn(shards: int, every: int, kind: np.dtype, form: type = np.int32):
    """(shard, key, ids) of the windows, one in `every` by hash, of each text; the first id is the one before, -2 at
    the start, and ids past the end are -1. form: of the ids; unsigned ones of 16 bits have -2 and -1 as their largest."""

    def run(batches):
        places = np.arange(WINDOW + 1)
        for b in batches:
            doc, shard, keys, rows = b.column("h").to_numpy().view(np.uint64), [], [], []
            for lo, _, ids, off in stored_ids(b.column("ids"), kind):
                count = -(-np.diff(off) // WINDOW)
                owner = np.repeat(np.arange(len(count)), count)
                start = (np.arange(len(owner)) - (np.cumsum(count) - count)[owner]) * WINDOW
                key = K.mix(doc[lo + owner] + start.astype(np.uint64))
                mine = np.flatnonzero(key % U(every) == 0)
                owner, key = owner[mine], key[mine]
                at = (off[owner] + start[mine])[:, None] - 1 + places
                got = ids[np.clip(at, 0, max(0, len(ids) - 1))]
                got[at < off[owner][:, None]] = -2
                got[at >= off[owner + 1][:, None]] = -1
                key = K.mix(key)
                shard.append((key % U(shards)).astype(np.int64))
                keys.append((key >> U(1)).astype(np.int64))
                rows += [r.tobytes() for r in got.astype(form)]
            flat = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in (shard, keys)]
            yield pa.RecordBatch.from_arrays([pa.array(flat[0]), pa.array(flat[1]), pa.array(rows, pa.binary())], ["shard", "key", "ids"])

    return run


def _short(vocabulary: int) -> type:
    """The smallest form of the ids of windows that leaves room for -2 and -1."""
    return np.uint16 if vocabulary <= (1 << 16) - 2 else np.int32


def _window_ids(rows: list) -> np.ndarray:
    """The windows of one shard, in either form."""
    short = bool(rows) and len(rows[0]) == 2 * (WINDOW + 1)
    ids = np.frombuffer(b"".join(rows), np.uint16 if short else np.int32).reshape(-1, WINDOW + 1).astype(np.int64)
    return np.where(ids >= (1 << 16) - 2, ids - (1 << 16), ids) if short else ids


FITTED = "shard long, n long, weights binary"


def _fitted(shared):
    """A shard's weights after one pass over its windows, from the weights of the shared model."""

    def run(group: pa.Table) -> pa.Table:
        model, rate = shared.value
        model = copy.copy(model)
        model.p = {n: w.copy() for n, w in model.p.items()}
        rows = sorted(zip(group.column("key").to_pylist(), group.column("ids").to_pylist(), strict=True))
        ids = _window_ids([r for _, r in rows])
        model.fit(ids, rate=rate)
        return pa.table({"shard": group.column("shard").slice(0, 1), "n": pa.array([len(ids)], pa.int64()), "weights": pa.array([model.weights()], pa.binary())})

    return run


def _mean(group: pa.Table) -> pa.Table:
    """The mean of some shards' weights, by their windows."""
    n = group.column("n").to_pylist()
    total = sum(np.frombuffer(w, np.float32).astype(np.float64) * m for w, m in zip(group.column("weights").to_pylist(), n, strict=True))
    mean = (total / sum(n)).astype(np.float32).tobytes()
    return pa.table({"shard": group.column("shard").slice(0, 1), "n": pa.array([sum(n)], pa.int64()), "weights": pa.array([mean], pa.binary())})


def learn(model: AttentionModel, windows: DataFrame, shards: int, rounds: int = ROUNDS) -> AttentionModel:
    """Fit the model's attention weights to windows(shard, key, ids), each in one of the rounds: there every shard in a task of its own,
    then their mean, taken in steps of FAN shards, so that the driver gets FAN sets of weights at most."""
    sc = windows.sparkSession.sparkContext
    for r in range(rounds):
        small = copy.copy(model)
        small.inner = small.single = small.made = None
        shared = sc.broadcast((small, 0.01 / (1 + r)))
        # A fixed number of partitions: by bytes, which are few, many shards would be joined into one task.
        mine = windows.where(F.pmod(F.shiftright("key", 40), F.lit(rounds)) == r)
        fitted = materialize(mine.repartition(min(2 * shards, 20_000), "shard").groupBy("shard").applyInArrow(_fitted(shared), FITTED), "fitted")
        left, done = shards, [fitted]
        while left > FAN:
            left = -(-left // FAN)
            fitted = materialize(fitted.withColumn("shard", F.pmod("shard", F.lit(left))).groupBy("shard").applyInArrow(_mean, FITTED), "fitted")
            done.append(fitted)
        parts = fitted.orderBy("shard").toArrow()
        if parts.num_rows:
            model.set_weights(_mean(parts).column("weights")[0].as_py())
        shared.unpersist()
        release(*done)
    return model


class KeyIndex:
    """Places of 64-bit hashes among sorted ones: a table by leading bits leaves a step or two, as hashes spread evenly."""

    def __init__(self, keys: np.ndarray):
        self.n, self.shift = len(keys), U(64 - max(1, len(keys).bit_length()))
        self.keys = np.append(keys, U(2**64 - 1))
        ends = np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << (64 - int(self.shift))))
        self.first = np.concatenate(([0], ends[:-1])).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether found) of each hash."""
        at = self.first[(h >> self.shift).astype(np.int64)].astype(np.int64)
        left = np.flatnonzero(self.keys[at] < h)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] < h[left]]
        hit = (self.keys[at] == h) & (at < self.n)
        return at, hit


def _scores(shared, kind: np.dtype):
    def run(batches):
        model, keys, counts = shared.value
        index = KeyIndex(keys)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            cols = {n: [] for n in ("n_tokens", "n_known", "base", "score")}
            rare, rare_n, sizes = [], [], [0]
            for _, hi, words in K.texts(b.column("text")):
                h = np.insert(words.hash, words.off[1:], END_WORD)
                off = words.off + np.arange(len(words.off))
                at, hit = index.find(h)
                owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
                n = len(off) - 1
                cols["n_tokens"].append(np.diff(off))
                cols["n_known"].append(np.bincount(owner[hit], minlength=n))
                cols["base"].append(np.bincount(owner[hit], np.log10(counts[at[hit]] + 0.5) if len(keys) else None, n))
                left = np.flatnonzero(~hit)
                for i in range(n):
                    a, z = np.searchsorted(left, (off[i], off[i + 1]))
                    key, often = np.unique(h[left[a:z]], return_counts=True)
                    rare.append(key)
                    rare_n.append(often)
                    sizes.append(sizes[-1] + len(key))
            for _, _, ids, off in stored_ids(b.column("ids"), kind):
                cols["score"].append(model.log10(ids, off))
            flat = {n: np.concatenate(v) if v else np.zeros(0) for n, v in cols.items()}
            ends = pa.array(np.array(sizes, np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(v).astype(np.uint64).view(np.int64) if v else np.zeros(0, np.int64))) for v in (rare, rare_n)]
            rid = np.arange(row, row + b.num_rows)
            row += b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), b.column("doc_id"), pa.array(flat["n_tokens"].astype(np.int64)), pa.array(flat["n_known"].astype(np.int64)), pa.array(flat["base"].astype(np.float64)), pa.array(flat["score"].astype(np.float64)), *lists],
                ["rid", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "rare_n"],
            )

    return run


def score_documents(docs: DataFrame, tokenizer: str, most_words: int = MOST_WORDS, every: int = EVERY) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    prepare(spark)
    words = WordIds.of(tokenizer)
    size = words.tokenizer.get_vocab_size()
    ends = np.zeros(size, np.int64)
    for token, i in words.tokenizer.get_vocab().items():
        ends[i] = token.endswith("</w>")
    kind = _id_type(size)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = materialize(rows.mapInArrow(_encoded(tokenizer, words.apart, kind), "doc_id long, text string, ids binary"), "encoded", row_group=16 << 20)
    training = rows.where(~_held_out())
    counts = materialize(training.select("text", "ids").mapInArrow(_tally(size, kind), "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    few = {k: [] for k in (1, 3)}  # at most one row per id, and one
    for r in counts.where("kind > 0").collect():
        few[r.kind].append((r.key, r.n))
    ids = np.zeros(size, np.int64)
    for key, n in few[1]:
        ids[key] = n
    model = AttentionModel(ids, ends)
    sc = spark.sparkContext
    found = training.select("ids").mapInArrow(_pairs(sc.broadcast(model), kind), "kind int, key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most one row per pair of slots
    pairs = np.zeros((KEPT + 2) * (KEPT + 1), np.int64)
    pairs[found.column("key").to_numpy()] = found.column("n").to_numpy()
    model.set_counts(ids, pairs.reshape(KEPT + 2, KEPT + 1))
    shards = max(1, round(sum(n for _, n in few[3]) / every / ROUNDS / SHARD))
    windows = training.select(F.xxhash64("doc_id", "ids").alias("h"), "ids").mapInArrow(_windows_to_learn(shards, every, kind, _short(size)), "shard long, key long, ids binary")
    learn(model, windows, shards)  # made anew in each round, which costs less than a table of them
    vocabulary = counts.where("kind = 0")
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    least = 1
    if distinct > most_words:
        # The least count at which no more than most_words words are broadcast.
        steps = vocabulary.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()
        room = 0
        for b, c in sorted(((r.b, r.c) for r in steps), reverse=True):
            if room + c > most_words:
                least = 2 ** (b + 1)
                break
            room += c
    top = vocabulary.where(F.col("n") >= least).select("key", "n").toArrow()
    keys = top.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    known = (model, keys[order], top.column("n").to_numpy()[order])
    scored = rows.mapInArrow(_scores(sc.broadcast(known), kind), "rid long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<long>, rare_n array<long>")
    scored = materialize(scored, "scored")
    release(rows)
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("rid", F.col("x.rare").alias("key"), F.col("x.rare_n").alias("m"))
    found = rare.join(vocabulary.where(F.col("n") < least).select("key", "n"), "key", "left").groupBy("rid").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("more"), F.sum(F.col("m") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("rest")
    )
    per_token = float(np.log10(total + 0.5 * (distinct + 1)))
    out = scored.join(found, "rid", "left")
    return out.select(
        "doc_id", _held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), "score",
    )


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
