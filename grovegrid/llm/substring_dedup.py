"""Substring dedup by collinear chaining of shared k-mer seeds.

Seeds are the minimizers of a document's k-word windows (the smallest hash of each `window` positions), so that any
shared run of k + window - 1 words has a shared seed. One shuffle deals the seeds out by their hash; a stream over the
sorted rows matches each holder of a seed to its home, the lowest doc_id that holds it, and to the holder before it:
linear in the seeds however many documents share a passage. The i-th occurrence in a document goes with the i-th
there, or else, unless it overlaps the one before, with the first. A seed that very many documents hold is dealt out by SALTS fixed shares of doc_ids as
well, each share with a home of its own; the homes of the shares are matched in a second, small round. Where lower
documents hold parts of a passage, the holder before often has it whole, and the seeds across the seams (there are
some, as window < k) lead to the document that holds it whole.

A document's matches, to whichever documents, are looked at together: a seed that is alone with its partner and in no unbroken
stretch of shared seeds is dropped, and so is a match inside another document's that is sure to be a passage. The other matches with one document
are merged to exact runs, and the runs chained: a tree over the home's positions gives the best chain end within reach
below a point, with gap costs linear in the words skipped. The gaps of a chain, be it a single seed, are aligned word
by word and its ends extended, and passages of min_words words at least with percent % of matching words are kept; a
chain with fewer is split at its widest gap, and its parts are tried alike, down to single runs.
The lower document keeps its copy; the passages found are the repeats.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. Repeats within one document, texts that are null or
shorter than k words, and rows without a doc_id have no passages. Rows that repeat a doc_id with the
same text count once; with other texts each is matched on its own, to documents under other ids only.
Empty tables give no rows; other columns of docs are left alone, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .storage import materialize, prepare, release, sized

U = np.uint64
#: Cost of each word skipped on either side, in matched words.
GAP = 0.25
#: Runs are linked only where no more words than this are skipped on either side.
WIDEST = 40
#: In an extension: cost of each odd word, in matched words, and how far below the best it is given up; the
#: second, looser pair is tried where the first gives too short a passage.
STRICT, LOOSE = (2, 12), (1, 8)
#: Seeds of a pair with more words than this between them are not of one stretch.
APART = 45
#: A seed is dealt out in SALTS shares where, of some FLUSH seeds read together, at least 1 / SALTS of the documents hold it.
SALTS, FLUSH = 64, 1 << 20
#: Bits of a text's hash that tell apart texts under one doc_id until the texts themselves are compared.
TAG = 0xFFFF


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash (the last among equals) of each `window` positions in a row."""
    n = len(h)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(h[::-1]))]) if n else np.zeros(0, np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(h[::-1], window)
    at = n - 1 - (np.arange(n - window + 1) + np.argmin(seen, axis=1))
    return np.unique(at)


def _seed_rows(k: int, window: int):
    """Batches (doc_id, tkey, text) -> arrays (seed, doc_id, tag << 32 | place), a chunk of texts at a time."""

    def run(batches):
        for b in batches:
            docs, tags = b.column("doc_id").to_numpy(), b.column("tkey").to_numpy() & TAG
            for lo, hi, words in K.texts(b.column("text")):
                h, bounds = K.shingle_hashes(words, k)
                count = np.diff(words.off)
                found = [minimizers(h[bounds[i] : bounds[i + 1]], window) if count[i] >= k else np.zeros(0, np.int64) for i in range(hi - lo)]
                n = [len(f) for f in found]
                at = np.concatenate(found)
                yield h[np.repeat(bounds[:-1], n) + at].view(np.int64), np.repeat(docs[lo:hi], n), np.repeat(tags[lo:hi] << 32, n) | at

    return run


def _seeds_of(k: int, window: int):
    def run(batches):
        for rows in _seed_rows(k, window)(batches):
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["seed", "doc", "at"])

    return run


def _frequent(k: int, window: int):
    """Seeds that 1 / SALTS of the documents at least, and sixteen, hold among some that are read together."""

    def run(batches):
        held, rows = [], 0

        def flush():
            seed, doc = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((doc, seed))
            seed, doc = seed[order], doc[order]
            new = np.ones(len(seed), bool)
            new[1:] = (np.diff(seed) != 0) | (np.diff(doc) != 0)
            value, n = np.unique(seed[new], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value[n >= max(16, len(np.unique(doc)) / SALTS)])], ["seed"])

        for seed, doc, _ in _seed_rows(k, window)(batches):
            held.append((seed, doc))
            rows += len(seed)
            if rows >= FLUSH:
                yield flush()
                held, rows = [], 0
        if rows:
            yield flush()

    return run


def _matches_of(k: int):
    """Rows (seed, salt, doc, at) sorted so -> matches (doc, tags, home, xy), and for salted seeds also the rows of each
    share's home (with the seed, and no home; of occurrences that overlap, the first). Nothing is held but the rows of a seed's home and of the last document."""
    names = ["seed", "salt", "doc", "at"]

    def run(batches):
        kept = [np.zeros(0, np.int64)] * 4
        for b in batches:
            n_kept = len(kept[0])
            seed, salt, doc, at = (np.concatenate((x, b.column(c).to_numpy())) for x, c in zip(kept, names, strict=True))
            fresh = np.arange(len(seed)) >= n_kept
            if not len(seed):
                continue
            same = np.zeros(len(seed), bool)
            same[1:] = (seed[1:] == seed[:-1]) & (salt[1:] == salt[:-1])
            again = np.zeros(len(seed), bool)
            again[1:] = same[1:] & (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])
            seed, salt, doc, at, fresh, same = (x[~again] for x in (seed, salt, doc, at, fresh, same))
            tag, place = at >> 32, at & 0xFFFFFFFF
            text = ~same  # where a text's rows begin
            text[1:] |= (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
            first = np.flatnonzero(text)
            of = np.cumsum(text) - 1
            n = np.diff(np.append(first, len(seed)))
            group = np.cumsum(~same)[first] - 1  # the seed of each text
            home = np.flatnonzero(~same)[group]
            home = of[home]
            before = np.arange(len(first)) - 1
            while True:  # texts under the same doc_id are no holders before
                other = (before >= home) & (doc[first[np.maximum(before, 0)]] == doc[first])
                if not other.any():
                    break
                before = before - other
            before = np.where(before < home, home, before)
            out = []
            nth = np.arange(len(seed)) - first[of]
            over = np.zeros(len(seed), bool)  # a word or two said over and over: the i-th goes with the i-th alone
            over[1:] = (nth[1:] > 0) & (np.diff(place) < k)
            for partner in (home, before):
                p = partner[of]
                fits = fresh & (doc[first[p]] < doc) & ~(over & (nth >= n[p]))
                if partner is before:
                    fits &= before[of] != home[of]
                i = np.flatnonzero(fits)
                p = p[i]
                y = place[first[p] + np.where(nth[i] < n[p], nth[i], 0)]
                out.append((doc[i], tag[i] << 16 | tag[first[p]], doc[first[p]], place[i] << 32 | y))
            lead = np.flatnonzero(fresh & (salt > 0) & ~over & (doc == doc[first[home[of]]]))
            cols = [np.concatenate(x) for x in zip(*out, strict=True)]
            none = np.zeros(len(cols[0]) + len(lead), bool)
            none[: len(cols[0])] = True
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((np.zeros(len(cols[0]), np.int64), seed[lead])), mask=none),
                pa.array(np.concatenate((cols[0], doc[lead]))), pa.array(np.concatenate((cols[1], at[lead]))),
                pa.array(np.concatenate((cols[2], np.zeros(len(lead), np.int64))), mask=~none), pa.array(np.concatenate((cols[3], np.zeros(len(lead), np.int64))))],
                ["seed", "doc", "tags", "home", "xy"])
            last = group == group[-1]
            keep = last & ((np.arange(len(first)) == home) | (doc[first] == doc[-1]))
            # and the last text under another doc_id, should the next rows go on with this one
            keep[max(before[-1], 0)] |= last[max(before[-1], 0)]
            rows = keep[of]
            kept = [x[rows] for x in (seed, salt, doc, at)]

    return run


class Reach:
    """Maxima of (score, item) over a range of ranks 0..n-1, one value at each rank; a value can be taken out again."""

    NONE = (-1e18, -1)

    def __init__(self, n: int):
        self.n, self.best = n, [self.NONE] * (2 * n)

    def put(self, rank: int, value: tuple[float, int] = NONE) -> None:
        i = rank + self.n
        self.best[i] = value
        while i > 1:
            i >>= 1
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def between(self, lo: int, hi: int) -> tuple[float, int]:
        """Over the ranks lo..hi-1."""
        out, i, j = self.NONE, lo + self.n, hi + self.n
        while i < j:
            if i & 1:
                out, i = max(out, self.best[i]), i + 1
            if j & 1:
                j -= 1
                out = max(out, self.best[j])
            i, j = i >> 1, j >> 1
        return out


def runs_of(x: np.ndarray, y: np.ndarray, k: int, pair: np.ndarray | None = None) -> np.ndarray:
    """Distinct matches (x, y) of k words each -> rows (pair, start x, start y, length) of exact runs along diagonals, in order."""
    pair = np.zeros(len(x), np.int64) if pair is None else pair
    order = np.lexsort((x, y - x, pair))
    x, y, pair = x[order], y[order], pair[order]
    new = np.ones(len(x), bool)
    new[1:] = (np.diff(y - x) != 0) | (np.diff(x) > k) | (np.diff(pair) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x)) - 1
    rows = np.stack((pair[first], x[first], y[first], x[last] + k - x[first]), axis=1)
    return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def chains(runs: list) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains of runs (start x, start y, length), each ascending in both, best first."""
    if len(runs) == 1:
        return [[tuple(runs[0])]]
    rows = sorted(runs)
    by_y = sorted(range(len(rows)), key=lambda i: rows[i][1] + rows[i][2])
    ends = [rows[i][1] + rows[i][2] for i in by_y]
    rank = {i: r for r, i in enumerate(by_y)}
    low = [bisect_left(ends, y - WIDEST) for _, y, _ in rows]
    high = [bisect_right(ends, y) for _, y, _ in rows]
    tree, score, back = Reach(len(rows)), [0.0] * len(rows), [-1] * len(rows)
    waiting = sorted(range(len(rows)), key=lambda i: rows[i][0] + rows[i][2])
    w = gone = 0
    for j, (x, y, n) in enumerate(rows):
        while w < len(waiting) and rows[waiting[w]][0] + rows[waiting[w]][2] <= x:
            i = waiting[w]
            xe, ye = rows[i][0] + rows[i][2], rows[i][1] + rows[i][2]
            tree.put(rank[i], (score[i] + GAP * (xe + ye), i))
            w += 1
        while gone < w and rows[waiting[gone]][0] + rows[waiting[gone]][2] < x - WIDEST:
            tree.put(rank[waiting[gone]])
            gone += 1
        score[j] = n
        if low[j] < high[j]:
            value, i = tree.between(low[j], high[j])
            gain = value - GAP * (x + y)
            if i >= 0 and gain > 0:
                score[j], back[j] = n + gain, i
    out, used = [], [False] * len(rows)
    for j in sorted(range(len(rows)), key=lambda j: (-score[j], j)):
        if used[j]:
            continue
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(tuple(rows[j]))
            j = back[j]
        out.append(chain[::-1])
    return out


def stretches(x: np.ndarray, group: np.ndarray, k: int, apart: int) -> np.ndarray:
    """For each seed (place x in `group`) the words that its stretch spans: seeds of the group with at most `apart` words between."""
    if not len(x):
        return np.zeros(0, np.int64)
    order = np.lexsort((x, group))
    xs, gs = x[order], group[order]
    new = np.ones(len(xs), bool)
    new[1:] = (gs[1:] != gs[:-1]) | (np.diff(xs) > k + apart)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(xs)) - 1
    out = np.empty(len(xs), np.int64)
    out[order] = (xs[last] + k - xs[first])[np.cumsum(new) - 1]
    return out


def promising(x: np.ndarray, doc: np.ndarray, pair: np.ndarray, k: int, min_words: int) -> np.ndarray:
    """Which matches can be of a passage: those with another seed of the same pair within APART words, and those in an unbroken stretch of
    the document's shared seeds, be they shared with whichever documents, that spans half of min_words."""
    return (stretches(x, pair, k, APART) > k) | (stretches(x, doc, k, k) >= min_words // 2)


def document_chains(pairs: list, min_words: int, percent: int) -> list:
    """[(key, runs)]: the runs of one document with each other one -> [(key, chains)] without those that lie in a chain of
    another key that is a passage as it stands."""
    found, sure = [], []
    for key, runs in pairs:
        for c in chains(runs):
            (x0, y0, _), (p, q, n) = c[0], c[-1]
            exact = sum(r[2] for r in c)
            found.append((key, c, x0, p + n))
            if exact >= min_words and 100 * exact >= percent * max(p + n - x0, q + n - y0):
                sure.append((x0 - p - n, key, x0, p + n))
    kept: list = []
    for _, key, x0, x1 in sorted(sure):
        if not any(a <= x0 and x1 <= b for _, a, b in kept):
            kept.append((key, x0, x1))
    out: dict = {}
    for key, c, x0, x1 in found:
        if not any(a <= x0 and x1 <= b and key != other for other, a, b in kept):
            out.setdefault(key, []).append(c)
    return list(out.items())


def _chains_of(k: int, min_words: int, percent: int):
    """Matches sorted by document and home -> the chains of each pair, however short: their ends are extended later."""

    def chained(doc, tags, home, xy):
        change = np.ones(len(doc), bool)
        change[1:] = (doc[1:] != doc[:-1]) | (tags[1:] >> 16 != tags[:-1] >> 16)
        pair = change.copy()
        pair[1:] |= (tags[1:] != tags[:-1]) | (home[1:] != home[:-1])
        long = promising(xy >> 32, np.cumsum(change), np.cumsum(pair), k, min_words)
        pair = np.cumsum(pair)
        long[1:] &= (pair[1:] != pair[:-1]) | (xy[1:] != xy[:-1])
        doc, tags, home, xy, pair = (v[long] for v in (doc, tags, home, xy, pair))
        out = []
        if len(doc):
            runs = runs_of(xy >> 32, xy & 0xFFFFFFFF, k, pair)
            first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            heads = zip(doc[first].tolist(), (tags[first] >> 16).tolist(), home[first].tolist(), (tags[first] & TAG).tolist(), strict=True)
            at = [*np.searchsorted(runs[:, 0], pair[first]).tolist(), len(runs)]
            runs = list(map(tuple, runs[:, 1:].tolist()))
            mine, own = [], None
            for (*now, other, htag), lo, hi in zip([*heads, (None, None, None, None)], at, [*at[1:], 0], strict=True):
                if now != own:
                    out += [(*own, *key, [np.array(c, np.int32).tobytes() for c in cs]) for key, cs in (document_chains(mine, min_words, percent) if mine else [])]
                    mine, own = [], now
                mine.append(((other, htag), runs[lo:hi]))
        cols = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.list_(pa.binary()))], ["doc_id", "tag", "home", "htag", "runs"])

    def run(batches):
        kept = [np.zeros(0, np.int64)] * 4
        for b in batches:
            rows = [np.concatenate((x, b.column(c).to_numpy())) for x, c in zip(kept, ("doc", "tags", "home", "xy"), strict=True)]
            if len(rows[0]):
                open_ = (rows[0] == rows[0][-1]) & (rows[1] >> 16 == rows[1][-1] >> 16)
                yield chained(*(x[~open_] for x in rows))
                kept = [x[open_] for x in rows]
        if len(kept[0]):
            yield chained(*kept)

    return run


def _matches(a: list, b: list) -> int:
    """Most words that two short sequences have in common in order."""
    if not a or not b:
        return 0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if x == y else max(row[j], row[j - 1])
            last = keep
    return row[-1]


def _go_on(a: list, b: list, i: int, j: int, step: int, ends: tuple[int, int], odd: int, drop: int) -> tuple[int, int, int]:
    """The best way on from a[i], b[j]: a word that agrees counts 1, a word skipped or changed -odd; it ends where all ways are drop below the best."""
    best, found, row = (0, 0), (i, j, 0), {j: (0, 0)}
    for v in range(1, drop // odd + 1):
        if (ends[1] - j) * step < v:
            break
        row[j + step * v] = (-odd * v, 0)
    while i != ends[0] and row:
        word, new, last = a[i], {}, None
        i += step
        q = min(row) if step > 0 else max(row)
        stop = (max(row) if step > 0 else min(row)) + step
        while True:
            way = (row[q][0] - odd, row[q][1]) if q in row else None
            if (old := row.get(q - step)) is not None:
                way = max(way or old, (old[0] + 1, old[1] + 1)) if b[q - step] == word else max(way or (-drop * 9, 0), (old[0] - odd, old[1]))
            if last is not None:
                way = max(way or (-drop * 9, 0), (last[0] - odd, last[1]))
            last = way if way is not None and way[0] > best[0] - drop else None
            if last is not None:
                new[q] = last
                if last > best:
                    best, found = last, (i, q, last[1])
            elif q == stop or (q - stop) * step > 0:
                break
            if q == ends[1]:
                break
            q += step
        row = new
    return found


def _extend(a: list, b: list, i: int, j: int, step: int, ends: tuple[int, int], how: tuple[int, int]) -> tuple[int, int, int]:
    """From a[i], b[j] on by step: how far both agree; single odd words or pairs are passed where three follow alike, others as _go_on does."""
    found = 0
    while True:
        while i != ends[0] and j != ends[1] and a[i] == b[j]:
            i, j, found = i + step, j + step, found + 1
        for da, db in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2)):
            p, q = i + step * da, j + step * db
            left = min((ends[0] - p) * step, (ends[1] - q) * step)
            if left >= 3 and all(a[p + step * t] == b[q + step * t] for t in range(3)):
                i, j = p, q
                break
        else:
            p, q, more = _go_on(a, b, i, j, step, ends, *how)
            if not more:
                return i, j, found
            i, j, found = p, q, found + more


def gaps(a: list, b: list, runs: list[tuple[int, int, int]]) -> list[int]:
    """The words matched between each run of a chain and the next."""
    return [_matches(a[x + n : p], b[y + n : q]) for (x, y, n), (p, q, _) in zip(runs, runs[1:], strict=False)]


def align(a: list, b: list, runs: list[tuple[int, int, int]], between: list[int] | None = None, how: tuple[int, int] = STRICT) -> tuple[int, int, int, int, int]:
    """A chain on word lists a and b -> (start, end) in a, (start, end) in b, matched words. between: the words matched in each gap."""
    between = gaps(a, b, runs) if between is None else between
    x, y, n = runs[0]
    i, j, found = _extend(a, b, x - 1, y - 1, -1, (-1, -1), how)
    x0, y0 = i + 1, j + 1
    # _extend stops at the first pair that differs, so the words passed are those of the extension
    found += n
    x, y = x + n, y + n
    for (p, q, n), m in zip(runs[1:], between, strict=True):
        found += m + n
        x, y = p + n, q + n
    x1, y1, more = _extend(a, b, x, y, 1, (len(a), len(b)), how)
    return x0, x1, y0, y1, found + more


def _alike_around(a: list, b: list, runs: list[tuple[int, int, int]], reach: int) -> int:
    """How many words the two texts have in common, order aside, from `reach` before the runs to `reach` after: no fewer than an alignment there can match."""
    (x, y, _), (p, q, n) = runs[0], runs[-1]
    left: dict = {}
    for w in b[max(0, y - reach) : q + n + reach]:
        left[w] = left.get(w, 0) + 1
    found = 0
    for w in a[max(0, x - reach) : p + n + reach]:
        if left.get(w):
            left[w] -= 1
            found += 1
    return found


def aligned(a: list, b: list, runs: list[tuple[int, int, int]], min_words: int, percent: int):
    """The passages of a chain as align gives them: a chain that misses percent is split at its widest gap and its parts are tried."""
    between, todo = gaps(a, b, runs), [(0, len(runs))]
    while todo:
        lo, hi = todo.pop()
        # A passage that goes further than min_words beyond the runs agrees in part at least this near to them.
        if 100 * _alike_around(a, b, runs[lo:hi], min_words) < percent * percent * min_words // 100:
            continue
        for how in (STRICT, LOOSE):
            x0, x1, y0, y1, n = align(a, b, runs[lo:hi], between[lo : hi - 1], how)
            alike = 100 * n >= percent * max(x1 - x0, y1 - y0)
            if alike and x1 - x0 >= min_words:
                yield x0, x1, y0, y1, n
                break
            if how == STRICT and not alike:
                if hi - lo > 1:
                    wide = [max(runs[i][0] - runs[i - 1][0], runs[i][1] - runs[i - 1][1]) - runs[i - 1][2] for i in range(lo + 1, hi)]
                    cut = lo + 1 + int(np.argmax(wide))
                    todo += [(cut, hi), (lo, cut)]
                break


def _passages(k: int, min_words: int, percent: int):
    names = ["doc_id", "tkey", "start_word", "end_word", "start_byte", "end_byte", "home_id", "home_start", "home_end", "n_matched"]

    def hashed(column):
        for _, _, words in K.texts(column):
            for i in range(len(words.off) - 1):
                lo, hi = words.off[i], words.off[i + 1]
                yield words.hash[lo:hi], words.start[lo:hi] - words.byte_off[i], words.end[lo:hi] - words.byte_off[i]

    def run(batches):
        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("doc_id", "tkey", "home", "runs")]
            for doc, tkey, home, runs, mine, theirs in zip(*cols, hashed(b.column("text")), hashed(b.column("home_text")), strict=True):
                ours, others, kept = mine[0].tolist(), theirs[0].tolist(), []
                for r in runs:
                    chain = [tuple(x) for x in np.frombuffer(r, np.int32).reshape(-1, 3).tolist()]
                    if any(a <= chain[0][0] and chain[-1][0] + chain[-1][2] <= b for a, b in kept):
                        continue  # within a passage found
                    for x0, x1, y0, y1, n in aligned(ours, others, chain, min_words, percent):
                        kept.append((x0, x1))
                        out.append((doc, tkey, x0, x1, int(mine[1][x0]), int(mine[2][x1 - 1]), home, y0, y1, n))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("tkey"), text.alias("text")).where("doc_id is not null and text is not null")


def repeated_passages(docs: DataFrame, k: int = 6, window: int = 5, min_words: int = 50, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) -> doc_id, tkey (xxhash64 of the text), start_word, end_word (exclusive), start_byte, end_byte (in
    the UTF-8 text), home_id, home_start, home_end, n_matched: a row per repeated passage and home."""
    spark = docs.sparkSession
    prepare(spark, 500)
    texts = _keyed(docs)
    common = materialize(texts.mapInArrow(_frequent(k, window), "seed long").distinct(), "common")
    seeds = texts.mapInArrow(_seeds_of(k, window), "seed long, doc long, at long")
    share = F.when(F.col("often"), F.pmod(F.xxhash64("doc"), F.lit(SALTS)) + 1).otherwise(F.lit(0)).cast("long")
    dealt = seeds.join(sized(common.withColumn("often", F.lit(True)), common.count()), "seed", "left").select("seed", share.alias("salt"), "doc", "at")
    order = ["seed", "salt", "doc", "at"]

    def matched(rows: DataFrame) -> DataFrame:
        return rows.repartition("seed", "salt").sortWithinPartitions(*order).mapInArrow(_matches_of(k), "seed long, doc long, tags long, home long, xy long")

    found = materialize(matched(dealt), "matches")
    homes = found.where("seed is not null").select("seed", F.lit(0).cast("long").alias("salt"), "doc", F.col("tags").alias("at"))
    pairs = ["doc", "tags", "home", "xy"]
    both = found.where("home is not null").select(*pairs).unionByName(matched(homes).select(*pairs))
    both = both.repartition("doc", F.shiftright("tags", 16)).sortWithinPartitions("doc", "tags", "home", "xy")
    linked = materialize(both.mapInArrow(_chains_of(k, min_words, percent), "doc_id long, tag long, home long, htag long, runs array<binary>"), "chains")
    release(common, found)
    ids = materialize(linked.select(F.col("doc_id").alias("id")).union(linked.select("home")).distinct(), "ids")
    wanted = materialize(texts.join(sized(ids.withColumnRenamed("id", "doc_id"), ids.count()), "doc_id", "left_semi"), "texts")
    mine = linked.join(wanted, "doc_id").where(f"(tkey & {TAG}L) = tag")
    theirs = wanted.select(F.col("doc_id").alias("home"), F.col("tkey").alias("hkey"), F.col("text").alias("home_text"))
    out = mine.join(theirs, "home").where(f"(hkey & {TAG}L) = htag").select("doc_id", "tkey", "home", "runs", "text", "home_text")
    schema = "doc_id long, tkey long, start_word long, end_word long, start_byte long, end_byte long, home_id long, home_start long, home_end long, n_matched long"
    found = materialize(out.mapInArrow(_passages(k, min_words, percent), schema).distinct(), "passages")
    release(linked, ids, wanted)
    return found


def _cut(batches):
    for b in batches:
        texts = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("_cuts").to_pylist(), strict=True):
            if spans and text is not None:
                raw, at, parts = text.encode(), 0, []
                for s in sorted((s["start_byte"], s["end_byte"]) for s in spans):
                    parts.append(raw[at : max(at, s[0])])
                    at = max(at, s[1])
                text = b"".join([*parts, raw[at:]]).decode("utf-8", "replace")
            texts.append(text)
        i = b.schema.get_field_index("text")
        yield b.set_column(i, "text", pa.array(texts, pa.string())).drop_columns(["_cuts"])


def drop_repeats(docs: DataFrame, k: int = 6, window: int = 5, min_words: int = 50, percent: int = 80) -> DataFrame:
    """docs without their repeated passages: the text is cut, n_chars (if there) counted anew, all other columns
    kept; documents of which nothing but white space stays are dropped. Rows that repeat a doc_id are told apart by their texts."""
    found = repeated_passages(docs, k, window, min_words, percent)
    cuts = materialize(found.groupBy("doc_id", "tkey").agg(F.collect_set(F.struct("start_byte", "end_byte")).alias("_cuts")), "cuts")
    same = (docs["doc_id"].cast("long") == cuts["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == cuts["tkey"])
    with_cuts = docs.join(sized(cuts, 20 * cuts.count()), same, "left").select(*(docs[c] for c in docs.columns), cuts["_cuts"])
    hit = with_cuts.where("_cuts is not null").mapInArrow(_cut, docs.schema).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        hit = hit.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return with_cuts.where("_cuts is null").drop("_cuts").unionByName(hit)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("tkey")
