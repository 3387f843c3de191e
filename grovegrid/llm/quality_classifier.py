"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counted from the text alone. Each is cut into bins at quantiles of the labelled sample;
cyclic boosting adds shallow trees, one feature at a time, to a table of scores per bin; then the pairs
of features that explain most of what is left get a table over two coarse sets of bins each. A text's
score is the logistic function of the sum of its table entries.

The labels come from a bounded sample (MOST_LABELLED rows by hash of doc_id) of the rows whose
crc32(doc_id) mod 4 is not 2; only their features reach the driver. Features and scores are computed for
every row. Null texts are empty. A doc_id that is null or has no label trains nothing; one with several
labels trains if they agree. With labels of one class only, or none, every score is the smoothed share of
label 1 (1 without any label, as nothing speaks against a text).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .storage import materialize, prepare

MOST_LABELLED = 20_000
THRESHOLD = 0.7
FEATURES = [
    "log_chars", "log_words", "word_length", "longest_word", "upper", "digits", "marks", "exclaims", "bars", "stops", "other", "lines_per_word",
    "distinct_words", "top_word", "distinct_triples", "marked_words", "repeats_in_row",
]
#: Byte classes: 0 others, 1 lower case, 2 upper case, 3 digits, 4 symbol marks, 5 exclamation and question marks, 6 bars, 7 stops and commas, 8 line ends, 9 other white space, 10 the first byte of a longer character, 11 its other bytes.
_KIND = np.zeros(256, np.int64)
_KIND[97:123], _KIND[65:91], _KIND[48:58] = 1, 2, 3
_KIND[list(b"#$%&*+<=>@^_`~\\/")] = 4
_KIND[list(b"!?")] = 5
_KIND[list(b"|")] = 6
_KIND[list(b".,;:")] = 7
_KIND[list(b"\n\r")] = 8
_KIND[list(b" \t\x0b\x0c")] = 9
_KIND[192:], _KIND[128:192] = 10, 11


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(column), len(FEATURES)), np.float32)
    for lo, hi, words in K.texts(column):
        n = hi - lo
        length = np.diff(words.byte_off)
        owner = np.repeat(np.arange(n), length)
        kind = _KIND[words.data]
        count = np.bincount(owner * 12 + kind, minlength=12 * n).reshape(n, 12).astype(np.float64)
        chars = np.maximum(length - count[:, 11], 0)
        n_words = np.diff(words.off)
        some, solid = np.maximum(n_words, 1), np.maximum(chars - count[:, 8] - count[:, 9], 1)
        size = words.end - words.start
        marked = np.bitwise_or(kind[words.end - 1] == 4, kind[words.end - 1] == 5) if len(size) else np.zeros(0, bool)
        same = np.zeros(len(size), bool)
        same[1:] = words.hash[1:] == words.hash[:-1]
        of = np.repeat(np.arange(n), n_words)
        triples, off = K.shingle_hashes(words, 3)
        distinct, top, three = np.ones(n), np.zeros(n), np.ones(n)
        longest = np.zeros(n)
        for i in np.flatnonzero(n_words):
            a, b = words.off[i], words.off[i + 1]
            s = np.sort(words.hash[a:b])
            cut = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True])))
            distinct[i], top[i] = (len(cut) - 1) / (b - a), np.diff(cut).max() / (b - a)
            three[i] = len(K.unique_sorted(triples[off[i] : off[i + 1]])) / max(1, off[i + 1] - off[i])
            longest[i] = size[a:b].max()
        out[lo:hi] = np.stack([
            np.log1p(chars), np.log1p(n_words), (solid / some), np.minimum(longest, 200), count[:, 2] / solid, count[:, 3] / solid, count[:, 4] / solid, count[:, 5] / solid,
            count[:, 6] / solid, count[:, 7] / solid, count[:, 0] / solid, count[:, 8] / some, distinct, top, three,
            np.bincount(of, marked, n) / some, np.bincount(of, same, n) / some], axis=1)
    return out


def _cut(weight: np.ndarray, slope: np.ndarray, least: float) -> tuple[float, int]:
    """The best place to cut a row of bins in two: (gain, first bin of the right side)."""
    w, s = np.cumsum(weight), np.cumsum(slope)
    wr, sr = w[-1] - w[:-1], s[-1] - s[:-1]
    w, s, total = w[:-1], s[:-1], s[-1] ** 2 / (w[-1] + 1.0)
    gain = np.where((w >= least) & (wr >= least), s**2 / (w + 1.0) + sr**2 / (wr + 1.0) - total, -1.0)
    at = int(np.argmax(gain)) if len(gain) else -1
    return (float(gain[at]), at + 1) if at >= 0 else (-1.0, 0)


def shallow_tree(weight: np.ndarray, slope: np.ndarray, least: float = 2.0) -> np.ndarray:
    """A regression tree of at most four leaves over ordered bins: its value for each bin."""
    spans = [(0, len(weight))]
    for _ in range(2):
        parts = []
        for a, b in spans:
            gain, at = _cut(weight[a:b], slope[a:b], least) if b - a > 1 else (-1.0, 0)
            parts += [(a, a + at), (a + at, b)] if gain > 1e-9 else [(a, b)]
        spans = parts
    out = np.zeros(len(weight))
    for a, b in spans:
        out[a:b] = slope[a:b].sum() / (weight[a:b].sum() + 1.0)
    return out


class AdditiveModel:
    """Lookup tables per feature and per chosen pair of features."""

    def __init__(self, bins: int = 32, coarse: int = 6, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.1):
        self.bins, self.coarse, self.rounds, self.pair_rounds, self.n_pairs, self.rate = bins, coarse, rounds, pair_rounds, pairs, rate

    def _edges(self, x: np.ndarray, n: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1])) for c in x.T]

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        x = x.astype(np.float64)
        n, wide = x.shape
        ones = float(y.sum())
        self.pairs: list[tuple[int, int]] = []
        self.edges = self._edges(x, self.bins) if n else [np.zeros(0)] * wide
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.coarse_edges, self.pair_tables = [np.zeros(0)] * wide, []
        share = (ones + 1) / (n + 2) if n else 1 - 1e-9
        self.base = float(np.log(share / (1 - share)))
        if ones in (0.0, float(n)):
            return self
        at = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]
        score = np.full(n, self.base)

        def step(index: np.ndarray, size: int, tree) -> np.ndarray:
            p = 1 / (1 + np.exp(-score))
            value = self.rate * tree(np.bincount(index, p * (1 - p), size), np.bincount(index, y - p, size))
            score[:] += value[index]
            return value

        for _ in range(self.rounds):
            for j in range(wide):
                self.tables[j] += step(at[j], len(self.tables[j]), shallow_tree)
        self.coarse_edges = self._edges(x, self.coarse)
        rough = [np.searchsorted(e, c, "right") for e, c in zip(self.coarse_edges, x.T, strict=True)]
        width = [len(e) + 1 for e in self.coarse_edges]
        p = 1 / (1 + np.exp(-score))
        gains = []
        for a in range(wide):
            for b in range(a + 1, wide):
                w = np.bincount(rough[a] * width[b] + rough[b], p * (1 - p), width[a] * width[b])
                s = np.bincount(rough[a] * width[b] + rough[b], y - p, width[a] * width[b])
                gains.append((-float((s**2 / (w + 1.0)).sum()), a, b))
        for _, a, b in sorted(gains)[: self.n_pairs]:
            self.pairs.append((a, b))
            self.pair_tables.append(np.zeros(width[a] * width[b]))
        for _ in range(self.pair_rounds):
            for t, (a, b) in enumerate(self.pairs):

                def tree(w, s, shape=(width[a], width[b])):
                    w, s = w.reshape(shape), s.reshape(shape)
                    best, rows = _cut(w.sum(1), s.sum(1), 2.0)
                    out = np.zeros(shape)
                    for part in (slice(0, rows), slice(rows, None)) if best > 1e-9 else (slice(None),):
                        out[part] = shallow_tree(w[part].sum(0), s[part].sum(0))
                    return out.ravel()

                self.pair_tables[t] += step(rough[a] * width[b] + rough[b], width[a] * width[b], tree)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        total = np.full(len(x), self.base)
        for j, (e, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(e, x[:, j], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            ea, eb = self.coarse_edges[a], self.coarse_edges[b]
            total += table[np.searchsorted(ea, x[:, a], "right") * (len(eb) + 1) + np.searchsorted(eb, x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def _feature_rows(batches):
    for b in batches:
        x = features(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], ["doc_id", "x"])


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def feature_table(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(rows.mapInArrow(_feature_rows, "doc_id long, x array<float>"), "features")


def train(table: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> AdditiveModel:
    """table(doc_id, x), labels(doc_id, quality) -> a model of the bounded sample."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).where("y = y2").select("doc_id", "y")
    sample = table.where(~_held_out()).join(marks, "doc_id").orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(most).toArrow().sort_by("doc_id")
    y = (sample.column("y").to_numpy() > 0).astype(np.float64)
    x = np.array(sample.column("x").to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, sample.column("doc_id").to_numpy()))
    return AdditiveModel().fit(x[order], y[order])


def _scored(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            x = np.array(b.column("x").values.to_numpy()).reshape(b.num_rows, len(FEATURES)) if b.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MOST_LABELLED) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, held_out, score, predicted for every row of docs."""
    table = feature_table(docs)
    shared = docs.sparkSession.sparkContext.broadcast(train(table, labels, most))
    out = table.mapInArrow(_scored(shared), "doc_id long, score double")
    return out.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _kept(shared, threshold):
    def run(batches):
        model = shared.value
        for b in batches:
            yield b.filter(pa.array(model.score(features(b.column("text"))) >= threshold))

    return run


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MOST_LABELLED) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(feature_table(docs), labels, most))
    return docs.mapInArrow(_kept(shared, threshold), docs.schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
