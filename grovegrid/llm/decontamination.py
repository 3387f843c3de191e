"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

An item of q distinct k-word shingles is found in a document that holds at least percent % of them.
Items are partitioned by q: of each, the sketch keeps the q - ceil(q * percent / 100) + 1 smallest
shingle hashes (a bottom-m MinHash whose m follows the size). A document that holds enough of the
item's shingles misses at most q - ceil(...) of them, hence holds one of the sketch: nothing is missed,
however short the item and long the document. Items of q from 2^b to 2^(b+1) - 1 are a partition with
an index of its own: the larger its items, the smaller the share of the hash range that its sketches
take up. Documents are streamed past the partitions; in each, a document's shingles above the
partition's largest sketch value are skipped, and so are documents with fewer shingles than an item of
that size needs. Each pair found is verified on the words themselves. Items are taken in blocks of bounded size, each broadcast to one pass over the documents.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. A text of fewer than k words is one shingle; a text
without words (or null) is never found and contains nothing. Repeated rows are each judged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .storage import prepare

#: Bytes of item texts in one broadcast block.
BLOCK_BYTES = 16 << 20


def _shingle_bytes(words: K.Words, text: int, k: int, at: int) -> bytes:
    """The shingle at a position of a text, its words parted by one space."""
    lo, hi = int(words.off[text]), int(words.off[text + 1])
    first = lo + at
    return b" ".join(K.LOWER[words.data[words.start[j] : words.end[j]]].tobytes() for j in range(first, min(first + k, hi)))


class Partition:
    """The sketches of the items of a band of sizes."""

    def __init__(self, keys: list[np.ndarray], owners: list[np.ndarray], need: list[int]):
        keys, owners, need = np.concatenate(keys), np.concatenate(owners), np.repeat(need, [len(k) for k in keys])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners, self.need = keys[order], owners[order], need[order]
        self.top, self.least = self.keys[-1], int(self.need.min())

    def pairs(self, h: np.ndarray, doc: np.ndarray, size: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) for hashes h of texts doc, whose numbers of shingles are in size, that meet a sketch."""
        near = (h <= self.top) & (size[doc] >= self.least)
        h, doc = h[near], doc[near]
        lo, hi = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
        found = set()
        for d, a, b in zip(doc[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            found.update((d, o) for o, n in zip(self.owners[a:b].tolist(), self.need[a:b].tolist(), strict=True) if size[d] >= n)
        return found


class Items:
    """Partitions by size of a block of items."""

    def __init__(self, rows: list[tuple], k: int, percent: int):
        self.k, self.percent = k, percent
        self.ids, self.sets, self.known = [], [], []
        bands: dict[int, tuple[list, list, list]] = {}
        for _, _, words in K.texts(pa.array([t for _, t in rows], pa.string())):
            h, off = K.shingle_hashes(words, k)
            for i in range(len(off) - 1):
                mine = h[off[i] : off[i + 1]]
                s, first = np.unique(mine, return_index=True)
                n, q = len(self.ids), len(s)
                self.ids.append(rows[n][0])
                self.sets.append(s)
                self.known.append({_shingle_bytes(words, i, k, int(j)) for j in first})
                if q:
                    need = -(-q * percent // 100)
                    keys, owners, needs = bands.setdefault(q.bit_length(), ([], [], []))
                    keys.append(s[: q - need + 1])
                    owners.append(np.full(len(keys[-1]), n))
                    needs.append(need)
        self.partitions = [Partition(*bands[b]) for b in sorted(bands)]
        self.filter = np.zeros(1 << 20, bool)
        for p in self.partitions:
            self.filter[(p.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def search(self, words: K.Words):
        """(text, item, shingles shared) for the pairs with enough of the item's shingles."""
        h, off = K.shingle_hashes(words, self.k)
        if not self.partitions or not len(h):
            return
        at = np.flatnonzero(self.filter[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        doc, size = np.searchsorted(off, at, "right") - 1, np.diff(off)
        pairs = sorted(set().union(*(p.pairs(h[at], doc, size) for p in self.partitions)))
        for d, item in pairs:
            mine = h[off[d] : off[d + 1]]
            spot = np.searchsorted(self.sets[item], mine)
            spot[spot == len(self.sets[item])] = 0
            equal = np.flatnonzero(self.sets[item][spot] == mine)
            _, first = np.unique(mine[equal], return_index=True)
            shared = len(self.known[item] & {_shingle_bytes(words, d, self.k, int(j)) for j in equal[first]})
            if 100 * shared >= self.percent * len(self.known[item]):
                yield d, item, shared


def item_blocks(benchmark: DataFrame, k: int, percent: int):
    """Sketches of blocks of benchmark(item_id, text), each of about BLOCK_BYTES of text."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for i in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else rows
        yield Items(sorted(map(tuple, block.collect()), key=lambda r: (r[0] is None, r[0], r[1] or "")), k, percent)


def _hits(shared):
    def run(batches):
        items = shared.value
        for b in batches:
            docs, out = b.column("doc_id"), []
            for lo, _, words in K.texts(b.column("text")):
                out += [(lo + d, items.ids[i], len(items.known[i]), n) for d, i, n in items.search(words)]
            row, item, size, n = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([docs.take(pa.array(row, pa.int64())), pa.array(item, pa.int64()), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "item_id", "n_item", "n_shared"])

    return run


def _clean(shared):
    def run(batches):
        items = shared.value
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for lo, _, words in K.texts(b.column("text")):
                keep[[lo + d for d, _, _ in items.search(words)]] = False
            yield b.filter(pa.array(keep))

    return run


def contained(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_item, n_shared for every document and item it contains, by rows."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for items in item_blocks(benchmark, k, percent):
        hits = rows.mapInArrow(_hits(spark.sparkContext.broadcast(items)), "doc_id long, item_id long, n_item long, n_shared long")
        out = hits if out is None else out.unionByName(hits)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that contain no item, with all their columns."""
    spark = docs.sparkSession
    prepare(spark)
    for items in item_blocks(benchmark, k, percent):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(items)), docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (
  SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (
  SELECT DISTINCT kind, id, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT kind, id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'b' GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, n.n AS n_item, count(*) AS n_shared
FROM s d JOIN s b ON d.g = b.g JOIN n ON n.id = b.id
WHERE d.kind = 'd' AND b.kind = 'b' GROUP BY d.id, b.id, n.n HAVING 100 * count(*) >= 80 * n.n
"""
