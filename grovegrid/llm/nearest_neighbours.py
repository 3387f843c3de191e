"""Approximate maximum inner product search with score-aware anisotropic quantisation.

Vectors are cut into subspaces of `width` components, each with 16 centres (four bits). The error of a
vector counts `eta` times along the vector itself, since that part changes the large inner products,
and once across it; centres are fitted and codes chosen by coordinate descent on that loss. A query's
inner products with all centres form a table per subspace; scans add up table entries, and of each block
of rows the best SHARE, at most CANDIDATES (but twice `top` at least), are ranked again by exact inner
products of the original vectors in double precision.

Centres are fitted on a bounded sample (SAMPLE rows by hash of vec_id); every row is encoded and
scanned. Rows are packed to blocks and queries to chunks, which meet in one equi-join on groups of blocks, so
that neither the plan nor the driver grows with the queries. It is a sorted merge, never a broadcast: the queries are
repeated for each group, which the planner does not count. A task holds the blocks of one group (GROUP of them, HELD bytes)
while the chunks stream by, so that what is found for a chunk is merged over the group. Vectors that are null, zero
or hold null or non-finite components take no part, nor do those of another than the most common
length. Equal vectors within a block of rows are scanned once, and ties go to the smaller vec_id. Rows
without a vec_id take no part; rows that repeat both columns count once; of several vectors under the vec_id of a
query the smallest, component by component, is asked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import arrow_rows, materialize, prepare, release

SAMPLE = 8192
#: Rows that are scanned at once, queries that are asked at once, and blocks in a group where there are many.
BLOCK, CHUNK, GROUP = 4096, 1024, 64
#: Groups that there are at least, blocks permitting; bytes of a group, which a task holds; bytes of a row group of blocks.
GROUPS, HELD, ROW_GROUP = 64, 72 << 20, 16 << 20
#: The share of a block's rows that is ranked exactly for a query, and the most rows of it.
SHARE, CANDIDATES = 0.05, 100


class Quantiser:
    def __init__(self, width: int = 2, threshold: float = 0.2, sweeps: int = 3, rounds: int = 8):
        self.width, self.threshold, self.sweeps, self.rounds = width, threshold, sweeps, rounds

    def _padded(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float32)
        extra = -x.shape[1] % self.width
        return np.pad(x, ((0, 0), (0, extra))).reshape(len(x), -1, self.width)

    def fit(self, sample: np.ndarray) -> Quantiser:
        x = self._padded(sample)
        n, parts, _ = x.shape
        t = self.threshold**2
        self.eta = max(1.0, (sample.shape[1] - 1) * t / (1 - t)) if sample.shape[1] > 1 else 1.0
        rng = np.random.default_rng(7)
        self.centres = np.zeros((parts, 16, self.width), np.float32)
        if not n:
            return self
        for m in range(parts):
            self.centres[m] = x[rng.integers(0, n, 16), m] if n else 0
        codes = self.encode(sample)
        unit = x / np.linalg.norm(x.reshape(n, -1), axis=1)[:, None, None]
        for _ in range(self.rounds):
            along = np.einsum("nmd,nmd->nm", x - self._decoded(codes), unit)
            total = along.sum(1)
            for m in range(parts):
                u, v = unit[:, m].astype(np.float64), x[:, m].astype(np.float64)
                rest = total - along[:, m]
                want = v + (self.eta - 1) * u * (rest + np.einsum("nd,nd->n", v, u))[:, None]
                for c in range(16):
                    mine = codes[:, m] == c
                    if mine.any():
                        a = mine.sum() * np.eye(self.width) + (self.eta - 1) * u[mine].T @ u[mine]
                        self.centres[m, c] = np.linalg.solve(a, want[mine].sum(0))
                    else:
                        self.centres[m, c] = x[rng.integers(0, n), m]
                new = np.einsum("nd,nd->n", x[:, m] - self.centres[m][codes[:, m]], unit[:, m])
                total += new - along[:, m]
                along[:, m] = new
            codes = self.encode(sample)
        return self

    def _decoded(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(codes.shape[1]), codes]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Four-bit codes (one in each byte) by coordinate descent on the anisotropic loss."""
        x = self._padded(vectors)
        n, parts, _ = x.shape
        if not n:
            return np.zeros((0, parts), np.uint8)
        unit = x / np.maximum(np.linalg.norm(x.reshape(n, -1), axis=1), 1e-30)[:, None, None]
        plain = np.empty((n, parts, 16), np.float32)
        along = np.empty((n, parts, 16), np.float32)
        for m in range(parts):
            c = self.centres[m]
            plain[:, m] = (x[:, m] ** 2).sum(1)[:, None] - 2 * x[:, m] @ c.T + (c**2).sum(1)[None]
            along[:, m] = np.einsum("nd,nd->n", x[:, m], unit[:, m])[:, None] - unit[:, m] @ c.T
        codes = plain.argmin(2)
        rows = np.arange(n)
        total = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(self.sweeps):
            for m in range(parts):
                rest = total - along[rows, m, codes[:, m]]
                codes[:, m] = (plain[:, m] + (self.eta - 1) * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                total = rest + along[rows, m, codes[:, m]]
        return codes.astype(np.uint8)

    def packed(self, vectors: np.ndarray) -> np.ndarray:
        """Codes of two subspaces to a byte."""
        codes = self.encode(vectors)
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return codes[:, ::2] | codes[:, 1::2] << 4

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and pair of subspaces, 256 sums of two table entries."""
        q = self._padded(queries)
        t = np.einsum("qmd,mcd->qmc", q, self.centres)
        t = np.pad(t, ((0, 0), (0, t.shape[1] % 2), (0, 0)))
        return (t[:, ::2, None, :] + t[:, 1::2, :, None]).reshape(len(q), t.shape[1] // 2, 256)


def search_block(model: Quantiser, ids, vectors, packed, q_ids, queries, top: int, candidates: int):
    """(query, vec_id, score) of the best rows of one block for each query, its own id left out."""
    order = np.lexsort((ids,))
    ids, vectors, packed = ids[order], vectors[order], packed[order]
    _, first, group = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
    members = np.argsort(group, kind="stable")
    begin = np.searchsorted(group[members], np.arange(len(first) + 1))
    codes, wide = np.ascontiguousarray(packed[first].T), vectors[first].astype(np.float64)
    tables = model.tables(queries).astype(np.float32)
    out_q, out_i, out_s = [], [], []
    take = min(candidates, len(first))
    if not len(first):
        return [np.zeros(0)] * 3
    for j, qid in enumerate(q_ids.tolist()):
        if j % 64 == 0:
            asked = tables[j : j + 64]
            scores = np.take(asked[:, 0], codes[0], axis=1)
            for m in range(1, len(codes)):
                scores += np.take(asked[:, m], codes[m], axis=1)
            bests = np.argpartition(scores, len(first) - take, axis=1)[:, len(first) - take :] if take < len(first) else np.broadcast_to(np.arange(len(first)), scores.shape)
            exacts = np.einsum("qcd,qd->qc", wide[bests], queries[j : j + 64].astype(np.float64))
        best, exact = bests[j % 64], exacts[j % 64]
        rank = np.argsort(-exact, kind="stable")[: top + 1]
        got_i, got_s = [], []
        for g, s in zip(best[rank].tolist(), exact[rank].tolist(), strict=True):
            mine = ids[members[begin[g] : min(begin[g + 1], begin[g] + top + 1)]]
            got_i.append(mine[mine != qid])
            got_s.append(np.full(len(got_i[-1]), s))
        i, s = np.concatenate(got_i), np.concatenate(got_s)
        rank = np.lexsort((i, -s))[:top]
        out_q.append(np.full(len(rank), qid))
        out_i.append(i[rank])
        out_s.append(s[rank])
    return [np.concatenate(x) if x else np.zeros(0) for x in (out_q, out_i, out_s)]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dim)


def _packed(dim: int, size: int, shared=None):
    """Rows (vec_id, v) -> rows of up to `size` of them: ids, vectors and, with a model, codes, as bytes."""

    def run(batches):
        held, rows = [], 0

        def pack():
            ids, vectors = (np.concatenate(x) for x in zip(*held, strict=True))
            codes = shared.value.packed(vectors).tobytes() if shared else b""
            cols = [pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(vectors).tobytes()], pa.binary()), pa.array([codes], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["ids", "vectors", "codes"])

        for b in batches:
            lo = 0
            while lo < b.num_rows:
                part = b.slice(lo, size - rows)
                held.append((part.column("vec_id").to_numpy(), _matrix(part.column("v"), dim)))
                lo, rows = lo + part.num_rows, rows + part.num_rows
                if rows == size:
                    yield pack()
                    held, rows = [], 0
        if rows:
            yield pack()

    return run


def _best(found: list, top: int) -> list:
    """The best `top` rows of each query among several results of search_block."""
    q, i, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.searchsorted(q, q, "left")
    keep = np.arange(len(q)) - first < top
    return [q[keep], i[keep], s[keep]]


def _scan(shared, dim: int, kind: str, top: int):
    """Rows of a block beside a chunk of queries -> the best of the block for each query; results of one chunk are merged."""

    def run(batches):
        found: dict = {}

        def merged():
            for parts in found.values():
                q, i, s = _best(parts, top)
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(i.astype(np.int64)), pa.array(s.astype(np.float64))], ["query_id", "vec_id", "score"])

        for b in batches:
            for ids, vectors, codes, q_ids, queries in zip(*(b.column(c).to_pylist() for c in ("ids", "vectors", "codes", "q_ids", "q_vectors")), strict=True):
                ids = np.frombuffer(ids, np.int64)
                vectors, queries = (np.frombuffer(x, kind).reshape(-1, dim) for x in (vectors, queries))
                take = max(2 * top, min(CANDIDATES, int(SHARE * len(ids))))
                parts = found.setdefault(q_ids, [])
                parts.append(search_block(shared.value, ids, vectors, np.frombuffer(codes, np.uint8).reshape(len(ids), -1), np.frombuffer(q_ids, np.int64), queries, top, take))
                if len(parts) >= 16:
                    parts[:] = [_best(parts, top)]
                if len(found) > 8:
                    yield from merged()
                    found.clear()
        yield from merged()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20, sample: int = SAMPLE) -> DataFrame:
    """vectors(vec_id, embedding), queries(vec_id, embedding) -> query_id, rank, vec_id, score: the rows found with
    the largest inner products, the query's own vec_id left out."""
    spark = vectors.sparkSession
    prepare(spark, 1000)
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"

    def valid(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast(f"array<{kind}>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & fine)

    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = valid(vectors)
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return none
    dim = sizes["d"]
    rows = rows.where(F.size("v") == dim)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().combine_chunks()
    model = spark.sparkContext.broadcast(Quantiser().fit(_matrix(some.column("v").combine_chunks(), dim).astype(np.float32)))
    packed = "ids binary, vectors binary, codes binary"
    # A block or a chunk is a row of its bytes: 1 to 2 MB for BLOCK vectors of 64 components.
    index = materialize(rows.mapInArrow(_packed(dim, BLOCK, model), packed), "index", ROW_GROUP, wide=True)
    blocks = index.count()
    most = max(1, min(GROUP, HELD // (BLOCK * dim * (4 if kind == "float" else 8))))
    groups = max(1, min(blocks, GROUPS), -(-blocks // most))
    asked = valid(queries).where(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialize(asked.mapInArrow(_packed(dim, CHUNK), packed), "asked", ROW_GROUP, wide=True).select(F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    # A merge streams its left side and holds the rows of a key on its right.
    pairs = asked.select("q_ids", "q_vectors", group).hint("merge").join(index.withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")), "group")
    found = pairs.drop("group").mapInArrow(_scan(model, dim, "f4" if kind == "float" else "f8", top), "query_id long, vec_id long, score double")
    with arrow_rows(spark, 4):
        found = materialize(found.distinct(), "found")
    release(index)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select("query_id", "rank", "vec_id", "score")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
