"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct k-word shingles (fewer than k words: the whole sequence as one;
no words, or a null text: the empty set, which links with nothing). Two documents link when
100 * |A & B| >= percent * |A | B|.

Each shingle flips one bit of a sketch, so the Hamming distance of two sketches is at most the size
of the symmetric difference. Sizes are cut into bands. Where a link's smaller set has a shingles, the larger
one has at most a * 100 / percent, and so has their union: the symmetric difference is at most
D = a * (100 - percent) / percent. So of D + 1 + spare blocks of the sketches for the smaller set's band at
least spare + 1 are equal (pigeonhole): the join key is a 64-bit hash of a block's bits. A set gives the keys of
its own band and of each lower one with a set that it can link with. A block that no shingle fell into says little.
A set with at most spare such blocks leaves them out, as one of its equal blocks has shingles then; this holds
for all but small sets. Any other set gives them too, each key joined by those of a second, independent sketch,
of which one block must be equal as well. No link is lost.

Equal sets are one class from the start, and one text of each class gives keys. They are dealt out once; a stream over
the sorted rows drops keys of a single class. Keys that many documents of a sample hold are dealt out in shares. Of the
keys with the same classes one is kept. Within a key, classes are compared by the Hamming distance of folded sketches,
and a spanning forest of those near enough is emitted, at most one row a class; its edges are verified exactly. Where
an edge fails, all near pairs of its keys that are still apart are verified. Keys with very many classes are dealt out
by pairs of blocks. Documents under a null doc_id get no links but to equal sets.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as K
from .components import components
from .storage import arrow_rows, materialize, prepare, release, sized

U = np.uint64


def band_edges(top: int = 1 << 40) -> list[int]:
    """Lower bounds of the size bands; each is at least 1.5 times the one before (from 2 on)."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, -(-out[-1] * 3 // 2)))
    return out


_EDGES = np.array(band_edges(), np.int64)


def block_count(band: int, percent: int) -> tuple[int, int]:
    """Blocks of the sketches for links whose smaller set is of this band, and how many of them are spare."""
    most = (int(_EDGES[band + 1]) - 1) * (100 - percent) // percent
    spare = most * (100 - percent) // 100
    return most + 1 + spare, spare


def _blocks(s: np.ndarray, count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted mixed values: each block's key (a Zobrist hash of its parity bits) and whether it is empty."""
    cut = np.searchsorted(s >> U(32), (np.arange(count + 1, dtype=np.uint64) << U(32)) // U(count))
    cut[-1] = len(s)
    flips = K.mix((s & U(0xFFFF)) + U((seed << 20) + (1 << 16)))
    run = np.concatenate((np.zeros(1, np.uint64), np.bitwise_xor.accumulate(flips)))
    return run[cut[1:]] ^ run[cut[:-1]], cut[1:] == cut[:-1]


def block_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The join keys of a set, given as sorted distinct hashes."""
    n = len(shingles)
    if not n:
        return np.zeros(0, np.uint64)
    band = int(np.searchsorted(_EDGES, n, "right")) - 1
    bands = [band]
    while bands[-1] > 0 and percent * n <= 100 * (int(_EDGES[bands[-1]]) - 1):
        bands.append(bands[-1] - 1)
    second, out = None, []
    for b in bands:
        count, spare = block_count(b, percent)
        value, empty = _blocks(shingles, count, 1)
        at = K.mix(np.arange(count, dtype=np.uint64) + U((b + 1) << 40))
        out.append(K.mix(value[~empty] ^ at[~empty]))
        if empty.sum() > spare:
            if second is None:
                second = np.sort(K.mix(shingles ^ U(0x5851F42D4C957F2D)))
            other, _ = _blocks(second, count, 2)
            pair = K.mix(other ^ K.mix(np.arange(count, dtype=np.uint64) + U((b + 1) << 41)))
            out += [K.mix(pair + e) for e in at[empty]]
    return np.concatenate(out)


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit hash of a set (0: empty)."""
    if not len(shingles):
        return 0
    total = np.add.reduce(K.mix(shingles ^ U(0x2545F4914F6CDD1D)), dtype=np.uint64, keepdims=True)
    return int(K.mix(total + U(len(shingles)))[0]) | 1


def _sets(column: pa.Array, k: int):
    for lo, hi, words in K.texts(column):
        h, off = K.shingle_hashes(words, k)
        for i in range(hi - lo):
            yield K.unique_sorted(h[off[i] : off[i + 1]])


def _sizes_of(k: int):
    def run(batches):
        for b in batches:
            found = [(len(s), class_of(s)) for s in _sets(b.column("text"), k)]
            n, cls = (np.array(x, np.uint64).view(np.int64) for x in (zip(*found, strict=True) if found else ([], [])))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), pa.array(n), pa.array(cls)], ["doc_id", "tkey", "n", "cls"])

    return run


def _keys_of(k: int, percent: int):
    def run(batches):
        for b in batches:
            cids, at = b.column("cid").to_numpy(), 0
            parts, owner, rows = [], [], 0
            for s in _sets(b.column("text"), k):
                parts.append(np.unique(block_keys(s, percent)).view(np.int64))
                owner.append(np.full(len(parts[-1]), cids[at]))
                rows, at = rows + len(parts[-1]), at + 1
                if rows >= 1 << 16 or at == len(cids):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(np.concatenate(owner))], ["key", "cid"])
                    parts, owner, rows = [], [], 0

    return run


def _shared():
    """Rows (key, salt, cid) sorted so -> (key, cid) of the keys with several cids, and of salted keys."""

    def run(batches):
        kept = [np.zeros(0, np.int64)] * 3
        held = False  # whether the kept row is of a key with another cid before
        for b in [*batches, None]:
            key, salt, cid = (np.concatenate((x, b.column(c).to_numpy())) if b is not None else x for x, c in zip(kept, ("key", "salt", "cid"), strict=True))
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            again = np.append(False, same & (cid[1:] == cid[:-1]))
            if again.any():
                key, salt, cid = key[~again], salt[~again], cid[~again]
                same = key[1:] == key[:-1]
            out = (np.append(held, same) | np.append(same, False)) | (salt > 0)
            stop = len(key) if b is None else len(key) - 1  # the last row waits for the next
            yield pa.RecordBatch.from_arrays([pa.array(key[:stop][out[:stop]]), pa.array(cid[:stop][out[:stop]])], ["key", "cid"])
            held = bool(same[-1]) if len(same) else held
            kept = [key[-1:], salt[-1:], cid[-1:]]

    return run


def fold(shingles: np.ndarray) -> bytes:
    """A parity sketch with at least twice as many bits as shingles, a power of two, 512 at least."""
    bits = max(512, 1 << int(2 * len(shingles)).bit_length())
    odd = np.bincount((K.mix(shingles + U(77)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _set_rows(k: int, exact: bool):
    """Rows (cid, text) -> (cid, n, sketch), or (cid, shingles)."""

    def run(batches):
        for b in batches:
            sets = list(_sets(b.column("text"), k))
            if exact:
                yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "shingles"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("cid"), pa.array([len(s) for s in sets], pa.int64()), pa.array([fold(s) for s in sets], pa.binary())], ["cid", "n", "sketch"])

    return run


def near_pairs(cls: list, n: np.ndarray, roots: list, sketches: list, percent: int, every: bool):
    """Pairs (two arrays at a time, some PAIRS of them) within one key that may link: a spanning forest of them over the roots, or every one across roots."""
    width = min(map(len, sketches))
    rows = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, width), axis=0) for x in sketches]).view(np.uint64)
    cls = np.array(cls, np.int64)
    groups: dict = {}
    for i, r in enumerate(roots):
        groups.setdefault(r, []).append(i)
    root = np.unique(np.array([x if x is not None else 0 for x in roots], np.int64), return_inverse=True)[1]

    def near(i: int, others: np.ndarray) -> np.ndarray:
        d = np.bitwise_count(rows[others] ^ rows[i]).sum(1)
        fits = (d <= (n[others] + n[i]) * (100 - percent) // (100 + percent)) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))
        return others[fits]

    one, two, held = [], [], 0
    if every:
        for i in range(len(cls)):
            rest = np.arange(i + 1, len(cls))
            two.append(near(i, rest[root[rest] != root[i]]))
            one.append(np.full(len(two[-1]), i))
            held += len(two[-1])
            if held >= PAIRS:
                yield cls[np.concatenate(one)], cls[np.concatenate(two)]
                one, two, held = [], [], 0
        if held:
            yield cls[np.concatenate(one)], cls[np.concatenate(two)]
        return
    left = np.ones(len(cls), bool)
    for start in range(len(cls)):
        if not left[start]:
            continue
        todo = groups[roots[start]][:]
        left[todo] = False
        while todo:
            i = todo.pop()
            others = np.flatnonzero(left)
            if not len(others):
                todo = []
                break
            for j in near(i, others).tolist():
                if left[j]:
                    one.append(i)
                    two.append(j)
                    same = groups[roots[j]]
                    left[same] = False
                    todo += same
    if one:
        yield cls[one], cls[two]


def _candidates(percent: int, every: bool):
    """Rows (grp, cid, n, root, sketch) sorted by grp -> pairs (a, b, grp). The rows of one group are held, but of its pairs, of
    which every one can be near, some PAIRS at a time."""

    def run(batches):
        held, group, out, rows = [], None, [], 0

        def pairs():
            if len(held) > 1:
                cls, n, roots, sketches = zip(*held, strict=True)
                for a, b in near_pairs(cls, np.array(n), roots, sketches, percent, every):
                    yield np.minimum(a, b), np.maximum(a, b), pa.repeat(group, len(a))

        def batch():
            cols = list(zip(*out, strict=True)) if out else [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [pa.array([], pa.string())]]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(cols[0])), pa.array(np.concatenate(cols[1])), pa.concat_arrays(cols[2])], ["a", "b", "grp"])

        for b in chain(batches, [None]):
            of = zip(*(b.column(c).to_pylist() for c in ("grp", "cid", "n", "root", "sketch")), strict=True) if b is not None else [(None,) * 5]
            for g, *row in of:
                if g != group:
                    for found in pairs():
                        out.append(found)
                        rows += len(found[0])
                        if rows >= PAIRS:
                            yield batch()
                            out, rows = [], 0
                    held, group = [], g
                held.append(row)
        yield batch()

    return run


def _linked(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for i, (xa, xb) in enumerate(zip(b.column("xa").to_pylist(), b.column("xb").to_pylist(), strict=True)):
                x, y = np.frombuffer(xa, np.uint64), np.frombuffer(xb, np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(keep, pa.int32())) for c in ("a", "b")], ["a", "b"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs(a, b) of classes that link, by the sets of their texts(cid, text)."""
    ends = materialize(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), "ends")
    sets = materialize(texts.join(sized(ends, ends.count()), "cid", "left_semi").mapInArrow(_set_rows(k, True), "cid long, shingles binary").dropDuplicates(["cid"]), "sets")
    one, two = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("xa")), sets.select(F.col("cid").alias("b"), F.col("shingles").alias("xb"))
    with arrow_rows(pairs.sparkSession, READ):
        links = materialize(pairs.join(one, "a").join(two, "b").select("a", "b", "xa", "xb").mapInArrow(_linked(percent), "a long, b long"), "links")
    release(ends, sets)
    return links


def _dealt(members: DataFrame, sizes: DataFrame, most: int = 4096) -> DataFrame:
    """members(key, cid) with a group name: the key, or for a key of more than `most` classes each pair of its blocks."""
    blocks = F.ceil(F.col("m") / F.lit(most // 2)).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    whole = F.array(F.col("key").cast("string"))
    parts = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.concat_ws("_", F.col("key").cast("string"), F.least(own, j).cast("string"), F.greatest(own, j).cast("string")))
    return members.join(sizes.select("key", "m"), "key").withColumn("grp", F.explode(F.when(F.col("m") > most, parts).otherwise(whole)))


#: Documents of a sample in which frequent keys are looked for, and the shares in which those of a SHARES-th of them are dealt out. A key
#: that the sample misses is dealt out whole, with the same result.
SAMPLE, SHARES = 16384, 64
#: Pairs of classes that a task holds before it emits them, about; rows of pairs with both sets that it reads together.
PAIRS, READ = 1 << 16, 100
#: Numbers of classes from here on stand for further texts under a doc_id that has several.
FURTHER = 1 << 62


def jaccard_classes(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tkey, n, cls) for each row of docs(doc_id, text), with tkey a hash of the text and cls one of its set; and for each class
    of a non-empty set (cls, doc_id, tkey, cid, root, component): its first row, its number, the component's first number and doc_id."""
    spark = docs.sparkSession
    prepare(spark)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))
    rows = materialize(texts.mapInArrow(_sizes_of(k), "doc_id long, tkey long, n long, cls long"), "sizes")
    full = rows.where("n > 0")
    first = full.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey")).alias("r")).select("cls", "r.doc_id", "r.tkey")
    order = first.groupBy("doc_id").agg(F.min("tkey").alias("low"), F.max("tkey").alias("high")).where("low <> high and doc_id is not null").select("doc_id", "low")
    several = materialize(order, "several")
    n_several = several.count()
    further = (F.xxhash64("doc_id", "tkey").bitwiseAND(F.lit(FURTHER - 1))).bitwiseOR(F.lit(FURTHER))
    cid = F.when(F.col("doc_id").isNull(), F.xxhash64("tkey").bitwiseAND(F.lit(FURTHER - 1)).bitwiseOR(F.lit(FURTHER))).when(F.col("low").isNull() | (F.col("low") == F.col("tkey")), F.col("doc_id")).otherwise(further)
    classes = materialize(first.join(sized(several, n_several), "doc_id", "left").select("cls", "doc_id", "tkey", cid.alias("cid")), "classes")
    n_classes = classes.count()
    known = classes.where("doc_id is not null")
    # Rows with the texts of no class's first row, a smaller table than the classes where few are copies.
    copies = materialize(full.where("doc_id is not null").select("doc_id", "tkey").distinct().join(known.select("doc_id", "tkey"), ["doc_id", "tkey"], "left_anti"), "copies")
    one = texts.where("doc_id is not null and text is not null").join(sized(copies, 2 * copies.count()), ["doc_id", "tkey"], "left_anti")
    one = one.join(sized(several, n_several), "doc_id", "left").select(cid.alias("cid"), "text")
    keys = one.mapInArrow(_keys_of(k, percent), "key long, cid long")
    every = max(1, n_classes // SAMPLE)
    some = one.where(F.pmod(F.xxhash64("cid"), F.lit(every)) == 0).mapInArrow(_keys_of(k, percent), "key long, cid long")
    often = materialize(some.groupBy("key").count().where(F.col("count") >= max(64, n_classes // every // SHARES)).select("key", F.lit(True).alias("often")), "often")
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("cid"), F.lit(SHARES)) + 1).otherwise(F.lit(0)).cast("long")
    dealt = keys.join(sized(often, often.count()), "key", "left").select("key", salt.alias("salt"), "cid")
    members = materialize(dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", "cid").mapInArrow(_shared(), "key long, cid long"), "members")
    release(often)
    # Of the keys with the same classes the smallest stays.
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("cid")).alias("s1"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("s2")).where("m > 1")
    sizes = materialize(sizes.groupBy("m", "s1", "s2").agg(F.min("key").alias("key")).select("key", "m"), "sizes")
    members, all_members = materialize(_dealt(members, sizes).select("grp", "cid"), "members"), members
    release(all_members)
    involved = materialize(members.select("cid").distinct(), "involved")
    sets = one.join(sized(involved, involved.count()), "cid", "left_semi").mapInArrow(_set_rows(k, False), "cid long, n long, sketch binary")
    sets = materialize(sets.dropDuplicates(["cid"]), "sketches")

    def candidates(rows: DataFrame, every: bool) -> DataFrame:
        full = rows.join(sets.select("cid", "n", "sketch"), "cid").select("grp", "cid", "n", "root", "sketch")
        return full.repartition("grp").sortWithinPartitions("grp", "n", "cid").mapInArrow(_candidates(percent, every), "a long, b long, grp string")

    tried = materialize(candidates(members.withColumn("root", F.col("cid")), False), "tried")
    pairs = materialize(tried.select("a", "b").distinct(), "pairs")
    links = verify(pairs, one, k, percent)
    roots = materialize(components(links), "roots")
    failed = tried.join(links, ["a", "b"], "left_anti").select("grp").distinct()
    again = members.join(failed, "grp", "left_semi").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    more = materialize(candidates(again, True).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "more")
    found = verify(more, one, k, percent)
    if not found.isEmpty():
        roots, old = materialize(components(links.unionByName(found)), "roots"), roots
        release(old)
    placed = classes.join(sized(roots, roots.count()), classes.cid == roots.node, "left").select("cls", "doc_id", "tkey", "cid", F.coalesce("root", "cid").alias("root"))
    # A number that stands for a further text is no doc_id; all others are.
    low = placed.where((F.col("cid") >= FURTHER) & F.col("doc_id").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("low"))
    low = materialize(low, "low")
    own = F.when(F.col("root") < FURTHER, F.col("root"))
    placed = placed.join(sized(low, low.count()), "root", "left").select("cls", "doc_id", "tkey", "cid", "root", F.least(own, "low").alias("component"))
    placed = materialize(placed, "placed")
    release(copies, several, classes, sizes, members, involved, sets, tried, pairs, links, more, found, roots, low)
    return rows, placed


def ngram_jaccard(docs: DataFrame, k: int = 5, percent: int = 80, sizes: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_shingles, component_id (with sizes, also component_size) for each row.

    component_id is the smallest doc_id that links reach, the row's own included (null only where a
    set's rows all have a null doc_id); equal non-empty sets are linked. Repeated rows are each
    returned. Other columns of docs are not read, whatever their names.
    """
    rows, classes = jaccard_classes(docs, k, percent)
    if sizes:
        own = rows.where("n > 0").groupBy("cls").agg(F.count(F.lit(1)).alias("size"))
        own = classes.join(own, "cls").select("root", "size").groupBy("root").agg(F.sum("size").alias("size"))
        classes = classes.join(own, "root")
    small = classes.select("cls", "component", *["size"] * sizes)
    out = rows.join(sized(small, classes.count()), "cls", "left")
    alone = F.col("n") == 0
    cols = [F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id")]
    if sizes:
        cols.append(F.when(alone, F.lit(1)).otherwise(F.col("size")).cast("long").alias("component_size"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), *cols)


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: of the class with the smallest doc_id the first row, as rows with a null doc_id come
    last. Rows that repeat a doc_id are told apart by their texts; documents without words all stay. All columns are kept."""
    rows, classes = jaccard_classes(docs, k, percent)
    kept = classes.where("cid = root").select("doc_id", "tkey")
    pairs = rows.where("n > 0").groupBy("doc_id", "tkey").agg(F.count(F.lit(1)).alias("c"))
    same = pairs.doc_id.eqNullSafe(kept.doc_id) & (pairs.tkey == kept.tkey)
    gone = materialize(pairs.join(kept, same, "left_anti").select("doc_id", "tkey"), "gone")
    twice = materialize(pairs.where("c > 1").join(kept, same, "left_semi").select("doc_id", "tkey"), "twice")

    def on(left: DataFrame, right: DataFrame):
        return left["doc_id"].cast("long").eqNullSafe(right["doc_id"]) & (F.xxhash64(left["text"].cast("string")) == right["tkey"])

    n_twice = 2 * twice.count()
    left = docs.join(sized(gone, 2 * gone.count()), on(docs, gone), "left_anti")
    if not n_twice:
        return left
    once, again = left.join(sized(twice, n_twice), on(left, twice), "left_anti"), left.join(sized(twice, n_twice), on(left, twice), "left_semi")
    return once.unionByName(again.dropDuplicates(["doc_id", "text"]))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i+2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(seen) AS c FROM r GROUP BY 1) m ON m.doc_id = d.doc_id
"""
