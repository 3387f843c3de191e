"""Bounded-space online packing of documents into token windows.

Each partition keeps a fixed number of open windows. A document's ids are cut into whole windows and
a rest; the rest goes to the open window with the least room that holds it. Where none does and no
further window may open, the fullest one is filled up with the head of the rest and emitted. What is
open at the end of a partition is joined the same way, so that a partition leaves one unfilled window
at most; the leftovers of groups of partitions are then merged, so that one window in many thousands
is padded. Nothing is shuffled but those leftovers.

Null texts are empty; every document has at least its end id. Null and repeated doc_ids are packed
like others; other columns of docs are not read, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import materialize, prepare
from .subwords import text_ids

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Partitions whose leftovers are merged in one task: at most this many windows of ids.
MERGED = 256


class Packer:
    """Open windows of one partition. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, open_windows: int, first_id: int):
        self.window, self.most, self.next_id = window, open_windows, first_id
        self.room: list[tuple[int, int]] = []  # (room, key) of the open windows, sorted
        self.open: dict[int, list] = {}
        self.made = 0
        self.out: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def add(self, doc, ids: np.ndarray, total: int | None = None, start: int = 0) -> None:
        total, end, base = len(ids) if total is None else total, len(ids), start
        at = 0
        while end - at >= self.window:
            self.emit([(doc, base + at, ids[at : at + self.window], total)])
            at += self.window
        while at < end:
            need = end - at
            i = bisect_left(self.room, (need, -1))
            if i < len(self.room):
                room, key = self.room.pop(i)
                self.open[key].append((doc, base + at, ids[at:end], total))
                self._keep(room - need, key)
                return
            if len(self.room) < self.most:
                self.made += 1
                self.open[self.made] = [(doc, base + at, ids[at:end], total)]
                self._keep(self.window - need, self.made)
                return
            room, key = self.room.pop(0)
            self.open[key].append((doc, base + at, ids[at : at + room], total))
            at += room
            self._keep(0, key)

    def _keep(self, room: int, key: int) -> None:
        if room:
            insort(self.room, (room, key))
        else:
            self.emit(self.open.pop(key))

    def close(self) -> list:
        """Join the open windows; the pieces of the one that stays unfilled."""
        rest = [p for _, key in self.room for p in self.open[key]]
        self.room, self.open, self.most = [], {}, 1
        for doc, start, ids, total in rest:
            self.add(doc, ids, total, start)
        return [p for pieces in self.open.values() for p in pieces]

    def take(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])


def _pack(path: str, window: int, open_windows: int, end_id: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        packer = Packer(window, open_windows, part << 32)
        for b in batches:
            docs = b.column("doc_id").to_pylist()
            for lo, hi, ids, off in text_ids(b.column("text"), path, end_id):
                bounds = off.tolist()
                for i in range(hi - lo):
                    packer.add(docs[lo + i], ids[bounds[i] : bounds[i + 1]])
                if packer.out:
                    yield packer.take()
        left = packer.close()
        if packer.out:
            yield packer.take()
        packer.next_id = -1 - part  # leftovers: the window of this partition that is not full
        if left:
            packer.emit(left)
            yield packer.take()

    return run


def _merge(window: int):
    def run(batches):
        packer, group = None, None
        for b in batches:
            for doc, start, ids, total, g in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens", "grp")), strict=True):
                if g != group:
                    if packer is not None:
                        for pieces in packer.open.values():
                            packer.emit(pieces)
                        yield packer.take()
                    packer, group = Packer(window, 1, (1 << 60) + (g << 32)), g
                packer.add(doc, np.frombuffer(ids, np.uint32), total, start)
        if packer is not None:
            for pieces in packer.open.values():
                packer.emit(pieces)
            yield packer.take()

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, open_windows: int = 64, end_id: int = 2) -> DataFrame:
    """docs(doc_id, text) -> one row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens,
    sequence_id, offset. tokenizer is the path of a tokenizer file, the same on all machines."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = materialize(rows.mapInArrow(_pack(tokenizer, window, open_windows, end_id), SCHEMA), "pieces")
    left = pieces.where("sequence_id < 0").withColumn("part", -1 - F.col("sequence_id")).withColumn("grp", F.floor(F.col("part") / MERGED))
    merged = left.repartition("grp").sortWithinPartitions("grp", "part", "offset").mapInArrow(_merge(window), SCHEMA)
    return pieces.where("sequence_id >= 0").unionByName(merged)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
