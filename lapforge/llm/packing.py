"""Best-fit decreasing packing of all documents into sequences of a fixed length.

Pieces of one length are alike, so the packing is planned over the number of pieces of each length:
open sequences with equal room are one entry, and a segment tree over the possible rooms finds the
tightest one that fits in logarithmic time. The plan's size depends on the sequence length alone,
and it places exactly what best-fit decreasing over all pieces, one at a time, would place. Tasks
then look their pieces up in it by length and by rank within the length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common
from .tokens import encoder

#: Shares that each length's pieces are counted in, so that a frequent length is ranked by many tasks.
SHARES = 64


class RoomTree:
    """Segment tree over rooms 0..capacity: which of them have open sequences."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.some = np.zeros(2 * self.size, bool)

    def put(self, room: int, some: bool) -> None:
        i = room + self.size
        self.some[i] = some
        i >>= 1
        while i:
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]
            i >>= 1

    def tightest(self, length: int) -> int:
        """The smallest room of at least ``length`` with an open sequence, or -1."""
        i = length + self.size
        if self.some[i]:
            return length
        while i > 1:
            if not i & 1 and self.some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.some[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


@dataclass
class Plan:
    """Runs of placements. In run r pieces first_rank.. of a length go ``each`` to a sequence, from sequence ``first_seq``, at ``offset``."""

    length: np.ndarray
    first_rank: np.ndarray
    first_seq: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int


def best_fit_plan(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over pieces given as length -> number. Length-0 pieces are not placed."""
    tree, open_runs, rows, sequences = RoomTree(capacity), {}, [], 0

    def keep(room: int, first: int, n: int) -> None:
        if n and room:
            if not open_runs.setdefault(room, []):
                tree.put(room, True)
            open_runs[room].append((first, n))

    for length in sorted((k for k, v in counts.items() if k > 0 and v > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"a piece of {length} exceeds {capacity}")
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                first, n = open_runs[room].pop()
                if not open_runs[room]:
                    tree.put(room, False)
            # a sequence that took one piece is the tightest for the next while it fits
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, first, each, capacity - room))
                keep(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:
                rows.append((length, rank, first + full, left, capacity - room))
                keep(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            keep(room, first + full, n - full)
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences)


def place(plan: Plan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks."""
    key = lambda n, r: (n.astype(np.int64) << 44) | r  # noqa: E731  ranks stay below 2**44
    runs = key(plan.length, plan.first_rank)
    order = np.argsort(runs)
    run = order[np.searchsorted(runs[order], key(length, rank), side="right") - 1]
    k = rank - plan.first_rank[run]
    return plan.first_seq[run] + k // plan.each[run], plan.offset[run] + k % plan.each[run] * length


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, share int"


def cut_into_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """Encode whole texts, append ``end_id`` and cut at every ``capacity`` ids. One row for each piece."""

    @common.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        for batch in batches:
            ids, at = coder.encode(batch.column("text"))
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for d, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                own = np.append(ids[a:b].astype("<u4"), np.uint32(end_id))
                for k, s in enumerate(range(0, len(own), capacity)):
                    crc = zlib.crc32(own[s : s + capacity].tobytes())
                    for to, x in zip(rows, (d, k, s, min(capacity, len(own) - s), crc, zlib.crc32(b"%d-%d-%d" % (d or 0, k, crc)) % SHARES)):
                        to.append(x)
            yield pa.record_batch([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["doc_id", "piece", "start", "length", "ids_crc32", "share"])

    return docs.mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Best-fit decreasing packing of all documents.

    A document's ids are its whole text's and ``end_id``; only documents over ``capacity`` are cut,
    every ``capacity`` ids. Returns a row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id and offset. Within a sequence offsets run gapless from 0.

    Null text: empty, so one piece of length 1. Null and repeated ids are rows like others. An empty
    table gives an empty result. Other columns are not read.

    The driver holds the number of pieces of each length, at most ``capacity`` numbers, and the plan.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = common.materialize(cut_into_pieces(docs, tokenizer_path, end_id, capacity), "pieces")
    shares = pieces.groupBy("length", "share").count()
    plan = best_fit_plan({r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)

    # at most capacity * SHARES rows: ranks before each share of a length
    earlier = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    bases = shares.select("length", "share", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(within) - 1).join(F.broadcast(bases), ["length", "share"])
    rows = ranked.select("doc_id", "piece", "start", F.col("length").cast("long"), "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    held = docs.sparkSession.sparkContext.broadcast(plan)

    @common.tidy
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, offset = place(held.value, batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            keep = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.record_batch([*keep.columns, pa.array(seq, pa.int64()), pa.array(offset, pa.int64())], [*keep.schema.names, "sequence_id", "offset"])

    return rows.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    import public_tokenizers

    return pack_documents(common.documents(spark, sf_dir, common.ENCODE_BYTES), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)
