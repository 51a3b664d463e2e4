"""Token-ID / binary output: fixed-width bit packing with block offsets.

Every id takes the fewest bits that hold the vocabulary. A shard file is

    magic ``LFTK`` | version, bits, ids a block (u32 each) | documents, ids, blocks (u64 each)
    | doc_id of each document (i64), a byte each that is 1 for a null id, ids before each document (u64, one more)
    | byte offset of each block in the payload (u64, one more) | payload

with little-endian numbers. A block starts at a byte, holds a fixed number of ids (the last may hold
fewer) and unpacks in one vectorised step, so any id range needs the blocks that it touches alone:
a reader takes a shard's tables and then seeks to the blocks.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common
from .tokens import encoder, width

MAGIC, VERSION, BLOCK = b"LFTK", 1, 4096
#: ids of a shard file, at which the next document opens another; ids that are packed, and blocks that are read, at once.
SHARD_IDS, PACK_AT, READ_BLOCKS = 4 << 20, 1 << 16, 256


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids as ``bits`` bits each, least bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), PACK_AT):  # a multiple of eight ids fills whole bytes
        planes = (ids[at : at + PACK_AT].astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
        out.append(np.packbits(planes.astype(np.uint8), axis=None, bitorder="little").tobytes())
    return b"".join(out)


def unpack(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first ``n`` ids of what :func:`pack` made, as unsigned 32-bit numbers."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype("<u4")
    planes = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros(n, "<u4")
    for k in range(bits):
        out |= planes[:, k].astype("<u4") << np.uint32(k)
    return out


def shard_bytes(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, bits: int, block: int = BLOCK) -> bytes:
    """A shard file's bytes. sizes: ids of each document."""
    out, blocks = io.BytesIO(), [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    out.write(MAGIC + np.array([VERSION, bits, block], "<u4").tobytes() + np.array([len(doc_ids), len(ids), len(blocks)], "<u8").tobytes())
    out.write(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes())
    out.write(np.concatenate(([0], np.cumsum(sizes))).astype("<u8").tobytes())
    out.write(np.cumsum([0, *map(len, blocks)]).astype("<u8").tobytes())
    for b in blocks:
        out.write(b)
    return out.getvalue()


class Shard:
    """A shard's tables. ``read(offset, n)`` gives bytes of the file; blocks are read and unpacked on demand."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read, head = read, read(0, 40)
        if head[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.version, self.bits, self.block = (int(x) for x in np.frombuffer(head, "<u4", 3, 4))
        docs, self.n_ids, blocks = (int(x) for x in np.frombuffer(head, "<u8", 3, 16))
        tables, at = read(40, 17 * docs + 8 + 8 * (blocks + 1)), 0
        self.doc_ids, at = np.frombuffer(tables, "<i8", docs, at), at + 8 * docs
        self.nulls, at = np.frombuffer(tables, np.uint8, docs, at), at + docs
        self.starts, at = np.frombuffer(tables, "<u8", docs + 1, at).astype(np.int64), at + 8 * (docs + 1)
        self.offsets = np.frombuffer(tables, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = 40 + len(tables)

    def ids(self, start: int, end: int) -> np.ndarray:
        """ids start..end of the shard, from the blocks that hold them."""
        if start >= end:
            return np.zeros(0, "<u4")
        first, last, parts = start // self.block, (end - 1) // self.block, []
        base = self.offsets[first]
        raw = memoryview(self.read(self.payload + int(base), int(self.offsets[last + 1] - base)))
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(raw[self.offsets[b] - base : self.offsets[b + 1] - base], n, self.bits))
        return np.concatenate(parts)[start - first * self.block :][: end - start]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self) -> Iterator[np.ndarray]:
        """ids of each document in turn; what is read at once is READ_BLOCKS blocks or one document."""
        at, low, held = 0, 0, np.zeros(0, "<u4")
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist()):
            if b > low + len(held):
                at = max(b, min(a + READ_BLOCKS * self.block, self.n_ids))
                low, held = a, self.ids(a, at)
            yield held[a - low : b - low]


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the file system that Spark finds it in: a path without a scheme is on the default one, not on each machine's disk."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file:///") else whole


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_shard(uri: str, data: bytes) -> None:
    """Under a name of its own, then renamed: a lost or repeated task leaves no half-written shard."""
    fs, path = _open(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(part := f"{path}.{uuid.uuid4().hex}.part") as out:
        out.write(data)
    fs.move(part, path)


def open_shard(uri: str) -> tuple[pa.NativeFile, Shard]:
    """An open file, to be closed by the caller, and its shard."""
    fs, path = _open(uri)
    f = fs.open_input_file(path)

    def read(offset: int, n: int) -> bytes:
        f.seek(offset)
        return f.read(n)

    return f, Shard(read)


def cut_points(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values that cut a whole-number column evenly, from a scan of it alone."""
    if parts < 2:
        return []
    shares = [float(i) / parts for i in range(1, parts)]
    got = df.select(F.percentile_approx(column, shares, 10_000)).first()[0] or []
    return sorted({int(x) for x in got})


MANIFEST = "bucket int, shard int, path string, n_docs long, n_ids long"


def write_token_files(docs: DataFrame, out_uri: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write shard files in ascending id order.

    Returns the manifest: one row for each shard with its bucket, number, path, documents and ids.
    Null text: empty, so ``end_id`` alone. Null ids come first. Rows with one id keep an order by
    their ids' bytes, so repeated runs write the same files. An empty table writes no shard. Columns
    other than the two named ones are not read.

    Ids are encoded where the texts lie; what is shuffled are packed ids, ranged by cut points that a
    scan of the id column finds. A shard holds at most ``shard_ids`` ids and one document more.
    """
    if shard_ids < 1:
        raise ValueError("shard_ids must be positive")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out_uri, parts = qualified(docs.sparkSession, out_uri), common.input_partitions(docs)
    cuts = np.array(cut_points(docs, "doc_id", parts), np.int64)

    @common.tidy
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        bits = width(max(coder.vocabulary, end_id + 1))
        for batch in batches:
            ids, at = coder.encode(batch.column("text"))
            packed = [pack(np.append(ids[a:b].astype("<u4"), end_id), bits) for a, b in zip(at, at[1:])]
            doc = batch.column("doc_id")
            bucket = np.searchsorted(cuts, doc.fill_null(np.iinfo(np.int64).min).to_numpy(), side="left")
            yield pa.record_batch([doc, pa.array(bucket, pa.int32()), pa.array(at[1:] - at[:-1] + 1, pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "bucket", "n", "packed"])

    @common.tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(tokenizer_path).vocabulary
        bits = width(max(vocabulary, end_id + 1))
        held: tuple[list, list, list] = ([], [], [])
        bucket = shard = total = 0

        def flush():
            nonlocal shard, total, held
            path = f"{out_uri}/shard-{bucket:06d}-{shard:05d}.lftk"
            write_shard(path, shard_bytes(held[0], np.array(held[1]), np.concatenate(held[2]), bits))
            row = pa.record_batch([[bucket], [shard], [path], [len(held[0])], [total]], schema=pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))
            shard, total, held = shard + 1, 0, ([], [], [])
            return row

        for batch in batches:
            for b, d, n, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "n", "packed"))):
                if held[0] and (b != bucket or total >= shard_ids):
                    yield flush()
                if b != bucket:
                    bucket, shard = b, 0
                held[0].append(d)
                held[1].append(n)
                held[2].append(unpack(raw, n, bits))
                total += n
        if held[0]:
            yield flush()

    encoded = docs.mapInArrow(encode, "doc_id long, bucket int, n int, packed binary")
    # a bucket is a partition of its own: none meets another by its hash
    ordered = encoded.repartitionById(parts, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "packed")
    return common.materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document of the shards in a manifest: doc_id, start, n_tokens, ids_crc32.

    start: ids of all documents before it, over all shards. ids_crc32: unsigned crc32 of its ids as
    little-endian unsigned 32-bit integers, unpacked from the files.
    """
    # one row for each shard file, so the order over all of them is short
    before = Window.orderBy("bucket", "shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).select("path", "before")

    @common.tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
                f, shard = open_shard(path)
                with f:
                    crc = np.fromiter((zlib.crc32(x.tobytes()) for x in shard.documents()), np.int64, len(shard.doc_ids))
                yield pa.record_batch(
                    [pa.array(shard.doc_ids, mask=shard.nulls.astype(bool)), pa.array(shard.starts[:-1] + before), pa.array(np.diff(shard.starts)), pa.array(crc)],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = placed.repartition(common.input_partitions(manifest), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4(spark, sf_dir: str) -> DataFrame:
    """All documents encoded, written as token files in the shared folder and read back."""
    import public_tokenizers

    docs = common.documents(spark, sf_dir, common.ENCODE_BYTES)
    out = common.new_path(spark, "token-files")
    manifest = write_token_files(docs, out, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    common.forget_later(spark, out)
    return read_token_files(manifest)
