"""Canonical exact fingerprints.

A text's canonical form folds Unicode compatibility forms, case and white space. Its fingerprint is
the 128-bit xxhash of that form, and equal fingerprints are backed by bytes: within a bucket of
equal hashes, which is never collected, the least and greatest form are compared, and forms that
differ are told apart by a number behind the hash.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common
from .token_files import cut_points


def canonical(text: str | None) -> bytes:
    """NFKC, case-folded, NFKC again, runs of white space as one blank, none at the ends. Null: empty."""
    if not text:
        return b""
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def wide_hash(form: bytes) -> bytes:
    return xxhash.xxh3_128_digest(form)


def _frames(forms: list[bytes]) -> list[bytes]:
    """Compressed forms. The compressor is deterministic and lossless, so frames are equal exactly where forms are, if all executors have one version of it."""
    press = zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False)
    return [press.compress(f) for f in forms]


def _several(hashes: DataFrame) -> DataFrame:
    return hashes.groupBy("hash").count().where("count > 1").select("hash")


def _differing(frames: DataFrame, several: DataFrame) -> DataFrame:
    """Hashes whose forms differ, of (hash, frame) rows. Only forms that share a hash are shuffled, and a
    task first reduces its own part of a bucket to its least and greatest frame."""
    shared = common.maybe_in(frames, "hash", several)
    return shared.groupBy("hash").agg(F.min("frame").alias("low"), F.max("frame").alias("high")).where("low <> high").select("hash")


def _numbers(frames: DataFrame, differing: DataFrame) -> DataFrame:
    """(hash, key, number): forms of one hash, told apart by numbers from 0 in the order of their frames."""
    distinct = common.maybe_in(frames, "hash", differing).join(differing, "hash", "left_semi").distinct()
    numbered = distinct.withColumn("number", F.row_number().over(Window.partitionBy("hash").orderBy("frame")) - 1)
    return common.materialize(numbered.select("hash", F.sha2("frame", 256).alias("key"), "number"), "collision-numbers")


def _named(raw: str, number: Column | None = None) -> Column:
    name = F.lower(F.hex(raw))
    return name if number is None else F.concat(name, F.when(F.coalesce(number, F.lit(0)) > 0, F.concat(F.lit("-"), number.cast("string"))).otherwise(""))


def fingerprint(docs: DataFrame, hasher: Callable[[bytes], bytes] = wide_hash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of every whole text.

    The fingerprint is the hash of the canonical form in hexadecimal; where different forms share a
    hash, all but the first (by their compressed bytes) carry a number behind it. Null text: as
    empty. Null ids and repeated rows are kept. An empty table gives an empty result. Other columns
    are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [canonical(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array([hasher(f) for f in made], pa.binary()), pa.array(_frames(made), pa.binary())], ["doc_id", "hash", "frame"])

    forms = docs.mapInArrow(run, "doc_id long, hash binary, frame binary")
    frames = forms.select("hash", "frame")
    differing = common.materialize(_differing(frames, _several(forms)), "hash-collisions")
    if differing.isEmpty():
        return forms.select("doc_id", _named("hash").alias("fingerprint"))
    keyed = forms.select("doc_id", "hash", F.sha2("frame", 256).alias("key"))
    return keyed.join(_numbers(frames, differing), ["hash", "key"], "left").select("doc_id", _named("hash", F.col("number")).alias("fingerprint"))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by as many of the following text's first (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: What stands for a null id where ids are ordered: below all others.
NO_ID = -(2**63)


def compare_edited(docs: DataFrame, hasher: Callable[[bytes], bytes] = wide_hash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, which the next document's beginning ends.

    The next document has the next lower id; the last one's is the first. Repeated ids are ordered by
    their compressed texts, null ids come last. Returns doc_id, n_chars (code points), edited_sha256,
    fingerprint, edited_fingerprint, near_edited and near_next: 1 where the two fingerprints are
    equal, else 0.

    Null text: empty. One row alone is its own next. An empty table gives an empty result. Other
    columns are not read.

    Texts are shuffled once and compressed, into ranges of ids; a task streams its ranges in order.
    Rows with one id are one range, streamed by one task.
    The first row of every range is copied to the range that it follows, so no task needs another's.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spark, parts = docs.sparkSession, common.input_partitions(docs)
    cuts = cut_points(docs, "doc_id", parts)
    top = docs.agg(F.max("doc_id")).first()[0]
    # cut points are ids that occur, and range k ends with cut k: so its greatest id is known
    heads = cuts if cuts and top == cuts[-1] else [*cuts, NO_ID if top is None else top]
    held = spark.sparkContext.broadcast((np.array(cuts, np.int64), np.array(heads, np.int64)))

    @common.tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to their range; rows with a range's greatest id to the next higher range as well (the highest's: to the lowest)."""
        cuts, heads = held.value
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            at = np.searchsorted(cuts, ids, side="left")
            packed = pa.array([press.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()], pa.binary())
            first = np.flatnonzero(heads[at] == ids)
            take = np.concatenate((np.arange(len(ids)), first))
            to = np.concatenate((at, (at[first] + 1) % len(heads)))
            copy = np.arange(len(take)) >= len(ids)
            rows = pa.array(take)
            yield pa.record_batch([pa.array(to, pa.int32()), batch.column("doc_id").take(rows), packed.take(rows), pa.array(copy)], ["to", "doc_id", "packed", "copy"])

    dealt = docs.mapInArrow(deal, "to int, doc_id long, packed binary, copy boolean")
    # copies stand behind a range's own rows; of several with one id, the first is the one wanted
    ordered = dealt.repartitionById(parts, "to").sortWithinPartitions("to", "copy", F.col("doc_id").desc_nulls_last(), "packed")

    def stream(frames: bool) -> DataFrame:
        names = ["doc_id", "n_chars", "edited_sha256", "hash", "edited_hash", "next_hash"] + ["frame", "edited_frame", "next_frame"] * frames
        types = [pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * (6 if frames else 3)

        @common.tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            unpress = zstandard.ZstdDecompressor()
            waits: tuple | None = None  # range, id, text and form of the row whose next is still to come
            for batch in batches:
                rows: list[tuple] = []
                for to, d, packed, copy in zip(*(batch.column(c).to_pylist() for c in ("to", "doc_id", "packed", "copy"))):
                    text = unpress.decompress(packed).decode("utf-8", "surrogatepass")
                    form = canonical(text)
                    if waits is not None and waits[0] == to:
                        new = edited(waits[2], text)
                        forms = [waits[3], canonical(new), form]
                        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                        rows.append((waits[1], len(waits[2]), sha, *map(hasher, forms), *(_frames(forms) if frames else ())))
                    waits = None if copy else (to, d, text, form)
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)

        kinds = {"doc_id": "long", "n_chars": "long", "edited_sha256": "string"}
        return ordered.mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'binary')}" for n in names))

    plain, framed = stream(False), stream(True)
    hashes = plain.select(F.explode(F.array("hash", "edited_hash")).alias("hash"))
    frames = framed.select(F.explode(F.array(F.struct("hash", "frame"), F.struct(F.col("edited_hash").alias("hash"), F.col("edited_frame").alias("frame")))).alias("x")).select("x.*")
    # one job: its three uses of the ordered rows share one shuffle
    found = _differing(frames, _several(hashes)).withColumnRenamed("hash", "differs")
    both = common.materialize(plain.unionByName(found, allowMissingColumns=True), "fingerprints")
    rows, differing = both.where("differs is null").drop("differs"), both.where("differs is not null").select(F.col("differs").alias("hash"))
    if differing.isEmpty():
        name = {k: _named(k) for k in ("hash", "edited_hash", "next_hash")}
    else:
        numbers, rows, name = _numbers(frames, differing), framed, {}
        for k in ("hash", "edited_hash", "next_hash"):
            own = numbers.select(F.col("hash").alias(k), F.col("key").alias("_key"), F.col("number").alias(f"_{k}"))
            rows = rows.withColumn("_key", F.sha2(k.replace("hash", "frame"), 256)).join(own, [k, "_key"], "left").drop("_key")
            name[k] = _named(k, F.col(f"_{k}"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        name["hash"].alias("fingerprint"),
        name["edited_hash"].alias("edited_fingerprint"),
        (name["hash"] == name["edited_hash"]).cast("double").alias("near_edited"),
        (name["hash"] == name["next_hash"]).cast("double").alias("near_next"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return compare_edited(common.documents(spark, sf_dir))
