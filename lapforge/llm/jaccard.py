"""N-gram Jaccard join by vertical partitioning.

All shingles have one global order: by frequency, rarest first, then by hash. Frequencies come from
a sketch of fixed size that is counted over every document; any function of the shingle gives a
valid order, so the sketch's error costs time, never a link.

1. Documents with equal shingle sets are one class. Candidates are classes that share a shingle of
   their prefixes (the first ``n - ceil(t n) + 1`` in the order), which two linked sets always do.
2. The order is cut into fragments. Overlaps are counted in each fragment separately and summed per
   pair; pairs over the threshold are links.
3. A short list of classes that share a prefix shingle gives its pairs. Pairs that share too few prefix
   shingles to reach the threshold are left out.
4. A class that is in long lists belongs to the longest of them, its home. Classes of one home are
   compared block against block, in matrix products per fragment, and so are those of another home
   that share a long list with it. What leaves a comparison are link counts of the two blocks and
   edges between parts that were not connected inside a block: neither pairs nor sets are copied out
   for each pair, and rows grow with the number of blocks' pairs alone.
5. Connected components of the links, by the smallest document id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import shingle_sets

#: Counters of the frequency sketch (2**22, saturating at 65535: 8 MB where it is used) and its blocks.
SKETCH_BITS, SKETCH_BLOCKS = 22, 64
#: Fragments that the global order is cut into.
FRAGMENTS = 8
#: Longest list that gives its pairs; classes and shingles that a block of longer ones is made for.
SHORT, BLOCK, BLOCK_SHINGLES = 32, 1024, 1 << 20
#: Shares that the rows of a long list are dealt to where they meet what is known of the list.
SALTS = 16
#: Hashes counted at once while sketching.
COUNT_AT = 4 << 20


def set_id(shingles: np.ndarray) -> int:
    """A 64-bit name of a shingle set. With the set's size it tells classes apart."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64)))


def with_class(docs: DataFrame, n: int, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the class of each text in the column ``name``: null without words."""

    @F.arrow_udf("long")
    @common.tidy
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([set_id(s) if len(s) else None for s in shingle_sets(texts, n)], pa.int64())

    return docs.withColumn(name, found(F.col(text_col).cast("string")))


def _survey(docs: DataFrame, n: int) -> DataFrame:
    """kind 0: a document's set; kind 1: a block of a task's shingle counts."""
    size = (1 << SKETCH_BITS) // SKETCH_BLOCKS
    names = ["kind", "doc_id", "n", "sig", "block", "counts"]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, waiting, held = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
        for batch in batches:
            sets = shingle_sets(batch.column("text"), n)
            k = len(sets)
            sizes = np.array([len(s) for s in sets], np.int64)
            sigs = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
            yield pa.record_batch([pa.array(np.zeros(k), types[0]), batch.column("doc_id"), pa.array(sizes), sigs, pa.nulls(k, types[4]), pa.nulls(k, types[5])], names)
            waiting += [s >> np.uint64(64 - SKETCH_BITS) for s in sets]
            held += int(sizes.sum())
            if held > COUNT_AT:
                counts += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=len(counts)).astype(np.uint32)
                waiting, held = [], 0
        if held:
            counts += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=len(counts)).astype(np.uint32)
        press = zstandard.ZstdCompressor(level=1)
        for b in range(SKETCH_BLOCKS):
            own = counts[b * size : (b + 1) * size]
            if own.any():
                row = press.compress(np.minimum(own, 65535).astype("<u2").tobytes())
                yield pa.record_batch([pa.array([x], t) for x, t in zip((1, None, None, None, b, row), types)], names)

    return docs.mapInArrow(run, "kind int, doc_id long, n long, sig long, block int, counts binary")


def _sketch(survey: DataFrame) -> np.ndarray:
    """Counts of all tasks added up: each block in a task of its own, SKETCH_BLOCKS rows to the driver."""
    size = (1 << SKETCH_BITS) // SKETCH_BLOCKS

    @common.tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u2")
                sums[b] = np.minimum(sums.get(b, 0) + part.astype(np.uint32), 65535)
        for b, own in sums.items():
            yield pa.record_batch([pa.array([b], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(own.astype("<u2").tobytes())], pa.binary())], ["block", "counts"])

    rows = survey.where("kind = 1").select("block", "counts").repartition(SKETCH_BLOCKS, "block").mapInArrow(add, "block int, counts binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.uint16)
    for r in rows:
        out[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), "<u2")
    return out


class Order:
    """The global order of shingles, and its fragments of equal weight."""

    def __init__(self, counts: np.ndarray, fragments: int = FRAGMENTS):
        self.counts, self.fragments = counts, fragments
        weight = np.bincount(counts, minlength=1 << 16).astype(np.float64) * np.arange(1 << 16)
        self.share = weight / max(weight.sum(), 1)
        self.before = np.cumsum(self.share) - self.share

    def keys(self, h: np.ndarray) -> np.ndarray:
        return (self.counts[h >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(48)) | (h & np.uint64((1 << 48) - 1))

    def fragment(self, h: np.ndarray) -> np.ndarray:
        often = self.counts[h >> np.uint64(64 - SKETCH_BITS)]
        place = self.before[often] + self.share[often] * ((h & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32)
        return np.minimum((place * self.fragments).astype(np.int64), self.fragments - 1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _postings(docs: DataFrame, order, n: int, percent: int) -> DataFrame:
    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, sigs, sizes = [], [], []
            for s in shingle_sets(batch.column("text"), n):
                if not len(s) or (sig := set_id(s)) in seen:
                    continue
                seen.add(sig)
                p = prefix_length(len(s), percent)
                tokens.append(s[np.argpartition(order.value.keys(s), p - 1)[:p]])
                sigs.append(sig)
                sizes.append(len(s))
            if len(seen) > 1 << 20:
                seen.clear()
            if tokens:
                each = [len(t) for t in tokens]
                yield pa.record_batch([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(sigs, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each))], ["token", "sig", "n"])

    return docs.mapInArrow(run, "token long, sig long, n int")


def _fragments(docs: DataFrame, order, n: int) -> DataFrame:
    """(sig, parts): a set cut by the fragments of the order, once a task."""
    kind = pa.list_(pa.list_(pa.int64()))

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sigs, parts = [], []
            for s in shingle_sets(batch.column("text"), n):
                if not len(s) or (sig := set_id(s)) in seen:
                    continue
                seen.add(sig)
                frag = order.value.fragment(s)
                sigs.append(sig)
                parts.append([s[frag == f].view(np.int64) for f in range(order.value.fragments)])
            if len(seen) > 1 << 20:
                seen.clear()
            yield pa.record_batch([pa.array(sigs, pa.int64()), pa.array(parts, kind)], ["sig", "parts"])

    return docs.mapInArrow(run, "sig long, parts array<array<long>>")


def _fits(percent: int, x: str, y: str) -> str:
    return f"100 * least({x}, {y}) >= {percent} * greatest({x}, {y})"


def _may_link(percent: int) -> str:
    """Overlap filter for pairs that share ``met`` prefix shingles in short lists, and at most least(ua, ub) in long ones.

    Take the set whose prefix ends first in the order: shared shingles up to there are in both
    prefixes, and it has ceil(t n) - 1 others.
    """
    need = f"ceil({percent} * (na + nb) / {100 + percent}.0 - 1e-9)"
    rest = f"greatest(ceil({percent} * na / 100.0 - 1e-9), ceil({percent} * nb / 100.0 - 1e-9)) - 1"
    return f"met + least(ua, ub) + {rest} >= {need}"


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among pairs (a, na, b, nb): overlaps of each fragment, summed per pair."""
    left = sets.select(F.col("sig").alias("a"), F.col("parts").alias("pa"))
    right = sets.select(F.col("sig").alias("b"), F.col("parts").alias("pb"))
    partial = F.zip_with("pa", "pb", lambda x, y: F.size(F.array_intersect(x, y)))
    total = pairs.join(left, "a").join(right, "b").withColumn("k", F.aggregate(partial, F.lit(0), lambda s, x: s + x))
    # a class can come from several equal documents: their rows agree
    return total.where(f"100L * k >= {percent}L * (na + nb - k)").select("a", "ha", "b", "hb").distinct()


def _packed(parts: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Fragments of a block, each as its distinct shingles and cells (class, place of the shingle)."""
    raw = []
    for shingles, of in parts:
        own, place = np.unique(shingles, return_inverse=True)
        raw += [np.array([len(own), len(place)], "<i8").tobytes(), own.astype("<i8").tobytes(), place.astype("<i4").tobytes(), of.astype("<i4").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpacked(raw: bytes) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(raw):
        own, cells = (int(x) for x in np.frombuffer(raw, "<i8", 2, at))
        at += 16
        out.append((np.frombuffer(raw, "<i8", own, at), np.frombuffer(raw, "<i4", cells, at + 8 * own), np.frombuffer(raw, "<i4", cells, at + 8 * own + 4 * cells)))
        at += 8 * own + 8 * cells
    return out


def _linked(left, ln: np.ndarray, right, rn: np.ndarray, percent: int) -> np.ndarray:
    """Which classes of two blocks link: overlaps of each fragment as a matrix product, summed."""
    total = np.zeros((len(ln), len(rn)), np.float32)
    for x, y in zip(left, right):
        shared = np.intersect1d(x[0], y[0], assume_unique=True)
        for s in range(0, len(shared), 4096):
            some, sheets = shared[s : s + 4096], []
            for (own, place, of), rows in ((x, len(ln)), (y, len(rn))):
                column = np.full(len(own), -1, np.int32)
                where = np.minimum(np.searchsorted(some, own), len(some) - 1)
                hit = some[where] == own
                column[hit] = where[hit]
                at = column[place]
                sheet = np.zeros((rows, len(some)), np.float32)
                sheet[of[at >= 0], at[at >= 0]] = 1
                sheets.append(sheet)
            total += sheets[0] @ sheets[1].T
    k = total.astype(np.int64)
    return 100 * k >= percent * (ln[:, None] + rn[None, :] - k)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of edges between named nodes those that connect parts not yet connected."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    kept: tuple[list[int], list[int]] = ([], [])
    for x, y in np.unique(np.stack([a, b], axis=1), axis=0).tolist():
        if (p := find(x)) != (q := find(y)):
            root[max(p, q)] = min(p, q)
            kept[0].append(x)
            kept[1].append(y)
    return kept


KEY = ["home", "asks", "grade", "b"]
_KEY = "home struct<size: long, token: long>, asks boolean, grade int, b int"


def _home_blocks(lists: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links of classes in long lists: (sig, k) partial numbers of links to add up, edges (a, b) that connect
    what is linked, and which class asks which other home (sig, home).

    lists: (token, sig, n, size) of all long lists. Every pair that shares one is compared exactly once.
    """
    rank = F.struct("size", "token")
    own = lists.groupBy("sig", "n").agg(F.max(rank).alias("home"))
    own = common.materialize(own, "homes")
    placed = lists.join(own, ["sig", "n"])
    # homes that meet in a list: the class of the lesser one asks the greater one's
    meets = placed.select("token", "home").distinct()
    several = meets.groupBy("token").agg(F.max("home").alias("most"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "most")
    spread = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = placed.select("token", "sig", "n", F.col("home").alias("from"), F.pmod(F.xxhash64("sig", F.lit(3)), F.lit(SALTS)).cast("int").alias("salt"))
    asking = salted.join(spread(several), ["token", "salt"]).where(F.col("from") < F.col("most")).drop("most")
    asks = asking.join(spread(meets), ["token", "salt"]).where(F.col("from") < F.col("home")).select("sig", "n", "home").distinct()
    asks = common.materialize(asks, "asked-homes")
    # sizes a factor of the threshold apart cannot link: blocks hold one grade of sizes and meet the next ones
    grade = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    rows = own.select("home", "sig", "n", F.lit(False).alias("asks")).unionByName(asks.select("home", "sig", "n", F.lit(True).alias("asks"))).withColumn("grade", grade)
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = rows.groupBy("home", "asks", "grade").agg(blocks.alias("blocks"))
    salt = F.pmod(F.xxhash64("sig", F.lit(5)), F.lit(SALTS)).cast("int")
    dealt = rows.withColumn("salt", salt).join(spread(sizes), ["home", "asks", "grade", "salt"])
    dealt = dealt.select("home", "asks", "grade", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int").alias("b"), "sig", "n").join(sets, "sig")

    def pack(table: pa.Table) -> pa.Table:
        sig, first = np.unique(table.column("sig").to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        n, asks = table.column("n").to_numpy().astype(np.int64), table.column("asks")[0].as_py()
        parts = []
        for f in range(FRAGMENTS):
            part = pc.list_element(table.column("parts").combine_chunks(), f)
            parts.append((part.flatten().to_numpy(), np.repeat(np.arange(len(sig)), pc.list_value_length(part).to_numpy())))
        raw = _packed(parts)
        counts, edges, label = np.zeros(len(sig), np.int64), ([], []), sig
        if not asks:
            met = _linked(own := _unpacked(raw), n, own, n, percent)
            np.fill_diagonal(met, False)
            counts = met.sum(axis=1)
            label, last = sig.copy(), None
            while last is None or (label != last).any():  # least name along links, then of that name
                last = label
                label = np.minimum(label, np.where(met, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max))
                label = label[np.searchsorted(sig, label)]
            edges = (sig[label != sig].tolist(), label[label != sig].tolist())
        one = lambda x: pa.array([x], pa.list_(pa.int64()))
        columns = [table.column(k).slice(0, 1).combine_chunks() for k in KEY]
        return pa.table([*columns, one(sig), one(n), one(label), one(counts), one(edges[0]), one(edges[1]), pa.array([raw], pa.binary())], names=[*KEY, "sig", "n", "label", "counts", "ea", "eb", "raw"])

    packed = dealt.groupBy(*KEY).applyInArrow(pack, f"{_KEY}, sig array<long>, n array<long>, label array<long>, counts array<long>, ea array<long>, eb array<long>, raw binary")
    packed = common.materialize(packed, "blocks")
    side = lambda k: packed.select(*(F.col(c).alias(f"{k}{c}") for c in (*KEY, "n", "label", "raw")))
    name = lambda k: packed.select("home", *(F.col(c).alias(f"{k}{c}") for c in KEY[1:]))
    left = name("l").withColumn("rgrade", F.explode(F.when(F.col("lasks"), F.array(F.col("lgrade") - 1, F.col("lgrade"), F.col("lgrade") + 1)).otherwise(F.array(F.col("lgrade"), F.col("lgrade") + 1))))
    pairs = left.join(name("r").where("not rasks"), ["home", "rgrade"]).where("lasks or rgrade > lgrade or rb > lb")
    pairs = pairs.select(F.col("home").alias("lhome"), F.col("home").alias("rhome"), *(f"{k}{c}" for k in "lr" for c in KEY[1:]))
    both = pairs.join(side("l"), [f"l{c}" for c in KEY]).join(side("r"), [f"r{c}" for c in KEY])

    @common.tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: [] for c in (*KEY, "counts", "ea", "eb")}
            for x in range(batch.num_rows):
                row = {c: batch.column(c)[x] for c in batch.schema.names}
                size, label, raw = ([row[f"{k}{c}"] for k in "lr"] for c in ("n", "label", "raw"))
                size, label = ([v.values.to_numpy() for v in y] for y in (size, label))
                met = _linked(_unpacked(raw[0].as_py()), size[0], _unpacked(raw[1].as_py()), size[1], percent)
                i, j = np.nonzero(met)
                edges = _forest(label[0][i], label[1][j])
                for k, axis in (("l", 1), ("r", 0)):
                    for c in KEY:
                        rows[c].append(row[f"{k}{c}"].as_py())
                    rows["counts"].append(met.sum(axis=axis))
                    rows["ea"].append(edges[0] if k == "l" else [])
                    rows["eb"].append(edges[1] if k == "l" else [])
            long = pa.list_(pa.int64())
            types = [pa.struct([("size", pa.int64()), ("token", pa.int64())]), pa.bool_(), pa.int32(), pa.int32(), long, long, long]
            yield pa.record_batch([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))

    crossed = common.materialize(both.mapInArrow(compare, f"{_KEY}, counts array<long>, ea array<long>, eb array<long>"), "block-links")

    def add(table: pa.Table) -> pa.Table:
        sig = next(v for v in table.column("sig") if v.is_valid).values
        return pa.table({"sig": sig, "k": pa.array(np.sum([v.values.to_numpy() for v in table.column("counts")], axis=0))})

    counts = packed.select(*KEY, "sig", "counts").unionByName(crossed.select(*KEY, "counts"), allowMissingColumns=True).groupBy(*KEY).applyInArrow(add, "sig long, k long")
    edges = [x.select(F.explode(F.arrays_zip(F.col("ea").alias("a"), F.col("eb").alias("b"))).alias("x")).select("x.*") for x in (packed, crossed)]
    return counts, edges[0].unionByName(edges[1]).where("a <> b"), asks.select("sig", "home")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents linked by 100 * intersection >= percent * union of their shingle sets.

    Returns a row for each document: doc_id, n_shingles (set size), component_id (smallest doc_id
    reachable by links, itself included), class_id (its set's name), component_class (a
    class that names its component; both null without words) and n_links (other sets that its set links with).

    Null text or no words: an empty set, linked with nothing, so the document is its own component.
    A null id cannot be a component's name unless all its members' ids are null. Repeated rows are
    returned as often as they come. An empty table gives an empty result. Other columns are not read.
    """
    if not 0 < percent <= 100 or n < 1:
        raise ValueError("percent must be 1 to 100 and n positive")
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    survey = common.materialize(_survey(docs, n), "shingle-survey")
    order = spark.sparkContext.broadcast(Order(_sketch(survey)))
    own = survey.where("kind = 0").select("doc_id", "n", "sig")
    classes = own.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("first_id"))

    # one document speaks for its class; a few others pass, so a shingle of one class can count twice: it gives no pair
    heads = common.maybe_in(docs, "doc_id", classes.select(F.col("first_id").alias("doc_id")))
    postings = common.materialize(_postings(heads, order, n, percent), "prefixes")
    tokens = postings.groupBy("token").count().where("count > 1").select("token")
    live = common.materialize(common.maybe_in(postings, "token", tokens).distinct(), "lists")
    common.discard(postings)
    long = live.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where(f"size > {SHORT}")
    long = common.materialize(long, "long-lists")
    marked = common.marked(live, "token", long.select("token"))
    salted = long.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    perhaps = marked.where("_maybe").withColumn("salt", F.pmod(F.xxhash64("sig", F.lit(3)), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"], "left").select("token", "sig", "n", "size")
    perhaps = common.materialize(perhaps, "sized-lists")
    lists = perhaps.where("size is not null")
    # shingles of a prefix that are in long lists are not counted pair by pair: at most so many are shared
    unseen = lists.groupBy("sig").agg(F.count(F.lit(1)).alias("unseen"), F.max(F.struct("size", "token")).alias("home"))
    brief = marked.where("not _maybe").select("token", "sig", "n").unionByName(perhaps.where("size is null").select("token", "sig", "n")).join(unseen, "sig", "left").fillna(0, "unseen")
    x, y = (brief.select("token", F.col("sig").alias(k), F.col("n").alias(f"n{k}"), F.col("unseen").alias(f"u{k}"), F.col("home").alias(f"h{k}")) for k in "ab")
    met = x.join(y, "token").where("a < b").where(_fits(percent, "na", "nb")).groupBy("a", "na", "ua", "ha", "b", "nb", "ub", "hb").agg(F.count(F.lit(1)).alias("met"))
    # pairs of one home are compared there, and so are those of homes of which one class asks the other's
    short = met.where(_may_link(percent)).where("ha is null or hb is null or ha <> hb").select("a", "na", "ha", "b", "nb", "hb")
    pairs = common.materialize(short, "candidates")
    common.discard(live)

    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).union(lists.select("sig")).distinct()
    ids = classes.join(wanted, "sig").select(F.col("first_id").alias("doc_id"))
    sets = common.materialize(_fragments(common.maybe_in(docs, "doc_id", ids), order, n), "fragments")

    links = common.materialize(_verify(pairs, sets, percent), "links")
    common.discard(pairs)
    if lists.isEmpty():
        edges, degrees = links, []
    else:
        counts, more, asks = _home_blocks(lists, sets, percent)
        for k, other in (("a", "b"), ("b", "a")):
            asked = asks.select(F.col("sig").alias(k), F.col("home").alias(f"h{other}"))
            links = links.join(asked, [k, f"h{other}"], "left_anti")
        edges, degrees = links.select("a", "b").unionByName(more), [counts]
    degrees += [links.select(F.col(k).alias("sig"), F.lit(1).cast("long").alias("k")) for k in "ab"]
    comp = common.components(edges.select("a", "b"), "components").withColumnsRenamed({"node": "sig", "component": "root"})
    degree = reduce(DataFrame.unionByName, degrees).groupBy("sig").agg(F.sum("k").alias("n_links"))
    named = common.materialize(classes.join(comp, "sig", "left").withColumn("root", F.coalesce("root", "sig")), "classes")
    common.discard(sets)
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_class = named.join(least, "root").join(degree, "sig", "left").select("sig", "root", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    joined = own.join(by_class, "sig", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("sig").alias("class_id"), F.col("root").alias("component_class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op3(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: five words, 0.8."""
    return jaccard_components(common.documents(spark, sf_dir), n=5, percent=80)
