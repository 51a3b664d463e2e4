"""Mixing sources to target weights, with DataFrame functions alone.

A source's documents form one stream of words, which is packed into blocks of one length. A source
takes as many slots as its target needs, each slot draws its output shard (so the counts of a source
over the shards are multinomial), a pseudorandom permutation of each source's block numbers says which
block a slot holds, and slots meet the blocks' pieces of documents by source and block number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of a block.
BLOCK_WORDS = 512
#: A word: what stands between white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of sources in their order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a share of all words, and how often a source (and so a document) may be taken.
SHARE, MOST = 1.5, 2
#: Parts that each source's documents are ordered in: offsets of parts are summed first, so no source is one task.
PARTS = 1024
#: Slots that one row unfolds into, and that a task unfolds.
CHUNK, TASK_SLOTS = 1 << 12, 1 << 20
#: Slots of an output shard, on average.
SHARD_SLOTS = 1 << 16
#: Rounds of the permutation of block numbers.
ROUNDS = 24


def permuted(x: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 that depends on ``key`` alone, for any n of 1 or more.

    Each round pairs every number with a partner (k - x mod n) and a hash of the pair says whether the
    two change places, so every round is a bijection of exactly these numbers.
    """

    def step(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, i), n) - x, n)
        return F.when(F.xxhash64(key, i, F.greatest(x, partner)).bitwiseAND(1) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, step)


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``number``: their place (from 0) in an order without ties. Each range of the order is numbered by a task of its own."""
    at = common.materialize(rows.orderBy(*order).withColumn("_part", F.spark_partition_id()), "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a range, as many as shuffle partitions
    starts = at.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return at.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn("number", F.col("_start") + F.col("_own") - 1).drop("_part", "_own", "_start")


def filled(sources: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source_size long, weight double) with ``target``: words by weight, none above ``most`` times its source's size.

    Together the targets are ``share`` of all words (at most ``most`` times all). What a source cannot
    take is shared again by weight among those below their limit, until none is above: each round is
    one aggregation, and a source that has reached its limit stays there.
    """
    cap = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    wanted, level = min(share, most) * total, 0.0
    while True:
        full = cap <= F.col("weight") * level
        held, weight = sources.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, F.lit(0.0)).otherwise(F.col("weight")))).first()
        if not weight:  # all have reached their limit, or there is none
            break
        new = (wanted - held) / weight
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def weighted(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with ``number``, their place by code point (null last), and ``weight``, the repeating weights in that order."""
    out = numbered(sources, F.col("source").asc_nulls_last())
    return out.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int")))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, part, tie): words of each whole text, and the part of its source that it is ordered in."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("tie"))
    return rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Sources with their targets and slots, and the parts of each with the words before them."""
    named = F.col("source").isNull()
    parts = common.materialize(rows.groupBy("source", "part").agg(F.sum("size").alias("words")), "parts")
    sources = weighted(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    sources = filled(common.materialize(sources, "sources"), share, most)
    size, b = F.col("source_size"), block_words
    # whole words to take: so many whole passes over the source, and a rest that ends within a block
    sources = sources.withColumn("wanted", F.least(F.round("target").cast("long"), size * most))
    sources = sources.withColumns({"full_blocks": F.expr(f"source_size div {b}"), "blocks": F.ceil(size / b), "passes": F.expr("coalesce(try_divide(wanted - wanted % nullif(source_size, 0), source_size), 0)").cast("long"), "rest": F.expr("coalesce(wanted % nullif(source_size, 0), 0)")})
    sources = sources.withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / b))
    sources = common.materialize(sources, "targets")
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most PARTS rows
    offsets = parts.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumn("none", named).withColumn("source", F.coalesce("source", F.lit("")))
    known = sources.select("number", "source_size", "target", F.coalesce("source", F.lit("")).alias("source"), named.alias("none"))
    return sources, offsets.join(known, ["source", "none"])


def slots(sources: DataFrame, seed: int, shards: int, tasks: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(number, slot, shard, place, block, words): every slot of every source.

    A pass takes all blocks of a source in an order of its own; a source's last block, if it is short,
    is its last. The last slot of a source may take only the first words of its block. Shards are drawn slot by slot; ``place`` orders a shard.
    """
    rows = sources.where("slots > 0").select("number", "full_blocks", "blocks", "source_size", "passes", "rest", "slots", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(CHUNK).cast("long"))).alias("chunk"))
    rows = rows.repartition(tasks, "number", "chunk").withColumn("slot", F.explode(F.expr(f"sequence(chunk, least(chunk + {CHUNK}, slots) - 1)")))
    rows = rows.withColumns({"pass": F.expr("slot div blocks"), "turn": F.expr("slot % blocks")})
    block = F.when(F.col("turn") < F.col("full_blocks"), permuted(F.col("turn"), F.greatest(F.col("full_blocks"), F.lit(1)), F.xxhash64(F.lit(seed), F.lit("block"), "number", "pass"))).otherwise(F.col("full_blocks"))
    length = F.when(F.col("turn") < F.col("full_blocks"), F.lit(block_words).cast("long")).otherwise(F.col("source_size") - F.col("full_blocks") * block_words)
    words = F.when(F.col("pass") < F.col("passes"), length).otherwise(F.least(length, F.col("rest") - F.col("turn") * block_words))
    drawn = F.xxhash64(F.lit(seed), F.lit("shard"), "number", "slot")
    return rows.select("number", "slot", F.pmod(drawn, F.lit(shards)).alias("shard"), F.xxhash64(drawn).alias("place"), block.alias("block"), words.alias("words"))


def pieces(rows: DataFrame, offsets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents cut at the blocks of their source: (number, block, at, doc_id, size, doc_start, first, length).

    ``doc_start`` is the document's place in its source's stream of words, ``first`` the piece's first
    word in the document, ``at`` its place in the block. A document without words has one row without a block.
    """
    rows = rows.withColumn("none", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    order = Window.partitionBy("source", "none", "part").orderBy("doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(order), F.lit(0))).join(offsets.drop("words"), ["source", "none", "part"])
    rows = rows.withColumn("doc_start", F.col("before") + F.col("within"))
    spans = F.when(F.col("size") > 0, F.expr(f"sequence(doc_start div {block_words}, (doc_start + size - 1) div {block_words})"))
    rows = rows.select("number", "source_size", "target", "doc_id", "size", "doc_start", F.explode_outer(spans).alias("block"))
    begin = F.greatest("doc_start", F.col("block") * block_words)
    end = F.least(F.col("doc_start") + F.col("size"), (F.col("block") + 1) * block_words)
    return rows.withColumns({"at": begin - F.col("block") * block_words, "first": begin - F.col("doc_start"), "length": end - begin})


def mix(docs: DataFrame, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as pieces of documents: doc_id, size, source_size, target, number, doc_start, shard, place, slot, block, at, first, taken.

    Sources in code-point order (null last) weigh ``weights``, repeating. The mix is ``share`` times
    all words; no source gives more than ``most`` times its own, and what it cannot give is shared by
    weight among the others. Each source gives its target, rounded to whole words; each of its passes
    takes every block once, so no document is taken more than ``most`` times. Within a shard, pieces
    are ordered by (place, number, slot, at); a piece is ``taken`` words of a document from its word
    ``first`` on. Pieces that no slot takes are in the result with 0 taken, and a document without
    words is one row with 0 taken and null in slot, block and first, so every document is in the result.

    Null or empty texts have no words and source null is a source of its own. A source without words
    has target 0. Null ids are kept like others; (number, doc_start) tells rows of equal ids with
    words apart. An empty table gives an empty result. Other columns are not read. Equal tables give
    equal mixes, however they are laid out in files: everything is drawn by hashes of ``seed``.
    """
    # narrow rows, written: texts are read once
    rows = common.materialize(sized(docs, id_col, text_col, source_col), "sizes")
    sources, offsets = plan(rows, weights, share, most, block_words)
    total = sources.agg(F.sum("slots")).first()[0] or 0
    own = pieces(rows, offsets, block_words)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_SLOTS))
    drawn = slots(sources, seed, max(1, round(total / shard_slots)), tasks, block_words)
    # the few rows that slots unfold from say nothing of their number, so they must not be broadcast
    both = own.join(drawn.hint("merge"), ["number", "block"], "left")
    # no slot: no words
    taken = F.when(F.col("words") > F.col("at"), F.least(F.col("length"), F.col("words") - F.col("at"))).otherwise(F.lit(0).cast("long"))
    return both.withColumn("taken", taken).drop("length", "words")


def op12(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "source")
    found = mix(docs)
    # a document with words is told by its place; those without have nothing to sum
    key = ["doc_id", "size", "source_size", "target", "number", "doc_start"]
    some = found.where("size > 0").groupBy(*key).agg(F.sum("taken").alias("taken"))
    return some.unionByName(found.where("size = 0").select(*key, "taken")).select("doc_id", "size", "source_size", "target", "taken")
