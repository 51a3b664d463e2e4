"""Ranked lexical search: an index of trees over terms and documents, searched best first.

Documents are taken in blocks as they are stored, without a shuffle. Each block is one row of a written
index: its terms, its documents' lengths, and a compressed quadtree of the largest impacts over the
grid of terms and documents (:mod:`treap`). An item's terms descend all blocks; the best of each task
meet in Spark. The index holds every term of every document, so any items can be searched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .treap import Searcher, Treap, build

#: Distinct pairs of terms and documents of a block: it ends with the document that reaches them.
BLOCK_POSTINGS = 1 << 19
#: Documents of an item.
BEST = 10
#: Terms of items that are searched at once; more items are taken in blocks, each of which passes over the index.
QUERY_TERMS = 1 << 18
#: Blocks of one Parquet row group of the index: writers and readers hold one group at a time. A limit in bytes is first looked at after 100 rows, hundreds of MB.
GROUP_BLOCKS = 1

#: Every byte as terms have it: A-Z lower-cased, what stands between terms a space; all bytes of other characters belong to terms.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

INDEX = "doc_ids array<long>, lengths array<long>, terms array<string>, found_in array<int>, height int, top int, kept binary, below binary, tf binary"


def term_texts(texts: pa.Array) -> pa.Array:
    """Texts of lower-case terms and spaces alone. Null: empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    data = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(BYTES))
    return pa.Array.from_buffers(texts.type, len(texts), [None, offsets, data], 0, texts.offset)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms, each term's place among them in text order, and where each text's terms begin (one entry more)."""
    lists = pc.ascii_split_whitespace(term_texts(texts))
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    if not len(lists):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(1, np.int64)
    flat = lists.flatten()
    at = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    coded = flat.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), kept[at]


def lengths_of(texts: pa.Array) -> np.ndarray:
    """Number of terms of each text, counted at the bytes where they begin."""
    plain = term_texts(texts)
    if not len(plain):
        return np.zeros(0, np.int64)
    _, offsets, data = plain.buffers()
    at = np.frombuffer(offsets, np.int32 if plain.type == pa.string() else np.int64)[plain.offset : plain.offset + len(plain) + 1].astype(np.int64)
    inside = np.frombuffer(data, np.uint8)[at[0] : at[-1]] != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    # a text's first byte begins a term, whatever ends the text before
    heads = at[:-1][np.diff(at) > 0] - at[0]
    begins[heads] = inside[heads]
    return np.diff(np.concatenate(([0], np.cumsum(begins)))[at - at[0]])


def measure(length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The length measure of documents: 100 for the mean one, 10 for an empty one, and 90 more for each mean length more."""
    return 100 - 90 + (90 * length * n_docs) // max(n_terms, 1)


@dataclass
class Index:
    """rows: the written blocks (INDEX); n_docs: documents with a term; n_terms: their terms, with repeats."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_postings: int = BLOCK_POSTINGS) -> Index:
    """Indexes whole texts: two passes over the documents, the first for the number and mean length of documents.

    Terms are the longest runs of ASCII letters and digits and of all other characters from U+0080 on,
    A-Z lower-cased. Documents without a term, with a null text or a null id are not indexed and do
    not count; rows of one id are documents of their own. An empty table gives an index without blocks.
    A task holds one block: ``block_postings`` pairs of terms and documents, and one batch more.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")

    @common.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            own = lengths_of(batch.column("text"))
            n, total = n + int((own > 0).sum()), total + int(own.sum())
        yield pa.record_batch([pa.array([n]), pa.array([total])], ["n", "total"])

    n_docs, n_terms = docs.mapInArrow(count, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def block(parts: list) -> pa.RecordBatch:
        ids, lengths = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(ids, kind="stable")
        column_of = np.empty(len(ids), np.int64)
        column_of[order] = np.arange(len(ids))
        vocabulary = pa.chunked_array([p[2] for p in parts]).combine_chunks().dictionary_encode()
        sizes, starts = [len(p[2]) for p in parts], np.cumsum([0, *[len(p[0]) for p in parts]])
        code = np.split(vocabulary.indices.to_numpy(), np.cumsum(sizes)[:-1])
        rows = np.concatenate([c[p[4]] for p, c in zip(parts, code)])
        columns = column_of[np.concatenate([p[3] + s for p, s in zip(parts, starts[:-1].tolist())])]
        tf = np.concatenate([p[5] for p in parts])
        # frequent terms first: rows that stand together are alike
        df = np.bincount(rows, minlength=len(vocabulary.dictionary))
        by_df = np.argsort(-df, kind="stable")
        row_of = np.empty(len(by_df), np.int64)
        row_of[by_df] = np.arange(len(by_df))
        tree = build(row_of[rows], columns, tf, measure(lengths[order], n_docs, n_terms))
        values = [ids[order], lengths[order], vocabulary.dictionary.take(pa.array(by_df)), df[by_df].astype(np.int32)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v)) for v in values]
        last = [pa.array([tree.height], pa.int32()), pa.array([tree.top], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (tree.kept, tree.below, tree.tf)]]
        return pa.record_batch([*lists, *last], ["doc_ids", "lengths", "terms", "found_in", "height", "top", "kept", "below", "tf"])

    @common.tidy
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            terms, codes, at = terms_of(batch.column("text"))
            lengths = np.diff(at)
            some = np.flatnonzero(lengths)
            if not len(some):
                continue
            doc = np.repeat(np.arange(len(some)), lengths[some])
            pair, tf = np.unique(doc * len(terms) + codes, return_counts=True)
            parts.append((batch.column("doc_id").to_numpy()[some], lengths[some], terms, (pair // len(terms)).astype(np.int32), (pair % len(terms)).astype(np.int32), tf.astype(np.int32)))
            held += len(pair)
            if held >= block_postings:
                yield block(parts)
                parts, held = [], 0
        if parts:
            yield block(parts)

    path = common.new_path(docs.sparkSession, "lexical")
    docs.mapInArrow(blocks, INDEX).write.option("parquet.block.row.count.limit", GROUP_BLOCKS).parquet(path)
    common.forget_later(docs.sparkSession, path)
    return Index(docs.sparkSession.read.schema(INDEX).parquet(path), n_docs, n_terms)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, terms): the distinct terms of each item, of all rows of one id together."""

    @common.tidy
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, codes, at = terms_of(batch.column("text"))
            item = np.repeat(np.arange(len(at) - 1), np.diff(at))
            yield pa.record_batch([batch.column("item_id").take(pa.array(item)), terms.take(pa.array(codes))], ["item_id", "term"])

    rows = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    return rows.mapInArrow(split, "item_id long, term string").groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def _ranked(index: Index, asked: list, best: int) -> DataFrame:
    """(item_id, doc_id, score) of one block of items: each task's best documents."""
    spark = index.rows.sparkSession
    wanted = pa.array(sorted({t for r in asked for t in r["terms"]}), pa.string())
    held = spark.sparkContext.broadcast(wanted)

    @common.tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), np.int64)
        for batch in batches:
            at = pc.index_in(batch.column("terms").flatten(), held.value)
            known = at.is_valid()
            np.add.at(total, at.filter(known).to_numpy(), batch.column("found_in").flatten().filter(known).to_numpy())
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], ["term", "df"])

    # as many rows as the items have terms
    df = {r["term"]: r["df"] for r in index.rows.select("terms", "found_in").mapInArrow(counted, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = np.zeros(len(wanted), np.int64)
    for t, n in df.items():
        weight[t] = math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1)))
    place = {t: k for k, t in enumerate(wanted.to_pylist())}
    own = [np.array(sorted(place[t] for t in r["terms"] if weight[place[t]] > 0), np.int64) for r in asked]
    item_ids, n_docs, n_terms = [r["item_id"] for r in asked], index.n_docs, index.n_terms

    given = spark.sparkContext.broadcast((wanted, weight, own))

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weight, own = given.value
        top = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own]
        for batch in batches:
            for b in range(len(batch)):
                x = {c: batch.column(c)[b] for c in batch.schema.names}
                ids, lengths = x["doc_ids"].values.to_numpy(), x["lengths"].values.to_numpy()
                m = measure(lengths, n_docs, n_terms)
                tree = Treap(x["height"].as_py(), x["top"].as_py(), np.frombuffer(x["kept"].as_buffer(), np.uint8), np.frombuffer(x["below"].as_buffer(), np.uint8), np.frombuffer(x["tf"].as_buffer(), np.int32))
                searcher = Searcher(tree, m)
                row = pc.index_in(wanted, x["terms"].values).fill_null(-1).to_numpy()
                for k, terms in enumerate(own):
                    here = terms[row[terms] >= 0]
                    if not len(here):
                        continue
                    old_ids, old = top[k]
                    bound = int(old[-1]) if len(old) == best else 1  # what a task has found bounds its later blocks
                    columns, sums = searcher.search(row[here].astype(np.int64), weight[here], best, bound)
                    if len(columns):
                        both_ids, both = np.concatenate((old_ids, ids[columns])), np.concatenate((old, sums))
                        order = np.lexsort((both_ids, -both))[:best]
                        top[k] = (both_ids[order], both[order])
        counts = [len(t[0]) for t in top]
        yield pa.record_batch(
            [pa.array(np.repeat(np.array(item_ids, np.int64), counts)), pa.array(np.concatenate([t[0] for t in top])), pa.array(np.concatenate([t[1] for t in top]))], ["item_id", "doc_id", "score"]
        )

    return index.rows.mapInArrow(run, "item_id long, doc_id long, score long")


def search(index: Index, items: DataFrame, best: int = BEST, item_col: str = "item_id", text_col: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """The ``best`` documents of each item: item_id, rank (from 1), doc_id, score.

    A document scores, for each distinct term of the item, weight * (10^9 tf div (1000 tf + 8 m)):
    tf is how often the document has the term, m its length measure (:func:`measure`), and the weight
    floor(1000 ln((2 N + 2) / (2 df + 1))) for df of the N indexed documents with the term. Scores
    are whole numbers of 64 bits; equal ones are ranked by doc_id. Documents of score 0 are not returned.

    Items are a stated query set: they are taken in blocks of ``query_terms`` distinct terms an item, which the
    driver reads, and each block passes over the index once. Items with a null id or text, or without
    a term of the index, have no rows; rows of one item_id are one item. Empty tables give an empty result.
    """
    terms = common.materialize(item_terms(items, item_col, text_col), "items")
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks, found = -(-total // query_terms), None
    for b in range(blocks):
        asked = sorted(terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect())
        if asked:
            own = _ranked(index, asked, best)
            found = own if found is None else found.unionByName(own)
    if found is None:
        return index.rows.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def op11(spark, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    index = build_index(common.documents(spark, sf_dir, common.ENCODE_BYTES))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: What op11 returns, by joins of all terms.
OP11_SQL = r"""
with docs as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents where text is not null),
lengths as (select doc_id, len(terms)::bigint as n from docs where len(terms) > 0),
totals as (select count(*) as n_docs, sum(n)::bigint as n_terms from lengths),
tf as (select doc_id, term, count(*) as tf from (select doc_id, unnest(terms) as term from docs) group by all),
weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from tf group by term), totals),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
measures as (select doc_id, 100 - 90 + (90 * n * n_docs) // n_terms as m from lengths, totals),
scores as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint as score from asked join tf using (term) join weights using (term) join measures using (doc_id) group by item_id, doc_id),
ranked as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
