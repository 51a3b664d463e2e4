"""Ranked search, mixing and whitening against plain versions, and their edge cases."""

import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lapforge.llm import lexical, mixing, treap, whitening
from lapforge.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ranked search


def plain_search(docs, items, best=10):
    """Every document against every item, term by term."""
    tf = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t in docs if i is not None and t is not None]
    tf = [(i, c) for i, c in tf if c]
    n_docs, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None and t is not None:
            asked[i] |= set(TERM.findall(t.translate(LOWER)))
    out = set()
    for item, terms in asked.items():
        scores = []
        for doc, c in tf:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            s = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, doc))
        out |= {(item, k, doc, -s) for k, (s, doc) in enumerate(sorted(scores)[:best], 1)}
    return out


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_treap_finds_what_a_full_table_has(data):
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    rows, columns = (data.draw(st.integers(1, n)) for n in (60, 400))
    table = rng.integers(0, 4, (rows, columns)) * (rng.random((rows, columns)) < data.draw(st.sampled_from([0.02, 0.3, 1])))
    r, c = np.nonzero(table)
    if not len(r):
        return
    m = rng.integers(10, 500, columns)
    tree = treap.Searcher(treap.build(r, c, table[r, c].astype(np.int32), m), m)
    asked = np.unique(r[rng.integers(0, len(r), 8)])
    weights, k = rng.integers(1, 5000, len(asked)), data.draw(st.integers(1, 12))
    sums = weights @ treap.impact(table[asked], m[None, :])
    want = sorted((-int(s), j) for j, s in enumerate(sums.tolist()) if s > 0)[:k]
    got, found = tree.search(asked, weights, k)
    assert [(-int(s), int(j)) for j, s in zip(got, found)] == want


@pytest.mark.parametrize("texts", [["", None, "a", "Ab-ab  AB", "ñ\x00é x", " ", "日本 b1,c", "a" * 70000]])
def test_terms(texts):
    for a in (pa.array(texts), pa.array(["zz 1", *texts])[1:]):
        terms, codes, at = lexical.terms_of(a)
        names = terms.to_pylist()
        assert [[names[k] for k in codes[x:y]] for x, y in zip(at[:-1], at[1:])] == [TERM.findall((t or "").translate(LOWER)) for t in texts]
        assert lexical.lengths_of(a).tolist() == [len(TERM.findall((t or "").translate(LOWER))) for t in texts]


def test_search_edge_cases(spark):
    """Nulls, empty and very long texts, ties, repeated rows and ids, extra columns."""
    docs = [(k, f"common word{k % 7} w{k} " + "filler " * (k % 5)) for k in range(300)]
    docs += [(400, None), (None, "common word1"), (401, ""), (402, "!!"), (403, "common " * 50_000 + "rare"), (404, "Tie tie"), (404, "Tie tie"), (405, "tie TIE"), (3, "common again")]
    items = [(1, "Common WORD3 rare w17"), (2, "tie"), (3, None), (4, ""), (5, "absent"), (None, "common"), (6, "common"), (6, "word5"), (7, "filler " * 1000)]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, terms string").repartition(12)
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, score string")
    index = lexical.build_index(d, block_postings=150)
    assert index.rows.count() > 5
    want = plain_search(docs, items)
    for options in ({}, {"query_terms": 4}):
        assert {tuple(r) for r in lexical.search(index, q, **options).collect()} == want
    assert {r[2] for r in want if r[0] == 2} == {404, 405} and len([r for r in want if r[0] == 2]) == 3


def test_each_block_is_a_row_group_of_its_own(spark):
    """Writers and readers hold one row group, so it must not grow with a task's documents."""
    docs = spark.range(25_000).selectExpr("id as doc_id", "concat('a', id % 50, ' b', id) as text").coalesce(1)
    rows = lexical.build_index(docs, block_postings=10).rows
    (file,) = rows.inputFiles()
    stored = pq.ParquetFile(file.removeprefix("file://")).metadata
    # a block ends with an Arrow batch, so it is at most 10,000 documents here
    assert stored.num_rows > 1 and stored.num_row_groups == stored.num_rows == rows.count()


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search(lexical.build_index(docs), items).isEmpty()
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical.search(lexical.build_index(some), items.limit(0)).isEmpty()
    # the only term is in every document, and its weight is 0
    assert lexical.search(lexical.build_index(some), items).collect()[0]["score"] > 0
    many = spark.createDataFrame([(k, "a") for k in range(3000)], "doc_id long, text string")
    assert lexical.search(lexical.build_index(many), items).isEmpty()


def test_op11_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert {tuple(r) for r in QUERIES["op11_ranked_search"](spark, sf_dir).collect()} == plain_search(docs, items)


# mixing


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets of sources in their order, as the words say: what is above a limit is shared again by weight."""
    w = [Fraction(weights[k % len(weights)]) for k in range(len(sizes))]
    target, open_, left = [Fraction(0)] * len(sizes), set(range(len(sizes))), Fraction(share) * sum(sizes)
    while open_ and left:
        total = sum(w[k] for k in open_)
        for k in open_:
            target[k] += left * w[k] / total
        left = sum(max(target[k] - most * sizes[k], 0) for k in open_)
        target = [min(t, Fraction(most * n)) for t, n in zip(target, sizes)]
        open_ = {k for k in open_ if target[k] < most * sizes[k]}
    return target


def check_mix(rows, docs):
    """rows: doc_id, size, source_size, target, taken; docs: doc_id -> (text, source)."""
    size = {i: len(WORD.findall(t or "")) for i, (t, _) in docs.items()}
    names = sorted({s for _, s in docs.values()}, key=lambda s: (s is None, s or ""))
    total = [sum(size[i] for i, (_, s) in docs.items() if s == n) for n in names]
    targets, taken = plain_targets(total), Counter()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        k = names.index(docs[r["doc_id"]][1])
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[k])
        assert abs(r["target"] - float(targets[k])) <= 1e-9 * max(total[k], 1)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[k] += r["taken"]
    assert all(abs(taken[k] - t) <= 0.5 for k, t in enumerate(targets))


def test_op12_query(spark, sf_dir):
    docs = {r["doc_id"]: (r["text"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op12_source_mix"](spark, sf_dir).collect()
    check_mix(rows, docs)
    again = QUERIES["op12_source_mix"](spark, sf_dir).collect()
    assert sorted(rows) == sorted(again)


def test_mix_edge_cases(spark):
    """Null text, source and id, empty and very long texts, a hot source, sources without words, clashing names."""
    docs = [(k, "w " * (k % 40), "hot" if k % 3 else f"s{k % 8}") for k in range(600)]
    docs += [(1000, None, "empty"), (1001, "", "empty"), (1002, "x " * 70_000, "long"), (1003, "a\tb\x0bc\x0cd\r\ne f", None), (1004, "z", "Ω"), (1005, "y y", "z\U0001f600")]
    d = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in docs], "doc_id long, text string, source string, size int, number int")
    found = mixing.mix(d.repartition(7), block_words=64, shard_slots=100)
    check_mix(found.groupBy("doc_id", "size", "source_size", "target").agg(F.sum("taken").alias("taken")).collect(), {i: (t, s) for i, t, s in docs})
    # equal tables, laid out otherwise
    other = mixing.mix(d.repartition(3, "doc_id"), block_words=64, shard_slots=100)
    assert sorted(map(str, other.collect())) == sorted(map(str, found.collect()))
    # another seed, another order, the same words a source
    assert sorted(map(str, mixing.mix(d, seed=1, block_words=64, shard_slots=100).collect())) != sorted(map(str, found.collect()))
    # slots hold blocks of one length, each of a source's blocks at most twice, and pieces that adjoin
    slots = defaultdict(list)
    for r in found.where("taken > 0").collect():
        slots[r["number"], r["slot"]].append((r["at"], r["taken"], r["block"], r["shard"]))
    for parts in slots.values():
        parts.sort()
        assert all(p[0] == sum(q[1] for q in parts[:k]) for k, p in enumerate(parts)) and sum(p[1] for p in parts) <= 64
        assert len({p[2:] for p in parts}) == 1
    uses = Counter((n, parts[0][2]) for (n, _), parts in slots.items())
    assert max(uses.values()) == 2
    # shards draw from the sources as their targets say
    shards = Counter(parts[0][3] for parts in slots.values())
    assert len(shards) > 10 and max(shards.values()) < 3 * np.mean(list(shards.values()))


def test_mix_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c", "s")] * 3 + [(1, "a b", "s"), (None, "q r", "s"), (None, None, "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(d)
    assert found.agg(F.sum("taken")).first()[0] == 20  # 13 words, 150 %: 19.5
    assert found.groupBy("doc_start", "size").agg(F.sum("taken").alias("t")).where("t > 2 * size").isEmpty()
    assert found.count() >= 6 and mixing.mix(d.limit(0)).isEmpty()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permuted_is_a_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long"))).collect()]
    assert sorted(got) == list(range(n)) and (n < 64 or got != sorted(got))
    if n == 1000:  # neighbours part
        assert abs(np.corrcoef(got, range(n))[0, 1]) < 0.15


# whitening


def plain_whitening(vectors, k=4):
    x = {i: tuple(floor(256 * float(c)) for c in v) for i, v in vectors.items()}
    listed = sorted(set(x.values()))
    n, d = len(listed), len(listed[0])
    s = [sum(v[i] for v in listed) for i in range(d)]
    own = np.array([[n * v[i] - s[i] for i in range(d)] for v in listed], object)
    cov = np.array([[float(Fraction(int((own[:, i] * own[:, j]).sum()), n**3)) for j in range(d)] for i in range(d)])
    values, vectors_ = np.linalg.eigh(cov)
    values, vectors_ = values[::-1], vectors_[:, ::-1]
    out = {}
    for i, v in x.items():
        c = np.array([v[a] - s[a] / n for a in range(d)])
        out[i] = (sum((n * v[a] - s[a]) ** 2 for a in range(d)), (c @ vectors_[:, :k]) / np.sqrt(values[:k]))
    return n, out, values / np.trace(cov)


def check_whitening(rows, vectors, k=4):
    n, want, explained = plain_whitening(vectors, k)
    got = defaultdict(dict)
    for r in rows:
        got[r["vec_id"]][r["component"]] = r
    assert set(got) == set(want) and len(rows) == k * len(want)
    signs = None
    for i, (deviation, white) in want.items():
        own = [got[i][c + 1] for c in range(k)]
        assert {(r["n"], int(r["deviation"])) for r in own} == {(n, deviation)}
        w = np.array([r["whitened"] for r in own])
        signs = np.sign(w * white) if signs is None else signs
        assert np.allclose(w * signs, white, atol=1e-7)
        assert np.allclose([r["explained"] for r in own], explained[:k], rtol=1e-9) and own[0]["identity_error"] < 1e-5


def test_op13_query(spark, sf_dir):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    check_whitening(QUERIES["op13_whitening"](spark, sf_dir).collect(), vectors)


def test_whitening_edge_cases(spark):
    """Left-out vectors, repeats, a third of all rows alike, large entries, clashing names."""
    rng = np.random.default_rng(3)
    good = {k: rng.normal(size=5) * [1, 2, 3, 4, 1e5] for k in range(80)} | {k: np.ones(5) for k in range(100, 140)}
    bad = [(500, None), (501, [1.0, None, 2.0, 3.0, 4.0]), (502, [float("nan")] * 5), (503, [1.0, 2.0, 3.0, 4.0, float("-inf")]), (504, [1e30, 0.0, 0.0, 0.0, 0.0]), (505, [1.0, 2.0]), (506, [])]
    rows = [(k, [float(c) for c in v]) for k, v in good.items()] + bad
    d = spark.createDataFrame([(k, v, 0.5, 7) for k, v in rows], "vec_id long, embedding array<double>, whitened double, n int").repartition(6)
    check_whitening(whitening.whiten(d).collect(), good)
    twice = whitening.whiten(d.union(d))
    assert twice.count() == 8 * len(good) and {r["n"] for r in twice.select("n").distinct().collect()} == {81}


def test_whitening_without_variance(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(d).isEmpty() and whitening.whiten(d.limit(0)).isEmpty()
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    found = whitening.whiten(line).collect()
    assert {(r["vec_id"], r["component"], r["n"], abs(round(r["whitened"], 9))) for r in found} == {(1, 1, 2, 1.0), (2, 1, 2, 1.0), (None, 1, 2, 1.0)}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([3, 100, 2**20, 2**31, 2**45, 2**61]))
def test_square_sums_are_exact(seed, size):
    c = np.random.default_rng(seed).integers(-size, size, (7, 4))
    own = [[int(v) for v in r] for r in c]
    want = [sum(r[i] ** 2 for r in own) for i in range(4)] + [sum((r[i] + r[j]) ** 2 for r in own) for i in range(4) for j in range(i + 1, 4)]
    assert whitening.square_sums(c) == want
