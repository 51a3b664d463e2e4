"""Every registered query over the smallest tables, whole, against brute force or SQL."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pytest

from lapforge.llm import decontaminate, fingerprints, licences
from lapforge.llm.queries import QUERIES, SQL
from lapforge.llm.tokens import PieceEncoder
from tests.llm.test_operators import WORDS, brute_components, brute_edited, lower, one_by_one, tokenizer  # noqa: F401


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: QUERIES[name](spark, sf_dir).collect()


def by_id(rows, docs):
    out = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(out) == len(docs)
    return out


def test_op1(run, docs):
    got, ids = by_id(run("op1_fingerprints"), docs), sorted(docs)
    names = {}
    for k, (text, new, after) in brute_edited([docs[i]["text"] for i in ids]).items():
        r, forms = got[ids[k]], [fingerprints.canonical(x) for x in (text, new, after)]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (float(forms[0] == forms[1]), float(forms[0] == forms[2]))
        assert all(names.setdefault(f, n) == n for f, n in zip(forms, (r["fingerprint"], r["edited_fingerprint"])))
    assert len(set(names.values())) == len(names)


def test_op2(spark, sf_dir, run, docs):
    """Smith-Waterman of all pairs, whole tables, two rows at a time."""
    items = {r["item_id"]: WORDS.findall(lower(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    codes = {}
    coded = lambda words: np.array([codes.setdefault(w, len(codes)) for w in words], np.uint64)
    owned, want = {i: coded(w) for i, w in items.items()}, {}
    for d, r in docs.items():
        text = coded(WORDS.findall(lower(r["text"])))
        for i, x in owned.items():
            s = row_scores(x, text)
            if s >= 2 * decontaminate.LEAST_SCORE * len(x) or s >= 2 * decontaminate.LEAST_WORDS:
                want[d, i] = s / (2 * len(x))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in run("op2_decontaminate")}
    assert want and got == want and min(map(len, items.values())) >= decontaminate.SHORT_ITEM


def row_scores(item, text):
    """Best local score by rows of the table; a row's gaps are found step by step until nothing changes."""
    above, best = np.zeros(len(text) + 1, np.int64), 0
    for x in item:
        row = np.concatenate(([0], np.maximum(np.maximum(above[:-1] + np.where(text == x, 2, -1), above[1:] - 1), 0)))
        while (row[1:] < row[:-1] - 1).any():
            row[1:] = np.maximum(row[1:], row[:-1] - 1)
        above, best = row, max(best, int(row.max()))
    return best


def test_op3(run, docs):
    got, ids = by_id(run("op3_jaccard_join"), docs), sorted(docs)
    for k, (n, component, links) in brute_components([docs[i]["text"] for i in ids]).items():
        r = got[ids[k]]
        assert (r["n_shingles"], r["component_id"], r["n_links"]) == (n, ids[component], links)


def test_op4(run, docs, tokenizer):  # noqa: F811
    got, before = by_id(run("op4_token_files"), docs), 0
    ids = sorted(docs)
    for i, e in zip(ids, PieceEncoder(tokenizer).tokenizer.encode_batch([docs[i]["text"] or "" for i in ids], add_special_tokens=False)):
        own = np.array([*e.ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (before, len(own), zlib.crc32(own.tobytes()))
        before += len(own)


def test_op5(run, docs, tokenizer):  # noqa: F811
    rows, ids, pieces = run("op5_best_fit_packing"), sorted(docs), {}
    for i, e in zip(ids, PieceEncoder(tokenizer).tokenizer.encode_batch([docs[i]["text"] or "" for i in ids], add_special_tokens=False)):
        own = np.array([*e.ids, 0], "<u4")
        for k, s in enumerate(range(0, len(own), 2048)):
            pieces[i, k] = (s, len(own[s : s + 2048]), zlib.crc32(own[s : s + 2048].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == pieces and len(rows) == len(pieces)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(o == sum(n for p, n in b if p < o) and sum(n for _, n in b) <= 2048 for b in bins.values() for o, _ in b)
    assert len(bins) == len(one_by_one([n for _, n, _ in pieces.values()], 2048))


def test_op6(spark, sf_dir, run):
    c = duckdb.connect()
    for t in ("pages", "events"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = c.execute(SQL["op6_url_lists"])
    names = [d[0] for d in found.description]
    got = [tuple(r[n] for n in names) for r in run("op6_url_lists")]
    assert sorted(got, key=str) == sorted(found.fetchall(), key=str) and any(r[names.index("listed")] for r in got)


def test_op7(run, docs):
    got = by_id(run("op7_language_id"), docs)
    letters = {i for i, r in docs.items() if any(c.isalpha() for c in r["text"] or "")}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i]["score"] <= 1 for i in docs)
    assert {i for i in docs if got[i]["lang_pred"] == "und"} == set(docs) - letters
    held = [i for i in letters if got[i]["held_out"] and docs[i]["lang"]]
    assert np.mean([got[i]["lang_pred"] == docs[i]["lang"] for i in held]) >= 0.95


def test_op8(run, docs):
    got = by_id(run("op8_licences"), docs)
    for i, d in docs.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(d["text"]))
        hits = [(k, x) for p, x in licences.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r, base = got[i], sorted({x for _, x in hits})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(hits), ",".join(base))
        assert (r["first_word"], r["last_word"]) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert set(base) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_op9(run, docs):
    """Entities of a plainer search are gone, and texts without any are as they were."""
    got = by_id(run("op9_pii_surrogates"), docs)
    simple = re.compile(r"[\w.+-]+@[\w-]+\.[A-Za-z]{2,}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-])|AKIA[0-9A-Z]{16}|(?<=token = \")[0-9a-f]{20,}")
    kept = {}
    for i, d in docs.items():
        old, new = simple.findall(d["text"] or ""), got[i]["text"]
        for x in old:
            assert x not in new
        assert (new == d["text"]) == (got[i]["n_entities"] == 0) and (not old or got[i]["n_entities"] >= len(set(old)))
        for x, y in zip(old, simple.findall(new or "")):
            assert kept.setdefault(x.lower(), y.lower()) == y.lower()
    assert len(kept) > 5 and len(set(kept.values())) == len(kept)


def test_op10(run, docs):
    got = by_id(run("op10_lm_scores"), docs)
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    words = {i: [*WORDS.findall(lower(d["text"])), "\n"] for i, d in docs.items()}
    counts = Counter(w for i, ws in words.items() if not out[i] for w in ws)
    total, types = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r, want = got[i], sum(log10((counts[w] + 1) / (total + types + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(ws), sum(counts[w] > 0 for w in ws), total)
        assert abs(r["base_score"] - want) <= 1e-7 * abs(want)
    mean = lambda c: sum(got[i][c] for i in docs if out[i]) / sum(got[i]["n_tokens"] for i in docs if out[i])
    assert mean("score") > mean("base_score")
