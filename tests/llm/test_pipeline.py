"""The pipeline's stages against brute force over the smallest tables."""

import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lapforge.llm import common, decontaminate, packing  # noqa: E402
from tests.llm.test_operators import SCHEMA, WORDS, brute_components, lower  # noqa: E402

ITEM = " ".join(f"item{k}" for k in range(20))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    filler = lambda s, n=40: " ".join(f"{s}{k}" for k in range(n))
    texts = [filler("alpha"), filler("alpha"), filler("alpha") + " extra", filler("beta") + " " + ITEM, "123 ...", None, filler("gamma") + " x.y@mail.org", filler("delta", 3000), "", filler("beta")]
    rows = [(i, t, None if i == 9 else "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_take_effect_and_keep_clean_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, tables), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
        kept[name] = sorted(r["doc_id"] for r in docs.collect())
        if name == "pii_surrogates":
            text = {r["doc_id"]: r for r in docs.collect()}
    assert kept["language_id"] == [0, 0, 1, 2, 3, 6, 7, 9]
    assert kept["near_duplicates"] == [0, 3, 6, 7, 9]
    assert kept["benchmark_decontamination"] == kept["pii_surrogates"] == [0, 6, 7, 9]
    assert "x.y@mail.org" not in text[6]["text"] and re.search(r"\S+@\S+\.org$", text[6]["text"]) and text[6]["n_chars"] == len(text[6]["text"])
    assert text[9]["lang"] == "en"
    assert set(kept["best_fit_packing"]) == {0, 6, 7, 9}
    rows = docs.collect()
    assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) + 1


CLASHING = {"score": "x", "lang_pred": 1, "_k": 2.0, "found": None, "class_id": "a", "component_id": "b", "rank": "c", "_maybe": True, "_at": 1, "_bits": 2, "_word": 3, "n_entities": "many", "entity_kinds": 7, "pii": "p", "text_hash": "h", "token": 1}


def clashing(df):
    return df.withColumns({k: F.lit(v) for k, v in CLASHING.items()}).withColumn("tags", F.create_map(F.lit("a"), F.lit("b")))


def test_stages_take_empty_tables_and_clashing_columns(spark, tables):
    docs = clashing(spark.read.parquet(f"{tables}/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), tables)
        assert empty.count() == 0
        out = stage(spark, docs, tables)
        if name != "best_fit_packing":
            assert out.columns == empty.columns == docs.columns
            rows = out.collect()
            assert rows and all(r[k] == v for r in rows for k, v in CLASHING.items()) and rows[0]["tags"] == {"a": "b"}


def test_rows_with_repeated_and_null_ids(spark, tables):
    filler = lambda s, n=40: " ".join(f"{s}{k}" for k in range(n))
    a, b, c = filler("a"), filler("b"), filler("c")
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, c), (4, c), (4, c + " more"), (5, None), (5, None), (6, ""), (None, a), (None, a), (None, None), (7, filler("d") + " " + ITEM), (7, filler("e")), (None, ITEM)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    stages = dict(corpus_pipeline.STAGES)
    order = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    # of (2, a) and (2, b) the first is near (1, a); of 4's three near rows one stays
    got = order(stages["near_duplicates"](spark, docs, tables))
    four = [x for x in got if x[0] == 4]
    assert len(four) == 1 and four[0][1] in (c, c + " more")
    assert [x for x in got if x[0] != 4] == sorted([(1, a), (2, b), (5, None), (6, ""), (None, a), (None, None), (7, rows[13][1]), (7, rows[14][1]), (None, ITEM)], key=str)
    clean = order(stages["benchmark_decontamination"](spark, docs, tables))
    assert clean == sorted([x for x in rows if x[0] != 7 and x[1] != ITEM], key=str)


def test_run_equals_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    with_letters = sorted(i for i, t in docs.items() if any(c.isalpha() for c in t or ""))
    comp = brute_components([docs[i] for i in with_letters])
    first = [i for k, i in enumerate(with_letters) if comp[k][1] == k]
    grams = {tuple(w[k : k + 8]) for t in items for w in [WORDS.findall(lower(t))] for k in range(len(w) - 7)}

    def leaks(t):
        w = WORDS.findall(lower(t))
        return sum(tuple(w[k : k + 8]) in grams for k in range(len(w) - 7))

    got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    # a whole item shares many runs of eight words; a clean text shares none
    assert {i for i in first if leaks(docs[i]) == 0} <= got <= set(first)
    assert not {i for i in first if leaks(docs[i]) >= 6} & got
