"""A training corpus from raw documents: language, near duplicates, benchmark items, personal data, packing.

Each stage takes all that the one before kept, as (spark, docs, sf_dir), and returns the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lapforge.llm import common, decontaminate, jaccard, langid, packing, pii


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is learned from the labelled ones; lang becomes the language found.

    Texts that are null, hold no letter, or need ``langid.FOREIGN`` times the phrases of any learned
    language go; without labelled documents all go. Rows are judged one by one, so repeated rows and ids
    stay as they are, and other columns, whatever their names, are passed on. Empty in, empty out.
    """
    common.prepare(spark)
    languages = langid.learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))
    own = common.free_name(docs, "found")
    found = docs.withColumn(own, langid.identified(spark, languages, F.col("text")))
    found = found.where((F.col(own)["lang_pred"] != langid.UNKNOWN) & (F.col(own)["phrases"] < langid.FOREIGN))
    return found.withColumn("lang", F.col(own)["lang_pred"]).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): that with the smallest doc_id.

    Of rows that repeat an id, those with a text in a group are judged by their own text, and of a group
    that the id heads one row stays; of those without words one of each text. Rows without an id cannot
    head a group and stay, but for exact repeats of a text. Null and empty texts are in no group. Other
    columns, whatever their names, are passed on. Empty in, empty out.
    """
    common.prepare(spark)
    found = jaccard.jaccard_components(docs, n=5, percent=80)
    found = common.materialize(found.select("doc_id", "class_id", "component_class", "component_id"), "groups")
    dropped = found.where("doc_id <> component_id").select("doc_id")
    repeated = common.materialize(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    nameless = docs.where("doc_id is null")
    if repeated.isEmpty() and nameless.isEmpty():
        return common.without(docs, "doc_id", dropped)
    # rows whose id does not tell them apart: each finds its own class, and each group keeps one
    several = common.maybe_in(docs, "doc_id", repeated).join(repeated, "doc_id", "left_semi").select(docs.columns).unionByName(nameless)
    names = ["class_id", "component_class", "component_id", "rank"]
    own = {c: common.free_name(docs, c) for c in names}
    groups = found.where("class_id is not null").select("doc_id", *(F.col(c).alias(own[c]) for c in names[:3])).distinct()
    classed = jaccard.with_class(several, n=5, name=own["class_id"]).join(groups, ["doc_id", own["class_id"]], "left")
    heads = classed.where(F.col(own["component_id"]).isNull() | F.col("doc_id").isNull() | (F.col(own["component_id"]) == F.col("doc_id")))
    rest = [F.col(f.name) for f in docs.schema if f.name != "doc_id" and "map<" not in f.dataType.simpleString()]  # maps have no order
    group = F.when(F.col("doc_id").isNotNull(), F.col(own["component_class"]))
    order = Window.partitionBy("doc_id", group, F.when(group.isNull(), F.sha2("text", 256))).orderBy(own["class_id"], *rest)
    one = heads.withColumn(own["rank"], F.row_number().over(order)).where(F.col(own["rank"]) == 1).select(docs.columns)
    return common.without(docs.where("doc_id is not null"), "doc_id", dropped.unionByName(repeated)).unionByName(one)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Of rows that repeat an id all go if one holds an item. Rows without an id are judged by their text.
    Null and empty texts stay, and so does everything where there are no items. Other columns, whatever
    their names, are passed on. Empty in, empty out.
    """
    common.prepare(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = common.materialize(decontaminate.contaminated(docs, items).select("doc_id").distinct(), "contaminated")
    named, nameless = docs.where("doc_id is not null"), docs.where("doc_id is null")
    kept = common.without(named, "doc_id", found)
    if nameless.isEmpty():
        return kept
    key = common.free_name(docs, "text_hash")
    hashed = nameless.withColumn(key, F.xxhash64("text"))
    bad = decontaminate.contaminated(hashed.select(F.col(key).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(key)).distinct()
    return kept.unionByName(hashed.join(bad, key, "left_anti").select(docs.columns))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data; n_chars follows the new text.

    Every row stays. Null and empty texts stay as they are; repeated rows and ids are rows like others.
    Other columns, whatever their names, are passed on. Empty in, empty out.
    """
    common.prepare(spark)
    # the operator's columns may have the names of columns that are passed on
    away = {c: common.free_name(docs, f"kept_{c}") for c in docs.columns if c.lower() in pii.OWN_COLUMNS}
    out = pii.replace_entities(docs.withColumnsRenamed(away), pii.key_of(spark)).drop(*pii.OWN_COLUMNS).withColumnsRenamed({v: k for k, v in away.items()})
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 ids: a row for each piece of a document.

    Null and empty texts are one piece of one id. Null and repeated ids are rows like others. Other
    columns are not read. Empty in, empty out.
    """
    common.prepare(spark, common.ENCODE_BYTES)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_surrogates", pii_surrogates),
    ("best_fit_packing", best_fit_packing),
]

#: Language models, tokenizers and alignments are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read back before the next."""
    common.prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
