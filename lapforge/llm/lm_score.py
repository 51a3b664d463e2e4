"""Language-model scores of whole documents.

Unigram counts are taken over all training documents, and the recurrent model learns from all their
words. Each task trains its own copy of the model on its part of the documents, and the copies are
averaged by the words that they learned from; a few rounds share the documents out, each document
in one round. The model knows the most frequent words, and a word outside its vocabulary is scored
as unknown times its share of the unknown words by the counts of the whole corpus.

Counts come back to the documents in two ways. A table of the most frequent words, of bounded size,
is broadcast; the other words of each document are joined with their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .gru import END, UNKNOWN, Model, Trainer
from .words import split_hashes

#: Words whose counts are broadcast, at most; and words that the model knows.
FREQUENT, VOCABULARY = 200_000, 2046
#: Size of the model: classes of words, numbers of an input word and of the state.
CLASSES, INNER, STATE = 40, 12, 16
#: Where the rounds end, as shares of the training documents: short ones first, which bring the copies together.
ROUNDS = (1 / 16, 1 / 4, 1.0)
#: Parts in which the copies of a model are added up.
SLICES = 16
#: Distinct words after which a counting task writes what it has, and words that are scored together.
COUNT_AT, SCORE_AT = 1 << 20, 1 << 20


def _own(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a batch's distinct words as signed numbers, each word's place among them, and where texts begin."""
    hashes, codes, at = split_hashes(batch.column("text"))
    return hashes.view(np.int64), codes, at


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): how often each word, by its 64-bit hash, is in the column ``text``."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged():
            both = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            word, where = np.unique(both[0], return_inverse=True)
            return word, np.bincount(where, weights=both[1], minlength=len(word)).astype(np.int64)

        for batch in batches:
            hashes, codes, _ = _own(batch)
            if len(codes):
                parts.append((hashes, np.bincount(codes, minlength=len(hashes))))
                held += len(hashes)
            if held > COUNT_AT:
                parts = [merged()]
                held = len(parts[0][0])
                if held > COUNT_AT // 2:
                    yield pa.record_batch([pa.array(parts[0][0]), pa.array(parts[0][1])], ["word", "n"])
                    parts, held = [], 0
        if parts:
            word, n = merged()
            yield pa.record_batch([pa.array(word), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` words with the highest counts, sorted by word. Of the words about the last count that fits, a share by hash."""
    grade = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    left, last, share = most, -1, 0.0
    # a few hundred grades, however many words there are
    for r in counts.groupBy(grade.alias("g")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("g")).collect():
        if r["k"] > left:
            last, share = r["g"], left / r["k"]
            break
        left -= r["k"]
    place = F.pmod(F.xxhash64("word", F.lit(11)), F.lit(1 << 40)) / float(1 << 40)
    rows = counts.where((grade > last) | ((grade == last) & (place < share))).toArrow()
    word, n = rows.column("word").to_numpy(), rows.column("n").to_numpy()
    top = np.lexsort((word, -n))[:most]
    order = top[np.argsort(word[top])]
    return word[order], n[order]


def _look_up(table: np.ndarray, values: np.ndarray, keys: np.ndarray, missing: int) -> np.ndarray:
    """Values at the keys in a sorted table."""
    if not len(table):
        return np.full(len(keys), missing, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], missing)


def _round(docs: DataFrame, model: Model, known: np.ndarray, numbers: np.ndarray) -> Model:
    """The mean of the models that tasks train, from ``model`` on, on their documents: weighted by their words."""
    held = docs.sparkSession.sparkContext.broadcast((model, known, numbers))
    cuts = np.linspace(0, len(model.flat), SLICES + 1).astype(int)
    names, types = ["slice", "learned", "parameters"], (pa.int32(), pa.int64(), pa.binary())

    @common.tidy
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, known, numbers = held.value
        trainer = Trainer(Model(start.starts, start.inner, start.state, start.flat.copy()))
        for batch in batches:
            hashes, codes, at = _own(batch)
            stream, _ = _streams(_look_up(known, numbers, hashes, UNKNOWN)[codes], at)
            trainer.add(stream)
        own = trainer.finish().flat.astype(np.float64) * trainer.learned
        if trainer.learned:
            yield pa.record_batch([pa.array(range(SLICES), types[0]), pa.array([trainer.learned] * SLICES, types[1]), pa.array([own[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], types[2])], names)

    @common.tidy
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for k, n, raw in zip(*(batch.column(c).to_pylist() for c in names)):
                have = sums.setdefault(k, [0, 0.0])
                have[0] += n
                have[1] = have[1] + np.frombuffer(raw)
        for k, (n, total) in sums.items():
            yield pa.record_batch([pa.array([k], types[0]), pa.array([n], types[1]), pa.array([total.tobytes()], types[2])], names)

    schema = "slice int, learned long, parameters binary"
    # each task hands over one model; a part of it is added up in a task, and SLICES rows come to the driver
    copies = common.materialize(docs.select("text").mapInArrow(train, schema), "trained")
    rows = copies.repartition(SLICES, "slice").mapInArrow(add, schema).collect()
    flat = model.flat.copy()
    for r in rows:
        flat[cuts[r["slice"]] : cuts[r["slice"] + 1]] = np.frombuffer(r["parameters"]) / r["learned"]
    return Model(model.starts, model.inner, model.state, flat)


def _streams(numbers: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A batch's words with an end mark behind each text, and each word's text."""
    k = len(at) - 1
    text = np.repeat(np.arange(k), np.diff(at))
    stream = np.full(len(numbers) + k, END)
    stream[np.arange(len(numbers)) + text] = numbers
    return stream, text


def learn(docs: DataFrame, word: np.ndarray, n: np.ndarray, total: int, texts: int, vocabulary: int) -> tuple[Model, np.ndarray, np.ndarray]:
    """The model, and the words it knows with their numbers, sorted by word. ``docs``: training documents."""
    top = np.lexsort((word, -n))[:vocabulary]
    known = word[top]
    order = np.argsort(known)
    known, numbers, known_n = known[order], 2 + order, n[top]
    model = Model.new(np.concatenate(([total - known_n.sum(), texts], known_n)), CLASSES, INNER, STATE)
    place = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20)) / float(1 << 20)
    if texts:
        for low, high in zip((0.0, *ROUNDS), ROUNDS):
            model = _round(docs.where((place >= low) & (place < high)), model, known, numbers)
    return model, known, numbers


def score_documents(docs: DataFrame, holdout: tuple[int, int] | None = (7, 2), id_col: str = "doc_id", text_col: str = "text", most: int = FREQUENT, vocabulary: int = VOCABULARY) -> DataFrame:
    """Unigram and recurrent log10 probabilities of every whole text.

    Returns doc_id, held_out, n_tokens, n_known (tokens of the training documents), train_tokens,
    base_score and score. Tokens are the words (cut at white space, A-Z lower-cased) and an end mark.
    base_score: sum of log10((c + 1) / (N + V + 1)) over the tokens. Learns from documents whose
    crc32(doc_id as text) modulo holdout[0] is not holdout[1] (None: all).

    Null text: empty, so its end mark alone. A null id is never held out. Without training documents
    N, V and n_known are 0, base_score is 0 and the model knows no word. Repeated rows are kept. An
    empty table gives an empty result. Other columns are not read.

    The model learns from every word of all training documents. Which documents a task trains on
    follows how Spark splits the input, so ``score`` can differ a little between layouts of one table.
    """
    if most < vocabulary:
        raise ValueError("the model's words must be among the frequent ones")
    out = common.held_out("doc_id", *holdout) if holdout else F.lit(False)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    train = docs.where(~out)
    counts = common.materialize(count_words(train), "word-counts")
    words, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    texts = train.count()
    total, distinct = words + texts, types + (texts > 0)
    word, n = frequent(counts, most)
    model, known, numbers = learn(train, word, n, words, texts, vocabulary)
    known_n = _look_up(word, n, known, 0)
    # unknown words share P(unknown) by their counts plus 1; one more stands for all never seen
    rest = np.log10(words - known_n.sum() + (types - len(known)) + 1.0)
    held = spark.sparkContext.broadcast((model, known, numbers, word, n))
    base = float(np.log10(total + distinct + 1))

    @common.tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, numbers, word, n = held.value
        task, done = TaskContext.get().partitionId(), 0
        texts_ids: list = []
        texts_out: list[bool] = []
        parts: list[tuple] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            nonlocal done, texts_ids, texts_out, parts, waiting
            stream = np.concatenate([p[0] for p in parts])
            sizes = np.concatenate([p[1] for p in parts])
            got = model.log10_likelihoods(stream, np.concatenate(([0], np.cumsum(sizes))))
            k = len(sizes)
            row = (task << 33) + done + np.arange(k)
            done += k
            batch = pa.record_batch(
                [pa.array(row), pa.array(texts_ids, pa.int64()), pa.array(texts_out), pa.array(sizes), *(pa.array(np.concatenate([p[j] for p in parts])) for j in (2, 3)), pa.array(got + np.concatenate([p[4] for p in parts])), pa.array([x for p in parts for x in p[5]], pa.list_(pa.int64())), pa.array([x for p in parts for x in p[6]], pa.list_(pa.int32()))],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "words", "times"],
            )
            texts_ids, texts_out, parts, waiting = [], [], [], 0
            return batch

        for batch in batches:
            hashes, codes, at = _own(batch)
            k, sizes = len(at) - 1, np.diff(at)
            c = _look_up(word, n, hashes, 0)
            number = _look_up(known, numbers, hashes, UNKNOWN)
            stream, doc_of = _streams(number[codes], at)
            logs = np.log10(c + 1.0)
            seen = np.bincount(doc_of, weights=c[codes] > 0, minlength=k).astype(np.int64)
            sums = np.bincount(doc_of, weights=logs[codes], minlength=k).astype(np.float64)
            odd = (number == UNKNOWN)[codes]
            unknown = np.bincount(doc_of, weights=np.where(odd, logs[codes] - rest, 0.0), minlength=k).astype(np.float64)
            rare = np.flatnonzero((c == 0)[codes])
            pairs, times = np.unique(doc_of[rare] * max(len(hashes), 1) + codes[rare], return_counts=True)
            cuts = np.searchsorted(pairs // max(len(hashes), 1), np.arange(k + 1))
            own = hashes[pairs % max(len(hashes), 1)] if len(pairs) else np.zeros(0, np.int64)
            texts_ids += batch.column("doc_id").to_pylist()
            texts_out += batch.column("held_out").to_pylist()
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
            parts.append((stream, sizes + 1, seen, sums, unknown, [own[a:b] for a, b in spans], [times[a:b].astype(np.int32) for a, b in spans]))
            waiting += len(stream)
            if waiting >= SCORE_AT:
                yield flush()
        if parts:
            yield flush()

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, words array<long>, times array<int>"
    scored = common.materialize(docs.withColumn("held_out", out).mapInArrow(score, schema), "scores")
    # words outside the broadcast table, with their counts
    rare = scored.select("row", F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("k"))).alias("x")).select("row", "x.word", "x.k")
    found = rare.join(counts, "word").groupBy("row").agg(F.sum("k").alias("rare_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1.0)).alias("rare_logs"))
    whole = scored.drop("words", "times").join(found, "row", "left").fillna(0, ["rare_known", "rare_logs"])
    end_known, end_log = (1, float(np.log10(texts + 1.0))) if texts else (0, 0.0)
    return whole.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("rare_known") + end_known).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") + end_log - F.col("n_tokens") * base).alias("base_score"),
        (F.col("score") + F.col("rare_logs")).alias("score"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return score_documents(common.documents(spark, sf_dir))
