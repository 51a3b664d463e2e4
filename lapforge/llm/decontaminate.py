"""Benchmark decontamination: rare two-word seeds of items, then Smith-Waterman alignment.

A seed is two words of an item, next to each other or with one between. An alignment over the
threshold has at least so many seeds of the item in a short stretch of the text, with no more between
their words there. So if all but a few seeds of an item are looked up, the rarest by their counts over
all documents, windows of a text that hold some of them are the candidates; a bound that no alignment
exceeds leaves out more, and what is left is aligned. No text over the threshold is missed, and a
phrase that all items share is no seed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import ngram_hashes, split_words, word_hashes

#: Items of fewer words than SHORT_ITEM must share so many words in a row: half of them may be two words.
RUN_WORDS, SHORT_ITEM = 3, 10
#: Alignment: a match, and a mismatch or gap. Scores are shares of a whole item's matches.
MATCH, PENALTY = 2, 1
#: An item is found at this share of itself, or with as much as so many words in a row.
LEAST_SCORE, LEAST_WORDS = 0.5, 13
#: Words of items that are held by each task at once; more items are taken in blocks.
BLOCK_WORDS = 1 << 20
#: Half a window of the shortest items; longer items have windows of four times the length, and so on.
LEAST_STRIDE = 64
#: Counters of windows and items that are held at once.
CELLS = 1 << 22


def align(item: np.ndarray, doc: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: the best local score, and the place in ``doc`` where it begins (at the latest) and ends (exclusive).

    A row of the table is computed at once: gaps along ``doc`` are a running maximum.
    """
    if not len(item) or not len(doc):
        return 0, 0, 0
    place = np.arange(len(doc), dtype=np.int64)
    above, above_from = np.zeros(len(doc) + 1, np.int64), np.arange(len(doc) + 1)
    best = (0, 0, 0)
    for word in item.tolist():
        step = np.where(doc == word, MATCH, -PENALTY)
        diagonal, down = above[:-1] + step, above[1:] - PENALTY
        row = np.maximum(diagonal, down)
        begin = np.where(diagonal >= down, above_from[:-1], above_from[1:])
        begin = np.where(row > 0, begin, place + 1)
        row = np.maximum(row, 0)
        lifted = row + PENALTY * place
        run = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == run, place, 0))
        row = run - PENALTY * place
        begin = np.where(row > 0, begin[source], place + 1)
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(begin[k]), k + 1)
        above, above_from = np.concatenate(([0], row)), np.concatenate(([0], begin))
    return best


def most_score(own: np.ndarray, doc: np.ndarray) -> int:
    """What no alignment of an item with ``doc`` exceeds. ``own``: the item's distinct words, sorted.

    Each aligned word of ``doc`` is a match at best if the item has it, and costs the penalty if not.
    """
    gain = np.where(own[np.minimum(np.searchsorted(own, doc), len(own) - 1)] == doc, MATCH, -PENALTY)
    total = np.concatenate(([0], np.cumsum(gain)))
    return int((total - np.minimum.accumulate(total)).max())


def needs(n: int, least_score: float, least_words: int) -> tuple[int, int, int]:
    """For an item of ``n`` words: how many seeds an alignment over the threshold holds, how many of them are looked for in a window, and the most words of a text that it spans.

    Between two matches that are no seed lie two errors at least, which cost what a match gains (two
    penalties); so of M matches at most one and those that end a seed add to the score, and a score
    needs as many seeds. Errors also bound the span.
    """
    least = min(math.ceil(MATCH * n * least_score), MATCH * least_words)
    held = max(0, -(-(least - MATCH) // MATCH))
    return held, (held + 1) // 2, n + max((MATCH * n - least) // PENALTY, 0)


def _pairs(codes: np.ndarray, ends: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, seed) of two known words at a distance of one and two in one text. ``codes``: words' numbers, -1 if unknown; ``ends``: where each place's text ends."""
    for apart in (1, 2):
        first, second = codes[:-apart], codes[apart:]
        at = np.flatnonzero((first >= 0) & (second >= 0) & (np.arange(len(first)) + apart < ends[: len(first)]))
        yield at, first[at] * words + second[at]


def item_seeds(words: np.ndarray, known: np.ndarray, held: int) -> np.ndarray:
    """Seeds of an item, one for each place and distance, as numbers by the sorted hashes ``known``; where no seed is certain, its words."""
    codes = np.searchsorted(known, words)
    if held < 1:
        return codes * len(known) + codes
    return np.concatenate([seed for _, seed in _pairs(codes, np.full(len(codes), len(codes)), len(known))])


@dataclass
class Seeds:
    """Seeds of items with windows of one length: sorted, and for each the items (with how many of their places) that have it; ``enough`` by item."""

    stride: int
    known: np.ndarray
    at: np.ndarray
    item: np.ndarray
    weight: np.ndarray
    enough: np.ndarray

    def windows(self, place: np.ndarray, seed: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, item) of windows that hold enough seeds. ``place``, ``seed``: where which seeds begin; ``starts``: where each text begins (one entry more).

        Texts are cut into halves of ``stride`` words, numbered through; window h is the half h and the
        next of the same text, so whatever spans at most ``stride`` words lies in a window whole.
        """
        found = np.minimum(np.searchsorted(self.known, seed), len(self.known) - 1)
        hit = np.flatnonzero(self.known[found] == seed)
        if not len(hit):
            return
        place, seed, first = place[hit], found[hit], self.first_half(starts)
        text = np.searchsorted(starts, place, side="right") - 1
        half = (place - starts[text]) // self.stride
        key = np.unique(np.concatenate([(first[text] + half) * len(self.known) + seed, ((first[text] + half - 1) * len(self.known) + seed)[half > 0]]))
        window, seed = key // len(self.known), key % len(self.known)
        many = np.diff(self.at)[seed]
        # as many windows together as the counters allow
        groups = np.searchsorted(window, np.arange(window[0], window[-1] + 1, max(1, CELLS // len(self.enough))))
        for a, b in zip(groups, [*groups[1:], len(window)]):
            if a == b:
                continue
            low, n = window[a], many[a:b]
            ends = np.cumsum(n)
            entry = np.repeat(self.at[seed[a:b]] - ends + n, n) + np.arange(ends[-1])
            cell = np.repeat(window[a:b] - low, n) * len(self.enough) + self.item[entry]
            cells, own = np.unique(cell, return_inverse=True)
            count = np.bincount(own, self.weight[entry]).astype(np.int64)
            full = cells[count >= self.enough[cells % len(self.enough)]]
            yield full // len(self.enough) + low, full % len(self.enough)

    def first_half(self, starts: np.ndarray) -> np.ndarray:
        """The number of each text's first half."""
        return np.concatenate(([0], np.cumsum(-(-np.diff(starts) // self.stride))))


def text_seeds(hashes: np.ndarray, code: np.ndarray, starts: np.ndarray, known: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray]:
    """Where which pairs of known words (sorted hashes) begin; with ``single`` also known words by themselves."""
    place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    codes = np.where(known[place] == hashes, place, -1)[code]
    parts = list(_pairs(codes, np.repeat(starts[1:], np.diff(starts)), len(known)))
    if single:
        at = np.flatnonzero(codes >= 0)
        parts.append((at, codes[at] * (len(known) + 1)))
    return np.concatenate([p for p, _ in parts]), np.concatenate([s for _, s in parts])


def _seeds(own: list[np.ndarray], sizes: list[tuple[int, int, int]], counts: dict[int, int]) -> list[Seeds]:
    """The rarest seeds of each item, by the length of their windows. ``own``: all seeds of each item, ``sizes``: what :func:`needs` says of it."""
    classes: dict[int, list[tuple[int, np.ndarray, int]]] = {}
    for k, (seeds, (held, enough, span)) in enumerate(zip(own, sizes)):
        if len(seeds):
            stride = LEAST_STRIDE
            while stride < span:
                stride *= 4
            kept = len(seeds) - max(held - enough, 0)
            rare = seeds[np.argsort([counts.get(x, 0) for x in seeds.tolist()], kind="stable")[:kept]]
            classes.setdefault(stride, []).append((k, rare, max(enough, 1)))
    out = []
    for stride, rows in sorted(classes.items()):
        pairs = [np.unique(rare, return_counts=True) for _, rare, _ in rows]
        known, place = np.unique(np.concatenate([w for w, _ in pairs]), return_inverse=True)
        order = np.argsort(place, kind="stable")
        item = np.repeat([k for k, _, _ in rows], [len(w) for w, _ in pairs])[order]
        enough = np.full(len(own), np.iinfo(np.int64).max)
        enough[[k for k, _, _ in rows]] = [e for _, _, e in rows]
        out.append(Seeds(stride, known, np.concatenate(([0], np.cumsum(np.bincount(place, minlength=len(known))))), item, np.concatenate([n for _, n in pairs])[order], enough))
    return out


def seed_counts(docs: DataFrame, known: np.ndarray, wanted: np.ndarray, single: bool) -> dict[int, int]:
    """How often each of the seeds (sorted) occurs in all texts."""
    held = docs.sparkSession.sparkContext.broadcast((known, wanted))

    @common.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = held.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            words, codes, starts = split_words(batch.column("text"))
            if len(codes):
                _, seed = text_seeds(word_hashes(words), codes, starts, known, single)
                place = np.minimum(np.searchsorted(wanted, seed), len(wanted) - 1)
                total += np.bincount(place[wanted[place] == seed], minlength=len(wanted))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["seed", "n"])

    # as many rows as the items have seeds
    found = docs.select("text").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).collect()
    return {int(wanted[r["seed"]]): r["n"] for r in found}


def _block(docs: DataFrame, item_ids: list[int], item_texts: list[str], least_score: float, least_words: int) -> DataFrame:
    """(doc_id, item_id, score, doc_start, doc_end) of one block of items against all documents."""
    words, codes, at = split_words(pa.array(item_texts, pa.string()))
    hashes = word_hashes(words)
    items = [hashes[codes[a:b]] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    schema = "doc_id long, item_id long, score double, doc_start long, doc_end long"
    if not len(hashes):
        return docs.sparkSession.createDataFrame([], schema)
    known, sizes = np.unique(hashes), [needs(len(w), least_score, least_words) for w in items]
    own, single = [item_seeds(w, known, held) if len(w) else np.zeros(0, np.int64) for w, (held, _, _) in zip(items, sizes)], any(held < 1 for held, _, _ in sizes)
    seeds = _seeds(own, sizes, seed_counts(docs, known, np.unique(np.concatenate(own)), single))
    runs = {k: np.unique(ngram_hashes(w, min(RUN_WORDS, len(w)))) for k, w in enumerate(items) if 0 < len(w) < SHORT_ITEM}
    held = docs.sparkSession.sparkContext.broadcast((known, seeds, items, [np.unique(w) for w in items], runs))

    @common.tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seeds, items, own_words, runs = held.value
        for batch in batches:
            own, codes, at = split_words(batch.column("text"))
            if not len(codes):
                continue
            hashes = word_hashes(own)
            texts = hashes[codes]
            place, seed = text_seeds(hashes, codes, at, known, single)
            ids, best = batch.column("doc_id").to_pylist(), {}
            for group in seeds:
                first = group.first_half(at)
                for windows, found in group.windows(place, seed, at):
                    text = np.searchsorted(first, windows, side="right") - 1
                    for w, d, k in zip(windows.tolist(), text.tolist(), found.tolist()):
                        start = at[d] + (w - first[d]) * group.stride
                        part = texts[start : min(start + 2 * group.stride, at[d + 1])]
                        whole = MATCH * len(items[k])
                        enough = min(least_score * whole, MATCH * least_words)
                        if most_score(own_words[k], part) < enough:
                            continue
                        points, begin, end = align(items[k], part)
                        if points >= enough:
                            shift = int(start - at[d])
                            best[d, k] = max(best.get((d, k), (0, 0, 0)), (points, -(shift + end), shift + begin))
            rows = []
            for (d, k), (points, end, begin) in best.items():
                if k in runs and not np.isin(ngram_hashes(texts[at[d] : at[d + 1]], min(RUN_WORDS, len(items[k]))), runs[k]).any():
                    continue
                rows.append((ids[d], item_ids[k], points / (MATCH * len(items[k])), begin, -end))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "doc_start", "doc_end"])

    scored = docs.mapInArrow(score, schema)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "doc_start", "doc_end")).alias("x"))
    return best.select("doc_id", "item_id", "x.*")


def contaminated(docs: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of documents and test items that they hold: doc_id, item_id, score, doc_start, doc_end.

    score is the best local alignment of the item's words with the whole text's, as a share of the
    item's own (1: word for word). A pair is returned from ``least_score`` on, or with an alignment
    worth ``least_words`` words in a row. Items of fewer than SHORT_ITEM words must also share
    RUN_WORDS words in a row (or all of theirs) with the text. doc_start and doc_end are the aligned
    words of the text. Words are cut at white space, A-Z lower-cased.

    Null or empty texts and items match nothing; rows with a null id are not compared. Of repeated
    pairs the best alignment stays. Empty tables give an empty result. Other columns are not read.

    Items are a stated query set: they are taken in blocks of bounded size against all documents,
    and each block passes over them twice: once to count its items' words, once to align.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.select(F.sum(F.size(F.split("text", "\\s+")))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    parts = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).distinct().collect()
        rows.sort()
        if rows:
            parts.append(_block(docs, [r["item_id"] for r in rows], [r["text"] for r in rows], least_score, least_words))
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, doc_start long, doc_end long")
    return reduce(DataFrame.unionByName, parts)


def op2(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
