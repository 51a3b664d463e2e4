"""Language identification by cross-parsing entropy.

A suffix automaton of each language's training text accepts exactly its substrings. Running text is
cut greedily into the longest phrases that the automaton accepts. A language's phrase count is
divided by the count that it needs for as much unseen text of its own, so languages with little and
with much training text compare; the language with fewest such normalised phrases wins.

Automata are built once, on the driver, and broadcast as flat tables of a few MB. A task moves all
windows of a batch's texts through a table at once, a character a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

#: Training sample of each language: documents, characters of each, and characters in all; and languages that are learned.
SAMPLE_DOCS, SAMPLE_DOC_CHARS, SAMPLE_CHARS, LANGUAGES = 200, 1000, 60_000, 500
#: Shares in which a language's sample is drawn, so that a frequent language is drawn by many tasks.
SHARES = 256
#: Normalised phrases a character from which a text is in none of the learned languages (they need about 1).
FOREIGN = 4.0
#: Characters of a window: a phrase ends with its window.
WINDOW = 1024

UNKNOWN = "und"


class SuffixAutomaton:
    """Accepts every substring of a text. ``next[s]`` maps a character to a state; 0 is the start."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            now = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy = len(self.next)
                    self.next.append(self.next[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse: each the longest substring of the training text, or one unseen character."""
        step, n, at = self.next, 0, 0
        state = step[0]
        for c in text:
            to = state.get(c)
            if to is None:
                n += at
                to = step[0].get(c)
                if to is None:
                    n += 1
                    state, at = step[0], 0
                    continue
            state, at = step[to], 1
        return n + at


@dataclass
class PhraseTable:
    """A suffix automaton with its transitions in one array: state s has one for character c if owner[base[s] + c] == s."""

    alphabet: np.ndarray
    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    first: np.ndarray
    rate: float = 1.0

    @classmethod
    def of(cls, text: str) -> PhraseTable:
        states = SuffixAutomaton(text).next
        letters = sorted(set(text))
        code, wide = {c: i for i, c in enumerate(letters)}, len(letters) + 1
        base, owner, target = [0] * len(states), [-1] * wide, [0] * wide

        def put(s: int, begin: int, moves: list[tuple[int, int]]) -> None:
            if (short := begin + wide - len(owner)) > 0:
                owner.extend([-1] * short)
                target.extend([0] * short)
            base[s] = begin
            for c, to in moves:
                owner[begin + c], target[begin + c] = s, to

        moves = [sorted((code[c], to) for c, to in n.items()) for n in states]
        # states with several transitions at places that fit, most first; those with one then fill the gaps
        at = 0
        for s in sorted((s for s in range(len(states)) if len(moves[s]) > 1), key=lambda s: -len(moves[s])):
            (c, _), tried = moves[s][0], 0
            while tried < 16 and at < len(owner):
                if owner[at] < 0 and at >= c:
                    if all(at - c + k >= len(owner) or owner[at - c + k] < 0 for k, _ in moves[s]):
                        break
                    tried += 1
                at += 1
            put(s, max(at - c, 0) if tried < 16 and at < len(owner) else len(owner), moves[s])
            at = max(at - 4 * wide, 0)
        free = iter([k for k in range(len(owner)) if owner[k] < 0])
        for s in range(len(states)):
            if len(moves[s]) == 1:
                c = moves[s][0][0]
                put(s, next((k - c for k in free if k >= c), len(owner)), moves[s])
        first = np.zeros(len(letters) + 1, np.int32)
        first[[c for c, _ in moves[0]]] = [to for _, to in moves[0]]
        flat = lambda x: np.array(x, np.int32)
        return cls(np.array([ord(c) for c in letters], np.uint32), flat(base), np.concatenate((flat(owner), np.full(len(letters) + 1, -1, np.int32))), np.concatenate((flat(target), np.zeros(len(letters) + 1, np.int32))), first)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Numbers of characters; those that the language lacks share the last one."""
        if not len(self.alphabet):
            return np.zeros(len(points), np.int32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at, len(self.alphabet)).astype(np.int32)

    def phrases(self, points: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each window points[begin : begin + size]: longest substrings of the training text, or one unseen character."""
        order = np.argsort(-sizes, kind="stable")
        begins, sizes, codes = begins[order], sizes[order], self.codes(points)
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")  # windows longer than t
        state, count = np.zeros(len(sizes), np.int32), np.zeros(len(sizes), np.int64)
        for t, n in enumerate(active.tolist()):
            c, s = codes[begins[:n] + t], state[:n]
            at = self.base[s] + c
            go = self.owner[at] == s
            to = np.where(go, self.target[at], self.first[c])
            count[:n] += (~go & (s > 0)).view(np.int8) + (to == 0).view(np.int8)
            state[:n] = to
        count += state > 0
        out = np.empty(len(sizes), np.int64)
        out[order] = count
        return out


def letters_of(texts: pa.Array) -> list[str]:
    """Texts in lower case with a blank for each run of what is neither a letter nor a mark on one, and at both ends. Without a letter: empty."""
    texts = pc.utf8_lower(pc.fill_null(texts, ""))
    cut = pc.binary_join_element_wise("", pc.utf8_trim(pc.replace_substring_regex(texts, r"[^\pL\pM]+", " "), " "), "", " ")
    return pc.if_else(pc.match_substring_regex(texts, r"\pL"), cut, "").to_pylist()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, begin and size of the windows of texts that stand one behind the other."""
    each = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), each)
    within = (np.arange(len(text)) - (np.cumsum(each) - each)[text]) * WINDOW
    return text, (np.cumsum(sizes) - sizes)[text] + within, np.minimum(WINDOW, sizes[text] - within)


def training_texts(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, doc_chars: int = SAMPLE_DOC_CHARS, chars: int = SAMPLE_CHARS, most: int = LANGUAGES) -> dict[str, str]:
    """A bounded sample of labelled text for each language: (doc_id, text, lang) rows -> language -> its running text.

    The documents are those whose hashed ids are smallest, so the sample does not depend on how rows
    are dealt to tasks. At most ``sample_docs * doc_chars`` characters of a language reach the driver.
    """
    known = docs.where("lang is not null and text is not null")
    # the languages with most labelled documents, one row each
    kept = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).select("lang")
    ids = known.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).join(F.broadcast(kept), "lang")
    ids = ids.withColumn("share", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(SHARES)))
    # the least hashes of a share, then of all shares: each task keeps no more than its part of a sample
    least = lambda rows, *by: rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))).where(F.col("r") <= sample_docs)
    some = least(least(ids, "lang", "share"), "lang")
    # at most sample_docs ids a language
    rows = known.select("doc_id", "lang", F.substring("text", 1, doc_chars).alias("text")).join(F.broadcast(some.select("doc_id", "lang").distinct()), ["doc_id", "lang"])
    found: dict[str, list] = {}
    for r in rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect():  # of rows with one id one text
        found.setdefault(r["lang"], []).append((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]))
    out = {}
    for lang in sorted(found):
        text = "".join(letters_of(pa.array([t for _, t in sorted(found[lang])])))[:chars]
        if text.strip():
            out[lang] = f" {text}"
    return out


@dataclass
class Languages:
    """Tables of all learned languages, by name."""

    names: list[str]
    tables: list[PhraseTable]

    @classmethod
    def learn(cls, texts: dict[str, str]) -> Languages:
        """``texts``: what :func:`letters_of` makes of each language's sample."""
        names = sorted(texts)
        return cls(names, [cls._table(texts[x]) for x in names])

    @staticmethod
    def _table(text: str) -> PhraseTable:
        """The automaton of a text, and the phrases a character that it expects of the language: half the text parsed by the other half's."""
        table, half = PhraseTable.of(text), text.find(" ", len(text) // 2) + 1
        rest = text[half:]
        if half > 2 and rest:
            found = SuffixAutomaton(text[:half]).phrases(rest) / len(rest)
            # phrases grow with the logarithm of what is known
            table.rate = float(found * log2(half) / log2(len(text)))
        return table

    def measure(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases a character of each text (rows) in each language, 1 where it is as expected; and the texts' characters."""
        made = letters_of(texts)
        sizes = np.fromiter(map(len, made), np.int64, len(made))
        points = _points("".join(made))
        text, begins, lengths = windows(sizes)
        out = np.zeros((len(made), len(self.names)))
        for k, table in enumerate(self.tables):
            out[:, k] = np.bincount(text, weights=table.phrases(points, begins, lengths), minlength=len(made)) / table.rate
        return out / np.maximum(sizes, 1)[:, None], sizes

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and normalised phrases a character of each text. Ties go to the language that sorts first."""
        found, sizes = self.measure(texts)
        if not self.names:
            return [UNKNOWN] * len(sizes), np.zeros(len(sizes)), np.zeros(len(sizes))
        best = found.argmin(axis=1)
        least = found[np.arange(len(best)), best]
        second = np.partition(found, 1, axis=1)[:, 1] if len(self.names) > 1 else least
        lead = least / np.maximum(second, 1e-9) if len(self.names) > 1 else np.zeros(len(best))
        score = np.where(sizes > 0, 1.0 - np.minimum(lead, 1.0) ** 8, 0.0)
        return [self.names[b] if n else UNKNOWN for n, b in zip(sizes.tolist(), best.tolist())], score, least


def learn(docs: DataFrame) -> Languages:
    """Learns from (doc_id, text, lang) rows; the samples' bounds are :data:`SAMPLE_DOCS` and those beside it."""
    return Languages.learn(training_texts(docs))


def identified(spark, languages: Languages, text: Column) -> Column:
    """A struct of lang_pred, score and phrases (normalised, a character) from whole texts. Only the text goes to Python."""
    held = spark.sparkContext.broadcast(languages)

    @F.arrow_udf("lang_pred string, score double, phrases double")
    @common.tidy
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lang, score, phrases = held.value.predict(texts)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(phrases)], ["lang_pred", "score", "phrases"])

    # so that a filter on the result does not parse all texts a second time
    return found.asNondeterministic()(text.cast("string"))


def identify_languages(docs: DataFrame, holdout: tuple[int, int] | None = (3, 1), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Predicted language of every whole text: doc_id, held_out, lang_pred, score and phrases.

    Learns from rows with a language whose crc32(doc_id as text) modulo holdout[0] is not holdout[1]
    (None: from all), a bounded sample of each language. Only the text enters a prediction. The score
    is 1 - (fewest / second fewest normalised phrases) ** 8; phrases are the fewest, a character.

    Null text or no letter: ``und`` with score 0; so is every text if no row has a language. A null
    id is never held out. Repeated rows are kept. An empty table gives an empty result. Other columns
    are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    out = common.held_out("doc_id", *holdout) if holdout else F.lit(False)
    languages = learn(docs.where(~out))
    found = docs.select("doc_id", out.alias("held_out"), identified(docs.sparkSession, languages, F.col("text")).alias("x"))
    return found.select("doc_id", "held_out", "x.*")


def op7(spark, sf_dir: str) -> DataFrame:
    return identify_languages(common.documents(spark, sf_dir))
