"""Words and word n-grams of a batch of texts, as numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers that make a word's place in an n-gram count (fixed, so that runs agree).
PLACES = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ^ 0xD1B54A32D192ED03 << k) & (1 << 64) - 1 | 1 for k in range(16)], np.uint64)


def _coded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
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


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of whole texts: A-Z lower-cased, cut at space and U+0009 to U+000D. Null: no words.

    Returns the distinct words, each word's place among them in text order, and where each text's
    words begin (one entry more).
    """
    words, codes, at = _coded(texts)
    # by way of numpy: to_pylist makes a scalar of each word
    return words.to_numpy(zero_copy_only=False).tolist(), codes, at


def split_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`split_words` with :func:`word_hashes` of the distinct words in their place; no word becomes a string."""
    words, codes, at = _coded(texts)
    raw = words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary())
    return np.fromiter(map(xxhash.xxh3_64_intdigest, raw.to_numpy(zero_copy_only=False).tolist()), np.uint64, len(raw)), codes, at


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of ``n`` words, by the place of their first word."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out += hashes[k : len(hashes) - n + 1 + k] * PLACES[k]
    return mix(out + np.uint64(n))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Per text its distinct ``n``-word shingles as sorted 64-bit hashes.

    Fewer words: the whole sequence as one shingle. No words: an empty set.
    """
    words, codes, at = split_words(texts)
    own = word_hashes(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    grams, out = ngram_hashes(own, n), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(ngram_hashes(own[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
