"""Encoding with a public tokenizer, a word at a time.

Texts are cut at spaces and line feeds. The tokenizer in use drops white space and never merges
across it, so a text's ids are the ids of its pieces in order. Each batch's distinct words are
encoded once and its texts put together from them.
"""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces with other characters than Latin-1 letters that a worker remembers before it starts afresh.
CACHE_PIECES = 100_000
#: Punctuation that is split off: the tokenizer never joins it with letters.
CLOSING = ".,;:!?"
#: Latin-1 letters, which the tokenizer's normaliser only lower-cases.
PLAIN = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$"

_encoders: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """ids of whole texts as little-endian unsigned 16-bit or 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.model_only, self.spelled, self.ends_word = self._plain(path)
        self.others: dict[str, np.ndarray] = {}

    def _plain(self, path: str):
        """The model without its normaliser and splitter, for words that these would only lower-case."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        bare = Tokenizer.from_file(path)
        end = getattr(bare.model, "end_of_word_suffix", None)
        if not end:
            return None, None, None
        bare.normalizer, bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        # a byte-level model spells a Latin-1 letter as the two printable stand-ins of its UTF-8 bytes
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        spelled = {c: spell.pre_tokenize_str(chr(c))[0][0] for c in range(0x80, 0x100) if chr(c).isalpha()}
        ends = np.zeros(self.vocabulary, bool)
        ends[[i for t, i in bare.get_vocab(with_added_tokens=False).items() if t.endswith(end)]] = True
        return bare, spelled, ends

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Lower-case plain words: their ids in one array, and how many each has. Each ends with an end-of-word token."""
        if not len(words):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        text = " ".join(words.to_numpy(zero_copy_only=False).tolist())
        if not text.isascii():
            text = text.translate(self.spelled)
        ids = np.array(self.model_only.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        return ids, np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0)

    def _others(self, pieces: list[str]) -> list[np.ndarray]:
        """Any pieces, as the whole tokenizer encodes them."""
        if len(self.others) > CACHE_PIECES:
            self.others = {}
        new = list({p for p in pieces if p not in self.others})
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.others[p] = np.array(e.ids, self.kind)
        return [self.others[p] for p in pieces]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text's ids begin (one entry more). Null: empty."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        if not len(lists):
            return np.zeros(0, self.kind), np.zeros(1, np.int64)
        pieces = lists.flatten().dictionary_encode()
        distinct = pieces.dictionary
        bare = pc.utf8_rtrim(distinct, CLOSING)
        plain = pc.match_substring_regex(bare, PLAIN) if self.ends_word is not None else pa.array([False] * len(distinct))
        is_plain = plain.to_numpy(zero_copy_only=False)
        words = pc.utf8_lower(bare.filter(plain)).dictionary_encode()
        cut = pc.utf8_length(bare).to_numpy()
        whole = pc.utf8_length(distinct).to_numpy()
        ids, sizes = self._words(words.dictionary)
        # the rest: closing punctuation of plain words, and all other pieces as they are
        tailed = np.flatnonzero(is_plain & (whole > cut))
        tails = [p[c:] for p, c in zip(distinct.take(pa.array(tailed)).to_pylist(), cut[tailed].tolist())]
        rest = self._others([*tails, *distinct.filter(pc.invert(plain)).to_pylist()])
        pool = np.concatenate([ids, *rest, np.zeros(0, self.kind)])
        units = np.concatenate([sizes, np.fromiter(map(len, rest), np.int64, len(rest)), [0]])
        starts = np.cumsum(units) - units
        # a piece is a unit and, after a plain word, its closing punctuation; the last unit is empty
        first, second = np.full(len(distinct), len(units) - 1), np.full(len(distinct), len(units) - 1)
        first[is_plain] = words.indices.to_numpy()
        second[tailed] = len(sizes) + np.arange(len(tails))
        first[~is_plain] = len(sizes) + len(tails) + np.arange(len(rest) - len(tails))
        codes = pieces.indices.to_numpy()
        at = np.empty(2 * len(codes), np.int64)
        at[0::2], at[1::2] = first[codes], second[codes]
        n = units[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        small = np.int32 if max(len(pool), ends[-1]) < 1 << 31 else np.int64
        take = np.repeat((starts[at] - ends[:-1]).astype(small), n)
        take += np.arange(ends[-1], dtype=small)
        per_text = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
        return pool[take], ends[2 * per_text]


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def width(vocabulary: int) -> int:
    """Fewest bits that hold every id below ``vocabulary``."""
    return max(1, math.ceil(math.log2(max(vocabulary, 2))))
