"""Exact token counts by prefix dynamic programming.

Each text gets a table with the exact number of tokens of every prefix, so that truncation and
budget questions need no encoding again.  Inside a word of the pre-tokenizer a prefix ends
with the one token t for which the prefix without t has a last token u and (u, t) stays
two tokens when encoded together, hence count(prefix) = count(prefix without t) + 1.  Words of
the pre-tokenizer don't influence each other, hence inside a text count(prefix) is the count
before the last word plus the count of the word's own prefix; only in a run of white
space does a prefix hold other words than the text, and there the run is a word of its own.

A table holds differences: entry i is the count of the first i + 1 code points less the count
of the first i, one signed byte each (four little-endian bytes each in the rare text where one
byte is too small).  Its sum is the number of tokens; ``prefix_counts`` unfolds it.

A null text counts as empty (no tokens, no bytes, an empty table).  Special strings inside
a text are one token each, as in the library.  Repeated rows are counted each; further columns are
not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import mapped

LETTERS, NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾"
#: vocab.BYTE_PATTERN for texts without characters of vocab.ODD.
PLAIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
#: Two white space characters or more, as the library knows them.
RUNS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2,}")
#: Words, or pairs of tokens, that a worker remembers, twice: those used of late and those used before.
REMEMBERED = 600_000


class Remembered(dict):
    """Answers of a function, in two generations of bounded size."""

    def __init__(self, answer: Callable):
        super().__init__()
        self.answer, self.older = answer, {}

    def __missing__(self, key):
        if (out := self.older.get(key)) is None:
            out = self.answer(key)
        self[key] = out
        return out

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()


class PrefixCounter:
    def __init__(self, path: str):
        self.path = path
        self.encoding, self.ranks = vocab.byte_encoding(path)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.endings = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.endings.add_word(t.decode("latin-1"), (len(t), i))
        self.endings.make_automaton()
        self.special = sorted(self.encoding.special_tokens_set, key=len, reverse=True)
        self.special_in = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.stays = Remembered(self._stays)
        self.moves = Remembered(self._moves)

    def trim(self) -> None:
        self.stays.trim()
        self.moves.trim()

    def words(self, text: str) -> list[str]:
        """Words of the pre-tokenizer; the library itself cuts texts with odd characters."""
        if not vocab.ODD.search(text):
            return PLAIN.findall(text)
        return [text[a:b] for _, (a, b) in vocab.library(self.path).pre_tokenizer.pre_tokenize_str(text)]

    def _stays(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        both = self.encoding._core_bpe.encode_single_piece(self.tokens[a] + self.tokens[b])
        return len(both) == 2 and both[0] == a

    def _moves(self, word: str) -> bytes:
        """``differences``, a byte each; a word for which that is too small makes its text a wide one."""
        d = self.differences(word)
        if max(d) > 127 or min(d) < -127:
            raise OverflowError
        return bytes([x & 255 for x in d])

    def dynamic(self, word: bytes) -> list[int]:
        """Number of tokens of each byte prefix of one word of the pre-tokenizer.  The automaton names the tokens that end at each place, the longest first."""
        count, last, done, stays = [0], [-1], 0, self.stays
        for end, (length, token) in self.endings.iter(word.decode("latin-1")):
            if end < done:
                continue
            j = end + 1 - length
            if j == 0 or stays[last[j] << 32 | token]:
                if end > done:
                    break
                count.append(count[j] + 1)
                last.append(token)
                done += 1
        if done < len(word):
            raise ValueError(f"the vocabulary can't spell {word!r}")
        return count

    def differences(self, word: str) -> list[int]:
        """Count of each code point prefix less the one before, for a word by itself."""
        if word[0] == "'":  # a cut can turn a contraction into other words
            counts = [0, *(sum(self.dynamic(w.encode())[-1] for w in self.words(word[:i])) for i in range(1, len(word)))] if len(word) <= 3 else None
            if counts:
                counts.append(self.dynamic(word.encode())[-1])
                return [b - a for a, b in zip(counts, counts[1:], strict=False)]
        raw = word.encode()
        counts = self.dynamic(raw)
        if len(raw) > len(word):
            counts = [0, *(c for c, b in zip(counts[1:], raw[1:] + b" ", strict=True) if b & 0xC0 != 0x80)]
        return [b - a for a, b in zip(counts, counts[1:], strict=False)]

    def plain(self, text: str) -> np.ndarray:
        """Differences for a text without special strings."""
        words = self.words(text)
        try:
            moves = self.moves
            d = np.frombuffer(b"".join([moves[w] for w in words]), np.int8)
        except OverflowError:
            d = np.array([x for w in words for x in self.differences(w)], np.int64)
        if runs := [m.span() for m in RUNS.finditer(text)]:
            d = d.astype(np.int64)
            for s, e in runs:
                own = self.differences(text[s:e])
                if e < len(d):
                    d[e] += d[s:e].sum() - sum(own)
                d[s:e] = own
        return d

    def table(self, text: str) -> np.ndarray:
        """Differences of the counts of all prefixes of a text, one for each code point."""
        if not self.special_in or not self.special_in.search(text):
            return self.plain(text)
        parts, at = [], 0
        for m in self.special_in.finditer(text):
            # before its last character a special string is text like any other
            cut = self.plain(text[at : m.end()]).astype(np.int64)
            whole = self.plain(text[at : m.start()]).astype(np.int64).sum() + 1
            cut[-1] = whole - cut[:-1].sum()
            parts.append(cut)
            at = m.end()
        return np.concatenate([*parts, self.plain(text[at:])]).astype(np.int64)

    def prefix_counts(self, text: str) -> list[int]:
        """Entry i: tokens of text[:i]."""
        return [0, *np.cumsum(self.table(text), dtype=np.int64).tolist()]


def longest_prefix(differences: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    counts = np.cumsum(differences, dtype=np.int64)
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def encoded(differences: np.ndarray) -> bytes:
    if differences.dtype != np.int8 and len(differences) and np.abs(differences).max() > 127:
        return differences.astype("<i4").tobytes()
    return differences.astype(np.int8).tobytes()


def decoded(table: bytes, n_chars: int) -> np.ndarray:
    return np.frombuffer(table, np.int8 if len(table) == n_chars else "<i4")


@functools.cache
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit, fits, prefix_table of each text; fits: code points of the
    longest prefix of at most ``limit`` tokens."""
    path = path or vocab.place("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in (b.slice(at, 128) for b in batches for at in range(0, b.num_rows, 128)):
            n_tokens, fits, tables = [], [], []
            for text in batch.column(1).to_pylist():
                d = c.table(text) if text else np.zeros(0, np.int8)
                n_tokens.append(int(d.sum(dtype=np.int64)))
                # a text of fewer code points than ``limit`` may still have more tokens
                fits.append(longest_prefix(d, limit))
                tables.append(encoded(d))
            c.trim()
            n_bytes = pc.cast(pc.fill_null(pc.binary_length(batch.column(1)), 0), pa.int64())
            yield pa.record_batch([batch.column(0), n_bytes, pa.array(n_tokens, pa.int64()), pa.array(np.array(n_tokens, np.int64) > limit), pa.array(fits, pa.int64()), pa.array(tables, pa.binary())], names=["id", "n_bytes", "n_tokens", "over_limit", "fits", "prefix_table"])

    out = mapped(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fits bigint, prefix_table binary")
    return out.withColumnRenamed("id", id_col)
