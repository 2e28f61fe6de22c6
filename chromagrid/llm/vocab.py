"""Exact token ids of the public tokenizers, faster than the library that defines them.

Whatever lies outside the characters for which the short way is known to be equal
goes to the ``tokenizers`` library itself."""

from __future__ import annotations

import functools
import json
import os
import re
import sys
import unicodedata
from array import array

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The byte-level word pattern of byte_bpe_50k (fixed value).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The word pattern of word_bpe_49k (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters outside of which texts go to the library.
ODD = re.compile("[^\t\n\r\x20-\x7e¡-ſ‐-‧€]")
#: A chunk that the library must encode: other characters than these, or a special string.
ODD_CHUNK = re.compile("[^\x21-\x7e¡-ÿ]|<\\|")
#: White space at which str.split() cuts and which isn't of the word rule; texts with it go to the library.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: Texts without these are cut into words by bytes, the rest goes by chunks.
NOT_LATIN = re.compile("[^\t-\r\x20-\x7e¡-ÿ]|<\\|")
#: Characters of texts that are encoded at once, about; longer texts go by chunks.
AT_ONCE = 1 << 20
LITTLE = sys.byteorder == "little"
#: Chunks that a worker remembers, twice: those used of late and those used before.
REMEMBERED = 140_000


def place(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def byte_encoding(path: str):
    """byte_bpe_50k as a tiktoken encoding."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    to_byte = byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens=special), ranks


#: Of each character below 256: 0 white space, 1 letter, 2 digit, 3 other, 4 the character 0.
KIND = np.array([4, *(0 if chr(c) in "\t\n\x0b\x0c\r " else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(1, 256))], np.uint8)


def ended(texts: list[str]) -> str:
    """Words (WORD_PATTERN) of lower-case texts of characters below 256, the character 0 after each; a blank between texts."""
    raw = np.frombuffer("\0".join(texts).encode("latin-1"), np.uint8)
    kind = KIND[raw]
    keep, end = kind > 0, (kind > 0) & (kind < 4)
    end[:-1] &= (kind[1:] != kind[:-1]) | (kind[:-1] == 2)
    marks = np.flatnonzero(raw == ord("'"))
    marks = marks[(kind[marks - 1] != 3) | (marks == 0)]  # those at the start of a word
    next_, after = (np.where(marks + k < len(raw), raw[np.minimum(marks + k, len(raw) - 1)], 0) for k in (1, 2))
    for k, hit in ((1, np.isin(next_, [*b"stmd"])), (2, np.isin(next_, [*b"rv"]) & (after == ord("e")) | (next_ == ord("l")) & (after == ord("l")))):
        end[marks[hit]], end[marks[hit] + k] = False, True
    place = np.cumsum(keep.view(np.uint8) + end.view(np.uint8), dtype=np.int32)
    out = np.zeros(place[-1] if len(place) else 0, np.uint8)
    out[place[keep] - 1 - end[keep]] = np.where(kind == 4, 32, raw)[keep]
    return out.tobytes().decode("latin-1")


class WordIds(dict):
    """Chunk without white space -> its ids as little-endian 16-bit bytes.

    A word end is modelled as one more byte, 0xFF, which no UTF-8 text holds; the
    vocabulary then is an ordinary byte-pair vocabulary ranked by id."""

    END = b"\xff"

    def __init__(self, path: str):
        super().__init__()
        import regex
        import tiktoken

        self.path, self.older = path, {}
        spec = json.load(open(path, encoding="utf-8"))
        if max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) >= 1 << 16:
            raise ValueError(f"{path}: ids do not fit in 16 bits")
        to_byte, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
        ranks = {}
        for t, i in spec["model"]["vocab"].items():
            if t not in special:
                body = t.removesuffix("</w>")
                ranks[bytes(to_byte[c] for c in body) + (self.END if body != t else b"")] = i
        # the same with the byte 0 as a word's end and a blank between texts, for texts without it
        zero = {k.replace(self.END, b"\0"): i for k, i in ranks.items() if b"\0" not in k}
        self.whole_pieces, self.blank = tiktoken.Encoding("texts", pat_str=r"[^\x00\x20]+\x00|\x20", mergeable_ranks=zero, special_tokens={}).encode_ordinary, zero[b" "]
        self.pieces = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.words = regex.compile(WORD_PATTERN).findall

    def whole(self, text: str) -> bytes:
        ids = library(self.path).encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(2, "little") for i in ids)

    def __missing__(self, chunk: str) -> bytes:
        if (out := self.older.get(chunk)) is not None:
            pass
        elif ODD_CHUNK.search(chunk):
            out = self.whole(chunk)
        else:
            ids = array("H")
            for w in self.words(chunk.lower()):
                ids.extend(self.pieces(w.encode() + self.END))
            out = ids.tobytes() if LITTLE else ids.byteswap() or ids.tobytes()
        if len(chunk) <= 64:
            self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        if ODD_SPACE.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))

    def many(self, texts: list[str]) -> list[bytes]:
        """``ids`` of each text, of many texts at once."""
        out: list[bytes] = [b""] * len(texts)
        held, size = [], 0
        for i, t in enumerate(texts):
            if len(t) > AT_ONCE or NOT_LATIN.search(t):
                out[i] = self.ids(t)
                continue
            held.append(i)
            size += len(t)
            if size >= AT_ONCE:
                self._encode(texts, held, out)
                held, size = [], 0
        self._encode(texts, held, out)
        return out

    def _encode(self, texts: list[str], held: list[int], out: list[bytes]) -> None:
        ids = np.array(self.whole_pieces(ended([texts[i].lower() for i in held])), "<u2")
        raw, ends = ids.tobytes(), np.flatnonzero(ids == self.blank).tolist()
        for i, lo, hi in zip(held, [0, *(e + 1 for e in ends)], [*ends, len(ids)], strict=False):
            out[i] = raw[2 * lo : 2 * hi]

    def trim(self) -> None:
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)
