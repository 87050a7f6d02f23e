"""Chunk-cached tokenisation for the lower-casing, word-ending BPE vocabulary.

No token crosses white space there, so a text is the concatenation of its
white-space chunks' tokens. A worker keeps the ids of the chunks it has seen
(a cache bounded by bytes: when full it is emptied, which changes no result)
and gathers a whole text's ids with numpy.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .textbytes import LOWER, PAD, SlotTable, mixed, span_hashes, text_bytes, words

#: Fixed values of the vocabulary's file: what splits words, by its pattern.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below this code point, composing changes nothing and lower-casing looks at no neighbours.
SIMPLE_BELOW = "ɐ"
WORD_END = "</w>"
#: Of each byte: white space 0, a letter or part of a character beyond ASCII 1, else 2.
KIND = np.full(256, 2, dtype=np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
#: Apostrophes, "<", and first bytes of characters other than U+00C0 to U+017F.
ODD = np.zeros(256, dtype=bool)
ODD[[0x27, 0x3C, 0xC2, *range(0xC6, 0x100)]] = True
#: Marks that often end a chunk; together they are one word of the pattern.
MARKS = ",.;:!?#$%&*|"
#: What a coder's cache may hold before it is emptied.
CACHE_BYTES = 32_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte, as byte-level vocabularies have it."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ChunkCoder:
    """Texts to ids. encode_word: the ids of one word, given in byte symbols without the word end."""

    def __init__(self, tokenizer_path: str, encode_word: Callable[[str], list[int]], limit: int = CACHE_BYTES, keep_decoded: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(tokenizer_path)
        with open(tokenizer_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in [*spec["model"]["vocab"].items(), *self.special.items()]}
        self.encode_word, self.limit, self.keep_decoded = encode_word, limit, keep_decoded
        self.words = regex.compile(WORD).findall
        self.split_specials = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")").split
        self.symbols = byte_symbols()
        self.clear()

    def clear(self) -> None:
        self.slots, self.starts, self.sizes = SlotTable(), array("q"), array("q")
        self.flat, self.decoded, self.decoded_bytes = array("H"), [], 0

    def held(self) -> int:
        """Bytes of the cache, about."""
        slots = self.slots
        return slots.one.nbytes + slots.two.nbytes + slots.table.nbytes + 8 * (len(self.starts) + len(self.sizes)) + 2 * len(self.flat) + self.decoded_bytes

    def word_ids(self, word: str) -> list[int]:
        symbols = self.symbols
        return self.encode_word(word if word.isascii() and word.isprintable() else "".join([symbols[b] for b in word.encode()]))

    def chunk_ids(self, chunk: str) -> list[int]:
        ids: list[int] = []
        if not chunk:
            return ids
        if max(chunk) < SIMPLE_BELOW and "<|" not in chunk:
            word = chunk.lower()
            core = word.rstrip(MARKS)
            if core.isalpha():  # the common case: one word and marks
                return [*self.word_ids(core), *self.word_ids(word[len(core) :])] if len(core) < len(word) else self.word_ids(core)
            for word in self.words(word):
                ids += self.word_ids(word)
            return ids
        for piece in self.split_specials(chunk):
            if piece in self.special:
                ids.append(self.special[piece])
            elif piece:
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece)):
                    ids += self.encode_word(word)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The vocabulary names no decoder: tokens joined by spaces."""
        return " ".join(map(self.token_of.__getitem__, ids))

    def units(self, body: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans whose tokens are their own affair: chunks, split further where letters meet marks.

        A chunk with an apostrophe, the start of a special token or a character
        other than ASCII and Latin letters stays whole.
        """
        starts, ends, before = words(body, bounds)
        kind = KIND[body[:-PAD]]
        turns = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        turns = turns[(kind[turns] > 0) & (kind[turns - 1] > 0)]
        chunk = np.searchsorted(starts, turns, side="right") - 1
        inner = starts[chunk] < turns if len(turns) else np.zeros(0, bool)  # else another text begins here
        whole = np.zeros(len(starts) + 1, dtype=bool)
        odd = np.flatnonzero(ODD[body[:-PAD]] | (np.concatenate([[False], body[: -PAD - 1] == 0xC3]) & ((body[:-PAD] == 0x97) | (body[:-PAD] == 0xB7)))) if len(kind) else []
        whole[np.searchsorted(starts, odd, side="right") - 1] = True
        turns = turns[inner & ~whole[chunk]]
        if len(turns):
            starts, ends = np.sort(np.concatenate([starts, turns])), np.sort(np.concatenate([ends, turns]))
            before = np.searchsorted(starts, bounds)
        return starts, ends, before

    def batch(self, texts: pa.Array) -> Coded:
        """The texts' ids, and their decoded texts if this coder keeps them."""
        if self.held() > self.limit:
            self.clear()
        body, bounds = text_bytes(texts)
        starts, ends, before = self.units(body, bounds)
        raw = body.tobytes()
        # Lower-cased chunks have the same ids, but for special tokens.
        one, two = span_hashes(body if b"<|" in raw else LOWER[body], starts, ends)
        at = self.slots.find(one, two)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            _, first, back = np.unique(one[missing] ^ mixed(two[missing]), return_index=True, return_inverse=True)
            new, place = missing[first], self.slots.count
            for a, b in zip(starts[new].tolist(), ends[new].tolist(), strict=True):
                ids = self.chunk_ids(raw[a:b].decode())
                self.starts.append(len(self.flat))
                self.sizes.append(len(ids))
                self.flat.extend(ids)
                if self.keep_decoded:
                    self.decoded.append(self.decode(ids))
                    self.decoded_bytes += 64 + len(self.decoded[-1])
            self.slots.add(one[new], two[new])
            at[missing] = place + back
        sizes = np.frombuffer(self.sizes, dtype=np.int64)[at] if len(at) else at
        last = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.zeros(0, "<u4")
        if last[-1]:
            shift = np.frombuffer(self.starts, dtype=np.int64)[at] - last[:-1]
            ids = np.frombuffer(self.flat, dtype=np.uint16)[np.repeat(shift, sizes) + np.arange(last[-1])].astype("<u4")
        decoded = None
        if self.keep_decoded:
            some = sizes > 0
            used, where = np.unique(at[some], return_inverse=True)
            tokens = pa.array([self.decoded[s] for s in used.tolist()], type=pa.string()).take(pa.array(where))
            kept = np.concatenate([[0], np.cumsum(some)])[before]
            decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, type=pa.int32()), tokens), " ")
        return Coded(ids, last[before], decoded)

    def encode(self, text: str) -> np.ndarray:
        return self.batch(pa.array([text])).ids


@dataclass(frozen=True)
class Coded:
    """The ids of all texts; text i has those from bounds[i] to bounds[i + 1]."""

    ids: np.ndarray
    bounds: np.ndarray
    decoded: pa.Array | None


def library_coder(tokenizer_path: str, limit: int = CACHE_BYTES) -> ChunkCoder:
    """Words encoded by the tokenizers library's own model."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path).model
    return ChunkCoder(tokenizer_path, lambda word: [t.id for t in model.tokenize(word)], limit)


_coders: dict[tuple, ChunkCoder] = {}


def worker_coder(kind: str, make: Callable[[str], ChunkCoder], tokenizer_path: str) -> ChunkCoder:
    """One coder for a Python worker's lifetime, so that its cache outlives a task."""
    key = (kind, tokenizer_path)
    if key not in _coders:
        _coders[key] = make(tokenizer_path)
    return _coders[key]
