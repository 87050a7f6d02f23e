"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one last token is possible in a BPE
encoding: the one whose pairing with the last token of the prefix before it is
compatible, that is, encodes to just these two tokens. A suffix automaton over
the vocabulary (Aho-Corasick) yields the tokens that end at each place; the
pair test replays merges backwards from the boundary. Back-pointers from the
whole word give the ids, with no merge loop and no backtracking.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import need, text_or_empty
from .textbytes import slices
from .tokens import WORD_END, ChunkCoder, Coded, worker_coder

#: A word's last byte is a symbol of its own, shifted here, as the vocabulary's word-end tokens have it.
END_SHIFT = 0xE000


class PrefixEncoder:
    """Exact BPE ids of words (strings of byte symbols)."""

    def __init__(self, tokenizer_path: str, pair_limit: int = 250_000):
        import ahocorasick

        with open(tokenizer_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = whole
            self.parts[whole] = (left, right)
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, int] = {}  # every token is its own encoding
        for token, i in vocab.items():
            symbols = self._closed(token[: -len(WORD_END)]) if token.endswith(WORD_END) else token
            self.automaton.add_word(symbols, (i, len(symbols)))
            self.whole[symbols] = i
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}
        self.pair_limit = pair_limit

    @staticmethod
    def _closed(word: str) -> str:
        return word[:-1] + chr(END_SHIFT + ord(word[-1]))

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a, b side by side: no merge across their boundary comes before both are complete.

        Ids of merged tokens rise with their merges' ranks. Undo the later of
        the two tokens' merges, so that what touches the boundary is as it was
        before it; a merge across the boundary that ranks earlier would have won.
        """
        before = float("inf")
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                return False
            undo_a, undo_b = self.parts.get(a), self.parts.get(b)
            if undo_a and (not undo_b or a > b):
                before, a = a, undo_a[1]
            elif undo_b:
                # At equal rank the left one of two places merges first.
                before, b = b + 1, undo_b[0]
            else:
                return True

    def __call__(self, word: str) -> list[int]:
        if len(self.known) > self.pair_limit:
            self.known.clear()
        known, text = self.known, self._closed(word)
        whole = self.whole.get(text)
        if whole is not None:
            return [whole]
        last, size, done = [-1] * len(text), [0] * len(text), -1
        for end, (token, length) in self.automaton.iter(text):
            if end == done:  # this prefix has its one last token
                continue
            if length <= end:
                key = last[end - length] << 17 | token
                good = known.get(key)
                if good is None:
                    good = known[key] = self.compatible(last[end - length], token)
                if not good:
                    continue
            last[end], size[end], done = token, length, end
        ids, at = [], len(text) - 1
        while at >= 0:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids


def prefix_coder(tokenizer_path: str) -> ChunkCoder:
    return ChunkCoder(tokenizer_path, PrefixEncoder(tokenizer_path), keep_decoded=True)


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """ids and the decoded text of every row: (id_col, ids array<int>, decoded string)."""

    def columns(coded: Coded) -> list[pa.Array]:
        return [pa.ListArray.from_arrays(pa.array(coded.bounds, type=pa.int32()), pa.array(coded.ids.astype("int32"))), coded.decoded]

    return _coded(docs, tokenizer_path, id_col, text_col, "ids array<int>, decoded string", columns)


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: (id_col, n_tokens, ids_sha256, decoded_sha256); see _coded for edge cases."""

    def columns(coded: Coded) -> list[pa.Array]:
        bounds, raw = coded.bounds.tolist(), memoryview(coded.ids.view(np.uint8))
        texts = coded.decoded
        ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist()
        body = memoryview(texts.buffers()[2] or b"")
        sha = hashlib.sha256
        return [
            pa.array(np.diff(coded.bounds), type=pa.int64()),
            pa.array([sha(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds, bounds[1:], strict=False)], type=pa.string()),
            pa.array([sha(body[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)], type=pa.string()),
        ]

    return _coded(docs, tokenizer_path, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", columns)


def _coded(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, added: str, columns) -> DataFrame:
    """One row out for every row in; no shuffle.

    Null text counts as empty: no ids, decoded "". Null or repeated ids are
    passed through, each row by itself; other columns are not read. An empty
    table gives no rows. Texts of any length are encoded whole, in slices of
    some megabytes, so memory follows the longest text only.
    """
    need(docs, id_col, text_col)
    rows = docs.select(docs[id_col], text_or_empty(text_col).alias(text_col))
    names = [id_col, *(c.split()[0] for c in added.split(", "))]

    def run(batches):
        coder = worker_coder("prefix", prefix_coder, tokenizer_path)
        for batch in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns(coder.batch(batch.column(1)))], names)

    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {added}")
