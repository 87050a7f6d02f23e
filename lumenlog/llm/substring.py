"""Removal of repeated passages by content-defined chunking.

A gear rolling hash, of the last 16 bytes at every place, cuts a text where it
is smallest among the places up to REACH bytes on either side. Cuts depend on
nearby bytes only, so an insertion shifts chunks but doesn't change those
beyond it. A chunk is known by its digest of 128 bits; of equal chunks the first,
by doc_id and place, owns the text, and the others are repeats. Neighbouring repeats make
a run, and runs of at least min_bytes are taken out of the text, but for words of
up to WORD bytes that lie across their ends. In text with a period of up to REACH
bytes equally small hashes recur; such a stretch is cut at its first and last of
them, and between these about every STRETCH bytes.

Most chunks are in one place only. They are told apart first: tasks count short
keys of all chunks, which travel sorted and compressed, and only chunks whose key
passes a filter of the repeated ones become rows. Rows of texts are known by
doc_id and the text's hash, so that no text loses what another one repeats.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, need, scratch, split_by, text_or_empty
from .textbytes import PAD, mixed, packed, release, slices, span_hashes, text_bytes, unpacked

WINDOW, REACH = 16, 28
#: Bytes of a chunk within a stretch of a short period.
STRETCH = 56
#: How far a removed span's ends give way to a word.
WORD = 24
#: Zeros between texts, so that no text's cuts depend on its neighbours.
_GAP = WINDOW + REACH
#: The gear table: a random word for each byte but 0.
GEAR = mixed(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
GEAR[0] = 0
_NONE = np.uint32(0xFFFFFFFF)
#: Bytes of text for each range of hashes, chunks of a run, and bits of the filter of repeated chunks at most (32 MB).
RANGE_BYTES, RUN, FILTER_BITS = 64_000_000, 1_000_000, 28


def gear_hashes(body: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2 h + gear[byte] in 32 bits over the last WINDOW bytes, at every byte; by doubling."""
    h = GEAR[body]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def window_min(h: np.ndarray, width: int) -> np.ndarray:
    """At each place the least of it and the width - 1 before it."""
    out, have = h.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[step:] = np.minimum(out[step:], out[:-step])
        have += step
    return out


def chain_cuts(low: np.ndarray) -> np.ndarray:
    """Those of the places with the smallest hash around that cut.

    Places within REACH of each other have the same hash and are a chain, as in
    text with a short period. It is cut at its first and last place and about
    every STRETCH bytes from the first, so it has the same few chunks wherever
    it stands.
    """
    if not len(low):
        return low
    fresh = np.concatenate([[True], np.diff(low) > REACH])
    first = low[fresh][np.cumsum(fresh) - 1]
    part = (low - first) // STRETCH
    last = np.concatenate([fresh[1:], [True]])
    return low[fresh | last | np.concatenate([[True], part[1:] != part[:-1]])]


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each chunk's text, start and end there, and two hashes, which are its digest."""
    body, bounds = text_bytes(texts)
    sizes = np.diff(bounds)
    shift = _GAP * (np.arange(len(sizes)) + 1)
    spread = np.zeros(int(bounds[-1]) + _GAP * (len(sizes) + 1) + PAD, dtype=np.uint8)
    place = np.arange(bounds[-1]) + np.repeat(shift, sizes)
    spread[place] = body[:-PAD]
    h = gear_hashes(spread)
    outside = np.ones(len(spread), dtype=bool)
    outside[place] = False
    h[outside | ((spread & 0xC0) == 0x80)] = _NONE  # no cut within a character
    del place, outside
    left = window_min(h, REACH + 1)
    right = np.full(len(h), _NONE, dtype=np.uint32)
    right[:-REACH] = left[REACH:]
    cuts = chain_cuts(np.flatnonzero((h == left) & (h <= right) & (h != _NONE)))
    del h, left, right
    firsts = (bounds[:-1] + shift)[sizes > 0]
    starts = np.unique(np.concatenate([cuts, firsts]))
    which = np.searchsorted(bounds[:-1] + shift, starts, side="right") - 1
    ends = np.minimum(np.concatenate([starts[1:], [len(spread)]]), (bounds[1:] + shift)[which]) if len(starts) else starts
    base = (bounds[:-1] + shift)[which] if len(starts) else starts
    one, two = span_hashes(spread, starts, ends)
    return which, starts - base, ends - base, one, two


def runs(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Spans that touch, joined; those of at least so many bytes."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= least]


def trimmed(text: bytes, cut: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """These spans of the text, shrunk to whole words where words of up to WORD bytes lie across their ends.

    Where no white space is met within WORD bytes, as in text without spaces,
    the span keeps its end, which is between characters.
    """
    between = lambda i: text[i - 1 : i].isspace() or text[i : i + 1].isspace()
    out = []
    for a, b in cut:
        if a > 0:
            a = next((i for i in range(a, min(a + WORD, b) + 1) if between(i)), a)
        if b < len(text):
            b = next((i for i in range(b, max(b - WORD, a) - 1, -1) if between(i)), b)
        if a < b:
            out.append((a, b))
    return out


def without(text: bytes, cut: list[tuple[int, int]]) -> bytes:
    """The text without these spans."""
    kept, at = [], 0
    for a, b in cut:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): rows that agree in doc_id and text are one."""
    text = text_or_empty()
    return docs.select(docs["doc_id"], F.xxhash64(text).alias("key"), text.alias("text"))


def _often(rows: DataFrame) -> tuple[np.ndarray, int]:
    """A filter that the first hashes of all repeated chunks pass, and few others: words of bits, and how many bits of a hash they take.

    A range of hashes is counted by one task, from runs that are sorted and
    compressed; a run has a hash's first 32 bits within its range.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
    bits = min(24, max(1, math.ceil(math.log2(ranges))))
    width = min(FILTER_BITS, max(16, math.ceil(math.log2(max(1, size / 8)))))

    def run(batches):
        held: list[np.ndarray] = []

        def flush():
            h = np.sort(np.concatenate(held)) >> np.uint64(32 - bits)
            held.clear()
            parts = (h >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1], [True]]))
            sizes = np.diff(cuts)
            runs = [packed(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(parts[cuts[:-1]]), pa.array(sizes.astype(np.int32)), pa.array(runs, type=pa.binary())], ["range", "n", "run"])

        for batch in slices(batches, 0):
            one = chunks(batch.column(0))[3]
            if len(one):
                held.append(one)
            if sum(map(len, held)) > RUN:
                yield flush()
        if held:
            yield flush()
        release()

    def count(table: pa.Table) -> pa.Table:
        h = np.sort(np.concatenate([unpacked(r.as_py(), n.as_py()) for r, n in zip(table["run"], table["n"], strict=True)]))
        again = np.unique(h[1:][h[1:] == h[:-1]])
        at = np.unique((again >> np.uint64(32 + bits - width)).astype(np.int64))
        word, back = np.unique(at >> 6, return_inverse=True)
        out = np.zeros(len(word), dtype=np.uint64)
        np.bitwise_or.at(out, back, np.uint64(1) << (at & 63).astype(np.uint64))
        return pa.table({"word": pa.array(word), "set": pa.array(out.view(np.int64))})

    runs = rows.select("text").mapInArrow(run, "range long, n int, run binary")
    found = runs.groupBy("range").applyInArrow(count, "word long, set long").groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()  # at most 2^FILTER_BITS bits
    table = np.zeros(1 << (width - 6), dtype=np.int64)
    table[found.column("word").to_numpy()] = found.column("set").to_numpy()
    return table, width


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(one, two, doc, key, start, stop): all chunks that are in several places, and a few others; places in bytes of the text's UTF-8."""
    rows = _keyed(docs)
    table, width = _often(rows)
    held = docs.sparkSession.sparkContext.broadcast(table)  # at most 32 MB, by FILTER_BITS
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        table = held.value
        for batch in slices(batches, 2):
            which, start, end, one, two = chunks(batch.column(2))
            at = (one >> np.uint64(64 - width)).astype(np.int64)
            some = np.flatnonzero((table[at >> 6] >> (at & 63)) & 1)
            if len(some):
                which = pa.array(which[some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one[some].view(np.int64)), pa.array(two[some].view(np.int64)), batch.column(0).take(which), batch.column(1).take(which), pa.array(start[some].astype(np.int32)), pa.array(end[some].astype(np.int32))],
                    ["one", "two", "doc", "key", "start", "stop"],
                )

    return scratch(rows.mapInArrow(run, f"one long, two long, doc {id_type}, key long, start int, stop int"), "chunks")


def dedup(docs: DataFrame, min_bytes: int = 64, extra: list[str] = ()) -> DataFrame:
    """Every row's (doc_id, the columns of extra, text without repeats, removed_bytes, removed_spans).

    A passage's first occurrence stays, by doc_id and place; later ones go, in
    the same document too. Null text stays null and empty text empty; texts of
    any length are cut whole. Rows with the same doc_id and different texts are
    documents of their own, in the order of their texts' hashes; rows that agree
    in both are one document and cut alike. Null ids come after all others. An
    empty table gives no rows. Columns that aren't in extra are not read.

    removed_spans: what was taken out, in bytes of the text's UTF-8.

    Repeated chunks are shuffled by digest twice: as counts, combined before,
    and against the repeated digests, a join that Spark splits where a passage
    is in a third of all texts. Only texts with repeats, and a few others, are
    shuffled. A document's spans are at most its chunks.
    """
    need(docs, "doc_id", "text")
    pieces = repeated_chunks(docs)
    owner = F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "key", "start"))
    owned = scratch(pieces.groupBy("one", "two").agg(F.count("*").alias("n"), owner.alias("o")).where("n > 1").select("one", "two", F.col("o.doc").alias("owner"), F.col("o.key").alias("its"), F.col("o.start").alias("at")), "owners")
    repeats = pieces.join(owned, ["one", "two"]).where(~(F.col("doc").eqNullSafe(F.col("owner")) & (F.col("key") == F.col("its")) & (F.col("start") == F.col("at"))))
    spans = scratch(repeats.groupBy("doc", "key").agg(F.collect_set(F.struct("start", "stop")).alias("spans")).select(F.col("doc").alias("of"), F.col("key").alias("by"), "spans"), "spans")
    drop(pieces, owned)
    kept = ["doc_id", *extra]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    texts = docs.select(docs["text"].alias("\x00text"), F.xxhash64(text_or_empty()).alias("\x00key"), *(docs[c] for c in kept))
    some, others = split_by(texts, texts["\x00key"], spans.select("by").distinct())
    whole = others.select("\x00text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"), *kept)
    joined = whole.union(some.join(spans, some["doc_id"].eqNullSafe(spans["of"]) & (some["\x00key"] == spans["by"]), "left").select("\x00text", "spans", *(some[c] for c in kept)))

    def run(batches):
        for batch in slices(batches, 0, 8_000_000):
            out, gone, cuts = [], [], []
            for text, found in zip(batch.column(0), batch.column(1), strict=True):
                cut = runs([(s["start"], s["stop"]) for s in found.as_py()], min_bytes) if found.is_valid else []
                if cut and text.is_valid:
                    raw = text.as_py().encode()
                    cut = trimmed(raw, [(a, min(b, len(raw))) for a, b in cut if a < len(raw)])
                    new = without(raw, cut)
                    out.append(new.decode(errors="ignore"))
                    gone.append(len(raw) - len(new))
                else:
                    out.append(text)
                    gone.append(0)
                    cut = []
                cuts.append([{"start": a, "stop": b} for a, b in cut])
            texts_out = pa.array([t.as_py() if isinstance(t, pa.Scalar) else t for t in out], type=pa.string())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], texts_out, pa.array(gone, type=pa.int64()), pa.array(cuts, type=kind)], [*kept, "text", "removed_bytes", "removed_spans"])

    return joined.mapInArrow(run, f"{fields}, text string, removed_bytes long, removed_spans array<struct<start:bigint,stop:bigint>>")
