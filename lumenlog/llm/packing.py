"""Sequence packing as a cutting-stock problem solved by column generation.

Every document is cut at multiples of the capacity; whole pieces fill a
sequence each, and the tails, of at most capacity - 1 tokens, are packed. The
linear program has a row for each tail length (at most capacity - 1, whatever
the corpus) and a column for each pattern, a multiset of lengths that fits.
Columns are priced by a knapsack dynamic program over the capacity, until no
pattern improves or its bound shows that no whole sequence can be saved. Rounded
down, the patterns' counts give slots; the few tails left over go best-fit into
further sequences. A tail's rank among those of its length picks its slot, so
all that the driver sees is the length histogram.
"""

from __future__ import annotations

import logging
import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, scratch, text_or_empty
from .textbytes import slices
from .tokens import library_coder, worker_coder


log = logging.getLogger("lumenlog")

#: A plan this close to the bound is good enough, if it needs more whole sequences; a pattern improves if it is worth more than one sequence by more than this.
GAP, IMPROVES = 5e-5, 1e-7
#: Pricing has settled when so many rounds together save less than this share of the sequences.
SETTLED_ROUNDS, SETTLED = 20, 1e-5


def starting_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[Counter], np.ndarray, np.ndarray]:
    """Patterns, their counts and their matrix. Each uses up one length that later ones lack, so the matrix is triangular in that order."""
    left, alive, m = demand.astype(np.float64), list(range(len(lengths))), len(lengths)
    sizes = lengths.tolist()
    columns, matrix, x = [Counter()] * m, np.zeros((m, m)), np.zeros(m)
    while alive:
        pattern, room, k = Counter([alive[-1]]), capacity - sizes[-1], 0
        while k := bisect_right(sizes, room):
            pattern[alive[k - 1]] += 1
            room -= sizes[k - 1]
        count, gone = min((left[i] / n, i) for i, n in pattern.items())
        for i, n in pattern.items():
            left[i] = max(0.0, left[i] - count * n)
            matrix[i, gone] = n
        columns[gone], x[gone] = pattern, count
        at = alive.index(gone)
        del alive[at], sizes[at]
    return columns, x, matrix


def knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to capacity the most worth that fits, and which length's piece comes last there (-1: none, as with one token less)."""
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    for used in range(int(lengths[0]), capacity + 1):
        value = best[used - lengths[: upto[used]]] + worth[: upto[used]]
        j = int(value.argmax())
        best[used] = best[used - 1]
        if value[j] > best[used]:
            best[used], took[used] = value[j], j
    return best, took


def pattern_within(lengths: np.ndarray, took: np.ndarray, room: int) -> Counter:
    """The knapsack's pattern for this room."""
    pattern: Counter = Counter()
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            pattern[int(took[room])] += 1
            room -= int(lengths[took[room]])
    return pattern


class Basis:
    """A basis of the master program: patterns, their counts, and its inverse as a dense matrix and the factors of the last pivots."""

    def __init__(self, lengths: np.ndarray, demand: np.ndarray, capacity: int, factors: int = 64):
        self.columns, self.x, matrix = starting_basis(lengths, demand, capacity)
        self.dense = np.linalg.inv(matrix)
        self.price = self.dense.sum(axis=0)
        self.left, self.right, self.k = np.zeros((len(lengths), factors)), np.zeros((factors, len(lengths))), 0

    def enter(self, pattern: Counter) -> bool:
        """Pivot the pattern in, if it improves at the basis' prices."""
        rows, copies = np.fromiter(pattern, dtype=np.int64), np.fromiter(pattern.values(), dtype=np.float64)
        if self.price[rows] @ copies <= 1 + IMPROVES:
            return False
        k = self.k
        enters = self.dense[:, rows] @ copies + self.left[:, :k] @ (self.right[:k, rows] @ copies)
        can = np.flatnonzero(enters > 1e-9)
        out = int(can[np.argmin(self.x[can] / enters[can])])
        step = self.x[out] / enters[out]
        self.x = np.maximum(self.x - step * enters, 0)
        self.x[out], self.columns[out] = step, pattern
        row = (self.dense[out] + self.left[out, :k] @ self.right[:k]) / enters[out]
        enters[out] -= 1
        self.price = self.price - enters.sum() * row
        self.left[:, k], self.right[k] = -enters, row
        self.k = k + 1
        if self.k == len(self.right):
            self.dense += self.left @ self.right
            self.price, self.k = self.dense.sum(axis=0), 0
        return True


def column_generation(demand: dict[int, int], capacity: int, gap: float = GAP, rounds: int | None = None) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Patterns with fractional counts that cover demand (length -> number) by the fewest sequences.

    A knapsack at given prices yields the best pattern that holds each length,
    and a bound on every plan (Farley's). It is asked at prices in proportion to
    length first, then at the basis' prices, smoothed towards the best bound's;
    patterns that improve are pivoted in. Ends when none does, when the plan
    needs no more whole sequences than the bound or is within gap of it, or when
    pricing has settled: SETTLED_ROUNDS rounds saved less than a share SETTLED;
    after so many rounds of pricing only if rounds is given. Every basis on the
    way is a valid plan. Returns the plan, and its value over the bound, which
    is logged too.
    """
    if not demand:
        return [], 1.0
    lengths = np.array(sorted(demand), dtype=np.int64)
    wanted = np.array([demand[int(n)] for n in lengths], dtype=np.float64)
    # Demands a little apart: then no two patterns run out at once, every pivot improves, and pivots end.
    basis = Basis(lengths, wanted * (1 + 1e-9 * np.random.default_rng(5).random(len(wanted))), capacity)
    bound, centre, done = 0.0, lengths / capacity, 0
    values = [float(basis.x.sum())]
    while True:
        entered = 0
        for share in (0.5, 0.0) if done else (1.0,):
            at = share * centre + (1 - share) * basis.price
            best, took = knapsack(lengths, at, capacity)
            if at @ wanted / best[-1] > bound:
                bound, centre = float(at @ wanted / best[-1]), at / best[-1]
            worth = at + best[capacity - lengths]
            for j in np.argsort(-worth, kind="stable").tolist():
                if worth[j] <= 1 + IMPROVES:
                    break
                pattern = pattern_within(lengths, took, capacity - int(lengths[j]))
                pattern[j] += 1
                entered += basis.enter(pattern)
            if entered:
                break
        value = float(basis.x.sum())
        values.append(value)
        done += 1
        settled = gap and done > SETTLED_ROUNDS and values[-1 - SETTLED_ROUNDS] - value < SETTLED * value
        if settled or value <= max(bound * (1 + gap), math.ceil(bound - 1e-6) if gap else 0) or (not entered and done > 1) or done == rounds:
            break
    log.info("packing: %.2f sequences planned, at least %.2f needed, by %d rounds of pricing", value, bound, done)
    return [({int(lengths[i]): n for i, n in p.items()}, float(v)) for p, v in zip(basis.columns, basis.x, strict=True)], value / bound


def plan(histogram: dict[int, int], capacity: int, gap: float = GAP) -> np.ndarray:
    """Slots for all pieces: rows (length, first rank, copies in a sequence, first sequence, offset), by length and first rank.

    A piece of this length and rank r >= first takes sequence first_sequence +
    (r - first) // copies, at offset + (r - first) % copies * length.
    """
    left = {k: n for k, n in histogram.items() if n}
    whole = left.pop(capacity, 0)
    made: list[tuple[dict[int, int], int]] = [({capacity: 1}, whole)] if whole else []
    for pattern, count in column_generation(left, capacity, gap)[0]:
        count = min(int(count + 1e-6), *(left[k] // n for k, n in pattern.items()))
        if count > 0:
            made.append((pattern, count))
            for k, n in pattern.items():
                left[k] -= n * count
    room: list[tuple[int, int]] = []
    bins: list[Counter] = []
    for k in sorted(left, reverse=True):
        for _ in range(left[k]):
            i = bisect_left(room, (k, -1))
            free, b = room.pop(i) if i < len(room) else (capacity, len(bins))
            if b == len(bins):
                bins.append(Counter())
            bins[b][k] += 1
            insort(room, (free - k, b))
    made += [(dict(b), 1) for b in bins]
    rows, first, sequence = [], Counter(), 0
    for pattern, count in made:
        offset = 0
        for k in sorted(pattern, reverse=True):
            rows.append((k, first[k], pattern[k], sequence, offset))
            first[k] += pattern[k] * count
            offset += k * pattern[k]
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's pieces, with part and k: a piece is the k-th of its length in part, a task's number."""
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("k", pa.int64())]

    def run(batches):
        coder = worker_coder("library", library_coder, tokenizer_path)
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in slices(batches, 1):
            row_of, out = [], []
            coded = coder.batch(batch.column(1))
            bounds = coded.bounds.tolist()
            for i in range(batch.num_rows):
                ids = np.append(coded.ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    row_of.append(i)
                    out.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids), seen[len(piece)]))
                    seen[len(piece)] += 1
            if out:
                table = np.array(out, dtype=np.int64)
                arrays = [pa.array(table[:, j]) for j in range(5)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row_of)), *arrays, pa.array(np.full(len(out), part))], [id_col, *(n for n, _ in names), "part"])

    return docs.select(docs[id_col], text_or_empty(text_col).alias(text_col)).mapInArrow(run, f"`{id_col}` {id_type}, start long, length long, ids_crc32 long, doc_tokens long, k long, part long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", gap: float = GAP) -> DataFrame:
    """Sequences of at most capacity tokens: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row for each piece.

    A document is its ids by the tokenizers library and then end_id; each id
    lies in one piece. Null or empty text: one piece of just end_id. Null and
    repeated ids are kept, each row is packed by itself. Other columns are not
    read. An empty table gives no rows.

    Texts are tokenised once; the table of pieces (without ids) is written to
    the shared folder, so ranks stay fixed when a task is run again. Ranks come
    from counts by task and length, not from a global sort; a length that a
    third of all documents share is spread over all tasks.
    """
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    cut = scratch(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pack-pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = scratch(counts, "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    slots = plan(histogram, capacity, gap)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).select(cut[id_col], "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("k")).alias("rank"))
    held = spark.sparkContext.broadcast(slots)  # rows: lengths of a few thousand patterns, whatever the corpus

    def place(batches):
        table = held.value
        key = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            hit = table[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - hit[:, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(hit[:, 3] + nth // hit[:, 2]), pa.array(hit[:, 4] + nth % hit[:, 2] * length)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
