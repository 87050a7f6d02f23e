"""Document quality by ordinal regression: a cumulative-link (proportional odds) model on graded ratings.

All grades share one weight vector over hashed text features; ordered
thresholds cut the score into grades, P(grade > j) = sigmoid(score - t_j). The
model gives the expected grade and the probability of reaching a grade, by
which documents are selected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, text_or_empty
from .textbytes import LOWER, PAD, mixed, slices, span_hashes, text_bytes, words

BITS = 18
#: Of each byte, for a word's outline: upper case, lower case or part of another character, digit; marks stand for themselves.
OUTLINE = np.arange(256, dtype=np.uint8)
OUTLINE[ord("A") : ord("Z") + 1] = ord("A")
OUTLINE[ord("a") : ord("z") + 1] = ord("a")
OUTLINE[ord("0") : ord("9") + 1] = ord("0")
OUTLINE[0x80:] = ord("a")
#: Slots from here on are for features of the whole document.
_LENGTH, _FRESH = (1 << BITS), (1 << BITS) + 32
SIZE = _FRESH + 11


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two feature slots for each word (its lower-cased form and its outline), the words before each text, and two for each text (length, share of different words)."""
    body, bounds = text_bytes(texts)
    starts, ends, before = words(body, bounds)
    mask = np.uint64((1 << BITS) - 1)
    form = span_hashes(LOWER[body], starts, ends)[0]
    shape = OUTLINE[body]
    sizes = ends - starts
    outline = shape[starts].astype(np.uint64)
    for k in (1, 2, 3):  # the last three bytes
        outline = outline << np.uint64(8) | np.where(sizes >= k, shape[np.maximum(ends - k, 0)], 0).astype(np.uint64)
    outline = mixed(outline ^ (np.minimum(sizes, 20).astype(np.uint64) << np.uint64(40)))
    n = np.diff(before)
    different = np.array([len(np.unique(form[a:b])) for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)], dtype=np.int64)
    length = _LENGTH + np.minimum(np.log2(n + 1).astype(np.int64), 31)
    fresh = _FRESH + 10 * different // np.maximum(n, 1)
    return np.stack([(form & mask).astype(np.int64), (outline & mask).astype(np.int64)]), before, length, fresh


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j), a column for each threshold j."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -40, 40)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        slots, before, length, fresh = features(texts)
        total = np.concatenate([[0.0], np.cumsum(self.weights[slots[0]] + self.weights[slots[1]])])
        n = np.diff(before)
        return (total[before[1:]] - total[before[:-1]]) / np.maximum(n, 1) + self.weights[length] + self.weights[fresh]


def fit(rows: np.ndarray, slots: np.ndarray, values: np.ndarray, grades: np.ndarray, size: int = SIZE, rounds: int = 300, rate: float = 0.3, decay: float = 1e-5) -> OrdinalModel:
    """Maximum likelihood by Adam on sparse rows (row, slot, value); grades weigh alike however many rows they have.

    With fewer than two grades the thresholds alone hold the smoothed shares.
    """
    top = int(grades.max()) if len(grades) else 1
    counts = np.bincount(grades, minlength=top + 1).astype(np.float64)
    weights, steps = np.zeros(size), max(top, 1)
    if (counts > 0).sum() < 2:
        over = (np.cumsum(counts[::-1])[::-1][1:] + 1) / (counts.sum() + 1.5)
        return OrdinalModel(weights, -np.log(np.clip(over, 1e-6, 1 - 1e-6) / (1 - np.clip(over, 1e-6, 1 - 1e-6))))
    importance = (counts.sum() / ((counts > 0).sum() * np.maximum(counts, 1)))[grades]
    importance /= importance.sum()
    low, gaps = np.zeros(1), np.zeros(steps - 1)  # thresholds: low, then gaps that are exponentials
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, low, gaps)]
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate([low, np.exp(gaps)]))
        score = np.bincount(rows, values * weights[slots], minlength=len(grades))
        edges = np.concatenate([[-40.0], theta, [40.0]])
        upper, lower = edges[grades + 1] - score, edges[grades] - score
        sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        p_up, p_low = sig(upper), sig(lower)
        like = np.maximum(p_up - p_low, 1e-12)
        d_up, d_low = p_up * (1 - p_up) / like * importance, p_low * (1 - p_low) / like * importance
        d_score = d_up - d_low
        d_theta = np.array([d_low[grades == j + 1].sum() - d_up[grades == j].sum() for j in range(steps)])
        tail = np.cumsum(d_theta[::-1])[::-1]
        grads = [np.bincount(slots, values * d_score[rows], minlength=size) + decay * weights, tail[:1], tail[1:] * np.exp(gaps)]
        for k, (param, grad) in enumerate(zip((weights, low, gaps), grads, strict=True)):
            first, second = moments[k]
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            param -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return OrdinalModel(weights, np.cumsum(np.concatenate([low, np.exp(gaps)])))


def grade(quality: Column, toxic: Column) -> Column:
    """0: poor; 1: sound but toxic; 2: sound. A null quality is no rating, a null toxic is none."""
    return F.when(quality == 0, 0).when(quality == 1, F.when(F.coalesce(toxic, F.lit(0)) == 1, 1).otherwise(2))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 4000) -> OrdinalModel:
    """Fit on at most most_rows rated documents, those whose ids hash lowest; a document rated twice has its lower grade."""
    need(labels, "doc_id", "quality", "toxic")
    rated = labels.select(labels["doc_id"].alias("d"), grade(labels["quality"], labels["toxic"]).alias("grade")).where("d is not null and grade is not null")
    rated = rated.groupBy("d").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("d"), "d").limit(most_rows)
    texts = docs.select(docs["doc_id"], text_or_empty().alias("text"))
    chosen = texts.join(F.broadcast(rated), texts["doc_id"] == rated["d"]).select("doc_id", "text", "grade")  # most_rows rows of two numbers
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(most_rows) if most_rows else chosen.limit(0)

    def run(batches):
        for batch in slices(batches, 1):
            slots, before, length, fresh = features(batch.column(1))
            found = []
            for i in range(batch.num_rows):
                a, b = before[i], before[i + 1]
                at, n = np.unique(slots[:, a:b], return_counts=True)
                found.append((np.concatenate([at, [length[i], fresh[i]]]), np.concatenate([n / max(b - a, 1), [1.0, 1.0]])))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([f[0] for f in found], type=pa.list_(pa.int32())), pa.array([f[1] for f in found], type=pa.list_(pa.float32()))], ["grade", "slots", "part"])

    got = chosen.mapInArrow(run, "grade int, slots array<int>, part array<float>").toArrow()
    lists = got.column("slots").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    slots = lists.flatten().to_numpy().astype(np.int64)
    values = got.column("part").combine_chunks().flatten().to_numpy().astype(np.float64)
    return fit(rows, slots, values, got.column("grade").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: OrdinalModel, extra: list[str] = ()) -> DataFrame:
    """Every row's doc_id, the columns of extra, expected_grade and p_sound, the probability of a grade over 0.

    Whole texts are read. Null or empty text: no words, scored by its length
    alone. Rows stand alone, so null and repeated ids are no matter. No shuffle.
    """
    need(docs, "doc_id", "text")
    kept = ["doc_id", *extra]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # two megabytes, by BITS

    def run(batches):
        own = OrdinalModel(*held.value)
        for batch in slices(batches, 0):
            tails = own.tails(own.scores(batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(tails.sum(axis=1)), pa.array(tails[:, 0])], [*kept, "expected_grade", "p_sound"])

    return docs.select(text_or_empty().alias("\x00text"), *(docs[c] for c in kept)).mapInArrow(run, f"{fields}, expected_grade double, p_sound double")


def select(docs: DataFrame, labels: DataFrame, least: float = 0.5, most_rows: int = 4000, extra: list[str] = ()) -> DataFrame:
    """The documents that are probably sound, p_sound >= least, scored; see train and score."""
    return score(docs, train(docs, labels, most_rows), extra).where(F.col("p_sound") >= least)
